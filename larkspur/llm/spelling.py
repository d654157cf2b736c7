"""Spelling variants: words one edit apart, grouped under the most frequent of them.

1. Words are counted in each task, and summed over all documents; those of at least
   ``least_letters`` letters and ``least_n`` occurrences are the vocabulary.
2. The letters of a word that occur an odd number of times are a bit mask, cut into
   three bands.  One edit flips two bits at most, so that two near words agree in a
   band at least.  Words are joined on equal bands, with lengths that differ by one at most.
3. A band alone has few values, and all words of a value would be compared, so that
   each is divided further: one edit leaves the first or the last ``s // 2`` letters of
   both words alone, where s is the shorter length.  The join key is band, its value,
   s, the side and these letters; no near pair is lost by it.
4. A joined pair is looked at under the first key that it shares, and near if its masks
   differ in two bits at most and its edit distance is one.
5. A word's form is its near word of largest count (ties: the smallest in code-point
   order) if that is ``ratio`` times its own at least.  Counts grow along forms, so that
   they end; roots are found by doubling the steps.

Nothing is gathered in one task or on the driver: keys of many words are split by the
skew join, as a join is all that is done with them.  All joins sort and merge by hint, as
Spark takes the vocabulary for its compressed files and the keyed rows for no more than
it, so that it would broadcast millions of them by way of the driver.

Runs of ``[A-Za-z\\u00C0-\\u00FF]`` count, A-Z lowered.  With ``drop_every``, the run of a
document whose unsigned crc32 h of ``<doc_id>:<run>`` it divides loses the letter h %
length: this plants misspellings; None leaves texts alone.  A null text has no runs, a
null id counts as ``None`` in the key; repeated rows count each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.store import arrow_rows, forget, written
from larkspur.llm.textblock import release, slices, text_bytes

#: Runs in UTF-8 whose ASCII is lowered: a to z, and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Distinct words that a task holds before it passes them on.
HELD = 300_000
BANDS, WIDTH = 3, 21
#: Letters dealt over the bands by how often they are used, so that no band has the frequent ones alone.
BY_USE = "etaoinshrdlcumwfgypbvkjxqz"


def bits() -> np.ndarray:
    """The bit of each code point below 256; letters beyond ASCII share bits of their band, which can only hide a flip."""
    out = np.zeros(256, np.int64)
    used = [0] * BANDS
    for i, letter in enumerate(BY_USE):
        band = (0, 1, 2, 2, 1, 0)[i % 6]
        out[ord(letter)] = 1 << (band * WIDTH + used[band])
        used[band] += 1
    for i in range(0xC0, 0x100):
        band = i % BANDS
        out[i] = 1 << (band * WIDTH + used[band] + i // BANDS % (WIDTH - used[band]))
    return out


BITS = bits()


def counter(drop_every: int | None, least_letters: int):
    """Partial counts of the words of the batches: (word, n)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            keys = [w for w in held if len(w.decode()) >= least_letters]
            for i in range(0, len(keys), 50_000):
                some = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in some], pa.string()), pa.array([held[w] for w in some], pa.int64())], ["word", "n"])
            held.clear()

        for piece in slices(batches, "text"):
            ids = piece.column("id").to_pylist()
            for doc, text in zip(ids, text_bytes(piece.column("text"))):
                found = Counter(x for x in RUN.findall(text.lower()) if len(x) >= least_letters)
                if drop_every:
                    start = zlib.crc32(f"{doc}:".encode())
                    hashes = [zlib.crc32(x, start) for x in found]
                    for word, h in [(w, h) for w, h in zip(found, hashes) if h % drop_every == 0]:
                        letters = word.decode()
                        at = h % len(letters)
                        held[(letters[:at] + letters[at + 1 :]).encode()] += found.pop(word)
                for word, n in found.items():
                    held[word] += n
                if len(held) > HELD:
                    yield from out()
        yield from out()
        release()

    return run


def with_masks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        size = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        ends = np.cumsum(size)
        mask = np.bitwise_xor.reduceat(BITS[letters], ends - size) if len(words) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(size.astype(np.int32)), pa.array(mask)], ["word", "n", "size", "mask"])


def vocabulary(docs: DataFrame, least_letters: int = 6, least_n: int = 5, drop_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, size (letters) and mask (letters of odd number) of the words that are frequent and long enough."""
    arrow_rows(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    partial = texts.mapInArrow(counter(drop_every, least_letters), "word string, n bigint")
    words = partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)
    return words.mapInArrow(with_masks, "word string, n bigint, size int, mask bigint")


def keyed(words: DataFrame, shorter: list[str]) -> DataFrame:
    """A row for each word, band, side and each ``s`` of ``shorter``: the length of the shorter word of a pair."""
    low = (1 << WIDTH) - 1
    ways = ", ".join(f"named_struct('band', {j}, 'side', {side}, 's', {s})" for j in range(BANDS) for side in (0, 1) for s in shorter)
    split = words.select("word", "n", "size", "mask", F.explode(F.expr(f"array({ways})")).alias("k"))
    value = F.expr(f"shiftright(mask, {WIDTH} * k.band) & {low}")
    letters = F.expr("if(k.side = 0, left(word, k.s div 2), right(word, k.s div 2))")
    key = F.xxhash64("k.band", value, "k.s", "k.side", letters)  # words that merely share a hash aren't near
    return split.select(key.alias("key"), "k.band", "k.side", "k.s", "word", "n", "size", "mask")


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of words one edit apart, once: a, n_a, b, n_b."""
    left = keyed(words, ["size"]).select("key", "band", "side", "s", *[F.col(c).alias(f"{c}_a") for c in ("word", "n", "mask")])
    right = keyed(words, ["size", "size - 1"]).select("key", *[F.col(c).alias(f"{c}_b") for c in ("word", "n", "mask", "size")])
    low = (1 << WIDTH) - 1
    flips = "(mask_a ^ mask_b)"
    first = [f"(band <= {j} or ({flips} & {low << (WIDTH * j)}L) != 0)" for j in range(BANDS - 1)]
    first.append("(side = 0 or left(word_a, s div 2) != left(word_b, s div 2))")
    near = f"bit_count({flips}) <= 2 and (size_b > s or word_a < word_b) and {' and '.join(first)} and levenshtein(word_a, word_b, 1) = 1"
    return left.join(right.hint("merge"), (left["key"] == right["key"]) & F.expr(near)).select(F.col("word_a").alias("a"), F.col("n_a"), F.col("word_b").alias("b"), F.col("n_b"))


def forms(words: DataFrame, ratio: int) -> DataFrame:
    """word, n_near, form and form_n of the words that have near words."""
    both = near_pairs(words).select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), (-F.col("n_b")).alias("less"), F.col("b").alias("near")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), (-F.col("n_a")).alias("less"), F.col("a").alias("near")),
    )).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("n"), F.min(F.struct("less", "near")).alias("best"))
    follows = -F.col("best.less") >= F.col("n") * ratio
    return best.select("word", "n_near", F.when(follows, F.col("best.near")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """word and root of the words that have a form: each round doubles the steps."""
    chain = written(found.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(chain.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        forget(chain)
        if longer.where("moved").isEmpty():
            return longer.select("word", "root")
        chain = longer


def variants(docs: DataFrame, least_letters: int = 6, least_n: int = 5, ratio: int = 5, drop_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form (null if none), root, n, n_near and form_n of every word of the vocabulary."""
    words = written(vocabulary(docs, least_letters, least_n, drop_every, id_col, text_col), "spelling-words")
    found = written(forms(words, ratio), "spelling-forms")
    out = words.select("word", "n").join(found.hint("merge"), "word", "left").join(roots(found).hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")
