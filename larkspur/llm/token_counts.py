"""Token counts: pieces counted once per distinct pre-token.

1. One pass gathers the distinct pre-tokens with their frequencies; partial sums are
   made in each task, so a frequent pre-token is a row per task before the shuffle.
2. The library counts the pieces of each distinct pre-token once.
3. A second pass makes per-document pre-token frequencies.  The most frequent
   pre-tokens (``head_rows`` of at most 16 bytes each, and a tenth of that of at most
   ``LONGEST`` bytes, such as ruled lines: a fixed bound of some 9 MB) are summed on the
   spot from a broadcast table; the others leave as (row, pre-token, frequency), are
   joined to the counted vocabulary and summed; a pre-token that is hot and longer
   still is split by the skew join.  The head decides where a sum is made, never its value.

No token ids are kept for any document.

Null and empty texts have 0 bytes and 0 tokens; repeated rows give a row each, null
ids stay null; columns other than the id and the text are ignored; an empty table
gives no rows.  Special strings inside texts count as the library counts them.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.pretokens import Pieces, char_classes, string_array, supported, tokenizer
from larkspur.llm.store import arrow_rows, written
from larkspur.llm.textblock import slices, span_hashes, span_keys, text_bytes

VOCABULARY = "token string, n bigint"
COUNTED = "token string, n bigint, pieces int"
FREQUENCIES = "row bigint, id bigint, n_bytes bigint, n_head bigint, tail array<struct<token:string,n:bigint>>"
#: Distinct pre-tokens that a task holds before it passes them on.
HELD = 400_000
#: Characters that the library encodes at once.
AT_ONCE = 1 << 18
#: Bytes of the longest pre-token of the head.
LONGEST = 512


def vocabulary_of(path: str):
    specials = supported(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        classes = char_classes(path)

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(held)
            for i in range(0, len(keys), 50_000):
                some = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([string_array(some), pa.array([held[k] for k in some], pa.int64())], ["token", "n"])
            held.clear()

        for piece in slices(batches, "text"):
            found = Pieces(text_bytes(piece.column("text")), specials, classes)
            counts = np.bincount(found.which, minlength=len(found.at)).tolist()
            for key, n in zip(found.distinct(), counts):
                held[key] = held.get(key, 0) + n
            if len(held) > HELD:
                yield from out()
        yield from out()

    return run


def by_size(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of at most ``AT_ONCE`` characters, or of one text: the library keeps some hundred bytes a piece."""
    some: list[str] = []
    size = 0
    for text in texts:
        if some and size + len(text) > AT_ONCE:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def count_pieces(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tokenizer(path)
        for batch in batches:
            texts = batch.column("token").to_pylist()
            pieces: list[int] = []
            for some in by_size(texts):
                pieces += [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("n"), pa.array(pieces, pa.int32())], ["token", "n", "pieces"])

    return run


class Head:
    """Pre-tokens with their piece counts, found by exact bytes."""

    def __init__(self, rows: list[tuple[str, int]]):
        from larkspur.llm.textblock import Block

        every = [(t.encode(), p) for t, p in rows]
        short = [(t, p) for t, p in every if len(t) <= 16]
        self.long = {t: p for t, p in every if len(t) > 16}
        block = Block([t for t, _ in short])
        length = np.diff(block.ptr) - 1
        start = block.ptr[:-1]
        h = span_hashes(block, start, length)
        k1, k2 = span_keys(block, start, length)
        order = np.argsort(h)
        new = np.ones(len(order), bool)
        new[1:] = h[order][1:] != h[order][:-1]  # of two with one hash, one goes the other way
        order = order[new]
        self.hash, self.k1, self.k2, self.length = h[order], k1[order], k2[order], length[order]
        self.pieces = np.array([p for _, p in short], np.int64)[order] if short else np.zeros(0, np.int64)

    def counts(self, found: Pieces) -> np.ndarray:
        """Piece counts of the distinct pre-tokens; -1 for those that aren't in the head."""
        out = np.full(len(found.at), -1, np.int64)
        length = found.length[found.at]
        if len(self.hash) and len(out):
            start, h = found.start[found.at], found.hash[found.at]
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            k1, k2 = span_keys(found.block, start, np.minimum(length, 16))
            same = (self.hash[at] == h) & (self.length[at] == length) & (self.k1[at] == k1) & (self.k2[at] == k2)
            out[same] = self.pieces[at[same]]
        if self.long:
            for i in np.flatnonzero((length > 16) & (length <= LONGEST)).tolist():
                out[i] = self.long.get(found.bytes(int(found.at[i])), -1)
        return out


def frequencies(path: str, head):
    specials = supported(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes = head.value, char_classes(path)
        for piece in slices(batches, "text"):
            texts = text_bytes(piece.column("text"))
            found = Pieces(texts, specials, classes)
            counts = known.counts(found)
            first = np.array(found.first_segment)
            row_of = np.repeat(np.arange(len(texts)), np.diff(first))
            row = row_of[found.segment]
            each = counts[found.which]
            n_head = np.zeros(len(texts), np.int64)
            np.add.at(n_head, row[each >= 0], each[each >= 0])
            np.add.at(n_head, row_of[np.array(found.special) >= 0], 1)
            rest = each < 0
            pair, n = np.unique(row[rest] * len(found.at) + found.which[rest], return_counts=True)
            rows, which = np.divmod(pair, max(len(found.at), 1))
            used, index = np.unique(which, return_inverse=True)
            tokens = string_array([found.bytes(int(i)) for i in found.at[used]]).take(pa.array(index))
            offsets = np.zeros(len(texts) + 1, np.int32)
            np.cumsum(np.bincount(rows, minlength=len(texts)), out=offsets[1:])
            tail = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([tokens, pa.array(n, pa.int64())], ["token", "n"]))
            yield pa.RecordBatch.from_arrays(
                [piece.column("row"), piece.column("id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(n_head), tail],
                ["row", "id", "n_bytes", "n_head", "tail"],
            )

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, head_rows: int = 100_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every text."""
    spark = docs.sparkSession
    path = os.path.abspath(path)
    arrow_rows(spark)
    texts = docs.select(F.col(text_col).alias("text"))
    found = texts.mapInArrow(vocabulary_of(path), VOCABULARY).groupBy("token").agg(F.sum("n").alias("n"))
    counted = written(found.mapInArrow(count_pieces(path), COUNTED), "pieces")
    size = F.octet_length("token")
    # bounded by rows times bytes
    short = counted.where(size <= 16).orderBy(F.desc("n"), "token").limit(head_rows)
    long = counted.where((size > 16) & (size <= LONGEST) & (F.col("n") > 1)).orderBy(F.desc("n"), "token").limit(head_rows // 10)
    rows = [(r.token, r.pieces) for some in (short, long) for r in some.select("token", "pieces").toLocalIterator()]
    shared = spark.sparkContext.broadcast(Head(rows))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = written(numbered.mapInArrow(frequencies(path, shared), FREQUENCIES), "frequencies")
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.token", "t.n")
    sums = tail.join(counted.select("token", "pieces"), "token").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("n_tail"))
    total = F.col("n_head") + F.coalesce("n_tail", F.lit(0))
    return rows.drop("tail").join(sums, "row", "left").select(F.col("id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
