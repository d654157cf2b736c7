"""Substring dedup by super-k-mers.

A window is ``k`` consecutive words of one document.  Windows are sent to buckets by
their minimiser, the smallest hash of their ``MINIMISER``-word runs: equal windows have
the same one.  Consecutive windows that share it travel together, as one packed string
of their words (a super-k-mer), so that a word is sent about three times and not ``k``
times.

1. Documents are dealt to blocks by a hash of their row.  A block keeps each of its
   different super-k-mers once, with a mark if it occurs more than once, and sends one
   row of packed strings to each bucket: a passage that fills a third of all rows is a
   string per block.
2. A bucket sorts the windows of all blocks.  Windows are compared by their words, not
   by hashes alone.  For each block it answers which windows of its strings occur
   anywhere else.
3. The block marks the words under those windows in all its documents, whose text never
   leaves the block's place: both steps read the same shuffled documents.

Words are runs of bytes other than space and 0x09 to 0x0D.  Windows are judged on the
input, so that every copy of a repeated passage goes.

Null and empty texts have no words and give the hash of an empty text.  Repeated rows
are documents of their own (each repeats the other); null ids stay null; extra columns
are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.store import arrow_rows
from larkspur.llm.textblock import WHITE, Block, Words, mix, release, text_bytes, window_hashes

K = 35
MINIMISER = 3
#: Text bytes of a block, and of the strings in a bucket, about.
BLOCK_BYTES, BUCKET_BYTES = 3 << 20, 5 << 20
PACKED = "bucket bigint, block bigint, packed binary"
ANSWER = "block bigint, bucket bigint, marks binary"
KEPT = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())]


def sliding_minimum(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


class SuperKmers:
    """The super-k-mers of a block: ``first`` window and number of windows ``n``; ``kind`` numbers the different strings.

    ``order``: an occurrence of each different string, by bucket and text.
    """

    def __init__(self, texts: list[bytes], k: int, buckets: int):
        self.k = k
        self.words = words = Words(Block(texts), WHITE)
        hashes = words.hashes()
        counts = np.diff(words.ptr)
        n_windows = max(len(words) - k + 1, 0)
        self.valid = words.doc[:n_windows] == words.doc[k - 1 :] if n_windows else np.zeros(0, bool)
        m = min(MINIMISER, k)
        low = sliding_minimum(mix(window_hashes(hashes, m)), k - m + 1)[:n_windows] if n_windows else np.zeros(0, np.uint64)
        at = np.flatnonzero(self.valid)
        new = np.ones(len(at), bool)
        new[1:] = (low[at[1:]] != low[at[:-1]]) | (np.diff(at) != 1)
        begin = np.flatnonzero(new)
        self.first = at[begin]
        self.n = np.diff(np.append(begin, len(at)))
        self.bucket = (mix(low[self.first]) % np.uint64(max(buckets, 1))).astype(np.int64)
        self.start = words.start[self.first]
        last = self.first + self.n + k - 2
        self.size = words.start[last] + words.length[last] - self.start
        self.counts = counts
        self._group(hashes)

    def _group(self, hashes: np.ndarray) -> None:
        """Different strings of words.  Strings are packed with single spaces, so that white space makes no difference."""
        raw, words, k = self.words.block.data.tobytes(), self.words, self.k
        kinds: dict[bytes, int] = {}
        kind = np.zeros(len(self.first), np.int64)
        starts, lengths = words.start, words.length
        single = np.ones(len(starts), bool)  # whether one space follows the word
        if len(starts) > 1:
            single[:-1] = (starts[1:] == starts[:-1] + lengths[:-1] + 1) & (words.block.data[starts[1:] - 1] == 0x20)
        odd = np.append(0, np.cumsum(~single))
        last = self.first + self.n + k - 2
        plain = odd[last] == odd[self.first] if len(last) else np.zeros(0, bool)
        for i, (s, n, ok) in enumerate(zip(self.start.tolist(), self.size.tolist(), plain.tolist())):
            text = raw[s : s + n]
            if not ok:
                text = b" ".join(text.split())
            kind[i] = kinds.setdefault(text, len(kinds))
        strings = list(kinds)
        self.kind = kind
        repeats = np.bincount(kind, minlength=len(strings))
        where = np.zeros(len(strings), np.int64)
        where[kind] = self.bucket
        windows = np.zeros(len(strings), np.int64)
        windows[kind] = self.n
        order = sorted(range(len(strings)), key=lambda i: (where[i], strings[i]))
        self.strings, self.repeats, self.where, self.windows, self.order = strings, repeats, where, windows, np.array(order, np.int64)

    def packed(self) -> list[tuple[int, bytes]]:
        """(bucket, strings) for each bucket."""
        out = []
        where = self.where[self.order]
        cuts = np.flatnonzero(np.diff(where, prepend=-1, append=-1))
        squeeze = zstandard.ZstdCompressor(level=3)
        for a, b in zip(cuts, cuts[1:]):
            some = self.order[a:b]
            lines = [(b"2" if self.repeats[i] > 1 else b"1") + self.strings[i] for i in some.tolist()]
            out.append((int(where[a]), squeeze.compress(b"\n".join(lines))))
        return out

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """Whether each word is under a window that the answers mark."""
        marks = np.zeros(int(self.windows.sum()), bool)
        begin = np.zeros(len(self.strings) + 1, np.int64)
        np.cumsum(self.windows[self.order], out=begin[1:])
        where = self.where[self.order]
        for bucket, raw in answers.items():
            a, b = np.searchsorted(where, bucket), np.searchsorted(where, bucket, side="right")
            size = begin[b] - begin[a]
            marks[begin[a] : begin[b]] = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8))[:size]
        place = np.zeros(len(self.strings), np.int64)  # of each string's marks
        place[self.order] = begin[:-1]
        total = int(self.n.sum())
        ends = np.cumsum(self.n)
        local = np.arange(total) - np.repeat(ends - self.n, self.n)
        window = np.repeat(self.first, self.n) + local
        hit = window[marks[np.repeat(place[self.kind], self.n) + local]]
        cover = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + self.k, -1)
        return np.cumsum(cover)[:-1] > 0


def repeated_windows(strings: list[bytes], twice: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of the strings, in order: their number per string, and which occur more than once."""
    words = Words(Block(strings), WHITE)
    hashes = words.hashes()
    # words with one hash must have the same bytes; number them by their bytes
    _, at, ids = np.unique(hashes, return_index=True, return_inverse=True)
    other = differing(words, at[ids])
    if len(other):
        known: dict[bytes, int] = {}
        raw = words.block.data
        ids = np.array([known.setdefault(raw[s : s + n].tobytes(), len(known)) for s, n in zip(words.start.tolist(), words.length.tolist())])
    runs = window_hashes(mix(ids.astype(np.uint64) + np.uint64(1)), k)
    valid = np.flatnonzero(words.doc[: len(runs)] == words.doc[k - 1 :]) if len(runs) else np.zeros(0, np.int64)
    owner = words.doc[valid]
    order = valid[np.argsort(runs[valid], kind="stable")]
    same = runs[order][1:] == runs[order][:-1]
    repeated = np.zeros(len(words) + 1, bool)
    left, right = order[:-1][same], order[1:][same]
    wrong = np.zeros(len(left), bool)
    for a in range(0, len(left), 200_000):  # windows with one hash are compared word by word
        x, y = left[a : a + 200_000], right[a : a + 200_000]
        for j in range(k):
            wrong[a : a + 200_000] |= ids[x + j] != ids[y + j]
    if wrong.any():  # a collision: those windows are sorted by their words
        bad = np.isin(runs[order], runs[left[wrong]])
        some = order[bad]
        _, group, n = np.unique(np.stack([ids[some + j] for j in range(k)], 1), axis=0, return_inverse=True, return_counts=True)
        repeated[some[n[group.reshape(-1)] > 1]] = True
        good = ~np.isin(runs[left], runs[left[wrong]])
        left, right = left[good], right[good]
    repeated[left] = repeated[right] = True
    marks = repeated[valid] | twice[owner]
    return np.bincount(owner, minlength=len(strings)), marks


def differing(words: Words, first: np.ndarray) -> np.ndarray:
    """Words whose bytes differ from those of the word given for them."""
    different = words.length != words.length[first]
    left = np.flatnonzero(~different)
    at = 0
    data = words.block.data
    while len(left):
        different[left] |= data[words.start[left] + at] != data[words.start[first[left]] + at]
        at += 1
        left = left[(words.length[left] > at) & ~different[left]]
    return np.flatnonzero(different)


def block_texts(rows: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """The block's rows in an order of their own, so that both steps see the same one."""
    texts, ids = text_bytes(rows.column("text")), pc.fill_null(rows.column("id"), 0).to_pylist()
    order = sorted(range(rows.num_rows), key=lambda i: (ids[i], texts[i]))
    return rows.take(pa.array(order, pa.int64())), [texts[i] for i in order]


def sender(k: int, buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        packed = SuperKmers(block_texts(rows)[1], k, buckets).packed()
        release()
        return pa.table([pa.array([b for b, _ in packed], pa.int64()), pa.array([key[0].as_py()] * len(packed), pa.int64()), pa.array([p for _, p in packed], pa.binary())], ["bucket", "block", "packed"])

    return run


def counter(k: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        plain = zstandard.ZstdDecompressor()
        parts = [plain.decompress(p).split(b"\n") for p in rows.column("packed").to_pylist()]
        lines = [line for part in parts for line in part]
        counts, marks = repeated_windows([x[1:] for x in lines], np.array([x[:1] == b"2" for x in lines], bool), k)
        ends = np.append(0, np.cumsum(counts))
        release()
        out, at = [], 0
        squeeze = zstandard.ZstdCompressor(level=3)
        for block, part in zip(rows.column("block").to_pylist(), parts):
            mine = marks[ends[at] : ends[at + len(part)]]
            at += len(part)
            if mine.any():
                out.append((block, squeeze.compress(np.packbits(mine).tobytes())))
        return pa.table([pa.array([b for b, _ in out], pa.int64()), pa.array([key[0].as_py()] * len(out), pa.int64()), pa.array([m for _, m in out], pa.binary())], ["block", "bucket", "marks"])

    return run


def keeper(k: int, buckets: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows, texts = block_texts(rows)
        found = SuperKmers(texts, k, buckets)
        words = found.words
        gone = found.repeated(dict(zip(answers.column("bucket").to_pylist(), answers.column("marks").to_pylist())))
        kept = texts_of(words, ~gone)
        removed = np.append(0, np.cumsum(gone))
        n_removed = removed[words.ptr[1:]] - removed[words.ptr[:-1]]
        old = rows.column("text").to_pylist()
        new = [t if n == 0 else t_kept.decode("utf-8", "replace") for t, n, t_kept in zip(old, n_removed.tolist(), kept)]
        columns = [c for c in rows.column_names if c not in ("text", "block")]
        return pa.table(
            [*(rows.column(c) for c in columns), pa.array(np.diff(words.ptr)), pa.array(n_removed), pa.array(new, pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())],
            [*columns, "n_words", "n_removed", "kept", "kept_sha256"],
        )

    return run


def texts_of(words: Words, kept: np.ndarray) -> list[bytes]:
    """The kept words of each document, joined by one space."""
    block = words.block
    step = np.zeros(block.size + 1, np.int8)
    step[words.start[kept]] = 1
    step[words.start[kept] + words.length[kept] + 1] -= 1  # with the byte after it
    use = np.cumsum(step[:-1], dtype=np.int8) > 0
    data = np.where(WHITE[block.data[: block.size]], np.uint8(0x20), block.data[: block.size])[use].tobytes()
    ends = np.append(0, np.cumsum(use))[block.ptr]
    return [data[a : max(a, b - 1)] for a, b in zip(ends.tolist(), ends[1:].tolist())]


def _removed(docs: DataFrame, k: int, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    """id, the struct ``rest`` of the named columns (if any), n_words, n_removed, kept and kept_sha256."""
    arrow_rows(docs.sparkSession)
    more = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), *more, F.col(f"`{text_col}`").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = size // BLOCK_BYTES + 1, 3 * size // BUCKET_BYTES + 1
    # rows without an id may all be alike, and are dealt by their place
    dealt = texts.withColumn("block", F.pmod(F.xxhash64(F.coalesce("id", -1 - F.monotonically_increasing_id()), "text"), F.lit(blocks)))
    sent = dealt.groupBy("block").applyInArrow(sender(k, buckets), PACKED)
    answers = sent.groupBy("bucket").applyInArrow(counter(k), ANSWER)
    schema = T.StructType([*[f for f in texts.schema if f.name != "text"], *KEPT])
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(keeper(k, buckets), schema)


def remove_repeats(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text that is left) and kept_sha256 of every document."""
    found = _removed(docs, k, id_col, text_col, [])
    return found.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept", "kept_sha256")


def strip_repeats(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents, with all their columns, without their repeated passages.

    Documents from which nothing is removed stay as they are; those of which no word is
    left go.  ``size_col``, if there is one, becomes the new number of characters.
    """
    names = docs.columns
    found = _removed(docs, k, id_col, text_col, [c for c in names if c != text_col])
    found = found.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    types = {f.name: f.dataType for f in docs.schema}

    def column(c: str):
        if c == text_col:
            return F.col("kept").alias(c)
        if c == size_col:
            return F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col("rest")[c]).cast(types[c]).alias(c)
        return F.col("rest")[c].alias(c)

    return found.select(*[column(c) for c in names])
