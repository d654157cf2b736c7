"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared if they share a seed, a run of ``seed``
words (lower case, cut at ASCII characters other than letters and digits).  Running
Karp-Rabin hashes find the seeds; equal hashes are confirmed word by word.  The longest
match of unmarked words is marked as a tile in both texts, again and again, until no
match of at least ``seed`` words is left.  A document is contaminated by an item of
which tiles cover at least ``threshold``; the order of the tiles does not matter, so
passages that were cut up and reordered count too.  An item with fewer than ``seed``
words is one seed by itself; items without words match nothing.  Where both repeat
words, so that pairs of seeds are many, the longest matches are found by halving
their length instead of from a list of the pairs.

The benchmark is handled in blocks of at most ``block_words`` words: each block's seeds
and texts are broadcast, which bounds what an executor holds, and what one block found is
written before the next begins.  Usual benchmarks are one block.  Documents and items are
lower-cased by the same function, character by character.

Null and empty texts are clean.  Repeated rows are judged each, null ids stay null,
extra columns are ignored, an empty table gives no rows, an empty benchmark leaves all
documents clean.  Items with a null id contaminate like others: they are one null, the
last, among the items found.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.store import arrow_rows, written
from larkspur.llm.textblock import PUNCT, Block, Words, mix, slices, text_bytes, window_hashes

SEED = 5
THRESHOLD = 0.8
#: Pairs of seeds of a document and an item beyond which they aren't listed; the tiles are the same.
MOST_PAIRS = 10_000
FOUND = [T.StructField("_items", T.ArrayType(T.LongType())), T.StructField("_coverage", T.DoubleType())]


class Benchmark:
    """One block of items, with their seeds in sorted arrays."""

    def __init__(self, items: list[tuple[int | None, bytes]], seed: int):
        self.words = words = Words(Block([t for _, t in items]), PUNCT)
        hashes = words.hashes()
        self.ids = [i for i, _ in items]
        self.n_words = np.diff(words.ptr)
        self.size = np.minimum(self.n_words, seed)  # of an item's seeds
        self.seeds: dict[int, tuple[np.ndarray, ...]] = {}  # size -> hashes and items, sorted, the number of seeds of each, and where they are in the last, the words that they begin at
        for size in np.unique(self.size[self.size > 0]).tolist():
            runs = window_hashes(hashes, size)
            at = np.flatnonzero((words.doc[: len(runs)] == words.doc[size - 1 :]) & (self.size[words.doc[: len(runs)]] == size))
            at = at[np.argsort(runs[at], kind="stable")]  # of one hash by item, then by place
            new = np.ones(len(at), bool)
            new[1:] = (runs[at[1:]] != runs[at[:-1]]) | (words.doc[at[1:]] != words.doc[at[:-1]])
            first = np.flatnonzero(new)
            self.seeds[size] = runs[at[first]], words.doc[at[first]], np.diff(np.append(first, len(at))), first, at

    def coverage(self, words: Words, hashes: np.ndarray) -> dict[int, dict[int, float]]:
        """For each document the items that it shares seeds with, and the share of their words under tiles."""
        out: dict[int, dict[int, float]] = defaultdict(dict)
        for size, (seeds, items, many, start, begin) in self.seeds.items():
            runs = window_hashes(hashes, size)
            first, last = np.searchsorted(seeds, runs), np.searchsorted(seeds, runs, side="right")
            hit = np.flatnonzero((last > first) & (words.doc[: len(runs)] == words.doc[size - 1 :]))
            n = last[hit] - first[hit]
            at = np.repeat(hit, n)
            which = np.repeat(first[hit] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            order = np.lexsort((at, items[which], words.doc[at]))
            at, which = at[order], which[order]
            doc, item = words.doc[at], items[which]
            cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (item[1:] != item[:-1])) + 1 if len(at) else []
            for i, w in zip(np.split(at, cuts), np.split(which, cuts)) if len(at) else []:
                d, k = int(words.doc[i[0]]), int(items[w[0]])
                covered = self._in_pairs(words, i, w, size, many, start, begin) if many[w].sum() <= MOST_PAIRS else self._in_runs(words, i, k, size)
                if covered:
                    out[d][k] = covered / int(self.n_words[k])
        return out

    def _in_pairs(self, words: Words, at: np.ndarray, which: np.ndarray, size: int, many: np.ndarray, start: np.ndarray, begin: np.ndarray) -> int:
        """The words under tiles, from all pairs of seeds."""
        n = many[which]
        seed = begin[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        pairs = [(i, j) for i, j in zip(np.repeat(at, n).tolist(), seed.tolist()) if all(word(words, i + x) == word(self.words, j + x) for x in range(size))]
        return sum(n for _, _, n in tiles(pairs, size))

    def _in_runs(self, words: Words, at: np.ndarray, item: int, size: int) -> int:
        """The same from the words that seeds cover, without a pair for each two places: texts may repeat a word thousands of times."""
        ids: dict[bytes, int] = {}
        pattern = np.array([ids.setdefault(word(self.words, j), len(ids)) for j in range(self.words.ptr[item], self.words.ptr[item + 1])], np.int64)
        at = np.unique(at)
        covered = np.unique(np.concatenate([at + x for x in range(size)]))
        text = [ids.get(word(words, i), -1) for i in covered.tolist()]
        apart = np.flatnonzero(np.diff(covered) > 1) + 1
        return sum(n for _, _, n in longest_first(np.insert(np.array(text, np.int64), apart, -1), pattern, size))


def word(words: Words, i: int) -> bytes:
    return words.block.data[words.start[i] : words.start[i] + words.length[i]].tobytes()


def tiles(seeds: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from all common runs of ``size`` words (place in text, place in pattern).

    Seeds on one diagonal that follow each other form a match; the longest match is taken
    first, ties by place.  A match that meets marked words is cut down to its unmarked
    runs, which compete again.
    """
    heap: list[tuple[int, int, int]] = []
    by_diagonal: dict[int, list[int]] = defaultdict(list)
    for i, j in set(seeds):
        by_diagonal[i - j].append(i)
    for diagonal, places in by_diagonal.items():
        places.sort()
        first = last = places[0]
        for i in [*places[1:], None]:
            if i != last + 1 if i is not None else True:
                heap.append((-(last - first + size), first, first - diagonal))
                first = i
            last = i
    heapq.heapify(heap)
    text: set[int] = set()
    pattern: set[int] = set()
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        free = [x for x in range(-n) if i + x not in text and j + x not in pattern]
        if len(free) == -n:
            out.append((i, j, -n))
            text.update(range(i, i - n))
            pattern.update(range(j, j - n))
            continue
        run: list[int] = []
        for x in [*free, None]:
            if run and x != run[-1] + 1 if x is not None else True:
                if len(run) >= size:
                    heapq.heappush(heap, (-len(run), i + run[0], j + run[0]))
                run = []
            if x is not None:
                run.append(x)
    return out


def longest_first(text: np.ndarray, pattern: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """The tiles of ``tiles`` of two sequences of numbers; negative ones match nothing.

    The longest common run of unmarked numbers is found by halving: runs of a length
    are hashed, and looked up in those of the pattern.  Memory grows with the sum of the lengths.
    """
    text, pattern = text.copy(), pattern.copy()
    out: list[tuple[int, int, int]] = []

    def starts(x: np.ndarray, n: int) -> np.ndarray:
        """Where runs of n begin that hold no negative number."""
        bad = np.concatenate([[0], np.cumsum(x < 0)])
        return np.flatnonzero(bad[n:] == bad[:-n])

    def found(n: int, salt: int) -> tuple[int, int] | None:
        """The first common run of n: where it begins in either."""
        if n > min(len(text), len(pattern)):
            return None
        i, j = starts(text, n), starts(pattern, n)
        if not len(i) or not len(j):
            return None
        a, b = (window_hashes(mix(x.astype(np.uint64) + np.uint64(salt)), n)[k] for x, k in ((text, i), (pattern, j)))
        same = np.flatnonzero(np.isin(a, b))
        return (int(i[same[0]]), int(j[np.flatnonzero(b == a[same[0]])[0]])) if len(same) else None

    most, salt = min(len(text), len(pattern)), 1
    while True:
        low, high, best = size - 1, most, None  # a run of low is there, none of more than high
        while low < high:
            n = (low + high + 1) // 2
            here = found(n, salt)
            if here:
                low, best = n, here
            else:
                high = n - 1
        if best is None:
            return out
        i, j = best
        if not np.array_equal(text[i : i + low], pattern[j : j + low]):
            salt += 1  # hashes that collided don't under another salt
            continue
        out.append((i, j, low))
        text[i : i + low] = pattern[j : j + low] = -1
        most = low


def judge(shared, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark: Benchmark = shared.value
        for part in slices(batches, "text"):
            words = Words(Block(text_bytes(part.column("text"), lower=True)), PUNCT)
            found = benchmark.coverage(words, words.hashes())
            items: list[list[int]] = [[] for _ in range(part.num_rows)]
            most = np.zeros(part.num_rows)
            for d, covered in found.items():
                most[d] = max(covered.values())
                items[d] = sorted((benchmark.ids[k] for k, c in covered.items() if c >= threshold), key=lambda i: (i is None, i or 0))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names), pa.array(items, pa.list_(pa.int64())), pa.array(most)], [*part.schema.names, "_items", "_coverage"])

    return run


def blocks(benchmark: DataFrame, block_words: int, seed: int, id_col: str, text_col: str) -> Iterator[Benchmark]:
    """The benchmark in blocks; the driver holds one at a time."""
    held: list[tuple[int | None, bytes]] = []
    size = 0
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    for row in rows.orderBy("id", "text").toLocalIterator():
        text = text_bytes(pa.array([row.text]), lower=True)[0]
        n = len(Words(Block([text]), PUNCT))
        if held and size + n > block_words:
            yield Benchmark(held, seed)
            held, size = [], 0
        if n:
            held.append((row.id, text))
            size += n
    if held:
        yield Benchmark(held, seed)


def contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[Column], text: Column, threshold: float = THRESHOLD, seed: int = SEED, block_words: int = 2_000_000, item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The kept columns, the text, ``_items`` (ids of the items found, sorted) and ``_coverage`` (the largest) of every document."""
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = docs.select(*keep, text.alias("text"), F.array().cast("array<bigint>").alias("_items0"), F.lit(0.0).alias("_coverage0"))
    judged = None
    for part in blocks(benchmark, block_words, seed, item_col, item_text):
        if judged:  # the block before: no task holds two
            rows = written(rows, "block-judged")
            judged.destroy()
        judged = spark.sparkContext.broadcast(part)
        rows = rows.mapInArrow(judge(judged, threshold), T.StructType([*rows.schema, *FOUND]))
        rows = rows.withColumns({"_items0": F.array_sort(F.array_union("_items0", "_items")), "_coverage0": F.greatest("_coverage0", "_coverage")}).drop("_items", "_coverage")
    return rows.withColumnsRenamed({"_items0": "_items", "_coverage0": "_coverage"})


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, contaminated, items (sorted ids) and coverage (of the item covered most) of every document."""
    found = contamination(docs, benchmark, [F.col(id_col).alias("_id")], F.col(text_col), **options)
    return found.select(F.col("_id").alias(id_col), (F.size("_items") > 0).alias("contaminated"), F.col("_items").alias("items"), F.col("_coverage").alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, that no item contaminates."""
    names = docs.columns
    rest = F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("_rest")
    found = contamination(docs, benchmark, [rest], F.col(f"`{text_col}`"), **options).where(F.size("_items") == 0)
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col("_rest")[c].alias(c) for c in names])
