"""Best-fit packing, planned over the histogram of lengths.

1. Each document's ids and the end id are cut into pieces; a task numbers its
   pieces within each length as it goes, so no length is ever gathered in one place.
2. The histogram has at most ``capacity`` rows.  The driver runs best-fit decreasing
   over its counts: a step places all pieces of one length that fit bins with the same
   room.  The plan holds runs of ranks, not documents, and its size depends on the
   number of different lengths only.
3. A piece's rank within its length (numbers of earlier tasks plus its own) is joined
   to the planned runs, which gives its sequence and offset.

Null and empty texts are the end id alone.  Repeated rows are packed each; null ids
stay null; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.pretokens import IdCache, Pieces, char_classes, id_cache, supported
from larkspur.llm.store import arrow_rows, written
from larkspur.llm.textblock import slices, text_bytes

PIECES = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, nth bigint"
PACKED = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def document_ids(texts: list[bytes], cache: IdCache, specials: list[tuple[str, int]], classes: np.ndarray) -> list[np.ndarray]:
    """The token ids of each text."""
    found = Pieces(texts, specials, classes)
    begin, sizes = cache.of(found.distinct())
    each = sizes[found.which]
    ends = np.cumsum(each)
    index = np.repeat(begin[found.which] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)
    every = cache.flat[index]
    # ids before each segment
    cut = np.searchsorted(found.segment, np.arange(len(found.special) + 1))
    at = np.append(0, ends)[cut]
    out = []
    for r in range(len(texts)):
        a, b = found.first_segment[r], found.first_segment[r + 1]
        parts = []
        for s in range(a, b):
            parts.append(every[at[s] : at[s + 1]])
            if found.special[s] >= 0:
                parts.append(np.array([found.special[s]], np.uint32))
        out.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
    return out


def pieces_of(path: str, capacity: int, end_id: int):
    specials = supported(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, numbers, classes = id_cache(path), np.zeros(capacity + 1, np.int64), char_classes(path)
        task = TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        for part in slices(batches, "text"):
            rows: list[tuple] = []
            for i, ids in zip(part.column("id").to_pylist(), document_ids(text_bytes(part.column("text")), cache, specials, classes)):
                ids = np.concatenate([ids, end]).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, int(numbers[b - a])))
                    numbers[b - a] += 1
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces in a sequence, first offset), by length and rank.

    Best-fit decreasing: a piece goes where the least room is left that holds it.
    """
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, number)
    rooms: list[int] = []
    steps: list[tuple[int, int, int, int, int]] = []
    fresh = 0

    def put(room: int, first: int, number: int) -> None:
        if number and room:
            if room not in open_runs:
                open_runs[room] = []
                insort(rooms, room)
            open_runs[room].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, number = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room]
                    rooms.pop(k)
            else:
                room, first, number = capacity, fresh, -(-left // (capacity // length))
                fresh += number
            fits = room // length
            full = min(number, left // fits)
            if full:
                steps.append((length, rank, first, fits, capacity - room))
                rank += full * fits
                left -= full * fits
                put(room - fits * length, first, full)
            if full < number and left:  # fewer than fits are left: one sequence takes them
                steps.append((length, rank, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, number - full)
    return np.array(sorted(steps), np.int64).reshape(-1, 5)


def place(steps):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planned = steps.value
        key = planned[:, 0] << 44 | planned[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            step = planned[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            nth = rank - step[:, 1]
            sequence, slot = step[:, 2] + nth // step[:, 3], nth % step[:, 3]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(step[:, 4] + slot * length)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    spark = docs.sparkSession
    path = os.path.abspath(path)
    arrow_rows(spark)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    pieces = written(texts.mapInArrow(pieces_of(path, capacity, end_id), PIECES), "packed-pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    steps = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(earlier, ["length", "task"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    placed = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place(steps), PACKED)
    return placed.withColumnRenamed("id", id_col)
