"""Approximate nearest neighbours by cross-polytope hashing.

A hash function applies a pseudo-random rotation (three times random signs and a fast
Hadamard transform) to the unit vector and takes the nearest signed axis.  A table's
key joins several such axes.  Rows are put under one key in each of ``TABLES`` tables; a
query also looks under the next best keys of each table (multiprobe).  The candidates
found are ranked by their exact cosine in double precision, on the original vectors.

Buckets keep their expected size whatever the number of rows n: a table has about
``KEYS`` n keys.  Each function names a signed axis; the last one looks at the first few
coordinates only, as many as it takes to come to that number of keys.  The probes grow as n to the power ``GROWTH``: near neighbours agree
in more axes than others, so that a query takes a share of the rows that falls as n grows.

Rows that a bucket has beyond ``APART`` don't count for n: near copies need no more keys.

Near copies share a key in most tables.  The rows of buckets of more than ``HEAVY`` rows are
grouped by the largest such bucket that each is in, which holds nearly all of its near copies.
A group gets tables of its own, by the same functions, of its rows' differences to a centre,
about ``KEYS`` keys for each of its rows.  A query that probes heavy buckets of a group in a
table looks once in the group's table of that number, however many these buckets are, under
``MORE`` times as many keys as it would in a table of that size.  A centre is fitted on at most
``SAMPLE`` rows of its group, and every row is put under the new keys.
Heavy buckets of these are split again, up to ``LEVELS`` times and while that helps.  A
query nearer to a centre than ``CENTRAL`` of the sample's mean distance has no direction to
go by and is compared with the whole bucket; rows in the centre itself (scaled copies) have
a key of their own, which each query looks under.

Queries that found fewer than ``k`` other rows, though there are more, probe 8 times as
many keys, then 64 times; those that still find too few are compared with all rows, in
blocks.

Equal vectors are one class, represented by its smallest ids (as many as a result can
name): a group of copies is a row in each table.  A pair of a query class and a row
class is compared once, however many tables it meets in.

Vectors that are null, zero or hold null or non-finite components take no part, as
query or candidate.  Vectors of different lengths aren't compared.  Rows with a null id
take no part; rows with one id and one vector are one row.  Ties go to the smaller id.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.store import arrow_rows, written

TABLES = 64
#: Keys that a query looks under in each table, of ``AT`` rows, and how they grow with the rows.
PROBES, AT, GROWTH = 34, 10_000, 0.35
#: Keys of a table for each row.
KEYS = 3
BLOCKS = 64
#: Rows of a bucket above which it is split, the rows at most that a centre is fitted on, and splits.
HEAVY, SAMPLE, LEVELS = 128, 16, 4
#: Times the probes in a split bucket, as a query doesn't meet all buckets of a group; rows of a bucket that count for the number of keys.
MORE, APART = 2, 8
#: Shares of a group's mean distance to its centre, and of a unit vector, under which a query and a row are in the centre.
CENTRAL, NOTHING = 0.5, 1e-7
#: The query vectors are sent to every task if they hold at most so many numbers, else joined to each pair.
MOST_SENT = 2_000_000
#: Queries that one row of a candidate lists at most, about.
LISTED = 4096
#: Rotations of a level, at least as many as tables.
TABLES_APART = 1 << 20
#: Pairs that are compared, and keys that are given out, at a time.
AT_ONCE = 50_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, normalised."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, function: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng([seed, table, function, x.shape[1]])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, padded with zeros to a power of two."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    width = 1 << max(vectors.shape[1] - 1, 0).bit_length()
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def axes(x: np.ndarray) -> np.ndarray:
    """Scores of the signed axes: 0 to d - 1 positive, d to 2 d - 1 negative."""
    return np.concatenate([x, -x], 1)


def functions_of(wanted: float, d: int) -> list[int]:
    """The signed axes that each function of a table of about ``wanted`` keys tells apart."""
    functions = []
    while wanted > 1.4:
        functions.append(min(2 * d, 2 * max(1, round(wanted / 2))))
        wanted /= functions[-1]
    return functions


def best_keys(x: np.ndarray, functions: list[int], table: int, probes: int, seed: int) -> np.ndarray:
    """The best keys of each row in a table, from 0 to the product of ``functions``."""
    n = len(x)
    probes = min(probes, math.prod(functions))
    total = np.zeros((n, 1))
    key = np.zeros((n, 1), np.int64)
    for f, m in enumerate(functions):
        scores = axes(rotated(x, table, f, seed)[:, : m // 2])
        most = min(scores.shape[1], probes)
        if most < scores.shape[1]:
            best = np.argpartition(-scores, most - 1, 1)[:, :most] if most > 1 else scores.argmax(1)[:, None]
        else:
            best = np.broadcast_to(np.arange(most), scores.shape)
        loss = (scores.max(1, keepdims=True) - np.take_along_axis(scores, best, 1)) ** 2
        total = (total[:, :, None] + loss[:, None, :]).reshape(n, -1)
        key = (key[:, :, None] * m + best[:, None, :]).reshape(n, -1)
        if total.shape[1] > probes:
            keep = np.argpartition(total, probes - 1, 1)[:, :probes]
            total, key = np.take_along_axis(total, keep, 1), np.take_along_axis(key, keep, 1)
    return key


def keys(vectors: np.ndarray, probes: int, tables: int, wanted: float, seed: int) -> np.ndarray:
    """Keys (row, table, probe) out of about ``wanted``, the best ones (fewer if there are no more); one probe gives the row's own keys."""
    x = unit(vectors)
    functions = functions_of(wanted, x.shape[1])
    every = math.prod(functions)
    out = np.zeros((len(x), tables, min(probes, every)), np.int64)
    for t in range(tables):
        out[:, t] = (vectors.shape[1] * tables + t) * every + best_keys(x, functions, t, probes, seed)
    return out


def matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each vector length in the batch."""
    lists = batch.column(column)
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(size) - size
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, flat[begin[rows][:, None] + np.arange(d)]


def hashed(probes: int, tables: int, wanted: float, seed: int):
    rows_at_once = max(1, 30_000 // probes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("cls").to_numpy()
            for rows, vectors in matrices(batch, "vector"):
                for a in range(0, len(rows), rows_at_once):
                    got = keys(vectors[a : a + rows_at_once], probes, tables, wanted, seed)
                    who = np.repeat(ids[rows[a : a + rows_at_once]], got.shape[1] * got.shape[2])
                    table = np.broadcast_to(np.arange(tables, dtype=np.int32)[:, None], got.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(got.reshape(-1)), pa.array(table.reshape(-1)), pa.array(who)], KEYED)

    return run


KEYED = ["key", "turn", "cls"]


def mixed(*numbers: np.ndarray) -> np.ndarray:
    """One number for several; two that come out alike only cost comparisons."""
    out = np.uint64(0)
    for x in numbers:
        out = (out ^ np.asarray(x, np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out = out ^ (out >> np.uint64(32))
    return out.view(np.int64)


def centre_of(group: pa.Table) -> pa.Table:
    """The mean of unit vectors, their mean distance to it and the rows of the group."""
    (batch,) = group.sort_by("first").combine_chunks().to_batches()
    ((_, vectors),) = matrices(batch, "vector")
    x = unit(vectors)
    centre = x.mean(0)
    return pa.table({"grp": batch.column("grp")[:1], "centre": pa.array([centre[: vectors.shape[1]]]), "radius": pa.array([np.linalg.norm(x - centre, axis=1).mean()]), "size": pa.array([pc.sum(batch.column("n")).as_py()])})


def keyed_batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    found, turn, who = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(found), pa.array(turn.astype(np.int32)), pa.array(who)], KEYED)


def split_keys(probes_of, level: int, seed: int, asked: bool):
    """The keys of each row's difference to its centre in the group's tables of the heavy buckets that it lists (``held``).

    The turn is the table; it is -1 where a query keeps the bucket's own key.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("held")
            count = held.value_lengths().to_numpy(zero_copy_only=False)
            key, turn = (held.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
            row = np.repeat(np.arange(batch.num_rows), count)
            ids, grp = (batch.column(k).to_numpy() for k in ("cls", "grp"))
            radius = batch.column("radius").to_numpy()
            size = 2 ** np.round(np.log2(batch.column("size").to_numpy())).astype(np.int64)
            # the first of several buckets that a row lists in a table
            once = np.zeros(len(row), bool)
            once[np.unique(np.stack([row, turn]), axis=1, return_index=True)[1]] = True
            for (rows, vectors), (_, centres) in zip(matrices(batch, "vector"), matrices(batch, "centre")):
                x = unit(vectors)
                x[:, : centres.shape[1]] -= centres
                away = np.linalg.norm(x, axis=1)
                local = np.full(batch.num_rows, -1)
                local[rows] = np.arange(len(rows))
                mine = np.flatnonzero(local[row] >= 0)
                at = local[row[mine]]
                whole = asked & (away[at] < CENTRAL * radius[rows[at]])
                inside = ~whole if asked else away[at] < NOTHING
                some = mine[inside & once[mine]]
                out = [(key[mine[whole]], np.full(whole.sum(), -1), ids[row[mine[whole]]]), (mixed(turn[some], grp[row[some]], np.full(len(some), -1)), turn[some], ids[row[some]])]
                rest = mine[(~whole if asked else ~inside) & once[mine]]
                for t, n in np.unique(np.stack([turn[rest], size[row[rest]]]), axis=1).T.tolist():
                    these = rest[(turn[rest] == t) & (size[row[rest]] == n)]
                    probes = probes_of(n) if asked else 1
                    for a in range(0, len(these), max(1, 30_000 // probes)):
                        part = these[a : a + max(1, 30_000 // probes)]
                        got = best_keys(x[local[row[part]]], functions_of(KEYS * n, x.shape[1]), TABLES_APART * (level + 1) + t, probes, seed)
                        each = np.repeat(part, got.shape[1])
                        out.append((mixed(turn[each], grp[row[each]], got.reshape(-1)), turn[each], ids[row[each]]))
                        if sum(len(y[0]) for y in out) > AT_ONCE:
                            yield keyed_batch(out)
                            out = []
                if out:
                    yield keyed_batch(out)

    return run


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two matrices, pair by pair: a pair's value does not depend on the others."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosines of pairs of vectors."""
    for batch in batches:
        for (rows, a), (_, b) in zip(matrices(batch, "qv"), matrices(batch, "cv")):
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in ("q", "c", "first")), pa.array(cosines(a, b))], ["q", "c", "first", "score"])


def best_of(q: np.ndarray, c: np.ndarray, first: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The ``most`` best rows of each query."""
    order = np.lexsort((c, first, -score, q))
    nth = np.arange(len(order)) - np.searchsorted(q[order], q[order])
    at = order[nth < most]
    return q[at], c[at], first[at], score[at]


def scored_lists(shared, most: int):
    """Cosines of candidates and the queries that they list; of each Arrow batch the ``most`` best of each query."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, place, vectors = shared.value
        for batch in batches:
            lists = batch.column("qs")
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            # places of the queries in the order of their ids, and each pair's row
            q = np.searchsorted(ids, lists.flatten().to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(batch.num_rows), n)
            c, first = (batch.column(k).to_numpy() for k in ("c", "first"))
            found = []
            for rows, mine in matrices(batch, "cv"):
                width = mine.shape[1]
                if width not in vectors:
                    continue
                local = np.full(batch.num_rows, -1)
                local[rows] = np.arange(len(rows))
                pairs = np.flatnonzero((local[row] >= 0) & (place[q, 0] == width))
                for a in range(0, len(pairs), AT_ONCE):
                    some = pairs[a : a + AT_ONCE]
                    score = cosines(vectors[width][place[q[some], 1]], mine[local[row[some]]])
                    found.append(best_of(q[some], c[row[some]], first[row[some]], score, most))
            if found:
                q, c, first, score = best_of(*(np.concatenate(x) for x in zip(*found)), most)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[q], c, first, score)], ["q", "c", "first", "score"])

    return run


def sent_queries(asked: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The ids of the query classes, sorted; of each its vector's length and place among those of that length; the vectors by length."""
    batch = asked.select("cls", "vector").orderBy("cls").toArrow().combine_chunks()
    ids = batch.column("cls").to_numpy()
    place = np.zeros((len(ids), 2), np.int64)
    vectors = {}
    for part in batch.to_batches()[:1]:
        for rows, some in matrices(part, "vector"):
            vectors[some.shape[1]] = some
            place[rows] = np.stack([np.full(len(rows), some.shape[1]), np.arange(len(rows))], 1)
    return ids, place, vectors


def nearest(
    rows: DataFrame, k: int = 5, every: int = 50, tables: int = TABLES, probes: int = PROBES, growth: float = GROWTH, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for every row whose id is divisible by ``every``."""
    spark = rows.sparkSession
    arrow_rows(spark)
    vectors = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").alias("vector")).where("id is not null and vector is not null")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = vectors.where(~bad & F.exists("vector", lambda x: x != 0))
    kind = vectors.schema["vector"].dataType.elementType  # type: ignore[attr-defined]
    # -0 and 0 are one value
    valid = valid.withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x)))
    first = Window.partitionBy("vector").orderBy("id")
    # a row more than a result can name, since a query's own row is left out
    top = valid.withColumn("nth", F.dense_rank().over(first)).where(F.col("nth") <= k + 1)
    classes = written(top.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    chosen = valid.where(F.col("id") % every == 0).distinct()
    asked = written(chosen.select("vector").distinct().withColumn("cls", F.monotonically_increasing_id()), "asked")
    queries = chosen.join(asked, "vector").select("id", "cls")

    keyed = "key bigint, turn int, cls bigint"
    one_table = classes.select("cls", "vector").mapInArrow(hashed(1, 1, KEYS * classes.count(), seed), keyed).groupBy("key").agg(F.count("*").alias("n"))
    # the rows, without those that a bucket has beyond what rows apart from each other come to
    n = one_table.agg(F.sum(F.least("n", F.lit(APART)))).first()[0] or 0
    in_all = KEYS * n
    index = written(classes.select("cls", "vector").mapInArrow(hashed(1, tables, in_all, seed), keyed), "index")
    of_vector = classes.select("cls", "vector", F.col("ids")[0].alias("first"))
    levels = []  # of each the (heavy key, group) and the groups' centres
    fresh, before = index, math.inf
    for level in range(LEVELS):
        heavy = written(fresh.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY), "heavy")
        heavy_rows = heavy.agg(F.sum("n")).first()[0]
        if not heavy_rows or heavy_rows > 0.9 * before:
            break
        before = heavy_rows
        members = fresh.join(heavy, "key").groupBy("cls").agg(F.max(F.struct("n", "key"))["key"].alias("grp"), F.collect_list(F.struct("key", "turn")).alias("held"))
        members = written(members.join(of_vector, "cls"), "members")
        # one row of each of so many parts of a group
        part = members.groupBy("grp", F.pmod(F.xxhash64("first"), F.lit(SAMPLE))).agg(F.min(F.struct(F.xxhash64("first", F.lit(level)), "first", "cls")).alias("x"), F.count("*").alias("n"))
        fitted = part.select("grp", "n", "x.first", "x.cls").join(classes.select("cls", "vector"), "cls")
        centres = written(fitted.select("grp", "n", "first", "vector").groupBy("grp").applyInArrow(centre_of, "grp bigint, centre array<double>, radius double, size bigint"), "centres")
        held = written(members.select("grp", F.explode("held").alias("h")).select("h.key", "grp").distinct(), "held")
        levels.append((held, centres))
        fresh = written(members.join(centres, "grp").select("cls", "grp", "vector", "centre", "radius", "size", "held").mapInArrow(split_keys(None, level, seed, False), keyed), "split")
        index = index.unionByName(fresh)
    index = index.select("key", F.col("cls").alias("c"))
    numbers = asked.agg(F.sum(F.size("vector"))).first()[0] or 0
    n_asked = asked.count()
    of_class = classes.select(F.col("cls").alias("c"), F.col("vector").alias("cv"), F.col("ids")[0].alias("first"))
    sent = spark.sparkContext.broadcast(sent_queries(asked)) if numbers <= MOST_SENT else None
    pair_score = "q bigint, c bigint, first bigint, score double"

    def met(some: DataFrame, probes: int) -> DataFrame:
        """The pairs of classes that share a key, with repeats."""
        probed = some.select("cls", "vector").mapInArrow(hashed(probes, tables, in_all, seed), keyed)
        parts = []
        for level, (held, centres) in enumerate(levels):
            probed = written(probed, "probed")
            parts += [probed.where("turn < 0"), probed.where("turn >= 0").join(held, "key", "left_anti")]
            asking = probed.where("turn >= 0").join(held, "key").groupBy("cls", "grp").agg(F.collect_list(F.struct("key", "turn")).alias("held"))
            asking = asking.join(some.select("cls", "vector"), "cls").join(centres, "grp").select("cls", "grp", "vector", "centre", "radius", "size", "held")
            probed = asking.mapInArrow(split_keys(lambda size: max(1, round(MORE * probes * (size / n) ** growth)), level, seed, True), keyed)
        for part in parts:
            probed = probed.unionByName(part)
        # never broadcast: the keys of either side are many times the rows
        return probed.select("key", F.col("cls").alias("q")).hint("merge").join(index, "key").select("q", "c")

    def best(pairs: DataFrame, some: DataFrame) -> DataFrame:
        """The k + 1 nearest (score, id) of each query class."""
        if sent is not None:
            group = F.pmod(F.xxhash64("q"), F.lit(n_asked // LISTED + 1))
            lists = pairs.groupBy("c", group.alias("part")).agg(F.collect_set("q").alias("qs"))
            got = lists.join(of_class, "c").select("c", "first", "qs", "cv").mapInArrow(scored_lists(sent, k + 1), pair_score)
        else:
            q = some.select(F.col("cls").alias("q"), F.col("vector").alias("qv"))
            got = pairs.distinct().join(of_class, "c").join(q, "q").where(F.size("qv") == F.size("cv")).select("q", "c", "first", "qv", "cv").mapInArrow(scored, pair_score)
        near = got.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first", "c"))).where(F.col("nth") <= k + 1)
        # each class before another in this order has an id before all of the other's: so k + 1 classes hold the k + 1 nearest ids
        named = near.join(classes.select(F.col("cls").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("id"))
        return written(named.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("nth") <= k + 1), "found")

    probes = max(1, round(probes * (n / AT) ** growth))
    found = best(met(asked, probes), asked)
    # the ids that there are for vectors of each length
    by_size = classes.groupBy(F.size("vector").alias("size")).agg(F.sum(F.size("ids")).alias("ids"))
    wanted = asked.withColumn("size", F.size("vector")).join(by_size, "size").select("cls", "vector", F.least(F.lit(k + 1), "ids").alias("wanted"))
    for times in (8, 64, None):
        counts = found.groupBy(F.col("q").alias("cls")).agg(F.count("*").alias("n"))
        few = written(wanted.join(counts, "cls", "left").where(F.coalesce("n", F.lit(0)) < F.col("wanted")).select("cls", "vector", "wanted"), "few")
        if few.isEmpty():
            break
        if times is None or probes * times >= in_all:
            block = F.pmod(F.xxhash64("cls"), F.lit(BLOCKS))
            spread = few.select(F.col("cls").alias("q"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BLOCKS - 1).cast("bigint"))).alias("block"))
            pairs = spread.join(classes.select(F.col("cls").alias("c"), block.alias("block")), "block").select("q", "c")
            times = None
        else:
            pairs = met(few, probes * times)
        found = found.join(few.select(F.col("cls").alias("q")), "q", "left_anti").unionByName(best(pairs, few))
        if times is None:
            break
        wanted = few
    named = queries.select(F.col("id").alias("query_id"), F.col("cls").alias("q")).join(found.select("q", "score", "id"), "q").where("query_id <> id")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
