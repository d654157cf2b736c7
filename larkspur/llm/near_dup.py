"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its 5-word shingles (lower case, cut at ASCII
characters other than letters and digits; a shorter document is one shingle).  A
shingle's weight is its count in the document times its smoothed inverse document
frequency over all documents (see ``Idf``), which goes by the share of the documents
that hold it and not by their number: a pair weighs the same in a small corpus and in a
large one of the same make.  Document frequencies come from a table of ``1 << DF_BITS``
hashed counts: its size is fixed whatever the corpus, and each task fills one before
anything is shuffled.  What other shingles add to a place on average is taken off.

1. Every document gets ``BANDS * ROWS`` consistent weighted samples.  Two documents
   agree in a sample with a probability of their weighted Jaccard similarity.  Equal
   samples in a whole band make a bucket.
2. Documents with the same word sequence (128-bit key) are one node, so that copies cost
   a row each and no pair.
3. In each of a few rounds a bucket's nodes are compared with one of them, its pivot of
   the round, unless both are in one part already.  Verified links (weighted Jaccard of
   the whole texts >= the threshold) join parts.  After the first round the buckets
   left have the shingles counted that only one of their nodes has; the weight of the
   others bounds the similarity of a pair from above, so that nodes and pairs that can't
   reach the threshold aren't compared, and the nodes with the least of their own, which
   are near to most others, become the pivots.
4. All pairs across the parts that are left and that the bounds allow are compared, so
   that no link is lost.  A group of near copies is one part by then, and makes no pairs.
5. Parts are joined by large-star and small-star steps on tables, or on the driver if the
   links of a round are few (see ``components``); nothing of the size of the corpus
   reaches the driver.

Null ids and texts without words take part as documents of their own, without a class
mate.  Repeated rows are one row each.  An id that is repeated with other texts is a
document for each of them.  Extra columns are ignored, an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.components import components
from larkspur.llm.store import arrow_rows, forget, written
from larkspur.llm.textblock import PUNCT, Block, Words, document_keys, mix, release, shingles, slices, text_bytes, weighted

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
#: Rounds in which each bucket is compared with one of its nodes, before all pairs that are left are.
PIVOTS = 3
DF_BITS = 20
#: Share of the documents below which a shingle counts as rare.
FLOOR = 1 / 1024
CHUNK = 1 << 14
#: Quantile tables of the samples' random numbers.
SIZE = 1 << 16


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and ln c of Gamma(2, 1) and beta of U(0, 1), each at SIZE quantiles."""
    u = (np.arange(SIZE) + 0.5) / SIZE
    low, high = np.zeros(SIZE), np.full(SIZE, 40.0)
    for _ in range(60):  # inverse of the distribution function 1 - exp(-x) (1 + x)
        mid = (low + high) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low.astype(np.float32), np.log(low).astype(np.float32), u.astype(np.float32)


def shingled(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their hashes, and the distinct shingles with document and count."""
    words = Words(Block(texts), PUNCT)
    hashes = words.hashes()
    return words, hashes, *weighted(*shingles(words, hashes, SHINGLE))


def packed(counts: np.ndarray) -> bytes:
    """Numbers from 0 up, in as few bytes each as the largest takes."""
    return counts.astype(np.min_scalar_type(int(counts.max())).newbyteorder("<")).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // CHUNK}").astype(np.int64)


def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's document frequencies, as chunks of the table."""
    table, n = np.zeros(1 << DF_BITS, np.int64), 0
    for part in slices(batches, "text"):
        _, _, h, _, _ = shingled(text_bytes(part.column("text"), lower=True))
        table += np.bincount((h >> np.uint64(64 - DF_BITS)).astype(np.int64), minlength=1 << DF_BITS)
        n += part.num_rows
    if n:
        starts = np.arange(0, 1 << DF_BITS, CHUNK)
        counts = [packed(table[s : s + CHUNK]) for s in starts]
        yield pa.RecordBatch.from_arrays([pa.array(starts // CHUNK), pa.array(np.full(len(starts), n) * (starts == 0)), pa.array(counts, pa.binary())], ["chunk", "n", "counts"])


def summed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the chunks of a task, by chunk."""
    tables: dict[int, np.ndarray] = {}
    docs: dict[int, int] = {}
    for batch in rows:
        for c, n, raw in zip(*(batch.column(k).to_pylist() for k in ("chunk", "n", "counts"))):
            tables[c] = tables.get(c, 0) + unpacked(raw)
            docs[c] = docs.get(c, 0) + n
    if tables:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(tables), pa.int64()), pa.array([docs[c] for c in tables], pa.int64()), pa.array([packed(t) for t in tables.values()], pa.binary())], ["chunk", "n", "counts"]
        )


class Idf:
    """Weights of shingles: 1 + ln((1 + FLOOR) / (share + FLOOR)) / ln((1 + FLOOR) / FLOOR), so from 1 (in all documents) to 2 (in next to none).

    The smoothing keeps a large group of copies together: its shared shingles are frequent
    because of the group, and must not weigh next to nothing against single edits.  Below
    a share of FLOOR weights change little, so that what is left of the error of a count
    matters little: it is about the square root of the table's load a place, and its share
    of the documents falls as they grow.
    """

    def __init__(self, docs: int, table: np.ndarray):
        size = len(table)
        own = (table - table.sum() / size) * (size / (size - 1))
        share = np.clip(own, 1, max(docs, 1)) / max(docs, 1)
        self.weights = (1 + np.log((1 + FLOOR) / (share + FLOOR)) / np.log((1 + FLOOR) / FLOOR)).astype(np.float32)

    def of(self, h: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.weights[(h >> np.uint64(64 - DF_BITS)).astype(np.int64)] * count.astype(np.float32)


def inverse_frequencies(texts: DataFrame) -> Idf:
    """From all documents; what reaches the driver are the 8 MB of the table at most."""
    schema = "chunk bigint, n bigint, counts binary"
    parts = texts.select("text").mapInArrow(frequencies, schema)
    # the sums of a few tasks each, then those of all, so that no task gathers more than it can hold
    some = parts.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(16))).repartition("chunk", "salt").drop("salt").mapInArrow(summed, schema)
    # in one job: an iterator would run one for each partition, one after the other
    rows = some.repartition("chunk").mapInArrow(summed, schema).toArrow()
    table, docs = np.zeros(1 << DF_BITS, np.int64), 0
    for chunk, n, raw in zip(*(rows.column(k) for k in ("chunk", "n", "counts"))):
        table[chunk.as_py() * CHUNK : (chunk.as_py() + 1) * CHUNK] += unpacked(raw.as_py())
        docs += n.as_py()
    out = Idf(docs, table)
    del table, rows
    release()
    return out


def bands_of(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, tables) -> np.ndarray:
    """The band hashes of n documents (rows without shingles: zeros)."""
    gamma, log_gamma, uniform = tables
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    owner = doc[first] if len(first) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(h)))
    segment = np.repeat(np.arange(len(first)), size)
    log_weight = np.log(weight)
    out = np.zeros((n, BANDS), np.uint64)
    low = np.uint64(0xFFFF)
    for band in range(BANDS):
        key = np.full(len(first), band + 1, np.uint64)
        for row in range(ROWS):
            bits = mix(h ^ np.uint64((band * ROWS + row + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            r = gamma[(bits & low).astype(np.int64)]
            log_c = log_gamma[(bits >> np.uint64(16) & low).astype(np.int64)]
            beta = uniform[(bits >> np.uint64(32) & low).astype(np.int64)]
            t = np.floor(log_weight / r + beta)
            a = log_c - r * (t - beta + 1)
            least = np.minimum.reduceat(a, first) if len(first) else a
            at = np.flatnonzero(a == least[segment])
            # of equal values the smallest shingle
            pick = np.full(len(first), 2**64 - 1, np.uint64)
            np.minimum.at(pick, segment[at], mix(h[at] ^ t[at].astype(np.int64).view(np.uint64)))
            key = mix(key ^ pick)
        out[owner, band] = key
    return out


def sampled(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, tables = shared.value, _tables()
        for part in slices(batches, "text", 2 << 20):
            words, hashes, h, doc, count = shingled(text_bytes(part.column("text"), lower=True))
            bands = bands_of(h, doc, idf.of(h, count), part.num_rows, tables)
            k1, k2 = document_keys(words, hashes)
            size = np.diff(words.ptr)
            nodes = [f"{a:016x}{b:016x}" if n else None for a, b, n in zip(k1.tolist(), k2.tolist(), size.tolist())]
            flat = pa.array(bands.reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (part.num_rows + 1), BANDS, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(nodes, pa.string()), lists], ["id", "node", "bands"])

    return run


def verified(shared, threshold: float):
    """The parts of pairs whose texts have a weighted Jaccard similarity of at least the threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for part in (s for b in slices(batches, "text_a") for s in slices([b], "text_b")):
            n = part.num_rows
            texts = text_bytes(part.column("text_a"), lower=True) + text_bytes(part.column("text_b"), lower=True)
            _, _, h, doc, count = shingled(texts)
            weight = idf.of(h, count).astype(np.float64)
            total = np.bincount(doc, weight, 2 * n)
            pair, side = doc % n, doc >= n
            order = np.lexsort((side, h, pair))
            h, pair, side, weight = h[order], pair[order], side[order], weight[order]
            both = np.flatnonzero((h[1:] == h[:-1]) & (pair[1:] == pair[:-1]) & (side[1:] != side[:-1]))
            common = np.bincount(pair[both], np.minimum(weight[both], weight[both + 1]), n)
            union = total[:n] + total[n:] - common
            good = common >= threshold * union - 1e-9
            yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(good)) for k in ("part_a", "part_b")], ["a", "b"])

    return run


def links_of(pairs: DataFrame, texts: DataFrame, shared, threshold: float) -> DataFrame:
    """The parts of the verified pairs of nodes."""
    a, b = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").select("part_a", "part_b", "text_a", "text_b").mapInArrow(verified(shared, threshold), "a string, b string")


def weights_of(shared):
    """Each distinct shingle of each text, with its weight and the first half of the node's key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            _, _, h, doc, count = shingled(text_bytes(part.column("text"), lower=True))
            key = np.array([int(n[:16], 16) for n in part.column("node").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key[doc]), pa.array(shared.value.of(h, count))], ["h", "k", "w"])

    return run


def whole_weights(shared):
    """The weight of each text, and the first half of the node's key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            _, _, h, doc, count = shingled(text_bytes(part.column("text"), lower=True))
            weight = np.bincount(doc, shared.value.of(h, count), part.num_rows)
            key = np.array([int(n[:16], 16) for n in part.column("node").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(key), pa.array(weight)], ["node", "k", "weight"])

    return run


def common_weights(texts: DataFrame, shared) -> DataFrame:
    """node, its weight and how much of it lies on shingles that other nodes of the table have too.

    Two nodes have at most the smaller of their common weights in common, which bounds
    their similarity from above without looking at the pair.
    """
    rows = texts.mapInArrow(weights_of(shared), "h bigint, k bigint, w float")
    alone = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("k").alias("k"), F.min("w").alias("w")).where("n = 1").groupBy("k").agg(F.sum(F.col("w").cast("double")).alias("alone"))
    found = texts.mapInArrow(whole_weights(shared), "node string, k bigint, weight double").join(alone, "k", "left")
    return found.select("node", "weight", (F.col("weight") - F.coalesce("alone", F.lit(0.0))).alias("common"))


def joined_parts(buckets: DataFrame, bands: DataFrame, texts: DataFrame, shared, threshold: float) -> DataFrame:
    """node and part (the smallest node that it is linked to, over any number of links) of all nodes in buckets."""
    parts = buckets.select("node").distinct().withColumn("part", F.col("node"))
    counted = [F.expr("(n * n - within) div 2").alias("pairs"), F.col("n").alias("members")]
    least = F.least("common_a", "common_b")
    possible = least >= (threshold - 1e-6) * (F.col("weight_a") + F.col("weight_b") - least)
    weighed = buckets.withColumns({"weight": F.lit(1.0), "common": F.lit(1.0)})
    for turn in range(PIVOTS + 1):
        if turn:
            placed = weighed.join(parts, "node")
            by_part = placed.groupBy("band", "key", "part").agg(F.count("*").alias("n"))
            sizes = by_part.groupBy("band", "key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"), F.count("*").alias("parts")).where("parts > 1")
            open_buckets = sizes = written(sizes, "open-buckets")
        else:  # each node is a part
            placed = weighed.withColumn("part", F.col("node"))
            sizes = placed.groupBy("band", "key").agg(F.count("*").alias("n"), F.count("*").alias("within"))
        left = sizes.select(*counted).agg(F.sum("pairs").alias("pairs"), F.sum("members").alias("members")).first()
        if not left.pairs:
            break
        member = written(placed.join(open_buckets.select("band", "key"), ["band", "key"]), "open-members") if turn else placed
        if turn == 1:
            some = texts.join(member.select("node").distinct(), "node")
            common = written(common_weights(some, shared), "common-weights").where(F.col("common") >= (threshold - 1e-6) * F.col("weight"))
            weighed = written(member.select("node", "band", "key").join(common, "node"), "weighed")
            member = weighed.join(parts, "node")
        last = turn == PIVOTS or 2 * left.pairs <= left.members
        one, two = (member.select("band", "key", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "part", "weight", "common")]) for k in "ab")
        if last:
            # a pair that meets in several bands is made in the first of them
            one, two = (x.join(bands.select(F.col("node").alias(f"node_{k}"), F.col("bands").alias(f"bands_{k}")), f"node_{k}") for x, k in ((one, "a"), (two, "b")))
            first = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), True) == F.col("band") + 1
            pairs = one.join(two, ["band", "key"]).where((F.col("part_a") < F.col("part_b")) & possible & first)
        else:
            # in the first round any node; then those with the least of their own, which are near to most others
            order = F.struct(F.when(F.lit(turn == 0), F.xxhash64("node_b")).otherwise(F.lit(0)), F.col("common_b") / F.col("weight_b"), "node_b", "part_b", "weight_b", "common_b")
            # written, so that both sides of the join are plain shuffles: a hot bucket is split by the skew join
            best = written(two.groupBy("band", "key").agg(F.max(order).alias("p")), "pivots")
            pairs = one.join(best.select("band", "key", "p.node_b", "p.part_b", "p.weight_b", "p.common_b"), ["band", "key"]).where((F.col("part_a") != F.col("part_b")) & possible)
            if turn:  # a pivot of one round is none of the next, and a bucket in one part stays so
                weighed = member.drop("part").join(best.select("band", "key", F.col("p.node_b").alias("node")), ["band", "key", "node"], "left_anti")
        ends = [F.struct(F.col(f"node_{k}").alias("node"), F.col(f"part_{k}").alias("part")) for k in "ab"]
        pairs = pairs.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y"))
        pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.part").alias("part_a"), F.col("y.part").alias("part_b")).distinct()
        label = components(links_of(pairs, texts, shared, threshold))
        parts = written(parts.join(label.withColumnRenamed("node", "part"), "part", "left").select("node", F.coalesce("label", "part").alias("part")), "parts")
        if last:
            break
    return parts


def _classed(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """id, node, ``first`` (smallest (id, node) of the group) and n_members of every row; first is null for a null id or a text without words."""
    spark = docs.sparkSession
    arrow_rows(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    shared = spark.sparkContext.broadcast(inverse_frequencies(texts))
    rows = written(texts.mapInArrow(sampled(shared), "id bigint, node string, bands array<bigint>"), "samples")

    nodes = rows.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min("bands").alias("bands"))
    members = nodes.select("node", "id", F.posexplode("bands").alias("band", "key"))
    several = members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    buckets = written(members.join(several, ["band", "key"]), "buckets")

    wanted = buckets.select("node", "id").distinct()
    # an id may be repeated with other texts: the text must have the node's key
    with_text = texts.join(wanted, "id").select("node", "text").mapInArrow(keyed, "node string, text string")
    with_text = written(with_text.dropDuplicates(["node"]), "bucket-texts")
    parts = joined_parts(buckets.select("node", "band", "key"), nodes.select("node", "bands"), with_text, shared, threshold)
    forget(with_text)

    placed = nodes.select("node", "id", "n").join(parts, "node", "left").select("node", "id", "n", F.coalesce("part", "node").alias("part"))
    # written, so that both sides of the join are plain shuffles: a hot part is split by the skew join
    classes = written(placed.groupBy("part").agg(F.min(F.struct("id", "node")).alias("first"), F.sum("n").alias("n_members")), "classes")
    of_node = written(placed.select("node", "part").join(classes, "part").select("node", "first", "n_members"), "classed-nodes")
    known = rows.where("node is not null and id is not null").select("id", "node").join(of_node, "node")
    # rows of no node don't meet in a join
    others = rows.where("node is null or id is null").select("id", "node", F.lit(None).cast(of_node.schema["first"].dataType).alias("first"), F.lit(1).cast("bigint").alias("n_members"))
    return known.select("id", "node", "first", "n_members").unionByName(others)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its group, its own if alone; null for a null id) and n_members of every row."""
    classed = _classed(docs, threshold, id_col, text_col)
    return classed.select(F.col("id").alias(id_col), F.coalesce("first.id", "id").alias("class_id"), "n_members")


def noded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the keys of their word sequences, which are null without words."""
    for part in slices(batches, "text"):
        words = Words(Block(text_bytes(part.column("text"), lower=True)), PUNCT)
        k1, k2 = document_keys(words, words.hashes())
        nodes = [f"{a:016x}{b:016x}" if n else None for a, b, n in zip(k1.tolist(), k2.tolist(), np.diff(words.ptr).tolist())]
        yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("id"), pa.array(nodes, pa.string())], ["doc", "id", "node"])


def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the word sequence of their node."""
    for part in slices(batches, "text"):
        words = Words(Block(text_bytes(part.column("text"), lower=True)), PUNCT)
        k1, k2 = document_keys(words, words.hashes())
        good = pa.array([f"{a:016x}{b:016x}" == n for a, b, n in zip(k1.tolist(), k2.tolist(), part.column("node").to_pylist())], pa.bool_())
        yield pa.RecordBatch.from_arrays([part.column("node").filter(good), part.column("text").filter(good)], ["node", "text"])


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, without those whose group has a smaller one, by id and then by the key of the words.

    Of rows with one id and one word sequence all stay or go: they are one document.  Rows
    with a null id and texts without words stay.
    """
    gone = _classed(docs, threshold, id_col, text_col).where(F.struct("id", "node") != F.col("first")).select("id", "node").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([rows.schema["doc"], T.StructField("id", T.LongType()), T.StructField("node", T.StringType())])
    kept = rows.mapInArrow(noded, schema).join(gone, ["id", "node"], "left_anti")
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
