"""Connected components of a table of links, by alternating large-star and small-star steps.

At most ``FEW`` links are joined on the driver, which takes no shuffle; the labels are the same.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.store import forget, written

MOST_ROUNDS = 60
#: Links at most that the driver joins: with keys of 32 letters, 7 MB.
FEW = 100_000


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours (large star: the larger ones; small star: the smaller ones and itself) linked to its smallest neighbour or itself."""
    if larger:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # written, so that both sides of the join are plain shuffles: the centre of a large star is split by the skew join
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    joined = both.join(least, "a")
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def joined(edges: DataFrame) -> DataFrame:
    """node and label of a few links, to be broadcast."""
    kind = edges.schema["a"].dataType
    found = edges.toArrow()
    above: dict = {}

    def top(x):
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]  # halves the way
        return x

    for a, b in zip(*(found.column(k).to_pylist() for k in "ab")):
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    nodes = list(above)
    table = pa.table({k: pa.array(v, found.schema.field("a").type) for k, v in (("node", nodes), ("label", [top(x) for x in nodes]))})
    frame = edges.sparkSession.createDataFrame(table)
    return F.broadcast(frame.select(*[F.col(c).cast(kind).alias(c) for c in frame.columns]))


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for every node that has a link.

    Each round takes two shuffles of the links, whatever the component's shape; a
    component of n nodes takes O(log n) rounds and never passes through one task as a
    whole, but for the final links to its smallest node.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.count() <= FEW:
        return joined(edges)
    for _ in range(MOST_ROUNDS):
        after = written(_star(_star(edges, True), False), "edges")
        # a forest of stars to smallest nodes: no node has two links, and no centre has one
        twice = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not twice and not after.join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            centres = after.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("label"))
            return after.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(centres)
        forget(edges)
        edges = after
    raise RuntimeError("the components did not settle")
