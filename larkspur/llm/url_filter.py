"""URL filter by a Bloom filter cascade, in DataFrame functions only.

The rules are (host, path, verdict).  A url's candidate keys are its host suffixes
and path prefixes in the shapes (labels, path length) that the rules have.  The
cascade answers whether a candidate is a listed key, without a join and without
error over the corpus's own keys:

* level 0 holds the listed keys;
* level 1 the corpus's candidates that pass level 0 but aren't listed;
* level 2 the listed keys that pass level 1; and so on until nothing is left.

A candidate is listed if the first level that rejects it is an odd one.  Candidates
that level 0 rejects never leave their task, so that what is shuffled to build a
level is its false positives and not the key universe.  A level is one literal of a
size fixed by the number of rules (16 bits a rule at level 0), which ``max_rules``
bounds, as the list itself is held by the driver; a longer list is refused.

Null urls and those without ``://`` have an empty host and path and fit no rule.
Repeated rows are judged each; other columns are ignored; an empty table gives no
rows.  Two rules with one key: a block wins.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.store import forget, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = 4
MOST_LEVELS = 40


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII-lowered; path: then up to ``?``, ``#`` or the end."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    rest = F.split_part(F.split_part(rest, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    df = df.withColumn("_rest", F.coalesce(rest, F.lit("")))
    host = F.translate(F.split_part("_rest", F.lit("/"), F.lit(1)), UPPER, LOWER)
    return df.withColumn("host", host).withColumn("path", F.expr("substring(_rest, char_length(split_part(_rest, '/', 1)) + 1)")).drop("_rest")


def suffix(host: Column, labels: int) -> Column:
    """The last ``labels`` labels of the host; null if it has fewer."""
    enough = F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) >= labels - 1
    return F.when(enough, F.substring_index(host, ".", -labels))


def candidates(shapes: list[tuple[int, int]]) -> Column:
    """The url's keys in the given shapes, the longest first."""
    keys = []
    for labels, size in shapes:
        path = F.when(F.char_length("path") >= size, F.substring("path", 1, size))
        keys.append(F.concat(suffix(F.col("host"), labels), path))
    # keys of one shape differ in length from url to url, so they are ordered by their own length
    made = F.array_compact(F.array(*keys))
    return F.reverse(F.array_sort(F.transform(made, lambda k: F.struct(F.char_length(k).alias("n"), k.alias("key")))))


class Level:
    """A Bloom filter as one literal: an array of 64-bit words, read from text when the query is planned."""

    def __init__(self, keys: DataFrame, count: int, bits_per_key: int, salt: int):
        self.bits = max(64, -(-count * bits_per_key // 64) * 64)
        self.salt = salt
        at = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("at"))
        words = at.groupBy(F.expr("at div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("v"))
        self.words = [0] * (self.bits // 64)
        for row in words.toLocalIterator():  # at most bits / 64 rows
            self.words[row.w] = row.v
        self.literal = F.split(F.lit(" ".join(map(str, self.words))), " ").cast("array<bigint>")

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.salt * HASHES + i)), F.lit(self.bits)) for i in range(HASHES)]

    def holds(self, key: Column) -> Column:
        found = F.lit(True)
        for at in self.places(key):
            found = found & (F.getbit(F.get(self.literal, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
        return found


def listed(levels: list[Level], key: Column) -> Column:
    """Whether the cascade lists the key: the number of levels that it passes in turn is odd."""
    answer = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        answer = F.when(levels[i].holds(key), answer).otherwise(F.lit(i % 2 == 1))
    return answer


def cascade(rules: DataFrame, universe: DataFrame, bits_per_key: int = 16) -> list[Level]:
    """Levels that answer exactly for every key of ``universe`` (one column ``key``, repeats allowed) and of ``rules``."""
    levels: list[Level] = []
    inside, outside = rules.select("key").distinct(), universe.select("key")
    while True:
        i = len(levels)
        if i == MOST_LEVELS:
            raise RuntimeError("the cascade does not end")
        source = inside if i % 2 == 0 else outside
        count = source.count()
        if count == 0 and i:
            return levels
        levels.append(Level(source, count, bits_per_key, i))
        passed = levels[i].holds(F.col("key"))
        if i % 2 == 0:
            kept = outside.where(passed)
            kept = written(kept.distinct().join(rules.select("key"), "key", "left_anti") if i == 0 else kept, "false-positives")
            forget(outside)
            outside = kept
        else:
            inside = inside.where(passed)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_rules: int = 1_000_000) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null) and verdict of every row."""
    spark = pages.sparkSession
    verdicts: dict[str, str] = {}
    shapes: set[tuple[int, int]] = set()
    for host, path, verdict in rules:
        shapes.add((host.count(".") + 1, len(path)))
        key = host + path
        verdicts[key] = "block" if "block" in (verdict, verdicts.get(key)) else verdict
    if len(verdicts) > max_rules:
        raise ValueError(f"{len(verdicts)} rules; the cascade's filters hold at most max_rules = {max_rules}")
    urls = with_host_and_path(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))).select("page_id", "host", "path")
    if not verdicts:
        none = F.lit(None).cast("string")
        return urls.select(F.col("page_id").alias(id_col), "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    keys = candidates(sorted(shapes))
    universe = urls.select(F.explode(keys).alias("k")).select(F.col("k.key").alias("key"))

    def table(keys: list[str]) -> DataFrame:
        """The keys as rows of one literal: no Python worker makes them."""
        return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(keys)), "array<string>")).alias("key"))

    every = cascade(table(sorted(verdicts)), universe)
    blocked = [k for k, v in sorted(verdicts.items()) if v == "block"]
    fits = F.filter(F.transform("keys", lambda k: k["key"]), lambda k: listed(every, k))
    judged = urls.withColumn("keys", keys).withColumn("rule", F.get(fits, F.lit(0)))
    block = listed(cascade(table(blocked), table(sorted(verdicts))), F.col("rule")) if blocked else F.lit(False)
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(block, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("page_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
