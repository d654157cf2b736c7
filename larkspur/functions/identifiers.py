"""Identifiers on targets that fold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 63


def folded(name: Column) -> Column:
    """A Postgres identifier: lower case, other characters than letters, digits and ``_`` become ``_``;
    a leading digit gets ``col_`` before it, an empty name is ``col_``.  Beyond 63 bytes it is cut
    between characters and ends in ``_`` and the CRC-32 of the whole name."""
    clean = F.regexp_replace(F.lower(name), r"[^\p{L}\p{Nd}_]", "_")
    clean = F.when((clean == "") | clean.rlike(r"^\p{Nd}"), F.concat(F.lit("col_"), clean)).otherwise(clean)
    mark = F.concat(F.lit("_"), F.lower(F.lpad(F.hex(F.crc32(F.encode(clean, "UTF-8"))), 8, "0")))
    # the longest prefix of whole characters within the bytes that are left
    sizes = F.transform(F.sequence(F.lit(0), F.lit(MOST_BYTES - 9)), lambda n: F.substring(clean, F.lit(1), n))
    prefix = F.element_at(F.filter(sizes, lambda p: F.octet_length(p) <= MOST_BYTES - 9), -1)
    return F.when(F.octet_length(clean) > MOST_BYTES, F.concat(prefix, mark)).otherwise(clean)


def valid(name: Column) -> Column:
    """At most 128 characters, a letter or ``_`` first, then letters, digits, ``_``, space, ``$`` or ``#``."""
    return (F.char_length(name) <= 128) & name.rlike(r"^[\p{L}_][\p{L}\p{Nd}_ $#]*$")


def collisions(names: DataFrame, scope: list[str], name: str) -> DataFrame:
    """Different names of a scope that fold to one identifier, with their number."""
    found = names.select(*scope, name).distinct().withColumn("folded", folded(F.col(name)))
    return found.groupBy(*scope, "folded").agg(F.count("*").alias("names")).where("names > 1")
