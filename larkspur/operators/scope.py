"""Filters that decide which tables and which changes are looked at."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RISKS = {"safe": 0, "blocking": 1, "rebuild": 2, "data-loss": 3}


def glob_pattern(glob: str) -> str:
    """A regular expression for a file glob: ``*`` and ``?`` don't match ``/``; ``[a-z]`` and ``[^a-z]`` are classes; ``\\`` quotes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            stop = glob.find("]", i + 2)
            if stop < 0:
                raise ValueError(f"malformed glob {glob!r}")
            inner = glob[i + 1 : stop]
            out += "[" + ("^" + re.escape(inner[1:]) if inner[0] == "^" else re.escape(inner)).replace(r"\-", "-") + "]"
            i = stop
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches(name: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | name.rlike(glob_pattern(g)) | F.lower(name).rlike(glob_pattern(g.lower()))
    return found


def in_scope(tables: DataFrame, include: list[str], exclude: list[str], name: str = "table_name") -> DataFrame:
    """Tables that an include glob matches (all, without one) and no exclude glob."""
    kept = tables.where(~matches(F.col(name), exclude))
    return kept.where(matches(F.col(name), include)) if include else kept


def managed(target: DataFrame, source: DataFrame, managed_names: DataFrame, key: str = "table_name") -> DataFrame:
    """Target tables that are managed, or that the source doesn't have."""
    return target.join(managed_names, key, "left_semi").unionByName(target.join(managed_names, key, "left_anti").join(source, key, "left_anti"))


def risk_rank(risk: Column) -> Column:
    """Unknown risks rank with the worst."""
    out = F.lit(3)
    for name, rank in RISKS.items():
        out = F.when(risk == name, rank).otherwise(out)
    return out


def at_most(statements: DataFrame, limit: str) -> DataFrame:
    return statements.where(risk_rank(F.col("risk")) <= RISKS[limit])


def risk_counts(statements: DataFrame) -> DataFrame:
    """Statements of each known risk and in all, and whether applying them needs a consent to lose data."""
    counts = [F.count_if(F.col("risk") == r).alias(r.replace("-", "_")) for r in RISKS]
    return statements.agg(*counts, F.count("*").alias("total"), (F.count_if(risk_rank(F.col("risk")) > 2) > 0).alias("needs_consent"))
