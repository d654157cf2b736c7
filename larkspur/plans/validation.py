"""What is wrong with definitions, as relations of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.plans import ddl

ACTIONS = ("", "NO ACTION", "RESTRICT", "CASCADE", "SET NULL", "SET DEFAULT")


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def _violations(df: DataFrame, name: str, rules: list[tuple[Column, str]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(when, F.lit(what)) for when, what in rules]))
    return df.select(F.col(name).alias("name"), F.posexplode(found).alias("place", "violation"))


def tables(df: DataFrame, target: str) -> DataFrame:
    """Violations of table_name, columns (structs of name, data_type, is_identity, has_default, is_computed) and key (names)."""
    lacks = lambda what: F.lit(not ddl.supports(target, what))
    some = lambda f: F.exists("columns", f)
    names = F.transform("columns", lambda c: c["name"])
    return _violations(df, "table_name", [
        (blank(F.col("table_name")), "empty table name"),
        (F.size("columns") == 0, "no columns"),
        ((F.size("key") > 0) & lacks("primary_key"), "primary keys unsupported"),
        (some(lambda c: blank(c["name"])), "empty column name"),
        (some(lambda c: blank(c["data_type"])), "empty data type"),
        (some(lambda c: c["is_identity"]) & lacks("identity"), "identity unsupported"),
        (some(lambda c: c["has_default"]) & lacks("default"), "defaults unsupported"),
        (some(lambda c: c["is_computed"]) & lacks("computed"), "computed columns unsupported"),
        (F.exists("key", blank), "empty key column"),
        (F.exists("key", lambda k: ~blank(k) & ~F.array_contains(names, k)), "key column does not exist"),
    ])


def indexes(df: DataFrame) -> DataFrame:
    """Violations of index_name, table_name, columns, exprs, prefixes and include_cols."""
    mixed = F.exists(F.arrays_zip(F.col("prefixes"), F.col("exprs")), lambda z: (z["prefixes"] > 0) & F.coalesce(z["exprs"], F.lit(False)))
    return _violations(df, "index_name", [
        (blank(F.col("table_name")), "empty table name"),
        (blank(F.col("index_name")), "empty index name"),
        (F.size("columns") == 0, "no columns"),
        (F.size("exprs") > F.size("columns"), "more expression flags than columns"),
        (F.size("prefixes") > F.size("columns"), "more prefixes than columns"),
        (F.exists("columns", blank), "empty column"),
        (F.exists("prefixes", lambda p: p < 0), "negative prefix"),
        (mixed, "prefix of an expression"),
        (F.exists("include_cols", blank), "empty included column"),
    ])


def action(text: Column) -> Column:
    """A referential action in upper case with single spaces."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def foreign_keys(df: DataFrame, target: str) -> DataFrame:
    """Violations of fk_name, table_name, columns, ref_table, ref_columns, on_delete and on_update."""
    acts = [action(F.col(c)) for c in ("on_delete", "on_update")]
    lacking = {"mssql": "RESTRICT", "mysql": "SET DEFAULT"}.get(target)
    return _violations(df, "fk_name", [
        (blank(F.col("table_name")), "empty table name"),
        (blank(F.col("fk_name")), "empty constraint name"),
        (blank(F.col("ref_table")), "empty referenced table"),
        (F.size("columns") == 0, "no columns"),
        (F.size("columns") != F.size("ref_columns"), "column counts differ"),
        (F.exists("columns", blank), "empty column"),
        (F.exists("ref_columns", blank), "empty referenced column"),
        (reduce(lambda a, b: a | b, [~a.isin(*ACTIONS) for a in acts]), "invalid action"),
        (reduce(lambda a, b: a | b, [a == (lacking or "?") for a in acts]), "unsupported action"),
    ])
