"""Differences of two schema snapshots, as long relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Facts that make two versions of a column different; the position, identity and samples don't.
FACTS = ("data_type", "max_length", "precision", "scale", "datetime_precision", "is_nullable", "is_unsigned", "display_width", "enum_values", "srid", "is_computed", "computed_persisted")
TRIMMED = ("on_update_expr", "computed_expr")


def same_default(a: str, b: str) -> Column:
    """Both absent, or both present and equal: blank ones exactly, others trimmed, in their own case."""
    has_a, has_b = F.col(f"{a}.has_default"), F.col(f"{b}.has_default")
    x, y = F.coalesce(F.col(f"{a}.default_expr"), F.lit("")), F.coalesce(F.col(f"{b}.default_expr"), F.lit(""))
    blank = (F.trim(x) == "") | (F.trim(y) == "")
    return (has_a == has_b) & (~has_a | F.when(blank, x == y).otherwise(F.trim(x) == F.trim(y)))


def differences(columns: list[str]) -> Column:
    """The names of the facts in which the sides ``old`` and ``new`` differ."""
    found = [F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), c) for c in columns if c in FACTS]
    found += [F.when(F.trim(F.coalesce(F.col(f"old.{c}"), F.lit(""))) != F.trim(F.coalesce(F.col(f"new.{c}"), F.lit(""))), c) for c in columns if c in TRIMMED]
    if "default_expr" in columns:
        found.append(F.when(~same_default("old", "new"), "default"))
    return F.array_compact(F.array(*found, F.lit(None).cast("string")))


def column_changes(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ("table_name", "column_name")) -> DataFrame:
    """added, removed and changed columns, with the facts that changed.  Names match in their own case."""
    facts = [c for c in old.columns if c not in key]
    on = reduce(lambda a, b: a & b, (F.col(f"old.{k}") == F.col(f"new.{k}") for k in key))
    both = old.alias("old").join(new.alias("new"), on, "full_outer")
    gone, fresh = F.col(f"new.{key[0]}").isNull(), F.col(f"old.{key[0]}").isNull()
    change = F.when(fresh, "added").when(gone, "removed").when(F.size("facts") > 0, "changed")
    out = both.withColumn("facts", F.when(fresh | gone, F.array().cast("array<string>")).otherwise(differences(facts))).withColumn("change", change).where("change is not null")
    return out.select(*[F.coalesce(F.col(f"old.{k}"), F.col(f"new.{k}")).alias(k) for k in key], "change", F.array_join("facts", ",").alias("facts"))


def table_changes(old: DataFrame, new: DataFrame, name: str = "table_name") -> DataFrame:
    """added and removed tables."""
    a, b = old.select(name).distinct(), new.select(name).distinct()
    return b.join(a, name, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, name, "left_anti").withColumn("change", F.lit("removed")))


def object_changes(old: DataFrame, new: DataFrame, key: tuple[str, ...], same: Column) -> DataFrame:
    """Indexes, keys or checks by name: a changed one is removed and added."""
    on = reduce(lambda a, b: a & b, (F.col(f"old.{k}") == F.col(f"new.{k}") for k in key))
    both = old.alias("old").join(new.alias("new"), on, "full_outer")
    fresh, gone = F.col(f"old.{key[0]}").isNull(), F.col(f"new.{key[0]}").isNull()
    change = F.when(fresh, F.array(F.lit("added"))).when(gone, F.array(F.lit("removed"))).when(~same, F.array(F.lit("removed"), F.lit("added"))).otherwise(F.array().cast("array<string>"))
    return both.select(*[F.coalesce(F.col(f"old.{k}"), F.col(f"new.{k}")).alias(k) for k in key], F.explode(change).alias("change"))


def same_index() -> Column:
    """Whether ``old`` and ``new`` are the same index: lists of flags and lengths count as padded by false and 0, filters as trimmed."""

    def padded(c: str, rest: object) -> Column:
        return F.forall(F.zip_with(F.col(f"old.{c}"), F.col(f"new.{c}"), lambda x, y: F.coalesce(x, F.lit(rest)) == F.coalesce(y, F.lit(rest))), lambda x: x)

    text = lambda side: F.trim(F.coalesce(F.col(f"{side}.filter"), F.lit("")))
    plain = [F.col(f"old.{c}") == F.col(f"new.{c}") for c in ("columns", "is_unique", "include_cols")]
    return reduce(lambda a, b: a & b, [*plain, text("old") == text("new"), padded("exprs", False), padded("prefixes", 0)])


def same_foreign_key() -> Column:
    """Whether ``old`` and ``new`` are the same key: actions in any case, without blanks around them; a null one is a blank one."""
    action = lambda side, c: F.lower(F.trim(F.coalesce(F.col(f"{side}.{c}"), F.lit(""))))
    plain = [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in ("columns", "ref_schema", "ref_table", "ref_columns")]
    return reduce(lambda a, b: a & b, [*plain, *[action("old", c) == action("new", c) for c in ("on_delete", "on_update")]])


def same_check() -> Column:
    """Whether ``old`` and ``new`` are the same check: its text without blanks around it."""
    return F.trim(F.coalesce("old.definition", F.lit(""))) == F.trim(F.coalesce("new.definition", F.lit("")))


#: Facts that a snapshot of an older version doesn't have, by the version that brought them.
SINCE = {"is_unsigned": 2, "on_update_expr": 2, "enum_values": 2, "datetime_precision": 3, "display_width": 4}


def backfilled(old: DataFrame, current: DataFrame, version: str = "version", key: tuple[str, ...] = ("table_name", "column_name")) -> DataFrame:
    """An old snapshot whose missing facts are those of the current one."""
    facts = [c for c in SINCE if c in old.columns]
    now = current.select(*key, *[F.col(c).alias(f"_{c}") for c in facts])
    both = old.join(now, list(key), "left")

    def value(c: str) -> Column:
        older = F.col(version) < SINCE[c]
        if c == "enum_values":
            older = older & (F.coalesce(F.size(c), F.lit(0)) <= 0)
        return F.when(older, F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)).alias(c)

    return both.select(*[value(c) if c in facts else F.col(c) for c in old.columns])


def only_kinds(changes: DataFrame, kinds: list[str], kind: str = "object_kind") -> DataFrame:
    """Changes without those of kinds of objects that aren't managed; tables and columns always are."""
    return changes.where(F.col(kind).isin("table", "column", *kinds))


def changed_tables(changes: DataFrame, kinds: list[str]) -> DataFrame:
    """table_name and the number of changes of each kind (column, index, foreign key, check) of the tables that still differ.

    ``changes`` has table_name and object_kind.  Tables of which only objects that aren't managed differ are gone.
    """
    count = lambda kind: F.count_if(F.col("object_kind") == kind)
    every = only_kinds(changes, kinds).groupBy("table_name")
    return every.agg(count("column").alias("columns"), count("index").alias("indexes"), count("foreign key").alias("foreign_keys"), count("check").alias("checks"))


def summary(changes: DataFrame) -> DataFrame:
    """Counts of changes, and whether they remove something."""
    return changes.groupBy("change").agg(F.count("*").alias("n")).withColumn("is_destructive", F.col("change") == "removed")
