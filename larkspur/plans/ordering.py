"""The order of a plan, and its script."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phases of a plan that brings a schema up to date, in order.
PHASES = ("create table", "drop foreign key", "change table", "create index", "create check", "add foreign key", "drop table")
#: Steps within a changed table, in order.
STEPS = ("drop check", "drop index", "add column", "change column", "drop column", "add index", "add check")


def drop_actions(tables: list[str], references: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """What drops tables, in order: ("drop table", table, "") and, where only cycles are left,
    ("drop foreign key", table, key) for the keys among the tables of cycles.  References are (key, from, to)."""
    left, open_ = set(tables), [r for r in references if r[1] != r[2] and r[1] in tables and r[2] in tables]
    out: list[tuple[str, str, str]] = []
    while left:
        free = sorted(t for t in left if not any(r[2] == t for r in open_))
        if free:
            out += [("drop table", t, "") for t in free]
            left -= set(free)
            open_ = [r for r in open_ if r[1] not in free]
        else:
            inside = _in_cycles(sorted(left), {(a, b) for _, a, b in open_})
            cut = [r for r in open_ if r[1] in inside and r[2] in inside]
            out += [("drop foreign key", a, key) for key, a, _ in sorted(cut, key=lambda r: (r[1], r[0]))]
            open_ = [r for r in open_ if r not in cut]
    return out


def drops(tables: DataFrame, references: DataFrame, by: str | None = None) -> DataFrame:
    """seq, act, table_name and object_name of ``drop_actions`` for the tables of each ``by`` (a database; all together if None).

    References have table_name, object_name and ref_table.  A database's tables are few; databases are worked on apart.
    """
    group, none = by or "all_", F.lit(None).cast("string")
    if by is None:
        tables, references = tables.withColumn(group, F.lit(1)), references.withColumn(group, F.lit(1))
    rows = tables.select(group, "table_name", none.alias("object_name"), none.alias("ref_table")).unionAll(references.select(group, "table_name", "object_name", "ref_table"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, listed in zip(*(c.to_pylist() for c in batch.columns)):
                refs = [(r["object_name"], r["table_name"], r["ref_table"]) for r in listed if r["object_name"] is not None]
                acts = drop_actions(sorted(r["table_name"] for r in listed if r["object_name"] is None), refs)
                found += [(key, i, *a) for i, a in enumerate(acts)]
            kinds = (batch.column(0).type, pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)], [group, "seq", "act", "table_name", "object_name"])

    kind = dict(tables.dtypes)[group]
    listed = rows.groupBy(group).agg(F.collect_list(F.struct("table_name", "object_name", "ref_table")).alias("listed"))
    out = listed.mapInArrow(run, f"`{group}` {kind}, seq int, act string, table_name string, object_name string")
    return out if by else out.drop(group)


def drop_levels(tables: list[str], references: list[tuple[str, str]]) -> list[tuple[str, int]]:
    """Tables with the round in which they are dropped: children before the tables that they reference.

    References to itself don't count.  Where only cycles are left, the references among
    the tables of cycles are dropped, and the rounds go on.  The plan's tables are few, so
    this runs on the driver.
    """
    known = set(tables)
    edges = {(a, b) for a, b in references if a != b and a in known and b in known}
    left, out, level = sorted(known), [], 0
    while left:
        free = [t for t in left if not any(b == t for _, b in edges)]
        if not free:
            inside = _in_cycles(left, edges)
            edges = {(a, b) for a, b in edges if not (a in inside and b in inside)}
            continue
        out += [(t, level) for t in free]
        left = [t for t in left if t not in free]
        edges = {(a, b) for a, b in edges if a not in free}
        level += 1
    return out


def _in_cycles(tables: list[str], edges: set[tuple[str, str]]) -> set[str]:
    """Tables that can be reached from themselves."""
    found = set()
    for start in tables:
        reached: set[str] = set()
        todo = [start]
        while todo:
            at = todo.pop()
            fresh = {b for a, b in edges if a == at} - reached
            reached |= fresh
            todo += fresh
        if start in reached:
            found.add(start)
    return found


def ordered(statements: DataFrame, by: str | None = None) -> DataFrame:
    """Statements with their place in the plan: by phase, ``seq`` (if there), table, step and name, for each ``by``.

    ``seq`` puts keys of changed tables before those of new ones, and drops in their order.
    """
    return placed(statements).orderBy(*[by] * (by is not None), *_order(statements))


def placed(statements: DataFrame) -> DataFrame:
    phase, step = F.lit(len(PHASES)), F.lit(len(STEPS))
    for i, p in enumerate(PHASES):
        phase = F.when(F.col("phase") == p, i).otherwise(phase)
    for i, s in enumerate(STEPS):
        step = F.when(F.col("step") == s, i).otherwise(step)
    return statements.withColumns({"phase_no": phase, "step_no": step})


def _order(statements: DataFrame) -> list[str]:
    return [c for c in ("phase_no", "seq", "table_name", "step_no", "object_name", "place") if c in statements.columns or c in ("phase_no", "step_no")]


def script(statements: DataFrame, unsupported: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """The plan as one text, or one for each ``by``: before each statement a comment with risk and description, its
    ``note`` and its ``warnings`` (if there); then what is ``unsupported`` (table_name, description, reason).

    A text's plan is small: it is that of one database.
    """
    head = F.concat(F.lit("-- ["), F.col("risk"), F.lit("] "), F.col("description"), F.lit("\n"))
    if "note" in statements.columns:
        head = F.concat(head, _comment("note", "note"))
    if "warnings" in statements.columns:
        each = F.transform("warnings", lambda w: F.concat(F.lit("-- warning: "), w, F.lit("\n")))
        head = F.concat(head, F.coalesce(F.array_join(each, ""), F.lit("")))
    own = [by] * (by is not None)
    group = lambda df: df.groupBy(*own) if own else df
    out = group(placed(statements).select(*own, F.struct(*_order(statements), F.concat(head, F.col("sql"), F.lit(";\n\n")).alias("text")).alias("r"))).agg(_joined().alias("script"))
    if unsupported is None:
        return out
    parts = out.select(*own, F.lit(0).alias("part"), F.col("script").alias("text"))
    block = F.concat(F.lit("-- [unsupported] "), F.col("description"), F.lit("\n"), _comment("table", "table_name"), _comment("reason", "reason"), F.lit("\n"))
    rest = group(unsupported.select(*own, F.struct("table_name", "description", block.alias("text")).alias("r"))).agg(_joined().alias("text"))
    both = parts.unionAll(rest.select(*own, F.lit(1), "text"))
    return group(both.select(*own, F.struct("part", "text").alias("r"))).agg(_joined().alias("script"))


def _joined():
    return F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["text"]), "")


def _comment(word: str, name: str):
    return F.when(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(f"-- {word}: "), F.col(name), F.lit("\n"))).otherwise("")


def add_column_risk(nullable, has_default, identity):
    """Adding a column that must have a value, without a default or identity, blocks on rows that exist."""
    return F.when(~nullable & ~has_default & ~identity, "blocking").otherwise("safe")


#: Kinds of objects in the order in which a schema is created.
CREATION = ("schema", "table", "index", "foreign key", "check")


def create_order(objects: DataFrame) -> DataFrame:
    """Objects (kind, source_place, object_name) with their place in the plan that creates them.  Plans are small."""
    phase = F.array_position(F.array(*map(F.lit, CREATION)), F.col("kind"))
    rows = objects.agg(F.sort_array(F.collect_list(F.struct(phase.alias("phase"), "source_place", "kind", "object_name"))).alias("all"))
    return rows.select(F.posexplode("all").alias("place", "r")).select("r.kind", "r.object_name", "place")
