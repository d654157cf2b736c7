"""Dialects by name, and operations as batches of statements: ``apply`` adds to a relation of objects
what creates or changes each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.plans import ddl, definitions

BATCH = "array<struct<sql:string,best_effort:boolean>>"
#: Operation to the statements' Column, of (target, schema, cascade).
Operation = Callable[[str, str, bool], Column]


def batch(*statements: Column, best_effort: int | None = None) -> Column:
    return F.array(*[F.struct(s.alias("sql"), F.lit(i == best_effort).alias("best_effort")) for i, s in enumerate(statements)]).cast(BATCH)


def _cascading(sql: Column, target: str, cascade: bool) -> Column:
    if cascade:
        ddl.need(target, "cascade")
        return F.concat(sql, F.lit(" CASCADE"))
    return sql


def _unchecked(sql: Column, target: str) -> Column:
    """The statement on one connection that doesn't check references meanwhile."""
    off = {"mysql": "SET FOREIGN_KEY_CHECKS = ", "sqlite": "PRAGMA foreign_keys = "}[target]
    values = {"mysql": ("0", "1"), "sqlite": ("OFF", "ON")}[target]
    return batch(F.lit(off + values[0]), sql, F.lit(off + values[1]))


def _drop_table(target: str, schema: str, cascade: bool) -> Column:
    sql = _cascading(ddl.drop("table", target, schema), target, cascade)
    return _unchecked(sql, target) if target in ("mysql", "sqlite") else batch(sql)


def _truncate(target: str, schema: str, cascade: bool) -> Column:
    sql = _cascading(ddl.truncate(target, schema), target, cascade)
    if target == "mysql":
        return _unchecked(sql, target)
    if target == "sqlite":
        counter = F.concat(F.lit("DELETE FROM sqlite_sequence WHERE name = '"), F.replace(F.col("table_name"), F.lit("'"), F.lit("''")), F.lit("'"))
        return batch(sql, counter, best_effort=1)
    return batch(sql)


def _set_default(target: str, schema: str, cascade: bool) -> Column:
    return F.transform(ddl.set_default(target, schema), lambda s: F.struct(s.alias("sql"), F.lit(False).alias("best_effort"))).cast(BATCH)


#: What creates and changes objects, by name.
OPERATIONS: dict[str, Operation] = {
    "create_schema": lambda t, s, c: batch(ddl.create_schema(t)),
    "create_table": lambda t, s, c: batch(F.coalesce("sql", F.raise_error(F.concat_ws(", ", F.lit(f"{t} can't define"), "violations")).cast("string"))),
    "create_index": lambda t, s, c: batch(ddl.create_index(t, s)),
    **{f"add_{k}": (lambda k: lambda t, s, c: batch(ddl.add_constraint(k, t, s)))(k) for k in ("primary_key", "unique", "foreign_key", "check")},
    "drop_schema": lambda t, s, c: batch(_cascading(ddl.drop("schema", t), t, c)),
    "drop_table": _drop_table,
    "drop_index": lambda t, s, c: batch(ddl.drop("index", t, s)),
    "drop_constraint": lambda t, s, c: batch(ddl.drop("constraint", t, s)),
    "add_column": lambda t, s, c: batch(ddl.add_column(t, s)),
    "drop_column": lambda t, s, c: batch(ddl.drop("column", t, s)),
    "alter_column_type": lambda t, s, c: batch(definitions.alter_type(t, s)),
    "alter_column_nullability": lambda t, s, c: batch(definitions.alter_nullability(t, s)),
    "set_column_default": _set_default,
    "drop_column_default": lambda t, s, c: batch(ddl.drop_default(t, s)),
    "truncate_table": _truncate,
}


class Registry:
    """Dialects by name and alias; a dialect is its operations."""

    def __init__(self):
        self.operations: dict[str, dict[str, Operation]] = {d: OPERATIONS for d in ddl.CAPABILITIES}
        self.names = {d: d for d in ddl.CAPABILITIES} | ddl.ALIASES

    def register(self, name: str, operations: dict[str, Operation], aliases: tuple[str, ...] = ()) -> None:
        keys = [k.strip().lower() for k in (name, *aliases)]
        if not all(keys):
            raise ValueError("a dialect needs a name, and no alias may be empty")
        taken = [k for i, k in enumerate(keys) if k in self.names or k in keys[:i]]
        if taken:
            raise ValueError(f"dialect {taken[0]!r} is registered already")
        self.operations[keys[0]] = operations
        self.names |= {k: keys[0] for k in keys}

    def resolve(self, name: str) -> str:
        key = name.strip().lower()
        if key not in self.names:
            raise ValueError(f"unknown dialect {name!r}; there are {', '.join(sorted(self.operations))}")
        return self.names[key]

    def apply(self, operation: str, objects: DataFrame, dialect: str, schema: str = "", cascade: bool = False) -> DataFrame:
        """The objects' names with the statements of the operation: place, sql, and whether its failure may be ignored.

        Statements of one object belong on one connection.  Tables are created, and columns added and
        changed, from the facts of columns (``definitions``); a rendered ``definition`` is taken as it is.
        """
        target = self.resolve(dialect)
        found = self.operations[target].get(operation)
        if found is None:
            raise ValueError(f"{target} doesn't support {operation}")
        if operation == "create_table":
            objects = definitions.create_tables(objects, target, schema)
        elif "type_text" in objects.columns:
            objects = definitions.with_facts(objects)
            if operation == "add_column" and "definition" not in objects.columns:
                objects = objects.withColumn("definition", definitions.column(target))
        names = [c for c in ("schema_name", "table_name", "column_name", "index_name", "constraint_name") if c in objects.columns]
        return objects.select(*names, F.posexplode(found(target, schema, cascade)).alias("place", "s")).select(*names, "place", "s.sql", "s.best_effort")
