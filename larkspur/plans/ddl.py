"""DDL text for five dialects, as Column expressions over relations of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What quotes a name.
QUOTES = {"postgres": '""', "mssql": "[]", "mysql": "``", "sqlite": '""', "clickhouse": "``"}

#: What each dialect can create and change.
CAPABILITIES = {
    "postgres": "schema table column primary_key identity default computed index standalone_key unique check index_expression index_include index_filter drop_schema drop_table drop_index drop_constraint add_column drop_column alter_column truncate cascade",
    "mssql": "schema table column primary_key identity default computed index standalone_key unique check index_include index_filter drop_schema drop_table drop_index drop_constraint add_column drop_column alter_column truncate",
    "mysql": "schema table column primary_key identity default computed index standalone_key unique check index_expression index_prefix drop_schema drop_table drop_index drop_constraint add_column drop_column alter_column truncate",
    "sqlite": "table column primary_key identity default index index_filter drop_table drop_index add_column drop_column truncate",
    "clickhouse": "schema table column primary_key drop_schema drop_table add_column drop_column truncate",
}
#: Other names of the dialects.
ALIASES = {"postgresql": "postgres", "pg": "postgres", "sqlserver": "mssql", "sql-server": "mssql", "sql_server": "mssql", "mariadb": "mysql", "maria": "mysql", "sqlite3": "sqlite", "click-house": "clickhouse"}


def dialect(name: str) -> str:
    """The dialect of a name or alias."""
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in CAPABILITIES:
        raise ValueError(f"unknown dialect {name!r}")
    return key


def supports(target: str, capability: str) -> bool:
    return capability in CAPABILITIES[dialect(target)].split()


def need(target: str, capability: str) -> None:
    if not supports(target, capability):
        raise ValueError(f"{target} doesn't support {capability}")


def quoted(name: Column, target: str) -> Column:
    a, b = QUOTES[target]
    return F.concat(F.lit(a), F.replace(name, F.lit(b), F.lit(b + b)), F.lit(b))


def qualified(schema: str, table: Column, target: str) -> Column:
    return F.concat(quoted(F.lit(schema), target), F.lit("."), quoted(table, target)) if schema and target != "sqlite" else quoted(table, target)


def listed(names: Column, target: str) -> Column:
    return F.array_join(F.transform(names, lambda n: quoted(n, target)), ", ")


def column_definition(name: Column, type_text: Column, nullable: Column, default: Column, target: str) -> Column:
    """``name type [NOT NULL] [DEFAULT text]``."""
    if target == "clickhouse":
        return F.concat_ws(" ", quoted(name, target), F.when(nullable, F.concat(F.lit("Nullable("), type_text, F.lit(")"))).otherwise(type_text))
    return F.concat_ws(" ", quoted(name, target), type_text, F.when(~nullable, "NOT NULL"), F.when(default.isNotNull(), F.concat(F.lit("DEFAULT "), default)))


def create_tables(columns: DataFrame, target: str, schema: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """table_name and CREATE TABLE text, of table_name, ordinal, definition and key_position (null outside the primary key); with what a table has in ``keep``."""
    need(target, "table")
    parts = columns.groupBy(*keep, "table_name").agg(F.sort_array(F.collect_list(F.struct("ordinal", "definition"))).alias("defs"), F.sort_array(F.collect_list(F.when(F.col("key_position").isNotNull(), F.struct("key_position", "column_name")))).alias("keys"))
    key = listed(F.transform("keys", lambda k: k["column_name"]), target)
    body = F.array_join(F.transform("defs", lambda d: F.concat(F.lit("  "), d["definition"])), ",\n")
    inline = F.when((F.size("keys") > 0) & F.lit(target != "clickhouse"), F.concat(F.lit(",\n  PRIMARY KEY ("), key, F.lit(")"))).otherwise("")
    tail = F.lit({"mysql": " ENGINE=InnoDB"}.get(target, ""))
    if target == "clickhouse":
        tail = F.concat(F.lit(" ENGINE = MergeTree ORDER BY "), F.when(F.size("keys") > 0, F.concat(F.lit("("), key, F.lit(")"))).otherwise("tuple()"))
    return parts.select(*keep, "table_name", F.concat(F.lit("CREATE TABLE "), qualified(schema, F.col("table_name"), target), F.lit(" (\n"), body, inline, F.lit("\n)"), tail).alias("sql"))


def index_parts(target: str) -> Column:
    """The key of an index: expressions in parentheses, names quoted, with the length of a prefix."""

    def part(c: Column, i: Column) -> Column:
        size = F.coalesce(F.get("prefixes", i), F.lit(0))
        name = F.concat(quoted(c, target), F.when(size > 0, F.concat(F.lit("("), size.cast("string"), F.lit(")"))).otherwise(""))
        return F.when(F.coalesce(F.get("exprs", i), F.lit(False)), F.concat(F.lit("("), F.trim(c), F.lit(")"))).otherwise(name)

    lacks = [(kind, found) for kind, found in (("index_expression", F.exists("exprs", lambda x: x)), ("index_prefix", F.exists("prefixes", lambda x: x > 0))) if not supports(target, kind)]
    out = F.array_join(F.transform("columns", part), ", ")
    for kind, found in lacks:
        out = F.when(found, F.raise_error(F.lit(f"{target} does not support {kind}")).cast("string")).otherwise(out)
    return out


def create_index(target: str, schema: str = "") -> Column:
    """CREATE INDEX of index_name, table_name, columns, is_unique, include_cols, filter, exprs (which parts are expressions) and prefixes (their lengths)."""
    need(target, "index")
    text = F.concat(F.when(F.col("is_unique"), "CREATE UNIQUE INDEX ").otherwise("CREATE INDEX "), quoted(F.col("index_name"), target), F.lit(" ON "), qualified(schema, F.col("table_name"), target), F.lit(" ("), index_parts(target), F.lit(")"))
    if supports(target, "index_include"):
        text = F.concat(text, F.when(F.size("include_cols") > 0, F.concat(F.lit(" INCLUDE ("), listed(F.col("include_cols"), target), F.lit(")"))).otherwise(""))
    if supports(target, "index_filter"):
        text = F.concat(text, F.when(F.col("filter").isNotNull(), F.concat(F.lit(" WHERE "), F.col("filter"))).otherwise(""))
    return text


def add_constraint(kind: str, target: str, schema: str = "") -> Column:
    """ALTER TABLE ... ADD CONSTRAINT of a primary_key, unique, foreign_key or check."""
    need(target, {"check": "check", "unique": "unique"}.get(kind, "standalone_key"))
    columns = listed(F.col("columns"), target) if kind != "check" else F.col("definition")
    if kind == "foreign_key":
        act = lambda c, word: F.when(~F.upper(F.coalesce(F.col(c), F.lit(""))).isin("", "NO ACTION"), F.concat(F.lit(f" ON {word} "), F.upper(c))).otherwise("")
        rest = F.concat(F.lit("FOREIGN KEY ("), columns, F.lit(") REFERENCES "), qualified(schema, F.col("ref_table"), target), F.lit(" ("), listed(F.col("ref_columns"), target), F.lit(")"), act("on_delete", "DELETE"), act("on_update", "UPDATE"))
    else:
        rest = F.concat(F.lit({"primary_key": "PRIMARY KEY (", "unique": "UNIQUE (", "check": "CHECK ("}[kind]), columns, F.lit(")"))
    return F.concat(F.lit("ALTER TABLE "), qualified(schema, F.col("table_name"), target), F.lit(" ADD CONSTRAINT "), quoted(F.col("constraint_name"), target), F.lit(" "), rest)


def _when_missing(condition: Column, name: Column, sql: Column) -> Column:
    """SQL Server's statement under a condition on the name's text."""
    return F.concat(F.lit("IF "), F.replace(condition, F.lit("?"), _text(name)), F.lit(" EXEC("), _text(sql), F.lit(")"))


def create_schema(target: str) -> Column:
    """Creates schema_name unless it is there."""
    need(target, "schema")
    name = F.col("schema_name")
    if target == "mssql":
        return _when_missing(F.lit("NOT EXISTS (SELECT 1 FROM sys.schemas WHERE name = ?)"), name, F.concat(F.lit("CREATE SCHEMA "), quoted(name, target)))
    return F.concat(F.lit("CREATE SCHEMA IF NOT EXISTS " if target == "postgres" else "CREATE DATABASE IF NOT EXISTS "), quoted(name, target))


#: What MySQL drops for each kind of constraint.
MYSQL_DROPS = {"primary_key": " DROP PRIMARY KEY", "unique": " DROP INDEX ", "foreign_key": " DROP FOREIGN KEY ", "check": " DROP CHECK "}


def drop(kind: str, target: str, schema: str = "") -> Column:
    """DROP of a table, index, column, constraint (for MySQL of a ``constraint_kind``) or schema."""
    need(target, f"drop_{kind}")
    table = qualified(schema, F.col("table_name"), target) if kind != "schema" else None
    if kind == "schema":
        name = F.col("schema_name")
        if target == "mssql":
            return _when_missing(F.lit("SCHEMA_ID(?) IS NOT NULL"), name, F.concat(F.lit("DROP SCHEMA "), quoted(name, target)))
        return F.concat(F.lit("DROP SCHEMA IF EXISTS " if target == "postgres" else "DROP DATABASE IF EXISTS "), quoted(name, target))
    if kind == "table":
        return F.concat(F.lit("DROP TABLE IF EXISTS "), table)
    if kind == "column":
        return F.concat(F.lit("ALTER TABLE "), table, F.lit(" DROP COLUMN IF EXISTS " if target == "clickhouse" else " DROP COLUMN "), quoted(F.col("column_name"), target))
    if kind == "constraint":
        name = quoted(F.col("constraint_name"), target)
        if target != "mysql":
            return F.concat(F.lit("ALTER TABLE "), table, F.lit(" DROP CONSTRAINT "), name)
        what = F.col("constraint_kind")
        verb = F.raise_error(F.concat(F.lit("MySQL has no constraint of the kind "), what)).cast("string")
        for k, word in MYSQL_DROPS.items():
            verb = F.when(what == k, F.lit(word) if k == "primary_key" else F.concat(F.lit(word), name)).otherwise(verb)
        return F.concat(F.lit("ALTER TABLE "), table, verb)
    if target in ("mssql", "mysql"):
        return F.concat(F.lit("DROP INDEX "), quoted(F.col("index_name"), target), F.lit(" ON "), table)
    return F.concat(F.lit("DROP INDEX IF EXISTS " if target == "sqlite" else "DROP INDEX "), qualified(schema, F.col("index_name"), target))


def truncate(target: str, schema: str = "") -> Column:
    need(target, "truncate")
    return F.concat(F.lit("DELETE FROM " if target == "sqlite" else "TRUNCATE TABLE "), qualified(schema, F.col("table_name"), target))


def add_column(target: str, schema: str = "") -> Column:
    need(target, "add_column")
    return F.concat(F.lit("ALTER TABLE "), qualified(schema, F.col("table_name"), target), F.lit(" ADD " if target == "mssql" else " ADD COLUMN "), F.col("definition"))


def _text(value: Column) -> Column:
    """A SQL Server string of the value."""
    return F.concat(F.lit("N'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))


def drop_default(target: str, schema: str = "") -> Column:
    """Drops the default of column_name.  SQL Server's defaults are constraints, found by the column at run time."""
    need(target, "alter_column")
    table, name = qualified(schema, F.col("table_name"), target), quoted(F.col("column_name"), target)
    if target != "mssql":
        return F.concat(F.lit("ALTER TABLE "), table, F.lit(" ALTER COLUMN "), name, F.lit(" DROP DEFAULT"))
    return F.concat(
        F.lit("DECLARE @sql nvarchar(max) = (SELECT "), _text(F.concat(F.lit("ALTER TABLE "), table, F.lit(" DROP CONSTRAINT "))),
        F.lit(" + QUOTENAME(d.name) FROM sys.default_constraints d JOIN sys.columns c ON c.object_id = d.parent_object_id AND c.column_id = d.parent_column_id WHERE d.parent_object_id = OBJECT_ID("),
        _text(table), F.lit(") AND c.name = "), _text(F.col("column_name")), F.lit("); IF @sql IS NOT NULL EXEC sp_executesql @sql"),
    )


def set_default(target: str, schema: str = "") -> Column:
    """The statements, in order, that make ``default`` the default of column_name."""
    need(target, "alter_column")
    table, name = qualified(schema, F.col("table_name"), target), quoted(F.col("column_name"), target)
    if target != "mssql":
        return F.array(F.concat(F.lit("ALTER TABLE "), table, F.lit(" ALTER COLUMN "), name, F.lit(" SET DEFAULT "), F.col("default")))
    constraint = quoted(F.concat_ws("_", F.lit("df"), F.col("table_name"), F.col("column_name")), target)
    return F.array(drop_default(target, schema), F.concat(F.lit("ALTER TABLE "), table, F.lit(" ADD CONSTRAINT "), constraint, F.lit(" DEFAULT "), F.col("default"), F.lit(" FOR "), name))
