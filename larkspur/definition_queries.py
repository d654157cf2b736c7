"""Queries of whole definitions, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.catalog_queries import _duck, fixture
from larkspur.functions import types
from larkspur.plans import api, definitions

#: table, place, column, kind, length, nullable, identity, default, on update, computed, persisted, place in the key
COLUMNS = """VALUES
('loan',1,'no','bigint',NULL,false,true,NULL,NULL,NULL,false,1), ('loan',2,'code','varchar',12,false,false,'''x''',NULL,NULL,false,NULL), ('loan',3,'at','timestamp',NULL,true,false,'CURRENT_TIMESTAMP','CURRENT_TIMESTAMP',NULL,false,NULL),
('loan',4,'days','integer',NULL,false,false,NULL,NULL,'fee * 2',true,NULL), ('loan',5,'note','text',NULL,true,false,'''n''',NULL,NULL,false,NULL), ('loan',6,'fee','integer',NULL,true,false,'1 + 1',' ',NULL,false,NULL),
('shelf',1,'hall','integer',NULL,false,false,NULL,NULL,NULL,false,2), ('shelf',2,'place','integer',NULL,true,false,'-5',NULL,NULL,false,1), ('shelf',3,'wide','integer',NULL,true,false,NULL,NULL,'hall + 1',false,NULL),
('desk',1,'name','varchar',9,false,false,NULL,NULL,NULL,false,NULL), ('desk',2,'lamp','text',NULL,false,false,NULL,NULL,NULL,false,NULL)"""
FACTS = ["table_name", "ordinal", "column_name", "kind", "length", "is_nullable", "is_identity", '"default"', "on_update", "computed", "persisted", "key_position"]


def _columns(spark, sf_dir, target):
    none, off = F.lit(None).cast("int"), F.lit(False)
    c = fixture(spark, sf_dir, COLUMNS, [x.strip('"') for x in FACTS])
    return c.withColumn("type_text", types.render(target, F.col("kind"), F.col("length"), none, none, off, off, off, none))


def column_definitions(spark, sf_dir):
    """Each column's definition on every dialect, and what the dialect can't define of it."""
    out = None
    for t in types.TARGETS:
        c = definitions.with_facts(_columns(spark, sf_dir, t))
        why = definitions.violations(t)
        one = c.select(F.lit(t).alias("target"), "table_name", "column_name", F.when(F.size(why) == 0, definitions.column(t)).alias("definition"), F.array_join(why, "; ").alias("violations"))
        out = one if out is None else out.unionAll(one)
    return out


def whole_tables(spark, sf_dir):
    """CREATE TABLE of each table on every dialect, or why there is none."""
    out = None
    for t in types.TARGETS:
        one = definitions.create_tables(_columns(spark, sf_dir, t), t, "app").select(F.lit(t).alias("target"), "table_name", "sql", F.array_join("violations", "; ").alias("violations"))
        out = one if out is None else out.unionAll(one)
    return out


def column_operations(spark, sf_dir):
    """The statements that add each column, change its type and its nullability."""
    registry, out = api.Registry(), None
    for t in ("postgres", "mssql", "mysql"):
        plain = _columns(spark, sf_dir, t).where("computed IS NULL")
        for op in ("add_column", "alter_column_type", "alter_column_nullability"):
            one = registry.apply(op, plain, t, "app").select(F.lit(t).alias("target"), F.lit(op).alias("operation"), "table_name", "column_name", "sql")
            out = one if out is None else out.unionAll(one)
    return out


_MARKS = {"postgres": '""', "mssql": "[]", "mysql": "``", "sqlite": '""', "clickhouse": "``"}
_TYPES = {
    "postgres": ("bigint", "'character varying(' || length || ')'", "timestamp without time zone", "integer", "text"), "mssql": ("BIGINT", "'VARCHAR(' || length || ')'", "DATETIME2", "INT", "NVARCHAR(MAX)"),
    "mysql": ("BIGINT", "'VARCHAR(' || length || ')'", "DATETIME(6)", "INT", "LONGTEXT"), "sqlite": ("INTEGER", "'VARCHAR(' || length || ')'", "DATETIME", "INTEGER", "TEXT"), "clickhouse": ("Int64", "'String'", "DateTime64(3)", "Int32", "String"),
}


def _parts(t: str) -> dict[str, str]:
    a, b = _MARKS[t]
    big, sized, stamp, whole, text = _TYPES[t]
    kind = f"CASE kind WHEN 'bigint' THEN '{big}' WHEN 'varchar' THEN {sized} WHEN 'timestamp' THEN '{stamp}' WHEN 'integer' THEN '{whole}' ELSE '{text}' END"
    name, nulls = f"'{a}' || column_name || '{b}'", "CASE WHEN is_nullable THEN '' ELSE ' NOT NULL' END"
    default = "\"default\"" if t != "mysql" else "CASE WHEN kind = 'text' OR \"default\" = '1 + 1' THEN '(' || \"default\" || ')' ELSE \"default\" END"
    own = {"postgres": " GENERATED BY DEFAULT AS IDENTITY", "mssql": " IDENTITY(1,1) NOT NULL", "mysql": " AUTO_INCREMENT NOT NULL", "sqlite": " NOT NULL"}.get(t, "")
    update = "coalesce(' ON UPDATE ' || nullif(trim(on_update), ''), '')" if t == "mysql" else "''"
    plain = f"{name} || ' ' || {kind} || CASE WHEN is_identity THEN '{own}' ELSE {nulls} || coalesce(' DEFAULT ' || {default}, '') || {update} END"
    made = {
        "postgres": f"{name} || ' ' || {kind} || ' GENERATED ALWAYS AS (' || computed || ') STORED' || {nulls}", "mssql": f"{name} || ' AS (' || computed || ')' || CASE WHEN persisted THEN ' PERSISTED' ELSE '' END || {nulls}",
        "mysql": f"{name} || ' ' || {kind} || ' GENERATED ALWAYS AS (' || computed || ') ' || CASE WHEN persisted THEN 'STORED' ELSE 'VIRTUAL' END || {nulls}",
    }.get(t, "NULL")
    why = "''" if t in ("postgres", "mssql", "mysql") else "CASE WHEN computed IS NOT NULL THEN 'no computed columns' ELSE '' END"
    if t == "clickhouse":
        plain = f"{name} || ' ' || CASE WHEN is_nullable THEN 'Nullable(' || {kind} || ')' ELSE {kind} END"
        why = "array_to_string(list_filter([CASE WHEN computed IS NOT NULL THEN 'no computed columns' END, CASE WHEN is_nullable AND key_position IS NOT NULL THEN 'nullable key column' END, CASE WHEN is_identity THEN 'no identity' END, CASE WHEN \"default\" IS NOT NULL THEN 'no defaults' END], lambda x: x IS NOT NULL), '; ')"
    return {"definition": f"CASE WHEN computed IS NOT NULL THEN {made} ELSE {plain} END", "why": why, "kind": kind, "name": name, "nulls": nulls}


def _rows(t: str) -> str:
    p = _parts(t)
    return f"(SELECT *, {p['definition']} AS d, {p['why']} AS why, {p['kind']} AS type_text, {p['name']} AS q FROM {_duck(COLUMNS, FACTS)})"


def _tables() -> str:
    out = []
    for t, (a, b) in _MARKS.items():
        schema = "" if t == "sqlite" else f"{a}app{b}."
        inline = "(count(*) FILTER (key_position IS NOT NULL) = 1 AND bool_or(is_identity AND key_position IS NOT NULL))" if t == "sqlite" else "false"
        line = f"CASE WHEN i AND key_position IS NOT NULL THEN q || ' INTEGER PRIMARY KEY AUTOINCREMENT' ELSE d END"
        key = "string_agg(q, ', ' ORDER BY key_position) FILTER (key_position IS NOT NULL)"
        named = "'    PRIMARY KEY (' || " if t == "clickhouse" else f"'    CONSTRAINT {a}pk_' || table_name || '{b} PRIMARY KEY (' || "
        tail = {"mysql": "' ENGINE=InnoDB DEFAULT CHARSET=utf8mb4'", "clickhouse": f"' ENGINE = MergeTree ORDER BY ' || coalesce('(' || {key} || ')', 'tuple()')"}.get(t, "''")
        why = f"coalesce(string_agg(CASE WHEN why <> '' THEN column_name || ': ' || replace(why, '; ', '; ' || column_name || ': ') END, '; ' ORDER BY ordinal), '')"
        out.append(f"""SELECT '{t}' AS target, table_name, CASE WHEN {why} = '' THEN 'CREATE TABLE {schema}{a}' || table_name || '{b} (' || chr(10) || string_agg('    ' || {line}, ',' || chr(10) ORDER BY ordinal) || CASE WHEN any_value(i) THEN '' ELSE coalesce(',' || chr(10) || {named} {key} || ')', '') END || chr(10) || ')' || {tail} END AS sql, {why} AS violations
FROM (SELECT *, {inline} OVER (PARTITION BY table_name) AS i FROM {_rows(t)}) GROUP BY table_name""".replace("(count(*) FILTER (key_position IS NOT NULL) = 1 AND bool_or(is_identity AND key_position IS NOT NULL)) OVER (PARTITION BY table_name)", "(count(key_position) OVER (PARTITION BY table_name) = 1 AND bool_or(is_identity AND key_position IS NOT NULL) OVER (PARTITION BY table_name))").replace("false OVER (PARTITION BY table_name)", "false"))
    return " UNION ALL ".join(out)


def _operations() -> str:
    out = []
    for t in ("postgres", "mssql", "mysql"):
        a, b = _MARKS[t]
        head = f"'ALTER TABLE {a}app{b}.{a}' || table_name || '{b}"
        add = f"{head} ADD {'' if t == 'mssql' else 'COLUMN '}' || d"
        retype = {"postgres": f"{head} ALTER COLUMN ' || q || ' TYPE ' || type_text", "mssql": f"{head} ALTER COLUMN ' || q || ' ' || type_text || CASE WHEN is_nullable THEN ' NULL' ELSE ' NOT NULL' END", "mysql": f"{head} MODIFY COLUMN ' || d"}[t]
        nulls = f"{head} ALTER COLUMN ' || q || CASE WHEN is_nullable THEN ' DROP NOT NULL' ELSE ' SET NOT NULL' END" if t == "postgres" else retype
        out += [f"SELECT '{t}' AS target, '{op}' AS operation, table_name, column_name, {sql} AS sql FROM {_rows(t)} WHERE computed IS NULL" for op, sql in (("add_column", add), ("alter_column_type", retype), ("alter_column_nullability", nulls))]
    return " UNION ALL ".join(out)


def queries():
    return {f.__name__: f for f in (column_definitions, whole_tables, column_operations)}


def oracle_sql() -> dict[str, str]:
    return {
        "column_definitions": " UNION ALL ".join(f"SELECT '{t}' AS target, table_name, column_name, CASE WHEN why = '' THEN d END AS definition, why AS violations FROM {_rows(t)}" for t in _MARKS),
        "whole_tables": _tables(),
        "column_operations": _operations(),
    }
