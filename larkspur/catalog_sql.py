"""DuckDB counterparts of the schema engine's queries, written by hand."""

from __future__ import annotations

from larkspur.catalog_queries import BACKFILL, BACKFILL_COLUMNS, CHECKS, DEFAULT_ROWS, DEFAULTS, KEY_PAIRS, NEEDS, NEW_DEFAULTS, SIDE_COLUMNS, SIDES, SNAPSHOT_COLUMNS, SNAPSHOTS, STATEMENT_COLUMNS, STATEMENTS, TABLES, TYPE_COLUMNS, TYPES, _duck, quoted

_NAMES = ", ".join(f"'{t}'" for t in TABLES)
_SCHEMA = f"""(SELECT table_name, ordinal_position::INT AS ordinal, column_name,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE data_type END AS data_type
  FROM information_schema.columns WHERE table_name IN ({_NAMES}))"""
_COUNTS = "(" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES) + ")"
_SIZES = f"""(SELECT s.table_name, 24 + sum(16 + CASE WHEN data_type IN ('int', 'float') THEN 4 WHEN data_type IN ('bigint', 'double') THEN 8 WHEN data_type LIKE 'timestamp%' THEN 24 ELSE 4096 END)::BIGINT AS row_bytes,
  count(*) AS n_columns, any_value(row_count) AS row_count FROM {_SCHEMA} s JOIN {_COUNTS} c USING (table_name) GROUP BY s.table_name)"""
_KIND = r"""CASE WHEN dialect = 'mssql' AND data_type = 'timestamp' THEN 'rowversion' WHEN data_type LIKE 'tinyint(1)%' THEN 'boolean'
  WHEN data_type = 'bit' THEN CASE WHEN dialect = 'mssql' OR dialect = 'mysql' AND length <= 1 THEN 'boolean' ELSE 'bitstring' END
  WHEN data_type IN ('integer', 'INTEGER', 'int unsigned') THEN 'integer' WHEN data_type IN ('numeric', 'decimal', 'money') THEN 'decimal'
  WHEN data_type IN ('character varying', 'varchar', 'nvarchar') THEN 'varchar' WHEN data_type IN ('char', 'nchar') THEN 'char' WHEN data_type IN ('text', 'TEXT', 'mediumtext') THEN 'text'
  WHEN data_type IN ('bytea', 'longblob') THEN 'blob' WHEN data_type IN ('double precision', 'float') THEN 'double' WHEN data_type LIKE 'timestamp%' OR data_type LIKE 'datetime%' THEN 'timestamp'
  WHEN data_type IN ('uuid', 'uniqueidentifier') THEN 'uuid' WHEN data_type IN ('json', 'jsonb') THEN 'json' WHEN data_type = 'REAL' THEN 'real' ELSE data_type END"""
_TYPED = f"""(SELECT *, {_KIND} AS kind, data_type IN ('timestamp with time zone', 'datetimeoffset') AS tz, data_type IN ('nvarchar', 'nchar') AS national, coalesce(length, 0) AS n FROM {_duck(TYPES, TYPE_COLUMNS)})"""

_MAP = {
    "postgres": """CASE kind WHEN 'boolean' THEN 'boolean' WHEN 'smallint' THEN 'smallint' WHEN 'integer' THEN CASE WHEN unsigned THEN 'bigint' ELSE 'integer' END WHEN 'bigint' THEN CASE WHEN unsigned THEN 'numeric(20,0)' ELSE 'bigint' END
 WHEN 'decimal' THEN CASE WHEN prec > 0 THEN format('numeric({},{})', prec, scale) ELSE 'numeric' END WHEN 'real' THEN 'real' WHEN 'double' THEN 'double precision' WHEN 'varchar' THEN CASE WHEN n > 0 THEN format('character varying({})', n) ELSE 'text' END
 WHEN 'char' THEN format('character({})', n) WHEN 'text' THEN 'text' WHEN 'binary' THEN 'bytea' WHEN 'varbinary' THEN 'bytea' WHEN 'blob' THEN 'bytea' WHEN 'rowversion' THEN 'bytea' WHEN 'date' THEN 'date' WHEN 'time' THEN 'time'
 WHEN 'timestamp' THEN 'timestamp' || format('({})', least(fsp, 6)) || CASE WHEN tz THEN ' with time zone' ELSE ' without time zone' END WHEN 'uuid' THEN 'uuid' WHEN 'json' THEN 'jsonb' WHEN 'xml' THEN 'xml' WHEN 'bitstring' THEN format('bit({})', n) END""",
    "mssql": """CASE kind WHEN 'boolean' THEN 'BIT' WHEN 'smallint' THEN 'SMALLINT' WHEN 'integer' THEN CASE WHEN unsigned THEN 'BIGINT' ELSE 'INT' END WHEN 'bigint' THEN CASE WHEN unsigned THEN 'DECIMAL(20,0)' ELSE 'BIGINT' END
 WHEN 'decimal' THEN CASE WHEN prec > 0 THEN format('DECIMAL({},{})', least(prec, 38), least(scale, 38)) ELSE 'DECIMAL(38,18)' END WHEN 'real' THEN 'REAL' WHEN 'double' THEN 'FLOAT'
 WHEN 'varchar' THEN CASE WHEN national THEN CASE WHEN n BETWEEN 1 AND 4000 THEN format('NVARCHAR({})', n) WHEN n BETWEEN 4001 AND 8000 THEN format('VARCHAR({})', n) ELSE 'NVARCHAR(MAX)' END WHEN n BETWEEN 1 AND 8000 THEN format('VARCHAR({})', n) ELSE 'VARCHAR(MAX)' END
 WHEN 'char' THEN CASE WHEN national THEN format('NCHAR({})', n) ELSE format('CHAR({})', n) END WHEN 'text' THEN 'NVARCHAR(MAX)' WHEN 'binary' THEN format('BINARY({})', n) WHEN 'varbinary' THEN 'VARBINARY(MAX)' WHEN 'blob' THEN 'VARBINARY(MAX)'
 WHEN 'rowversion' THEN 'ROWVERSION' WHEN 'date' THEN 'DATE' WHEN 'time' THEN 'TIME' WHEN 'timestamp' THEN CASE WHEN tz THEN 'DATETIMEOFFSET' ELSE 'DATETIME2' END || format('({})', least(fsp, 7))
 WHEN 'uuid' THEN 'UNIQUEIDENTIFIER' WHEN 'json' THEN 'NVARCHAR(MAX)' WHEN 'xml' THEN 'NVARCHAR(MAX)' WHEN 'bitstring' THEN format('VARBINARY({})', (n + 7) // 8) END""",
    "mysql": """CASE kind WHEN 'boolean' THEN 'TINYINT(1)' WHEN 'smallint' THEN 'SMALLINT' WHEN 'integer' THEN CASE WHEN unsigned THEN 'INT UNSIGNED' ELSE 'INT' END WHEN 'bigint' THEN CASE WHEN unsigned THEN 'BIGINT UNSIGNED' ELSE 'BIGINT' END
 WHEN 'decimal' THEN CASE WHEN prec > 0 THEN format('DECIMAL({},{})', least(prec, 65), least(scale, 30)) ELSE 'DECIMAL(65,30)' END WHEN 'real' THEN 'FLOAT' WHEN 'double' THEN 'DOUBLE'
 WHEN 'varchar' THEN CASE WHEN n BETWEEN 1 AND 16383 THEN format('VARCHAR({})', n) ELSE 'LONGTEXT' END WHEN 'char' THEN CASE WHEN n <= 255 THEN format('CHAR({})', n) ELSE format('VARCHAR({})', n) END
 WHEN 'text' THEN CASE WHEN n <= 0 THEN 'LONGTEXT' ELSE 'MEDIUMTEXT' END WHEN 'binary' THEN CASE WHEN n <= 255 THEN format('BINARY({})', n) ELSE format('VARBINARY({})', n) END WHEN 'varbinary' THEN 'LONGBLOB' WHEN 'blob' THEN 'LONGBLOB'
 WHEN 'rowversion' THEN 'BINARY(8)' WHEN 'date' THEN 'DATE' WHEN 'time' THEN 'TIME' WHEN 'timestamp' THEN CASE WHEN tz THEN 'TIMESTAMP' ELSE 'DATETIME' END || CASE WHEN fsp = 0 THEN '' ELSE format('({})', least(coalesce(fsp, 6), 6)) END
 WHEN 'uuid' THEN 'CHAR(36)' WHEN 'json' THEN 'JSON' WHEN 'xml' THEN 'LONGTEXT' WHEN 'bitstring' THEN format('BIT({})', n) END""",
    "sqlite": """CASE kind WHEN 'boolean' THEN 'BOOLEAN' WHEN 'smallint' THEN 'SMALLINT' WHEN 'integer' THEN 'INTEGER' WHEN 'bigint' THEN 'INTEGER' WHEN 'decimal' THEN CASE WHEN prec > 0 THEN format('NUMERIC({},{})', prec, scale) ELSE 'NUMERIC' END
 WHEN 'real' THEN 'REAL' WHEN 'double' THEN 'REAL' WHEN 'varchar' THEN CASE WHEN n > 0 THEN format('VARCHAR({})', n) ELSE 'TEXT' END WHEN 'char' THEN format('CHAR({})', n) WHEN 'text' THEN 'TEXT' WHEN 'binary' THEN 'BLOB' WHEN 'varbinary' THEN 'BLOB'
 WHEN 'blob' THEN 'BLOB' WHEN 'rowversion' THEN 'BLOB' WHEN 'date' THEN 'DATE' WHEN 'time' THEN 'TIME' WHEN 'timestamp' THEN 'DATETIME' || format('({})', fsp) WHEN 'uuid' THEN 'TEXT' WHEN 'json' THEN 'TEXT' WHEN 'xml' THEN 'TEXT' WHEN 'bitstring' THEN format('BIT({})', n) END""",
    "clickhouse": """CASE kind WHEN 'boolean' THEN 'Bool' WHEN 'smallint' THEN 'Int16' WHEN 'integer' THEN CASE WHEN unsigned THEN 'UInt32' ELSE 'Int32' END WHEN 'bigint' THEN CASE WHEN unsigned THEN 'UInt64' ELSE 'Int64' END
 WHEN 'decimal' THEN CASE WHEN prec > 0 THEN format('Decimal({}, {})', prec, scale) ELSE 'Decimal(38, 9)' END WHEN 'real' THEN 'Float32' WHEN 'double' THEN 'Float64' WHEN 'char' THEN format('FixedString({})', n) WHEN 'binary' THEN format('FixedString({})', n)
 WHEN 'rowversion' THEN 'FixedString(8)' WHEN 'date' THEN 'Date32' WHEN 'uuid' THEN 'UUID' WHEN 'bitstring' THEN NULL
 WHEN 'timestamp' THEN CASE WHEN fsp = 0 THEN CASE WHEN tz THEN 'DateTime(''UTC'')' ELSE 'DateTime' END ELSE format('DateTime64({}', least(coalesce(fsp, 3), 9)) || CASE WHEN tz THEN ', ''UTC'')' ELSE ')' END END ELSE 'String' END""",
}


_OLD, _NEW = (_duck(SNAPSHOTS[k], SNAPSHOT_COLUMNS) for k in ("old", "new"))
_CHANGES = f"""(SELECT coalesce(o.table_name, n.table_name) AS table_name, coalesce(o.column_name, n.column_name) AS column_name,
  CASE WHEN o.table_name IS NULL THEN 'added' WHEN n.table_name IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN o.table_name IS NULL OR n.table_name IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.data_type <> n.data_type THEN 'data_type' END, CASE WHEN o.max_length <> n.max_length THEN 'max_length' END,
    CASE WHEN o.is_nullable <> n.is_nullable THEN 'is_nullable' END, CASE WHEN o.has_default <> n.has_default OR trim(o.default_expr) <> trim(n.default_expr) THEN 'default' END) END AS facts
  FROM {_OLD} o FULL JOIN {_NEW} n ON o.table_name = n.table_name AND o.column_name = n.column_name
  WHERE o.table_name IS NULL OR n.table_name IS NULL OR o.data_type <> n.data_type OR o.max_length <> n.max_length OR o.is_nullable <> n.is_nullable OR o.has_default <> n.has_default OR trim(o.default_expr) <> trim(n.default_expr))"""
_EVENTS = "(SELECT event_id AS id, event_type AS source_type, CASE WHEN user_id % 3 = 0 THEN '' ELSE user_id::VARCHAR END AS source_identity, ts AS captured_at FROM events)"
_LAST = """(SELECT user_id AS run_id, ts AS "at", event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'running' ELSE 'success' END AS status, CASE WHEN event_id % 5 = 0 THEN 'boom' END AS error FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""
_RANK = "CASE risk WHEN 'safe' THEN 0 WHEN 'blocking' THEN 1 WHEN 'rebuild' THEN 2 ELSE 3 END"
_PHASE = "CASE phase WHEN 'create table' THEN 0 WHEN 'drop foreign key' THEN 1 WHEN 'change table' THEN 2 WHEN 'create index' THEN 3 WHEN 'create check' THEN 4 WHEN 'add foreign key' THEN 5 ELSE 6 END"
_STEP = "CASE step WHEN 'drop check' THEN 0 WHEN 'drop index' THEN 1 WHEN 'add column' THEN 2 WHEN 'change column' THEN 3 WHEN 'drop column' THEN 4 WHEN 'add index' THEN 5 WHEN 'add check' THEN 6 ELSE 7 END"
_PLAN = _duck(STATEMENTS, STATEMENT_COLUMNS, own=True)
_BASE = "regexp_replace(column_name, '^[a-z]{1,2}_', '')"
_REFERENCES = f"""(SELECT c.table_name, c.column_name, p.table_name AS ref_table, p.column_name AS ref_column FROM (SELECT *, {_BASE} AS base FROM {_SCHEMA}) c
  JOIN (SELECT *, {_BASE} AS base FROM {_SCHEMA} WHERE ordinal = 1) p ON c.base = p.base AND c.table_name <> p.table_name AND regexp_matches(p.base, '(key|_id)$') AND starts_with(p.table_name, regexp_replace(p.base, '(key|_id)$', '')))"""
_DROP = f"""WITH RECURSIVE e AS (SELECT DISTINCT table_name AS child, ref_table AS parent FROM {_REFERENCES}),
d(name, level) AS (SELECT DISTINCT table_name, 0 FROM {_SCHEMA} UNION ALL SELECT e.parent, d.level + 1 FROM d JOIN e ON e.child = d.name) SELECT name AS table_name, max(level)::INT AS level FROM d GROUP BY name"""
_VIOLATIONS = {
    "priority": "o_orderpriority[1:1] NOT IN ('1', '2', '3') OR o_orderpriority[2:2] <> '-'",
    "status": "o_orderstatus NOT IN ('F', 'O')",
    "price": "o_totalprice < 1000 OR o_totalprice > 200000",
    "quantity": "NOT (l_quantity > 5 AND l_discount < 0.05 AND l_tax <> 0.01 AND l_tax <> 0.02)",
    "name": "NOT regexp_matches(c_name, '^Customer#0+[1-9]')",
    "sum": "l_extendedprice * (1 - l_discount) - l_tax = 0 OR l_returnflag IS NULL",
}
#: The meaning of each default, as read by a person.
_LABELS = ["current_dt", "current_dt", "current_dt", "current_dt", "false", "true", "constant'x'", "constant'it's'", "constant'a'", "uuid_gen", "uuid_gen", "current_date", "current_date", "null", "", "other:nextval('s')", "constant-5", "other:lower('a')", "constant'pending'"]
_SQL_TYPES = {
    "postgres": ("integer", "bigint", "double precision", "text", "timestamp without time zone", "real[]"),
    "mssql": ("INT", "BIGINT", "FLOAT", "NVARCHAR(MAX)", "DATETIME2", "NVARCHAR(MAX)"),
    "mysql": ("INT", "BIGINT", "DOUBLE", "LONGTEXT", "DATETIME(6)", "JSON"),
    "sqlite": ("INTEGER", "INTEGER", "REAL", "TEXT", "DATETIME", "TEXT"),
    "clickhouse": ("Int32", "Int64", "Float64", "String", "DateTime64(3)", "Array(Float32)"),
}


def _native(target: str) -> str:
    names = ("int", "bigint", "double", "string", "timestamp_ntz", "array<float>")
    return f"CASE data_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(names, _SQL_TYPES[target]))} END"


def _create(target: str) -> str:
    a, b = {"postgres": '""', "mssql": "[]", "mysql": "``", "sqlite": '""', "clickhouse": "``"}[target]
    typed = _native(target)
    if target == "clickhouse":
        line = f"'  {a}' || column_name || '{b} ' || CASE WHEN ordinal = 1 THEN {typed} ELSE 'Nullable(' || {typed} || ')' END"
        tail = f"chr(10) || ') ENGINE = MergeTree ORDER BY ({a}' || min(column_name) FILTER (ordinal = 1) || '{b})'"
    else:
        line = f"'  {a}' || column_name || '{b} ' || {typed} || CASE WHEN ordinal = 1 THEN ' NOT NULL' ELSE '' END"
        tail = f"',' || chr(10) || '  PRIMARY KEY ({a}' || min(column_name) FILTER (ordinal = 1) || '{b})' || chr(10) || '){' ENGINE=InnoDB' if target == 'mysql' else ''}'"
    return f"SELECT '{target}' AS target, table_name, 'CREATE TABLE {a}' || table_name || '{b} (' || chr(10) || string_agg({line}, ',' || chr(10) ORDER BY ordinal) || {tail} AS sql FROM {_SCHEMA} GROUP BY table_name"


def _foreign_keys() -> str:
    parts = []
    for target, (a, b) in {"postgres": '""', "mssql": "[]", "mysql": "``"}.items():
        text = f"ALTER TABLE {a}app{b}.{a}{{0}}{b} ADD CONSTRAINT {a}fk_{{0}}_{{1}}{b} FOREIGN KEY ({a}{{2}}{b}) REFERENCES {a}app{b}.{a}{{1}}{b} ({a}{{3}}{b})"
        parts.append(f"SELECT '{target}' AS target, format('{text}', table_name, ref_table, column_name, ref_column) || CASE WHEN table_name = 'lineitem' THEN ' ON DELETE CASCADE' ELSE '' END AS sql FROM {_REFERENCES}")
    return " UNION ALL ".join(parts)


#: What each dialect lacks, by hand.
_LACKS = {
    "postgres": "index_prefix",
    "mssql": "cascade index_expression index_prefix",
    "mysql": "cascade index_filter index_include",
    "sqlite": "alter_column cascade check computed drop_constraint drop_schema index_expression index_include index_prefix schema standalone_key unique",
    "clickhouse": "alter_column cascade check computed default drop_constraint drop_index identity index index_expression index_filter index_include index_prefix standalone_key unique",
}


def _alter_defaults() -> str:
    now = {"postgres": "CURRENT_TIMESTAMP", "mssql": "SYSDATETIME()", "mysql": "CURRENT_TIMESTAMP"}
    rows, parts = _duck(NEW_DEFAULTS, ["table_name", "column_name", "fragment"]), []
    for target, (a, b) in {"postgres": '""', "mysql": "``", "mssql": "[]"}.items():
        text = f"CASE column_name WHEN 'barred' THEN '1' WHEN 'at' THEN '{now[target]}' ELSE '''x''' END"
        head = f"'ALTER TABLE {a}app{b}.{a}' || table_name || '{b} ALTER COLUMN {a}' || column_name || '{b} "
        inside = "replace(table_name, chr(39), chr(39) || chr(39))"
        drop = head + "DROP DEFAULT'" if target != "mssql" else (
            f"'DECLARE @sql nvarchar(max) = (SELECT N''ALTER TABLE [app].[' || {inside} || '] DROP CONSTRAINT '' + QUOTENAME(d.name) FROM sys.default_constraints d JOIN sys.columns c ON c.object_id = d.parent_object_id AND c.column_id = d.parent_column_id "
            f"WHERE d.parent_object_id = OBJECT_ID(N''[app].[' || {inside} || ']'') AND c.name = N''' || column_name || '''); IF @sql IS NOT NULL EXEC sp_executesql @sql'"
        )
        put = f"{head}SET DEFAULT ' || {text}" if target != "mssql" else f"'ALTER TABLE [app].[' || table_name || '] ADD CONSTRAINT [df_' || table_name || '_' || column_name || '] DEFAULT ' || {text} || ' FOR [' || column_name || ']'"
        steps = [("set", 0, put), ("drop", 0, drop)] if target != "mssql" else [("set", 0, drop), ("set", 1, put), ("drop", 0, drop)]
        parts += [f"SELECT '{target}' AS target, '{k}' AS action, table_name, {n} AS place, {q} AS sql FROM {rows}" for k, n, q in steps]
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    mapped = ", ".join(f"{_native(t)} AS {t}" for t in _SQL_TYPES)
    kinds = "CASE data_type WHEN 'int' THEN 'integer' WHEN 'string' THEN 'text' WHEN 'timestamp_ntz' THEN 'timestamp' WHEN 'array<float>' THEN 'array' ELSE data_type END"
    out = {
        "introspect_columns": f"SELECT * FROM {_SCHEMA}",
        "row_count_exact": f"SELECT * FROM {_COUNTS}",
        "row_size_estimate": f"SELECT *, row_bytes * row_count AS table_bytes FROM {_SIZES}",
        "row_size_average": f"SELECT (sum(row_bytes * row_count) // sum(row_count))::BIGINT AS avg_row_bytes, (SELECT table_name FROM {_SIZES} ORDER BY row_bytes DESC, table_name DESC LIMIT 1) AS widest FROM {_SIZES}",
        "canonical_kinds": f"SELECT dialect, data_type, length, kind FROM {_TYPED}",
        "map_types": f"SELECT table_name, column_name, {kinds} AS kind, {mapped} FROM {_SCHEMA}",
        "ident_fold": r"SELECT p_partkey, regexp_replace(lower(p_name || ' #' || p_brand), '[^a-z0-9_]', '_', 'g') AS folded, regexp_full_match(p_name || ' #' || p_brand, '[A-Za-z_][A-Za-z0-9_ $#]*') AS valid FROM part",
        "ident_collisions": r"SELECT replace(lower(p_brand), '#', '_') AS folded, count(DISTINCT name) AS names FROM (SELECT p_brand, unnest([p_brand, lower(p_brand), replace(p_brand, '#', '_')]) AS name FROM part) GROUP BY 1 HAVING count(DISTINCT name) > 1",
        "scope_filter": f"SELECT t AS table_name FROM (SELECT unnest([{_NAMES}]) AS t) WHERE (regexp_matches(t, '^[c-n]') OR t LIKE 'p%') AND NOT (t LIKE '%s' OR t LIKE 'nat_on')",
        "managed_set": f"WITH e AS {_duck(SIDES, SIDE_COLUMNS)} SELECT table_name FROM e WHERE side = 'live' AND (table_name IN (SELECT table_name FROM e WHERE side = 'mine') OR table_name NOT IN (SELECT table_name FROM e WHERE side = 'source'))",
        "snapshot_diff_columns": f"SELECT * FROM {_CHANGES}",
        "snapshot_diff_tables": f"SELECT DISTINCT table_name, 'added' AS change FROM {_NEW} WHERE table_name NOT IN (SELECT table_name FROM {_OLD}) UNION ALL SELECT DISTINCT table_name, 'removed' FROM {_OLD} WHERE table_name NOT IN (SELECT table_name FROM {_NEW})",
        "snapshot_diff_summary": f"SELECT change, count(*) AS n, change = 'removed' AS is_destructive FROM {_CHANGES} GROUP BY change",
        "snapshot_backfill": f"""SELECT o.version, o.table_name, o.column_name, CASE WHEN n.column_name IS NOT NULL AND o.version < 2 THEN n.is_unsigned ELSE o.is_unsigned END AS is_unsigned, CASE WHEN n.column_name IS NOT NULL AND o.version < 4 THEN n.display_width ELSE o.display_width END AS display_width,
  CASE WHEN n.column_name IS NOT NULL AND o.version < 3 THEN n.datetime_precision ELSE o.datetime_precision END AS datetime_precision FROM {_duck(BACKFILL["old"], BACKFILL_COLUMNS)} o LEFT JOIN {_duck(BACKFILL["now"], BACKFILL_COLUMNS)} n USING (table_name, column_name)""",
        "pk_set_compare": f"SELECT n, list_sort(string_split(lower(one), ',')) = list_sort(string_split(lower(two), ',')) AS same_set, one = two AS same_order FROM {_duck(KEY_PAIRS, ['n', 'one', 'two'], ids=('n',))}",
        "drop_order": _DROP,
        "name_references": f"SELECT * FROM {_REFERENCES}",
        "risk_filter": f"SELECT phase, object_name, risk FROM {_PLAN} WHERE {_RANK} <= 1",
        "risk_counts": f"SELECT count(*) FILTER (risk = 'safe') AS safe, count(*) FILTER (risk = 'blocking') AS blocking, count(*) FILTER (risk = 'rebuild') AS rebuild, count(*) FILTER (risk = 'data-loss') AS data_loss, count(*) AS total, bool_or({_RANK} > 2) AS needs_consent FROM {_PLAN}",
        "plan_order": f"SELECT phase, table_name, step, object_name, {_PHASE} AS phase_no, {_STEP} AS step_no FROM {_PLAN}",
        "plan_script": f"SELECT database, string_agg('-- [' || risk || '] ' || description || chr(10) || sql || ';' || chr(10) || chr(10), '' ORDER BY {_PHASE}, table_name, {_STEP}, object_name) AS script FROM {_PLAN} GROUP BY database",
        "latest_snapshot": f"SELECT id, source_identity, captured_at FROM {_EVENTS} WHERE source_type = 'click' AND source_identity IN ('7', '') ORDER BY source_identity = '7' DESC, captured_at DESC, id DESC LIMIT 1",
        "list_snapshots": f"SELECT id, captured_at FROM {_EVENTS} ORDER BY captured_at DESC, id DESC LIMIT 50",
        "current_runs": f"SELECT * FROM {_LAST}",
        "recent_runs": f'SELECT run_id, "at" FROM {_LAST} ORDER BY "at" DESC, run_id DESC LIMIT 20',
        "reconcile_runs": f"SELECT run_id, CASE WHEN stale THEN 'failed' ELSE status END AS status, CASE WHEN stale THEN coalesce(error, 'stale run') ELSE error END AS error FROM (SELECT *, status = 'running' AND \"at\" < TIMESTAMP '2024-01-15' AS stale FROM {_LAST})",
        "schema_fingerprint": f"SELECT table_name, sha256(string_agg(table_name || '|' || ordinal || '|' || column_name || '|' || data_type, chr(10) ORDER BY ordinal)) AS fingerprint FROM {_SCHEMA} GROUP BY table_name",
        "default_labels": f"SELECT table_name, fragment, label FROM {_duck(DEFAULT_ROWS, ['table_name', 'fragment'])} JOIN (VALUES " + ", ".join(f"({quoted(d)}, {quoted(w)})" for d, w in zip(DEFAULTS, _LABELS)) + ") AS l(fragment, label) USING (fragment)",
        "check_violations": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({_VIOLATIONS[n]}) AS violations FROM {t}" for n, (t, _) in CHECKS.items()),
        "create_table_ddl": " UNION ALL ".join(map(_create, _SQL_TYPES)),
        "foreign_key_ddl": _foreign_keys(),
        "alter_default_ddl": _alter_defaults(),
        "capabilities": f"SELECT table_name, target, capability FROM {_duck(NEEDS, ['table_name', 'capability'])} JOIN (VALUES " + ", ".join(f"('{d}', '{c}')" for d, cs in _LACKS.items() for c in cs.split()) + ") AS l(target, capability) USING (capability)",
    }
    return out | {f"map_to_{t}": f"SELECT dialect, data_type, length, prec, scale, fsp, {m} AS type_text FROM {_TYPED}" for t, m in _MAP.items()}
