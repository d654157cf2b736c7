"""Queries of plans, validation, manifests and mapping losses, with their DuckDB counterparts.

The templates are of a reading room's catalog, of which each supplier keeps one (``estate``).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur import catalog_queries
from larkspur.catalog_queries import TABLES, _duck, fixture
from larkspur.functions import identifiers, texts, types
from larkspur.operators import state
from larkspur.plans import api, changes, ordering, validation
from larkspur.sources import catalog

TARGETS = ("postgres", "mssql", "mysql")

#: dialect, type, what a person says its kind is, length, precision, scale, fractional digits, unsigned
LOSSY = """VALUES
('mssql','tinyint','tinyint',NULL,NULL,NULL,NULL,false), ('mysql','mediumint','mediumint',NULL,NULL,NULL,NULL,true), ('mysql','int','integer',NULL,NULL,NULL,NULL,true), ('mysql','bigint','bigint',NULL,NULL,NULL,NULL,true),
('postgres','numeric','decimal',NULL,NULL,NULL,NULL,false), ('postgres','numeric','decimal',NULL,70,40,NULL,false), ('mysql','decimal','decimal',NULL,5,9,NULL,true), ('mysql','float','double',NULL,NULL,NULL,NULL,true),
('postgres','bit','bitstring',80,NULL,NULL,NULL,false), ('postgres','bit varying','varbitstring',9,NULL,NULL,NULL,false), ('postgres','timestamp with time zone','timestamp',NULL,NULL,NULL,6,false),
('postgres','time with time zone','time',NULL,NULL,NULL,NULL,false), ('mysql','timestamp','timestamp',NULL,NULL,NULL,0,false), ('mssql','datetime2','timestamp',NULL,NULL,NULL,7,false), ('mysql','mediumtext','text',16777215,NULL,NULL,NULL,false),
('postgres','bytea','blob',NULL,NULL,NULL,NULL,false), ('mssql','nvarchar','varchar',6000,NULL,NULL,NULL,false), ('mssql','nchar','char',10,NULL,NULL,NULL,false), ('mssql','nvarchar','varchar',-1,NULL,NULL,NULL,false),
('postgres','geometry','spatial',NULL,NULL,NULL,NULL,false), ('postgres','text[]','array',NULL,NULL,NULL,NULL,false), ('postgres','uuid','uuid',NULL,NULL,NULL,NULL,false), ('postgres','jsonb','json',NULL,NULL,NULL,NULL,false),
('postgres','xml','xml',NULL,NULL,NULL,NULL,false), ('mysql','enum','enum',NULL,NULL,NULL,NULL,false), ('mysql','set','set',NULL,NULL,NULL,NULL,false), ('mssql','timestamp','rowversion',NULL,NULL,NULL,NULL,false),
('postgres','date','date',NULL,NULL,NULL,NULL,false), ('mssql','binary','binary',16,NULL,NULL,NULL,false), ('postgres','real','real',NULL,NULL,NULL,NULL,false), ('postgres','boolean','boolean',NULL,NULL,NULL,NULL,false)"""
LOSSY_COLUMNS = ["dialect", "data_type", "said", "length", "prec", "scale", "fsp", "unsigned"]


def mapping_warnings(spark, sf_dir):
    """What each column's mapping loses on each target; each distinct declaration is judged once."""
    t = fixture(spark, sf_dir, LOSSY, LOSSY_COLUMNS)
    facts = [c for c in LOSSY_COLUMNS if c != "said"]
    return texts.once(t.select(*facts), facts, _lost).select("dialect", "data_type", "kind", "length", "target", "place", "reason")


def _lost(t):
    t = t.withColumns({"kind": types.kind(F.col("data_type"), F.col("dialect"), F.col("length")), "tz": types.zoned(F.col("data_type")), "national": types.national(F.col("data_type"))})
    facts = types.Facts(*[F.col(c) for c in ("kind", "length", "prec", "scale", "unsigned", "tz", "national", "fsp")], F.lit(None).cast("string"))
    utc = (F.col("dialect") == "mysql") & (F.col("data_type") == "timestamp")
    every = F.map_from_arrays(F.array(*map(F.lit, types.TARGETS)), F.array(*[types.losses(target, facts, utc) for target in types.TARGETS]))
    each = t.select("*", F.explode_outer(every).alias("target", "reasons"))  # outer: else Spark filters by the whole map's size, with all rules again
    return each.select("*", F.posexplode_outer("reasons").alias("place", "reason")).drop("reasons", "tz", "national").where("place IS NOT NULL")


#: (targets, condition, reason) in the order in which the rules are read.
_WARN = [
    ("s", "kind LIKE '%bitstring'", "no bit strings"), ("s", "whole AND unsigned", "no unsigned integers"), ("s", "whole AND kind <> 'bigint'", "integer width isn''t enforced"),
    ("s", "kind IN ('varchar', 'char') AND length > 0", "length isn''t enforced"), ("s", "kind = 'decimal' AND prec > 0", "precision and scale aren''t enforced"), ("s", "kind = 'real'", "stored in 64 bits"),
    ("s", "kind IN ('binary', 'varbinary') AND length > 0", "length isn''t enforced"), ("s", "kind = 'rowversion'", "no row versions"), ("s", "data_type LIKE '%with time zone'", "no time zones"),
    ("s", "kind IN ('time', 'timestamp') AND fsp IS NOT NULL", "fractional seconds aren''t enforced"), ("s", "kind IN ('uuid', 'xml', 'array')", "stored as text"), ("s", "kind = 'json'", "stored as text, not validated"),
    ("s", "kind IN ('enum', 'set')", "members aren''t enforced"), ("s", "kind = 'spatial'", "needs an extension"),
    ("c", "kind = 'mediumint'", "no 24-bit integers"), ("c", "kind IN ('varchar', 'varbinary') AND length > 0", "length isn''t enforced"), ("c", "kind = 'char' AND length > 0", "fixed strings count bytes"),
    ("c", "data_type IN ('nvarchar', 'nchar')", "no national characters"), ("c", "kind = 'decimal' AND prec IS NULL", "default precision"), ("c", "kind = 'date'", "dates from 1900 to 2299 only"),
    ("c", "kind IN ('time', 'json', 'xml', 'set', 'spatial')", "stored as a string"), ("c", "kind = 'timestamp' AND fsp IS NULL", "default fractional seconds"), ("c", "data_type = 'timestamp with time zone'", "zone becomes UTC"),
    ("c", "kind = 'rowversion'", "no row versions"), ("c", "kind = 'enum'", "members are unknown, stored as a string"),
    ("p", "kind = 'tinyint'", "no 8-bit integers"), ("pm", "kind = 'mediumint'", "no 24-bit integers"), ("pm", "unsigned AND kind IN ('smallint', 'integer', 'bigint')", "no unsigned integers"),
    ("mysc", "kind = 'decimal' AND prec IS NULL", "no unbounded decimals"), ("y", "prec > 65", "precision is cut"), ("m", "prec > 38", "precision is cut"), ("y", "scale > 30", "scale is cut"), ("m", "scale > 38", "scale is cut"),
    ("pmysc", "scale > prec", "scale exceeds precision"), ("pmsc", "unsigned AND kind IN ('decimal', 'real', 'double')", "no unsigned fractions"), ("m", "kind LIKE '%bitstring'", "bits become bytes"),
    ("y", "kind = 'varbitstring' OR kind = 'bitstring' AND length > 64", "bits become bytes"), ("y", "data_type = 'timestamp with time zone'", "times from 1970 to 2038 only"), ("my", "data_type = 'time with time zone'", "no time zones"),
    ("pmsc", "dialect = 'mysql' AND data_type = 'timestamp'", "not kept in UTC"), ("py", "fsp > 6", "fractional seconds are cut"), ("m", "fsp > 7", "fractional seconds are cut"), ("c", "fsp > 9", "fractional seconds are cut"),
    ("pmsc", "kind IN ('text', 'blob') AND length IN (255, 65535, 16777215, 4294967295)", "capacity isn''t kept"), ("m", "data_type IN ('nvarchar', 'nchar') AND length BETWEEN 4001 AND 8000", "national characters are lost"),
    ("p", "kind = 'spatial'", "needs an extension"), ("mys", "kind = 'array'", "no arrays"),
]


def _warnings_sql() -> str:
    names = {"p": "postgres", "m": "mssql", "y": "mysql", "s": "sqlite", "c": "clickhouse"}
    rules = " UNION ALL ".join(f"SELECT dialect, data_type, kind, length, '{names[t]}' AS target, {i} AS rule, '{why}' AS reason FROM typed WHERE {when}" for i, (ts, when, why) in enumerate(_WARN) for t in ts)
    return f"""WITH typed AS (SELECT *, said AS kind, said IN ('tinyint', 'smallint', 'mediumint', 'integer', 'bigint') AS whole, row_number() OVER () AS n FROM {_duck(LOSSY, LOSSY_COLUMNS)}), found AS ({rules.replace("kind, length, '", "kind, length, n, '")})
SELECT dialect, data_type, kind, length, target, (row_number() OVER (PARTITION BY n, target ORDER BY rule) - 1)::INT AS place, reason FROM found"""


DECLARED = [("INTEGER", "bigint"), ("int4", "integer"), ("VARCHAR(20)", "varchar"), ("FLOATING POINT", "bigint"), ("native character(70)", "text"), ("my blob", "blob"), ("DOUBLE UNSIGNED", "double"), ("", "text"), ("STRING", "raw"), ("decimal(10, 5)", "decimal"), ("Real", "double"), ("longtext", "text"), ("varying character(9)", "varchar"), ("uuid", "uuid"), ("MONEY", "raw"), (" datetime ", "timestamp")]


DECLARATIONS = "VALUES " + ", ".join(f"('loan', '{d}')" for d, _ in DECLARED)


def sqlite_kinds(spark, sf_dir):
    t = fixture(spark, sf_dir, DECLARATIONS, ["table_name", "declaration"])
    return t.select("table_name", "declaration", types.sqlite_kind(F.col("declaration")).alias("kind"))


_SQLITE = (
    "SELECT table_name, declaration, CASE WHEN n IN ('integer', 'int', 'bigint', 'int8', 'rowid') THEN 'bigint' WHEN n = 'int4' THEN 'integer' WHEN n IN ('varchar', 'nvarchar', 'character varying', 'varying character') THEN 'varchar' WHEN n IN ('real', 'double', 'float', 'double precision') THEN 'double' "
    "WHEN n IN ('decimal', 'numeric') THEN 'decimal' WHEN n IN ('datetime', 'timestamp') THEN 'timestamp' WHEN n IN ('uuid', 'json', 'date', 'time', 'blob', 'text') THEN n WHEN n = '' THEN 'text' WHEN contains(n, 'int') THEN 'bigint' WHEN regexp_matches(n, 'char|clob|text') THEN 'text' "
    "WHEN contains(n, 'blob') THEN 'blob' WHEN regexp_matches(n, 'real|floa|doub') THEN 'double' ELSE 'raw' END AS kind FROM (SELECT table_name, declaration, trim(string_split(lower(trim(declaration)), '(')[1]) AS n FROM " + _duck(DECLARATIONS, ["table_name", "declaration"]) + ")"
)

#: table, column, old and new type, nullability and default, criteria, other attributes (lists by commas)
CHANGED = """VALUES
('reader','card','varchar(12)','varchar(16)',false,false,NULL,NULL,'',''), ('reader','barred','boolean','boolean',true,true,'0','1','',''), ('reader','since','date','date',true,false,NULL,NULL,'',''), ('reader','fee','integer','bigint',false,true,'0','0','',''),
('loan','due','date','date',true,true,'''x''',NULL,'',''), ('loan','no','integer','bigint',false,true,'5',NULL,'',''), ('loan','state','text','text',true,true,NULL,NULL,'','enum_values,srid'), ('loan','back','date','timestamp',true,false,NULL,NULL,'nullability',''), ('loan','mark','text','text',true,true,NULL,NULL,'on_update','')"""
CHANGED_COLUMNS = ["table_name", "column_name", "old_type", "new_type", "old_nullable", "new_nullable", "old_default", "new_default", "criteria", "attributes"]


def _changed(spark, sf_dir):
    lists = {c: F.filter(F.split(c, ","), lambda x: x != "") for c in ("criteria", "attributes")}
    return fixture(spark, sf_dir, CHANGED, CHANGED_COLUMNS).withColumns(lists)


def column_change_plan(spark, sf_dir):
    out = None
    for target in TARGETS:
        one = changes.expanded(_changed(spark, sf_dir), target).withColumn("target", F.lit(target))
        out = one if out is None else out.unionAll(one)
    return out


def _column_change_sql() -> str:
    quote = {"postgres": ('"', '"'), "mssql": ("[", "]"), "mysql": ("`", "`")}
    parts = []
    for t in TARGETS:
        a, b = quote[t]
        table, col = f"'ALTER TABLE {a}' || table_name || '{b}'", f"'{a}' || column_name || '{b}'"
        drop = f"{table} || ' ALTER COLUMN ' || {col} || ' DROP DEFAULT'"
        put = f"{table} || ' ALTER COLUMN ' || {col} || ' SET DEFAULT ' || new_default"
        literal = "CASE WHEN new_type = 'text' THEN '(' || new_default || ')' ELSE new_default END"
        whole = f"new_type || CASE WHEN new_nullable THEN '' ELSE ' NOT NULL' END || coalesce(' DEFAULT ' || {literal}, '')"
        retype = {"postgres": f"{table} || ' ALTER COLUMN ' || {col} || ' TYPE ' || new_type", "mssql": f"{table} || ' ALTER COLUMN ' || {col} || ' ' || new_type || CASE WHEN new_nullable THEN ' NULL' ELSE ' NOT NULL' END", "mysql": f"{table} || ' MODIFY COLUMN ' || {col} || ' ' || {whole}"}[t]
        nulls = retype
        if t == "postgres":
            nulls = f"{table} || ' ALTER COLUMN ' || {col} || CASE WHEN new_nullable THEN ' DROP NOT NULL' ELSE ' SET NOT NULL' END"
        if t == "mssql":
            drop = (
                "'DECLARE @sql nvarchar(max) = (SELECT N''ALTER TABLE [' || table_name || '] DROP CONSTRAINT '' + QUOTENAME(d.name) FROM sys.default_constraints d JOIN sys.columns c ON c.object_id = d.parent_object_id AND c.column_id = d.parent_column_id "
                "WHERE d.parent_object_id = OBJECT_ID(N''[' || table_name || ']'') AND c.name = N''' || column_name || '''); IF @sql IS NOT NULL EXEC sp_executesql @sql'"
            )
            put = f"{table} || ' ADD CONSTRAINT [df_' || table_name || '_' || column_name || '] DEFAULT ' || new_default || ' FOR ' || {col}"
        first = "had AND (retyped OR redefault)" if t == "mssql" else "had AND retyped"
        steps = [
            (first, "'drop column ' || column_name || ' default'", "'safe'", "NULL", drop),
            ("retyped", "'change column ' || column_name || ' type'", "'rebuild'", "'may rewrite the table; fails on values that can''t be cast'", retype),
            ("renull", "'change column ' || column_name || ' nullability'", "CASE WHEN new_nullable THEN 'safe' ELSE 'blocking' END", "CASE WHEN new_nullable THEN NULL ELSE 'checks the rows that are there' END", nulls),
            (f"redefault AND new_default IS NULL AND NOT ({first})", "'drop column ' || column_name || ' default'", "'safe'", "NULL", drop),
            (f"(redefault OR {first}) AND new_default IS NOT NULL", "'change column ' || column_name || ' default'", "'safe'", "NULL", put),
            ("NOT (retyped OR renull OR redefault)", "'change column ' || column_name", "'unsupported'", f"'no statement on {t} for: ' || CASE WHEN attributes <> '' THEN replace(attributes, ',', ', ') ELSE criteria END", "NULL"),
        ]
        parts += [f"SELECT '{t}' AS target, table_name, column_name, {i} AS step, {what} AS description, {risk} AS risk, {note} AS note, {sql} AS sql FROM c WHERE {when}" for i, (when, what, risk, note, sql) in enumerate(steps)]
    return f"""WITH c AS (SELECT *, old_default IS NOT NULL AS had, CASE WHEN criteria = '' THEN old_type <> new_type ELSE criteria IN ('type', 'max_length') END AS retyped,
  CASE WHEN criteria = '' THEN old_nullable <> new_nullable ELSE criteria = 'nullability' END AS renull, CASE WHEN criteria = '' THEN old_default IS DISTINCT FROM new_default ELSE criteria = 'default' END AS redefault FROM {_duck(CHANGED, CHANGED_COLUMNS)}),
s AS ({" UNION ALL ".join(parts)})
SELECT target, table_name, column_name, (row_number() OVER (PARTITION BY target, table_name, column_name ORDER BY step) - 1)::INT AS place, description, risk, note, sql FROM s"""


#: table, ordinal, column, type, nullable, default, identity, place in the key
ROOM = {
    "old": """VALUES ('reader',1,'no','bigint',false,NULL,true,1), ('reader',2,'card','varchar(12)',false,NULL,false,NULL), ('reader',3,'pager','text',true,NULL,false,NULL), ('desk',1,'no','integer',false,NULL,false,1),
('drawer',1,'no','integer',false,NULL,false,1), ('drawer',2,'desk','integer',true,NULL,false,NULL), ('lamp',1,'no','integer',false,NULL,false,1), ('shelf',1,'aisle','integer',false,NULL,false,1), ('shelf',2,'level','integer',false,NULL,false,NULL)""",
    "new": """VALUES ('reader',1,'no','bigint',false,NULL,true,1), ('reader',2,'card','varchar(16)',false,NULL,false,NULL), ('reader',3,'motto','text',false,'''x''',false,NULL), ('reader',4,'born','date',false,NULL,false,NULL),
('fine',1,'no','bigint',false,NULL,false,1), ('fine',2,'reader','bigint',true,NULL,false,NULL), ('shelf',1,'aisle','integer',false,NULL,false,1), ('shelf',2,'level','integer',false,NULL,false,2)""",
}
ROOM_COLUMNS = ["table_name", "ordinal", "column_name", "type_text", "is_nullable", "default", "is_identity", "key_position"]
#: table, kind, name, statement that adds, statement that drops, table that a key references
OBJECTS = {
    "old": """VALUES ('reader','index','ix_card','ADD ix_card','DROP ix_card',NULL), ('reader','check','ck_no','ADD ck_no','DROP ck_no',NULL), ('reader','foreign key','fk_desk','ADD fk_desk','DROP fk_desk','desk'), ('drawer','foreign key','fk_in','ADD fk_in','DROP fk_in','desk'),
('desk','foreign key','fk_has','ADD fk_has','DROP fk_has','drawer'), ('lamp','foreign key','fk_on','ADD fk_on','DROP fk_on','desk')""",
    "new": """VALUES ('reader','index','ix_card','ADD ix_card 2','DROP ix_card',NULL), ('reader','foreign key','fk_shelf','ADD fk_shelf','DROP fk_shelf','shelf'), ('fine','foreign key','fk_reader','ADD fk_reader','DROP fk_reader','reader'), ('fine','index','ix_fine','ADD ix_fine','DROP ix_fine',NULL), ('fine','check','ck_fine','ADD ck_fine','DROP ck_fine',NULL)""",
}
OBJECT_COLUMNS = ["table_name", "kind", "object_name", "add_sql", "drop_sql", "ref_table"]


def _room(spark, sf_dir):
    whole = {"whole": True, "own": True}
    sides = [{"columns": fixture(spark, sf_dir, ROOM[k], ROOM_COLUMNS, **whole), "objects": fixture(spark, sf_dir, OBJECTS[k], OBJECT_COLUMNS, **whole)} for k in ("old", "new")]
    return changes.sync_plan(*sides, "postgres", by="database")


def sync_plan(spark, sf_dir):
    """The whole plan from one state of each reading room to the next."""
    plan, _ = _room(spark, sf_dir)
    return ordering.ordered(plan, by="database").select("database", "phase_no", "seq", "table_name", "step_no", "object_name", "place", "risk", "description", "sql")


def sync_unsupported(spark, sf_dir):
    return _room(spark, sf_dir)[1]


def sync_script(spark, sf_dir):
    return ordering.script(*_room(spark, sf_dir), by="database")


def sync_manifest(spark, sf_dir):
    plan, unsupported = _room(spark, sf_dir)
    source = fixture(spark, sf_dir, "VALUES ('a', 1), ('b', 2)", ["table_name", "n"])
    return changes.manifest(ordering.script(plan, unsupported, by="database"), source, {"statement_count": plan, "unsupported_count": unsupported}, source_dialect="mssql", target_dialect="postgres")


def create_manifest(spark, sf_dir):
    """The run that creates every table on Postgres: its fingerprints and how many tables and losses there are."""
    ddl_rows = catalog_queries.create_table_ddl(spark, sf_dir).where("target = 'postgres'")
    script = ddl_rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("table_name", "sql"))), lambda r: r["sql"]), ";\n\n").alias("script"))
    lost = mapping_warnings(spark, sf_dir).where("target = 'postgres'")
    return changes.manifest(script, catalog_queries.introspect_columns(spark, sf_dir), {"table_count": ddl_rows, "warning_count": lost}, source_dialect="spark", target_dialect="postgres", unknown_type_policy="fail")


_R = {k: _duck(v, [c if c != "default" else '"default"' for c in ROOM_COLUMNS], whole=True) for k, v in ROOM.items()}
_O = {k: _duck(v, OBJECT_COLUMNS, whole=True) for k, v in OBJECTS.items()}
_SYNC = f"""WITH oc AS {_R["old"]}, nc AS {_R["new"]}, oo AS {_O["old"]}, no_ AS {_O["new"]},
made AS (SELECT DISTINCT table_name FROM nc WHERE table_name NOT IN (SELECT table_name FROM oc)), gone AS (SELECT DISTINCT table_name FROM oc WHERE table_name NOT IN (SELECT table_name FROM nc)),
def AS (SELECT *, concat_ws(' ', '"' || column_name || '"', type_text, CASE WHEN NOT is_nullable THEN 'NOT NULL' END, 'DEFAULT ' || "default") AS d FROM nc),
adds AS (SELECT n.*, table_name IN (SELECT * FROM made) AS is_new FROM no_ n WHERE NOT EXISTS (SELECT 1 FROM oo o WHERE o.table_name = n.table_name AND o.kind = n.kind AND o.object_name = n.object_name AND o.add_sql = n.add_sql)),
drops AS (SELECT o.* FROM oo o WHERE table_name NOT IN (SELECT * FROM gone) AND NOT EXISTS (SELECT 1 FROM no_ n WHERE o.table_name = n.table_name AND o.kind = n.kind AND o.object_name = n.object_name AND o.add_sql = n.add_sql)),
p AS (
SELECT 0 AS phase_no, 0 AS seq, table_name, 7 AS step_no, table_name AS object_name, 0 AS place, 'safe' AS risk, NULL AS note, 'create table ' || table_name AS description,
  'CREATE TABLE "' || table_name || '" (' || chr(10) || string_agg('  ' || d, ',' || chr(10) ORDER BY ordinal) || ',' || chr(10) || '  PRIMARY KEY (' || string_agg('"' || column_name || '"', ', ' ORDER BY key_position) FILTER (key_position IS NOT NULL) || ')' || chr(10) || ')' AS sql FROM def WHERE table_name IN (SELECT * FROM made) GROUP BY table_name
UNION ALL SELECT 1, 0, table_name, 7, object_name, 0, 'safe', NULL, 'drop foreign key ' || object_name, drop_sql FROM drops WHERE kind = 'foreign key'
UNION ALL SELECT 2, 0, table_name, CASE kind WHEN 'check' THEN 0 ELSE 1 END, object_name, 0, 'safe', NULL, 'drop ' || kind || ' ' || object_name, drop_sql FROM drops WHERE kind <> 'foreign key'
UNION ALL SELECT 2, 0, table_name, 2, column_name, 0, CASE WHEN is_nullable OR "default" IS NOT NULL OR is_identity THEN 'safe' ELSE 'blocking' END, CASE WHEN is_nullable OR "default" IS NOT NULL OR is_identity THEN NULL ELSE 'needs a value for the rows that are there' END,
  'add column ' || column_name, 'ALTER TABLE "' || table_name || '" ADD COLUMN ' || d FROM def WHERE table_name NOT IN (SELECT * FROM made) AND (table_name, column_name) NOT IN (SELECT (table_name, column_name) FROM oc)
UNION ALL SELECT 2, 0, n.table_name, 3, n.column_name, 0, 'rebuild', 'may rewrite the table; fails on values that can''t be cast', 'change column ' || n.column_name || ' type', 'ALTER TABLE "' || n.table_name || '" ALTER COLUMN "' || n.column_name || '" TYPE ' || n.type_text FROM nc n JOIN oc o USING (table_name, column_name) WHERE n.type_text <> o.type_text
UNION ALL SELECT 2, 0, table_name, 4, column_name, 0, 'data-loss', 'drops the column''s data', 'drop column ' || column_name, 'ALTER TABLE "' || table_name || '" DROP COLUMN "' || column_name || '"' FROM oc WHERE table_name NOT IN (SELECT * FROM gone) AND (table_name, column_name) NOT IN (SELECT (table_name, column_name) FROM nc)
UNION ALL SELECT CASE WHEN kind = 'foreign key' THEN 5 WHEN NOT is_new THEN 2 WHEN kind = 'index' THEN 3 ELSE 4 END, CASE WHEN kind = 'foreign key' AND is_new THEN 1 ELSE 0 END, table_name, CASE WHEN kind = 'foreign key' OR is_new THEN 7 WHEN kind = 'index' THEN 5 ELSE 6 END, object_name, 0, 'blocking', NULL, 'add ' || kind || ' ' || object_name, add_sql FROM adds
UNION ALL SELECT 6, i, t, 7, t, 0, 'data-loss', 'drops the table''s data', 'drop table ' || t, 'DROP TABLE IF EXISTS "' || t || '"' FROM (SELECT i, table_name AS t FROM gone JOIN (VALUES (0, 'lamp_'), (3, 'desk_'), (4, 'drawer_')) AS l(i, t) ON starts_with(table_name, t))
UNION ALL SELECT 6, i, table_name, 7, object_name, 0, 'safe', NULL, 'drop foreign key ' || object_name || ' of a cycle', drop_sql FROM oo JOIN (VALUES (1, 'fk_has'), (2, 'fk_in')) AS c(i, k) ON k = object_name),
u AS (SELECT table_name, 'change primary key' AS description, 'from (' || o.key || ') to (' || n.key || ')' AS reason FROM (SELECT table_name, string_agg(column_name, ',' ORDER BY key_position) FILTER (key_position > 0) AS key FROM oc GROUP BY 1) o JOIN (SELECT table_name, string_agg(column_name, ',' ORDER BY key_position) FILTER (key_position > 0) AS key FROM nc GROUP BY 1) n USING (table_name) WHERE o.key <> n.key),
script AS (SELECT database, coalesce((SELECT string_agg('-- [' || risk || '] ' || description || chr(10) || coalesce('-- note: ' || note || chr(10), '') || sql || ';' || chr(10) || chr(10), '' ORDER BY phase_no, seq, table_name, step_no, object_name, place) FROM p WHERE ends_with(p.table_name, '_' || database)), '') ||
  coalesce((SELECT string_agg('-- [unsupported] ' || description || chr(10) || '-- table: ' || table_name || chr(10) || '-- reason: ' || reason || chr(10) || chr(10), '' ORDER BY table_name, description) FROM u WHERE ends_with(u.table_name, '_' || database)), '') AS script FROM (SELECT s_suppkey AS database FROM supplier))
"""


def create_plan(spark, sf_dir):
    """The order of a plan that creates a schema: schema, tables, indexes, keys, checks; each in the source's order."""
    tables = catalog.parquet_columns(spark, sf_dir, TABLES).where("ordinal = 1").select(F.lit("table").alias("kind"), "table_name")
    refs = catalog_queries.name_references(spark, sf_dir)
    rest = refs.select(F.lit("foreign key"), F.concat_ws("_", F.lit("fk"), "table_name", "ref_table")).unionAll(refs.select(F.lit("index"), F.concat_ws("_", F.lit("ix"), "table_name", "column_name")))
    checks = spark.range(1).select(F.explode(F.expr("map_from_entries(array(" + ", ".join(f"struct('{n}', 'check')" for n in sorted(catalog_queries.CHECKS)) + "))")).alias("object_name", "kind"))
    schema = spark.range(1).select(F.lit("schema").alias("kind"), F.lit("app").alias("object_name"))
    every = tables.toDF("kind", "object_name").unionAll(rest).unionAll(checks.select("kind", "object_name")).unionAll(schema)
    place = F.row_number().over(Window.partitionBy("kind").orderBy("object_name")) - 1
    return ordering.create_order(every.withColumn("source_place", place))


BAD = {
    "tables": """VALUES ('reader', 'no:bigint:i:', 'no'), ('', 'no:int::', ''), ('desk', '', 'no'), ('loan', 'no:int::,:text::', 'no,gone'), ('shelf', 'a:::d,b:int::c', 'a'), ('lamp', 'a:int::', ' ')""",
    "indexes": """VALUES ('ix', 'reader', 'a,b', 'false,true', '0,0', 'c'), (' ', 'reader', 'a', 'true', '3', ''), ('ix2', '', '', 'true', '0', ''), ('ix3', 't', 'a', 'false', '-1,0', 'b, ')""",
    "keys": """VALUES ('fk', 'loan', 'a', 'reader', 'no', 'cascade', 'set   null'), ('fk2', 'loan', 'a,b', 'reader', 'no', 'explode', NULL), ('fk3', '', '', ' ', '', 'RESTRICT', 'SET DEFAULT'), ('', 'loan', ' ', 'reader', 'x', NULL, 'no action')""",
}


def _list(c: str):
    return F.filter(F.split(c, ","), lambda x: x != "")


def invalid_definitions(spark, sf_dir):
    t = fixture(spark, sf_dir, BAD["tables"], ["table_name", "columns", "key"])
    part = lambda c, i: F.element_at(F.split(c, ":"), i)
    t = t.withColumns({"columns": F.transform(_list("columns"), lambda c: F.struct(part(c, 1).alias("name"), part(c, 2).alias("data_type"), (part(c, 3) == "i").alias("is_identity"), (part(c, 4) == "d").alias("has_default"), (part(c, 4) == "c").alias("is_computed"))), "key": _list("key")})
    ix = fixture(spark, sf_dir, BAD["indexes"], ["index_name", "table_name", "columns", "exprs", "prefixes", "include_cols"])
    ix = ix.withColumns({"columns": _list("columns"), "exprs": F.transform(_list("exprs"), lambda x: x == "true"), "prefixes": _list("prefixes").cast("array<int>"), "include_cols": _list("include_cols")})
    fk = fixture(spark, sf_dir, BAD["keys"], ["fk_name", "table_name", "columns", "ref_table", "ref_columns", "on_delete", "on_update"]).withColumns({"columns": _list("columns"), "ref_columns": _list("ref_columns")})
    out = validation.indexes(ix).select(F.lit("index").alias("what"), F.lit("").alias("target"), "name", "place", "violation")
    for target in types.TARGETS:
        out = out.unionAll(validation.tables(t, target).select(F.lit("table"), F.lit(target), "name", "place", "violation"))
        out = out.unionAll(validation.foreign_keys(fk, target).select(F.lit("foreign key"), F.lit(target), "name", "place", "violation"))
    return out


def _invalid_sql() -> str:
    lst = lambda c: f"list_filter(string_split({c}, ','), lambda x: x <> '')"
    has = lambda c, w: f"len(list_filter({lst(c)}, lambda x: {w})) > 0"
    part = lambda i: f"string_split(x, ':')[{i}]"
    dialects = "(VALUES ('postgres'), ('mssql'), ('mysql'), ('sqlite'), ('clickhouse')) AS d(target)"
    t = [
        ("trim(table_name) = ''", "empty table name"), ("columns = ''", "no columns"), (has("columns", f"trim({part(1)}) = ''"), "empty column name"), (has("columns", f"trim({part(2)}) = ''"), "empty data type"),
        (has("columns", f"{part(3)} = 'i'") + " AND target = 'clickhouse'", "identity unsupported"), (has("columns", f"{part(4)} = 'd'") + " AND target = 'clickhouse'", "defaults unsupported"), (has("columns", f"{part(4)} = 'c'") + " AND target IN ('sqlite', 'clickhouse')", "computed columns unsupported"),
        (has("key", "trim(x) = ''"), "empty key column"), (f"len(list_filter({lst('key')}, lambda k: trim(k) <> '' AND NOT list_contains(list_transform({lst('columns')}, lambda x: {part(1)}), k))) > 0", "key column does not exist"),
    ]
    ix = [
        ("table_name = ''", "empty table name"), ("trim(index_name) = ''", "empty index name"), ("columns = ''", "no columns"), (f"len({lst('exprs')}) > len({lst('columns')})", "more expression flags than columns"), (f"len({lst('prefixes')}) > len({lst('columns')})", "more prefixes than columns"),
        (has("columns", "trim(x) = ''"), "empty column"), (has("prefixes", "x::INT < 0"), "negative prefix"), ("exprs = 'true' AND prefixes = '3'", "prefix of an expression"), (has("include_cols", "trim(x) = ''"), "empty included column"),
    ]
    act = lambda c: f"upper(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"
    known = "('', 'NO ACTION', 'RESTRICT', 'CASCADE', 'SET NULL', 'SET DEFAULT')"
    lacks = lambda c: f"(target = 'mssql' AND {act(c)} = 'RESTRICT' OR target = 'mysql' AND {act(c)} = 'SET DEFAULT')"
    fk = [
        ("table_name = ''", "empty table name"), ("fk_name = ''", "empty constraint name"), ("trim(ref_table) = ''", "empty referenced table"), ("columns = ''", "no columns"), (f"len({lst('columns')}) <> len({lst('ref_columns')})", "column counts differ"),
        (has("columns", "trim(x) = ''"), "empty column"), (has("ref_columns", "trim(x) = ''"), "empty referenced column"), (f"{act('on_delete')} NOT IN {known} OR {act('on_update')} NOT IN {known}", "invalid action"), (f"{lacks('on_delete')} OR {lacks('on_update')}", "unsupported action"),
    ]
    parts = []
    for what, rules, source, name, target in (
        ("table", t, f"{_duck(BAD['tables'], ['table_name', 'columns', 'key'], own=True)}, {dialects}", "table_name", "target"),
        ("index", ix, _duck(BAD["indexes"], ["index_name", "table_name", "columns", "exprs", "prefixes", "include_cols"], own=True), "index_name", "''"),
        ("foreign key", fk, f"{_duck(BAD['keys'], ['fk_name', 'table_name', 'columns', 'ref_table', 'ref_columns', 'on_delete', 'on_update'], own=True)}, {dialects}", "fk_name", "target"),
    ):
        parts += [f"SELECT '{what}' AS what, {target} AS target, {name} AS name, row_id, {i} AS rule, '{why}' AS violation FROM {source} WHERE {when}" for i, (when, why) in enumerate(rules)]
    return f"SELECT what, target, name, (row_number() OVER (PARTITION BY what, target, row_id ORDER BY rule) - 1)::INT AS place, violation FROM ({' UNION ALL '.join(parts)})"


def table_predicates(spark, sf_dir):
    """What a table's key allows, the first column being the key; lineitem and conversations have two."""
    two = F.col("table_name").isin("lineitem", "conversations")
    c = catalog.parquet_columns(spark, sf_dir, TABLES).withColumn("key_position", F.when((F.col("ordinal") == 1) | two & (F.col("ordinal") == 2), F.col("ordinal")))
    return catalog.key_facts(c, catalog.row_counts(spark, sf_dir, TABLES), 1000)


_TWO = "table_name IN ('lineitem', 'conversations')"


def run_by_id(spark, sf_dir):
    return state.run(catalog_queries.current_runs(spark, sf_dir), 7).select("run_id", "at", "status")


NAMED = "VALUES ('Loan Desk', 'src', '2nd Key', 'A,lower(B)', 'false,true', 'src'), ('reader', NULL, 'Größe', 'x y', 'false', NULL)"
NAMED_COLUMNS = ["table_name", "schema_name", "object_name", "parts", "exprs", "ref_schema"]


def normalized_objects(spark, sf_dir):
    t = fixture(spark, sf_dir, NAMED, NAMED_COLUMNS).withColumns({"parts": F.split("parts", ","), "exprs": F.transform(F.split("exprs", ","), lambda x: x == "true")})
    out = changes.retargeted(changes.normalized(t, identifiers.folded, ("table_name", "object_name"), {"parts": "exprs"}), "app")
    return out.withColumn("parts", F.array_join("parts", "|")).drop("exprs")


def _fold(name: str) -> str:
    word = f"regexp_replace(lower({name}), '[^\\p{{L}}\\p{{Nd}}_]', '_', 'g')"
    return f"CASE WHEN regexp_matches({name}, '^[0-9]') THEN 'col_' || {word} ELSE {word} END"


LIVE = "VALUES ('loan', 'due', 'ix_due', 'fk_reader', 'foreign_key', 'app'), ('o''hara', 'a', 'ix', 'pk', 'primary_key', 'it''s')"
LIVE_COLUMNS = ["table_name", "column_name", "index_name", "constraint_name", "constraint_kind", "schema_name"]
EVOLVED = [(d, op) for d in ("postgres", "mssql", "mysql") for op in ("create_schema", "drop_schema", "drop_table", "truncate_table", "drop_index", "drop_constraint", "drop_column")] + [("sqlite", op) for op in ("drop_table", "truncate_table", "drop_index", "drop_column")] + [("clickhouse", op) for op in ("drop_schema", "drop_column")]


def evolution_batches(spark, sf_dir):
    """The statements of each operation on each dialect."""
    registry, t, out = api.Registry(), fixture(spark, sf_dir, LIVE, LIVE_COLUMNS), None
    for d, op in EVOLVED:
        one = registry.apply(op, t, d).select(F.lit(d).alias("target"), F.lit(op).alias("operation"), "table_name", "place", "sql", "best_effort")
        out = one if out is None else out.unionAll(one)
    return out


def _evolution_sql() -> str:
    marks = {"postgres": '""', "sqlite": '""', "mssql": "[]", "mysql": "``", "clickhouse": "``"}
    text = lambda c: f"replace({c}, '''', '''''')"
    parts = []
    for d, op in EVOLVED:
        q = lambda c: f"'{marks[d][0]}' || {c} || '{marks[d][1]}'"  # noqa: B023, E731
        database = "SCHEMA" if d == "postgres" else "DATABASE"
        sql = {
            "create_schema": f"'CREATE {database} IF NOT EXISTS ' || {q('schema_name')}",
            "drop_schema": f"'DROP {database} IF EXISTS ' || {q('schema_name')}",
            "drop_table": f"'DROP TABLE IF EXISTS ' || {q('table_name')}",
            "truncate_table": f"'{'DELETE FROM' if d == 'sqlite' else 'TRUNCATE TABLE'} ' || {q('table_name')}",
            "drop_index": f"'DROP INDEX {'IF EXISTS ' if d == 'sqlite' else ''}' || {q('index_name')}" + (f" || ' ON ' || {q('table_name')}" if d in ("mssql", "mysql") else ""),
            "drop_constraint": f"'ALTER TABLE ' || {q('table_name')} || ' DROP CONSTRAINT ' || {q('constraint_name')}",
            "drop_column": f"'ALTER TABLE ' || {q('table_name')} || ' DROP COLUMN {'IF EXISTS ' if d == 'clickhouse' else ''}' || {q('column_name')}",
        }[op]
        if (d, op) == ("mysql", "drop_constraint"):
            sql = f"'ALTER TABLE ' || {q('table_name')} || CASE constraint_kind WHEN 'primary_key' THEN ' DROP PRIMARY KEY' ELSE ' DROP FOREIGN KEY ' || {q('constraint_name')} END"
        if (d, op) == ("mssql", "create_schema"):
            sql = f"'IF NOT EXISTS (SELECT 1 FROM sys.schemas WHERE name = N''' || {text('schema_name')} || ''') EXEC(N''CREATE SCHEMA [' || {text('schema_name')} || ']'')'"
        if (d, op) == ("mssql", "drop_schema"):
            sql = f"'IF SCHEMA_ID(N''' || {text('schema_name')} || ''') IS NOT NULL EXEC(N''DROP SCHEMA [' || {text('schema_name')} || ']'')'"
        steps = [sql]
        if d == "mysql" and op in ("drop_table", "truncate_table"):
            steps = ["'SET FOREIGN_KEY_CHECKS = 0'", sql, "'SET FOREIGN_KEY_CHECKS = 1'"]
        if (d, op) == ("sqlite", "drop_table"):
            steps = ["'PRAGMA foreign_keys = OFF'", sql, "'PRAGMA foreign_keys = ON'"]
        if (d, op) == ("sqlite", "truncate_table"):
            steps.append(f"'DELETE FROM sqlite_sequence WHERE name = ''' || {text('table_name')} || ''''")
        parts += [f"SELECT '{d}' AS target, '{op}' AS operation, table_name, {i} AS place, {s} AS sql, {d == 'sqlite' and op == 'truncate_table' and i == 1} AS best_effort FROM {_duck(LIVE, LIVE_COLUMNS)}" for i, s in enumerate(steps)]
    return " UNION ALL ".join(parts)


def schema_artifact(spark, sf_dir):
    """The columns of each table as JSON."""
    return catalog.artifact(catalog_queries.introspect_columns(spark, sf_dir))


_QUERIES = [mapping_warnings, sqlite_kinds, column_change_plan, sync_plan, sync_unsupported, sync_script, sync_manifest, create_manifest, create_plan, invalid_definitions, table_predicates, run_by_id, normalized_objects, evolution_batches, schema_artifact]


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from larkspur import catalog_sql
    from larkspur.catalog_sql import _COUNTS, _LAST, _REFERENCES, _SCHEMA

    plan = " UNION ALL ".join([
        "SELECT 0 AS phase_no, 'schema' AS kind, 'app' AS object_name", f"SELECT 1, 'table', table_name FROM {_SCHEMA} WHERE ordinal = 1", f"SELECT 2, 'index', 'ix_' || table_name || '_' || column_name FROM {_REFERENCES}",
        f"SELECT 3, 'foreign key', 'fk_' || table_name || '_' || ref_table FROM {_REFERENCES}", *[f"SELECT 4, 'check', '{n}'" for n in catalog_queries.CHECKS],
    ])
    return {
        "mapping_warnings": _warnings_sql(),
        "sqlite_kinds": _SQLITE,
        "column_change_plan": _column_change_sql(),
        "sync_plan": _SYNC + "SELECT regexp_extract(table_name, '([0-9]+)$', 1)::BIGINT AS database, phase_no, seq, table_name, step_no, object_name, place, risk, description, sql FROM p",
        "sync_unsupported": _SYNC + "SELECT *, regexp_extract(table_name, '([0-9]+)$', 1)::BIGINT AS database FROM u",
        "sync_script": _SYNC + "SELECT database, script FROM script",
        "sync_manifest": _SYNC + f"SELECT 'mssql' AS source_dialect, 'postgres' AS target_dialect, 'sha256:' || sha256((SELECT string_agg(h, chr(10) ORDER BY h) FROM (SELECT sha256(to_json({{n: n, table_name: table_name}})::VARCHAR) AS h FROM {_duck("VALUES ('a', 1), ('b', 2)", ['table_name', 'n'])}))) AS source_fingerprint, (SELECT 'sha256:' || sha256(string_agg(h, chr(10) ORDER BY h)) FROM (SELECT sha256(script) AS h FROM script)) AS plan_fingerprint, (SELECT count(*) FROM p) AS statement_count, (SELECT count(*) FROM u) AS unsupported_count",
        "create_manifest": f"""SELECT 'spark' AS source_dialect, 'postgres' AS target_dialect, 'fail' AS unknown_type_policy, (SELECT 'sha256:' || sha256(string_agg(h, chr(10) ORDER BY h)) FROM (SELECT sha256(to_json({{column_name: column_name, data_type: data_type, ordinal: ordinal, table_name: table_name}})::VARCHAR) AS h FROM {_SCHEMA})) AS source_fingerprint,
  (SELECT 'sha256:' || sha256(sha256(string_agg(sql, ';' || chr(10) || chr(10) ORDER BY table_name))) FROM ({catalog_sql.oracle_sql()["create_table_ddl"]}) WHERE target = 'postgres') AS plan_fingerprint, {len(TABLES)}::BIGINT AS table_count, (SELECT count(*) FROM ({_warnings_sql()}) WHERE target = 'postgres') AS warning_count""",
        "create_plan": f"SELECT kind, object_name, (row_number() OVER (ORDER BY phase_no, object_name) - 1)::INT AS place FROM ({plan})",
        "invalid_definitions": _invalid_sql(),
        "table_predicates": f"SELECT table_name, key_size, key_size > 0 AS has_key, key_size = 1 AS has_single_key, row_count > 1000 AS is_large, key_size = 1 AND first IN ('int', 'bigint') AS supports_keyset FROM (SELECT table_name, any_value(row_count) AS row_count, max(CASE WHEN ordinal = 1 THEN data_type END) AS first, CASE WHEN {_TWO} THEN 2 ELSE 1 END AS key_size FROM {_SCHEMA} s JOIN {_COUNTS} c USING (table_name) GROUP BY table_name)",
        "run_by_id": f'SELECT run_id, "at", status FROM {_LAST} WHERE run_id = 7',
        "normalized_objects": f"""SELECT {_fold("table_name")} AS table_name, CASE WHEN schema_name IS NOT NULL THEN 'app' END AS schema_name, {_fold("object_name")} AS object_name,
  array_to_string([CASE WHEN split_part(exprs, ',', i) = 'true' THEN split_part(parts, ',', i) ELSE {_fold("split_part(parts, ',', i)")} END FOR i IN range(1, len(string_split(parts, ',')) + 1)], '|') AS parts, CASE WHEN ref_schema IS NOT NULL THEN 'app' END AS ref_schema FROM {_duck(NAMED, NAMED_COLUMNS)}""",
        "evolution_batches": _evolution_sql(),
        "schema_artifact": f"SELECT table_name, to_json(list({{ordinal: ordinal, column_name: column_name, data_type: data_type}} ORDER BY ordinal))::VARCHAR AS columns FROM {_SCHEMA} GROUP BY table_name",
    }
