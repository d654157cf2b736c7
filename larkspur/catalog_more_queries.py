"""Queries of live tables' texts, kinds of differences, the log of runs, and widths, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.catalog_queries import TYPE_COLUMNS, TYPES, _duck, fixture
from larkspur.functions import kinds
from larkspur.operators import diff, state
from larkspur.plans import live
from larkspur.sources import catalog

#: table, place, column, type, length, precision, scale, nullable, default
COLUMNS = """VALUES ('loan',1,'no','bigint',NULL,64,0,false,NULL), ('loan',2,'code','character varying',12,NULL,NULL,false,'''x'''), ('loan',3,'fee','numeric',NULL,9,2,true,'0'), ('loan',4,'hall','integer',NULL,32,0,true,''),
('hall',1,'no','integer',NULL,32,0,false,NULL), ('hall',2,'name','text',NULL,NULL,NULL,true,NULL), ('desk',1,'no','integer',NULL,NULL,NULL,true,NULL)"""
COLUMN_FACTS = ["table_name", "ordinal", "column_name", "data_type", "max_length", "precision", "scale", "is_nullable", "default_expr"]
KEYS = "VALUES ('loan', 'no,code'), ('hall', 'no'), ('gone', 'x')"
INDEXES = "VALUES ('loan', 'ix_fee', 'fee,hall', true), ('loan', 'ix_code', 'code', false), ('hall', 'ix_name', 'name', false)"
FOREIGN = "VALUES ('loan', 'fk_hall', 'hall', 'hall', 'no', 'SET NULL', NULL), ('loan', 'fk_self', 'no,code', 'loan', 'no,code', NULL, 'cascade')"
FOREIGN_FACTS = ["table_name", "fk_name", "cols", "ref_table", "refs", "on_delete", "on_update"]
CHECKS = "VALUES ('loan', 'ck_fee', 'fee >= 0'), ('desk', 'ck_no', 'no > 0')"


def _cut(df, **names):
    return df.withColumns({new: F.split(old, ",") for new, old in names.items()})


def live_tables(spark, sf_dir):
    """The text of every table that is there, on PostgreSQL."""
    columns = fixture(spark, sf_dir, COLUMNS, COLUMN_FACTS, whole=True)
    keys = _cut(fixture(spark, sf_dir, KEYS, ["table_name", "cols"]), columns="cols")
    none = {"include_cols": F.array().cast("array<string>"), "exprs": F.array().cast("array<boolean>"), "prefixes": F.array().cast("array<int>"), "filter": F.lit(None).cast("string")}
    indexes = _cut(fixture(spark, sf_dir, INDEXES, ["table_name", "index_name", "cols", "is_unique"]), columns="cols").withColumns(none)
    foreign = _cut(fixture(spark, sf_dir, FOREIGN, FOREIGN_FACTS), columns="cols", ref_columns="refs")
    return live.table_ddl(columns, keys, indexes, foreign, fixture(spark, sf_dir, CHECKS, ["table_name", "check_name", "definition"]), "postgres", "app")


def _live_sql() -> str:
    q = lambda c: f"'\"' || replace({c}, ',', '\", \"') || '\"'"
    add = "'ALTER TABLE \"app\".\"' || table_name || '\" ADD CONSTRAINT \"'"
    kind = "CASE WHEN max_length > 0 THEN data_type || '(' || max_length || ')' WHEN precision > 0 AND scale > 0 THEN data_type || '(' || precision || ',' || scale || ')' WHEN precision > 0 THEN data_type || '(' || precision || ')' ELSE data_type END"
    act = lambda c, w: f"CASE WHEN {c} IS NOT NULL THEN ' ON {w} ' || upper({c}) ELSE '' END"
    return f"""WITH body AS (SELECT table_name, string_agg('    "' || column_name || '" ' || {kind} || CASE WHEN is_nullable THEN '' ELSE ' NOT NULL' END || CASE WHEN default_expr <> '' THEN ' DEFAULT ' || default_expr ELSE '' END, ',' || chr(10) ORDER BY ordinal) AS body FROM {_duck(COLUMNS, COLUMN_FACTS, whole=True)} GROUP BY table_name),
more AS (SELECT table_name, 0 AS part, '' AS name, {add} || 'pk_' || table_name || '" PRIMARY KEY (' || {q("cols")} || ');' AS t FROM {_duck(KEYS, ["table_name", "cols"])}
  UNION ALL SELECT table_name, 1, index_name, 'CREATE ' || CASE WHEN is_unique THEN 'UNIQUE ' ELSE '' END || 'INDEX "' || index_name || '" ON "app"."' || table_name || '" (' || {q("cols")} || ');' FROM {_duck(INDEXES, ["table_name", "index_name", "cols", "is_unique"])}
  UNION ALL SELECT table_name, 2, fk_name, {add} || fk_name || '" FOREIGN KEY (' || {q("cols")} || ') REFERENCES "app"."' || ref_table || '" (' || {q("refs")} || ')' || {act("on_delete", "DELETE")} || {act("on_update", "UPDATE")} || ';' FROM {_duck(FOREIGN, FOREIGN_FACTS)}
  UNION ALL SELECT table_name, 3, check_name, {add} || check_name || '" CHECK (' || definition || ');' FROM {_duck(CHECKS, ["table_name", "check_name", "definition"])}),
rest AS (SELECT table_name, string_agg(t, chr(10) ORDER BY part, name) AS rest FROM more GROUP BY table_name)
SELECT table_name, 'CREATE TABLE "app"."' || table_name || '" (' || chr(10) || body || chr(10) || ');' || coalesce(chr(10) || rest, '') AS sql FROM body LEFT JOIN rest USING (table_name)"""


#: Keys and checks of two states.
STATES = {
    "old": "VALUES ('loan','fk_a','x','hall','no',' cascade',NULL), ('loan','fk_b','y','hall','no',NULL,NULL), ('desk','fk_c','z','hall','no','SET NULL',''), ('lamp','fk_d','z','desk','no','','')",
    "new": "VALUES ('loan','fk_a','x','hall','no','CASCADE ',''), ('loan','fk_b','y','hall','code',NULL,NULL), ('desk','fk_c','z','desk','no','set null',NULL), ('lamp','fk_e','z','desk','no','','')",
}
CHECK_STATES = {"old": "VALUES ('loan','ck_a',' x > 0 '), ('loan','ck_b','y > 0'), ('desk','ck_c','z > 0'), ('shelf','ck_d','w')", "new": "VALUES ('loan','ck_a','x > 0'), ('loan','ck_b','Y > 0'), ('shelf','ck_d','w '), ('hall','ck_e','v')"}
CHECK_FACTS = ["table_name", "check_name", "definition"]


def _key_changes(spark, sf_dir):
    old, new = (_cut(fixture(spark, sf_dir, STATES[k], FOREIGN_FACTS), columns="cols", ref_columns="refs").withColumn("ref_schema", F.lit(None).cast("string")) for k in ("old", "new"))
    return diff.object_changes(old, new, ("table_name", "fk_name"), diff.same_foreign_key())


def _check_changes(spark, sf_dir):
    return diff.object_changes(*(fixture(spark, sf_dir, CHECK_STATES[k], CHECK_FACTS) for k in ("old", "new")), ("table_name", "check_name"), diff.same_check())


def foreign_key_changes(spark, sf_dir):
    return _key_changes(spark, sf_dir)


def check_changes(spark, sf_dir):
    return _check_changes(spark, sf_dir)


def managed_changes(spark, sf_dir):
    """The tables that still differ if only references are managed, and how many objects of theirs do."""
    kind = lambda df, k: df.select("table_name", F.lit(k).alias("object_kind"))
    from larkspur.catalog_queries import snapshot_diff_columns

    every = kind(_key_changes(spark, sf_dir), "foreign key").unionAll(kind(_check_changes(spark, sf_dir), "check")).unionAll(kind(snapshot_diff_columns(spark, sf_dir), "column"))
    return diff.changed_tables(every, ["foreign key"])


def _changes_sql(old: str, new: str, name: str, same: str) -> str:
    return f"""SELECT table_name, {name}, unnest(['removed', 'added']) AS change FROM {old} o JOIN {new} n USING (table_name, {name}) WHERE NOT ({same})
UNION ALL SELECT table_name, {name}, 'removed' FROM {old} o ANTI JOIN {new} n USING (table_name, {name}) UNION ALL SELECT table_name, {name}, 'added' FROM {new} n ANTI JOIN {old} o USING (table_name, {name})"""


_KEYS_SQL = _changes_sql(
    _duck(STATES["old"], FOREIGN_FACTS), _duck(STATES["new"], FOREIGN_FACTS), "fk_name",
    "o.cols = n.cols AND o.ref_table = n.ref_table AND o.refs = n.refs AND lower(trim(coalesce(o.on_delete, ''))) = lower(trim(coalesce(n.on_delete, ''))) AND lower(trim(coalesce(o.on_update, ''))) = lower(trim(coalesce(n.on_update, '')))",
)
_CHECKS_SQL = _changes_sql(_duck(CHECK_STATES["old"], CHECK_FACTS), _duck(CHECK_STATES["new"], CHECK_FACTS), "check_name", "trim(o.definition) = trim(n.definition)")


def _log(spark, sf_dir):
    """The events table as what happens to runs: each user is a run."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), "event_type", "event_id")
    k = F.col("event_id") % 4
    made = state.created(e.where(k == 0).select("run_id", "at", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"), F.concat(F.lit('{"n":'), F.col("event_id").cast("string"), F.lit("}")).alias("config")))
    gone = state.completed(e.where(k == 3).select("run_id", "at", F.when(F.col("event_id") % 5 == 0, "failed").otherwise("success").alias("status"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("error")))
    return made.unionByName(state.entered(e.where(k.isin(1, 2)).select("run_id", "at", F.col("event_type").alias("phase")))).unionByName(gone)


def run_log(spark, sf_dir):
    """Each run as its events tell, of a log to which some events are added twice."""
    log = _log(spark, sf_dir)
    first = log.where("run_id % 2 = 0")
    return state.runs_of(first.dropDuplicates().unionByName(state.fresh(log.unionAll(first), first)))


def _runs_sql() -> str:
    arg = lambda c, when: f"arg_max(CASE WHEN {when} THEN {c} END, CASE WHEN {when} THEN (moment, rank, word) END) FILTER ({when})"
    return f"""WITH e AS (SELECT DISTINCT user_id AS run_id, ts AS moment, event_id % 4 AS k, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'apply' END END AS kind, CASE WHEN event_id % 4 = 0 THEN substr(sha256('{{"n":' || event_id || '}}'), 1, 16) END AS config_hash,
  CASE WHEN event_id % 4 IN (1, 2) THEN event_type END AS phase, CASE event_id % 4 WHEN 0 THEN 'running' WHEN 3 THEN CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'success' END END AS status, CASE WHEN event_id % 4 = 3 AND event_id % 5 = 0 THEN event_type END AS error FROM events),
r AS (SELECT *, CASE k WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END AS rank, coalesce(phase, status, '') AS word FROM e)
SELECT run_id, min(CASE WHEN k = 0 THEN moment END) AS started_at, {arg("kind", "k = 0")} AS kind, {arg("config_hash", "k = 0")} AS config_hash, {arg("phase", "k IN (1, 2)")} AS phase, coalesce({arg("status", "k IN (0, 3)")}, 'running') AS status,
  max(CASE WHEN k = 3 THEN moment END) AS completed_at, nullif({arg("coalesce(error, '')", "k = 3")}, '') AS error FROM r GROUP BY run_id"""


def declared_widths(spark, sf_dir):
    """Estimated bytes of a value of each declared type, and of a row of each database's columns."""
    t = fixture(spark, sf_dir, TYPES, TYPE_COLUMNS, own=True)
    return catalog.declared_row_bytes(t.select(F.concat_ws("_", F.lit("d"), "database").alias("table_name"), "data_type", "length", F.col("prec").alias("precision")))


_WIDTH = """CASE WHEN data_type IN ('numeric', 'decimal') THEN 16 + greatest(20, coalesce(prec, 0) + 2) WHEN data_type LIKE 'timestamp%' OR data_type LIKE 'datetime%' OR data_type IN ('date', 'time') THEN 24 WHEN data_type IN ('uuid', 'uniqueidentifier') THEN 52
 WHEN data_type IN ('bytea', 'longblob', 'varbinary', 'binary') THEN 24 + CASE WHEN length BETWEEN 1 AND 8000 THEN length ELSE 4096 END WHEN lower(data_type) IN ('text', 'mediumtext', 'json', 'jsonb', 'xml', 'varchar', 'nvarchar', 'char', 'nchar', 'character varying') THEN 16 + CASE WHEN length BETWEEN 1 AND 8000 THEN length ELSE 4096 END ELSE 8 END"""


def health(spark, sf_dir):
    """How many tables each database has, how many of them are empty, and their rows."""
    tables = fixture(spark, sf_dir, "VALUES ('loan'), ('hall'), ('desk')", ["table_name"], own=True)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.concat(F.lit("loan_"), F.col("l_suppkey")).alias("table_name")).agg(F.count("*").alias("row_count"))
    halls = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("hall_"), F.col("s_suppkey")).alias("table_name"), F.lit(0).cast("bigint").alias("row_count"))
    return catalog.health(tables.select("database", "table_name"), rows.unionAll(halls))


_HEALTH = f"""SELECT database, count(*) AS n_tables, count(*) FILTER (n = 0) AS n_empty, count(*) FILTER (n IS NULL) AS n_unknown, coalesce(sum(n), 0)::BIGINT AS row_count FROM (SELECT database, CASE WHEN starts_with(table_name, 'hall') THEN 0 ELSE l.n END AS n
FROM {_duck("VALUES ('loan'), ('hall'), ('desk')", ["table_name"], own=True)} t LEFT JOIN (SELECT 'loan_' || l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) l ON k = table_name) GROUP BY database"""


def key_records(spark, sf_dir):
    """The columns of each table's key, in its order."""
    columns = fixture(spark, sf_dir, COLUMNS, COLUMN_FACTS)
    keys = _cut(fixture(spark, sf_dir, KEYS, ["table_name", "cols"]), columns="cols")
    return catalog.key_columns(columns.select("table_name", "column_name", "ordinal", "data_type"), keys)


_RECORDS = f"""SELECT table_name, column_name, place, ordinal, data_type FROM (SELECT table_name, unnest(string_split(cols, ',')) AS column_name, (generate_subscripts(string_split(cols, ','), 1) - 1)::INT AS place FROM {_duck(KEYS, ["table_name", "cols"])})
JOIN {_duck(COLUMNS, COLUMN_FACTS)} USING (table_name, column_name)"""


def artifact_columns(spark, sf_dir):
    """Columns that were written as JSON and read back."""
    columns = fixture(spark, sf_dir, COLUMNS, COLUMN_FACTS)
    return catalog.from_artifact(catalog.artifact(columns), "ordinal int, column_name string, data_type string, max_length int, precision int, scale int, is_nullable boolean, default_expr string")


#: SQLite declarations by p_partkey % 8, and what each says: kind, length, precision, scale, fractional digits.
LITE = [
    ("'VARCHAR(' || p_size || ')'", "varchar", "p_size", "NULL", "NULL", "NULL"), ("'decimal( ' || p_size || ' , 2)'", "decimal", "NULL", "p_size", "2", "NULL"), ("'FLOATING POINT'", "bigint", "NULL", "NULL", "NULL", "NULL"), ("'DATETIME(' || (p_size % 7) || ')'", "timestamp", "NULL", "NULL", "NULL", "p_size % 7"),
    ("'native character(' || p_size || ')'", "text", "p_size", "NULL", "NULL", "NULL"), ("'UNSIGNED BIG INT'", "bigint", "NULL", "NULL", "NULL", "NULL"), ("'real(' || p_size || ',1)'", "double", "NULL", "p_size", "1", "NULL"), ("p_brand", "raw", "NULL", "NULL", "NULL", "NULL"),
]


def _lite(i: int) -> str:
    return "CASE p_partkey % 8 " + " ".join(f"WHEN {n} THEN {(chr(39) + r[1] + chr(39)) if i == 1 else r[i]}" for n, r in enumerate(LITE)) + " END"


def sqlite_facts(spark, sf_dir):
    """Kind and sizes of each part's SQLite declaration."""
    k = F.col("k")
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(_lite(0)).alias("declaration")).withColumn("k", kinds.sqlite_declared(F.col("declaration")))
    return t.select("p_partkey", "declaration", *[k[c].alias(c) for c in ("kind", "length", "precision", "scale", "fsp", "unsigned")])


def queries():
    return {f.__name__: f for f in (live_tables, foreign_key_changes, check_changes, managed_changes, run_log, declared_widths, health, key_records, artifact_columns, sqlite_facts)}


def oracle_sql() -> dict[str, str]:
    from larkspur.catalog_sql import _CHANGES

    return {
        "live_tables": _live_sql(),
        "foreign_key_changes": _KEYS_SQL,
        "check_changes": _CHECKS_SQL,
        "managed_changes": f"SELECT table_name, count(*) FILTER (k = 'c') AS columns, 0::BIGINT AS indexes, count(*) FILTER (k = 'f') AS foreign_keys, 0::BIGINT AS checks FROM (SELECT table_name, 'f' AS k FROM ({_KEYS_SQL}) UNION ALL SELECT table_name, 'c' FROM {_CHANGES}) GROUP BY table_name",
        "run_log": _runs_sql(),
        "declared_widths": f"SELECT 'd_' || database AS table_name, count(*) AS n_columns, (24 + sum(16 + {_WIDTH}))::BIGINT AS row_bytes FROM {_duck(TYPES, TYPE_COLUMNS, own=True)} GROUP BY database",
        "health": _HEALTH,
        "key_records": _RECORDS,
        "artifact_columns": f"SELECT * FROM {_duck(COLUMNS, COLUMN_FACTS)}",
        "sqlite_facts": f"SELECT p_partkey, {_lite(0)} AS declaration, {_lite(1)} AS kind, {_lite(2)} AS length, {_lite(3)} AS precision, {_lite(4)} AS scale, {_lite(5)} AS fsp, p_partkey % 8 = 5 AS unsigned FROM part",
    }
