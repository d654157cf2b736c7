"""The registered queries of the schema engine, each with its DuckDB counterpart.

They read the given tables, or the estate of databases that the suppliers keep (``estate``),
whose templates are ``VALUES`` lists that both engines read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import estate
from larkspur.functions import fragments, identifiers, texts, types
from larkspur.operators import diff, drift, scope, state
from larkspur.plans import ddl, ordering
from larkspur.sources import catalog

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
REFERENCES = [("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier"), ("labels", "documents")]

#: dialect, declared type, length, precision, scale, fractional digits, unsigned
TYPES = """VALUES
('postgres','integer',NULL,NULL,NULL,NULL,false), ('postgres','bigint',NULL,NULL,NULL,NULL,false), ('postgres','smallint',NULL,NULL,NULL,NULL,false),
('postgres','character varying',80,NULL,NULL,NULL,false), ('postgres','text',NULL,NULL,NULL,NULL,false), ('postgres','numeric',NULL,12,2,NULL,false),
('postgres','numeric',NULL,NULL,NULL,NULL,false), ('postgres','timestamp with time zone',NULL,NULL,NULL,6,false), ('postgres','timestamp without time zone',NULL,NULL,NULL,3,false),
('postgres','boolean',NULL,NULL,NULL,NULL,false), ('postgres','uuid',NULL,NULL,NULL,NULL,false), ('postgres','jsonb',NULL,NULL,NULL,NULL,false), ('postgres','bytea',NULL,NULL,NULL,NULL,false),
('postgres','double precision',NULL,NULL,NULL,NULL,false), ('postgres','date',NULL,NULL,NULL,NULL,false), ('postgres','bit',8,NULL,NULL,NULL,false), ('postgres','xml',NULL,NULL,NULL,NULL,false),
('mssql','nvarchar',4000,NULL,NULL,NULL,false), ('mssql','nvarchar',-1,NULL,NULL,NULL,false), ('mssql','nvarchar',6000,NULL,NULL,NULL,false), ('mssql','varchar',8001,NULL,NULL,NULL,false),
('mssql','datetime2',NULL,NULL,NULL,7,false), ('mssql','datetimeoffset',NULL,NULL,NULL,0,false), ('mssql','uniqueidentifier',NULL,NULL,NULL,NULL,false), ('mssql','bit',NULL,NULL,NULL,NULL,false),
('mssql','money',NULL,19,4,NULL,false), ('mssql','timestamp',NULL,NULL,NULL,NULL,false), ('mssql','nchar',10,NULL,NULL,NULL,false), ('mssql','varbinary',-1,NULL,NULL,NULL,false), ('mssql','binary',300,NULL,NULL,NULL,false),
('mysql','int unsigned',NULL,NULL,NULL,NULL,true), ('mysql','bigint',NULL,NULL,NULL,NULL,true), ('mysql','tinyint(1)',NULL,NULL,NULL,NULL,false), ('mysql','mediumtext',16777215,NULL,NULL,NULL,false),
('mysql','decimal',NULL,65,30,NULL,false), ('mysql','datetime',NULL,NULL,NULL,0,false), ('mysql','time',NULL,NULL,NULL,NULL,false), ('mysql','bit',1,NULL,NULL,NULL,false), ('mysql','bit',12,NULL,NULL,NULL,false),
('mysql','json',NULL,NULL,NULL,NULL,false), ('mysql','longblob',4294967295,NULL,NULL,NULL,false), ('mysql','float',NULL,NULL,NULL,NULL,false), ('mysql','char',300,NULL,NULL,NULL,false),
('sqlite','INTEGER',NULL,NULL,NULL,NULL,false), ('sqlite','REAL',NULL,NULL,NULL,NULL,false), ('sqlite','TEXT',NULL,NULL,NULL,NULL,false)"""
TYPE_COLUMNS = ["dialect", "data_type", "length", "prec", "scale", "fsp", "unsigned"]

SNAPSHOTS = {
    "old": """VALUES ('reader','no','bigint',0,false,false,'',1), ('reader','card','varchar',12,false,false,'',2), ('reader','barred','bit',0,false,true,'((1))',3), ('reader','pager','varchar',15,true,false,'',4),
('loan','no','bigint',0,false,false,'',1), ('loan','remark','text',0,true,true,' x ',2), ('Shelf','no','int',0,false,false,'',1)""",
    "new": """VALUES ('reader','no','bigint',0,false,false,'',9), ('reader','card','varchar',16,false,false,'',2), ('reader','barred','bit',0,false,true,'((0))',3), ('reader','pen_name','varchar',90,true,false,'',4),
('fine','no','bigint',0,false,false,'',1), ('loan','no','bigint',0,false,false,'',1), ('loan','remark','text',0,true,true,'x',2), ('shelf','no','int',0,false,false,'',1)""",
}
SNAPSHOT_COLUMNS = ["table_name", "column_name", "data_type", "max_length", "is_nullable", "has_default", "default_expr", "ordinal"]

STATEMENTS = """VALUES ('drop table','loan','','loan','data-loss','drop loan','DROP TABLE loan'), ('create table','fine','','fine','safe','create fine','CREATE TABLE fine (id int)'),
('change table','reader','drop column','pager','data-loss','drop pager','ALTER TABLE reader DROP COLUMN pager'), ('change table','reader','add column','pen','safe','add pen','ALTER TABLE reader ADD pen text'),
('change table','reader','change column','card','rebuild','widen card','ALTER TABLE reader ALTER card TYPE text'), ('add foreign key','fine','','fk','blocking','key','ALTER TABLE fine ADD FOREIGN KEY (id) REFERENCES reader(id)'),
('drop foreign key','loan','','fk','safe','key','ALTER TABLE loan DROP CONSTRAINT fk'), ('create index','fine','','ix','odd','index','CREATE INDEX ix ON fine (id)')"""
STATEMENT_COLUMNS = ["phase", "table_name", "step", "object_name", "risk", "description", "sql"]
DEFAULTS = ["getdate()", "(GETUTCDATE())", "CURRENT_TIMESTAMP", "now()", "((0))", "1", "'x'", "N'it''s'", "('A')::text", "newid()", "gen_random_uuid()", "CAST(getdate() AS date)", "curdate()", "NULL", "", "nextval('s')", "-5", "lower('A')", "pending"]


def fixture(spark: SparkSession, sf_dir: str, values: str, columns: list[str], **how) -> DataFrame:
    """The estate's rows of a template."""
    return estate.rows(spark, sf_dir, spark.sql(f"SELECT * FROM ({values}) AS t({', '.join(f'`{c}`' for c in columns)})"), **how)


_duck = estate.relation


def introspect_columns(spark, sf_dir):
    return catalog.parquet_columns(spark, sf_dir, TABLES).select("table_name", "ordinal", "column_name", "data_type")


def row_count_exact(spark, sf_dir):
    return catalog.row_counts(spark, sf_dir, TABLES)


def row_size_estimate(spark, sf_dir):
    return catalog.sizes(catalog.parquet_columns(spark, sf_dir, TABLES), catalog.row_counts(spark, sf_dir, TABLES)).select("table_name", F.col("row_bytes").cast("bigint").alias("row_bytes"), "n_columns", "row_count", F.col("table_bytes").cast("bigint").alias("table_bytes"))


def row_size_average(spark, sf_dir):
    return catalog.weighted_row_bytes(row_size_estimate(spark, sf_dir))


def _typed(spark, sf_dir) -> DataFrame:
    t = fixture(spark, sf_dir, TYPES, TYPE_COLUMNS)
    return t.withColumns({"kind": types.kind(F.col("data_type"), F.col("dialect"), F.col("length")), "tz": types.zoned(F.col("data_type")), "national": types.national(F.col("data_type"))})


def canonical_kinds(spark, sf_dir):
    return _typed(spark, sf_dir).select("dialect", "data_type", "length", "kind")


def _rendered(t: DataFrame, target: str):
    return types.render(target, *[F.col(c) for c in ("kind", "length", "prec", "scale", "unsigned", "tz", "national", "fsp")])


def _map_to(target: str):
    def query(spark, sf_dir):
        t = _typed(spark, sf_dir)
        return t.select("dialect", "data_type", "length", "prec", "scale", "fsp", _rendered(t, target).alias("type_text"))

    return query


def map_types(spark, sf_dir):
    """Every column of every table with its type on each target."""
    return _mapped(spark, sf_dir).drop("ordinal")


def _mapped(spark, sf_dir) -> DataFrame:
    none, no = F.lit(None).cast("int"), F.lit(False)
    c = catalog.parquet_columns(spark, sf_dir, TABLES)
    inner = F.regexp_extract("data_type", r"^array<(.*)>$", 1)
    c = c.withColumns({"kind": types.kind(F.col("data_type"), F.lit("spark"), none), "element_kind": types.kind(inner, F.lit("spark"), none)})
    rest = (none, none, none, no, no, no, none)
    out = [types.render(t, F.col("kind"), *rest, types.render(t, F.col("element_kind"), *rest)).alias(t) for t in types.TARGETS]
    return c.select("table_name", "ordinal", "column_name", "kind", *out)


def ident_fold(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey"), F.concat("p_name", F.lit(" #"), "p_brand").alias("name"))
    return parts.select("p_partkey", identifiers.folded(F.col("name")).alias("folded"), identifiers.valid(F.col("name")).alias("valid"))


def ident_collisions(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.array(F.col("p_brand"), F.lower("p_brand"), F.replace("p_brand", F.lit("#"), F.lit("_")))).alias("name"))
    return identifiers.collisions(parts, [], "name")


def scope_filter(spark, sf_dir):
    tables = catalog.parquet_columns(spark, sf_dir, TABLES).select("table_name").distinct()
    return scope.in_scope(tables, ["[c-n]*", "P*"], ["*s", "nat?on"])


#: Tables that are live, in the source, and managed by us.
SIDES = "VALUES " + ", ".join(f"('{side}', '{t}')" for side, ts in (("live", "loan book shelf hall attic"), ("source", "loan book shelf desk"), ("mine", "loan shelf")) for t in ts.split())
SIDE_COLUMNS = ["side", "table_name"]
BACKFILL = {
    "old": "VALUES (1,'t','a',false,0,NULL), (2,'t','b',false,0,NULL), (3,'t','c',false,0,2), (4,'t','d',false,0,3), (1,'t','gone',false,0,NULL)",
    "now": "VALUES (0,'t','a',true,1,6), (0,'t','b',true,1,6), (0,'t','c',true,1,6), (0,'t','d',true,1,6)",
}
BACKFILL_COLUMNS = ["version", "table_name", "column_name", "is_unsigned", "display_width", "datetime_precision"]


def managed_set(spark, sf_dir):
    every = fixture(spark, sf_dir, SIDES, SIDE_COLUMNS)
    live, source, mine = (every.where(F.col("side") == x).select("table_name") for x in ("live", "source", "mine"))
    return scope.managed(live, source, mine)


def _snapshots(spark, sf_dir):
    return (fixture(spark, sf_dir, SNAPSHOTS[k], SNAPSHOT_COLUMNS).drop("ordinal") for k in ("old", "new"))


def snapshot_diff_columns(spark, sf_dir):
    return diff.column_changes(*_snapshots(spark, sf_dir))


def snapshot_diff_tables(spark, sf_dir):
    return diff.table_changes(*_snapshots(spark, sf_dir))


def snapshot_diff_summary(spark, sf_dir):
    return diff.summary(diff.column_changes(*_snapshots(spark, sf_dir)))


def snapshot_backfill(spark, sf_dir):
    old, now = (fixture(spark, sf_dir, BACKFILL[k], BACKFILL_COLUMNS).withColumn("datetime_precision", F.col("datetime_precision").cast("int")) for k in ("old", "now"))
    return diff.backfilled(old, now.drop("version"))


KEY_PAIRS = "VALUES (1,'a,b','B,a'), (2,'a','a,b'), (3,'id','ID')"


def pk_set_compare(spark, sf_dir):
    t = fixture(spark, sf_dir, KEY_PAIRS, ["n", "one", "two"], ids=("n",))
    return t.select("n", drift.same_key_set(F.split("one", ","), F.split("two", ",")).alias("same_set"), (F.split("one", ",") == F.split("two", ",")).alias("same_order"))


def drop_order(spark, sf_dir):
    columns = catalog.parquet_columns(spark, sf_dir, TABLES)
    refs = [(r.table_name, r.ref_table) for r in catalog.references(columns).select("table_name", "ref_table").distinct().collect()]  # of a schema's tables
    return spark.createDataFrame(ordering.drop_levels([r.table_name for r in columns.select("table_name").distinct().collect()], refs), "table_name string, level int")


def name_references(spark, sf_dir):
    return catalog.references(catalog.parquet_columns(spark, sf_dir, TABLES))


def _statements(spark, sf_dir):
    return fixture(spark, sf_dir, STATEMENTS, STATEMENT_COLUMNS, own=True)


def risk_filter(spark, sf_dir):
    return scope.at_most(_statements(spark, sf_dir), "blocking").select("phase", "object_name", "risk")


def risk_counts(spark, sf_dir):
    return scope.risk_counts(_statements(spark, sf_dir))


def plan_order(spark, sf_dir):
    placed = ordering.ordered(_statements(spark, sf_dir))
    return placed.select("phase", "table_name", "step", "object_name", "phase_no", "step_no")


def plan_script(spark, sf_dir):
    """A script for each database."""
    return ordering.script(_statements(spark, sf_dir), by="database")


def _events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("source_type"), F.when(F.col("user_id") % 3 == 0, "").otherwise(F.col("user_id").cast("string")).alias("source_identity"), F.col("ts").alias("captured_at"))


def latest_snapshot(spark, sf_dir):
    return state.latest_snapshot(_events(spark, sf_dir), "click", "7").select("id", "source_identity", "captured_at")


def list_snapshots(spark, sf_dir):
    return state.list_snapshots(_events(spark, sf_dir)).select("id", "captured_at")


def _runs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "running").otherwise("success").alias("status"), F.when(F.col("event_id") % 5 == 0, "boom").alias("error"))


def current_runs(spark, sf_dir):
    return state.current_runs(_runs(spark, sf_dir))


def recent_runs(spark, sf_dir):
    return state.recent_runs(current_runs(spark, sf_dir)).select("run_id", "at")


def reconcile_runs(spark, sf_dir):
    return state.reconciled(current_runs(spark, sf_dir), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("run_id", "status", "error")


def schema_fingerprint(spark, sf_dir):
    c = introspect_columns(spark, sf_dir)
    line = F.concat_ws("|", "table_name", F.col("ordinal").cast("string"), "column_name", "data_type")
    return c.groupBy("table_name").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("fingerprint"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DEFAULT_ROWS = "VALUES " + ", ".join(f"('loan', {quoted(d)})" for d in DEFAULTS)


def default_labels(spark, sf_dir):
    """The label of each column's default; each distinct text is parsed once."""
    t = fixture(spark, sf_dir, DEFAULT_ROWS, ["table_name", "fragment"])
    return texts.applied(t, "fragment", "label", fragments.label).select("table_name", "fragment", "label")


CHECKS = {
    "priority": ("orders", "[o_orderpriority] LIKE '[1-3]-%'"),
    "status": ("orders", "(\"o_orderstatus\")::text = ANY (ARRAY['F'::text, 'O'::text])"),
    "price": ("orders", "`o_totalprice` BETWEEN 1000 AND 200000"),
    "quantity": ("lineitem", "l_quantity > 5 AND NOT (l_discount >= 0.05 OR l_tax IN (0.01, 0.02))"),
    "name": ("customer", "c_name ~ '^Customer#0+[1-9]'"),
    "sum": ("lineitem", "[l_extendedprice] * (1 - [l_discount]) - l_tax <> 0 AND l_returnflag IS NOT NULL"),
}


def check_violations(spark, sf_dir):
    """Rows that violate each check, translated to Spark (a null result doesn't violate)."""
    out = None
    for name, (table, check) in sorted(CHECKS.items()):
        bad = F.expr(f"NOT ({fragments.render(fragments.parse(check), 'spark')})")
        one = spark.read.parquet(f"{sf_dir}/{table}.parquet").agg(F.count_if(bad).alias("violations")).select(F.lit(name).alias("name"), "violations")
        out = one if out is None else out.unionAll(one)
    return out


def create_table_ddl(spark, sf_dir):
    """CREATE TABLE of every table on every dialect; the first column is the key."""
    out = None
    mapped = _mapped(spark, sf_dir)
    for t in types.TARGETS:
        key = F.when(F.col("ordinal") == 1, 1)
        c = mapped.select("table_name", "column_name", "ordinal", key.alias("key_position"), ddl.column_definition(F.col("column_name"), F.col(t), F.col("ordinal") > 1, F.lit(None).cast("string"), t).alias("definition"))
        one = ddl.create_tables(c, t).select(F.lit(t).alias("target"), "table_name", "sql")
        out = one if out is None else out.unionAll(one)
    return out


def foreign_key_ddl(spark, sf_dir):
    """ADD CONSTRAINT of every reference that names tell of."""
    t = name_references(spark, sf_dir).select(
        F.concat_ws("_", F.lit("fk"), "table_name", "ref_table").alias("constraint_name"), "table_name", F.array("column_name").alias("columns"), "ref_table", F.array("ref_column").alias("ref_columns"),
        F.when(F.col("table_name") == "lineitem", "CASCADE").alias("on_delete"), F.lit(None).cast("string").alias("on_update"),
    )
    out = [t.select(F.lit(d).alias("target"), ddl.add_constraint("foreign_key", d, "app").alias("sql")) for d in ("postgres", "mssql", "mysql")]
    return out[0].unionAll(out[1]).unionAll(out[2])


NEW_DEFAULTS = "VALUES " + ", ".join(f"({', '.join(map(quoted, r))})" for r in (("reader", "barred", "((1))"), ("lo'an", "at", "getdate()"), ("shelf", "code", "'x'")))


def alter_default_ddl(spark, sf_dir):
    """The statements that set each default and those that drop it."""
    out, every = None, fixture(spark, sf_dir, NEW_DEFAULTS, ["table_name", "column_name", "fragment"])
    for d in ("postgres", "mssql", "mysql"):
        t = texts.applied(every, "fragment", "default", partial(rendered_default, target=d))
        put = t.select(F.lit(d).alias("target"), F.lit("set").alias("action"), "table_name", F.posexplode(ddl.set_default(d, "app")).alias("place", "sql"))
        one = put.unionAll(t.select(F.lit(d), F.lit("drop"), "table_name", F.lit(0), ddl.drop_default(d, "app")))
        out = one if out is None else out.unionAll(one)
    return out


def rendered_default(text: str, target: str) -> str:
    return fragments.render(fragments.parse_default(text), target)


#: What the objects of a database need of a dialect.
NEEDS = "VALUES " + ", ".join(f"('loan', '{c}')" for c in sorted({c for cs in ddl.CAPABILITIES.values() for c in cs.split()}))


def capabilities(spark, sf_dir):
    """What the objects of each database need that a dialect lacks."""
    rows = [(d, c) for d, cs in ddl.CAPABILITIES.items() for c in cs.split()]
    have = F.broadcast(spark.createDataFrame(rows, "target string, capability string"))  # of all dialects: some eighty
    needs = fixture(spark, sf_dir, NEEDS, ["table_name", "capability"])
    wanted = needs.select("table_name", "capability", F.explode(F.array(*map(F.lit, ddl.CAPABILITIES))).alias("target"))
    return wanted.join(have, ["target", "capability"], "left_anti")


_PLAIN = [
    introspect_columns, row_count_exact, row_size_estimate, row_size_average, canonical_kinds, map_types, ident_fold, ident_collisions, scope_filter, managed_set, snapshot_diff_columns, snapshot_diff_tables,
    snapshot_diff_summary, snapshot_backfill, pk_set_compare, drop_order, name_references, risk_filter, risk_counts, plan_order, plan_script, latest_snapshot, list_snapshots,
    current_runs, recent_runs, reconcile_runs, schema_fingerprint, default_labels, check_violations, create_table_ddl, foreign_key_ddl, alter_default_ddl, capabilities,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from larkspur import catalog_more_queries, definition_queries, drift_queries, expression_queries, nested_queries, plan_queries, reader_queries, verify_queries

    return {f.__name__: f for f in _PLAIN} | {f"map_to_{t}": _map_to(t) for t in types.TARGETS} | drift_queries.queries() | reader_queries.queries() | plan_queries.queries() | nested_queries.queries() | definition_queries.queries() | verify_queries.queries() | expression_queries.queries() | catalog_more_queries.queries()


def oracle_sql() -> dict[str, str]:
    from larkspur import catalog_more_queries, catalog_sql, definition_queries, drift_queries, expression_queries, nested_queries, plan_queries, reader_queries, verify_queries

    return catalog_sql.oracle_sql() | drift_queries.oracle_sql() | reader_queries.oracle_sql() | plan_queries.oracle_sql() | nested_queries.oracle_sql() | definition_queries.oracle_sql() | verify_queries.oracle_sql() | expression_queries.oracle_sql() | catalog_more_queries.oracle_sql()
