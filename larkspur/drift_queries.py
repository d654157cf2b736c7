"""Queries of drift and live differences over the schemas of an estate of lending libraries, with DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import estate
from larkspur.operators import diff, drift
from larkspur.plans import ddl

COLUMNS = "table_name, column_name, data_type, max_length, precision, scale, fsp, is_nullable, is_computed, computed_persisted, is_identity, default_class, on_update, enum_values, srid, display_width".split(", ")


def _row(table: str, column: str, data_type: str, length: int = 0, **facts: object) -> tuple:
    plain = dict(precision=0, scale=0, fsp=None, is_nullable=True, is_computed=False, computed_persisted=False, is_identity=False, default_class="", on_update="", enum_values="", srid=0, display_width=0)
    return (table, column, data_type, length, *(plain | facts).values())


#: Desired and live columns, by the dialects of the two sides.
LIVE = {
    "mssql_postgres": (
        [
            _row("Loan", "No", "bigint", is_nullable=False, is_identity=True), _row("Loan", "Code", "nvarchar", 20, is_nullable=False), _row("Loan", "Ref", "uniqueidentifier", default_class="uuid_gen"),
            _row("Loan", "At", "datetimeoffset", fsp=7, default_class="current_dt"), _row("Loan", "Fee", "decimal", precision=12, scale=2), _row("Loan", "Days", "int", is_computed=True), _row("Loan", "Gone", "int"),
            _row("Loan", "Scan", "binary", 16), _row("Loan", "Kind", "int"), _row("Loan", "Stamp", "timestamp"), _row("Loan", "Place", "nvarchar", -1, srid=4326), _row("Hall", "No", "int"),
        ],
        [
            _row("LOAN", "no", "bigint", is_nullable=False), _row("LOAN", "code", "character varying", 40), _row("LOAN", "ref", "uuid", 36, default_class="uuid_gen"),
            _row("LOAN", "at", "timestamp", fsp=6, default_class="constant'x'"), _row("LOAN", "fee", "numeric", precision=12, scale=4), _row("LOAN", "days", "int", is_nullable=False), _row("LOAN", "more", "int"),
            _row("LOAN", "scan", "bytea"), _row("LOAN", "kind", "text"), _row("LOAN", "stamp", "bytea"), _row("LOAN", "place", "text"), _row("attic", "no", "int"),
        ],
    ),
    "mysql_mysql": (
        [_row("book", "a", "longtext"), _row("book", "b", "text", 65535), _row("book", "c", "enum", 7, enum_values="x,y"), _row("book", "d", "timestamp", fsp=0, on_update="NOW()"), _row("book", "e", "blob"), _row("book", "f", "int", is_computed=True, computed_persisted=True), _row("book", "g", "int", display_width=4)],
        [_row("book", "a", "text"), _row("book", "b", "text"), _row("book", "c", "enum"), _row("book", "d", "timestamp", fsp=0), _row("book", "e", "text"), _row("book", "f", "int", is_computed=True), _row("book", "g", "int", display_width=11)],
    ),
    "mssql_mysql": (
        [_row("shelf", "a", "nvarchar", 20000), _row("shelf", "b", "datetimeoffset", fsp=6), _row("shelf", "c", "datetimeoffset", fsp=0), _row("shelf", "d", "datetime2", fsp=3), _row("shelf", "e", "nvarchar", 20000)],
        [_row("shelf", "a", "mediumtext"), _row("shelf", "b", "datetime", fsp=6), _row("shelf", "c", "timestamp", fsp=0, on_update="NOW()"), _row("shelf", "d", "datetime", fsp=0), _row("shelf", "e", "text")],
    ),
}

#: index, table, parts, unique, included columns, filtered, flags of expressions, prefix lengths (lists separated by semicolons)
INDEX_COLUMNS = ["index_name", "table_name", "cols", "is_unique", "inc", "filtered", "exprs", "prefixes"]
INDEXES = [
    ("a", "reader", "Email", True, "Name;Age", True, "", ""), ("b", "reader", "Hall_No;Email", False, "", False, "", "0;20"), ("c", "loan", "State", False, "", True, "", ""),
    ("d", "loan", " Lower(X) ;No", True, "", False, "true;false", ""), ("e", "loan", "no", False, "b;A", False, "", ""), ("f", "loan", "no", False, "", False, "", "0"),
]
LIVE_INDEXES = [
    ("a", "READER", "email", True, "age;name", True, "", ""), ("y", "reader", "email;hall_no", False, "", False, "", ""), ("c", "loan", "state", False, "", True, "", ""),
    ("d", "loan", "Lower(X);no", True, "", False, "true;false", ""), ("w", "loan", "NO", False, "B;a", False, "", ""), ("f", "loan", "no", False, "", False, "false", ""),
]
CHECKS = ([("loan", "days > 0"), ("loan", "fee >= 0"), ("Book", "no  >  0"), ("hall", "x = 1"), ("shelf", "a = 1")], [("LOAN", "fee >= 0"), ("book", "NO > 0"), ("hall", "x = 2"), ("attic", "y = 1"), ("shelf", "a = 1"), ("shelf", "b = 1")])
KEY_COLUMNS = ["cols", "refs", "ref_table", "on_delete", "on_update", "ref_schema", "own_schema"]
KEYS = [("a,B", "x,Y", "Shelf", "CASCADE", "", "lib", "LIB"), ("a", "x", "t", "no  action", "RESTRICT", "", "lib"), ("b", "y", "t", " set   null ", None, " Old ", "lib"), ("c", "z", "T", None, "Set Default", None, "lib")]


def _literal(x: object, spark: bool) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "\\'" if spark else "''") + "'"
    return str(x).lower()


def listed(rows: list[tuple], spark: bool = False) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(_literal(x, spark) for x in r) + ")" for r in rows)


def values(rows: list[tuple], columns: list[str]) -> str:
    """The rows themselves as a DuckDB relation."""
    return f"(SELECT * FROM ({listed(rows)}) AS t({', '.join(columns)}))"


#: Objects have names of their own in each database.
OBJECTS = {"names": ("table_name", "index_name", "ref_table")}


def spread(rows: list[tuple], columns: list[str]) -> str:
    """The estate's rows of a template as a DuckDB relation."""
    return estate.relation(listed(rows), columns, **OBJECTS)


def fixture(spark: SparkSession, sf_dir: str, rows: list[tuple], columns: list[str]) -> DataFrame:
    template = spark.sql(f"SELECT * FROM ({listed(rows, True)}) AS t({', '.join(columns)})")
    return estate.rows(spark, sf_dir, template, **OBJECTS)


def _sides(spark: SparkSession, sf_dir: str, pair: str) -> list[DataFrame]:
    out = [fixture(spark, sf_dir, rows, COLUMNS) for rows in LIVE[pair]]
    return [x.withColumn("fsp", F.col("fsp").cast("int")) for x in out]


def _over(make: Callable[..., DataFrame], pair: str):
    def query(spark, sf_dir):
        return make(*_sides(spark, sf_dir, pair), *pair.split("_"))

    return query


def drift_tables(spark, sf_dir):
    return drift.table_matches(*_sides(spark, sf_dir, "mssql_postgres"))


def check_reconciliation(spark, sf_dir):
    return drift.check_reconciliation(*(fixture(spark, sf_dir, c, ["table_name", "definition"]) for c in CHECKS), True)


def check_counts(spark, sf_dir):
    return drift.check_reconciliation(*(fixture(spark, sf_dir, c, ["table_name", "definition"]) for c in CHECKS), False)


def _list(column: str, kind: str = "string") -> Column:
    return F.transform(F.filter(F.split(column, ";"), lambda x: x != ""), lambda x: x.cast(kind))


def _indexes(spark: SparkSession, sf_dir: str, rows: list[tuple]) -> DataFrame:
    t = fixture(spark, sf_dir, rows, INDEX_COLUMNS)
    return t.select("index_name", "table_name", F.split("cols", ";").alias("columns"), "is_unique", _list("inc").alias("include_cols"), F.when(F.col("filtered"), "x > 0").alias("filter"), _list("exprs", "boolean").alias("exprs"), _list("prefixes", "int").alias("prefixes"))


def _signed(spark, sf_dir, rows):
    signature = drift.index_signature(F.col("columns"), F.col("is_unique"), F.col("include_cols"), F.col("filter").isNotNull(), F.col("exprs"), F.col("prefixes"))
    return _indexes(spark, sf_dir, rows).select(F.lower("table_name").alias("table_name"), signature.alias("signature"))


def index_changes(spark, sf_dir):
    return diff.object_changes(_indexes(spark, sf_dir, INDEXES), _indexes(spark, sf_dir, LIVE_INDEXES), ("index_name",), diff.same_index())


def index_signatures(spark, sf_dir):
    return _signed(spark, sf_dir, INDEXES)


def signature_diff(spark, sf_dir):
    return drift.signature_changes(_signed(spark, sf_dir, INDEXES), _signed(spark, sf_dir, LIVE_INDEXES), ["table_name", "signature"])


def key_signatures(spark, sf_dir):
    t = fixture(spark, sf_dir, KEYS, KEY_COLUMNS)
    return t.select(drift.key_signature(F.split("cols", ","), F.split("refs", ","), *[F.col(c) for c in KEY_COLUMNS[2:]]).alias("signature"))


def index_ddl(spark, sf_dir):
    t = _indexes(spark, sf_dir, INDEXES)
    # dialects without expression parts or prefixes get the other indexes
    plain = t.where((F.size("exprs") == 0) & (F.size("prefixes") == 0))
    no_prefix = t.where(F.size("prefixes") == 0)
    some = {"postgres": no_prefix, "mssql": plain, "mysql": t, "sqlite": plain}
    out = [d.select(F.lit(name).alias("target"), ddl.create_index(name, "app").alias("sql")) for name, d in some.items()]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [drift_tables, check_reconciliation, check_counts, index_changes, index_signatures, signature_diff, key_signatures, index_ddl]
    return {f.__name__: f for f in plain} | {f"drift_{p}": _over(drift.column_deltas, p) for p in LIVE} | {f"live_diff_{p}": _over(drift.live_changes, p) for p in LIVE}


#: What each pair of columns differs in, by the rules, as read by a person: column, criteria.
DELTAS = {
    "mssql_postgres": [("no", "identity"), ("code", "nullability,max_length"), ("at", "tz_class,default"), ("fee", "scale"), ("days", "computed"), ("kind", "type")],
    "mysql_mysql": [("a", "max_length"), ("c", "enum_values"), ("d", "on_update"), ("e", "type"), ("f", "computed_storage")],
    "mssql_mysql": [("b", "tz_class"), ("c", "on_update"), ("d", "type"), ("e", "max_length")],
}
#: What only a live difference adds to them.
MORE = {"mssql_postgres": {"place": "srid"}, "mysql_mysql": {"g": "display_width"}, "mssql_mysql": {}}


def _deltas(pair: str) -> str:
    """Missing and extra columns are joined; the criteria are those of DELTAS, each checked to belong to a pair."""
    s, t = (spread(rows, COLUMNS) for rows in LIVE[pair])
    known = values(DELTAS[pair], ["c", "criteria"])
    return f"""WITH s AS (SELECT lower(table_name) AS t, lower(column_name) AS c FROM {s}), g AS (SELECT lower(table_name) AS t, lower(column_name) AS c FROM {t})
SELECT t AS table_name, c AS column_name, unnest(string_split(criteria, ',')) AS criterion FROM s JOIN g USING (t, c) JOIN {known} k USING (c)
UNION ALL SELECT t, c, 'missing' FROM s ANTI JOIN g USING (t, c) UNION ALL SELECT t, c, 'extra' FROM g ANTI JOIN s USING (t, c)"""


def _live(pair: str) -> str:
    every = {c: k for c, k in DELTAS[pair]}
    for c, k in MORE[pair].items():
        every[c] = f"{every[c]},{k}" if c in every else k
    rows = [(c, k, "; ".join(sorted({drift.REFUSALS[x] for x in k.split(",") if x in drift.REFUSALS}))) for c, k in every.items()]
    s, t = (spread(rows_, COLUMNS) for rows_ in LIVE[pair])
    return f"""WITH s AS (SELECT lower(table_name) AS t, lower(column_name) AS c FROM {s}), g AS (SELECT lower(table_name) AS t, lower(column_name) AS c FROM {t})
SELECT t AS table_name, c AS column_name, CASE WHEN reason = '' THEN 'change' ELSE 'refuse' END AS change, criteria, reason FROM s JOIN g USING (t, c) JOIN {values(rows, ["c", "criteria", "reason"])} k USING (c)
UNION ALL SELECT t, c, 'add', '', '' FROM s ANTI JOIN g USING (t, c) WHERE t IN (SELECT t FROM g) UNION ALL SELECT t, c, 'remove', '', '' FROM g ANTI JOIN s USING (t, c) WHERE t IN (SELECT t FROM s)"""


def _signatures(rows: list[tuple]) -> str:
    return f"""(WITH i AS (SELECT *, row_number() OVER () AS n FROM {spread(rows, INDEX_COLUMNS)}),
p AS (SELECT n, unnest(string_split(cols, ';')) AS part, unnest(range(1, len(string_split(cols, ';')) + 1)) AS place, string_split(exprs, ';') AS e, string_split(prefixes, ';') AS l FROM i),
k AS (SELECT n, string_agg(CASE WHEN e[place] = 'true' THEN 'expr:' || trim(part) ELSE lower(part) || CASE WHEN coalesce(try_cast(l[place] AS INT), 0) > 0 THEN '(' || l[place] || ')' ELSE '' END END, ',' ORDER BY place) AS parts FROM p GROUP BY n)
SELECT lower(table_name) AS table_name, CASE WHEN is_unique THEN 'unique:' ELSE '' END || parts || CASE WHEN inc <> '' THEN '/include:' || replace(lower(inc), ';', ',') ELSE '' END || CASE WHEN filtered THEN '/filtered' ELSE '' END AS signature FROM i JOIN k USING (n))"""


_ACTION = "CASE WHEN lower(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))) IN ('', 'no action', 'restrict') THEN 'noaction' ELSE lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))) END"


def _index_ddl() -> str:
    parts = []
    for target, (a, b) in {"postgres": '""', "mssql": "[]", "mysql": "``", "sqlite": '""'}.items():
        names = lambda c, a=a, b=b: f"'{a}' || replace({c}, ';', '{b}, {a}') || '{b}'"
        schema = "" if target == "sqlite" else f"{a}app{b}."
        include = f"CASE WHEN inc <> '' THEN ' INCLUDE (' || {names('inc')} || ')' ELSE '' END" if target in ("postgres", "mssql") else "''"
        where = "CASE WHEN filtered THEN ' WHERE x > 0' ELSE '' END" if target != "mysql" else "''"
        has = {"postgres": "prefixes = ''", "mysql": "true"}.get(target, "prefixes = '' AND exprs = ''")
        listed = f"CASE WHEN starts_with(index_name, 'd_') THEN '(Lower(X)), {a}No{b}' WHEN starts_with(index_name, 'b_') THEN '{a}Hall_No{b}, {a}Email{b}(20)' ELSE {names('cols')} END"
        parts.append(f"SELECT '{target}' AS target, 'CREATE ' || CASE WHEN is_unique THEN 'UNIQUE ' ELSE '' END || 'INDEX ' || {names('index_name')} || ' ON {schema}' || {names('table_name')} || ' (' || {listed} || ')' || {include} || {where} AS sql FROM {spread(INDEXES, INDEX_COLUMNS)} WHERE {has}")
    return " UNION ALL ".join(parts)


def _check_sql(same: str) -> str:
    side = "SELECT lower(table_name) AS table_name, count(*) AS n, list_sort(list(lower(trim(regexp_replace(definition, '\\s+', ' ', 'g'))))) AS texts FROM {} GROUP BY 1"
    a, b = (side.format(spread(c, ["table_name", "definition"])) for c in CHECKS)
    return f"""SELECT table_name, coalesce(a.n, 0) AS n_source, coalesce(b.n, 0) AS n_target, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'add' WHEN coalesce(a.n, 0) < coalesce(b.n, 0) THEN 'drop' WHEN {same} AND a.texts <> b.texts THEN 'rewritten' ELSE 'same' END AS status
FROM ({a}) a FULL JOIN ({b}) b USING (table_name)"""


def oracle_sql() -> dict[str, str]:
    one, two = _signatures(INDEXES), _signatures(LIVE_INDEXES)
    s, t = (spread(rows, COLUMNS) for rows in LIVE["mssql_postgres"])
    differ = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in ("cols", "is_unique", "inc", "filtered")) + " OR CASE WHEN contains(a.exprs, 'true') THEN a.exprs ELSE '' END <> CASE WHEN contains(b.exprs, 'true') THEN b.exprs ELSE '' END OR replace(replace(a.prefixes, '0', ''), ';', '') <> replace(replace(b.prefixes, '0', ''), ';', '')"
    return {
        "drift_tables": f"SELECT table_name, CASE WHEN b.x IS NULL THEN 'missing' WHEN a.x IS NULL THEN 'extra' ELSE 'both' END AS status FROM (SELECT DISTINCT lower(table_name) AS table_name, 1 AS x FROM {s}) a FULL JOIN (SELECT DISTINCT lower(table_name) AS table_name, 1 AS x FROM {t}) b USING (table_name)",
        "check_reconciliation": _check_sql("true"),
        "check_counts": _check_sql("false"),
        "index_changes": f"""WITH a AS (SELECT * FROM {spread(INDEXES, INDEX_COLUMNS)}), b AS (SELECT * FROM {spread(LIVE_INDEXES, INDEX_COLUMNS)})
SELECT index_name, unnest(['removed', 'added']) AS change FROM a JOIN b USING (index_name) WHERE {differ}
UNION ALL SELECT index_name, 'removed' FROM a ANTI JOIN b USING (index_name) UNION ALL SELECT index_name, 'added' FROM b ANTI JOIN a USING (index_name)""",
        "index_signatures": f"SELECT * FROM {one}",
        "signature_diff": f"SELECT *, 'missing' AS change FROM {one} a WHERE NOT EXISTS (SELECT 1 FROM {two} b WHERE a.table_name = b.table_name AND a.signature = b.signature) UNION ALL SELECT *, 'extra' FROM {two} a WHERE NOT EXISTS (SELECT 1 FROM {one} b WHERE a.table_name = b.table_name AND a.signature = b.signature)",
        "key_signatures": f"""SELECT (SELECT string_agg(lower(c) || ':' || lower(r), ',' ORDER BY i) FROM (SELECT unnest(string_split(cols, ',')) AS c, unnest(string_split(refs, ',')) AS r, unnest(range(len(string_split(cols, ',')))) AS i)) || '->' ||
  CASE WHEN trim(coalesce(ref_schema, '')) = '' OR lower(ref_schema) = lower(own_schema) THEN 'self' ELSE lower(trim(ref_schema)) END || '.' || lower(ref_table) || '|' || {_ACTION.format("on_delete")} || '|' || {_ACTION.format("on_update")} AS signature FROM {spread(KEYS, KEY_COLUMNS)}""",
        "index_ddl": _index_ddl(),
    } | {f"drift_{p}": _deltas(p) for p in LIVE} | {f"live_diff_{p}": _live(p) for p in LIVE}
