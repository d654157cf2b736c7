"""Queries of nested, enumerated and spatial types, with DuckDB counterparts.

The declared types are put together from the parts' own sizes, brands and names, so
that the counterparts know by rule what each must be read as, without reading it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import clickhouse, kinds, texts, types

#: Declared ClickHouse types by p_partkey % 16, as SQL of both engines.
DECLARED = [
    "'Nullable(Decimal(' || (p_size + 5) || ', ' || (p_size % 5) || '))'", "'LowCardinality( Nullable(FixedString(' || p_size || ')) )'", "'Array(Array(Nullable(UInt' || (8 * (p_size % 2) + 8) || ')))'",
    "'Enum8(''' || p_brand || ''' = 1, ''' || p_name || ', (x)'' = -' || p_size || ')'", "'DateTime64(' || (p_size % 12) || ', ''UTC'')'", "'DateTime(''Europe/Paris'')'", "'Map(String, ' || 'Int8)'", "'Decimal64(' || (p_size % 25) || ')'",
    "'Object(''json'')'", "'Array(LowCardinality(String)'", "'array(Enum16(''it''''s ' || p_size || '''=1))'", "'Nullable(DateTime)'", "'FixedString(' || (p_size - 10) || ')'", "'Array(Tuple(Int8, ' || p_brand || '))'", "' uint64 '", "'IPv' || (4 + 2 * (p_size % 2))",
]
TYPE = "CASE p_partkey % 16 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(DECLARED)) + " END"


def _types(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(TYPE).alias("data_type"))
    return texts.applied(t, "data_type", "k", clickhouse.parse, kinds.FACTS)


def clickhouse_kinds(spark, sf_dir):
    """The kind of each part's ClickHouse type; each distinct type is read once."""
    k = F.col("k")
    plain = [F.coalesce(k[c], F.lit(0)).alias(c) for c in ("length", "precision", "scale", "depth")]
    return _types(spark, sf_dir).select("p_partkey", "data_type", k["kind"].alias("kind"), *plain, k["fsp"].alias("fsp"), *[F.coalesce(k[c], F.lit(False)).alias(c) for c in ("zoned", "unsigned")], F.coalesce(F.array_join(k["members"], "|"), F.lit("")).alias("members"), k["raw"].alias("raw"))


def clickhouse_maps(spark, sf_dir):
    """Each part's ClickHouse type on every target; null where there is none."""
    return _types(spark, sf_dir).select("p_partkey", *[kinds.render(t, F.col("k")).alias(t) for t in types.TARGETS])


def clickhouse_losses(spark, sf_dir):
    """What each part's ClickHouse type loses on every target."""
    off = F.lit(False)
    each = F.explode(F.map_from_arrays(F.array(*map(F.lit, types.TARGETS)), F.array(*[kinds.losses(t, F.col("k"), off, off) for t in types.TARGETS]))).alias("target", "reasons")
    return _types(spark, sf_dir).select("p_partkey", each).select("p_partkey", "target", F.explode("reasons").alias("reason"))


_N = "p_partkey % 16"
_RULED = f"""(SELECT p_partkey, {TYPE} AS data_type, p_size, p_brand, p_name, {_N} AS n,
  CASE {_N} WHEN 0 THEN 'decimal' WHEN 1 THEN 'char' WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'tinyint' ELSE 'smallint' END WHEN 3 THEN 'enum' WHEN 4 THEN CASE WHEN p_size % 12 <= 9 THEN 'timestamp' ELSE 'raw' END WHEN 5 THEN 'timestamp' WHEN 7 THEN CASE WHEN p_size % 25 <= 18 THEN 'decimal' ELSE 'raw' END
    WHEN 8 THEN 'json' WHEN 10 THEN 'enum' WHEN 11 THEN 'timestamp' WHEN 12 THEN CASE WHEN p_size > 10 THEN 'char' ELSE 'raw' END WHEN 14 THEN 'bigint' WHEN 15 THEN 'text' ELSE 'raw' END AS kind,
  CASE {_N} WHEN 2 THEN 2 WHEN 10 THEN 1 WHEN 13 THEN 1 ELSE 0 END AS depth FROM part)"""
_KINDS = f"""(SELECT *, CASE WHEN kind = 'char' THEN CASE n WHEN 1 THEN p_size ELSE p_size - 10 END ELSE 0 END AS length, CASE WHEN kind = 'decimal' THEN CASE n WHEN 0 THEN p_size + 5 ELSE 18 END ELSE 0 END AS precision,
  CASE WHEN kind = 'decimal' THEN CASE n WHEN 0 THEN p_size % 5 ELSE p_size % 25 END ELSE 0 END AS scale, CASE WHEN kind = 'timestamp' THEN CASE n WHEN 4 THEN p_size % 12 ELSE 0 END END AS fsp, kind = 'timestamp' AND n IN (4, 5) AS zoned, n IN (2, 14) AS unsigned,
  CASE n WHEN 3 THEN p_brand || '|' || p_name || ', (x)' WHEN 10 THEN 'it''s ' || p_size ELSE '' END AS members, CASE WHEN kind = 'raw' THEN CASE n WHEN 13 THEN 'Tuple(Int8, ' || p_brand || ')' ELSE trim(data_type) END END AS raw FROM {_RULED})"""


def _maps() -> str:
    fsp = lambda most: f"least(fsp, {most})"
    last = "p_name || ', (x)'"
    sets = {
        "postgres": f"CASE kind WHEN 'decimal' THEN format('numeric({{}},{{}})', precision, scale) WHEN 'char' THEN format('character({{}})', length) WHEN 'tinyint' THEN 'smallint[][]' WHEN 'smallint' THEN 'integer[][]' WHEN 'enum' THEN CASE n WHEN 10 THEN 'text[]' ELSE 'text' END WHEN 'timestamp' THEN 'timestamp(' || {fsp(6)} || CASE WHEN zoned THEN ') with time zone' ELSE ') without time zone' END WHEN 'json' THEN 'jsonb' WHEN 'bigint' THEN 'numeric(20,0)' WHEN 'text' THEN 'text' END",
        "mssql": f"CASE WHEN depth > 0 THEN 'NVARCHAR(MAX)' ELSE CASE kind WHEN 'decimal' THEN format('DECIMAL({{}},{{}})', least(precision, 38), scale) WHEN 'char' THEN format('CHAR({{}})', length) WHEN 'enum' THEN format('NVARCHAR({{}})', greatest(length(p_brand), length({last}))) WHEN 'timestamp' THEN CASE WHEN zoned THEN 'DATETIMEOFFSET(' ELSE 'DATETIME2(' END || {fsp(7)} || ')' WHEN 'json' THEN 'NVARCHAR(MAX)' WHEN 'bigint' THEN 'DECIMAL(20,0)' WHEN 'text' THEN 'NVARCHAR(MAX)' END END",
        "mysql": f"CASE WHEN depth > 0 THEN 'JSON' ELSE CASE kind WHEN 'decimal' THEN format('DECIMAL({{}},{{}})', precision, scale) WHEN 'char' THEN format('CHAR({{}})', length) WHEN 'enum' THEN 'ENUM(''' || p_brand || ''',''' || {last} || ''')' WHEN 'timestamp' THEN CASE WHEN zoned THEN 'TIMESTAMP' ELSE 'DATETIME' END || CASE WHEN fsp > 0 THEN '(' || {fsp(6)} || ')' ELSE '' END WHEN 'json' THEN 'JSON' WHEN 'bigint' THEN 'BIGINT UNSIGNED' WHEN 'text' THEN 'LONGTEXT' END END",
        "sqlite": "CASE WHEN depth > 0 THEN 'TEXT' ELSE CASE kind WHEN 'decimal' THEN format('NUMERIC({},{})', precision, scale) WHEN 'char' THEN format('CHAR({})', length) WHEN 'timestamp' THEN 'DATETIME(' || fsp || ')' WHEN 'bigint' THEN 'INTEGER' WHEN 'raw' THEN NULL ELSE 'TEXT' END END",
        "clickhouse": f"CASE kind WHEN 'decimal' THEN format('Decimal({{}}, {{}})', precision, scale) WHEN 'char' THEN format('FixedString({{}})', length) WHEN 'tinyint' THEN 'Array(Array(UInt8))' WHEN 'smallint' THEN 'Array(Array(UInt16))' WHEN 'enum' THEN CASE n WHEN 3 THEN 'Enum8(''' || p_brand || ''' = 1, ''' || {last} || ''' = 2)' ELSE 'Array(Enum8(''it' || chr(92) || '''s ' || p_size || ''' = 1))' END WHEN 'timestamp' THEN CASE WHEN fsp > 0 THEN 'DateTime64(' || fsp || CASE WHEN zoned THEN ', ''UTC'')' ELSE ')' END WHEN zoned THEN 'DateTime(''UTC'')' ELSE 'DateTime' END WHEN 'json' THEN 'String' WHEN 'bigint' THEN 'UInt64' WHEN 'text' THEN 'String' END",
    }
    return "SELECT p_partkey, " + ", ".join(f"{sql} AS {t}" for t, sql in sets.items()) + f" FROM {_KINDS}"


#: Targets (by letters), condition and reason of what a type loses.
_LOST = [
    ("mys", "depth > 0", "no arrays"), ("p", "kind = 'tinyint'", "no 8-bit integers"), ("p", "unsigned AND kind <> 'tinyint'", "no unsigned integers"), ("m", "unsigned AND depth = 0", "no unsigned integers"),
    ("m", "precision > 38", "precision is cut"), ("p", "kind = 'enum'", "members aren't enforced"), ("ms", "kind = 'enum' AND depth = 0", "members aren't enforced"), ("y", "zoned", "times from 1970 to 2038 only"), ("pmsc", "false", ""),
    ("py", "fsp > 6", "fractional seconds are cut"), ("m", "fsp > 7", "fractional seconds are cut"), ("s", "unsigned AND depth = 0", "no unsigned integers"), ("s", "kind = 'char'", "length isn't enforced"), ("s", "kind = 'decimal'", "precision and scale aren't enforced"),
    ("s", "zoned", "no time zones"), ("s", "kind = 'timestamp'", "fractional seconds aren't enforced"), ("s", "kind = 'json'", "stored as text, not validated"), ("c", "kind = 'char'", "fixed strings count bytes"), ("c", "kind = 'json'", "stored as a string"), ("c", "zoned", "zone becomes UTC"),
]


def _losses() -> str:
    names = {"p": "postgres", "m": "mssql", "y": "mysql", "s": "sqlite", "c": "clickhouse"}
    return " UNION ALL ".join(f"SELECT p_partkey, '{names[t]}' AS target, '{why.replace(chr(39), chr(39) * 2)}' AS reason FROM {_KINDS} WHERE {when}" for ts, when, why in _LOST for t in ts)


#: dialect, declared type, subtype, srid, and whether the part's brand and name are its members, by p_partkey % 12.
OTHERS = [
    ("postgres", "'geometry(Point,' || p_size || ')'", "NULL", "NULL", False), ("postgres", "'geography'", "'ST_Polygon'", "p_size", False), ("postgres", "'GEOMETRY(ST_MultiPoint)'", "'point'", "NULL", False), ("postgres", "'geometry'", "NULL", "NULL", False),
    ("mysql", "'point'", "NULL", "p_size", False), ("mysql", "'geometrycollection'", "NULL", "0", False), ("mssql", "'geography'", "NULL", "p_size", False), ("mysql", "'enum'", "NULL", "NULL", True), ("mysql", "'set'", "NULL", "NULL", True),
    ("mysql", "'enum'", "NULL", "NULL", False), ("postgres", "'_varchar'", "NULL", "NULL", False), ("postgres", "'numeric[]'", "NULL", "NULL", False),
]


def _other(i: int) -> str:
    return "CASE p_partkey % 12 " + " ".join(f"WHEN {n} THEN {(chr(39) + o[0] + chr(39)) if i == 0 else o[i]}" for n, o in enumerate(OTHERS)) + " END"


_MEMBERED = "p_partkey % 12 IN (7, 8)"


def _others(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    facts = part.select("p_partkey", "p_size", F.expr(_other(0)).alias("dialect"), F.expr(_other(1)).alias("data_type"), F.expr(_other(2)).cast("string").alias("subtype"), F.expr(_other(3)).cast("int").alias("srid"), F.when(F.expr(_MEMBERED), F.array("p_brand", "p_name")).alias("members"))
    none = F.lit(None).cast("int")
    k = kinds.declared(F.col("data_type"), F.col("dialect"), F.when(F.expr("p_partkey % 12 = 10"), F.col("p_size")), F.when(F.expr("p_partkey % 12 = 11"), F.col("p_size")), F.lit(2), none, F.lit(False), F.col("members"), F.col("subtype"), F.col("srid"))
    return facts.withColumn("k", k)


def spatial_kinds(spark, sf_dir):
    """Family, subtype, srid and array levels of each part's declared type."""
    k = F.col("k")
    return _others(spark, sf_dir).select("p_partkey", "data_type", k["kind"].alias("kind"), k["family"].alias("family"), k["subtype"].alias("subtype"), k["srid"].alias("srid"), k["depth"].alias("depth"))


def member_maps(spark, sf_dir):
    """Each part's spatial type, enum, set or array on every target."""
    return _others(spark, sf_dir).select("p_partkey", *[kinds.render(t, F.col("k")).alias(t) for t in types.TARGETS])


_SPATIAL = f"""(SELECT *, p_partkey % 12 AS n, {_other(1)} AS data_type, CASE p_partkey % 12 WHEN 0 THEN 'Point' WHEN 1 THEN 'Polygon' WHEN 2 THEN 'MultiPoint' WHEN 4 THEN 'Point' WHEN 5 THEN 'GeometryCollection' ELSE '' END AS sub,
  CASE WHEN p_partkey % 12 IN (0, 1, 4, 6) THEN p_size ELSE 0 END AS srid, CASE WHEN p_partkey % 12 IN (1, 6) THEN 'geography' ELSE 'geometry' END AS family FROM part)"""


def _member_maps() -> str:
    pg = "CASE WHEN sub = '' AND srid = 0 THEN family ELSE family || '(' || CASE sub WHEN '' THEN 'Geometry' ELSE sub END || CASE WHEN srid > 0 THEN ',' || srid ELSE '' END || ')' END"
    listed = "'(''' || p_brand || ''',''' || p_name || ''')'"
    sets = {
        "postgres": f"CASE WHEN n < 7 THEN {pg} WHEN n < 10 THEN 'text' WHEN n = 10 THEN format('character varying({{}})[]', p_size) ELSE format('numeric({{}},2)[]', p_size) END",
        "mssql": "CASE WHEN n < 7 THEN upper(family) WHEN n = 7 THEN format('NVARCHAR({})', greatest(length(p_brand), length(p_name))) WHEN n = 8 THEN format('NVARCHAR({})', length(p_brand) + length(p_name) + 1) WHEN n = 9 THEN 'NVARCHAR(255)' ELSE 'NVARCHAR(MAX)' END",
        "mysql": f"CASE WHEN n < 7 THEN CASE sub WHEN '' THEN 'GEOMETRY' ELSE upper(sub) END || CASE WHEN srid > 0 THEN ' SRID ' || srid ELSE '' END WHEN n = 7 THEN 'ENUM' || {listed} WHEN n = 8 THEN 'SET' || {listed} WHEN n > 9 THEN 'JSON' END",
        "sqlite": "CASE WHEN n < 7 THEN 'BLOB' ELSE 'TEXT' END",
        "clickhouse": "CASE WHEN n = 7 THEN 'Enum8(''' || p_brand || ''' = 1, ''' || p_name || ''' = 2)' WHEN n < 10 THEN 'String' WHEN n = 10 THEN 'Array(String)' ELSE format('Array(Decimal({}, 2))', p_size) END",
    }
    return "SELECT p_partkey, " + ", ".join(f"{sql} AS {t}" for t, sql in sets.items()) + f" FROM {_SPATIAL}"


def queries():
    return {f.__name__: f for f in (clickhouse_kinds, clickhouse_maps, clickhouse_losses, spatial_kinds, member_maps)}


def oracle_sql() -> dict[str, str]:
    return {
        "clickhouse_kinds": f"SELECT p_partkey, data_type, kind, length, precision, scale, depth, fsp, zoned, unsigned, members, raw FROM {_KINDS}",
        "clickhouse_maps": _maps(),
        "clickhouse_losses": _losses(),
        "spatial_kinds": f"SELECT p_partkey, data_type, CASE WHEN n < 7 THEN 'spatial' WHEN n IN (7, 9) THEN 'enum' WHEN n = 8 THEN 'set' WHEN n = 10 THEN 'varchar' ELSE 'decimal' END AS kind, CASE WHEN n < 7 THEN family END AS family, CASE WHEN n < 7 THEN lower(sub) END AS subtype, CASE WHEN n < 7 THEN srid END AS srid, CASE WHEN n > 9 THEN 1 ELSE 0 END AS depth FROM {_SPATIAL}",
        "member_maps": _member_maps(),
    }
