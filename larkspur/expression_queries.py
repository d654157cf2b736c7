"""Queries of translated expressions, with DuckDB counterparts.

Expressions are put together from the parts' own brands, names and sizes, so that the
counterparts know by rule what each must become, without reading it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import expressions

TARGETS = ("postgres", "mssql", "mysql")
_EVEN = "CAST(substring(p_brand, 7) AS INT) % 2 = 0"
#: By p_partkey % 10: the source, and what it is on each target (None: refused), as SQL of both engines; ok is a truth value in brands of even numbers.
CASES = [
    ("'CASE WHEN [a] > ' || p_size || ' THEN N''' || p_brand || ''' ELSE ''x'' END'", "'CASE WHEN \"a\" > ' || p_size || ' THEN ''' || p_brand || ''' ELSE ''x'' END'", "'CASE WHEN [a] > ' || p_size || ' THEN ''' || p_brand || ''' ELSE ''x'' END'", "'CASE WHEN `a` > ' || p_size || ' THEN ''' || p_brand || ''' ELSE ''x'' END'"),
    ("'(CASE WHEN \"a\" IS NULL THEN NULL::numeric(10, ' || p_size || ') ELSE \"b\"::character varying END)'", "'CASE WHEN \"a\" IS NULL THEN NULL ELSE \"b\" END'", "'CASE WHEN [a] IS NULL THEN NULL ELSE [b] END'", "'CASE WHEN `a` IS NULL THEN NULL ELSE `b` END'"),
    ("'CASE WHEN [ok] = ' || (p_size % 3) || ' THEN getdate() ELSE newid() END'", f"'CASE WHEN \"ok\" = ' || CASE WHEN p_size % 3 < 2 AND {_EVEN} THEN CASE p_size % 3 WHEN 1 THEN 'true' ELSE 'false' END ELSE CAST(p_size % 3 AS VARCHAR(9)) END || ' THEN CURRENT_TIMESTAMP ELSE gen_random_uuid() END'", "'CASE WHEN [ok] = ' || (p_size % 3) || ' THEN getdate() ELSE newid() END'", "'CASE WHEN `ok` = ' || (p_size % 3) || ' THEN CURRENT_TIMESTAMP ELSE UUID() END'"),
    ("'CASE WHEN a ~ ''^[0-9]{' || (p_size % 5 + 1) || '}$'' THEN 1 ELSE 0 END'", "'CASE WHEN a ~ ''^[0-9]{' || (p_size % 5 + 1) || '}$'' THEN 1 ELSE 0 END'", "'CASE WHEN a LIKE ''' || repeat('[0-9]', p_size % 5 + 1) || ''' THEN 1 ELSE 0 END'", "'CASE WHEN a REGEXP ''^[0-9]{' || (p_size % 5 + 1) || '}$'' THEN 1 ELSE 0 END'"),
    ("'CASE WHEN \"k\" = ANY (ARRAY[''x''::text, ''' || p_brand || '''::text]) THEN ''a'' || \"k\" ELSE \"k\" || ''-'' || lower(\"l\") END'", "'CASE WHEN \"k\" IN (''x'', ''' || p_brand || ''') THEN ''a'' || \"k\" ELSE \"k\" || ''-'' || lower(\"l\") END'", "'CASE WHEN [k] IN (''x'', ''' || p_brand || ''') THEN ''a'' + [k] ELSE [k] + ''-'' + lower([l]) END'", "'CASE WHEN `k` IN (''x'', ''' || p_brand || ''') THEN CONCAT(''a'', `k`) ELSE CONCAT(`k`, ''-'', lower(`l`)) END'"),
    ("'CASE WHEN dbo.size_of([a]) > ' || p_size || ' THEN 1 END'", "NULL", "NULL", "NULL"),
    ("'[first] + [last] <> ''' || p_name || ''''", "'\"first\" || \"last\" <> ''' || p_name || ''''", "'CONCAT([first], [last]) <> ''' || p_name || ''''", "'CONCAT(`first`, `last`) <> ''' || p_name || ''''"),
    ("'[ok] IN (0, (1))'", f"CASE WHEN {_EVEN} THEN '\"ok\" IN (false, true)' ELSE '\"ok\" IN (0, 1)' END", "'[ok] IN (0, 1)'", "'`ok` IN (0, 1)'"),
    ("'CASE WHEN \"ok\" THEN true ELSE ' || p_size || ' > 7 END'", "'CASE WHEN \"ok\" THEN true ELSE ' || p_size || ' > 7 END'", "'CASE WHEN [ok] THEN 1 ELSE ' || p_size || ' > 7 END'", "'CASE WHEN `ok` THEN 1 ELSE ' || p_size || ' > 7 END'"),
    ("'([a]+[b]) > ' || p_size || ' AND [ok] <> 1'", f"'((\"a\" + \"b\") > ' || p_size || ') AND (\"ok\" <> ' || CASE WHEN {_EVEN} THEN 'true' ELSE '1' END || ')'", "'(([a] + [b]) > ' || p_size || ') AND ([ok] <> 1)'", "'((`a` + `b`) > ' || p_size || ') AND (`ok` <> 1)'"),
]
#: By p_partkey % 6: the column's kind and default, and the default on each target.
DEFAULTS = [
    ("'boolean'", "'((' || (p_size % 2) || '))'", "CASE p_size % 2 WHEN 1 THEN 'true' ELSE 'false' END", "CAST(p_size % 2 AS VARCHAR(9))", "CAST(p_size % 2 AS VARCHAR(9))"),
    ("'timestamp'", "'(getdate())'", "'CURRENT_TIMESTAMP'", "'SYSDATETIME()'", "'CURRENT_TIMESTAMP' || CASE p_size % 8 WHEN 0 THEN '' WHEN 7 THEN '(6)' ELSE '(' || (p_size % 8) || ')' END"),
    ("'json'", "CASE WHEN p_size > 25 THEN '''{}''' ELSE '''[]''::jsonb' END", "CASE WHEN p_size > 25 THEN '''{}''' ELSE '''[]''' END", "CASE WHEN p_size > 25 THEN '''{}''' ELSE '''[]''' END", "CASE WHEN p_size > 25 THEN 'JSON_OBJECT()' ELSE 'JSON_ARRAY()' END"),
    ("'array'", "'''{}''::text[]'", "'''{}'''", "'''{}'''", "'JSON_ARRAY()'"),
    ("'varchar'", "'(N''' || p_name || ''')'", "'''' || p_name || ''''", "'''' || p_name || ''''", "'''' || p_name || ''''"),
    ("'integer'", "'dbo.next(' || p_size || ')'", "NULL", "NULL", "NULL"),
]


def _case(rows: list[tuple], i: int) -> str:
    return f"CASE p_partkey % {len(rows)} " + " ".join(f"WHEN {n} THEN {r[i]}" for n, r in enumerate(rows)) + " END"


def _part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def _each(make):
    out = None
    for t in TARGETS:
        one = make(t).select(F.lit(t).alias("target"), "p_partkey", "translated")
        out = one if out is None else out.unionAll(one)
    return out


def translated_checks(spark, sf_dir):
    """Each part's expression on every target; its brand is the table whose columns it names."""
    part = _part(spark, sf_dir)
    exprs = part.select("p_partkey", F.col("p_brand").alias("table_name"), F.expr(_case(CASES, 0)).alias("definition"))
    brands = part.select("p_brand").distinct()
    columns = brands.select(F.col("p_brand").alias("table_name"), F.explode(F.expr(f"array(struct('OK', if({_EVEN}, 'boolean', 'integer')), struct('first', 'varchar'), struct('last', 'char'), struct('a', 'integer'))")).alias("c")).select("table_name", F.col("c.col1").alias("column_name"), F.col("c.col2").alias("kind"))
    return _each(lambda t: expressions.translated(exprs, columns, t))


def translated_defaults(spark, sf_dir):
    """Each part's default on every target."""
    c = _part(spark, sf_dir).select("p_partkey", F.expr(_case(DEFAULTS, 0)).alias("kind"), F.expr(_case(DEFAULTS, 1)).alias("default"), F.expr("p_size % 8").alias("fsp"))
    return _each(lambda t: expressions.translated_defaults(c, t))


def queries():
    return {f.__name__: f for f in (translated_checks, translated_defaults)}


def oracle_sql() -> dict[str, str]:
    sql = lambda rows, first: " UNION ALL ".join(f"SELECT '{t}' AS target, p_partkey, {_case(rows, first + i)} AS translated FROM part" for i, t in enumerate(TARGETS))
    return {"translated_checks": sql(CASES, 1), "translated_defaults": sql(DEFAULTS, 2)}
