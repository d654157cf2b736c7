"""Queries that verify rendered statements, with DuckDB counterparts.

Each database's statements are rendered and then spoilt, in a way that goes by the database's
number, so that the counterparts know by rule what the verification must find.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from larkspur.catalog_queries import _duck, fixture
from larkspur.functions import fragments, texts
from larkspur.plans import ddl, verify

TARGETS = ("postgres", "mssql", "mysql")
#: index, table, parts, unique, included, filter in SQL Server's words
INDEXES = """VALUES ('ix_code','loan','Code,Hall',true,'Fee','([Fee]>(0))'), ('ix_at','loan','At',false,'',NULL), ('ix_hall','shelf','Hall No,Place',false,'At,By',NULL)"""
INDEX_COLUMNS = ["index_name", "table_name", "cols", "is_unique", "inc", "filter"]
#: key, table, columns, referenced table and columns, actions
KEYS = """VALUES ('fk_reader','loan','Reader','reader','No','cascade',NULL), ('fk_place','loan','Hall,Place','shelf','Hall,Place','NO  ACTION','set null'), ('fk_desk','shelf','Desk','desk','No',NULL,'RESTRICT')"""
KEY_COLUMNS = ["constraint_name", "table_name", "cols", "ref_table", "refs", "on_delete", "on_update"]
#: check, table, definition in SQL Server's words
CHECKS = """VALUES ('ck_fee','loan','([Fee]>=(0) AND [Fee]<(100))'), ('ck_kind','loan','([Kind] IN (''a'',''b''))'), ('ck_hall','shelf','([Hall] IS NOT NULL OR NOT [Place]=(1))')"""
CHECK_COLUMNS = ["constraint_name", "table_name", "definition"]


def _all(make):
    out = None
    for t in TARGETS:
        one = make(t).withColumn("target", F.lit(t))
        out = one if out is None else out.unionAll(one)
    return out


def _translated(text: str, target: str) -> str:
    return fragments.render(fragments.parse(text), target)


def verified_indexes(spark, sf_dir):
    """Spoilt by database % 5: 1 loses UNIQUE, 2 gets another name, 3 another table, 4 a parenthesis too many."""
    def one(t):
        i = fixture(spark, sf_dir, INDEXES, INDEX_COLUMNS, own=True).withColumns({"columns": F.split("cols", ","), "include_cols": F.filter(F.split("inc", ","), lambda x: x != ""), "source": F.col("filter")})
        i = texts.applied(i, "source", "translated", partial(_translated, target=t)).withColumns({"exprs": F.array().cast("array<boolean>"), "prefixes": F.array().cast("array<int>")})
        right = i.withColumn("filter", F.col("translated")).withColumn("sql", ddl.create_index(t, "app"))
        n = F.col("database") % 5
        spoilt = F.when(n == 1, F.replace("sql", F.lit("UNIQUE "), F.lit(""))).when(n == 2, F.replace("sql", F.lit("ix_"), F.lit("iy_"))).when(n == 3, F.replace("sql", F.col("table_name"), F.lit("attic"))).when(n == 4, F.concat("sql", F.lit(")"))).otherwise(F.col("sql"))
        return verify.indexes(right.withColumn("sql", spoilt).withColumn("filter", F.col("source")), t)

    return _all(one)


def verified_keys(spark, sf_dir):
    """Spoilt by database % 4: 1 references another schema, 2 nulls where it should cascade, 3 is cut off after REFERENCES."""

    def one(t):
        k = fixture(spark, sf_dir, KEYS, KEY_COLUMNS, own=True).withColumns({"columns": F.split("cols", ","), "ref_columns": F.split("refs", ","), "ref_schema": F.lit("app")})
        n, sql = F.col("database") % 4, ddl.add_constraint("foreign_key", t, "app")
        a, b = ddl.QUOTES[t]
        spoilt = F.when(n == 1, F.replace(F.col("sql"), F.lit(f"REFERENCES {a}app"), F.lit(f"REFERENCES {a}other"))).when(n == 2, F.replace(F.col("sql"), F.lit("CASCADE"), F.lit("SET NULL"))).when(n == 3, F.regexp_replace("sql", "REFERENCES.*", "REFERENCES")).otherwise(F.col("sql"))
        return verify.foreign_keys(k.withColumn("sql", sql).withColumn("sql", spoilt), t)

    return _all(one)


def verified_checks(spark, sf_dir):
    """Spoilt by database % 3: 1 compares with another number, 2 has a condition more."""
    def one(t):
        c = fixture(spark, sf_dir, CHECKS, CHECK_COLUMNS, own=True).withColumn("source", F.col("definition"))
        c = texts.applied(c, "source", "translated", partial(_translated, target=t))
        right = c.withColumn("definition", F.col("translated")).withColumn("sql", ddl.add_constraint("check", t, "app")).withColumn("definition", F.col("source"))
        n = F.col("database") % 3
        spoilt = F.when(n == 1, F.regexp_replace("sql", r"\d(\)+)$", "7$1")).when(n == 2, F.regexp_replace("sql", r"\)$", " OR 1 = 1)")).otherwise(F.col("sql"))
        return verify.checks(right.withColumn("sql", spoilt), t).select("table_name", "constraint_name", "criterion")

    return _all(one)


_OVER = "(VALUES ('postgres'), ('mssql'), ('mysql')) AS g_(target)"


def _indexes_sql() -> str:
    rows = f"(SELECT *, database % 5 AS n FROM {_duck(INDEXES, INDEX_COLUMNS, own=True)}, {_OVER})"
    left = "SELECT table_name, index_name, '{}' AS criterion, {} AS expected, {} AS found, target FROM " + rows + " WHERE {}"
    return " UNION ALL ".join([
        left.format("unique", "'true'", "'false'", "n = 1 AND is_unique"), left.format("name", "index_name", "replace(index_name, 'ix_', 'iy_')", "n = 2"), left.format("table", "table_name", "'attic'", "n = 3"),
        left.format("unparsed", "''", "') not expected'", "n = 4 AND (target = 'mysql' OR filter IS NULL)"), left.format("filter", "filter", "CASE target WHEN 'postgres' THEN '\"Fee\" > 0)' ELSE '[Fee] > 0)' END", "n = 4 AND target <> 'mysql' AND filter IS NOT NULL"),
    ])


def _keys_sql() -> str:
    rows = f"(SELECT *, database % 4 AS n FROM {_duck(KEYS, KEY_COLUMNS, own=True)}, {_OVER})"
    left = "SELECT table_name, constraint_name, '{}' AS criterion, {} AS expected, {} AS found, target FROM " + rows + " WHERE {}"
    return " UNION ALL ".join([left.format("ref_schema", "'app'", "'other'", "n = 1"), left.format("on_delete", "'cascade'", "'set null'", "n = 2 AND on_delete = 'cascade'"), left.format("unparsed", "''", "'name expected'", "n = 3")])


def _checks_sql() -> str:
    rows = f"(SELECT *, database % 3 AS n FROM {_duck(CHECKS, CHECK_COLUMNS, own=True)}, {_OVER})"
    return f"SELECT table_name, constraint_name, 'predicate' AS criterion, target FROM {rows} WHERE n = 2 OR n = 1 AND constraint_name <> 'ck_kind'"


def queries():
    return {f.__name__: f for f in (verified_indexes, verified_keys, verified_checks)}


def oracle_sql() -> dict[str, str]:
    return {"verified_indexes": _indexes_sql(), "verified_keys": _keys_sql(), "verified_checks": _checks_sql()}
