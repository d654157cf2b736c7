"""Translated expressions, case by case."""

import pytest

from larkspur.functions import rewrites
from larkspur.operators import expressions

CLASSES = {"ok": "boolean", "first": "textual"}


@pytest.mark.parametrize(
    "text,postgres,mssql,mysql",
    [
        ("CASE WHEN (1 = [ok]) THEN _utf8mb4'a' END", "CASE WHEN (true = \"ok\") THEN 'a' END", "CASE WHEN (1 = [ok]) THEN 'a' END", "CASE WHEN (1 = `ok`) THEN 'a' END"),
        ("CASE WHEN `x` !~ '^ab.*$' THEN first + 'b' END", "CASE WHEN \"x\" !~ '^ab.*$' THEN first || 'b' END", "CASE WHEN [x] NOT LIKE 'ab%' THEN first + 'b' END", "CASE WHEN `x` NOT REGEXP '^ab.*$' THEN CONCAT(first, 'b') END"),
        ("CHECK ((CASE WHEN isnull(a, 1) = 1 THEN 'f(x)' END))", "CASE WHEN COALESCE(a, 1) = 1 THEN 'f(x)' END", "CASE WHEN isnull(a, 1) = 1 THEN 'f(x)' END", "CASE WHEN COALESCE(a, 1) = 1 THEN 'f(x)' END"),
        ("CASE WHEN a ~ b THEN 1 END", "CASE WHEN a ~ b THEN 1 END", None, "CASE WHEN a REGEXP b THEN 1 END"),
        ("CASE WHEN a ~ '^(x|y)$' THEN 1 END", "CASE WHEN a ~ '^(x|y)$' THEN 1 END", None, "CASE WHEN a REGEXP '^(x|y)$' THEN 1 END"),
        ("CASE WHEN a || 'x' + 1 = b THEN 1 END", "CASE WHEN a || 'x' + 1 = b THEN 1 END", None, None),
        ("CASE WHEN soundex(a) = 'b' THEN 1 END", None, None, None),
        ("CASE WHEN a) THEN 1 END", None, None, None),
        ("", None, None, None),
        ("now() AT TIME ZONE 'CET'", "CURRENT_TIMESTAMP AT TIME ZONE 'CET'", None, None),
        ("at_ AT TIME ZONE 'Europe/Paris' > now() AT TIME ZONE 'utc'", "\"at_\" AT TIME ZONE 'Europe/Paris' > (CURRENT_TIMESTAMP AT TIME ZONE 'UTC')", None, None),
        ("(ok = 0) OR NOT (ok <> 1)", '("ok" = false) OR (NOT ("ok" <> true))', "([ok] = 0) OR (NOT ([ok] <> 1))", "(`ok` = 0) OR (NOT (`ok` <> 1))"),
    ],
)
def test_translated(text, postgres, mssql, mysql):
    got = [rewrites.translate(text, t, CLASSES) for t in ("postgres", "mssql", "mysql")]
    assert [x or None for x in got] == [postgres, mssql, mysql]


def test_functions_of_one_dialect_stay():
    assert rewrites.translate("CASE WHEN soundex([a]) = 1 THEN 1 END", "mssql", {}, "mssql") == "CASE WHEN soundex([a]) = 1 THEN 1 END"
    assert rewrites.translate_default("next_of('x')", "mysql", source="mysql") == "next_of('x')"


def test_tables_with_and_without_columns(spark):
    columns = spark.createDataFrame([("t", "OK", "boolean"), ("t", "ok", "boolean"), ("t", "n", "integer")], "table_name string, column_name string, kind string")
    checks = spark.createDataFrame([("t", "ok = 1", 1), ("u", "ok = 1", 2), ("t", None, 3), ("t", "ok = 1", 4), (None, "ok = 1", 5)], "table_name string, definition string, classes_ int")
    got = sorted((x.classes_, x.translated) for x in expressions.translated(checks, columns, "postgres").collect())
    assert got == [(1, '"ok" = true'), (2, '"ok" = 1'), (3, None), (4, '"ok" = true'), (5, '"ok" = 1')]
    assert expressions.translated(checks.limit(0), columns.limit(0), "mysql").count() == 0
    d = spark.createDataFrame([("boolean", "1", None), ("timestamp", "now()", 9), ("text", " ", None), ("text", None, None)], "kind string, default string, fsp int")
    assert sorted(str(x.translated) for x in expressions.translated_defaults(d, "mysql").collect()) == ["1", "CURRENT_TIMESTAMP(6)", "None", "None"]
