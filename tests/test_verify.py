"""Parsing statements back, ClickHouse's types, fragments' keys and whole definitions, case by case."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import clickhouse, fragments, kinds
from larkspur.plans import api, definitions, ordering, verify


def test_statements():
    p = verify.parse("CREATE UNIQUE INDEX [a b] ON [app].[T] ([x], [y](20), (lower(z, 1))) INCLUDE ([i], [j]) WHERE [x] > N'a)'")
    assert (p["name"], p["table_name"], p["columns"], p["include_cols"], p["is_unique"], p["filter"]) == ("a b", "T", ["x", "y(20)", "lower(z, 1)"], ["i", "j"], True, "[x] > N'a)'")
    p = verify.parse('alter table "s"."t" add constraint "k""1" foreign key ("a", "b") references "o"."r" ("c", "d") on update set null on delete cascade;')
    assert (p["name"], p["columns"], p["ref_schema"], p["ref_table"], p["ref_columns"], p["on_delete"], p["on_update"]) == ('k"1', ["a", "b"], "o", "r", ["c", "d"], "CASCADE", "SET NULL")
    assert verify.parse("ALTER TABLE t ADD CONSTRAINT c CHECK (a IN (1, 2) AND b <> ')')")["definition"] == "a IN (1, 2) AND b <> ')'"
    assert verify.parse("ALTER TABLE t ADD CONSTRAINT c PRIMARY KEY (a, `b`)")["columns"] == ["a", "b"]
    for bad in ("", "CREATE TABLE t (a int)", "CREATE INDEX i ON t", "CREATE INDEX i ON t (a", "CREATE INDEX i ON t (a) x", "ALTER TABLE t ADD CONSTRAINT c FOREIGN KEY (a)", "ALTER TABLE t ADD CONSTRAINT c FOREIGN KEY (a) REFERENCES r (b) ON DELETE EXPLODE"):
        assert verify.parse(bad)["error"]


@pytest.mark.parametrize("a,b,alike", [("([Fee]>(0))", '"fee" > 0', True), ("x IN ('b','A')", "(x in ('a', 'B'))", True), ("CASE WHEN a THEN 1 END", "case  when [A] then 1 end", True), ("a = 1", "a = 2", False), ("x = 'A  b'", "x = 'A b'", False)])
def test_keys_of_fragments(a, b, alike):
    x, y = fragments.keys(a), fragments.keys(b)
    assert alike == (x["tree"] is not None and x["tree"] == y["tree"] or x["text"] == y["text"])


def test_nested_types():
    deep = "Array(" * 50 + "LowCardinality(Nullable(UInt16))" + ")" * 50
    assert clickhouse.parse(deep) == {"kind": "smallint", "unsigned": True, "depth": 50}
    assert clickhouse.parse(r"Enum16('a\'b' = 1, 'c''d,(' = -2)") == {"kind": "enum", "members": ["a'b", "c'd,("], "depth": 0}
    for bad in ("", "Array(Int8", "Array()", "Decimal(0, 0)", "Decimal(77, 1)", "Decimal(5, 6)", "Decimal32(10)", "FixedString(0)", "DateTime64(10)", "DateTime64()", "Enum8('a')", "Enum8()", "Nullable(Int8, Int8)", "Nullable", "UInt128", "Map(String, Int8)", "Int8) x(", "Enum8('a = 1)"):
        assert clickhouse.parse(bad)["kind"] == "raw", bad


def test_many_members(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("m"), i.cast("string"))).alias("m"), F.array(F.lit("it's"), F.lit("b\\c")).alias("few"))
    k = lambda members, kind="enum": kinds.struct(kind=F.lit(kind), members=members)
    got = df.select(*[kinds.render(t, k(F.col("m"))).alias(t) for t in ("clickhouse", "mssql")], kinds.render("mysql", k(F.col("few"), "set")).alias("mysql"), kinds.render("mysql", k(F.lit(None))).alias("none"), kinds.render("clickhouse", k(F.col("few"))).alias("few")).first()
    assert got.clickhouse.startswith("Enum16('m1' = 1, ") and got.mssql == "NVARCHAR(4)" and got.none is None
    assert got.mysql == r"SET('it''s','b\\c')" and got.few == r"Enum8('it\'s' = 1, 'b\\c' = 2)"


def test_what_a_dialect_cannot_define(spark):
    t = spark.createDataFrame([("t", 1, "a", "Array(Int8)", True, 1), ("t", 2, "b", None, False, None)], "table_name string, ordinal int, column_name string, type_text string, is_nullable boolean, key_position int")
    one = definitions.create_tables(t, "clickhouse").first()
    assert one.sql is None and one.violations == ["a: nullable array or map", "a: nullable key column", "b: no type"]
    with pytest.raises(Exception, match="can't define"):
        api.Registry().apply("create_table", t, "clickhouse").collect()
    assert definitions.create_tables(t.limit(0), "mysql").count() == 0


@pytest.mark.parametrize("text,kind,want", [("5", "INT", "5"), ("-1.5", "DECIMAL(5,2)", "-1.5"), ("'a''b'", "VARCHAR(3)", "'a''b'"), ("'a'", "LONGTEXT", "('a')"), ("'{}'", "json", "('{}')"), ("CURRENT_TIMESTAMP(6)", "DATETIME(6)", "CURRENT_TIMESTAMP(6)"), ("CURRENT_TIMESTAMP + 1", "DATETIME", "(CURRENT_TIMESTAMP + 1)"), ("UUID()", "CHAR(36)", "(UUID())"), ("null", "LONGTEXT", "null"), ("(1 + 1)", "INT", "(1 + 1)"), ("'a' || 'b'", "VARCHAR(2)", "('a' || 'b')")])
def test_mysql_defaults(spark, text, kind, want):
    assert spark.range(1).select(definitions.mysql_default(F.lit(text), F.lit(kind)).alias("x")).first().x == want


def test_drops_of_each_database(spark):
    tables = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (3, "e")], "db int, table_name string")
    keys = spark.createDataFrame([(1, "a", "k", "b"), (3, "d", "k1", "e"), (3, "e", "k2", "d"), (3, "e", "k3", "e")], "db int, table_name string, object_name string, ref_table string")
    got = sorted(tuple(x) for x in ordering.drops(tables, keys, "db").collect())
    assert got == [(1, 0, "drop table", "a", ""), (1, 1, "drop table", "b", ""), (2, 0, "drop table", "c", ""), (3, 0, "drop foreign key", "d", "k1"), (3, 1, "drop foreign key", "e", "k2"), (3, 2, "drop table", "d", ""), (3, 3, "drop table", "e", "")]
    assert ordering.drops(tables.drop("db"), keys.drop("db")).count() == 7
