import pytest
from pyspark.sql import functions as F

from larkspur import catalog_queries, plan_queries
from larkspur.functions import texts
from larkspur.plans import api, changes, ordering

SF = "/root/testdata/sf0.001"


def test_keys_of_cycles_are_dropped_before_their_tables():
    refs = [("has", "desk", "drawer"), ("in", "drawer", "desk"), ("on", "lamp", "desk"), ("self", "lamp", "lamp")]
    assert ordering.drop_actions(["desk", "drawer", "lamp"], refs) == [("drop table", "lamp", ""), ("drop foreign key", "desk", "has"), ("drop foreign key", "drawer", "in"), ("drop table", "desk", ""), ("drop table", "drawer", "")]
    assert ordering.drop_actions([], refs) == []


def test_a_dialect_of_ones_own(spark):
    r = api.Registry()
    assert r.resolve(" PostgreSQL ") == "postgres"
    r.register("Mine", {"drop_table": lambda t, s, c: api.batch(F.concat(F.lit("GO AWAY "), F.col("table_name")))}, ("my own",))
    t = spark.createDataFrame([("a",)], "table_name string")
    assert [tuple(x) for x in r.apply("drop_table", t, "MY OWN").collect()] == [("a", 0, "GO AWAY a", False)]
    for bad in (lambda: r.resolve("none"), lambda: r.register("mine", {}), lambda: r.register("x", {}, ("",)), lambda: r.register("x", {}, ("pg",)), lambda: r.apply("truncate_table", t, "mine"), lambda: r.apply("drop_table", t, "mssql", cascade=True)):
        with pytest.raises(ValueError):
            bad()
    assert r.apply("truncate_table", t, "pg", "s", cascade=True).first().sql == 'TRUNCATE TABLE "s"."a" CASCADE'


def test_losses_are_judged_once_for_each_declaration(spark):
    """However many suppliers there are: the rules stand above the aggregate of distinct declarations, and nowhere else."""
    df = plan_queries.mapping_warnings(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    rules = [i for i, line in enumerate(plan) if "fractional seconds are cut" in line]
    assert len(rules) == 1 and any("HashAggregate" in line for line in plan[rules[0] :])


def test_rules_on_distinct_values_keep_nulls_and_repeats(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, 5), (4, "b", 5), (5, "b", 5)], "id int, x string, y int")
    rule = lambda d: d.select("*", F.explode(F.when(F.col("x") == "a", F.array(F.lit(1), F.lit(2))).when(F.col("x").isNull(), F.array(F.lit(3)))).alias("z"))
    assert sorted((r.id, r.z) for r in texts.once(t, ["x", "y"], rule).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def test_an_estates_rows_are_dealt_over_all_cores(spark):
    t = catalog_queries.fixture(spark, SF, catalog_queries.TYPES, catalog_queries.TYPE_COLUMNS, own=True)
    assert t.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_a_sync_plan_broadcasts_no_catalog(spark):
    """Catalogs that are made of small files look small, but no side of them may go through the driver."""
    plan = plan_queries.sync_plan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Scan parquet") <= 30
    by = lambda i, t, sql: (i, t, "foreign key", "fk", sql, "DROP fk", "u")
    names = "database int, table_name string, ordinal int, column_name string, type_text string, is_nullable boolean, default string, is_identity boolean, key_position int"
    columns = lambda *ts: spark.createDataFrame([(1, t, 1, "a", "int", True, None, False, None) for t in ts], names)
    objects = lambda *rows: spark.createDataFrame(rows, "database int, table_name string, kind string, object_name string, add_sql string, drop_sql string, ref_table string")
    old = {"columns": columns("t", "u"), "objects": objects(by(1, "t", None), by(1, "gone", "ADD"))}
    new = {"columns": columns("t", "v"), "objects": objects(by(1, "t", None), by(1, "v", "ADD v"))}
    for key in ("database", None):
        got = {(r.phase, r.seq, r.table_name, r.sql) for r in changes.sync_plan(old, new, "postgres", by=key)[0].collect()}
        want = {("add foreign key", 0, "t", None), ("add foreign key", 1, "v", "ADD v"), ("create table", 0, "v", 'CREATE TABLE "v" (\n  "a" int\n)'), ("drop foreign key", 0, "t", "DROP fk"), ("drop table", 0, "u", 'DROP TABLE IF EXISTS "u"')}
        assert got == want | ({("drop foreign key", 0, "gone", "DROP fk")} if key is None else set())
