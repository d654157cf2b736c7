"""The text of tables that are there, from what the catalog readers give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.plans import ddl


def type_text() -> Column:
    """data_type with its length, or with precision and scale, where there are any."""
    n, p, s = (F.coalesce(F.col(c), F.lit(0)) for c in ("max_length", "precision", "scale"))
    sized = lambda *args: F.concat(F.col("data_type"), F.lit("("), F.concat_ws(",", *[a.cast("string") for a in args]), F.lit(")"))
    return F.when(n > 0, sized(n)).when((p > 0) & (s > 0), sized(p, s)).when(p > 0, sized(p)).otherwise(F.col("data_type"))


def table_ddl(columns: DataFrame, keys: DataFrame, indexes: DataFrame, foreign_keys: DataFrame, checks: DataFrame, target: str, schema: str = "") -> DataFrame:
    """table_name and sql of each table that has columns: CREATE TABLE, then its key, indexes, references and checks by name.

    Columns are those of the column readers; keys have table_name and columns; the others
    table_name, a name and their facts, as the readers give them.  Each relation is
    grouped by table once, and the groups are joined: nothing is looked up table by table.
    """
    line = F.concat(F.lit("    "), ddl.quoted(F.col("column_name"), target), F.lit(" "), type_text(), F.when(F.col("is_nullable"), "").otherwise(" NOT NULL"), F.when(F.coalesce("default_expr", F.lit("")) != "", F.concat(F.lit(" DEFAULT "), F.col("default_expr"))).otherwise(""))
    ordered = lambda order, text: F.transform(F.sort_array(F.collect_list(F.struct(order, text.alias("text")))), lambda x: x["text"])
    body = columns.groupBy("table_name").agg(F.array_join(ordered("ordinal", line), ",\n").alias("body"))
    head = F.concat(F.lit("CREATE TABLE "), ddl.qualified(schema, F.col("table_name"), target), F.lit(" (\n"), F.col("body"), F.lit("\n);"))
    named = keys.withColumn("constraint_name", F.concat(F.lit("pk_"), F.col("table_name")))
    more = [
        named.select("table_name", F.lit(0).alias("part"), F.col("constraint_name").alias("name"), ddl.add_constraint("primary_key", target, schema).alias("text")),
        indexes.select("table_name", F.lit(1), "index_name", ddl.create_index(target, schema)),
        foreign_keys.withColumn("constraint_name", F.col("fk_name")).select("table_name", F.lit(2), "fk_name", ddl.add_constraint("foreign_key", target, schema)),
        checks.withColumn("constraint_name", F.col("check_name")).select("table_name", F.lit(3), "check_name", ddl.add_constraint("check", target, schema)),
    ]
    every = more[0]
    for one in more[1:]:
        every = every.unionAll(one)
    rest = every.groupBy("table_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "name", F.concat("text", F.lit(";")).alias("text")))), lambda x: x["text"]), "\n").alias("rest"))
    return body.join(rest, "table_name", "left").select("table_name", F.concat(head, F.coalesce(F.concat(F.lit("\n"), F.col("rest")), F.lit(""))).alias("sql"))
