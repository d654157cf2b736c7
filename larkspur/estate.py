"""An estate of databases that grows with the given tables: each supplier keeps one, laid out by a template.

A template is a short list of catalog rows.  Each supplier has them with its number behind
the names, and lacks every eleventh, so that no two catalogs are alike and what is
compared, planned or mapped grows as the table of suppliers does.  Both engines read the
same estate: ``rows`` for Spark, ``relation`` for DuckDB.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ("table_name", "ref_table")
#: Distance of the ids of two suppliers.
STEP = 1000
LACKS = 11


def rows(spark: SparkSession, sf_dir: str, template: DataFrame, names: tuple[str, ...] = NAMES, ids: tuple[str, ...] = (), whole: bool = False, own: bool = False) -> DataFrame:
    """The template's rows for each supplier; all of them if ``whole``, with database and row_id if ``own``."""
    listed = [{"n_": i} | r.asDict() for i, r in enumerate(template.collect())]  # a literal's rows: no job runs
    kind = T.ArrayType(T.StructType([T.StructField("n_", T.IntegerType()), *template.schema.fields]))
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    cores = spark.sparkContext.defaultParallelism
    if suppliers.rdd.getNumPartitions() < cores:  # their file is small beside what is made of it: else one task has it all
        suppliers = suppliers.repartition(cores, "s_suppkey")
    every = suppliers.select("s_suppkey", F.inline(F.from_json(F.lit(json.dumps(listed)), kind)))
    if not whole:
        every = every.where(f"(s_suppkey + 3 * n_) % {LACKS} != 0")
    out = []
    for c, t in template.dtypes:
        value = F.col(f"`{c}`")
        if c in names:
            value = F.when(F.trim(value) != "", F.concat_ws("_", value, "s_suppkey")).otherwise(value)
        elif c in ids:
            value = (value + F.col("s_suppkey") * STEP).cast(t)
        out.append(value.alias(c))
    if own:
        out += [F.col("s_suppkey").alias("database"), (F.col("s_suppkey") * STEP + F.col("n_")).alias("row_id")]
    return every.select(*out)


def relation(values: str, columns: list[str], names: tuple[str, ...] = NAMES, ids: tuple[str, ...] = (), whole: bool = False, own: bool = False) -> str:
    """The same as a DuckDB subquery of a ``VALUES`` list."""
    out = []
    for c in columns:
        if c in names:
            out.append(f"CASE WHEN trim({c}) <> '' THEN {c} || '_' || s_suppkey ELSE {c} END AS {c}")
        elif c in ids:
            out.append(f"{c} + s_suppkey * {STEP} AS {c}")
        else:
            out.append(c)
    if own:
        out += ["s_suppkey AS database", f'(s_suppkey * {STEP} + n_)::BIGINT AS row_id']
    where = "" if whole else f" WHERE (s_suppkey + 3 * n_) % {LACKS} <> 0"
    return f"(SELECT {', '.join(out)} FROM supplier, (SELECT *, row_number() OVER () - 1 AS n_ FROM ({values}) AS v_({', '.join(columns)})) AS t_{where})"
