"""Catalogs as relations: Parquet tables, Spark catalogs and databases over JDBC."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import types

COLUMNS = "table_name string, ordinal int, column_name string, data_type string, is_nullable boolean"

#: The catalog query of each database, for all tables of a schema at once.
JDBC_COLUMNS = {
    "postgres": "select table_name, ordinal_position, column_name, data_type, character_maximum_length, numeric_precision, numeric_scale, datetime_precision, is_nullable, column_default, is_identity from information_schema.columns where table_schema = '{schema}'",
    "mysql": "select table_name, ordinal_position, column_name, column_type as data_type, character_maximum_length, numeric_precision, numeric_scale, datetime_precision, is_nullable, column_default, extra from information_schema.columns where table_schema = '{schema}'",
    "mssql": "select table_name, ordinal_position, column_name, data_type, character_maximum_length, numeric_precision, numeric_scale, datetime_precision, is_nullable, column_default from information_schema.columns where table_schema = '{schema}'",
}


def opened(spark: SparkSession, sf_dir: str, tables: list[str]) -> dict[str, DataFrame]:
    """The tables by name.  Each table's footers are read by a job of its own, so some are opened at once."""
    with ThreadPoolExecutor(8) as pool:
        return dict(zip(tables, pool.map(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), tables)))


def parquet_columns(spark: SparkSession, sf_dir: str, tables: list[str]) -> DataFrame:
    """One row for each column of the tables; only file footers are read."""
    rows = []
    for name, df in sorted(opened(spark, sf_dir, tables).items()):
        for i, f in enumerate(df.schema):
            rows.append((name, i + 1, f.name, f.dataType.simpleString(), f.nullable))
    return spark.createDataFrame(rows, COLUMNS)


def jdbc_columns(spark: SparkSession, dialect: str, url: str, schema: str, **options: str) -> DataFrame:
    """The columns of a database's schema, in one scan."""
    query = JDBC_COLUMNS[dialect].format(schema=schema.replace("'", "''"))
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def row_counts(spark: SparkSession, sf_dir: str, tables: list[str]) -> DataFrame:
    """Exact row counts, one scan of footers for each table."""
    out = None
    for name, df in sorted(opened(spark, sf_dir, tables).items()):
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionAll(one)
    return out


def row_bytes(data_type: Column) -> Column:
    """Estimated bytes of a value: 16 of overhead and its type's own."""
    own = F.when(data_type.isin("boolean", "tinyint"), 1).when(data_type == "smallint", 2).when(data_type.isin("int", "float", "date"), 4).when(data_type.isin("bigint", "double"), 8).when(data_type.startswith("timestamp"), 24)
    return F.lit(16) + own.otherwise(4096)


#: Type names by how their values are held in memory.
HELD = {
    "scalar": "int integer bigint smallint tinyint int2 int4 int8 serial bigserial smallserial mediumint float real double float4 float8 money smallmoney bit bool boolean",
    "decimal": "decimal numeric number", "time": "date time datetime datetime2 datetimeoffset smalldatetime timestamp timestamptz timetz", "uuid": "uniqueidentifier uuid",
    "binary": "image bytea blob mediumblob longblob varbinary binary tinyblob", "text": "text ntext mediumtext longtext json jsonb xml varchar nvarchar char nchar tinytext character",
    "spatial": "geometry geography point linestring polygon multipoint multilinestring multipolygon geometrycollection",
}
#: Bytes of headers, of a value of unknown length, of a spatial value; the longest length that counts.
TEXT_HEADER, BYTES_HEADER, UNKNOWN, SPATIAL, MOST = 16, 24, 4096, 512, 8000


def declared_bytes(data_type: Column, length: Column, precision: Column) -> Column:
    """Estimated bytes of a value of a declared type, without the slot that holds it."""
    names = F.create_map(*[F.lit(x) for held, words in HELD.items() for w in words.split() for x in (w, held)])
    held = F.try_element_at(names, types.base_name(data_type))
    n = F.coalesce(length, F.lit(0)).cast("long")
    data = F.when((n <= 0) | (n > MOST), UNKNOWN).otherwise(n)
    digits = F.greatest(F.coalesce(precision, F.lit(0)) + 2, F.lit(20))
    return (
        F.when(held == "decimal", TEXT_HEADER + digits).when(held == "time", 24).when(held == "uuid", TEXT_HEADER + 36).when(held == "binary", BYTES_HEADER + data)
        .when(held == "text", TEXT_HEADER + data).when(held == "spatial", TEXT_HEADER + SPATIAL).otherwise(8).cast("long")
    )


def declared_row_bytes(columns: DataFrame) -> DataFrame:
    """Estimated bytes of a row of each table (table_name, data_type, length, precision): 24, 16 for each column, and its values."""
    value = declared_bytes(F.col("data_type"), F.col("length"), F.col("precision"))
    return columns.groupBy("table_name").agg(F.count("*").alias("n_columns"), (F.lit(24) + F.sum(value + 16)).alias("row_bytes"))


def health(tables: DataFrame, counts: DataFrame) -> DataFrame:
    """n_tables, n_empty and row_count of each database (database, table_name) of tables with counts (table_name, row_count); tables that aren't counted are unknown."""
    both = tables.join(counts, "table_name", "left")
    return both.groupBy("database").agg(F.count("*").alias("n_tables"), F.count_if(F.col("row_count") == 0).alias("n_empty"), F.count_if(F.col("row_count").isNull()).alias("n_unknown"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"))


def sizes(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """Estimated bytes of a row (24 and its values) and of each table."""
    width = columns.groupBy("table_name").agg((F.lit(24) + F.sum(row_bytes(F.col("data_type")))).alias("row_bytes"), F.count("*").alias("n_columns"))
    return width.join(rows, "table_name").withColumn("table_bytes", F.col("row_bytes") * F.col("row_count"))


def weighted_row_bytes(table_sizes: DataFrame) -> DataFrame:
    """The average row size, weighted by rows, and the table with the widest rows."""
    known = table_sizes.where("row_bytes > 0")
    return known.agg(F.expr("sum(row_bytes * row_count) div sum(row_count)").alias("avg_row_bytes"), F.max_by("table_name", F.struct("row_bytes", "table_name")).alias("widest"))


#: Types of keys by which a table can be read in pages.
PAGED = ("int", "bigint", "smallint", "tinyint", "integer", "serial", "bigserial", "smallserial", "int2", "int4", "int8")


def key_facts(columns: DataFrame, counts: DataFrame, threshold: int) -> DataFrame:
    """Whether each table has a key, of one column, whether it is large, and whether its key allows reading in pages."""
    keys = columns.groupBy("table_name").agg(F.count("key_position").cast("int").alias("key_size"), F.max(F.when(F.col("key_position").isNotNull(), F.lower("data_type"))).alias("key_type"))
    single = F.col("key_size") == 1
    return keys.join(counts, "table_name").select(
        "table_name", "key_size", (F.col("key_size") > 0).alias("has_key"), single.alias("has_single_key"), (F.col("row_count") > threshold).alias("is_large"), (single & F.coalesce(F.col("key_type").isin(*PAGED), F.lit(False))).alias("supports_keyset")
    )


def key_columns(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """The columns (table_name, column_name, ...) of each table's key (table_name, columns in the key's order), with their place in it.

    Names are matched in their own case; a name of the key that no column has gives no row.
    """
    each = keys.select("table_name", F.posexplode("columns").alias("place", "column_name"))
    return each.join(columns, ["table_name", "column_name"])


def artifact(columns: DataFrame) -> DataFrame:
    """The columns of each table as JSON, in order."""
    facts = [c for c in columns.columns if c != "table_name"]
    return columns.groupBy("table_name").agg(F.to_json(F.sort_array(F.collect_list(F.struct("ordinal", *[c for c in facts if c != "ordinal"])))).alias("columns"))


def from_artifact(artifacts: DataFrame, facts: str = "ordinal int, column_name string, data_type string") -> DataFrame:
    """The columns that ``artifact`` wrote; facts that an older artifact doesn't have are null."""
    return artifacts.select("table_name", F.inline(F.from_json("columns", f"array<struct<{', '.join(':'.join(f.split()) for f in facts.split(', '))}>>")))


def references(columns: DataFrame) -> DataFrame:
    """References that names tell of: a column named as the first column of a table that its stem names.

    Prefixes of one or two letters don't count, and the stem is what precedes ``key`` or
    ``_id``: ``o_custkey`` references the first column ``c_custkey`` of ``customer``.
    """
    base = F.regexp_replace("column_name", r"^[a-z]{1,2}_", "")
    stem = F.regexp_replace("base", "(key|_id)$", "")
    child = columns.select("table_name", "column_name", base.alias("base"))
    parent = columns.where("ordinal = 1").select(F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"), base.alias("base"))
    parent = parent.where(F.col("ref_table").startswith(stem) & (stem != F.col("base")))
    return child.join(parent, "base").where("table_name != ref_table").select("table_name", "column_name", "ref_table", "ref_column")
