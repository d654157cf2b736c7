"""Catalog readers: a database's own catalog relations joined to tables, columns, keys, indexes, references and checks.

The relations come as DataFrames (Parquet copies of a catalog, or JDBC reads of it), under
the names that each system gives to their columns.  All readers return relations of the
same columns, whatever the system; lists are arrays in key order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The letters that PostgreSQL stores for the actions of a foreign key.
ACTION_LETTERS = {"a": "NO ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT"}


def in_order(place: str, *columns: str) -> list[Column]:
    """Aggregates that list the columns by ``place``."""
    return [F.transform(F.sort_array(F.collect_list(F.struct(F.col(place).alias("place"), F.col(c).alias("value")))), lambda x: x["value"]).alias(c) for c in columns]


def _action(letter: str) -> Column:
    out = F.lit("NO ACTION")
    for k, name in ACTION_LETTERS.items():
        out = F.when(F.col(letter) == k, name).otherwise(out)
    return out


def _words(column: str) -> Column:
    """A PostgreSQL vector of numbers, such as ``2 5`` or ``{2,5}``, as an array."""
    return F.transform(F.split(F.trim(F.translate(column, "{},", "   ")), " +"), lambda x: x.cast("int"))


# tables


def base_tables(tables: DataFrame, schema: str) -> DataFrame:
    """table_name of the base tables of a schema, by name; views and other schemas are left out."""
    return tables.where((F.col("table_schema") == schema) & F.col("table_type").isin("BASE TABLE", "r")).select("table_name").orderBy("table_name")


# columns


def postgres_columns(columns: DataFrame, version: int) -> DataFrame:
    """Columns as PostgreSQL lists them: generated columns are known from version 12 on, identity from version 10 on; a sequence default is identity too."""
    sequence = F.coalesce(F.col("column_default"), F.lit("")).like("nextval%")
    identity = sequence | (F.col("is_identity") == "YES") if version >= 10 else sequence
    computed = F.col("is_generated") == "ALWAYS" if version >= 12 else F.lit(False)
    return _columns(columns, identity, computed, F.when(computed, F.col("generation_expression")))


def mysql_columns(columns: DataFrame) -> DataFrame:
    """Columns as MySQL lists them: what ``EXTRA`` and ``COLUMN_TYPE`` say is decoded."""
    extra = F.lower(F.coalesce(F.col("extra"), F.lit("")))
    computed = F.contains(extra, F.lit("generated")) & ~F.contains(extra, F.lit("default_generated"))
    base = _columns(columns.withColumn("data_type", declared_type(F.col("data_type"), F.col("column_type"))), F.contains(extra, F.lit("auto_increment")), computed, F.when(computed, F.col("generation_expression")), "extra", "column_type")
    return base.select(
        *[c for c in base.columns if c not in ("extra", "column_type")],
        F.contains(extra, F.lit("stored generated")).alias("computed_persisted"),
        is_unsigned(F.col("column_type")).alias("is_unsigned"),
        on_update(F.col("extra")).alias("on_update"),
        enum_values(F.col("column_type")).alias("enum_values"),
    )


def mssql_columns(columns: DataFrame) -> DataFrame:
    return _columns(columns, F.col("is_identity") == 1, F.lit(False), F.lit(None).cast("string"))


def _columns(columns: DataFrame, identity: Column, computed: Column, expression: Column, *more: str) -> DataFrame:
    # a sequence is how identity is kept, and not a default; nor is a computed column's expression
    default = F.when(identity | computed, F.lit(None).cast("string")).otherwise(F.col("column_default"))
    length, precision, scale = (F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("max_length", "precision", "scale"))
    return columns.select(
        "table_name", "ordinal", "column_name", "data_type", length, precision, scale, (F.col("is_nullable") == "YES").alias("is_nullable"), identity.alias("is_identity"), default.alias("default_expr"),
        computed.alias("is_computed"), expression.alias("computed_expr"), *more,
    )


def is_unsigned(column_type: Column) -> Column:
    return F.array_contains(F.split(F.lower(column_type), "[ ()]+"), "unsigned")


def declared_type(data_type: Column, column_type: Column) -> Column:
    """``tinyint(1)`` keeps its width, which says that it is a boolean."""
    return F.when(F.lower(column_type).rlike(r"^\s*tinyint\(1\)"), F.lit("tinyint(1)")).otherwise(data_type)


def on_update(extra: Column) -> Column:
    """The expression after ``on update``, empty without one."""
    return F.trim(F.regexp_extract(F.coalesce(extra, F.lit("")), r"(?i)on update\s+(.*)$", 1))


def enum_values(column_type: Column) -> Column:
    """The members of ``enum(...)`` or ``set(...)``: quotes are doubled or escaped by a backslash inside them; empty for other types."""
    inside = F.regexp_extract(column_type, r"(?is)^\s*(?:enum|set)\s*\((.*)\)\s*$", 1)
    quoted = F.regexp_extract_all(inside, F.lit(r"(?s)'((?:[^'\\]|''|\\.)*)'"), F.lit(1))
    return F.transform(quoted, lambda v: F.regexp_replace(F.replace(v, F.lit("''"), F.lit("'")), r"(?s)\\(.)", "$1"))


def mssql_computed(columns: DataFrame, system_columns: DataFrame, tables: DataFrame, computed: DataFrame) -> DataFrame:
    """The columns, with the definitions of those that are computed."""
    found = computed.join(system_columns, ["object_id", "column_id"]).join(tables.select("object_id", F.col("name").alias("table_name")), "object_id")
    found = found.select("table_name", F.col("name").alias("column_name"), "definition", "is_persisted")
    out = columns.drop("is_computed", "computed_expr").join(found, ["table_name", "column_name"], "left")
    return out.select(*[c for c in out.columns if c not in ("definition", "is_persisted")], F.col("definition").isNotNull().alias("is_computed"), F.col("definition").alias("computed_expr"), F.coalesce(F.col("is_persisted") == 1, F.lit(False)).alias("computed_persisted"))


def with_spatial(columns: DataFrame, spatial: DataFrame) -> DataFrame:
    """The columns with subtype and SRID of those that the spatial catalog has (0 and empty for others)."""
    out = columns.join(spatial.select("table_name", "column_name", "subtype", "srid"), ["table_name", "column_name"], "left")
    return out.withColumns({"subtype": F.coalesce("subtype", F.lit("")), "srid": F.coalesce("srid", F.lit(0))})


# primary keys


def postgres_primary_keys(constraints: DataFrame, classes: DataFrame, attributes: DataFrame) -> DataFrame:
    keys = constraints.where("contype = 'p'").select("conrelid", F.posexplode(_words("conkey")).alias("place", "attnum"))
    named = keys.join(attributes, (F.col("attrelid") == F.col("conrelid")) & (attributes["attnum"] == keys["attnum"])).join(classes, F.col("oid") == F.col("conrelid"))
    return named.groupBy(F.col("relname").alias("table_name")).agg(*in_order("place", "attname")).withColumnRenamed("attname", "columns")


def mysql_primary_keys(usage: DataFrame) -> DataFrame:
    return usage.where("constraint_name = 'PRIMARY'").groupBy("table_name").agg(*in_order("ordinal_position", "column_name")).withColumnRenamed("column_name", "columns")


def mssql_primary_keys(indexes: DataFrame, index_columns: DataFrame, system_columns: DataFrame, tables: DataFrame) -> DataFrame:
    parts = indexes.where("is_primary_key = 1").select("object_id", "index_id").join(index_columns, ["object_id", "index_id"]).join(system_columns, ["object_id", "column_id"])
    return parts.join(tables.select("object_id", F.col("name").alias("table_name")), "object_id").groupBy("table_name").agg(*in_order("key_ordinal", "name")).withColumnRenamed("name", "columns")


# indexes


def folded(parts: DataFrame) -> DataFrame:
    """Rows of index parts (table_name, index_name, is_unique, filter, place, part, is_expr, prefix, is_key) as one row an index.

    Flags of expressions and lengths of prefixes are empty lists if no part has any.
    """
    key = parts.where("is_key").groupBy("table_name", "index_name", "is_unique", "filter").agg(*in_order("place", "part", "is_expr", "prefix"))
    key = key.select("table_name", "index_name", "is_unique", "filter", F.col("part").alias("columns"), F.when(F.exists("is_expr", lambda x: x), F.col("is_expr")).otherwise(F.array().cast("array<boolean>")).alias("exprs"), F.when(F.exists("prefix", lambda x: x > 0), F.col("prefix")).otherwise(F.array().cast("array<int>")).alias("prefixes"))
    more = parts.where("not is_key").groupBy("table_name", "index_name").agg(*in_order("place", "part")).withColumnRenamed("part", "include_cols")
    return key.join(more, ["table_name", "index_name"], "left").withColumn("include_cols", F.coalesce("include_cols", F.array().cast("array<string>")))


def postgres_indexes(indexes: DataFrame, classes: DataFrame, attributes: DataFrame) -> DataFrame:
    """Primary keys are left out; parts beyond ``indnkeyatts`` are included only; part 0 is an expression."""
    parts = indexes.where("not indisprimary").select("indexrelid", "indrelid", "indisunique", "indnkeyatts", "predicate", "expressions", F.posexplode(_words("indkey")).alias("place", "attnum"))
    parts = parts.join(attributes.select(F.col("attrelid").alias("indrelid"), "attnum", "attname"), ["indrelid", "attnum"], "left")
    # the n-th expression of the index belongs to its n-th part 0
    nth = F.count_if(F.col("attnum") == 0).over(_by_place("indexrelid"))
    expression = F.get(F.split(F.coalesce("expressions", F.lit("")), ";"), (F.col("nth") - 1).cast("int"))
    parts = parts.withColumn("nth", nth).withColumn("part", F.when(F.col("attnum") == 0, expression).otherwise(F.col("attname")))
    named = parts.join(classes.select(F.col("oid").alias("indrelid"), F.col("relname").alias("table_name")), "indrelid").join(classes.select(F.col("oid").alias("indexrelid"), F.col("relname").alias("index_name")), "indexrelid")
    return folded(named.select("table_name", "index_name", F.col("indisunique").alias("is_unique"), F.coalesce("predicate", F.lit("")).alias("filter"), "place", "part", (F.col("attnum") == 0).alias("is_expr"), F.lit(0).alias("prefix"), (F.col("place") < F.col("indnkeyatts")).alias("is_key")))


def _by_place(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("place")


def mysql_indexes(statistics: DataFrame) -> DataFrame:
    """Old servers have no ``expression`` column; the primary key is left out."""
    expression = F.col("expression") if "expression" in statistics.columns else F.lit(None).cast("string")
    return folded(
        statistics.where("index_name <> 'PRIMARY'").select(
            "table_name", "index_name", (F.col("non_unique") == 0).alias("is_unique"), F.lit("").alias("filter"), F.col("seq_in_index").alias("place"), F.coalesce(F.col("column_name"), expression).alias("part"),
            (F.col("column_name").isNull() & expression.isNotNull()).alias("is_expr"), F.coalesce("sub_part", F.lit(0)).alias("prefix"), F.lit(True).alias("is_key"),
        )
    )


def mssql_indexes(indexes: DataFrame, index_columns: DataFrame, system_columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Primary keys and heaps are left out; included columns go by their id."""
    some = indexes.where("is_primary_key = 0 and index_id > 0").select("object_id", "index_id", F.col("name").alias("index_name"), (F.col("is_unique") == 1).alias("is_unique"), F.coalesce("filter_definition", F.lit("")).alias("filter"))
    parts = some.join(index_columns, ["object_id", "index_id"]).join(system_columns.withColumnRenamed("name", "part"), ["object_id", "column_id"]).join(tables.select("object_id", F.col("name").alias("table_name")), "object_id")
    key = F.col("is_included_column") == 0
    return folded(parts.select("table_name", "index_name", "is_unique", "filter", F.when(key, F.col("key_ordinal")).otherwise(F.col("column_id")).alias("place"), "part", F.lit(False).alias("is_expr"), F.lit(0).alias("prefix"), key.alias("is_key")))


# foreign keys and checks


def postgres_foreign_keys(constraints: DataFrame, classes: DataFrame, attributes: DataFrame) -> DataFrame:
    pairs = F.arrays_zip(_words("conkey").alias("mine"), _words("confkey").alias("theirs"))
    keys = constraints.where("contype = 'f'").select("conname", "conrelid", "confrelid", _action("confdeltype").alias("on_delete"), _action("confupdtype").alias("on_update"), F.posexplode(pairs).alias("place", "pair"))
    mine = attributes.select(F.col("attrelid").alias("conrelid"), F.col("attnum").alias("mine"), F.col("attname").alias("columns"))
    theirs = attributes.select(F.col("attrelid").alias("confrelid"), F.col("attnum").alias("theirs"), F.col("attname").alias("ref_columns"))
    keys = keys.withColumns({"mine": F.col("pair.mine"), "theirs": F.col("pair.theirs")}).join(mine, ["conrelid", "mine"]).join(theirs, ["confrelid", "theirs"])
    keys = keys.join(classes.select(F.col("oid").alias("conrelid"), F.col("relname").alias("table_name")), "conrelid").join(classes.select(F.col("oid").alias("confrelid"), F.col("relname").alias("ref_table")), "confrelid")
    return keys.groupBy("table_name", F.col("conname").alias("fk_name"), "ref_table", "on_delete", "on_update").agg(*in_order("place", "columns", "ref_columns"))


def mysql_foreign_keys(usage: DataFrame, references: DataFrame) -> DataFrame:
    keys = usage.where("referenced_table_name is not null").join(references, ["constraint_name", "table_name"])
    keys = keys.withColumnsRenamed({"column_name": "columns", "referenced_column_name": "ref_columns"})
    return keys.groupBy("table_name", F.col("constraint_name").alias("fk_name"), F.col("referenced_table_name").alias("ref_table"), F.col("delete_rule").alias("on_delete"), F.col("update_rule").alias("on_update")).agg(*in_order("ordinal_position", "columns", "ref_columns"))


def mssql_foreign_keys(keys: DataFrame, key_columns: DataFrame, system_columns: DataFrame, tables: DataFrame) -> DataFrame:
    mine = system_columns.select(F.col("object_id").alias("parent_object_id"), F.col("column_id").alias("parent_column_id"), F.col("name").alias("columns"))
    theirs = system_columns.select(F.col("object_id").alias("referenced_object_id"), F.col("column_id").alias("referenced_column_id"), F.col("name").alias("ref_columns"))
    parts = keys.join(key_columns, "constraint_object_id").join(mine, ["parent_object_id", "parent_column_id"]).join(theirs, ["referenced_object_id", "referenced_column_id"])
    parts = parts.join(tables.select(F.col("object_id").alias("parent_object_id"), F.col("name").alias("table_name")), "parent_object_id").join(tables.select(F.col("object_id").alias("referenced_object_id"), F.col("name").alias("ref_table")), "referenced_object_id")
    action = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    return parts.groupBy("table_name", "fk_name", "ref_table", action("delete_action").alias("on_delete"), action("update_action").alias("on_update")).agg(*in_order("constraint_column_id", "columns", "ref_columns"))


def checks(constraints: DataFrame, owners: DataFrame, name: str, definition: str, key: list[str]) -> DataFrame:
    """table_name, check_name and definition: the constraints joined to the relation that names their tables."""
    return constraints.join(owners, key).select("table_name", F.col(name).alias("check_name"), F.col(definition).alias("definition")).orderBy("table_name", "check_name")


# statistics


def row_count_or_exact(fast: DataFrame, exact: DataFrame) -> DataFrame:
    """row_count from statistics; the exact count where they have none or none above zero."""
    out = exact.join(fast, "table_name", "left")
    return out.select("table_name", F.when(F.col("fast") > 0, F.col("fast")).otherwise(F.col("row_count")).alias("row_count"))


def average_row_bytes(pages: DataFrame, page_bytes: int = 1) -> DataFrame:
    """Bytes of a table (``pages`` units of it, summed) a row, rounded down; tables without rows are left out."""
    sums = pages.groupBy("table_name").agg(F.sum("pages").alias("pages"), F.sum("row_count").alias("row_count")).where("row_count > 0")
    return sums.select("table_name", F.expr(f"pages * {page_bytes} div row_count").alias("avg_bytes"))


def widened(estimates: DataFrame, averages: DataFrame) -> DataFrame:
    """row_bytes of the estimate, or the catalog's average if that is greater."""
    return estimates.join(averages, "table_name", "left").select("table_name", F.greatest("row_bytes", F.coalesce("avg_bytes", F.lit(0))).cast("bigint").alias("row_bytes"))


# existence


def existing(wanted: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """The wanted objects that are there already, names in any case; others are to be made."""
    there = live.select(*[F.lower(c).alias(f"_{c}") for c in key]).distinct()
    on = [F.lower(wanted[c]) == F.col(f"_{c}") for c in key]
    return wanted.join(there, on, "left").select(*wanted.columns, F.col(f"_{key[0]}").isNotNull().alias("is_there"))
