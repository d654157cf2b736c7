"""Checks, computed columns and defaults of many tables on another dialect.

What an expression means depends on its table's columns: whether 0 is a number or a truth
value, and + a sum.  The columns' classes are gathered for each table and joined to its
expressions; each distinct pair of text and classes is then translated once, in a task.
"""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import rewrites, texts

#: Classes that change what an expression means, by kind.
CLASSES = {"boolean": "boolean", "varchar": "textual", "char": "textual", "text": "textual", "json": "json", "array": "array"}


def class_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, c in CLASSES.items():
        out = F.when(kind == k, c).otherwise(out)
    return out


def column_classes(columns: DataFrame) -> DataFrame:
    """table_name and classes (lower-cased column name to class) of columns (table_name, column_name, kind); other columns have none."""
    one = columns.select("table_name", F.lower("column_name").alias("name"), class_of(F.col("kind")).alias("class")).where("class IS NOT NULL")
    # of names that differ in case only, one class counts
    each = one.groupBy("table_name", "name").agg(F.min("class").alias("class"))
    return each.groupBy("table_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "class")))).alias("classes"))


def _expression(key: str, target: str, source: str) -> str | None:
    facts = json.loads(key)
    return rewrites.translate(facts["text"], target, facts.get("classes"), source)


def _default(key: str, target: str, source: str) -> str | None:
    facts = json.loads(key)
    return rewrites.translate_default(facts["text"], target, facts.get("class", ""), facts.get("fsp"), source)


def translated(expressions: DataFrame, columns: DataFrame, target: str, text: str = "definition", source: str = "") -> DataFrame:
    """The expressions (table_name and ``text``) with ``translated``: null where the target can't say it."""
    key = F.to_json(F.struct(F.col(text).alias("text"), F.col("classes")))
    keyed = expressions.join(column_classes(columns), "table_name", "left").withColumn("key_", F.when(F.col(text).isNotNull(), key))
    return texts.applied(keyed, "key_", "translated", partial(_expression, target=target, source=source)).drop("key_", "classes")


def translated_defaults(columns: DataFrame, target: str, source: str = "") -> DataFrame:
    """Columns (default, kind, fsp) with ``translated``; null where the target can't say the default, or there is none."""
    key = F.to_json(F.struct(F.col("default").alias("text"), F.coalesce(class_of(F.col("kind")), F.lit("")).alias("class"), F.col("fsp")))
    keyed = columns.withColumn("key_", F.when(F.trim("default") != "", key))
    return texts.applied(keyed, "key_", "translated", partial(_default, target=target, source=source)).drop("key_")
