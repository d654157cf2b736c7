"""Whole column and table definitions from facts, for five dialects.

A column's facts: column_name, type_text, is_nullable, is_identity, default and on_update
(the target's text), computed (the expression's text), persisted.  Missing facts count as
null.  What a dialect can't say is a violation, not a guess (``violations``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.plans import ddl

#: What makes a column number itself.
IDENTITY = {"postgres": " GENERATED BY DEFAULT AS IDENTITY", "mssql": " IDENTITY(1,1)", "mysql": " AUTO_INCREMENT"}
FACTS = {"column_name": "string", "type_text": "string", "is_nullable": "boolean", "is_identity": "boolean", "default": "string", "on_update": "string", "computed": "string", "persisted": "boolean", "key_position": "int"}


def with_facts(columns: DataFrame) -> DataFrame:
    """The columns with every fact: those that are missing are null, flags false."""
    out = {c: F.lit(None).cast(t) for c, t in FACTS.items() if c not in columns.columns}
    out |= {c: F.coalesce(F.col(c), F.lit(c == "is_nullable")) for c, t in FACTS.items() if t == "boolean" and c in columns.columns}
    out |= {c: F.lit(c == "is_nullable") for c, t in FACTS.items() if t == "boolean" and c not in columns.columns}
    return columns.withColumns(out)


def given(name: str) -> Column:
    """A fact's text without blanks around it; null if there is none."""
    text = F.trim(F.col(name))
    return F.when(text != "", text)


def literal(text: Column) -> Column:
    return text.rlike(r"^'([^']|'')*'$") | text.rlike(r"^-?[0-9]+([.][0-9]+)?$")


def mysql_default(text: Column, type_text: Column) -> Column:
    """A default as MySQL takes it: expressions in parentheses, and literals of texts, blobs, JSON and GEOMETRY too."""
    base = F.upper(F.trim(F.regexp_replace(type_text, r"\(.*", "")))
    by_expression = base.isin("JSON", "GEOMETRY") | base.endswith("TEXT") | base.endswith("BLOB")
    bare = (F.upper(text) == "NULL") | F.upper(text).rlike(r"^CURRENT_TIMESTAMP(\([0-9]*\))?$") | literal(text) & ~by_expression | text.startswith("(")
    return F.when(bare, text).otherwise(F.concat(F.lit("("), text, F.lit(")")))


def default_text(target: str) -> Column:
    text = given("default")
    return mysql_default(text, F.col("type_text")) if target == "mysql" else text


def composite(type_text: Column) -> Column:
    """Whether a ClickHouse type can't be inside Nullable."""
    return F.lower(type_text).rlike(r"^\s*((nullable|lowcardinality)\(\s*)*(array|map)\(")


def column(target: str) -> Column:
    """The definition of a column with the facts of ``with_facts``; null where ``violations`` has something to say."""
    name, kind, lit = ddl.quoted(F.col("column_name"), target), F.col("type_text"), F.lit
    not_null = F.when(F.col("is_nullable"), "").otherwise(" NOT NULL")
    if target == "clickhouse":
        nullable = F.when(~composite(kind), F.concat(lit("Nullable("), kind, lit(")")))
        return F.concat(name, lit(" "), F.when(F.col("is_nullable"), nullable).otherwise(kind))
    default = F.when(~F.col("is_identity"), F.concat(lit(" DEFAULT "), default_text(target)))
    parts = [name, lit(" "), kind, F.when(F.col("is_identity"), IDENTITY.get(target, "")).otherwise("")]
    parts += [F.when(F.col("is_identity") & lit(target == "postgres"), "").otherwise(not_null), F.coalesce(default, lit(""))]
    if target == "mysql":
        parts.append(F.coalesce(F.when(~F.col("is_identity"), F.concat(lit(" ON UPDATE "), mysql_default(given("on_update"), kind))), lit("")))
    plain, expression = F.concat(*parts), F.concat(lit(" AS ("), given("computed"), lit(")"))
    computed = {
        "postgres": F.concat(name, lit(" "), kind, lit(" GENERATED ALWAYS"), expression, lit(" STORED"), not_null),
        "mssql": F.concat(name, expression, F.when(F.col("persisted"), " PERSISTED").otherwise(""), not_null),
        "mysql": F.concat(name, lit(" "), kind, lit(" GENERATED ALWAYS"), expression, F.when(F.col("persisted"), " STORED").otherwise(" VIRTUAL"), not_null),
    }.get(target, F.lit(None).cast("string"))
    return F.when(F.col("computed").isNotNull(), computed).otherwise(plain)


def violations(target: str) -> Column:
    """What of a column the dialect can't define, in order."""
    rules = [(F.col("type_text").isNull(), "no type"), (F.col("computed").isNotNull() & given("computed").isNull(), "computed column without expression")]
    if target not in ("postgres", "mssql", "mysql"):
        rules.append((F.col("computed").isNotNull(), "no computed columns"))
    if target == "clickhouse":
        rules += [(F.col("is_nullable") & composite(F.col("type_text")), "nullable array or map"), (F.col("is_nullable") & F.col("key_position").isNotNull(), "nullable key column")]
        rules += [(F.col("is_identity"), "no identity"), (given("default").isNotNull(), "no defaults")]
    return F.array_compact(F.array(*[F.when(when, why) for when, why in rules]))


def create_tables(columns: DataFrame, target: str, schema: str = "") -> DataFrame:
    """table_name, sql (null if a column can't be defined) and violations (``column: reason``) of each table.

    ``columns`` has table_name, ordinal and facts.  SQLite's sole key column, if it is an
    identity, is the key in its own definition, as only so it numbers itself.
    """
    c = with_facts(columns)
    parts = c.groupBy("table_name").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "column_name", F.col("is_identity"), F.col("key_position").isNotNull().alias("is_key"), column(target).alias("text"), violations(target).alias("why")))).alias("cs"),
        F.sort_array(F.collect_list(F.when(F.col("key_position").isNotNull(), F.struct("key_position", "column_name")))).alias("keys"),
    )
    key = ddl.listed(F.transform("keys", lambda k: k["column_name"]), target)
    inline = (F.size("keys") == 1) & F.exists("cs", lambda x: x["is_key"] & x["is_identity"]) & F.lit(target == "sqlite")
    line = lambda x: F.when(inline & x["is_key"], F.concat(ddl.quoted(x["column_name"], target), F.lit(" INTEGER PRIMARY KEY AUTOINCREMENT"))).otherwise(x["text"])
    lines = F.array_join(F.transform("cs", lambda x: F.concat(F.lit("    "), line(x))), ",\n")
    named = F.lit("    PRIMARY KEY (") if target == "clickhouse" else F.concat(F.lit("    CONSTRAINT "), ddl.quoted(F.concat(F.lit("pk_"), F.col("table_name")), target), F.lit(" PRIMARY KEY ("))
    keyed = F.when((F.size("keys") > 0) & ~inline, F.concat(F.lit(",\n"), named, key, F.lit(")"))).otherwise("")
    tail = F.lit(" ENGINE=InnoDB DEFAULT CHARSET=utf8mb4" if target == "mysql" else "")
    if target == "clickhouse":
        tail = F.concat(F.lit(" ENGINE = MergeTree ORDER BY "), F.when(F.size("keys") > 0, F.concat(F.lit("("), key, F.lit(")"))).otherwise("tuple()"))
    why = F.flatten(F.transform("cs", lambda x: F.transform(x["why"], lambda w: F.concat(x["column_name"], F.lit(": "), w))))
    sql = F.concat(F.lit("CREATE TABLE "), ddl.qualified(schema, F.col("table_name"), target), F.lit(" (\n"), lines, keyed, F.lit("\n)"), tail)
    return parts.select("table_name", F.when(F.size(why) == 0, sql).alias("sql"), why.alias("violations"))


def alter_type(target: str, schema: str = "") -> Column:
    """Changes a column's type to that of its facts, and nothing else of it.

    MySQL repeats the whole definition, as it would drop what is left out; SQL Server
    repeats the nullability, as a column without one becomes nullable.
    """
    ddl.need(target, "alter_column")
    head = F.concat(F.lit("ALTER TABLE "), ddl.qualified(schema, F.col("table_name"), target))
    name = ddl.quoted(F.col("column_name"), target)
    if target == "mysql":
        return F.concat(head, F.lit(" MODIFY COLUMN "), column(target))
    if target == "mssql":
        return F.concat(head, F.lit(" ALTER COLUMN "), name, F.lit(" "), F.col("type_text"), F.when(F.col("is_nullable"), " NULL").otherwise(" NOT NULL"))
    return F.concat(head, F.lit(" ALTER COLUMN "), name, F.lit(" TYPE "), F.col("type_text"))


def alter_nullability(target: str, schema: str = "") -> Column:
    """Makes a column nullable or not, as its facts say."""
    if target != "postgres":
        return alter_type(target, schema)
    head = F.concat(F.lit("ALTER TABLE "), ddl.qualified(schema, F.col("table_name"), target))
    return F.concat(head, F.lit(" ALTER COLUMN "), ddl.quoted(F.col("column_name"), target), F.when(F.col("is_nullable"), " DROP NOT NULL").otherwise(" SET NOT NULL"))
