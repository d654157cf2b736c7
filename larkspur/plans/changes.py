"""From differences of columns and objects to the statements of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.plans import ddl, definitions, ordering

#: Criteria of a drift that stand for a change of the type.
TYPE_CRITERIA = ("type", "max_length", "precision", "scale", "tz_class")
#: Attributes that no statement changes, by the columns that hold them.
ATTRIBUTES = ("on_update", "srid", "display_width", "enum_values")
STATEMENT = "struct<description:string,risk:string,note:string,sql:string>"


def filled(text: Column) -> Column:
    """Whether a text is there and not blank."""
    return F.trim(F.coalesce(text, F.lit(""))) != ""


def _statement(description: Column, risk: Column, note: Column, sql: Column) -> Column:
    return F.struct(description.alias("description"), risk.alias("risk"), note.cast("string").alias("note"), sql.alias("sql"))


def expanded(changes: DataFrame, target: str, schema: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """The statements that change columns, in order (``place``), with what no statement can do as risk ``unsupported``.

    ``changes`` has table_name, column_name, and type, nullable and default before (``old_``) and
    after (``new_``), types and defaults as the target's text.  ``criteria``, if there and not
    empty, says what differs instead; ``attributes`` names the other attributes that differ.

    A default goes before its column's type changes, and in SQL Server before it is replaced.
    Other facts of ``definitions`` that are there (identity, on_update) are kept where MySQL
    repeats the definition.  Columns of ``keep`` stay.
    """
    criteria = F.coalesce("criteria", F.array().cast("array<string>")) if "criteria" in changes.columns else F.array().cast("array<string>")
    attributes = F.col("attributes") if "attributes" in changes.columns else F.array().cast("array<string>")

    def differs(found: Column, *names: str) -> Column:
        return F.when(F.size(criteria) > 0, F.arrays_overlap(criteria, F.array(*map(F.lit, names)))).otherwise(found)

    had, has = filled(F.col("old_default")), filled(F.col("new_default"))
    retyped = differs(F.col("old_type") != F.col("new_type"), *TYPE_CRITERIA)
    nulls = differs(F.col("old_nullable") != F.col("new_nullable"), "nullability")
    defaults = differs(F.trim(F.coalesce("old_default", F.lit(""))) != F.trim(F.coalesce("new_default", F.lit(""))), "default")
    first = had & (retyped | F.lit(target == "mssql") & defaults)
    again = defaults | first
    rows = definitions.with_facts(changes.withColumns({"type_text": F.col("new_type"), "is_nullable": F.col("new_nullable"), "default": F.col("new_default")}))
    name, none = F.col("column_name"), F.lit(None)
    says = lambda verb, what: F.concat(F.lit(f"{verb} column "), name, F.lit(f" {what}"))
    safe, drops = F.lit("safe"), ddl.drop_default(target, schema)
    found = F.array_compact(
        F.array(
            F.when(first, _statement(says("drop", "default"), safe, none, drops)),
            F.when(retyped, _statement(says("change", "type"), F.lit("rebuild"), F.lit("may rewrite the table; fails on values that can't be cast"), definitions.alter_type(target, schema))),
            F.when(nulls, _statement(says("change", "nullability"), F.when(F.col("new_nullable"), "safe").otherwise("blocking"), F.when(~F.col("new_nullable"), "checks the rows that are there"), definitions.alter_nullability(target, schema))),
            F.when(again & ~has & ~first, _statement(says("drop", "default"), safe, none, drops)),
            F.when(again & has, _statement(says("change", "default"), safe, none, F.element_at(ddl.set_default(target, schema), -1))),
        )
    )
    why = F.concat_ws(", ", F.when(F.size(attributes) > 0, attributes).otherwise(criteria))
    cannot = F.array(_statement(F.concat(F.lit("change column "), name), F.lit("unsupported"), F.concat(F.lit(f"no statement on {target} for: "), why), none.cast("string")))
    return rows.select(*keep, "table_name", "column_name", F.posexplode_outer(F.when(F.size(found) > 0, found.cast(f"array<{STATEMENT}>")).otherwise(cannot.cast(f"array<{STATEMENT}>"))).alias("place", "s")).select(*keep, "table_name", "column_name", "place", "s.*")


PLAN = ("phase", "seq", "table_name", "step", "object_name", "place", "risk", "note", "description", "sql")
#: Facts of the columns and objects that a plan compares.
COLUMN_FACTS = ("ordinal", "type_text", "is_nullable", "default", "is_identity", "key_position")
OBJECT_FACTS = ("drop_sql", "ref_table")


def _sides(old: DataFrame, new: DataFrame, keys: list[str], facts: tuple[str, ...]) -> DataFrame:
    """A row for each key of both, dealt by table, with its facts before and after as structs ``o`` and ``n``: null where it isn't there."""
    both = old.select(*keys, *facts, F.lit(False).alias("is_new")).unionAll(new.select(*keys, *facts, F.lit(True)))
    fact = F.struct(*facts)
    return both.repartition("table_name").groupBy(*keys).agg(F.max(F.when(~F.col("is_new"), fact)).alias("o"), F.max(F.when(F.col("is_new"), fact)).alias("n"))


def sync_plan(old: dict[str, DataFrame], new: dict[str, DataFrame], target: str, schema: str = "", by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The statements that make ``old`` into ``new``, for ``ordering.ordered``, and what is unsupported.

    Both hold ``columns`` (table_name, ordinal, column_name, type_text, is_nullable, default,
    is_identity, key_position) and ``objects`` (table_name, kind, object_name, add_sql, drop_sql,
    ref_table), where kind is index, check or foreign key.  An object whose text differs is
    dropped and added.  Adding objects blocks; dropping tables and columns loses data.

    ``by`` is a column of both that names the database of a table (of names that no other
    database has): the results have it too, and each database's drops are ordered apart.

    Old and new rows are put together by grouping and windows on the table, not by joins of
    the catalogs.  The joins that are left sort and merge by hint: catalogs that are made of
    small files look small to Spark, and would go through the driver.
    """
    own, lit, no_note = [by] * (by is not None), F.lit, F.lit(None).cast("string")
    sides = _sides(old["columns"], new["columns"], [*own, "table_name", "column_name"], COLUMN_FACTS)
    table = Window.partitionBy(*own, "table_name")
    was, stays = F.max(F.col("o").isNotNull()), F.max(F.col("n").isNotNull())
    columns = sides.withColumns({"was": was.over(table), "stays": stays.over(table)})
    tables = sides.groupBy(*own, "table_name").agg(was.alias("was"), stays.alias("stays"))
    of_new = columns.where("n IS NOT NULL").select(*own, "table_name", "column_name", "was", F.col("o").isNull().alias("is_added"), "n.*")

    def rows(df: DataFrame, phase: Column, step: Column, name: Column, risk: Column, note: Column, description: Column, sql: Column, seq: Column | None = None, place: Column | None = None) -> DataFrame:
        zero = F.lit(0)
        return df.select(phase.alias("phase"), (zero if seq is None else seq).alias("seq"), "table_name", step.alias("step"), name.alias("object_name"), (zero if place is None else place).alias("place"), risk.alias("risk"), note.alias("note"), description.alias("description"), sql.alias("sql"), *own)

    says = lambda word, c: F.concat(F.lit(word + " "), F.col(c))
    definition = ddl.column_definition(F.col("column_name"), F.col("type_text"), F.col("is_nullable"), F.col("default"), target)
    creates = ddl.create_tables(of_new.where("NOT was").withColumn("definition", definition), target, schema, tuple(own))
    out = rows(creates, lit("create table"), lit(""), F.col("table_name"), lit("safe"), no_note, says("create table", "table_name"), F.col("sql"))

    risk = ordering.add_column_risk(F.col("is_nullable"), filled(F.col("default")), F.col("is_identity"))
    added = of_new.where("was AND is_added").withColumn("definition", definition).withColumn("risk", risk)
    out = out.unionAll(rows(added, lit("change table"), lit("add column"), F.col("column_name"), F.col("risk"), F.when(F.col("risk") == "blocking", "needs a value for the rows that are there"), says("add column", "column_name"), ddl.add_column(target, schema)))
    dropped = columns.where("stays AND n IS NULL")
    out = out.unionAll(rows(dropped, lit("change table"), lit("drop column"), F.col("column_name"), lit("data-loss"), lit("drops the column's data"), says("drop column", "column_name"), ddl.drop("column", target, schema)))
    facts = lambda side, name: [F.col(f"{side}.{c}").alias(f"{name}_{c.removeprefix('is_').removesuffix('_text')}") for c in ("type_text", "is_nullable", "default")]
    pairs = sides.where("o IS NOT NULL AND n IS NOT NULL").select(*own, "table_name", "column_name", *facts("o", "old"), *facts("n", "new"))
    differ = (F.col("old_type") != F.col("new_type")) | (F.col("old_nullable") != F.col("new_nullable")) | ~F.col("old_default").eqNullSafe(F.col("new_default"))
    changed = expanded(pairs.where(differ), target, schema, tuple(own))
    out = out.unionAll(rows(changed.where("risk <> 'unsupported'"), lit("change table"), lit("change column"), F.col("column_name"), F.col("risk"), F.col("note"), F.col("description"), F.col("sql"), place=F.col("place")))
    unsupported = changed.where("risk = 'unsupported'").select("table_name", "description", F.col("note").alias("reason"), *own)
    key = lambda side: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(f"{side}.key_position").isNotNull(), F.struct(F.col(f"{side}.key_position").alias("at"), "column_name")))), lambda k: k["column_name"]), ",")
    rekeyed = sides.groupBy(*own, "table_name").agg(was.alias("was"), stays.alias("stays"), key("o").alias("before"), key("n").alias("after")).where("was AND stays AND before <> after")
    unsupported = unsupported.unionAll(rekeyed.select("table_name", lit("change primary key").alias("description"), F.concat(lit("from ("), "before", lit(") to ("), "after", lit(")")).alias("reason"), *own))

    on = ["table_name", "kind", "object_name", "add_sql"]
    objects = _sides(old["objects"], new["objects"], on, OBJECT_FACTS).join(tables.hint("merge"), "table_name", "inner" if own else "left")
    objects = objects.withColumns({"made": F.coalesce(~F.col("was"), lit(False)), "gone": F.coalesce(~F.col("stays"), lit(False))})
    is_key, unlike = F.col("kind") == "foreign key", F.col("add_sql").isNull()
    describe = lambda verb: F.concat(lit(verb + " "), F.col("kind"), lit(" "), F.col("object_name"))
    step = lambda verb, when: F.when(when, F.concat(lit(verb + " "), F.col("kind"))).otherwise("")
    drops = objects.where(F.col("o").isNotNull() & (F.col("n").isNull() | unlike) & ~F.col("gone"))  # others go with their tables
    out = out.unionAll(rows(drops, F.when(is_key, "drop foreign key").otherwise("change table"), step("drop", ~is_key), F.col("object_name"), lit("safe"), no_note, describe("drop"), F.col("o.drop_sql")))
    adds = objects.where(F.col("n").isNotNull() & (F.col("o").isNull() | unlike))
    phase = F.when(is_key, "add foreign key").when(~F.col("made"), "change table").when(F.col("kind").isin("index", "check"), F.concat(lit("create "), F.col("kind")))
    out = out.unionAll(rows(adds.where(phase.isNotNull()), phase, step("add", ~is_key & ~F.col("made")), F.col("object_name"), lit("blocking"), no_note, describe("add"), F.col("add_sql"), seq=F.when(is_key & F.col("made"), 1).otherwise(0)))

    going = tables.where("was AND NOT stays").select(*own, "table_name")
    refs = objects.where(F.col("o").isNotNull() & is_key & F.col("gone")).select(*own, "table_name", "object_name", "o.*")
    cuts = refs.select(lit("drop foreign key").alias("act"), "table_name", "object_name", "drop_sql")
    last = ordering.drops(going, refs, by).join(cuts.hint("merge"), ["act", "table_name", "object_name"], "left")
    goes = F.col("act") == "drop table"
    name = F.when(goes, F.col("table_name")).otherwise(F.col("object_name"))
    says_it = F.when(goes, says("drop table", "table_name")).otherwise(F.concat(says("drop foreign key", "object_name"), lit(" of a cycle")))
    sql = F.when(goes, ddl.drop("table", target, schema)).otherwise(F.col("drop_sql"))
    out = out.unionAll(rows(last, lit("drop table"), lit(""), name, F.when(goes, "data-loss").otherwise("safe"), F.when(goes, "drops the table's data"), says_it, sql, seq=F.col("seq")))
    return out, unsupported


def retargeted(objects: DataFrame, schema: str, columns: tuple[str, ...] = ("schema_name", "ref_schema")) -> DataFrame:
    """Objects with every schema that they name replaced; a blank schema leaves them as they are, as does a null one."""
    if not schema.strip():
        return objects
    return objects.withColumns({c: F.when(F.col(c).isNotNull(), schema) for c in columns if c in objects.columns})


def normalized(objects: DataFrame, fold, names: tuple[str, ...], lists: dict[str, str | None]) -> DataFrame:
    """Objects with identifiers folded.  ``lists`` maps arrays of identifiers to the array that marks
    which of their parts are expressions (those stay), or to None."""
    out = {c: fold(F.col(c)) for c in names}
    for c, flags in lists.items():
        out[c] = F.transform(c, fold) if flags is None else _folded_parts(c, flags, fold)
    return objects.withColumns(out)


def _folded_parts(parts: str, flags: str, fold) -> Column:
    return F.transform(parts, lambda x, i: F.when(F.coalesce(F.get(F.col(flags), i), F.lit(False)), x).otherwise(fold(x)))


def fingerprint(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def manifest(script: DataFrame, source: DataFrame, counted: dict[str, DataFrame], **facts) -> DataFrame:
    """One row: the facts of a run, fingerprints of the scripts and of the source's relation, and how many rows ``counted`` has.

    Scripts and the source's rows are hashed each and the sorted hashes together, so that their order doesn't count.
    """

    def parts(script: Column, source: Column, which: str = "") -> list[Column]:
        return [script.cast("string").alias("script"), source.cast("string").alias("source"), *[(F.count("*") if c == which else F.lit(None).cast("bigint")).alias(c) for c in counted]]

    none = F.lit(None)
    lines = source.select(F.sha2(F.to_json(F.struct(*sorted(source.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    together = fingerprint(F.array_join(F.sort_array(F.collect_list("h")), "\n"))
    every = script.select(F.sha2("script", 256).alias("h")).agg(*parts(together, none)).unionAll(lines.agg(*parts(none, together)))
    for name, df in counted.items():
        every = every.unionAll(df.agg(*parts(none, none, name)))
    return every.agg(*[F.first(F.lit(v)).alias(k) for k, v in facts.items()], F.max("source").alias("source_fingerprint"), F.max("script").alias("plan_fingerprint"), *[F.max(c).alias(c) for c in counted])
