"""Drift of a live schema from the desired one: names match in any case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import types

DECIMALS = ("decimal", "numeric", "money", "smallmoney")


def type_class(data_type: Column, length: Column, dialect: Column) -> Column:
    """Types that are one on every dialect, however spelled: uuid, json and boolean."""
    name = F.lower(F.trim(data_type))
    my = dialect == "mysql"
    return (
        F.when(name.isin("uuid", "uniqueidentifier") | my & ((name == "char") & (length == 36) | (name == "binary") & (length == 16)), "uuid")
        .when(name.isin("json", "jsonb"), "json")
        .when(name.isin("bool", "boolean") | (dialect == "mssql") & (name == "bit") | my & ((name == "tinyint(1)") | (name == "bit") & (length <= 1)), "boolean")
        .otherwise("")
    )


#: Date-time and time types of each dialect, by what they say of the time zone.
ZONES = {
    "mssql": {"naive_dt": "datetime datetime2 smalldatetime", "tzaware_dt": "datetimeoffset", "naive_t": "time"},
    "postgres": {"naive_dt": "timestamp|timestamp without time zone", "tzaware_dt": "timestamptz|timestamp with time zone", "naive_t": "time|time without time zone", "tzaware_t": "timetz|time with time zone"},
    "mysql": {"naive_dt": "datetime timestamp", "naive_t": "time"},
}
#: Types without a bound that a user sets, and types of bytes.
UNBOUNDED = ("text", "ntext", "image", "tinytext", "mediumtext", "longtext", "blob", "tinyblob", "mediumblob", "longblob", "bytea", "xml")
BYTES = ("binary", "varbinary", "image", "bytea", "rowversion", "blob", "tinyblob", "mediumblob", "longblob")


def _name(data_type: Column) -> Column:
    return F.lower(F.trim(data_type))


def zone_class(data_type: Column, dialect: str) -> Column:
    """naive_dt, tzaware_dt, naive_t, tzaware_t, or na for other types of the dialect."""
    out = F.lit("na")
    for zone, names in ZONES.get(dialect, {}).items():
        out = F.when(_name(data_type).isin(names.split("|") if "|" in names else names.split()), zone).otherwise(out)
    return out


def _zones_differ(a: Column, b: Column, source: str, target: str) -> Column:
    """MySQL's TIMESTAMP is kept in UTC and shown in the session's zone: it matches either kind of date-time."""
    za, zb = zone_class(a, source), zone_class(b, target)
    pardoned = F.lit(False)
    for dialect, name, other in ((source, a, zb), (target, b, za)):
        if dialect == "mysql":
            pardoned = pardoned | (_name(name) == "timestamp") & other.isin("naive_dt", "tzaware_dt")
    return (za != zb) & ~pardoned


def _lob_tier(name: Column) -> Column:
    """Place of a MySQL text or blob type in its family, from 1 (tiny) to 4 (long); null for others."""
    out = F.lit(None).cast("int")
    for i, size in enumerate(("tiny", "", "medium", "long"), 1):
        out = F.when(name.isin(f"{size}text", f"{size}blob"), i).otherwise(out)
    return out


def _lengths_differ(a, b, expected: Column, source: str, target: str) -> Column:
    """Whether the lengths differ where a user sets them.

    Bytes become PostgreSQL's unbounded bytea; an enum's length is that of its longest
    member; what is too long for a MySQL VARCHAR becomes a text tier; and MySQL's tiers are
    compared with each other by their place.
    """
    na, nb = _name(a("data_type")), _name(b("data_type"))
    bound = lambda x, n: F.when(n.isin(*UNBOUNDED) | (F.coalesce(x("max_length"), F.lit(0)) <= 0), 0).otherwise(x("max_length"))
    enum = na.isin("enum", "set")
    exempt = na.isin(*BYTES) & (nb == "bytea") | enum & nb.isin("enum", "set")
    differ = bound(a, na) != bound(b, nb)
    if target != "mysql":
        exempt = exempt | enum & nb.isin(*UNBOUNDED)
    else:
        base = F.coalesce(F.lower(F.regexp_replace(expected, r"\(.*\)", "")), F.lit(""))
        exempt = exempt | (a("max_length") > 0) & base.isin("mediumtext", "longtext") & (base == nb)
        if source == "mysql":
            ta, tb = _lob_tier(na), _lob_tier(nb)
            differ = F.when(ta.isNotNull() & tb.isNotNull(), (na.endswith("text") == nb.endswith("text")) & (ta != tb)).otherwise(differ)
    return ~exempt & differ


def _typed(x, dialect: str, target: str) -> Column:
    """The target's type text of a column."""
    kind, length = types.kind(x("data_type"), F.lit(dialect), x("max_length")), x("max_length").cast("bigint")
    if dialect == "mysql":  # the tiers' names say their capacity
        for tier, size in types.TIERS.items():
            length = F.when(_name(x("data_type")).isin(f"{tier}text", f"{tier}blob"), F.lit(size)).otherwise(length)
    zoned = types.zoned(x("data_type")) | F.lit(dialect == "mysql") & (_name(x("data_type")) == "timestamp")
    return types.render(target, kind, length, x("precision"), x("scale"), F.lit(False), zoned, types.national(x("data_type")), x("fsp"))


def matched(source: DataFrame, target: DataFrame) -> DataFrame:
    """Columns of both sides, as ``s`` and ``t``, by table and column name in any case (``_t`` and ``_c``)."""
    s, t = (x.withColumn("_t", F.lower("table_name")).withColumn("_c", F.lower("column_name")) for x in (source, target))
    return s.alias("s").join(t.alias("t"), ["_t", "_c"], "full_outer")


def criteria(source_dialect: str, target_dialect: str) -> Column:
    """Of a matched pair the ways in which the target column isn't the source's, in a fixed order."""
    a, b = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"t.{c}"))
    ca, cb = type_class(a("data_type"), a("max_length"), F.lit(source_dialect)), type_class(b("data_type"), b("max_length"), F.lit(target_dialect))
    fixed = (ca != "") & (ca == cb)
    plain = ~a("is_computed") & ~b("is_computed")
    expected, actual = _typed(a, source_dialect, target_dialect), _typed(b, target_dialect, target_dialect)
    zones = _zones_differ(a("data_type"), b("data_type"), source_dialect, target_dialect)
    lengths = plain & ~fixed & _lengths_differ(a, b, expected, source_dialect, target_dialect)
    decimal = plain & ~fixed & _name(a("data_type")).isin(*DECIMALS)
    precision, scale = decimal & ~a("precision").eqNullSafe(b("precision")), decimal & ~a("scale").eqNullSafe(b("scale"))
    enum = lambda x: _name(x("data_type")).isin("enum", "set")
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    base = lambda c: F.regexp_replace(c, r"\([^)]*\)", "")
    types_differ = ~fixed & ~zones & ~lengths & ~precision & ~scale & F.when(plain, F.lower(expected) != F.lower(actual)).otherwise(F.lower(base(expected)) != F.lower(base(actual)))
    found = [
        F.when(a("is_computed") != b("is_computed"), "computed"),
        F.when(a("is_identity") != b("is_identity"), "identity"),
        F.when(zones, "tz_class"),
        F.when(enum(a) & enum(b) & (a("enum_values") != "") & (b("enum_values") == ""), "enum_values"),
        F.when(F.lit(target_dialect == "mysql") & (text(a("on_update")) != text(b("on_update"))), "on_update"),
        F.when(plain & (a("is_nullable") != b("is_nullable")), "nullability"),
        F.when(lengths, "max_length"),
        F.when(precision, "precision").when(scale, "scale"),
        F.when(plain & ~a("is_identity") & ~b("is_identity") & (a("default_class") != b("default_class")), "default"),
        F.when(types_differ, "type"),
    ]
    return F.array_compact(F.array(*found))


def storage_differs(target_dialect: str) -> Column:
    """Whether only one of two computed columns is stored, where the target has both kinds."""
    a, b = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"t.{c}"))
    return F.lit(target_dialect in ("mysql", "mssql")) & a("is_computed") & b("is_computed") & (a("computed_persisted") != b("computed_persisted"))


def column_deltas(source: DataFrame, target: DataFrame, source_dialect: str, target_dialect: str) -> DataFrame:
    """(table_name, column_name, criterion) for each way in which a target column isn't the source's; missing and extra columns too."""
    missing, extra = F.col("t.table_name").isNull(), F.col("s.table_name").isNull()
    every = F.array_compact(F.array_append(criteria(source_dialect, target_dialect), F.when(storage_differs(target_dialect), "computed_storage")))
    found = F.when(missing, F.array(F.lit("missing"))).when(extra, F.array(F.lit("extra"))).otherwise(every)
    return matched(source, target).select(F.col("_t").alias("table_name"), F.col("_c").alias("column_name"), F.explode(found).alias("criterion"))


#: Why a live change of a column is refused, by what changes.
REFUSALS = {
    "identity": "a column can't start or stop numbering itself in place",
    "computed": "a computed column is dropped and added, not changed",
    "computed_storage": "a computed column is dropped and added, not changed",
    "on_update": "no statement changes what an update sets",
    "enum_values": "no statement changes the members of an enum or set",
    "srid": "no statement changes a spatial reference",
    "display_width": "no statement changes a display width",
}


def live_changes(source: DataFrame, target: DataFrame, source_dialect: str, target_dialect: str) -> DataFrame:
    """table_name, column_name, change (add, remove, change or refuse), criteria and reason of every column that differs, in tables of both sides."""
    a, b = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"t.{c}"))
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    expression = lambda c: F.lower(F.regexp_replace(trimmed(c), r"[\s()\[\]`\"]", ""))  # noqa: E731  as two catalogs may write one expression
    same = F.lit(source_dialect == target_dialect)
    more = F.array_compact(
        F.array(
            F.when(storage_differs(target_dialect), "computed_storage"),
            F.when(trimmed(a("on_update")) != trimmed(b("on_update")), "on_update"),
            F.when(~a("srid").eqNullSafe(b("srid")), "srid"),
            F.when(same & ~a("enum_values").eqNullSafe(b("enum_values")), "enum_values"),
            F.when(same & ~a("display_width").eqNullSafe(b("display_width")), "display_width"),
            *([F.when(same & a("is_computed") & b("is_computed") & (expression(a("computed_expr")) != expression(b("computed_expr"))), "computed_expression")] if "computed_expr" in source.columns and "computed_expr" in target.columns else []),
        )
    )
    pairs = matched(source, target)
    for side in (source, target):
        pairs = pairs.join(side.select(F.lower("table_name").alias("_t")).distinct(), "_t", "left_semi")
    added, removed = b("table_name").isNull(), a("table_name").isNull()
    every = F.when(added | removed, F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(criteria(source_dialect, target_dialect), more)))
    pairs = pairs.select("_t", "_c", added.alias("added"), removed.alias("removed"), every.alias("criteria")).where(F.col("added") | F.col("removed") | (F.size("criteria") > 0))
    why = F.create_map(*[F.lit(x) for kv in REFUSALS.items() for x in kv])
    pairs = pairs.withColumn("reason", F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform("criteria", lambda c: F.try_element_at(why, c))))), "; "))
    change = F.when(F.col("added"), "add").when(F.col("removed"), "remove").when(F.col("reason") != "", "refuse").otherwise("change")
    return pairs.select(F.col("_t").alias("table_name"), F.col("_c").alias("column_name"), change.alias("change"), F.array_join("criteria", ",").alias("criteria"), "reason")


def table_matches(desired: DataFrame, live: DataFrame) -> DataFrame:
    """table_name and status (missing, extra or both), names in any case."""
    d, e = (x.select(F.lower("table_name").alias("table_name")).distinct().withColumn(side, F.lit(True)) for x, side in ((desired, "d"), (live, "e")))
    return d.join(e, "table_name", "full_outer").select("table_name", F.when(F.col("e").isNull(), "missing").when(F.col("d").isNull(), "extra").otherwise("both").alias("status"))


def check_reconciliation(desired: DataFrame, live: DataFrame, same_dialect: bool) -> DataFrame:
    """table_name, n_source, n_target and status (add, drop, rewritten or same) of the checks (table_name, definition) of every table that has any.

    Predicates are compared within one dialect only, in any order, case and white space: other dialects rewrite them.
    """
    normal = F.lower(F.trim(F.regexp_replace("definition", r"\s+", " ")))
    d, e = (x.groupBy(F.lower("table_name").alias("table_name")).agg(F.count("*").alias(n), F.sort_array(F.collect_list(normal)).alias(f"{n}_texts")) for x, n in ((desired, "n_source"), (live, "n_target")))
    both = d.join(e, "table_name", "full_outer").withColumns({"n_source": F.coalesce("n_source", F.lit(0)), "n_target": F.coalesce("n_target", F.lit(0))})
    status = F.when(F.col("n_source") > F.col("n_target"), "add").when(F.col("n_source") < F.col("n_target"), "drop").when(F.lit(same_dialect) & (F.col("n_source_texts") != F.col("n_target_texts")), "rewritten").otherwise("same")
    return both.select("table_name", "n_source", "n_target", status.alias("status"))


def index_signature(columns: Column, unique: Column, include: Column, filtered: Column, exprs: Column | None = None, prefixes: Column | None = None) -> Column:
    """``unique:a,b(20),expr:f(x)/include:c/filtered``: names in lower case, expressions as they are, all in their order."""
    flags = F.array().cast("array<boolean>") if exprs is None else exprs
    sizes = F.array().cast("array<int>") if prefixes is None else prefixes

    def part(c: Column, i: Column) -> Column:
        size = F.coalesce(F.get(sizes, i), F.lit(0))
        name = F.concat(F.lower(c), F.when(size > 0, F.concat(F.lit("("), size.cast("string"), F.lit(")"))).otherwise(""))
        return F.when(F.coalesce(F.get(flags, i), F.lit(False)), F.concat(F.lit("expr:"), F.trim(c))).otherwise(name)

    more = F.when(F.size(include) > 0, F.concat(F.lit("/include:"), F.array_join(F.transform(include, F.lower), ","))).otherwise("")
    return F.concat(F.when(unique, "unique:").otherwise(""), F.array_join(F.transform(columns, part), ","), more, F.when(filtered, "/filtered").otherwise(""))


def action(text: Column) -> Column:
    """Actions that do nothing are one; white space inside counts as one space."""
    name = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    return F.when(name.isin("", "no action", "restrict"), "noaction").otherwise(name)


def key_signature(columns: Column, ref_columns: Column, ref_table: Column, on_delete: Column, on_update: Column, ref_schema: Column, schema: Column) -> Column:
    """``a:x,b:y->self.table|on delete|on update``; a schema other than the table's own takes the place of ``self``."""
    pairs = F.array_join(F.zip_with(columns, ref_columns, lambda a, b: F.concat(F.lower(a), F.lit(":"), F.coalesce(F.lower(b), F.lit("")))), ",")
    other = F.lower(F.trim(F.coalesce(ref_schema, F.lit(""))))
    where = F.when((other == "") | (other == F.lower(F.coalesce(schema, F.lit("")))), "self").otherwise(other)
    return F.concat(pairs, F.lit("->"), where, F.lit("."), F.lower(ref_table), F.lit("|"), action(on_delete), F.lit("|"), action(on_update))


def signature_changes(desired: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """Signatures that only one side has; repeated ones are kept."""
    missing = desired.join(live, key, "left_anti").select(*key).withColumn("change", F.lit("missing"))
    return missing.unionByName(live.join(desired, key, "left_anti").select(*key).withColumn("change", F.lit("extra")))


def same_key_set(a: Column, b: Column) -> Column:
    """Whether two primary keys have the same columns, in any order and case."""
    return F.array_sort(F.transform(a, F.lower)) == F.array_sort(F.transform(b, F.lower))
