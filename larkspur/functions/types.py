"""Types of five dialects through one neutral model, as Column expressions.

A column's declared type becomes a *kind*; a kind becomes a target's type text.  Both are
generated CASE expressions, so that a mapping over any number of columns is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TARGETS = ("postgres", "mssql", "mysql", "sqlite", "clickhouse")

#: Type names of the source dialects, by kind.
KINDS = {
    "boolean": "bool boolean",
    "tinyint": "tinyint int1",
    "smallint": "smallint int2 smallserial serial2",
    "mediumint": "mediumint int3",
    "integer": "int integer int4 serial serial4",
    "bigint": "bigint int8 bigserial serial8",
    "decimal": "decimal numeric number money smallmoney dec",
    "real": "real float4",
    "double": "double float float8",
    "varchar": "varchar nvarchar varchar2 nvarchar2",
    "char": "char nchar character bpchar",
    "text": "text ntext tinytext mediumtext longtext clob string citext",
    "binary": "binary",
    "varbinary": "varbinary",
    "blob": "blob tinyblob mediumblob longblob bytea image",
    "date": "date",
    "time": "time timetz",
    "timestamp": "timestamp datetime datetime2 smalldatetime timestamp_ntz timestamptz datetimeoffset",
    "uuid": "uuid uniqueidentifier",
    "json": "json jsonb",
    "xml": "xml",
    "enum": "enum",
    "set": "set",
    "spatial": "geometry geography point linestring polygon",
}
#: Spellings with spaces, by the one-word name that they stand for.
SPELLINGS = {"character varying": "varchar", "double precision": "double", "timestamp without time zone": "timestamp", "timestamp with time zone": "timestamptz", "time without time zone": "time", "time with time zone": "timetz", "bit varying": "varbit"}
ZONED = ("timestamptz", "datetimeoffset", "timetz")
NATIONAL = ("nvarchar", "nchar", "ntext")
#: Bytes that the tiers of MySQL's texts and blobs hold.
TIERS = {"tiny": 255, "": 65535, "medium": 16777215, "long": 4294967295}


def _lookup(table: dict[str, str], key: Column) -> Column:
    """The key's value, or null.  A literal map keeps the expression small, whatever the number of names."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def base_name(data_type: Column) -> Column:
    """The type's name without arguments, as one word."""
    name = F.regexp_replace(F.lower(F.trim(data_type)), r"\s*\(.*\)|\s+unsigned$", "")
    return F.coalesce(_lookup(SPELLINGS, name), name)


def kind(data_type: Column, dialect: Column, width: Column) -> Column:
    """The neutral kind of a declared type; ``raw`` for a name that no rule knows.

    ``bit`` is a boolean in SQL Server, and in MySQL where it is one bit wide; else a bit
    string.  SQL Server's ``timestamp`` is a row version.  A name that ends in ``[]`` or
    starts with ``_`` in Postgres, or is Spark's ``array<...>``, is an array.
    """
    names = {n: k for k, ns in KINDS.items() for n in ns.split()} | {"varbit": "varbitstring", "bit": "bitstring", "rowversion": "rowversion"}
    lowered = F.lower(F.trim(data_type))
    mssql, mysql = dialect == "mssql", dialect == "mysql"
    return (
        F.when(lowered.endswith("[]") | lowered.startswith("array<") | (dialect == "postgres") & lowered.startswith("_"), "array")
        .when(mysql & lowered.startswith("tinyint(1)") | lowered.startswith("bit") & (mssql | mysql & (F.coalesce(width, F.lit(1)) <= 1)), "boolean")
        .when(mssql & (lowered == "timestamp"), "rowversion")
        .when((dialect == "spark") & (lowered == "float"), "real")
        .otherwise(F.coalesce(_lookup(names, base_name(data_type)), F.lit("raw")))
    )


def zoned(data_type: Column) -> Column:
    return base_name(data_type).isin(*ZONED)


def national(data_type: Column) -> Column:
    return base_name(data_type).isin(*NATIONAL)


def _sized(name: str, *args: Column) -> Column:
    return F.concat(F.lit(name + "("), F.concat_ws(",", *[a.cast("string") for a in args]), F.lit(")"))


def _cases(default: Column, rules: list[tuple[Column, Column]]) -> Column:
    for when, then in reversed(rules):
        default = F.when(when, then).otherwise(default)
    return default


def _lob(n: Column, noun: str) -> Column:
    tiers = [((n <= size), F.lit(f"{tier}{noun}".upper())) for tier, size in TIERS.items() if tier != "long"]
    return F.when(n <= 0, f"LONG{noun}".upper()).otherwise(_cases(F.lit(f"LONG{noun}".upper()), tiers))


class Facts:
    """The facts of a column that decide its type on a target."""

    def __init__(self, kind: Column, length: Column, precision: Column, scale: Column, unsigned: Column, tz: Column, national: Column, fsp: Column, element: Column):
        self.kind, self.tz, self.national, self.fsp, self.element = kind, tz, national, fsp, element
        self.n, self.p, self.s = (F.coalesce(x, F.lit(0)) for x in (length, precision, scale))
        self.u = F.coalesce(unsigned, F.lit(False))


def _postgres(f: Facts) -> dict[str, Column]:
    n, lit = f.n, F.lit
    fsp = F.when(f.fsp.isNull(), "").otherwise(_sized("", F.least(f.fsp, F.lit(6))))
    zone = F.when(f.tz, " with time zone")
    return {
        "boolean": lit("boolean"), "tinyint": lit("smallint"), "smallint": F.when(f.u, "integer").otherwise("smallint"), "mediumint": lit("integer"),
        "integer": F.when(f.u, "bigint").otherwise("integer"), "bigint": F.when(f.u, "numeric(20,0)").otherwise("bigint"),
        "decimal": F.when(f.p > 0, _sized("numeric", f.p, f.s)).otherwise("numeric"), "real": lit("real"), "double": lit("double precision"),
        "varchar": F.when(n > 0, _sized("character varying", n)).otherwise("text"), "char": F.when(n > 0, _sized("character", n)).otherwise("text"), "text": lit("text"),
        "binary": lit("bytea"), "varbinary": lit("bytea"), "blob": lit("bytea"), "rowversion": lit("bytea"), "date": lit("date"),
        "time": F.concat(lit("time"), fsp, zone.otherwise("")), "timestamp": F.concat(lit("timestamp"), fsp, zone.otherwise(" without time zone")),
        "uuid": lit("uuid"), "json": lit("jsonb"), "xml": lit("xml"), "enum": lit("text"), "set": lit("text"), "spatial": lit("geometry"),
        "bitstring": F.when(n > 0, _sized("bit", n)).otherwise("bit"), "varbitstring": F.when(n > 0, _sized("bit varying", n)).otherwise("bit varying"),
        "array": F.concat(f.element, lit("[]")),
    }


def _mssql(f: Facts) -> dict[str, Column]:
    n, lit = f.n, F.lit
    fsp = F.when(f.fsp.isNull(), "").otherwise(_sized("", F.least(f.fsp, F.lit(7))))
    big = lit("NVARCHAR(MAX)")
    bits = F.ceil(n / 8)
    variable = F.when((n > 0) & (n <= 8000), _sized("VARBINARY", n)).otherwise("VARBINARY(MAX)")
    return {
        "boolean": lit("BIT"), "tinyint": lit("TINYINT"), "smallint": F.when(f.u, "INT").otherwise("SMALLINT"), "mediumint": lit("INT"),
        "integer": F.when(f.u, "BIGINT").otherwise("INT"), "bigint": F.when(f.u, "DECIMAL(20,0)").otherwise("BIGINT"),
        "decimal": F.when(f.p > 0, _sized("DECIMAL", F.least(f.p, lit(38)), F.least(f.s, lit(38)))).otherwise("DECIMAL(38,18)"), "real": lit("REAL"), "double": lit("FLOAT"),
        "varchar": F.when(f.national, _cases(big, [(n <= 0, big), (n <= 4000, _sized("NVARCHAR", n)), (n <= 8000, _sized("VARCHAR", n))])).otherwise(F.when((n > 0) & (n <= 8000), _sized("VARCHAR", n)).otherwise("VARCHAR(MAX)")),
        "char": F.when(f.national, _cases(big, [(n <= 0, lit("NCHAR(1)")), (n <= 4000, _sized("NCHAR", n)), (n <= 8000, _sized("CHAR", n))])).otherwise(_cases(lit("VARCHAR(MAX)"), [(n <= 0, lit("CHAR(1)")), (n <= 8000, _sized("CHAR", n))])),
        "text": big, "binary": _cases(lit("VARBINARY(MAX)"), [(n <= 0, lit("BINARY(1)")), (n <= 8000, _sized("BINARY", n))]), "varbinary": variable, "blob": variable,
        "rowversion": lit("ROWVERSION"), "date": lit("DATE"), "time": F.concat(lit("TIME"), fsp), "timestamp": F.concat(F.when(f.tz, "DATETIMEOFFSET").otherwise("DATETIME2"), fsp),
        "uuid": lit("UNIQUEIDENTIFIER"), "json": big, "xml": big, "enum": lit("NVARCHAR(255)"), "set": lit("NVARCHAR(255)"), "spatial": lit("GEOMETRY"), "array": big,
        "bitstring": F.when((bits > 0) & (bits <= 8000), _sized("VARBINARY", bits)).otherwise("VARBINARY(MAX)"), "varbitstring": F.when((bits > 0) & (bits <= 8000), _sized("VARBINARY", bits)).otherwise("VARBINARY(MAX)"),
    }


def _mysql(f: Facts) -> dict[str, Column]:
    n, lit = f.n, F.lit
    u = F.when(f.u, " UNSIGNED").otherwise("")
    varchar = _cases(lit("LONGTEXT"), [(n <= 0, lit("LONGTEXT")), (n <= 16383, _sized("VARCHAR", n)), (n <= 4194303, lit("MEDIUMTEXT"))])
    bits = F.ceil(n / 8)
    varbinary = _cases(lit("MEDIUMBLOB"), [(n <= 0, lit("LONGBLOB")), (n <= 65535, _sized("VARBINARY", n))])
    stamp = F.least(F.coalesce(f.fsp, lit(6)), lit(6))
    return {
        "boolean": lit("TINYINT(1)"), **{k: F.concat(lit(name), u) for k, name in (("tinyint", "TINYINT"), ("smallint", "SMALLINT"), ("mediumint", "MEDIUMINT"), ("integer", "INT"), ("bigint", "BIGINT"), ("real", "FLOAT"), ("double", "DOUBLE"))},
        "decimal": F.concat(F.when(f.p > 0, _sized("DECIMAL", F.least(f.p, lit(65)), F.least(f.s, lit(30)))).otherwise("DECIMAL(65,30)"), u),
        "varchar": varchar, "char": _cases(varchar, [(n <= 0, lit("CHAR(1)")), (n <= 255, _sized("CHAR", n))]), "text": _lob(n, "text"),
        "binary": _cases(lit("MEDIUMBLOB"), [(n <= 0, lit("BINARY(1)")), (n <= 255, _sized("BINARY", n)), (n <= 65535, _sized("VARBINARY", n))]), "varbinary": varbinary, "blob": _lob(n, "blob"),
        "rowversion": lit("BINARY(8)"), "date": lit("DATE"), "time": F.concat(lit("TIME"), F.when(f.fsp.isNull(), "").otherwise(_sized("", F.least(f.fsp, lit(6))))),
        "timestamp": F.concat(F.when(f.tz, "TIMESTAMP").otherwise("DATETIME"), F.when(stamp == 0, "").otherwise(_sized("", stamp))),
        "uuid": lit("CHAR(36)"), "json": lit("JSON"), "xml": lit("LONGTEXT"), "enum": lit("VARCHAR(255)"), "set": lit("VARCHAR(255)"), "spatial": lit("GEOMETRY"), "array": lit("JSON"),
        "bitstring": _cases(_sized("VARBINARY", bits), [(n <= 0, lit("BIT")), (n <= 64, _sized("BIT", n))]), "varbitstring": _cases(lit("MEDIUMBLOB"), [(n <= 0, lit("LONGBLOB")), (bits <= 65535, _sized("VARBINARY", bits))]),
    }


def _sqlite(f: Facts) -> dict[str, Column]:
    n, lit = f.n, F.lit
    fsp = F.when(f.fsp.isNull(), "").otherwise(_sized("", f.fsp))
    text = {k: lit("TEXT") for k in ("text", "uuid", "json", "xml", "enum", "set", "array")}
    return text | {
        "boolean": lit("BOOLEAN"), "tinyint": lit("TINYINT"), "smallint": lit("SMALLINT"), "mediumint": lit("MEDIUMINT"), "integer": lit("INTEGER"), "bigint": lit("INTEGER"),
        "decimal": F.when(f.p > 0, _sized("NUMERIC", f.p, f.s)).otherwise("NUMERIC"), "real": lit("REAL"), "double": lit("REAL"),
        "varchar": F.when(n > 0, _sized("VARCHAR", n)).otherwise("TEXT"), "char": _sized("CHAR", F.greatest(n, lit(1))),
        **{k: lit("BLOB") for k in ("binary", "varbinary", "blob", "rowversion", "spatial")}, "date": lit("DATE"), "time": F.concat(lit("TIME"), fsp), "timestamp": F.concat(lit("DATETIME"), fsp),
        "bitstring": F.when(n > 0, _sized("BIT", n)).otherwise("BIT"), "varbitstring": F.when(n > 0, _sized("BIT VARYING", n)).otherwise("BIT VARYING"),
    }


def _clickhouse(f: Facts) -> dict[str, Column]:
    n, lit = f.n, F.lit
    fixed = F.when(n > 0, _sized("FixedString", n)).otherwise("String")
    stamp = F.least(F.coalesce(f.fsp, lit(3)), lit(9))
    zone = F.when(f.tz, ", 'UTC'").otherwise("")
    whole = {k: F.concat(F.when(f.u, "U").otherwise(""), lit(f"Int{bits}")) for k, bits in (("tinyint", 8), ("smallint", 16), ("mediumint", 32), ("integer", 32), ("bigint", 64))}
    text = {k: lit("String") for k in ("varchar", "text", "varbinary", "blob", "time", "json", "xml", "enum", "set", "spatial")}
    return whole | text | {
        "boolean": lit("Bool"), "decimal": _cases(F.concat(lit("Decimal("), f.p.cast("string"), lit(", "), f.s.cast("string"), lit(")")), [(f.p <= 0, lit("Decimal(38, 9)")), (f.p > 76, F.lit(None).cast("string"))]),
        "real": lit("Float32"), "double": lit("Float64"), "char": fixed, "binary": fixed, "rowversion": lit("FixedString(8)"), "date": lit("Date32"), "uuid": lit("UUID"),
        "timestamp": F.when(stamp == 0, F.when(f.tz, "DateTime('UTC')").otherwise("DateTime")).otherwise(F.concat(lit("DateTime64("), stamp.cast("string"), zone, lit(")"))),
        "array": F.concat(lit("Array("), f.element, lit(")")),
    }


_RULES = {"postgres": _postgres, "mssql": _mssql, "mysql": _mysql, "sqlite": _sqlite, "clickhouse": _clickhouse}


def render(target: str, kind: Column, length: Column, precision: Column, scale: Column, unsigned: Column, tz: Column, national: Column, fsp: Column, element: Column | None = None) -> Column:
    """The target's type text; null where the target has none (see ``with_policy``).

    ``kind`` should be a column that is there already: every rule reads it.
    """
    f = Facts(kind, length, precision, scale, unsigned, tz, national, fsp, element if element is not None else F.lit(None).cast("string"))
    first, *rest = _RULES[target](f).items()
    out = F.when(kind == first[0], first[1])
    for k, text in rest:
        out = out.when(kind == k, text)
    return out


#: What stands for an unknown type under the policy "text_fallback".
FALLBACK = {"postgres": "text", "mssql": "NVARCHAR(MAX)", "mysql": "TEXT", "sqlite": "TEXT", "clickhouse": "String"}


def with_policy(target: str, rendered: Column, data_type: Column, policy: str = "fail") -> Column:
    """What becomes of a type that the target lacks: an error, the declared text, or text."""
    if policy == "fail":
        return F.when(rendered.isNotNull(), rendered).otherwise(F.raise_error(F.concat(F.lit(f"no type on {target} for "), data_type)).cast("string"))
    return F.coalesce(rendered, F.lit(FALLBACK[target]) if policy == "text_fallback" else data_type)


WHOLE = ("tinyint", "smallint", "mediumint", "integer", "bigint")


def sqlite_kind(declaration: Column) -> Column:
    """The kind of a SQLite column, which may be declared by any words, or by none.

    Known names first: whole numbers have 64 bits and floating ones 64 whatever they are
    called.  Other names go by what they contain, in SQLite's order of precedence, so
    that ``floating point`` is a whole number.
    """
    name = F.trim(F.regexp_extract(F.lower(F.trim(declaration)), r"^[^(]*", 0))
    known = {n: k for k, ns in KINDS.items() for n in ns.split() if n in ("bool", "boolean", "tinyint", "smallint", "int2", "mediumint", "varchar", "nvarchar", "char", "nchar", "character", "date", "datetime", "timestamp")}
    known |= {n: "bigint" for n in ("integer", "int", "bigint", "int8", "rowid")} | {n: "double" for n in ("real", "double", "double precision", "float")}
    known |= {"int4": "integer", "decimal": "decimal", "numeric": "decimal", "character varying": "varchar", "varying character": "varchar", "text": "text", "clob": "text", "blob": "blob"}
    known |= {"time": "time", "uuid": "uuid", "json": "json", "bit": "bitstring", "varbit": "varbitstring", "bit varying": "varbitstring", "": "text"}
    by_part = _cases(F.lit("raw"), [(name.contains("int"), F.lit("bigint")), (name.rlike("char|clob|text"), F.lit("text")), (name.contains("blob"), F.lit("blob")), (name.rlike("real|floa|doub"), F.lit("double"))])
    return F.coalesce(_lookup(known, name), by_part)


def losses(target: str, f: Facts, utc: Column) -> Column:
    """What a mapping to the target loses, in order; ``utc`` marks times that the source keeps in UTC."""
    k, n, p, s, u = f.kind, f.n, f.p, f.s, f.u
    tz, national = F.coalesce(f.tz, F.lit(False)), F.coalesce(f.national, F.lit(False))
    most_fsp = {"postgres": 6, "mssql": 7, "mysql": 6, "clickhouse": 9}.get(target)
    flags = target in ("mysql", "sqlite", "clickhouse")
    sqlite = [
        (k.isin("bitstring", "varbitstring"), "no bit strings"),
        (k.isin(*WHOLE) & u, "no unsigned integers"),
        (k.isin(*WHOLE[:4]), "integer width isn't enforced"),
        (k.isin("varchar", "char") & (n > 0), "length isn't enforced"),
        ((k == "decimal") & (p > 0), "precision and scale aren't enforced"),
        (k == "real", "stored in 64 bits"),
        (k.isin("binary", "varbinary") & (n > 0), "length isn't enforced"),
        (k == "rowversion", "no row versions"),
        (k.isin("time", "timestamp") & tz, "no time zones"),
        (k.isin("time", "timestamp") & f.fsp.isNotNull(), "fractional seconds aren't enforced"),
        (k.isin("uuid", "xml", "array"), "stored as text"),
        (k == "json", "stored as text, not validated"),
        (k.isin("enum", "set"), "members aren't enforced"),
        (k == "spatial", "needs an extension"),
    ]
    clickhouse = [
        (k == "mediumint", "no 24-bit integers"),
        (k.isin("varchar", "varbinary") & (n > 0), "length isn't enforced"),
        ((k == "char") & (n <= 0), "no length for a fixed string"),
        ((k == "char") & (n > 0), "fixed strings count bytes"),
        (k.isin("varchar", "char") & national, "no national characters"),
        ((k == "binary") & (n <= 0), "no length for a fixed string"),
        ((k == "decimal") & (p <= 0), "default precision"),
        (k == "date", "dates from 1900 to 2299 only"),
        (k.isin("time", "json", "xml", "set", "spatial"), "stored as a string"),
        ((k == "timestamp") & f.fsp.isNull(), "default fractional seconds"),
        ((k == "timestamp") & tz, "zone becomes UTC"),
        (k == "rowversion", "no row versions"),
        (k == "enum", "members are unknown, stored as a string"),
    ]
    shared = [
        ((k == "tinyint") & F.lit(target == "postgres"), "no 8-bit integers"),
        ((k == "mediumint") & F.lit(not flags), "no 24-bit integers"),
        (k.isin("smallint", "integer", "bigint") & u & F.lit(not flags), "no unsigned integers"),
        ((k == "decimal") & (p <= 0) & F.lit(target != "postgres"), "no unbounded decimals"),
        ((k == "decimal") & (p > 65) & F.lit(target == "mysql") | (k == "decimal") & (p > 38) & F.lit(target == "mssql"), "precision is cut"),
        ((k == "decimal") & (s > 30) & F.lit(target == "mysql") | (k == "decimal") & (s > 38) & F.lit(target == "mssql"), "scale is cut"),
        ((k == "decimal") & (p > 0) & (s > p), "scale exceeds precision"),
        (k.isin("decimal", "real", "double") & u & F.lit(target != "mysql"), "no unsigned fractions"),
        (k.isin("bitstring", "varbitstring") & F.lit(target == "mssql") | ((k == "varbitstring") | (k == "bitstring") & (n > 64)) & F.lit(target == "mysql"), "bits become bytes"),
        ((k == "timestamp") & tz & F.lit(target == "mysql"), "times from 1970 to 2038 only"),
        ((k == "time") & tz & F.lit(target in ("mysql", "mssql")), "no time zones"),
        (k.isin("time", "timestamp") & utc & F.lit(target != "mysql"), "not kept in UTC"),
        (k.isin("time", "timestamp") & (f.fsp > (most_fsp if most_fsp is not None else 99)), "fractional seconds are cut"),
        (k.isin("text", "blob") & n.isin(*TIERS.values()) & F.lit(target != "mysql"), "capacity isn't kept"),
        (k.isin("varchar", "char") & national & (n > 4000) & (n <= 8000) & F.lit(target == "mssql"), "national characters are lost"),
        ((k == "spatial") & F.lit(target == "postgres"), "needs an extension"),
        ((k == "array") & F.lit(target not in ("postgres", "clickhouse")), "no arrays"),
    ]
    rules = {"sqlite": sqlite, "clickhouse": clickhouse}.get(target, []) + shared
    return F.array_compact(F.array(*[F.when(when, F.lit(text)) for when, text in rules]))
