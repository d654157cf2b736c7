"""Kinds with members, spatial facts and array elements.

A kind is a struct.  An array's facts are those of its innermost element, and ``depth``
counts its levels, so that types of any nesting are one flat row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import types

FACTS = "struct<kind:string,length:int,precision:int,scale:int,fsp:int,zoned:boolean,unsigned:boolean,members:array<string>,family:string,subtype:string,srid:int,depth:int,raw:string>"
_FIELDS = [tuple(f.split(":")) for f in FACTS.removeprefix("struct<").removesuffix(">").split(",")]
#: Spatial subtypes as PostGIS spells them.
SUBTYPES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
#: Members that fit in ClickHouse's enums.
ENUM8, ENUM16 = 127, 32767


def struct(**facts: Column) -> Column:
    """A kind of the facts given; others are null, and depth 0."""
    facts.setdefault("depth", F.lit(0))
    return F.struct(*[facts.get(name, F.lit(None)).cast(t).alias(name) for name, t in _FIELDS])


def declared(data_type: Column, dialect: Column, length: Column, precision: Column, scale: Column, fsp: Column, unsigned: Column, members: Column, subtype: Column, srid: Column) -> Column:
    """The kind of a declared type of PostgreSQL, SQL Server or MySQL.

    PostgreSQL's arrays have one level, and their element the column's facts.  Spatial types
    say family, subtype and srid in the type (``geometry(Point,4326)``) or in facts of their own.
    """
    low = F.lower(F.trim(data_type))
    array = low.endswith("[]") | (dialect == "postgres") & low.startswith("_")
    inner = F.when(low.endswith("[]"), F.regexp_replace(low, r"(\[\])+$", "")).when(array, F.substring(low, 2, 1000)).otherwise(low)
    word = F.trim(F.regexp_extract(inner, r"^([^(]*)", 1))
    spatial = word.isin("geometry", "geography", *map(str.lower, SUBTYPES))
    own = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(inner, r"\(\s*([^,)]*)", 1)), r"^\s*st_|\s", ""), "^geo(metry|graphy)$", "")
    beside = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(subtype, F.lit(""))), r"^\s*st_|\s", ""), "^geo(metry|graphy)$", "")
    sub = F.when(~word.isin("geometry", "geography"), word).when(own != "", own).otherwise(beside)
    told = F.regexp_extract(inner, r"\([^,]*,\s*(\d+)\s*\)$", 1)
    kind = F.when(spatial, "spatial").otherwise(types.kind(inner, dialect, length))
    return struct(
        kind=kind, length=length, precision=precision, scale=scale, fsp=fsp, zoned=types.zoned(inner), unsigned=unsigned, members=members, family=F.when(spatial, F.when(word == "geography", "geography").otherwise("geometry")),
        subtype=F.when(spatial, sub), srid=F.when(spatial, F.when(told != "", told.cast("int")).otherwise(F.coalesce(srid, F.lit(0)))), depth=array.cast("int"), raw=F.when(kind == "raw", inner),
    )


def sqlite_declared(declaration: Column) -> Column:
    """The kind of a SQLite column with the sizes that its declaration names.

    One number is a length, or a decimal's precision or a time's fractional digits; two are precision and scale.
    """
    kind = types.sqlite_kind(declaration)
    one, two = (F.regexp_extract(declaration, p, 1) for p in (r"\(\s*(\d+)", r"\(\s*\d+\s*,\s*(\d+)"))
    number = lambda text: F.when(text != "", text.try_cast("int"))
    sized = kind.isin("varchar", "char", "text", "binary", "varbinary", "blob", "bitstring", "varbitstring")
    decimal = kind.isin("decimal", "double", "real")
    low = F.lower(declaration)
    return struct(
        kind=kind, length=F.when(sized, number(one)), precision=F.when(decimal, number(one)), scale=F.when(decimal, number(two)), fsp=F.when(kind.isin("time", "timestamp"), number(one)), unsigned=low.rlike(r"\bunsigned\b"), zoned=F.lit(False),
        raw=F.when(kind == "raw", F.trim(declaration)),
    )


def quoted(text: Column, target: str) -> Column:
    """A member as a literal."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'" if target == "clickhouse" else "''")), F.lit("'"))


def members(k: Column, target: str) -> Column:
    """The type of an enum or set that has members; null where the target needs some and there are none."""
    n = F.coalesce(F.size(k["members"]), F.lit(0))
    each = F.transform(k["members"], lambda m: quoted(m, target))
    if target == "mysql":
        return F.when(n > 0, F.concat(F.upper(k["kind"]), F.lit("("), F.array_join(each, ","), F.lit(")")))
    if target == "clickhouse":
        numbered = F.array_join(F.transform(k["members"], lambda m, i: F.concat(quoted(m, target), F.lit(" = "), (i + 1).cast("string"))), ", ")
        return F.when((k["kind"] == "set") | (n <= 0) | (n > ENUM16), "String").otherwise(F.concat(F.when(n > ENUM8, "Enum16(").otherwise("Enum8("), numbered, F.lit(")")))
    if target == "mssql":
        sizes = F.transform(k["members"], lambda m: F.octet_length(m))
        length = F.coalesce(k["length"], F.lit(0))
        whole = F.when(length > 0, length).otherwise(F.aggregate(sizes, F.lit(-1), lambda a, x: a + x + 1))
        size = F.when(n <= 0, length).when(k["kind"] == "set", whole).otherwise(F.greatest(length, F.array_max(sizes)))
        return F.when(size > 4000, "NVARCHAR(MAX)").when(size > 0, F.concat(F.lit("NVARCHAR("), size.cast("string"), F.lit(")"))).otherwise("NVARCHAR(255)")
    return F.lit({"postgres": "text", "sqlite": "TEXT"}[target])


def spatial(k: Column, target: str) -> Column:
    srid = F.coalesce(k["srid"], F.lit(0))
    known = {s.lower(): s for s in SUBTYPES}
    spelled = F.coalesce(types._lookup(known, k["subtype"]), F.lit(""))
    if target == "postgres":
        name = F.when(spelled == "", "Geometry").otherwise(spelled)
        return F.when((spelled == "") & (srid <= 0), k["family"]).when(srid > 0, F.concat(k["family"], F.lit("("), name, F.lit(","), srid.cast("string"), F.lit(")"))).otherwise(F.concat(k["family"], F.lit("("), name, F.lit(")")))
    if target == "mysql":
        return F.concat(F.when(spelled == "", "GEOMETRY").otherwise(F.upper(spelled)), F.when(srid > 0, F.concat(F.lit(" SRID "), srid.cast("string"))).otherwise(""))
    if target == "mssql":
        return F.upper(k["family"])
    return F.lit({"sqlite": "BLOB", "clickhouse": "String"}[target])


#: What holds an array where there are none.
NO_ARRAYS = {"mssql": "NVARCHAR(MAX)", "mysql": "JSON", "sqlite": "TEXT"}


def render(target: str, k: Column) -> Column:
    """The target's type text of a kind; null where it has none.  ``k`` should be a column that is there already."""
    off = F.lit(False)
    plain = types.render(target, k["kind"], k["length"], k["precision"], k["scale"], k["unsigned"], F.coalesce(k["zoned"], off), off, k["fsp"])
    one = F.when(k["kind"].isin("enum", "set"), members(k, target)).when(k["kind"] == "spatial", spatial(k, target)).otherwise(plain)
    if target in NO_ARRAYS:
        return F.when(k["depth"] > 0, NO_ARRAYS[target]).otherwise(one)
    if target == "postgres":
        return F.concat(one, F.repeat(F.lit("[]"), k["depth"]))
    return F.concat(F.repeat(F.lit("Array("), k["depth"]), one, F.repeat(F.lit(")"), k["depth"]))


def losses(target: str, k: Column, national: Column, utc: Column) -> Column:
    """What the mapping loses, as ``types.losses``, with what only members, spatial facts and elements tell; an array's element loses what it would alone."""
    off, none = F.lit(False), F.lit(None).cast("string")
    f = types.Facts(k["kind"], k["length"], k["precision"], k["scale"], k["unsigned"], F.coalesce(k["zoned"], off), F.coalesce(national, off), k["fsp"], none)
    own = types.losses(target, f, utc)
    has = F.coalesce(F.size(k["members"]), F.lit(0)) > 0
    if target == "clickhouse":
        own = F.when((k["kind"] == "enum") & has, F.array_remove(own, "members are unknown, stored as a string")).otherwise(own)
    more = [
        F.when((k["kind"].isin("enum", "set")) & F.lit(target in ("postgres", "mssql")), "members aren't enforced"),
        F.when((k["kind"] == "spatial") & ((k["srid"] > 0) | (k["subtype"] != "")) & F.lit(target == "mssql"), "spatial subtype and srid are lost"),
        F.when((k["kind"] == "spatial") & (k["family"] == "geography") & F.lit(target == "mysql"), "no geography"),
    ]
    element = F.array_compact(F.array_append(F.concat(own, F.array_compact(F.array(*more))), F.when((k["depth"] > 0) & F.lit(target in NO_ARRAYS), "no arrays")))
    return F.when((k["depth"] > 0) & F.lit(target in NO_ARRAYS), F.array(F.lit("no arrays"))).otherwise(element)
