"""Verification of rendered statements: each is parsed back and compared with what it was rendered from.

Statements are parsed once for each distinct text, in tasks (``texts.applied``); the rest
are joins and comparisons of columns.  What doesn't parse is a difference too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import fragments, identifiers, texts

PARSED = (
    "struct<kind:string,name:string,table_name:string,columns:array<string>,is_unique:boolean,include_cols:array<string>,filter:string,"
    "ref_schema:string,ref_table:string,ref_columns:array<string>,on_delete:string,on_update:string,definition:string,error:string>"
)
_TOKEN = re.compile(r"""(?P<space>\s+|--[^\n]*)|(?P<string>[Nn]?'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[(?:[^\]]|\]\])*\])|(?P<word>\w[\w$#]*)|(?P<mark>.)""", re.S)
_CLOSE = {'"': '"', "`": "`", "[": "]"}


class Unparsed(ValueError):
    pass


class Statement:
    """Tokens of a statement; names are kept apart from words."""

    def __init__(self, sql: str):
        self.sql = sql.strip().rstrip(";").rstrip()
        self.tokens = [m for m in _TOKEN.finditer(self.sql) if not m["space"]]
        self.at = 0

    def take(self, *words: str) -> bool:
        """Whether the next tokens are these words or marks; if so they are passed."""
        some = self.tokens[self.at : self.at + len(words)]
        if [m[0].upper() for m in some if not m["name"] and not m["string"]] != list(words):
            return False
        self.at += len(words)
        return True

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise Unparsed(f"{' '.join(words)} expected" + (f" at {self.tokens[self.at][0]}" if self.at < len(self.tokens) else ""))

    def name(self) -> list[str]:
        """A qualified name's parts."""
        out = []
        while True:
            if self.at == len(self.tokens) or not (self.tokens[self.at]["name"] or self.tokens[self.at]["word"]):
                raise Unparsed("name expected")
            out.append(unquoted(self.tokens[self.at][0]))
            self.at += 1
            if not self.take("."):
                return out

    def inside(self) -> list[str]:
        """What stands between the next parentheses, cut at the commas that are in no inner ones."""
        self.need("(")
        start, depth, cuts = self.tokens[self.at - 1].end(), 1, []
        while self.at < len(self.tokens):
            m = self.tokens[self.at]
            self.at += 1
            if m["mark"] == "(":
                depth += 1
            elif m["mark"] == ")":
                depth -= 1
            if depth == 0 or depth == 1 and m["mark"] == ",":
                cuts.append(self.sql[start : m.start()].strip())
                start = m.end()
            if depth == 0:
                return cuts
        raise Unparsed("parenthesis isn't closed")

    def rest(self) -> str:
        out = self.sql[self.tokens[self.at].start() :] if self.at < len(self.tokens) else ""
        self.at = len(self.tokens)
        return out

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise Unparsed(f"{self.tokens[self.at][0]} not expected")


def unquoted(text: str) -> str:
    text = text.strip()
    close = _CLOSE.get(text[:1])
    return text[1:-1].replace(close * 2, close) if close and text.endswith(close) and len(text) > 1 else text


def part(text: str) -> str:
    """A key part: a name, a name with the length of a prefix, or an expression without its parentheses."""
    m = re.fullmatch(r"""("(?:[^"]|"")*"|`(?:[^`]|``)*`|\[(?:[^\]]|\]\])*\]|\w+)\s*(\(\s*\d+\s*\))?""", text)
    if m:
        return unquoted(m[1]) + re.sub(r"\s", "", m[2] or "")
    return text[1:-1].strip() if text.startswith("(") and text.endswith(")") else text


def action(s: Statement) -> str:
    for words in (("NO", "ACTION"), ("SET", "NULL"), ("SET", "DEFAULT"), ("CASCADE",), ("RESTRICT",)):
        if s.take(*words):
            return " ".join(words)
    raise Unparsed("action expected")


def _index(s: Statement, unique: bool) -> dict:
    name = s.name()[-1]
    s.need("ON")
    out = {"kind": "index", "name": name, "table_name": s.name()[-1], "is_unique": unique, "columns": [part(x) for x in s.inside()], "include_cols": [], "filter": ""}
    if s.take("INCLUDE"):
        out["include_cols"] = [part(x) for x in s.inside()]
    if s.take("WHERE"):
        out["filter"] = s.rest()
    return out


def _constraint(s: Statement) -> dict:
    out: dict = {"table_name": s.name()[-1]}
    s.need("ADD", "CONSTRAINT")
    out["name"] = s.name()[-1]
    if s.take("CHECK"):
        return out | {"kind": "check", "definition": ", ".join(s.inside())}
    for kind, words in (("primary key", ("PRIMARY", "KEY")), ("unique", ("UNIQUE",))):
        if s.take(*words):
            return out | {"kind": kind, "columns": [part(x) for x in s.inside()]}
    s.need("FOREIGN", "KEY")
    out |= {"kind": "foreign key", "columns": [part(x) for x in s.inside()], "on_delete": "", "on_update": ""}
    s.need("REFERENCES")
    *schema, out["ref_table"] = s.name()
    out["ref_schema"] = schema[-1] if schema else ""
    out["ref_columns"] = [part(x) for x in s.inside()]
    while s.take("ON"):
        if s.take("DELETE"):
            out["on_delete"] = action(s)
        else:
            s.need("UPDATE")
            out["on_update"] = action(s)
    return out


def parse(sql: str) -> dict:
    """A CREATE INDEX or ALTER TABLE ... ADD CONSTRAINT as its facts; ``error`` for anything else."""
    s = Statement(sql)
    try:
        if s.take("CREATE"):
            unique = s.take("UNIQUE")
            s.need("INDEX")
            out = _index(s, unique)
        else:
            s.need("ALTER", "TABLE")
            out = _constraint(s)
        s.end()
        return out
    except Unparsed as e:
        return {"error": str(e)}


def key(name: Column, target: str) -> Column:
    """A name as the target knows it."""
    return F.lower(F.trim(identifiers.folded(name) if target == "postgres" else name))


def _listed(names: Column, target: str) -> Column:
    return F.array_join(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: key(x, target)), ",")


def _rule(text: Column) -> Column:
    """An action in one spelling; doing nothing and RESTRICT are one."""
    word = F.regexp_replace(F.upper(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " ")
    return F.when(word.isin("", "NO ACTION", "RESTRICT"), "no action").otherwise(F.lower(word))


def _with_predicates(df: DataFrame, want: str) -> DataFrame:
    """``same_predicate``: whether the text wanted and the one found mean or read the same; both empty counts."""
    both = df.withColumns({"want_": F.coalesce(F.trim(want), F.lit("")), "found_": F.coalesce(F.trim(F.coalesce("parsed.filter", "parsed.definition")), F.lit(""))})
    for c in ("want_", "found_"):
        both = texts.applied(both, c, f"{c}k", fragments.keys, "struct<tree:string,text:string>")
    meant = F.coalesce(F.col("want_k.tree") == F.col("found_k.tree"), F.lit(False))
    filled = (F.col("want_") != "") & (F.col("found_") != "")
    return both.withColumn("same_predicate", (F.col("want_") == F.col("found_")) | filled & (meant | (F.col("want_k.text") == F.col("found_k.text"))))


def _deltas(df: DataFrame, names: list[str], criteria: list[tuple[str, Column, Column]], predicate: str | None = None) -> DataFrame:
    """A row for each criterion that differs: expected, found."""
    plain = F.col("parsed.error").isNull()
    rows = [F.when(plain & ~want.eqNullSafe(found), F.struct(F.lit(c).alias("criterion"), want.alias("expected"), found.alias("found"))) for c, want, found in criteria]
    if predicate:
        rows.append(F.when(plain & ~F.col("same_predicate"), F.struct(F.lit(predicate).alias("criterion"), F.col("want_").alias("expected"), F.col("found_").alias("found"))))
    rows.insert(0, F.when(~plain, F.struct(F.lit("unparsed").alias("criterion"), F.lit("").alias("expected"), F.col("parsed.error").alias("found"))))
    return df.select(*names, F.explode(F.array_compact(F.array(*rows))).alias("d")).select(*names, "d.*")


def _names(target: str, name: str) -> list[tuple[str, Column, Column]]:
    return [("name", key(F.col(name), target), key(F.col("parsed.name"), target)), ("table", key(F.col("table_name"), target), key(F.col("parsed.table_name"), target)), ("columns", _listed(F.col("columns"), target), _listed(F.col("parsed.columns"), target))]


def _bool(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def indexes(rendered: DataFrame, target: str) -> DataFrame:
    """Differences of ``sql`` from index_name, table_name, columns, is_unique, include_cols and filter; MySQL has neither of the last two."""
    df = _with_predicates(texts.applied(rendered, "sql", "parsed", parse, PARSED), "filter")
    criteria = [*_names(target, "index_name"), ("unique", _bool(F.col("is_unique")), _bool(F.col("parsed.is_unique")))]
    if target != "mysql":
        criteria.append(("include_cols", _listed(F.col("include_cols"), target), _listed(F.col("parsed.include_cols"), target)))
    return _deltas(df, ["table_name", "index_name"], criteria, "filter" if target != "mysql" else None)


def foreign_keys(rendered: DataFrame, target: str) -> DataFrame:
    """Differences of ``sql`` from constraint_name, table_name, columns, ref_schema (blank: any), ref_table, ref_columns and actions."""
    df = texts.applied(rendered, "sql", "parsed", parse, PARSED)
    named = F.trim(F.coalesce("ref_schema", F.lit(""))) != ""
    schema = ("ref_schema", F.when(named, key(F.col("ref_schema"), target)), F.when(named, key(F.col("parsed.ref_schema"), target)))
    criteria = [*_names(target, "constraint_name"), ("ref_table", key(F.col("ref_table"), target), key(F.col("parsed.ref_table"), target)), schema, ("ref_columns", _listed(F.col("ref_columns"), target), _listed(F.col("parsed.ref_columns"), target))]
    criteria += [(c, _rule(F.col(c)), _rule(F.col(f"parsed.{c}"))) for c in ("on_delete", "on_update")]
    return _deltas(df, ["table_name", "constraint_name"], criteria)


def checks(rendered: DataFrame, target: str) -> DataFrame:
    """Differences of ``sql`` from constraint_name, table_name and definition (in the source's dialect)."""
    df = _with_predicates(texts.applied(rendered, "sql", "parsed", parse, PARSED), "definition")
    return _deltas(df, ["table_name", "constraint_name"], _names(target, "constraint_name")[:2], "predicate")
