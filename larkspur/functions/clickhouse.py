"""ClickHouse's nested types, read into kinds.

``Array`` levels are counted, ``Nullable`` and ``LowCardinality`` say nothing about the
kind and go; what stays is one kind with its facts.  A type that the grammar or the
bounds don't know is ``raw``, with its text (without outer wrappers).
"""

from __future__ import annotations

import re

#: Names without arguments, by kind; U before them is unsigned.
PLAIN = {
    "bool": "boolean", "boolean": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "integer", "int64": "bigint", "float32": "real", "float64": "double", "string": "text", "ipv4": "text", "ipv6": "text",
    "date": "date", "date32": "date", "uuid": "uuid", "json": "json",
}
UNSIGNED = ("uint8", "uint16", "uint32", "uint64")
#: Digits of the decimals whose name has their bits.
DECIMALS = {"decimal32": 9, "decimal64": 18, "decimal128": 38, "decimal256": 76}
WRAPPERS = ("nullable", "lowcardinality")

_TOKEN = re.compile(r"(?P<text>'(?:[^'\\]|\\.|'')*')|(?P<mark>[(),])|(?P<rest>[^'(),]+)|(?P<bad>.)", re.S)
_MEMBER = re.compile(r"\s*('(?:[^'\\]|\\.|'')*')\s*=\s*[+-]?\d+\s*", re.S)


class Malformed(ValueError):
    pass


def call(text: str) -> tuple[str, list[str] | None]:
    """Name and arguments of ``name(a, b)``; None for a name alone.  Quotes and inner parentheses are kept together."""
    depth, name, args = 0, "", None
    for m in _TOKEN.finditer(text):
        if m["bad"]:
            raise Malformed(text)
        mark = m["mark"]
        if mark == ")":
            depth -= 1
            if depth < 0:
                raise Malformed(text)
        if depth == 0 and not mark:
            if args is not None and m[0].strip():
                raise Malformed(text)
            name += m[0] if args is None else ""
        elif mark == "(" and depth == 0:
            if args is not None:
                raise Malformed(text)
            args = [""]
        elif depth == 0 and mark == ",":
            raise Malformed(text)
        elif depth == 1 and mark == ",":
            args.append("")
        elif depth > 0:
            args[-1] += m[0]
        if mark == "(":
            depth += 1
    if depth or not name.strip():
        raise Malformed(text)
    if args is not None:
        args = [] if args == [""] or len(args) == 1 and not args[0].strip() else [a.strip() for a in args]
        if not all(args):
            raise Malformed(text)
    return name.strip(), args


def number(text: str, least: int, most: int) -> int:
    if not re.fullmatch(r"[+-]?\d+", text) or not least <= int(text) <= most:
        raise Malformed(text)
    return int(text)


def unquoted(text: str) -> str:
    return re.sub(r"\\(.)|''", lambda m: m[1] or "'", text[1:-1], flags=re.S)


def facts(name: str, args: list[str] | None) -> dict:
    """The facts of a type that is neither a wrapper nor an array."""
    key, given = name.lower(), args or []
    if key == "fixedstring" and len(given) == 1:
        return {"kind": "char", "length": number(given[0], 1, 2**31 - 1)}
    if key == "decimal" and len(given) == 2:
        precision = number(given[0], 1, 76)
        return {"kind": "decimal", "precision": precision, "scale": number(given[1], 0, precision)}
    if key in DECIMALS and len(given) == 1:
        return {"kind": "decimal", "precision": DECIMALS[key], "scale": number(given[0], 0, DECIMALS[key])}
    if key == "datetime" and len(given) < 2:
        return {"kind": "timestamp", "fsp": 0, "zoned": bool(given)}
    if key == "datetime64" and len(given) in (1, 2):
        return {"kind": "timestamp", "fsp": number(given[0], 0, 9), "zoned": len(given) == 2}
    if key in ("enum8", "enum16") and given:
        found = [_MEMBER.fullmatch(a) for a in given]
        if all(found):
            return {"kind": "enum", "members": [unquoted(m[1]) for m in found]}
    if key == "object" and len(given) == 1 and (given[0] if given[0][0] != "'" else unquoted(given[0])).lower() == "json":
        return {"kind": "json"}
    if not given and key in PLAIN:
        return {"kind": PLAIN[key]}
    if not given and key in UNSIGNED:
        return {"kind": PLAIN[key[1:]], "unsigned": True}
    raise Malformed(name)


def parse(text: str) -> dict:
    """The kind of a declared type as a dictionary of ``kinds.FACTS``; facts that don't apply are left out."""
    text, depth = text.strip(), 0
    while True:
        try:
            name, args = call(text)
            if args is not None and len(args) == 1 and name.lower() in (*WRAPPERS, "array"):
                depth += name.lower() == "array"
                text = args[0]
                continue
            return facts(name, args) | {"depth": depth}
        except Malformed:
            return {"kind": "raw", "raw": text, "depth": depth}
