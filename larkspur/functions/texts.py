"""Python functions over the distinct texts of a column.

Parsing is Python, and catalogs repeat the same few texts over and over: each distinct
text is parsed once, in tasks, and joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def applied(df: DataFrame, column: str, into: str, fn: Callable[[str], object], kind: str = "string") -> DataFrame:
    """``df`` with ``into``: ``fn`` of the texts of ``column``; null for null.  Structs are given as dictionaries."""
    out = to_arrow_type(T.StructType.fromDDL(f"x {kind}")["x"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            yield pa.RecordBatch.from_arrays([texts, pa.array([fn(x) for x in texts.to_pylist()], out)], [column, into])

    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    return df.join(distinct.mapInArrow(run, f"`{column}` string, `{into}` {kind}"), column, "left")


def once(df: DataFrame, columns: list[str], rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with what ``rule`` makes of the distinct values of ``columns`` (nulls count): none, one or more rows for each.

    For declared types, whose rules are long expressions: a catalog has few of them, however
    many columns it has, so that the rules' rows are broadcast.  They must keep ``columns``.
    """
    known = {c: f"{c}_of_rule" for c in columns}
    found = rule(df.select(*columns).distinct()).withColumnsRenamed(known)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in known.items()])
    return df.join(F.broadcast(found), same).drop(*known.values())
