"""Results as CSV or as a table."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plainlake.functions.canon import text


def _cells(df: DataFrame):
    return (tuple(r) for r in df.select(*[(F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, T.BooleanType) else text(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in df.schema]).toLocalIterator())


def write_csv(df: DataFrame, out) -> None:
    """Header and rows to a text stream, one partition at a time; NULL is an empty field."""
    w = csv.writer(out, lineterminator="\n")
    w.writerow(df.columns)
    w.writerows(["" if v is None else v for v in r] for r in _cells(df))


def to_csv(df: DataFrame) -> str:
    out = io.StringIO()
    write_csv(df, out)
    return out.getvalue()


def to_table(df: DataFrame) -> str:
    """A frame of lines, for results that fit a screen; numbers stand on the right, NULL is written out, and the last line counts the rows."""
    rows = [["NULL" if v is None else v for v in r] for r in _cells(df)]
    right = [isinstance(f.dataType, T.NumericType) for f in df.schema]
    wide = [max(len(x) for x in col) for col in zip(df.columns, *rows)]
    line = lambda r, to: "│" + "│".join(f" {x.rjust(n) if a else x.ljust(n)} " for x, n, a in zip(r, wide, to)) + "│"
    bar = lambda a, b, c: a + b.join("─" * (n + 2) for n in wide) + c
    body = [bar("┌", "┬", "┐"), line(df.columns, [False] * len(wide)), bar("├", "┼", "┤"), *(line(r, right) for r in rows), bar("└", "┴", "┘")]
    return "\n".join([*body, f"({len(rows)} row{'s' * (len(rows) != 1)})", ""])
