"""Schema inference from text columns: types, nullability, primary and foreign keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainlake.functions.canon import NUMBER

#: Classes of a value in the order they are tried; a value belongs to the first that fits, else to TEXT.
CLASSES = ["BOOLEAN", "INTEGER", "REAL", "TIMESTAMP", "DATE"]
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"


def value_class(c: Column) -> Column:
    whole = c.rlike(r"^[+-]?[0-9]+$") & c.try_cast("bigint").isNotNull()
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(F.lower(c).isin("true", "false", "yes", "no", "t", "f"), "BOOLEAN")
        .when(whole, "INTEGER")
        .when(c.rlike(NUMBER), "REAL")
        .when(c.rlike(DATE + r"[T ][0-9]{2}:[0-9]{2}:[0-9]{2}"), "TIMESTAMP")
        .when(c.rlike(DATE + "$"), "DATE")
        .otherwise("TEXT")
    )


def widened(found: set[str]) -> str:
    """The least type that holds all classes; the fold is a join in a lattice, so its order doesn't matter. A column
    without values is INTEGER."""
    if not found:
        return "INTEGER"
    if len(found) == 1:
        return next(iter(found))
    if found <= {"BOOLEAN", "INTEGER", "REAL"}:
        return "REAL" if "REAL" in found else "INTEGER"
    return "TIMESTAMP" if found <= {"DATE", "TIMESTAMP"} else "TEXT"


@dataclass
class Inferred:
    table: str
    n_rows: int
    columns: dict[str, str]
    nullable: dict[str, bool]
    unique: dict[str, bool]
    pk: str | None = None
    foreign: list[tuple[str, str, str]] = field(default_factory=list)


def infer_table(name: str, df: DataFrame, detect_pk: bool = True) -> Inferred:
    """One aggregation for the classes and NULLs of all text columns (empty text is NULL), and one for the number of
    distinct values of the columns that could be keys."""
    cols = df.columns
    filled = {c: F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")) for c in cols}
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(cols):
        aggs += [F.count(filled[c]).alias(f"f{i}"), *[F.coalesce(F.bool_or(value_class(filled[c]) == k), F.lit(False)).alias(f"c{i}_{k}") for k in [*CLASSES, "TEXT"]]]
    r = df.agg(*aggs).first()
    found = {c: {k for k in [*CLASSES, "TEXT"] if r[f"c{i}_{k}"] and r[f"f{i}"]} for i, c in enumerate(cols)}
    nullable = {c: r[f"f{i}"] < r["n"] for i, c in enumerate(cols)}
    kinds = {c: widened(found[c]) for c in cols}
    unique = dict.fromkeys(cols, False)
    if detect_pk and r["n"]:
        for c in [c for c in cols if not nullable[c]]:  # a column at a time: a distinct count of all at once expands the rows
            unique[c] = df.groupBy(f"`{c}`").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() == 0
            if unique[c] and _named_key(c):
                break
    out = Inferred(name, r["n"], kinds, nullable, unique)
    out.pk = suggest_pk(out) if detect_pk else None
    return out


def _named_key(column: str) -> bool:
    return column.lower() == "id" or column.lower().endswith("_id")


def suggest_pk(t: Inferred) -> str | None:
    """The first unique column without NULLs: one named id or …_id, else of type INTEGER, else any."""
    fit = [c for c in t.columns if t.unique[c] and not t.nullable[c]]
    return next((c for rule in (_named_key, lambda c: t.columns[c] == "INTEGER", lambda c: True) for c in fit if rule(c)), None) if t.n_rows else None


def suggest_foreign(tables: Sequence[Inferred]) -> None:
    """A column x_id that is not its table's key refers to the key of another table named x, xs, xes, or with y for ies."""
    keyed = {t.table.lower(): t for t in tables if t.pk}
    for t in tables:
        t.foreign = []
        for c in t.columns:
            stem = c.lower().removesuffix("_id")
            if c == t.pk or not stem or stem == c.lower():
                continue
            names = [stem, f"{stem}s", f"{stem}es"] + ([f"{stem[:-1]}ies"] if stem.endswith("y") else [])
            if other := next((keyed[n] for n in names if n in keyed and keyed[n] is not t), None):
                t.foreign.append((c, other.table, other.pk))


def infer(tables: Mapping[str, DataFrame], detect_pk: bool = True, detect_fk: bool = True) -> list[Inferred]:
    out = [infer_table(n, df, detect_pk) for n, df in sorted(tables.items())]
    if detect_fk:
        suggest_foreign(out)
    return out
