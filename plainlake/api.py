"""The verbs of the engine on paths; they give DataFrames first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainlake import __version__
from plainlake.operators import compare
from plainlake.session import session
from plainlake.sources import snapshot
from plainlake.sources.init import init
from plainlake.sources.settings import Settings, resolve
from plainlake.sources.validate import Report, validate


def load(path: str | Path, spark: SparkSession | None = None, **filters) -> snapshot.Snapshot:
    return snapshot.load(spark or session(), path, **filters)


def sql(text: str, path: str | Path, spark: SparkSession | None = None) -> DataFrame:
    return load(path, spark).sql(text)


def to_arrow(path: str | Path, table: str, spark: SparkSession | None = None):
    return load(path, spark)[table].toArrow()


def to_pandas(path: str | Path, table: str, spark: SparkSession | None = None):
    return load(path, spark)[table].toPandas()


def sql_arrow(text: str, path: str | Path, spark: SparkSession | None = None):
    return sql(text, path, spark).toArrow()


def sql_pandas(text: str, path: str | Path, spark: SparkSession | None = None):
    return sql(text, path, spark).toPandas()


def _polars(table):
    import polars  # an optional package

    return polars.from_arrow(table)


def to_polars(path: str | Path, table: str, spark: SparkSession | None = None):
    return _polars(to_arrow(path, table, spark))


def sql_polars(text: str, path: str | Path, spark: SparkSession | None = None):
    return _polars(sql_arrow(text, path, spark))


def diff_detail(left: str | Path, right: str | Path, spark: SparkSession | None = None, summary: bool = False, tables: Sequence[str] = (), exclude: Sequence[str] = ()) -> dict:
    """The diff as plain values: left, right, identical, and of each table its name, the numbers of added, deleted and
    modified rows, and unless `summary` the rows themselves. The rows come to the driver: for large diffs take diff()."""
    out = []
    for name, df in diff(left, right, spark, tables, exclude).items():
        if "surplus" in df.columns:
            kind = F.when(F.col("surplus") > 0, "added").otherwise("deleted")
            df = df.withColumn("kind", kind)
            counts = {r["kind"]: r["n"] for r in df.groupBy("kind").agg(F.sum(F.abs("surplus")).alias("n")).collect()}
        else:
            counts = {r["kind"]: r["n"] for r in df.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        out.append({"name": name, **{k: counts.get(k, 0) for k in ("added", "deleted", "modified")}} | ({} if summary else {"rows": [r.asDict(recursive=True) for r in df.collect()]}))
    return {"left": str(left), "right": str(right), "identical": not any(t[k] for t in out for k in ("added", "deleted", "modified")), "tables": out}


def _source(source: str | Path | Mapping[str, DataFrame], spark: SparkSession | None) -> snapshot.Snapshot:
    return snapshot.from_frames(spark or session(), source) if isinstance(source, Mapping) else load(source, spark)


def to_csv(source: str | Path | Mapping[str, DataFrame], to: str | Path, spark: SparkSession | None = None, force: bool = False, incremental: bool = False, **given):
    """`source` is a path or a dict of frames; `given` are settings, which the source directory's file completes."""
    s = _source(source, spark)
    chosen = resolve(Path(source) if isinstance(source, (str, Path)) else None, **given)
    if chosen.order == "pk" and not chosen.order_by and "order" not in given and any(not s.pk(t) for t in chosen.chosen(s.tables)) and isinstance(source, Mapping):
        chosen.order = "all-columns"
    return snapshot.to_csv_incremental(s, to, chosen) if incremental else snapshot.to_csv(s, to, chosen, force)


def to_parquet(source, to: str | Path, spark: SparkSession | None = None, force: bool = False, **given):
    """One sorted file a table below a path; a URL takes a folder of files a table, written in parallel."""
    settled = resolve(Path(source) if isinstance(source, (str, Path)) else None, **given)
    if "://" in str(to):
        return snapshot.to_parquet_url(_source(source, spark), str(to), settled)
    return snapshot.to_parquet(_source(source, spark), to, settled, force)


def to_sqlite(source, to: str | Path, spark: SparkSession | None = None, force: bool = False) -> None:
    snapshot.to_sqlite(_source(source, spark), to, force)


def to_duckdb(source, to: str | Path, spark: SparkSession | None = None, force: bool = False) -> None:
    snapshot.to_duckdb(_source(source, spark), to, force)


def checksum(path: str | Path, spark: SparkSession | None = None, tables: Sequence[str] = (), exclude: Sequence[str] = ()) -> str:
    return snapshot.checksum(load(path, spark), tables, exclude)


def diff(left: str | Path, right: str | Path, spark: SparkSession | None = None, tables: Sequence[str] = (), exclude: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Of each table on either side the changed rows; a table without a key is compared as a multiset, and a table that
    one side lacks is empty there."""
    a, b = (load(x, spark, tables=tables, exclude=exclude) for x in (left, right))
    out = {}
    for t in sorted({*a.tables, *b.tables}):
        x, y = a.tables.get(t), b.tables.get(t)
        x = y.limit(0) if x is None else x
        y = x.limit(0) if y is None else y
        pk = a.pk(t) or b.pk(t)
        out[t] = compare.diff(x, y, pk) if pk else compare.diff_multiset(x, y)
    return out


def merge(base: str | Path, left: str | Path, right: str | Path, to: str | Path | None = None, strategy: str = "normal", spark: SparkSession | None = None, force: bool = False) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """({table: merged rows with their class}, {table: conflict of whole tables}); with `to`, writes the result.

    A table that one side removed is gone if the other left it alone, and a conflict if not, which `ours` and `theirs`
    decide for their side. Tables need a key; a table without one is taken from the side that changed it."""
    sides = [load(x, spark) for x in (base, left, right)]
    rows, conflicts, kept, schema = {}, {}, {}, snapshot.Schema()
    for t in sorted({n for s in sides for n in s.tables}):
        b, l, r = (s.tables.get(t) for s in sides)
        pk = next((s.pk(t) for s in sides if t in s.tables and s.pk(t)), [])
        table = next(s.schema.tables[t] for s in (sides[1], sides[2], sides[0]) if t in s.schema.tables)
        if l is None or r is None:
            other = r if l is None else l
            if other is None or b is None:
                if other is not None:  # added on one side
                    kept[t], schema.tables[t] = other, table
                continue
            changed = compare.fingerprint(b).first() != compare.fingerprint(other).first()
            theirs = (strategy == "ours" and l is not None) or (strategy == "theirs" and r is not None)
            if changed and strategy == "normal":
                conflicts[t] = "modify_remove"
            if changed and theirs:
                kept[t], schema.tables[t] = other, table
            continue
        if not pk:
            same = lambda x, y: x is not None and compare.fingerprint(x).first() == compare.fingerprint(y).first()
            if not same(b, l) and not same(b, r) and not same(l, r) and strategy == "normal":
                conflicts[t] = "no key"
            kept[t], schema.tables[t] = (r if same(b, l) or (strategy == "theirs" and not same(b, r)) else l), table
            continue
        rows[t] = compare.merge(l.limit(0) if b is None else b, l, r, pk, strategy)
        kept[t], schema.tables[t] = snapshot.typed(compare.merged_table(rows[t], pk), table), table
    if to:
        schema.views = {v: q for s in (sides[2], sides[1]) for v, q in s.schema.views.items()}
        given = Settings(order="pk" if all(x.pk for x in schema.tables.values()) else "all-columns")
        snapshot.to_csv(snapshot.Snapshot(sides[0].spark, schema, kept, given), to, given, force)
    return rows, conflicts


def version() -> str:
    return __version__


__all__ = ["Report", "checksum", "diff", "diff_detail", "init", "load", "merge", "sql", "sql_arrow", "sql_pandas", "sql_polars", "to_arrow", "to_csv", "to_duckdb", "to_pandas", "to_parquet", "to_polars", "to_sqlite", "validate", "version"]
