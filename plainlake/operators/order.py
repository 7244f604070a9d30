"""Row order, synthetic keys, duplicates, and joins on order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plainlake.functions.canon import natural_key
from plainlake.operators.compare import canonical
from plainlake.session import Workspace, free_names

SYNTHETIC = "__plain_rowid"


def order_keys(df: DataFrame, columns: Sequence[str], mode: str = "text") -> list[Column]:
    """Sort keys: `text` compares canonical texts byte by byte, `natural` compares runs of digits by value."""
    kinds = {f.name: f.dataType for f in df.schema}
    from plainlake.functions.canon import encoded

    texts = [encoded(F.col(f"`{c}`"), kinds[c]) for c in columns]
    return [natural_key(t) for t in texts] if mode == "natural" else texts


def ordered(df: DataFrame, pk: Sequence[str] = (), mode: str = "pk", natural: bool = False, order_by: str | None = None) -> DataFrame:
    """Rows in key order, in the order of all columns, or by an SQL ORDER BY clause. Key order needs a key."""
    if order_by:
        return df.orderBy(*[F.expr(x) if not x.strip().upper().endswith((" DESC", " ASC")) else _directed(x) for x in order_by.split(",")])
    if mode == "pk" and not pk:
        raise ValueError("the table has no primary key: order by all columns or add a synthetic key")
    return df.orderBy(*order_keys(df, pk if mode == "pk" else df.columns, "natural" if natural else "text"))


def _directed(x: str) -> Column:
    expression, _, way = x.strip().rpartition(" ")
    return F.expr(expression).desc() if way.upper() == "DESC" else F.expr(expression).asc()


def with_synthetic_key(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """`df` with a first column of row numbers from 1 in a total order (all columns' texts unless `order` says other).

    Rows are sorted by range, numbered within their partitions and shifted by the partitions' counts, so no window puts
    the table into one task. The sorted rows are written to the shared folder, as both passes must see the same
    partitions even if an executor is lost between them.
    """
    keys = [F.col(f"`{c}`") for c in order] if order else order_keys(df, df.columns)
    part, at, n, first, shift = free_names(df, 5)
    sorted_ = Workspace(df.sparkSession, "numbered").save(df.orderBy(*keys).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "sorted")
    counts = sorted_.groupBy(part).agg(F.count("*").alias(n), F.min(at).alias(first))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shifts = counts.select(part, first, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(shift))
    out = sorted_.join(F.broadcast(shifts), part)
    return out.select((F.col(at) - F.col(first) + F.col(shift) + 1).cast("long").alias(SYNTHETIC), *[F.col(f"`{c}`") for c in df.columns])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(n_rows, n_duplicates): rows beyond the first of each distinct row; NULLs are equal."""
    c = canonical(df).groupBy(*[f"`{x}`" for x in df.columns]).agg(F.count("*").alias("n"))
    return c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def duplicate_keys(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return df.groupBy(*[f"`{k}`" for k in pk]).agg(F.count("*").alias("n")).filter("n > 1")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, values: Sequence[str], stretches: int = 256) -> DataFrame:
    """Each row of `left` with `values` of the last row of `right` of the same `by` at or before it, else NULL.

    Both sides pass one window by key and stretch of time, so the cost is a sort, not a product, and a key that holds much
    of the rows is in `stretches` tasks and not in one. A stretch begins with a row that carries the last value of the
    stretches before it, from one small window over (key, stretch). Ties on the right go to the largest values; equal times
    count as before. A NULL time is before all others; NULL keys are equal."""
    at, side, l, r, part = free_names(left.select("*", *[F.lit(0).alias(f"{c}_") for c in right.columns]), 5)
    keys = [F.col(f"`{c}`") for c in by]
    value = F.struct(*[F.col(f"`{v}`") for v in values])
    x = left.select(*keys, F.col(f"`{left_at}`").alias(at), F.lit(1).alias(side), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias(l), F.lit(None).cast(right.select(value).schema[0].dataType).alias(r))
    y = right.select(*keys, F.col(f"`{right_at}`").alias(at), F.lit(0).alias(side), F.lit(None).cast(x.schema[l].dataType).alias(l), value.alias(r))
    every = x.unionByName(y)
    number = F.col(at).cast("double") if isinstance(every.schema[at].dataType, T.NumericType) else F.col(at).cast("timestamp").cast("double")
    times = left.select(F.col(f"`{left_at}`").alias(at)).unionByName(right.select(F.col(f"`{right_at}`").alias(at)))
    a, b = times.agg(F.min(number), F.max(number)).first()
    wide = 0.0 if a is None or not b - a < float("inf") else (b - a) / stretches
    every = every.withColumn(part, F.coalesce(F.floor((number - a) / wide).cast("int"), F.lit(-1)) if wide > 0 else F.lit(0))
    last = F.max_by(r, F.when(F.col(side) == 0, F.struct(F.col(at), F.col(r)))).alias(r)
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.groupBy(*by, part).agg(last).withColumn(r, F.last(r, ignorenulls=True).over(earlier)).filter(F.col(r).isNotNull())
    carried = carried.select(*keys, F.lit(None).cast(every.schema[at].dataType).alias(at), F.lit(-1).alias(side), F.lit(None).cast(x.schema[l].dataType).alias(l), r, part)
    w = Window.partitionBy(*by, part).orderBy(F.col(side) >= 0, F.asc_nulls_first(at), side, F.asc_nulls_last(r)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = every.unionByName(carried).withColumn(r, F.last(r, ignorenulls=True).over(w)).filter(F.col(side) == 1)
    return out.select(f"{l}.*", *[F.col(f"{r}.`{v}`").alias(v if v not in left.columns else f"{v}_right") for v in values])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str) -> DataFrame:
    """Rows of `points` with the rows of `ranges` whose [low, high) holds `at`: an equi-join on cells, and a filter.

    A range lies in cells as wide as the next power of two over its length, so it needs two of them at most, however long
    it is; a point is dealt to its cell of each width that occurs, and a double has no more than some 2,000 widths."""
    level, cell = free_names(points.select("*", *[F.lit(0).alias(c) for c in ranges.columns]), 2)
    lo, hi = F.col(f"`{low}`").cast("double"), F.col(f"`{high}`").cast("double")
    whole = lambda v: F.when(F.abs(v) < 4e18, F.floor(v).cast("double")).otherwise(v)
    place = lambda x, l: whole(x / F.pow(F.lit(2.0), l))  # noqa: E731  exact, as widths are powers of two
    endless = (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf")) | (hi - lo == float("inf"))
    r = ranges.filter(F.col(f"`{low}`") < F.col(f"`{high}`")).withColumn(level, F.when(endless, 1023.0).otherwise(F.greatest(F.ceil(F.log2(hi - lo)).cast("double"), F.lit(-1000.0))))
    r = r.withColumn(cell, F.explode(F.when(F.col(level) == 1023.0, F.array(*map(F.lit, (-2.0, -1.0, 0.0, 1.0)))).otherwise(F.array_distinct(F.array(place(lo, F.col(level)), place(hi, F.col(level)))))))
    levels = sorted(x[0] for x in r.select(level).distinct().collect())
    x = F.col(f"`{at}`").cast("double")
    p = points.withColumn(level, F.explode(F.array(*map(F.lit, levels)) if levels else F.expr("cast(array() as array<double>)")))
    p = p.withColumn(cell, F.when((x == float("-inf")) & (F.col(level) == 1023.0), -2.0).otherwise(place(x, F.col(level))))
    return p.join(r, [level, cell]).filter((F.col(f"`{at}`") >= F.col(f"`{low}`")) & (F.col(f"`{at}`") < F.col(f"`{high}`"))).drop(level, cell)
