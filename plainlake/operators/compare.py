"""Row and column diff, three-way merge, fingerprints and the change status of tables."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plainlake.functions.canon import NULL_MARK, encoded, normal_number, normal_type, normal_value
from plainlake.session import ship

ROWID = r"__\w+_rowid"  # synthetic key columns take no part in comparisons


def canonical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """`columns` as canonical text, NULL as its mark."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*[encoded(F.col(f"`{c}`"), kinds[c]).alias(c) if c in kinds else F.lit(NULL_MARK).alias(c) for c in columns or df.columns])


def shared_columns(*frames: DataFrame) -> list[str]:
    """All columns of the frames, in the order they are met."""
    return list(dict.fromkeys(c for df in frames for c in df.columns))


def schema_diff(left: DataFrame, right: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """(column, type on the left, type on the right) of the columns that differ."""
    a, b = ({f.name: f.dataType.simpleString() for f in df.schema} for df in (left, right))
    return [(c, a.get(c), b.get(c)) for c in shared_columns(left, right) if a.get(c) != b.get(c)]


def _side(df: DataFrame, pk: Sequence[str], values: Sequence[str], name: str) -> DataFrame:
    """Keys, the values as one struct, and a mark of presence, which is set before any join."""
    c = canonical(df, [*pk, *values])
    return c.select(*[F.col(f"`{k}`").alias(f"{name}_{i}") for i, k in enumerate(pk)], F.struct(*[F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(values)], F.lit(1).alias("here")).alias(name))


def _joined(sides: Sequence[tuple[str, DataFrame]], n_keys: int) -> DataFrame:
    """Full outer join of all sides on the canonical keys, which are never NULL."""
    first, df = sides[0]
    df = df.withColumnsRenamed({f"{first}_{i}": f"k{i}" for i in range(n_keys)})
    for name, side in sides[1:]:
        df = df.join(side.withColumnsRenamed({f"{name}_{i}": f"k{i}" for i in range(n_keys)}), [f"k{i}" for i in range(n_keys)], "full_outer")
    return df


def _differs(a: Column, b: Column) -> Column:
    return (a != b) & (normal_value(a) != normal_value(b))


def diff(left: DataFrame, right: DataFrame, pk: Sequence[str]) -> DataFrame:
    """One row per changed key: the key columns (text), kind (added, deleted, modified) and columns, an array of (name,
    left, right) with the original texts of what differs after normalisation. Columns are matched by name."""
    values = [c for c in shared_columns(left, right) if c not in pk]
    both = _joined([("l", _side(left, pk, values, "l")), ("r", _side(right, pk, values, "r"))], len(pk))
    cells = [F.when(_differs(F.col(f"l.v{i}"), F.col(f"r.v{i}")), F.struct(F.lit(v).alias("name"), F.col(f"l.v{i}").alias("left"), F.col(f"r.v{i}").alias("right"))) for i, v in enumerate(values)]
    changed = F.filter(F.array(*cells), lambda x: x.isNotNull()) if cells else F.expr("cast(array() as array<struct<name:string,left:string,right:string>>)")
    kind = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "deleted").when(F.size("columns") > 0, "modified")
    out = both.withColumn("columns", F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), changed)).withColumn("kind", kind).filter("kind is not null")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(pk)], "kind", "columns")


def diff_multiset(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tables without a key: each distinct row whose number differs, with its surplus on the right (negative: lost)."""
    columns = shared_columns(left, right)
    a, b = (canonical(df, columns).withColumn("_n", F.lit(n)) for df, n in ((left, -1), (right, 1)))
    return a.unionByName(b).groupBy(*[f"`{c}`" for c in columns]).agg(F.sum("_n").alias("surplus")).filter("surplus <> 0")


STRATEGIES = ("normal", "ours", "theirs")


def merge(base: DataFrame, left: DataFrame, right: DataFrame, pk: Sequence[str], strategy: str = "normal") -> DataFrame:
    """One row per key of the three: key columns (text), class, conflict, columns (of a conflict: name, base, left,
    right), and result, the struct of the row that stays, or NULL.

    A side that changed wins over one that didn't; equal changes converge; what differs is a conflict: modify_modify,
    modify_delete or add_add. `normal` keeps the left row in a conflict and lets the deletion stand, `ours` and `theirs`
    take their own side. Columns of a conflict are all that differ from the base on either side.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    values = [c for c in shared_columns(base, left, right) if c not in pk]
    every = _joined([(n, _side(df, pk, values, n)) for n, df in (("b", base), ("l", left), ("r", right))], len(pk))

    def changed(x: str, y: str) -> Column:
        out = F.lit(False)
        for i in range(len(values)):
            out = out | _differs(F.col(f"{x}.v{i}"), F.col(f"{y}.v{i}"))
        return out

    has = {n: F.col(n).isNotNull() for n in "blr"}
    every = every.withColumns({"lc": has["b"] & has["l"] & changed("b", "l"), "rc": has["b"] & has["r"] & changed("b", "r"), "lr": has["l"] & has["r"] & changed("l", "r")})
    kind = (
        F.when(has["b"] & has["l"] & has["r"], F.when(~F.col("lc") & ~F.col("rc"), "unchanged").when(~F.col("rc"), "left").when(~F.col("lc"), "right").when(~F.col("lr"), "converged").otherwise("modify_modify"))
        .when(has["b"] & has["r"], F.when(F.col("rc"), "modify_delete").otherwise("deleted"))
        .when(has["b"] & has["l"], F.when(F.col("lc"), "modify_delete").otherwise("deleted"))
        .when(has["b"], "deleted_both")
        .when(has["l"] & has["r"], F.when(F.col("lr"), "add_add").otherwise("dedup"))
        .when(has["l"], "left_add")
        .otherwise("right_add")
    )
    every = every.withColumn("class", kind)
    is_conflict = F.col("class").isin("modify_modify", "modify_delete", "add_add")
    ours = {"normal": F.when(F.col("class") != "modify_delete", F.col("l")), "ours": F.col("l"), "theirs": F.col("r")}[strategy]
    result = F.when(is_conflict, ours).when(F.col("class") == "unchanged", F.col("b")).when(F.col("class").isin("right", "right_add"), F.col("r")).when(F.col("class").isin("left", "converged", "dedup", "left_add"), F.col("l"))
    cells = [
        F.when(F.when(has["b"], F.coalesce(_differs(F.col(f"b.v{i}"), F.col(f"l.v{i}")), F.lit(False)) | F.coalesce(_differs(F.col(f"b.v{i}"), F.col(f"r.v{i}")), F.lit(False))).otherwise(_differs(F.col(f"l.v{i}"), F.col(f"r.v{i}"))), F.struct(F.lit(v).alias("name"), *[F.col(f"{n}.v{i}").alias(side) for n, side in (("b", "base"), ("l", "left"), ("r", "right"))]))
        for i, v in enumerate(values)
    ]
    conflict = is_conflict & F.lit(strategy == "normal")
    columns = F.when(is_conflict, F.filter(F.array(*cells), lambda x: x.isNotNull())) if cells else F.lit(None).cast("array<struct<name:string,base:string,left:string,right:string>>")
    named = F.struct(*[F.col(f"_res.v{i}").alias(v) for i, v in enumerate(values)])
    out = every.withColumn("_res", result).withColumn("columns", columns)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(pk)], "class", conflict.alias("conflict"), "columns", (F.when(F.col("_res").isNotNull(), named) if values else F.lit(None)).alias("result"), F.col("_res").isNotNull().alias("stays"))


def merged_table(merged: DataFrame, pk: Sequence[str]) -> DataFrame:
    """The rows that stay, as text columns; the NULL mark becomes NULL again."""
    values = ["result.*"] if isinstance(merged.schema["result"].dataType, T.StructType) else []  # else all columns are keys
    flat = merged.filter("stays").select(*[F.col(f"`{k}`") for k in pk], *values)
    return flat.select(*[F.when(F.col(f"`{c}`") != NULL_MARK, F.col(f"`{c}`")).alias(c) for c in flat.columns])


def row_digest(df: DataFrame, numeric_only: bool = True) -> Column:
    """SHA-256 of a row's canonical texts, each with its length before it, so that no two rows run together. Texts of
    numeric columns are normalised; with numeric_only False, all are."""
    parts = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.NumericType):
            c = F.coalesce(normal_number(c, f.dataType), F.lit(NULL_MARK))
        else:
            c = encoded(c, f.dataType) if numeric_only else normal_value(encoded(c, f.dataType))
        parts += [F.length(c).cast("string"), F.lit(":"), c]
    return F.sha2(F.concat(*parts).cast("binary"), 256) if parts else F.sha2(F.lit("").cast("binary"), 256)


def _hashed(df: DataFrame) -> list[Column]:
    """What a row's hashes are taken of: numbers as whole ones or as doubles rounded to ten places, so that equal values
    of different types agree, other columns as canonical texts, and which cells are NULL."""
    out: list[Column] = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            out.append(c.cast("bigint"))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            d = c.cast("double")
            whole = (d == F.rint(d)) & (F.abs(d) < 9.2e18)
            # From 900,000 on ten places are finer than a double is.
            out += [F.when(whole, d).cast("bigint"), F.when(~whole, F.when(F.abs(d) < 9e5, F.rint(d * 1e10) / 1e10).otherwise(d))]
        elif isinstance(f.dataType, T.NumericType):
            out.append(normal_number(c, f.dataType))
        else:
            out.append(encoded(c, f.dataType))
    nulls = [F.when(F.col(f"`{f.name}`").isNull(), F.lit(1 << (k % 60))).otherwise(F.lit(0)).cast("bigint") for k, f in enumerate(df.schema)]
    for k in range(0, len(nulls), 60):
        part = nulls[k]
        for x in nulls[k + 1 : k + 60]:
            part = part.bitwiseOR(x)
        out.append(part)
    return out or [F.lit(0)]


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n_rows, digest), equal for equal multisets of rows however they are ordered or partitioned: the sums of the
    halves of two 64-bit hashes a row, digested. One partial aggregation to 4096 rows, no sort; in each of them a sum of
    halves stays below 2**63 up to 2**31 rows."""
    cells, low = _hashed(df), F.lit(0xFFFFFFFF)
    h = df.select(F.xxhash64(*cells).alias("x"), F.xxhash64(F.lit(40503), *cells).alias("y"))
    halves = [f(c).alias(f"{c}{n}") for c in "xy" for n, f in ((0, lambda c: F.sum(F.col(c).bitwiseAND(low))), (1, lambda c: F.sum(F.shiftright(c, 32))))]
    some = h.groupBy(F.col("x").bitwiseAND(F.lit(4095)).alias("g")).agg(F.count("*").alias("n"), *halves)
    total = [F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string") for c in ("x0", "x1", "y0", "y1")]
    d = some.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.concat_ws("/", *total).alias("s"))
    return d.select("n_rows", F.sha2(F.concat_ws("/", F.col("n_rows").cast("string"), "s").cast("binary"), 256).alias("digest"))


def change_status(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> list[tuple[str, str]]:
    """(table, added, removed, updated or unchanged), by fingerprints."""
    digest = lambda df: tuple(fingerprint(df).first())
    out = []
    for t in sorted({*old, *new}):
        out.append((t, "added" if t not in old else "removed" if t not in new else "unchanged" if digest(old[t]) == digest(new[t]) else "updated"))
    return out


def _run_together(batches):
    """One value a batch: the bytes of its texts one after the other, as Arrow holds them."""
    import pyarrow as pa

    for batch in batches:
        texts = batch.column(0)
        if len(texts):
            wide = pa.types.is_large_string(texts.type)
            _, offsets, data = texts.buffers()
            at = memoryview(offsets).cast("q" if wide else "i")
            yield pa.RecordBatch.from_arrays([pa.array([data[at[texts.offset] : at[texts.offset + len(texts)]].to_pybytes()], pa.binary())], names=["rows"])


def checksum(tables: Mapping[str, DataFrame], declared: Mapping[str, Sequence[tuple[str, str]]], pks: Mapping[str, Sequence[str]], views: Sequence[str] = ()) -> str:
    """SHA-256 of schema, rows and view names by the sequential protocol of the directory format. Every table is taken in
    the order of its key's texts, or of all columns without a key. The hash is sequential, so the bytes of the sorted rows
    stream through the driver, one partition at a time and a batch as one value; `fingerprint` is the parallel way to detect changes."""
    import re

    h = hashlib.sha256()
    for df in tables.values():
        ship(df.sparkSession)
    for t in sorted(tables):
        df, own = tables[t], [(c, k) for c, k in declared[t] if not re.fullmatch(ROWID, c)]
        h.update(f"TABLE:{t}\0".encode() + b"".join(f"COL:{c}:{normal_type(k)}\0".encode() for c, k in own))
        if pk := [c for c in pks.get(t, ()) if not re.fullmatch(ROWID, c)]:
            h.update(f"PK:{','.join(pk)}\0".encode())
        h.update(f"\1DATA:{t}\0".encode())
        c = canonical(df, [n for n, _ in own])
        c = c.orderBy(*[F.col(f"`{n}`") for n in (pk or c.columns)], *[F.col(f"`{n}`") for n in c.columns if n not in pk])
        line = F.concat(*[x for n in c.columns for x in (normal_value(F.col(f"`{n}`")), F.lit("\0"))], F.lit("\1")).alias("line")
        for (rows,) in c.select(line).mapInArrow(_run_together, "rows binary").toLocalIterator(prefetchPartitions=True):
            h.update(rows)
        h.update(b"\2")
    h.update(b"".join(f"VIEW:{v}\0".encode() for v in sorted(views)) + b"\3")
    return h.hexdigest()
