"""What the corpus operators share: row keys, bounded sets, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plainlake.session import Workspace, free_names


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(*cols: str) -> list[Column]:
    """Two independent 64-bit hashes of a row: never null, equal for equal rows only."""
    return [F.xxhash64(*cols).alias("_k1"), F.xxhash64(F.lit(7), *cols).alias("_k2")]


def ascii_space_trim(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\n\x0b\x0c\r"))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; the quick way is taken where the text is plain ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def components(edges: DataFrame, ws: Workspace, name: str, most_rounds: int = 40) -> DataFrame:
    """Connected components of the graph with edges (a, b): rows (id, component), component the smallest id.

    Alternates the large-star and small-star steps until the edges are stars; edges that are stars already cost no step. Everything is distributed; each round
    is written to the shared folder, so that lineage stays short. Ids without an edge to another id are not returned.
    An id with more than a HUBS-th of all edge ends has its neighbours' edges joined by a broadcast instead of a shuffle:
    there are at most HUBS such ids, whatever the graph, so the centre of a large star is in no single task.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = ws.save(now, f"{name}-0")
    for k in range(1, most_rounds + 1):
        n = _unless_stars(now)
        if not n:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        # An edge (a, b) with the larger a: a goes to the least neighbour of b.
        large = _to_least(now.select(F.col("b").alias("a"), F.col("a").alias("b")), least, 2 * n).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = ws.save(large, f"{name}-{k}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _to_least(large, low, 2 * n).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        now = ws.save(small, f"{name}-{k}")
    raise RuntimeError("the components did not settle")


HUBS = 256


def _unless_stars(edges: DataFrame) -> int:
    """The number of distinct edges (a, b), a > b; 0 if each a has one edge and is no b, so that every b is the least id
    of its component. One aggregation by id, to which each task sends an id once."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ids = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    got = ids.agg(F.sum("up").alias("n"), F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("open")).first()
    return got["n"] if got["open"] else 0


def _to_least(edges: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """`edges` (a, b) with m of `least` (a, m, n); hubs, of which there are HUBS at most, meet theirs by a broadcast."""
    hubs = F.broadcast(least.filter(F.col("n") * HUBS > ends).select("a", "m"))
    rest = edges.join(hubs, "a", "left_anti").join(least.filter(F.col("n") * HUBS <= ends).select("a", "m"), "a")
    return edges.join(hubs, "a").select("a", "b", "m").unionByName(rest.select("a", "b", "m"))


def rough_set(keys: DataFrame, column: str, bits: int = 1 << 22) -> DataFrame:
    """A bitmap of the hashes in `column`: at most bits / 64 rows (word, mask), 1 MB, whatever the input's size."""
    at = F.pmod(F.col(column), F.lit(bits))
    return keys.groupBy(F.floor(at / 64).cast("int").alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("_mask"))


def rough_split(rows: DataFrame, column: str, known: DataFrame, bits: int = 1 << 22) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash may be in the set, rows whose hash is not), without a shuffle: the bitmap's size is bounded by
    `bits`, so it is broadcast. Where most bits are set the first part is simply larger; a join must follow it."""
    word, mask = free_names(rows, 2)
    at = F.pmod(F.col(column), F.lit(bits))
    marked = rows.withColumn(word, F.floor(at / 64).cast("int")).join(F.broadcast(known.withColumnsRenamed({"_word": word, "_mask": mask})), word, "left")
    hit = F.coalesce(F.getbit(F.col(mask), (at % 64).cast("int")) == 1, F.lit(False))
    return marked.filter(hit).drop(word, mask), marked.filter(~hit).drop(word, mask)


__all__ = ["Workspace", "ascii_lower", "ascii_space_trim", "components", "free_names", "read", "rough_set", "rough_split", "row_key"]
