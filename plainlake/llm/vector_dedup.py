"""Near-duplicate vectors by E8 lattice hashing in several tables, confirmed by cosine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plainlake.llm.bytehash import mix
from plainlake.llm.shared import Workspace, components

#: 16 tables; a table's key joins two lattice points of eight projected coordinates each. With cells of this scale a pair
#: at cosine 0.93 in 64 dimensions shares a table with about 0.33 (probes included), and one at 0.2 with 0.0002.
TABLES, BLOCKS, SCALE, SEED = 16, 2, 0.25, 20240229
SKETCH = 256  # sign bits; at cosine 0.93 the mean distance is 31 bits, at 0.3 it is 103
FAR = 66
SQUARE = 512  # vectors in a side of a block that is compared at once


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the neighbours of a lattice point."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: round, and where the sum is odd, round the worst coordinate the other way."""
    r = np.rint(x)
    e = x - r
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    worst = np.abs(e[odd]).argmax(1)
    r[odd, worst] += np.where(e[odd, worst] >= 0, 1.0, -1.0)
    return r


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of D8 and D8 shifted by a half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Lattice:
    def __init__(self, dim: int):
        rng = np.random.default_rng([SEED, dim])
        gauss = lambda: rng.standard_normal((max(dim, 8), 8))
        self.project = [[np.linalg.qr(gauss())[0][:dim] * np.sqrt(dim / 64) for _ in range(BLOCKS)] for _ in range(TABLES)]
        self.signs = rng.standard_normal((dim, SKETCH))
        self.weigh = mix(np.arange(1, 8 * BLOCKS + 1, dtype=np.uint64)) | np.uint64(1)

    def keys(self, unit: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home keys, probe keys): a probe exchanges one block's point for the neighbour next nearest to the vector."""
        home, probe = [], []
        for t, blocks in enumerate(self.project):
            at = [unit @ p / SCALE for p in blocks]
            point = [nearest(x) for x in at]
            beside = [c + ROOTS[((x - c) @ ROOTS.T).argmax(1)] for x, c in zip(at, point)]
            hashed = lambda ps: mix((np.rint(2 * np.concatenate(ps, 1)).astype(np.int64).view(np.uint64) * self.weigh).sum(1, dtype=np.uint64) + salt + np.uint64(t))  # noqa: E731,B023
            home.append(hashed(point))
            probe += [hashed([beside[j] if j == k else point[j] for j in range(BLOCKS)]) for k in range(BLOCKS)]
        return np.stack(home, 1), np.stack(probe, 1)

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.signs > 0, axis=1).view(np.int64)


def _usable(vectors: list) -> list[np.ndarray | None]:
    out = []
    for v in vectors:
        x = None if v is None or None in v or not len(v) else np.asarray(v, np.float64)
        out.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ds = []
        for x in _usable(batch.column("embedding").to_pylist()):
            ds.append((None, None) if x is None else np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([d[0] for d in ds], pa.int64()), pa.array([d[1] for d in ds], pa.int64())], names=["vec_id", "label", "d1", "d2"])


def _lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[int, Lattice] = {}
    for whole in batches:
        for k in range(0, whole.num_rows, 2048):
            batch = whole.slice(k, 2048)
            vectors = _usable(batch.column("embedding").to_pylist())
            n = len(vectors)
            unit: list = [None] * n
            home, probe, sketch = np.zeros((n, TABLES), np.uint64), np.zeros((n, TABLES * BLOCKS), np.uint64), np.zeros((n, SKETCH // 64), np.int64)
            label = mix(np.array(batch.column("label").to_pylist(), np.int64).view(np.uint64))
            for dim in {len(v) for v in vectors}:
                rows = [i for i in range(n) if len(vectors[i]) == dim]
                x = np.stack([vectors[i] for i in rows])
                x = x / np.abs(x).max(1)[:, None]
                x = x / np.linalg.norm(x, axis=1)[:, None]
                lattice = tables.setdefault(dim, Lattice(dim)) if dim not in tables else tables[dim]
                home[rows], probe[rows] = lattice.keys(x, label[rows] + np.uint64(dim << 32))
                sketch[rows] = lattice.sketch(x)
                for i, u in zip(rows, x):
                    unit[i] = u
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(a).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists(home), lists(probe), lists(sketch), pa.array(unit, pa.list_(pa.float64()))], names=["id", "home", "probe", "sketch", "unit"])


def _counted(threshold: float):
    """Rows sorted by (c, i, j): the two sides of each block are compared by one product; rows and columns are counted."""

    def count(rows: pa.Table) -> tuple[list, list]:
        i, j, side = rows["i"][0].as_py(), rows["j"][0].as_py(), rows["side"].to_numpy()
        ids, m = rows["id"].to_numpy(), rows["m"].to_numpy()
        vectors = rows["unit"].to_pylist()
        got_ids, got = [], []
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if i == j else 1))
        for dim in {len(v) for v in vectors}:
            x, y = [k for k in a if len(vectors[k]) == dim], [k for k in b if len(vectors[k]) == dim]
            if x and y:
                u, v = np.stack([vectors[k] for k in x]), np.stack([vectors[k] for k in y])
                dot = u @ v.T
                for p, q in np.argwhere(np.abs(dot - threshold) < 1e-9):  # summed in the order in which links are confirmed
                    dot[p, q] = np.cumsum(u[p] * v[q])[-1]
                near = dot >= threshold
                near &= ids[x][:, None] != ids[y][None, :]
                got_ids += ids[x].tolist()
                got += (near @ m[y]).tolist()
                if i != j:
                    got_ids += ids[y].tolist()
                    got += (near.T @ m[x]).tolist()
        return got_ids, got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                ids, n = count(pa.Table.from_batches(held))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["id", "n"])
                held.clear()

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("c", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if name is not None and tuple(keys[lo]) != name:
                        yield from out()
                    name = tuple(keys[lo])
                    held.append(batch.slice(lo, hi - lo))
        yield from out()

    return run


def near_vectors(vectors: DataFrame, ws: Workspace, threshold: float = 0.93) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two vectors with equal labels (not null) and equal dimensions are linked if their cosine in double precision is
    `threshold` or more. Null, empty and zero vectors and those with null or non-finite components link with nothing.
    Equal vectors of a label are one class, of which only the smallest vec_id goes on; n_links counts them all the same.
    Rows that share a vec_id count as one vector in components. kept is vec_id = component_id; a null vec_id takes the
    component of its class. An empty table gives an empty table; other columns are not read.

    Vectors meet in the tables' cells, each vector in its own and, as a probe, beside it. First each meets the vector of
    least id in its cells, then those of other components, if the sign sketches allow it; all are verified by cosine.
    Links are then counted inside a component in squares of SQUARE by SQUARE vectors, so a group of thousands is neither
    emitted as pairs nor held by one task. Recall depends on the tables; it is measured in the tests.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    named = ws.save(rows.mapInArrow(_digests, "vec_id long, label long, d1 long, d2 long"), "digests")
    classes = named.filter("label is not null and d1 is not null").groupBy("label", "d1", "d2").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"))
    classes = ws.save(classes, "classes")
    single = classes.filter("id is not null").groupBy("id").agg(F.sum("m").alias("m"), F.min("label").alias("label"))
    chosen = rows.filter("label is not null").select(F.col("vec_id").alias("id"), "embedding", "label").join(single, ["id", "label"])
    chosen = chosen.filter((F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0))
    # Of several vectors with one id, the same one is taken in every run.
    kinds = Window.partitionBy("id").orderBy("label", F.xxhash64("embedding"), F.xxhash64(F.lit(3), "embedding"))
    chosen = chosen.withColumn("_r", F.row_number().over(kinds)).filter("_r = 1").drop("_r")
    cells = ws.save(chosen.select("id", "embedding", "label").mapInArrow(_lattice, "id long, home array<long>, probe array<long>, sketch array<long>, unit array<double>"), "cells")

    home = cells.select("id", F.explode("home").alias("key"))
    leaders = home.groupBy("key").agg(F.min("id").alias("leader"))
    meets = cells.select("id", F.explode(F.concat("home", "probe")).alias("key"))
    sketch = lambda c: cells.select(F.col("id").alias(c), F.col("sketch").alias(f"{c}_s"))
    apart = lambda x, y: sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(SKETCH // 64)), F.lit(0))
    unit = lambda c: cells.select(F.col("id").alias(c), F.col("unit").alias(f"{c}_u"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = pairs.select("a", "b").join(unit("a"), "a").join(unit("b"), "b").filter(F.size("a_u") == F.size("b_u"))
        dot = F.aggregate(F.zip_with("a_u", "b_u", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
        return x.filter(dot >= threshold).select("a", "b")

    stars = meets.join(leaders, "key").filter("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    stars = stars.join(sketch("a"), "a").join(sketch("b"), "b").filter(apart("a_s", "b_s") <= FAR).select("a", "b")
    links = ws.save(confirmed(stars), "links-1")
    of = components(links, ws, "components-1")
    to = of.select("id", F.col("component").alias("c"))
    placed = cells.select("id", "sketch", "home", "probe").join(to, "id", "left").withColumn("c", F.coalesce("c", "id"))
    placed = ws.save(placed, "placed")
    x = placed.select(F.col("id").alias("a"), F.col("c").alias("ca"), F.col("sketch").alias("a_s"), F.explode("home").alias("key"))
    y = placed.select(F.col("id").alias("b"), F.col("c").alias("cb"), F.col("sketch").alias("b_s"), F.explode(F.concat("home", "probe")).alias("key"))
    # Under a key, the component with most vectors there never meets itself.
    held = x.select("key", "ca").unionByName(y.select("key", F.col("cb").alias("ca"))).groupBy("key", "ca").agg(F.count("*").alias("n"))
    mixed = ws.save(held.groupBy("key").agg(F.max_by("ca", F.struct("n", "ca")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("key", "main"), "mixed")
    x, y = x.join(mixed, "key"), y.join(mixed, "key")
    met = x.filter("ca <> main").join(y.drop("main"), "key").unionByName(x.filter("ca = main").join(y.filter("cb <> main").drop("main"), "key"))
    pairs = met.filter((F.col("ca") != F.col("cb")) & (apart("a_s", "b_s") <= FAR)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = ws.save(confirmed(pairs), "links-2")
    of = ws.save(components(more.unionByName(of.select(F.col("id").alias("a"), F.col("component").alias("b"))), ws, "components-2"), "components")
    of = of.unionByName(of.select(F.col("component").alias("id"), "component").distinct())

    sizes = of.groupBy("component").agg(F.count("*").alias("k"))
    inside = of.join(sizes, "component").join(cells.select("id", "unit"), "id").join(single.select("id", "m"), "id")
    squares = F.ceil(F.col("k") / SQUARE).cast("int")
    inside = inside.select("id", "m", "unit", F.col("component").alias("c"), squares.alias("s")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("s")).cast("int"))
    dealt = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    dealt = dealt.select("c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "m", "unit")
    dealt = dealt.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")
    others = dealt.mapInArrow(_counted(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("others"))

    about = classes.join(single.select("id", F.col("m").alias("same")), "id", "left").join(of, "id", "left").join(others, "id", "left")
    about = about.select("label", "d1", "d2", (F.coalesce("same", "m") - 1 + F.coalesce("others", F.lit(0))).alias("_n"), F.coalesce("component", "id").alias("_c"))
    out = named.join(about, ["label", "d1", "d2"], "left").select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
