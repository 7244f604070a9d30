"""Removal of long byte strings that occur more than once: a depth-limited radix sort of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainlake.llm.bytehash import Powers, mix, prefix, spans
from plainlake.llm.shared import HUBS, Workspace, free_names, rough_set, rough_split

_SEGMENT, _LOW = 1 << 19, (1 << 20) - 1


class Depths:
    """The digits of the radix passes for a threshold of `depth` bytes: first `gram` bytes at a chosen suffix, then the
    core that all windows of a bucket of offsets share, then the hull of the bucket, then single windows."""

    def __init__(self, depth: int):
        if depth < 16:
            raise ValueError("the threshold must be at least 16 bytes")
        self.depth, self.gram = depth, max(8, depth * 128 // 400)
        self.reach = depth - self.gram + 1  # suffixes of which a window holds the whole gram
        self.step = -(-self.reach // 4)


def _bytes(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)


def anchors(p: np.ndarray, d: Depths) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, place, first window, last window) of the suffixes that stand for the windows of a text with prefix
    hashes p. Each window of `depth` bytes is given to the gram of least hash in it, the rightmost of equals: that depends
    on the window's bytes alone, so equal windows choose the same gram at the same offset."""
    n = len(p) - 1
    if n < d.depth:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    _, down = Powers.get(n + 1)
    gram = mix((p[d.gram :] - p[: -d.gram]) * down[: n - d.gram + 1])
    place, first, last = [], [], []
    for s in range(0, n - d.depth + 1, _SEGMENT):
        windows = min(_SEGMENT, n - d.depth + 1 - s)
        part = gram[s : s + windows + d.reach - 1]
        c = (part & ~np.uint64(_LOW)) | (np.uint64(_LOW) - np.arange(len(part), dtype=np.uint64))
        c = np.concatenate([c, np.full(-len(c) % d.reach, 2**64 - 1, np.uint64)]).reshape(-1, d.reach)
        up = np.minimum.accumulate(c, 1).ravel()
        back = np.minimum.accumulate(c[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(back[:windows], up[d.reach - 1 : d.reach - 1 + windows])
        chosen = (np.uint64(_LOW) - (least & np.uint64(_LOW))).astype(np.int64)
        cut = np.flatnonzero(np.diff(chosen)) + 1
        place.append(s + chosen[np.concatenate([[0], cut])])
        first.append(s + np.concatenate([[0], cut]))
        last.append(s + np.concatenate([cut - 1, [windows - 1]]))
    place = np.concatenate(place)
    return gram[place], place, np.concatenate(first), np.concatenate(last)


def entries(p: np.ndarray, d: Depths, chosen) -> tuple[np.ndarray, ...]:
    """(gram, core, hull, first window, last window) of the buckets of the anchors at places `chosen`."""
    gram, place, first, last = anchors(p, d)
    on = np.isin(place, chosen)
    gram, place, first, last = gram[on], place[on], first[on], last[on]
    out: list[tuple[np.ndarray, ...]] = []
    for k in range(4):
        near, far = np.maximum(place - last, k * d.step), np.minimum(place - first, (k + 1) * d.step - 1)
        ok = near <= far
        x, near, far = place[ok], near[ok], far[ok]
        a = x - k * d.step
        core = mix(spans(p, a, a - d.step + 1 + d.depth) + np.uint64(k))
        hull = mix(spans(p, x - far, x - near + d.depth) + far.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out.append((gram[ok], core, hull, x - far, x - near))
    return tuple(np.concatenate(c) for c in zip(*out))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _sizes(batch, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text."""
    size = np.cumsum([len(v.as_buffer()) if v.is_valid else 0 for v in batch.column("text")])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _first_digits(depth: int):
    def run(batches):
        d, seen = Depths(depth), set()
        for whole in batches:
            for batch in _sizes(whole):
                keys = list(zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist()))
                lengths, grams, places = [], [], []
                for key, value in zip(keys, batch.column("text")):
                    if key in seen or not value.is_valid or len(value.as_buffer()) < depth:  # a copy in the same task
                        lengths.append(0)
                        continue
                    seen.add(key)
                    g, x, _, _ = anchors(prefix(_bytes(value)), d)
                    lengths.append(len(g)), grams.append(g), places.append(x)
                at = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
                x = np.concatenate(places) if places else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), batch.column("n_bytes"), pa.ListArray.from_arrays(at, _long(g)), pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32)))], names=["t1", "t2", "n_bytes", "grams", "places"])

    return run


def _rows(keys: list[list], columns: list[list], names: list[str]) -> pa.RecordBatch:
    n = [len(c) for c in columns[0]]
    head = [pa.array(np.repeat(np.array(k, np.int64), n)) for k in keys]
    body = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
    return pa.RecordBatch.from_arrays(head + [_long(c) if c.dtype == np.uint64 else pa.array(c.astype(np.int32)) for c in body], names=["t1", "t2", *names])


def _later_digits(depth: int):
    def run(batches):
        d = Depths(depth)
        for whole in batches:
            for batch in _sizes(whole, 1 << 22):
                found: list[list] = [[], [], [], [], []]
                for value, places in zip(batch.column("text"), batch.column("places")):
                    for c, x in zip(found, entries(prefix(_bytes(value)), d, places.values.to_numpy(zero_copy_only=False))):
                        c.append(x)
                yield _rows([batch.column("t1").to_pylist(), batch.column("t2").to_pylist()], found, ["gram", "core", "hull", "lo", "hi"])

    return run


def _windows(depth: int):
    def run(batches):
        for whole in batches:
            for batch in _sizes(whole, 1 << 21):
                found: list[list] = [[], [], []]
                for value, todo in zip(batch.column("text"), batch.column("todo")):
                    p = prefix(_bytes(value))
                    lo, hi, gram = (todo.values.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "gram"))
                    n = hi - lo + 1
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    found[0].append(np.repeat(gram, n).astype(np.int64).view(np.uint64)), found[1].append(spans(p, at, at + depth)), found[2].append(at)
                yield _rows([batch.column("t1").to_pylist(), batch.column("t2").to_pylist()], found, ["gram", "window", "lo"])

    return run


def _remove(depth: int, keep: list[str], at: str, texts: bool):
    def run(batches):
        for whole in batches:
            for batch in _sizes(whole):
                out: list[list] = [[], [], [], []]
                for value, cuts in zip(batch.column("text"), batch.column(at)):
                    b = _bytes(value)
                    left, spans_ = b, 0
                    if cuts.is_valid and len(cuts):
                        turn = np.zeros(len(b) + 1, np.int64)
                        np.add.at(turn, cuts.values.field("lo").to_numpy(zero_copy_only=False), 1)
                        np.add.at(turn, cuts.values.field("hi").to_numpy(zero_copy_only=False) + depth, -1)
                        gone = np.cumsum(turn[:-1]) > 0
                        left, spans_ = b[~gone], int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
                    raw = left.tobytes()
                    out[0].append(len(b) - len(left)), out[1].append(spans_), out[2].append(hashlib.sha256(raw).hexdigest())
                    out[3].append(raw if texts else None)
                cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())] + ([pa.array(out[3], pa.binary())] if texts else [])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], names=[*keep, "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])])

    return run


def _held(rows: DataFrame, digits: DataFrame, by: list[str]) -> DataFrame:
    """The rows of which `digits` (by…, n: its rows) has the key. Keys with more than a HUBS-th of the rows are HUBS at
    most, whatever the data; their rows meet them by a broadcast and stay where they are, all others by a shuffle."""
    every = digits.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(digits.filter(F.col("n") * HUBS > every).select(*by))
    rest = digits.filter(F.col("n") * HUBS <= every).select(*by)
    return rows.join(hot, by, "left_semi").unionByName(rows.join(hot, by, "left_anti").join(rest, by, "left_semi"))


def remove_repeats(docs: DataFrame, ws: Workspace, depth: int = 400, texts: bool = False) -> DataFrame:
    """`docs` with n_bytes, n_removed, n_spans, kept_sha256 (and with `texts`, kept: the remaining bytes).

    Texts are UTF-8 bytes, null is empty; a byte goes if a string of `depth` bytes that covers it starts anywhere else too,
    in the same text or another one, overlaps included, judged on the input. Equal rows are two texts. Texts shorter than
    `depth` stay; clashing columns give way; an empty table gives an empty table.

    Windows of `depth` bytes are equal if and only if their suffixes fall into one group at that depth. The most
    significant digit is a gram of the window at a place its bytes choose, so that one suffix stands for some hundred
    windows; groups of one leave at once. The next pass orders by the core, which all windows of a bucket of offsets
    share; the next by the hull, which holds them all: equal hulls settle a bucket. What is left is ordered by whole
    windows. Passes count by partial aggregation; the rows of a hot group stay in their tasks, so no
    group meets in one. Copies of a text are one text
    here; texts that a pass doesn't need are kept out of the shuffle by a bitmap of bounded size. Hashes have 64 bits, and
    a match needs two of them (gram and window).
    """
    named = docs.select(*docs.columns, *([] if "text" in docs.columns else [F.lit(None).cast("string").alias("text")]))
    t1, t2, at = free_names(named, 3)
    keyed = named.withColumn("text", F.coalesce("text", F.lit(""))).withColumns({t1: F.xxhash64("text"), t2: F.xxhash64(F.lit(5), "text"), "n_bytes": F.octet_length("text").cast("long")})
    source = keyed.select(F.col(t1).alias("t1"), F.col(t2).alias("t2"), "n_bytes", "text")
    here = F.xxhash64("t1", "t2", "lo")
    met = [F.min(here).alias("_a"), F.max(here).alias("_b")]

    def repeated(rows: DataFrame, *by: str) -> DataFrame:
        """The rows whose digits occur at two places."""
        found = rows.groupBy(*by).agg(*met, F.count("*").alias("n")).filter("_a <> _b").select(*by, "n")
        return _held(rows, ws.save(found, "repeated-" + "-".join(by)), list(by))

    first = ws.save(source.mapInArrow(_first_digits(depth), "t1 long, t2 long, n_bytes long, grams array<long>, places array<int>"), "first")
    suffix = first.select("t1", "t2", F.explode(F.arrays_zip("grams", "places")).alias("x")).select("t1", "t2", F.col("x.grams").alias("gram"), F.col("x.places").alias("lo"))
    spots = repeated(suffix, "gram").groupBy("t1", "t2").agg(F.collect_set("lo").alias("places"))
    spots = ws.save(spots, "spots")

    def with_text(keys: DataFrame) -> DataFrame:
        """`keys` (t1, t2, ...) with the text of each."""
        near, _ = rough_split(source.filter(F.col("n_bytes") >= depth), "t1", rough_set(keys, "t1"))
        return near.groupBy("t1", "t2").agg(F.first("text").alias("text")).join(keys.hint("shuffle_hash"), ["t1", "t2"])

    buckets = ws.save(with_text(spots).mapInArrow(_later_digits(depth), "t1 long, t2 long, gram long, core long, hull long, lo int, hi int"), "buckets")
    alike = ws.save(repeated(buckets, "gram", "core"), "cores")
    hulls = ws.save(alike.groupBy("gram", "core", "hull").agg(*met, F.count("*").alias("n")), "hulls")
    settled = _held(alike, hulls.filter("_a <> _b"), ["gram", "core", "hull"]).select("t1", "t2", "lo", "hi")
    unsettled = ws.save(hulls.groupBy("gram", "core").agg(F.max(F.col("_a") == F.col("_b")).alias("any"), F.count("*").alias("n")).filter("any").select("gram", "core", "n"), "unsettled")
    chosen = _held(hulls, unsettled, ["gram", "core"]).select("gram", "core", "hull", "_a")
    todo = alike.withColumn("_a", here).join(chosen, ["gram", "core", "hull", "_a"], "left_semi").select("t1", "t2", F.struct("lo", "hi", "gram").alias("e"))
    todo = ws.save(todo.groupBy("t1", "t2").agg(F.collect_set("e").alias("todo")), "todo")
    windows = ws.save(with_text(todo).mapInArrow(_windows(depth), "t1 long, t2 long, gram long, window long, lo int"), "windows")
    single = repeated(windows, "gram", "window").select("t1", "t2", "lo", F.col("lo").alias("hi"))
    copied = first.groupBy("t1", "t2").agg(F.count("*").alias("m"), F.max("n_bytes").alias("n")).filter((F.col("m") > 1) & (F.col("n") >= depth))
    whole = copied.select("t1", "t2", F.lit(0).alias("lo"), (F.col("n") - depth).cast("int").alias("hi"))
    cuts = settled.unionByName(single).unionByName(whole).groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))
    cuts = ws.save(cuts, "cuts")

    new = ["n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]
    keep = [c for c in docs.columns if c not in ("n_bytes", "text", *new)] + ["n_bytes"]
    kinds = dict(keyed.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_removed long, n_spans long, kept_sha256 string"] + ["kept binary"] * texts)
    near, far = rough_split(keyed, t1, rough_set(cuts, "t1"))
    own = [F.col(f"`{c}`") for c in keep]
    touched = near.join(cuts.withColumnsRenamed({"t1": t1, "t2": t2, "cuts": at}), [t1, t2], "left").select(*own, "text", at).mapInArrow(_remove(depth, keep, at, texts), schema)
    raw = F.col("text").cast("binary")
    free = far.select(*own, F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), *([raw.alias("kept")] if texts else []))
    return touched.unionByName(free)
