"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainlake.llm.bytehash import FOLD, chunks, mix, shingles, words
from plainlake.llm.shared import Workspace, components
from plainlake.llm.workers import lean, release

#: Collections of SIDE pairs of minhashes. A table's key joins a pair of the left and one of the right collection, so
#: SIDE**2 tables of four rows cost 4 * SIDE minhashes; at a similarity of 0.75 a table is hit with 0.32, and all are
#: missed with 0.003.
SIDE, MINHASHES = 8, 32
#: A sketch keeps four bits of each of 128 more minhashes. Two of them are equal with similarity + (1 - similarity) / 16:
#: of the 98 expected at 0.75, fewer than AGREE are with 5e-6. It costs a pair 64 bytes where its sets take kilobytes.
SKETCHED, AGREE = 128, 77
#: And a bitmap marks each shingle in one of BITS bits. Common shingles have common bits, so an intersection is at most
#: the common bits and the shingles that share a bit with another one of their own set: a bound without any error.
BITS = 1024
#: Rows of one key that are compared in one block; a key with more of them is compared in blocks, all pairs of which are.
BLOCK, PARTNERS = 1000, 3

_A = mix(np.arange(1, MINHASHES + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, 1001 + MINHASHES, dtype=np.uint64))
_C = mix(np.arange(2001, 2001 + SKETCHED // 2, dtype=np.uint64)) | np.uint64(1)


PARTS, MAP = [f"m{k}" for k in range(SKETCHED // 16)], [f"b{k}" for k in range(BITS // 64)]
SKETCH = [*PARTS, *MAP, "lost"]  # lost: shingles that share a bit with another one


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for lo, hi, data, offsets in chunks(batch.column("text")):
        w, at = words(data, offsets)
        for i in range(lo, hi):
            yield i, shingles(w[at[i - lo] : at[i - lo + 1]], size)


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(d[0]), int(d[1])


def _nibbles(x: np.ndarray) -> np.ndarray:
    """Four bits of each number, sixteen to a long."""
    bits = (mix(x.astype(np.uint64)) >> np.uint64(60)).reshape(-1, 16)
    return (bits << (np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(1, dtype=np.uint64).view(np.int64)


def _agreement(x: str, y: str) -> Column:
    """How many of the sketches' minhashes are equal, from the columns with these prefixes: fields of four bits that the
    exclusive or leaves zero."""
    out = F.lit(SKETCHED)
    for m in PARTS:
        d = F.col(x + m).bitwiseXOR(F.col(y + m))
        d = d.bitwiseOR(F.shiftright(d, 1))
        d = d.bitwiseOR(F.shiftright(d, 2)).bitwiseAND(F.lit(0x1111111111111111))
        out = out - F.bit_count(d)
    return out


def _possible(x: str, y: str, similarity: int) -> Column:
    """Whether sizes and bitmaps allow the similarity."""
    sizes = 100 * F.least(x + "w", y + "w") >= similarity * F.greatest(x + "w", y + "w")
    common = F.least(x + "lost", y + "lost")
    for b in MAP:
        common = common + F.bit_count(F.col(x + b).bitwiseAND(F.col(y + b)))
    return sizes & (100 * common >= similarity * (F.col(x + "w") + F.col(y + "w") - common))


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            n = batch.num_rows
            count, d, sig, more = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), np.zeros((n, MINHASHES), np.int32), np.zeros((n, len(PARTS) + len(MAP) + 1), np.int64)
            for i, s in _sets(batch, size):
                count[i] = len(s)
                if len(s):
                    d[i] = _digest(s)
                    least, high, low = (np.full(m, 2**32 - 1, np.uint64) for m in (MINHASHES, SKETCHED // 2, SKETCHED // 2))
                    marks = np.zeros(BITS, bool)
                    for k in range(0, len(s), 2048):
                        part = s[k : k + 2048]
                        least = np.minimum(least, ((part * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(1))
                        product = part * _C[:, None]  # its halves are two minhashes
                        high, low = np.minimum(high, (product >> np.uint64(32)).min(1)), np.minimum(low, (product & np.uint64(2**32 - 1)).min(1))
                        marks[(part >> np.uint64(54)).astype(np.int64) % BITS] = True
                    sig[i] = least.astype(np.uint32).view(np.int32)
                    more[i, : len(PARTS)] = _nibbles(np.concatenate([high, low]))
                    more[i, len(PARTS) : -1] = np.packbits(marks).view(np.int64)
                    more[i, -1] = len(s) - np.count_nonzero(marks)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * MINHASHES, MINHASHES, dtype=np.int32)), pa.array(sig.ravel()))
            pairs = sig[:, : 4 * SIDE].astype(np.int64).view(np.uint64).reshape(n, 2 * SIDE, 2)
            halves = (mix(mix(pairs[..., 0]) + pairs[..., 1] * FOLD[1]) >> np.uint64(32)).astype(np.uint32)
            packed = np.concatenate([more[:, len(PARTS) : -1].copy().view(np.uint8), more[:, : len(PARTS)].copy().view(np.uint8), halves.view(np.uint8)], 1)
            blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), n, [None, pa.py_buffer(np.ascontiguousarray(packed))]).cast(pa.binary())
            wide = pa.ListArray.from_arrays(pa.array(np.arange(0, n * more.shape[1] + 1, more.shape[1], dtype=np.int32)), pa.array(more.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), flat, wide, blob], names=["doc_id", "n", "s1", "s2", "sig", "more", "packed"])

    return run


def _alike(t: int, own: np.ndarray, same: bool, ids: np.ndarray, c: np.ndarray, w: np.ndarray, lost: np.ndarray, packed: np.ndarray, similarity: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs (a, b, agreement) of the texts of one block that are in different components and may be alike. Each text
    outside the largest component meets all, 64 at a time: those of its own part of the key if `same`, else the others."""
    marks, nibbles, halves = packed[:, : BITS // 8].view(np.uint64), packed[:, BITS // 8 : BITS // 8 + SKETCHED // 2].view(np.uint64), packed[:, BITS // 8 + SKETCHED // 2 :].view(np.uint32)
    names, counts = np.unique(c, return_counts=True)
    main = c == names[counts.argmax()]
    rows = np.flatnonzero(~main)
    for k in range(0, len(rows), 64):
        r = rows[k : k + 64]
        ok = ((own[r][:, None] == own) == same) & (c[r][:, None] != c) & (main | (ids[r][:, None] < ids)) & (100 * np.minimum(w[r][:, None], w) >= similarity * np.maximum(w[r][:, None], w))
        x, y = np.nonzero(ok)
        x = r[x]
        common = np.bitwise_count(marks[x] & marks[y]).sum(1, dtype=np.int64) + np.minimum(lost[x], lost[y])
        on = 100 * common >= similarity * (w[x] + w[y] - common)
        x, y = x[on], y[on]
        d = nibbles[x] ^ nibbles[y]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        agree = SKETCHED - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)
        on = agree >= AGREE
        equal = halves[x] == halves[y]  # the pair counts in the first table it shares: that of the first equal halves
        on &= (equal[:, :SIDE].argmax(1) == t // SIDE) & (equal[:, SIDE:].argmax(1) == t % SIDE)
        x, y, agree = x[on], y[on], agree[on]
        yield np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), agree


def _open_pairs(similarity: int):
    """Rows sorted by key, the name of a block; its rows are held together, some 2 * BLOCK at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        release()

        def out(groups: list[list[np.ndarray]]) -> pa.RecordBatch:
            found = [p for _, t, same, own, *rest in groups for p in _alike(int(t[0]), own, bool(same[0]), *rest, similarity)]
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found) if found else ([], [], []))]
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=["a", "b", "agree"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", "t", "same", "own", "id", "c", "w", "lost")]
            blob = batch.column("packed")
            at = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1]
            cols.append(np.frombuffer(blob.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(blob), -1))
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            cuts = [0, *(np.flatnonzero(np.diff(cols[0])) + 1).tolist()]
            yield out([[x[a:b] for x in cols] for a, b in zip(cuts, cuts[1:])])
            held = [x[cuts[-1] :].copy() for x in cols]
        if held is not None:
            yield out([held])

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, want = batch.column("doc_id").to_pylist(), list(zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist()))
            out, held = ([], []), 0
            for i, s in _sets(batch, size):
                if _digest(s) == want[i]:  # not another text under the same doc_id
                    out[0].append(ids[i]), out[1].append(s.view(np.int64))
                    held += len(s)
                if held > 1 << 19 or i == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64()))], names=["id", "items"])
                    out, held = ([], []), 0

    return run


def _key(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _halves(sig: str, first: int) -> Column:
    return F.array(*[_key(F.lit(k), F.col(sig)[first + 2 * k], F.col(sig)[first + 2 * k + 1]) for k in range(SIDE)])


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike; the sets travel once for each side of a pair."""
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    low, high = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    x = x.filter(100 * low >= similarity * high).withColumn("both", F.size(F.array_intersect("x", "y")))
    return x.filter(100 * F.col("both") >= similarity * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def near_duplicates(docs: DataFrame, ws: Workspace, size: int = 5, similarity: int = 75) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two texts are linked if 100 * |intersection| >= similarity * |union| of their sets of distinct shingles (`size`
    words, A-Z lower-cased; fewer words are one shingle). Null, empty and blank texts have no set and link with nothing.
    Texts with equal sets are one class, and only its smallest doc_id goes on, so groups of copies cost one row. Rows
    that share a doc_id count as one document. A row with a null doc_id belongs to the class of its text but never
    stands for it. component_id is the smallest doc_id reachable by links; kept is doc_id = component_id. An empty table
    gives an empty table; other columns are not read.

    Candidates never come as all pairs of a group. Each class first meets the leader of one of its tables, the likeliest
    by their sketches, then the leaders of its other tables unless they are connected already; then, within a table, only
    texts of different components are paired, in blocks where a key has more than BLOCK of them and without a loss:
    the PARTNERS likeliest of each text first, and at last what is not connected yet. A pair counts in the first table it
    shares. Its sizes and bitmaps must allow the similarity, and it must agree in AGREE of the sketches' minhashes; every
    link is confirmed on the full sets.
    """
    sig = ws.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_signatures(size)), "doc_id long, n long, s1 long, s2 long, sig array<int>, more array<long>, packed binary"), "signatures")
    classes = sig.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    classes = ws.save(classes, "classes")
    chosen = classes.filter("rep is not null").select(F.col("rep").alias("doc_id"), "s1", "s2")
    reps = sig.join(chosen, ["doc_id", "s1", "s2"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"])
    reps = ws.save(reps, "representatives")

    tables = reps.select(F.col("doc_id").alias("id"), _halves("sig", 0).alias("l"), _halves("sig", 2 * SIDE).alias("r"))
    keys = F.array(*[_key(F.lit(SIDE * i + j), F.col("l")[i], F.col("r")[j]) for i in range(SIDE) for j in range(SIDE)])
    tables = tables.select("id", F.posexplode(keys).alias("t", "key"))
    # Exclusive or with the key orders the ids of every table anew: each table has a leader of its own.
    turned = F.col("id").bitwiseXOR(F.col("key"))
    shared = tables.groupBy("key").agg(F.min(turned).alias("_low"), F.max(turned).alias("_high")).filter("_low <> _high")
    tables = ws.save(tables.join(shared.select("key", F.col("_low").bitwiseXOR(F.col("key")).alias("leader")), "key"), "tables")

    wanted = tables.select(F.col("id").alias("doc_id")).distinct()
    wanted = reps.join(wanted, "doc_id", "left_semi").select("doc_id", "s1", "s2")
    with_text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("shuffle_hash"), "doc_id")
    sets = ws.save(with_text.mapInArrow(lean(_full_sets(size)), "id long, items array<long>"), "sets")

    sketches = ws.save(reps.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("n").alias("w"), "packed", *[F.col("more")[k].alias(m) for k, m in enumerate(SKETCH)]), "sketches")

    def likely(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the sizes and the sketches allow, with their agreement."""
        side = lambda c: sketches.select(F.col("id").alias(c), F.col("w").alias(f"{c}_w"), *[F.col(m).alias(f"{c}_{m}") for m in SKETCH])
        x = pairs.join(side("a"), "a").join(side("b"), "b").filter(_possible("a_", "b_", similarity))
        return x.select(*pairs.columns, _agreement("a_", "b_").alias("agree")).filter(F.col("agree") >= AGREE)

    stars = tables.filter("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    stars = ws.save(likely(stars), "stars")
    best = stars.groupBy("a").agg(F.max(F.struct("agree", (-F.col("b")).alias("l"))).alias("m")).select("a", (-F.col("m.l")).alias("b"))
    links = ws.save(_confirmed(best, sets, similarity), "links-1")
    of = components(links, ws, "components-1")

    def labelled(x: DataFrame, column: str, name: str) -> DataFrame:
        return x.join(of.select(F.col("id").alias(column), F.col("component").alias("_c")), column, "left").withColumn(name, F.coalesce("_c", F.col(column))).drop("_c")

    others = labelled(labelled(stars.select("a", "b"), "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
    links = ws.save(_confirmed(others.join(best, ["a", "b"], "left_anti"), sets, similarity), "links-2")
    of = components(links.union(of.select(F.col("id").alias("a"), F.col("component").alias("b"))), ws, "components-2")

    def split(t: DataFrame) -> DataFrame:
        """The rows of keys under which more than one component meets, with the number of rows of the key."""
        keys = t.groupBy("key").agg(F.min("c").alias("_x"), F.max("c").alias("_y"), F.count("*").alias("m")).filter("_x <> _y").select("key", "m")
        return t.join(keys, "key")

    open_ = ws.save(split(labelled(tables.select("key", "t", "id"), "id", "c")), "open")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = open_.withColumn("own", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    block = _key(F.col("key"), F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(block.alias("key"), "t", (F.col("own") == F.col("other")).cast("int").alias("same"), "own", "id", "c").join(sketches.select("id", "w", "lost", "packed"), "id")
    dealt = dealt.select("key", "t", "same", "own", "id", "c", "w", "lost", "packed").repartition("key").sortWithinPartitions("key")
    pairs = dealt.mapInArrow(lean(_open_pairs(similarity)), "a long, b long, agree long").groupBy("a", "b").agg(F.max("agree").alias("agree"))
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = ws.save(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    # The likeliest partners of each text first: in a group of near copies few of the other pairs are open after that.
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    nearest = both.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("agree"), "b"))).filter(F.col("_r") <= PARTNERS)
    nearest = ws.save(nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "nearest")
    links = ws.save(_confirmed(nearest, sets, similarity), "links-3")
    of = components(links.union(of.select(F.col("id").alias("a"), F.col("component").alias("b"))), ws, "components-3")
    left = labelled(labelled(pairs.join(nearest, ["a", "b"], "left_anti"), "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
    links = ws.save(_confirmed(left, sets, similarity), "links-4")
    of = components(links.union(of.select(F.col("id").alias("a"), F.col("component").alias("b"))), ws, "components-4")

    to = classes.join(of.select(F.col("id").alias("rep"), "component"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("_to"))
    out = sig.select("doc_id", "n", "s1", "s2").join(to, ["n", "s1", "s2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_to", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
