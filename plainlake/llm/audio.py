"""Media columns: chroma fingerprints of audio, and their alignment by offset histograms and bit errors."""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainlake.llm.bytehash import mix
from plainlake.llm.shared import Workspace, components
from plainlake.session import ship

FRAME, HOP, CLASSES, WIDTH, LOWEST = 1024, 256, 12, 12, 55.0
MOST_ERRORS, LEAST_FRAMES, APART = 0.2, 9, 8


@lru_cache(8)
def _bins(rate: int) -> np.ndarray:
    """Of each frequency bin the pitch class, as a one-hot row; bins below LOWEST Hz belong to none."""
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(f), CLASSES))
    ok = np.flatnonzero(f >= LOWEST)
    out[ok, np.rint(CLASSES * np.log2(f[ok] / LOWEST)).astype(int) % CLASSES] = 1
    return out


@lru_cache(1)
def _filters() -> list[tuple[int, int, int, int]]:
    """32 filters (kind, first class, classes, frames), by rule: a hash deals the shapes."""
    h = [int(x) for x in mix(np.arange(1, 129, dtype=np.uint64)) >> np.uint64(33)]
    return [(h[4 * k] % 4, h[4 * k + 1] % CLASSES, 2 + h[4 * k + 2] % 6, 4 + 2 * (h[4 * k + 3] % 5)) for k in range(32)]


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Pitch-class frames: the energy of the spectrum folded into one octave, as shares of the recording's loudest frame,
    so that loudness doesn't count but loud frames outweigh quiet ones."""
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), CLASSES))
    window = np.hanning(FRAME)
    for k in range(0, len(frames), 2048):
        out[k : k + 2048] = (np.abs(np.fft.rfft(frames[k : k + 2048] * window, axis=1)) ** 2) @ _bins(rate)
    top = out.sum(1).max(initial=0.0)
    return np.where(out > top * 1e-9, out / top, 0.0) if top > 0 else out * 0.0


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """One packed 32-bit number a frame. An integral image gives any rectangle's sum in four reads; a filter compares two
    halves of a rectangle of classes (cyclic) and frames, or its middle with its sides, and its sign is a bit. Silent
    stretches give no number: they would all be alike."""
    c = chroma(samples, rate)
    n = len(c) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 2 * CLASSES + 1))
    image[1:, 1:] = np.concatenate([c, c], 1).cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0, t1, c0, c1):
        return image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]

    out = np.zeros(n, np.uint64)
    for k, (kind, low, high, wide) in enumerate(_filters()):
        mid, half = low + high // 2, wide // 2
        if kind == 0:
            v = area(0, wide, low, mid) - area(0, wide, mid, low + 2 * (high // 2))
        elif kind == 1:
            v = area(0, half, low, low + high) - area(half, wide, low, low + high)
        elif kind == 2:
            v = area(0, half, low, mid) + area(half, wide, mid, low + high) - area(half, wide, low, mid) - area(0, half, mid, low + high)
        else:
            third = wide // 3
            v = area(third, 2 * third, low, low + high) - (area(0, third, low, low + high) + area(2 * third, 3 * third, low, low + high)) / 2
        out |= (v > 0).astype(np.uint64) << np.uint64(k)
    silent = area(0, WIDTH, 0, CLASSES) <= 0
    return np.where(silent, np.uint64(0), out).astype(np.uint32)


def decode(media: bytes | None) -> tuple[np.ndarray, int]:
    """Samples (mono, -1 to 1) and rate of a PCM WAV file of 8, 16, 24 or 32 bits; nothing if it can't be read."""
    try:
        with wave.open(io.BytesIO(media or b"")) as w:
            raw, size, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
        if size == 3:  # the three bytes are the upper ones of four
            raw, size = np.pad(np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3), ((0, 0), (1, 0))).tobytes(), 4
        x = np.frombuffer(raw, {1: np.uint8, 2: np.int16, 4: np.int32}[size]).astype(np.float64)
        x = (x - 128) / 128 if size == 1 else x / float(1 << (8 * size - 1))
        return x[: len(x) // channels * channels].reshape(-1, channels).mean(1), rate
    except (wave.Error, EOFError, KeyError, ZeroDivisionError):
        return np.zeros(0), 8000


def encode(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def tones(values, rate: int = 4000, length: int = 512) -> np.ndarray:
    """A recording of a vector: each component sounds for `length` samples, as loud as it is large; its place deals the
    pitch class, and a negative one is half an octave higher.

    There is no audio among the tables; this makes a media column of any column of numbers."""
    v = np.asarray([x for x in values if x is not None and np.isfinite(x)], np.float64)
    if not len(v) or not v.any():
        return np.zeros(0)
    pitch = 220 * 2 ** ((7 * np.arange(len(v)) % CLASSES + np.where(v > 0, 0, CLASSES // 2)) / CLASSES)
    phase = 2 * np.pi * np.cumsum(np.repeat(pitch / rate, length))
    return 0.9 * np.sin(phase) * np.repeat(np.abs(v) / np.abs(v).max(), length)


def render(rows: DataFrame, id_column: str, values: str) -> DataFrame:
    """(id, media): a WAV file of each row's values; null values give null media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                media = [None if v is None else encode(tones(v), 4000) for v in b.column("v").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(media, pa.binary())], names=["id", "media"])

    ship(rows.sparkSession)
    return rows.select(F.col(id_column).cast("long").alias("id"), F.col(values).alias("v")).mapInArrow(run, "id long, media binary")


def fingerprints(recordings: DataFrame) -> DataFrame:
    """(id, d1, d2, prints): the packed numbers of each recording (id, media), and a digest of them. Media that is null,
    empty, too short or no PCM WAV has no prints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(*decode(m.as_py())).view(np.int32) for m in batch.column("media")]
            d = [np.frombuffer(hashlib.blake2b(p.tobytes(), digest_size=16).digest(), np.int64) for p in prints]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([int(x[0]) for x in d], pa.int64()), pa.array([int(x[1]) for x in d], pa.int64()), pa.array(prints, pa.list_(pa.int32()))], names=["id", "d1", "d2", "prints"])

    ship(recordings.sparkSession)
    return recordings.select(F.col("id").cast("long").alias("id"), "media").mapInArrow(run, "id long, d1 long, d2 long, prints array<int>")


def _overlap(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, o, shift, votes) with n_frames, bit_errors and error_rate of the prints that overlap there, of those that hold."""
    side = lambda c, p: classes.select(F.col("c").alias(c), F.col("prints").alias(p))
    x = pairs.join(side("c", "x"), "c").join(side("o", "y"), "o")
    n = F.least(F.size("x") - F.greatest(F.col("shift"), F.lit(0)), F.size("y") - F.greatest(-F.col("shift"), F.lit(0)))
    x = x.withColumn("n_frames", n).filter(F.col("n_frames") >= LEAST_FRAMES)
    part = lambda p, shift: F.slice(p, F.greatest(shift, F.lit(0)) + 1, F.col("n_frames"))
    wrong = F.zip_with(part("x", F.col("shift")), part("y", -F.col("shift")), lambda a, b: F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(0xFFFFFFFF))))
    x = x.withColumn("bit_errors", F.aggregate(wrong, F.lit(0).cast("long"), lambda s, e: s + e)).withColumn("error_rate", F.col("bit_errors") / (32.0 * F.col("n_frames")))
    return x.filter(F.col("error_rate") <= MOST_ERRORS).select("c", "o", "shift", "votes", "n_frames", "bit_errors", "error_rate")


def align(recordings: DataFrame, ws: Workspace, least_votes: int = 2) -> DataFrame:
    """One row per row of `recordings` (id, media): id, n_prints, class_id (the smallest id with the same prints),
    component_id (the smallest id reachable by alignments, itself included), kept (id = component_id), and the alignment
    with the likeliest other recording: match_id, shift (its frame 0 lies at this frame), votes, n_frames, bit_errors,
    error_rate, all null if there is none.

    Equal pairs of prints, APART frames from each other, vote for the shift between two recordings (an offset histogram);
    one print alone would meet too many others by chance. A shift with `least_votes` is tried by the share of different
    bits over the frames that overlap: at most MOST_ERRORS over LEAST_FRAMES or more. Two recordings with such a shift are
    linked. Recordings with equal prints are one class, whatever their number and length, and linked at shift 0 without a
    vote. Others need APART + least_votes prints that change (FRAME + HOP * (WIDTH + APART + least_votes - 2) samples).

    No group is emitted as all of its pairs: first each class meets, under each key, the class of least id there; then
    only classes of different components meet, and of the largest component under a key none meets another of its own.
    The match is the link tried with most votes (then the longest, the smallest id and shift); a copy matches its class_id.

    Null, empty, too short and unreadable media have no prints and link with nothing. A null id belongs to the class of its
    prints but never stands for it. Ids that repeat are one recording with several versions. An empty table gives an empty
    table; other columns are not read.
    """
    prints = ws.save(fingerprints(recordings), "prints")
    some = prints.filter("size(prints) > 0")
    classes = some.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("prints").alias("prints"))
    classes = ws.save(classes.select(F.xxhash64("d1", "d2").alias("c"), "d1", "d2", "rep", "prints"), "classes")
    usable = classes.filter("rep is not null")
    n = F.greatest(F.size("prints") - APART, F.lit(0))
    keys = F.zip_with(F.slice("prints", 1, n), F.slice("prints", APART + 1, n), lambda a, b: F.when((a != 0) & (b != 0), F.xxhash64(a, b)))
    firsts = F.transform("keys", lambda k, i: F.when((i == 0) | ~k.eqNullSafe(F.get("keys", i - 1)), k))  # a note that is held votes once
    codes = usable.select("c", "rep", keys.alias("keys")).select("c", "rep", F.posexplode(firsts).alias("at", "code")).filter("code is not null")
    shared = codes.groupBy("code").agg(F.min(F.struct("rep", "c", "at")).alias("l"), F.min("c").alias("_x"), F.max("c").alias("_y")).filter("_x <> _y")
    shared = ws.save(shared.select("code", F.col("l.c").alias("o"), F.col("l.at").alias("o_at")), "shared")
    codes = ws.save(codes.join(shared.select("code"), "code", "left_semi"), "codes")

    def voted(met: DataFrame) -> DataFrame:
        """(c, o, shift, votes) from rows (c, at, o, o_at): `o` starts at frame `shift` of `c`."""
        return met.groupBy("c", "o", (F.col("at") - F.col("o_at")).alias("shift")).agg(F.count("*").alias("votes")).filter(F.col("votes") >= least_votes)

    found = ws.save(_overlap(voted(codes.join(shared, "code").filter("c <> o")), usable), "links-1")
    named = usable.select("c", "rep")
    ends = lambda x: x.select("c", "o").distinct().join(named, "c").join(named.select(F.col("c").alias("o"), F.col("rep").alias("b")), "o").select(F.col("rep").alias("a"), "b")
    several = some.filter("id is not null").select("id", F.xxhash64("d1", "d2").alias("c")).distinct().join(named, "c")
    versions = several.groupBy("id").agg(F.min("rep").alias("b"), F.collect_set("rep").alias("reps")).filter("size(reps) > 1").select(F.explode("reps").alias("a"), "b")
    of = components(ends(found).unionByName(versions), ws, "components-1")

    placed = codes.join(of.select(F.col("id").alias("rep"), F.col("component").alias("p")), "rep", "left").select("code", "c", "at", F.coalesce("p", "rep").alias("p"))
    held = placed.groupBy("code", "p").agg(F.count("*").alias("n"))
    mixed = ws.save(held.groupBy("code").agg(F.max_by("p", F.struct("n", "p")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("code", "main"), "mixed")
    open_ = ws.save(placed.join(mixed, "code"), "open")
    # A pair counts once: a row outside the main component meets the main one, and of its like those with a larger class.
    met = open_.filter("p <> main").join(open_.select("code", F.col("c").alias("o"), F.col("at").alias("o_at"), F.col("p").alias("q"), "main"), ["code", "main"])
    met = met.filter((F.col("p") != F.col("q")) & ((F.col("q") == F.col("main")) | (F.col("c") < F.col("o"))))
    turn = F.col("c") < F.col("o")
    met = met.select(F.when(turn, F.col("c")).otherwise(F.col("o")).alias("c"), F.when(turn, F.col("at")).otherwise(F.col("o_at")).alias("at"), F.when(turn, F.col("o")).otherwise(F.col("c")).alias("o"), F.when(turn, F.col("o_at")).otherwise(F.col("at")).alias("o_at"))
    more = ws.save(_overlap(voted(met), usable), "links-2")
    of = components(ends(more).unionByName(of.select(F.col("id").alias("a"), F.col("component").alias("b"))), ws, "components-2")

    links = found.unionByName(more)
    back = links.select(F.col("o").alias("c"), F.col("c").alias("o"), (-F.col("shift")).alias("shift"), "votes", "n_frames", "bit_errors", "error_rate")
    both = links.unionByName(back).join(named.select(F.col("c").alias("o"), F.col("rep").alias("match_id")), "o")
    best = both.groupBy("c").agg(F.max(F.struct("votes", "n_frames", (-F.col("match_id")).alias("m"), (-F.col("shift")).alias("s"), "bit_errors", "error_rate")).alias("b"))
    about = classes.select("c", "d1", "d2", "rep").join(best, "c", "left").join(of.select(F.col("id").alias("rep"), "component"), "rep", "left")
    # The versions of an id are in one component, that of the least of them; an id that stands for no class takes its class's.
    out = prints.select("id", "d1", "d2", F.size("prints").alias("n")).join(about.select("d1", "d2", "rep", "component", "b"), ["d1", "d2"], "left")
    copy = F.col("rep").isNotNull() & ~F.col("id").eqNullSafe(F.col("rep"))
    cell = lambda same, link: F.when(copy, same).otherwise(link)
    n = F.col("n").cast("long")
    out = out.select(
        "id", F.greatest(n, F.lit(0)).alias("n_prints"), F.coalesce("rep", "id").alias("class_id"), F.coalesce("component", "rep", "id").alias("component_id"),
        cell(F.col("rep"), -F.col("b.m")).alias("match_id"), cell(F.lit(0), -F.col("b.s")).cast("long").alias("shift"), cell(F.lit(None), F.col("b.votes")).alias("votes"),
        cell(n, F.col("b.n_frames").cast("long")).alias("n_frames"), cell(F.lit(0), F.col("b.bit_errors")).cast("long").alias("bit_errors"), cell(F.lit(0.0), F.col("b.error_rate")).alias("error_rate"),
    )
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
