"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plainlake.llm.bytehash import Powers, mix, prefix, spans
from plainlake.llm.pieces import texts_of
from plainlake.llm.workers import held, lean
from plainlake.session import ship

#: Runs of letters, and of other numbers than digits, which letters() takes out. A word is scored with a space before it,
#: as the vocabulary has its word starts.
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
LONGEST = 32  # bytes of a word that is scored together with others: no product of so few pieces underflows


def letters(text: str) -> list[str]:
    """The runs of letters (\\p{L}) of a text."""
    found = WORD.findall(text)
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def vocabulary(path: str) -> dict[bytes, int]:
    """The pieces of a rank file (base64 piece, rank): every byte is one, so that any text can be segmented."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@dataclass
class Model:
    """Log probabilities of the pieces, one column a language."""

    languages: list[str]
    pieces: dict[bytes, int]
    log_p: np.ndarray
    longest: int

    def __post_init__(self):
        self.version = hashlib.sha256(self.log_p.tobytes() + repr(self.languages).encode()).hexdigest()
        self.reach: dict[bytes, int] = {}  # the longest piece with these first four bytes
        sizes: dict[int, list[bytes]] = {}
        for w in self.pieces:
            if len(w) > 4:
                self.reach[w[:4]] = max(self.reach.get(w[:4], 4), len(w))
            if len(w) <= LONGEST:
                sizes.setdefault(len(w), []).append(w)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: the hashes of the pieces in order, and their probabilities
        for n, names in sizes.items():
            data = np.frombuffer(b"".join(names), np.uint8)
            starts = np.arange(0, len(data), n)
            hashes = spans(prefix(data), starts, starts + n)
            order = np.argsort(hashes)
            self.tables[n] = hashes[order], np.exp(self.log_p[[self.pieces[names[i]] for i in order]])

    @cached_property
    def rows(self) -> dict[bytes, list[float]]:
        """Probabilities by piece; only words over LONGEST bytes ask for them."""
        p = np.exp(self.log_p).tolist()
        return {w: p[i] for w, i in self.pieces.items()}

    def word(self, word: str) -> list[float]:
        """Log probability of a word in each language, all its segmentations summed by the forward algorithm: ways[j] is
        the probability of the first j bytes, the sum over pieces w that end there of ways[j - len(w)] * p(w)."""
        b = (" " + word.lower()).encode()
        n, k, get = len(b), len(self.languages), self.rows.get
        ways, scale = [[1.0] * k] + [[0.0] * k for _ in range(n)], [0.0] * k
        for i in range(n):
            w = ways[i]
            if i and i % 16 == 0 and min(w) < 1e-100:  # a long word would underflow: all that is still to be used grows alike
                ahead = ways[i : i + self.longest + 1]
                top = [max(v[x] for v in ahead) or 1.0 for x in range(k)]
                for v in ahead:
                    v[:] = [y / t for y, t in zip(v, top)]
                scale = [s + math.log(t) for s, t in zip(scale, top)]
            for j in range(i + 1, min(n, i + self.reach.get(b[i : i + 4], 4)) + 1):
                if (p := get(b[i:j])) is not None:
                    to = ways[j]
                    for x in range(k):
                        to[x] += w[x] * p[x]
        return [math.log(x) + s if x > 0 else -math.inf for x, s in zip(ways[n], scale)]

    def words(self, words: list[str]) -> np.ndarray:
        """word() for many: words of equal length go through the forward algorithm together, a piece is found by the hash
        of its bytes. What is over LONGEST bytes takes word(), which has the same sums."""
        raw = [(" " + w.lower()).encode() for w in words]
        out = np.empty((len(words), len(self.languages)))
        by: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            by.setdefault(len(b), []).append(i)
        _, down = Powers.get(LONGEST + 1)
        up, _ = Powers.get(LONGEST + 1)
        for n, at in by.items():
            if n > LONGEST:
                for i in at:
                    out[i] = self.word(words[i])
                continue
            data = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(-1, n)
            sums = np.zeros((len(at), n + 1), np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], axis=1, dtype=np.uint64, out=sums[:, 1:])
            ways = np.zeros((n + 1, len(at), len(self.languages)))
            ways[0] = 1.0
            for j in range(1, n + 1):
                for i in range(max(0, j - self.longest), j):
                    if (table := self.tables.get(j - i)) is None:
                        continue
                    hashes, p = table
                    h = mix((sums[:, j] - sums[:, i]) * down[i] + np.uint64(j - i))
                    k = np.searchsorted(hashes, h)
                    k[k == len(hashes)] = 0
                    has = np.flatnonzero(hashes[k] == h)
                    if len(has):
                        ways[j, has] += ways[i, has] * p[k[has]]
            out[at] = np.log(ways[n])
        return out


def train(counts: dict[str, dict[str, int]], pieces: dict[bytes, int], rounds: int = 4, smoothing: float = 0.1) -> Model:
    """Fits the piece probabilities of each language to word counts by expectation-maximisation: forward and backward
    sums give the expected count of every piece over all segmentations of every word. A piece that no word needs keeps
    the smoothing's share, so that all of the vocabulary takes part."""
    longest = max((len(w) for w in pieces), default=1)
    used = {w: i for i, w in enumerate(pieces)}
    for b in range(256):
        used.setdefault(bytes([b]), len(used))
    log_p = np.zeros((len(used), len(counts)))
    for x, (_, words) in enumerate(sorted(counts.items())):
        cuts = []  # of each word the places i, j and numbers k of its pieces, flat: the driver holds those of one language
        for word in words:
            b = (" " + word).encode()
            cuts.append(array("I", (v for j in range(1, len(b) + 1) for i in range(max(0, j - longest), j) if b[i:j] in pieces or j == i + 1 for v in (i, j, used[b[i:j]]))))
        p = np.full(len(used), 1.0 / len(used))
        for _ in range(rounds):
            got = np.full(len(used), smoothing)
            q, total = p.tolist(), {}
            for cut, (word, n) in zip(cuts, words.items()):
                size = len(word.encode()) + 1
                forward, backward = [0.0] * (size + 1), [0.0] * (size + 1)
                forward[0] = backward[size] = 1.0
                for i, j, k in zip(*[iter(cut)] * 3):
                    forward[j] += forward[i] * q[k]
                if forward[size] <= 0:
                    continue
                for k, j, i in zip(*[iter(cut[::-1])] * 3):
                    backward[i] += q[k] * backward[j]
                share = n / forward[size]
                for i, j, k in zip(*[iter(cut)] * 3):
                    total[k] = total.get(k, 0.0) + share * forward[i] * q[k] * backward[j]
            for k, v in total.items():
                got[k] += v
            p = got / got.sum()
        log_p[:, x] = np.log(p)
    return Model(sorted(counts), used, log_p, longest)


def fit(labelled: DataFrame, pieces: dict[bytes, int], docs_per_language: int = 400, words_per_language: int = 20_000) -> Model:
    """A model from rows (doc_id, text, lang) with lang not null.

    The classifier sees a bounded sample: about `docs_per_language` documents of each language, chosen by a hash of their
    doc_id with a rate that comes from the language's row count, and of their whole texts the `words_per_language` most
    frequent words. Only (lang, word, count) rows of these come to the driver.
    """
    labelled = labelled.filter("lang is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], {}, np.zeros((0, 0)), 1)
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, docs_per_language / n))])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.filter(chance < F.element_at(rate, F.col("lang")))
    words = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("r") <= words_per_language)
    found: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for r in top.collect():
        found[r["lang"]][r["word"]] = r["n"]
    return train(found, pieces)


def _runs(texts: Iterator[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _predict(model: Model, keep: list[str], most_cached: int = 150_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.languages)
        row_of, holder = held(("words", model.version), lambda: ({}, [np.zeros((1024, max(k, 1)))]))
        for batch in batches:
            best, score = [], []
            for texts in _runs(texts_of(batch)):
                lists = [letters(t.lower()) for t in texts]
                new = [w for w in dict.fromkeys(w for ws in lists for w in ws) if w not in row_of] if k else []
                if len(row_of) + len(new) > most_cached:  # memory stays bounded: the whole cache goes
                    row_of.clear()
                    new = list(dict.fromkeys(w for ws in lists for w in ws))
                if len(row_of) + len(new) > len(holder[0]):
                    holder[0] = np.concatenate([holder[0], np.zeros((max(len(holder[0]), len(new)), k))])
                if new:
                    holder[0][len(row_of) : len(row_of) + len(new)] = model.words(new)
                    row_of.update(zip(new, range(len(row_of), len(row_of) + len(new))))
                for words in lists:
                    if not words or not k:
                        best.append(UNKNOWN), score.append(0.0)
                        continue
                    total = holder[0][np.fromiter(map(row_of.__getitem__, words), np.int64, len(words))].sum(0)
                    top = int(total.argmax())
                    best.append(model.languages[top])
                    score.append(float(1 / np.exp(total - total[top]).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score, the posterior of that language among the learned ones (equal priors).

    A text is the product of its words; a word sums over all its segmentations. Whole texts are scored. Null text and
    text without a letter is `und` with score 0; ties go to the first language in order. With nothing learned,
    all are `und`. Words and texts may be of any length. Map only: no shuffle; clashing columns give way; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep] + ["lang_pred string", "score double"])
    return docs.select(*keep).mapInArrow(lean(_predict(model, keep)), schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
