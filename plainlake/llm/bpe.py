"""BPE encoding and decoding with a contiguous rank array."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plainlake.llm.pieces import Bounded, Splitter, texts_of
from plainlake.llm.workers import held, lean
from plainlake.session import ship

NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte, by rule: printable ones stand for
    themselves, the others take the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """The vocabulary of a byte-level BPE file, and words encoded by it."""

    def __init__(self, path: str, most_cached: int = 200_000, short: int = 192):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, letters = model["model"]["vocab"], byte_alphabet()
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.splitter = Splitter(path)
        self.bytes_of |= {i: s.encode() for s, i in self.splitter.special.items()}
        self.first = [0] * 256
        for c, b in letters.items():
            self.first[b] = vocab[c]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for k, pair in enumerate(model["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left], vocab[right]] = k
            self.made.append(vocab[left + right])
        self.short = short
        self.cache = Bounded(self._written, most_cached)
        self.by_text = {str(i): b for i, b in self.bytes_of.items()}

    def word(self, word: bytes) -> list[int]:
        """Parts and the ranks of neighbouring parts lie side by side in two arrays. The lowest rank is looked for by a
        scan, the boundary there is deleted, and the two neighbouring ranks are looked up afresh. Words over `short`
        bytes take a heap instead, as scans would cost the square of the length."""
        parts = [self.first[b] for b in word]
        if len(parts) > self.short:
            return self._long(parts)
        get, made = self.rank.get, self.made
        ranks = [get(p, NEVER) for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            at = ranks.index(low)
            parts[at] = made[low]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), NEVER)
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), NEVER)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two has been merged since
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (s := self.rank.get((parts[x], parts[after[x]]))) is not None:
                    heapq.heappush(heap, (s, x, parts[x], parts[after[x]]))
        return [p for p in parts if p >= 0]

    def _written(self, piece: str) -> str:
        if (i := self.splitter.special.get(piece)) is not None:
            return str(i)
        return ",".join(map(str, self.word(piece.encode())))

    def encode(self, text: str) -> str:
        """The ids of a text, in decimal, joined by commas."""
        return ",".join(map(self.cache.__getitem__, self.splitter(text)))

    def decode(self, ids: str) -> str:
        """The text of such ids; bytes that are no UTF-8 become U+FFFD, as the library has it."""
        return b"".join(map(self.by_text.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


def merges(path: str) -> Merges:
    """One for each Python worker."""
    return held(("merges", path), lambda: Merges(path))


def _batches(path: str, keep: list[str], what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out: dict[str, list] = {"ids": [], "decoded": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
                for text in texts_of(part):
                    ids = m.encode(text)
                    decoded = m.decode(ids)
                    if what == "digests":
                        out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                        out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    else:
                        out["ids"].append([int(x) for x in ids.split(",")] if ids else [])
                        out["decoded"].append(decoded)
                    out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
                types = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
                cols = {c: pa.array(v, types[c]) for c, v in out.items() if len(v) == part.num_rows}
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + list(cols.values()), names=[*keep, *cols])

    return run


def encode_decode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """`docs` with what the tokenizer file at `path` makes of `text` (null: empty): n_tokens and either ids and decoded,
    or their digests ids_sha256 and decoded_sha256.

    Map only: no shuffle. A worker holds the vocabulary and a cache of at most 200,000 pieces. Empty text has no ids and
    the digest of an empty string; columns of the input that clash with the new ones give way to them; an empty table
    gives an empty table. Repeated rows are encoded each.
    """
    ship(docs.sparkSession)
    new = {"n_tokens": "long"} | ({"ids_sha256": "string", "decoded_sha256": "string"} if digests else {"ids": "array<int>", "decoded": "string"})
    order = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded", "n_tokens"]
    keep = [c for c in docs.columns if c not in new and not (digests and c == "text")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep] + [f"{c} {new[c]}" for c in order])
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(lean(_batches(path, keep, "digests" if digests else "texts")), schema)
