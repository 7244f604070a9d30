"""Splits text the way the byte-level tokenizer does before its merges, and keeps a bounded cache of pieces."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import islice

#: The blocks in which the pattern below is used; other text is split by the library itself.
LATIN_END, PUNCTUATION = 0x250, (0x2000, 0x206F)


def _ranges(points: list[int]) -> str:
    runs: list[list[int]] = []
    for p in points:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


def _classes() -> tuple[str, str, str]:
    points = [*range(LATIN_END), *range(PUNCTUATION[0], PUNCTUATION[1] + 1)]
    kind = lambda p: unicodedata.category(chr(p))[0]
    space = [p for p in points if chr(p).isspace() and not 0x1C <= p <= 0x1F]  # str.isspace() adds four separators
    return _ranges([p for p in points if kind(p) == "L"]), _ranges([p for p in points if kind(p) == "N"]), _ranges(space)


def quick_pattern() -> re.Pattern:
    letter, number, space = _classes()
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Splitter:
    """Cuts a text into the strings that the merges treat one by one; special strings come out as pieces of their own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.quick = quick_pattern().findall
        self.plain = re.compile(f"[\x00-{chr(LATIN_END - 1)}{chr(PUNCTUATION[0])}-{chr(PUNCTUATION[1])}]*").fullmatch
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _parts(self, text: str) -> list[str]:
        if self.plain(text):
            return self.quick(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        if self.at_special and any(s in text for s in self.special):
            return [p for part in self.at_special.split(text) if part for p in ([part] if part in self.special else self._parts(part))]
        return self._parts(text)


class Bounded(dict):
    """A cache that works out what it lacks and lets the older half go when it is full: memory stays bounded."""

    def __init__(self, make: Callable, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                for k in list(islice(self, self.most // 2)):
                    del self[k]
            self[key] = value
        return value


def texts_of(batch, column: str = "text") -> Iterator[str]:
    """The texts of an Arrow batch, null as empty, never all of them as Python strings at once."""
    for x in batch.column(column):
        yield x.as_py() or ""
