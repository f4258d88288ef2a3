"""Hashed character n-grams and words of whole texts, as numpy arrays.

Texts are taken in chunks of CHUNK code points, so that one very long text needs no more memory than many short ones;
an n-gram or word belongs to the chunk that it starts in, whole: a word that runs past its chunk's end is hashed apart, part
by part. So chunks change nothing, and what a text gives depends on that text alone, not on its batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

CHUNK = 1 << 18
BLOCK = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters (Unicode category L)."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and (text[0].isalpha() or any(map(str.isalpha, text)))


def _letter_values(points: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What code points add to the value of their word, by their places in it."""
    with np.errstate(over="ignore"):
        value = (points + np.uint64(7)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _MIX
        value ^= value >> np.uint64(31)
        return value * _MIX


def _edge(points: np.ndarray, a: int, b: int) -> tuple[int, np.uint64 | None]:
    """Of the chunk points[a:b]: the places of a word that starts before a, and the value of the word that starts in it and ends past b."""
    black = points[a:b] > 32
    white = np.flatnonzero(~black)
    before = (int(white[0]) if len(white) else b - a) if a and points[a - 1] > 32 else 0
    if b == len(points) or not black[-1] or points[b] <= 32 or before == b - a:
        return before, None
    start = a + (int(white[-1]) + 1 if len(white) else 0)
    value = np.zeros(1, np.uint64)
    for c in range(start, len(points), CHUNK):
        part = points[c : c + CHUNK]
        end = np.flatnonzero(part <= 32)
        part = part[: end[0]] if len(end) else part
        value += _letter_values(part.astype(np.uint64), np.arange(c - start, c - start + len(part))).sum(dtype=np.uint64)
        if len(end):
            break
    return before, value[0]


@dataclass(frozen=True)
class Grams:
    """What is counted: n-grams of the given orders, of letters only or of all characters, and words."""

    orders: tuple[int, ...]
    bits: int
    only_letters: bool = False
    words: bool = False

    @property
    def size(self) -> int:
        return 1 << self.bits

    def _blocks(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int], np.ndarray, list[tuple[int, np.uint64 | None]]]]:
        """Chunks that fill a block: their texts' numbers, their own lengths, all code points with a tail for each, and their edges.

        An edge is how many places of the chunk belong to a word that starts before it, and the value of its last word if that runs past it.
        """
        tail = max(self.orders) - 1
        docs, lengths, parts, edges, total = [], [], [], [], 0
        for d, text in enumerate(texts):
            if not text:
                continue
            points = code_points(text.lower() if self.only_letters else text)
            if self.only_letters:
                points = np.where(letters()[points], points, np.uint32(32))
            for a in range(0, len(points), CHUNK):
                own = points[a : a + CHUNK + tail]
                n = min(CHUNK, len(points) - a)
                docs.append(d)
                lengths.append(n)
                parts.append(own)
                if len(own) < n + tail:
                    parts.append(np.full(n + tail - len(own), 32, np.uint32))
                edges.append(_edge(points, a, a + n) if self.words else (0, None))
                total += n
                if total >= BLOCK:
                    yield docs, lengths, np.concatenate(parts), edges
                    docs, lengths, parts, edges, total = [], [], [], [], 0
        if docs:
            yield docs, lengths, np.concatenate(parts), edges

    def indices(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(texts' numbers, where each one's run starts, bucket of each place; ``size`` where there is none)."""
        tail = max(self.orders) - 1
        shift, nothing = np.uint64(64 - self.bits), self.size
        for docs, lengths, points, edges in self._blocks(texts):
            starts = np.concatenate(([0], np.cumsum(np.array(lengths) + tail)))
            outside = np.concatenate([np.arange(e - tail, e) for e in starts[1:]]) if tail else np.zeros(0, np.int64)
            points = points.astype(np.uint64)
            padded = np.concatenate((points, np.full(tail, 32, np.uint64)))
            with np.errstate(over="ignore"):
                rolling = np.zeros(len(points), np.uint64)
                for k in range(1, max(self.orders) + 1):
                    rolling = (rolling + padded[k - 1 : k - 1 + len(points)] + np.uint64(k)) * _MIX
                    rolling ^= rolling >> np.uint64(29)
                    if k in self.orders:
                        at = ((rolling * _MIX) >> shift).astype(np.int64)
                        at[outside] = nothing
                        yield docs, starts[:-1], at
                if self.words:
                    black = points > 32
                    black[outside] = False
                    for start, (before, _) in zip(starts.tolist(), edges):
                        black[start : start + before] = False
                    first = np.flatnonzero(black & ~np.concatenate(([False], black[:-1])))
                    at = np.full(len(points), nothing, np.int64)
                    if len(first):
                        place = np.arange(len(points)) - np.repeat(
                            np.concatenate(([0], first)), np.diff(np.concatenate(([0], first, [len(points)])))
                        )
                        words = np.add.reduceat(np.where(black, _letter_values(points, place), np.uint64(0)), first)
                        for end, (_, value) in zip(starts[1:].tolist(), edges):
                            if value is not None:
                                words[np.searchsorted(first, end) - 1] = value
                        at[first] = ((words * _MIX) >> shift).astype(np.int64)
                    yield docs, starts[:-1], at

    def sums(self, texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text: the sum of its features' rows of the table, and how many features it has."""
        rows = np.vstack([table, np.zeros((1, table.shape[1]), table.dtype)])
        out, counts = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
        for docs, starts, at in self.indices(texts):
            np.add.at(out, docs, np.add.reduceat(rows[at], starts, axis=0))
            np.add.at(counts, docs, np.add.reduceat((at < self.size).astype(np.float64), starts))
        return out, counts

    def bags(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text: its distinct features and their counts."""
        out = []
        for text in texts:
            found = [at[at < self.size] for _, _, at in self.indices([text])]
            out.append(np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2)
        return out

    def document_counts(self, texts: list[str | None]) -> np.ndarray:
        """For each feature: in how many texts it is."""
        out, step = np.zeros(self.size, np.int64), 64
        for i in range(0, len(texts), step):
            seen = np.zeros((step, self.size + 1), bool)
            for docs, starts, at in self.indices(texts[i : i + step]):
                ends = np.append(starts[1:], len(at))
                seen[np.repeat(docs, ends - starts), at] = True
            out += seen[:, :-1].sum(0)
        return out
