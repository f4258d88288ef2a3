"""Blockwise suffix sorting with a difference cover, in numpy.

A difference cover D of v has for every two places i, j a shift d < v with (i + d) mod v and (j + d) mod v both in D.
The suffixes at places in D are ranked first, by their first DEPTH bytes. After that any two suffixes that share their
first v bytes are ordered by one comparison of two precomputed ranks, however long they agree, so buckets of suffixes
can be sorted one block at a time in memory that is proportional to the block.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

V = 32
#: Every residue of 32 is a difference of two of these.
COVER = (0, 1, 2, 4, 9, 15, 20, 25)
DEPTH = 8 * V


@lru_cache(1)
def shifts() -> np.ndarray:
    """shifts()[a, b]: the least d for places with residues a and b."""
    inside = np.zeros(V, bool)
    inside[list(COVER)] = True
    out = np.full((V, V), -1)
    for a in range(V):
        for b in range(V):
            out[a, b] = next(d for d in range(V) if inside[(a + d) % V] and inside[(b + d) % V])
    return out


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows of keys, most significant first; equal rows share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Block:
    """A text whose suffixes can be sorted by bucket."""

    def __init__(self, text: bytes):
        data = np.frombuffer(text + bytes(2 * DEPTH + 2 * V), np.uint8)
        #: The eight bytes at each place, as a big-endian number.
        self.words = np.zeros(len(data) - 7, np.uint64)
        for j in range(8):
            self.words = (self.words << np.uint64(8)) | data[j : j + len(self.words)]
        self.ranks = self._cover_ranks(len(text) + V)

    def _cover_ranks(self, n: int) -> np.ndarray:
        places = np.flatnonzero(np.isin(np.arange(n) % V, COVER))
        at = np.full(n + 2 * DEPTH, -1, np.int64)
        rank = dense(*(self.words[places + 8 * j] for j in range(V // 8)))
        step = V
        while step < DEPTH:
            # a place of the cover stays one when moved by v; places past the text share the least rank
            at[places] = rank
            rank = dense(rank, at[places + step])
            step *= 2
        at[places] = rank
        return at

    def sort(self, bucket: np.ndarray, places: np.ndarray, seed: int = 3) -> np.ndarray:
        """An order of ``places`` by bucket, then by suffix; suffixes that agree for DEPTH bytes or more may be in any order."""
        group = dense(bucket, *(self.words[places + 8 * j] for j in range(V // 8)))
        order = np.argsort(group, kind="stable")
        group = group[order]
        random, table = np.random.default_rng(seed), shifts()
        live = np.arange(len(order))
        settled = np.zeros(len(order), bool)
        while True:
            # groups of one are settled; each other group is parted by a pivot of its own: less, same, greater
            first = np.concatenate(([True], group[live][1:] != group[live][:-1])) if len(live) else np.zeros(0, bool)
            start = np.flatnonzero(first)
            size = np.diff(np.append(start, len(live)))
            alone = np.repeat((size == 1) | settled[live[start]], size) if len(live) else first
            live = live[~alone]
            if not len(live):
                return order
            first = np.concatenate(([True], group[live][1:] != group[live][:-1]))
            start = np.flatnonzero(first)
            size = np.diff(np.append(start, len(live)))
            pivot = np.repeat(places[order[live[start + (random.random(len(start)) * size).astype(np.int64)]]], size)
            own = places[order[live]]
            d = table[own % V, pivot % V]
            sign = np.sign(self.ranks[own + d] - self.ranks[pivot + d])
            part = np.lexsort((sign, group[live]))
            order[live] = order[live[part]]
            sign = sign[part]
            # new group numbers keep the order: the rows of a group get three numbers between its own and the next
            base = np.repeat(start, size)
            new = np.concatenate(([True], (sign[1:] != sign[:-1]) | (base[1:] != base[:-1])))
            group[live] = live[np.flatnonzero(new)][np.cumsum(new) - 1] + len(order) * 2
            settled[live] = sign == 0

    def agree(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the suffixes at a and b share their first ``length`` bytes; length is a multiple of 8."""
        out, at = np.zeros(len(a), bool), np.arange(len(a))
        for j in range(0, length, 8):
            at = at[self.words[a[at] + j] == self.words[b[at] + j]]
        out[at] = True
        return out


def repeated(text: bytes, bucket: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Which of the places start a string of ``length`` bytes that starts at another place of their bucket too."""
    block = Block(text)
    order = block.sort(bucket, places)
    a, b = order[:-1], order[1:]
    same = (bucket[a] == bucket[b]) & block.agree(places[a], places[b], length)
    out = np.zeros(len(places), bool)
    out[a[same]] = True
    out[b[same]] = True
    return out
