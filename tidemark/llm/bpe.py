"""Byte-level BPE over length-bucketed numpy matrices.

A text is parted by the tokenizer's pattern. The distinct new pieces of a batch of documents are laid out as padded
matrices, one for each power-of-two length; in each round every row merges its leftmost pair of minimum rank. Pairs are
looked up in an open-addressing hash table; rows that have no pair left leave the matrix, and columns are compacted as
rows shrink. A piece that is a token itself is that token, as in the public library.

Rows take a round per merge, which would be quadratic for one very long piece; pieces over LONG bytes are merged one by
one in the same order by a heap, so that a text of a million letters takes n log n steps. Both ways are exact.

Defined results: null text is empty and has no tokens; nothing is dropped or cut; rows keep their order and number;
other columns pass through, but for those of the output's names (ids, decoded), which it replaces; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_arrow_batches

NONE = np.int32(2**31 - 1)
LONG = 512
#: Pieces whose ids a worker keeps; about 100 MB.
CACHE = 400_000


class PairTable:
    """(left id, right id) -> id of the two together, in a hash table with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, to: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(to)) * 2.5))))
        size = 1 << self.bits
        self.mask = np.int64(size - 1)
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys = self.key(left, right)
        slot, todo, self.probes = self.home(keys), np.arange(len(keys)), 1
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], to[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask
            self.probes += 1

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pairs; NONE where there is none or an id is the padding (-1)."""
        shape, keys = left.shape, self.key(left, right).ravel()
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self.home(keys[todo])
        while len(todo):
            there = self.keys[slot]
            same = there == keys[todo]
            out[todo[same]] = self.values[slot[same]]
            more = ~same & (there >= 0)
            todo, slot = todo[more], (slot[more] + 1) & self.mask
        return out.reshape(shape)


class Vocabulary:
    """A rank file: base64 of a token's bytes and its rank, which is its id, on each line."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, to = [], [], []
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    to.append(rank)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(to, np.int32))
        self.pair_of = None

    def merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of similar length."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lengths.max())
        ids = np.full((len(pieces), width), -1, np.int32)
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        inside = np.arange(width) < lengths[:, None]
        ids[inside] = flat
        out: list[np.ndarray | None] = [None] * len(pieces)
        rows = np.arange(len(pieces))
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(pieces), 0), NONE, np.int32)
        while len(rows):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            line = np.arange(len(rows))
            rank = ranks[line, best] if ranks.shape[1] else np.full(len(rows), NONE, np.int32)
            done = rank == NONE
            if done.any():
                for i in np.flatnonzero(done).tolist():
                    out[rows[i]] = ids[i, : lengths[i]].copy()
                live = ~done
                rows, ids, ranks, lengths, best, rank = rows[live], ids[live], ranks[live], lengths[live], best[live], rank[live]
                if not len(rows):
                    break
                line = np.arange(len(rows))
            # the pair becomes one id; what stands right of it moves one place left
            width = ids.shape[1]
            ids[line, best] = rank
            columns = np.arange(width - 1)
            source = columns + (columns > best[:, None])
            ids = np.take_along_axis(ids, source, axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(source[:, :-1], width - 2), axis=1)
            lengths = lengths - 1
            if ids.shape[1] > 1:
                right = best < ids.shape[1] - 1
                r, b = line[right], best[right]
                ranks[r, b] = self.pairs.find(ids[r, b], ids[r, b + 1])
                left = best > 0
                r, b = line[left], best[left]
                ranks[r, b - 1] = self.pairs.find(ids[r, b - 1], ids[r, b])
            longest = int(lengths.max())
            if longest < ids.shape[1]:
                ids, ranks = ids[:, :longest], ranks[:, : max(0, longest - 1)]
        return out  # type: ignore[return-value]

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges, one at a time, by a heap of (rank, place) over a linked list."""
        if self.pair_of is None:
            there = self.pairs.keys >= 0
            self.pair_of = dict(zip(self.pairs.keys[there].tolist(), self.pairs.values[there].tolist()))
        find, n = self.pair_of.get, len(piece)
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := find(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or find(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := find(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := find(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pieces, as little-endian unsigned 32-bit integers."""
        out, buckets = {}, {}
        for p in pieces:
            rank = self.ranks.get(p)
            if rank is not None:
                out[p] = rank.to_bytes(4, "little")
            elif len(p) > LONG:
                out[p] = self.merge_long(p).astype("<u4").tobytes()
            else:
                buckets.setdefault(len(p).bit_length(), []).append(p)
        for bits, own in buckets.items():
            step = max(1, (1 << 20) >> bits)
            for i in range(0, len(own), step):
                part = own[i : i + step]
                for p, ids in zip(part, self.merge_matrix(part)):
                    out[p] = ids.astype("<u4").tobytes()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Encoder:
    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary, self.parts, self.cache = Vocabulary(path), regex.compile(pattern).findall, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self.parts(t) for t in texts]
        cache = self.cache
        new = set().union(*pieces).difference(cache) if pieces else set()
        if new:
            if len(cache) + len(new) > CACHE:
                cache.clear()
                new = set().union(*pieces)
            names = list(new)
            found = self.vocabulary.encode_pieces([p.encode() for p in names])
            cache.update((p, found[p.encode()]) for p in names)
        get = cache.__getitem__
        return [b"".join(map(get, own)) for own in pieces]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit integers) in place of the text, and the decoded bytes if asked.

    ``path`` is a rank file that every executor has, as a part of the installed tokenizer package.
    """
    small_arrow_batches(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name not in (text_col, "ids", "decoded")]
    schema = T.StructType(fields + [T.StructField(n, T.BinaryType()) for n in ("ids", "decoded")[: 1 + decoded]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            names = batch.schema.names
            ids = own.encode([t or "" for t in batch.column(names.index(text_col)).to_pylist()])
            made = [pa.array(ids, pa.binary())]
            if decoded:
                made.append(pa.array([own.vocabulary.decode(x) for x in ids], pa.binary()))
            keep = [i for i, n in enumerate(names) if n not in (text_col, "ids", "decoded")]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + made, schema.names)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the bytes of its ids in ``decoded``."""
    small_arrow_batches(encoded.sparkSession)
    schema = T.StructType([f for f in encoded.schema.fields if f.name != "decoded"] + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, r"(?s).+").vocabulary
        for batch in batches:
            names = batch.schema.names
            made = [None if x is None else own.decode(x) for x in batch.column(names.index(ids_col)).to_pylist()]
            keep = [i for i, n in enumerate(names) if n != "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(made, pa.binary())], schema.names)

    return encoded.mapInArrow(run, schema)


def report(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return encode(own, path, pattern, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
