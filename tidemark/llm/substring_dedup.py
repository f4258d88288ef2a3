"""Removal of every byte that a repeated string of LENGTH bytes covers, in the same document or another.

All suffixes of a large corpus cannot be exchanged, so three steps narrow them down without losing any repeat:

1. A string of LENGTH bytes has an anchor: the place of its least-hashed GRAM bytes. Equal strings have equal anchors.
   Neighbouring strings with one anchor are a run (about 80 strings). Anchors that occur once in the corpus are done with.
2. Runs that are equal as a whole, with all bytes that their strings cover, are repeated as a whole: copied documents and
   the inside of copied passages end here, as one row for each run.
3. What is left are anchors with several different runs, the edges of copied passages. Their suffixes are sorted, one
   bucket (an anchor) at a time, by blockwise suffix sorting: first bytes first, long ties by the ranks of a
   difference cover of the block (suffixes.py). Neighbours in that order that agree for LENGTH bytes are repeated.

An anchor with more than HOT different runs would not fit a block; its strings are compared by fingerprints
instead (64 bits by sums modulo 2^64, 62 by sums modulo a prime), grouped over all tasks. Equal runs are told by the same.

Defined results: null text is empty; texts shorter than LENGTH lose nothing; a string may overlap its own repeat;
repeated rows repeat each other's strings; what is removed depends on the input alone, never on what is left; empty
tables give empty results; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_arrow_batches, staged, text_or_empty
from .minhash import mix
from .suffixes import repeated

LENGTH = 200
GRAM = 40
#: Bytes that are hashed at once; a longer text is taken in parts that overlap by LENGTH - 1.
PART = 1 << 20
#: Bytes of the blocks that suffixes are sorted in, and the runs of one anchor that still go to a block.
BLOCK = 2 << 20
HOT = 8192
#: An anchor with more than this part of all runs that repeat is dealt to SALTS tasks.
SHARES, SALTS = 512, 64

_BASE = 0x9E3779B97F4A7C15 | 1
#: A Mersenne prime, by which remainders need no division, and two bases for hashes modulo it.
_PRIME = np.uint64((1 << 31) - 1)
_PRIME_BASES = (0x3C6EF372, 0x1B873593)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, and random numbers for each byte."""
    n = PART + LENGTH + 1
    with np.errstate(over="ignore"):
        up = np.concatenate(([np.uint64(1)], np.full(n - 1, _BASE, np.uint64))).cumprod()
        down = np.concatenate(([np.uint64(1)], np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64))).cumprod()
    return up, down, np.random.default_rng(7).integers(1, 1 << 63, (3, 256), dtype=np.uint64)


def _sums(data: np.ndarray) -> np.ndarray:
    up, _, numbers = _powers()
    with np.errstate(over="ignore"):
        return np.concatenate(([np.uint64(0)], np.cumsum(numbers[0][data] * up[: len(data)])))


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of data[start:end], whatever stands before it."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * _powers()[1][start] + (end - start).astype(np.uint64))


def _remainder(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2^62."""
    x = (x & _PRIME) + (x >> np.uint64(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


@lru_cache(4)
def _prime_powers(base: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < PART + LENGTH + 1:
        out = np.concatenate((out, _remainder(out * np.uint64(pow(base, len(out), int(_PRIME))))))
    return out


class PrimeHash:
    """62 bits by two polynomials modulo a prime: texts on which sums modulo 2^64 fail together do not make these fail."""

    def __init__(self, data: np.ndarray):
        self.sums = []
        for which, base in enumerate(_PRIME_BASES, 1):
            numbers = _remainder(_powers()[2][which] >> np.uint64(2))
            terms = _remainder(numbers[data] * _prime_powers(base)[: len(data)])
            # at most 2^21 terms below 2^31
            self.sums.append(_remainder(np.concatenate(([np.uint64(0)], np.cumsum(terms)))))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = []
        for sums, base in zip(self.sums, _PRIME_BASES):
            down = _prime_powers(pow(base, -1, int(_PRIME)))[start]
            out.append(_remainder(_remainder(sums[end] + _PRIME - sums[start]) * down))
        return (out[0] << np.uint64(31)) | out[1]


def parts(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end: bytes, and for each piece its text's number, its place in the text and in the bytes."""
    rows, offsets, pieces, total = [], [], [], 0

    def out():
        sizes = np.array([len(p) for p in pieces])
        return np.frombuffer(b"".join(pieces), np.uint8), np.array(rows), np.array(offsets), np.concatenate(([0], np.cumsum(sizes)))

    for i, text in enumerate(texts):
        step = PART - length
        for a in range(0, max(0, len(text) - length + 1), step):
            piece = text[a : a + step + length - 1]
            if total + len(piece) > PART:
                yield out()
                rows, offsets, pieces, total = [], [], [], 0
            rows.append(i)
            offsets.append(a)
            pieces.append(piece)
            total += len(piece)
    if pieces:
        yield out()


class Runs:
    """The runs of some texts: anchor hash, text, first string, number of strings, two hashes of all bytes covered."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM, whole: bool = True):
        found = [self._of(*p, length, gram, whole) for p in parts(texts, length)]
        names = ("anchor", "row", "start", "n", "a", "b")
        for i, name in enumerate(names):
            setattr(self, name, np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64))

    @staticmethod
    def _of(data, rows, offsets, bounds, length, gram, whole):
        first = _sums(data)
        at = np.arange(len(data) - gram + 1)
        hashes = _hash(first, at, at + gram)
        low = np.uint64((1 << 24) - 1)
        # the least hash of each string, leftmost where equal: the place takes the low bits
        least, width, size = (hashes & ~low) | at.astype(np.uint64), length - gram + 1, 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: size - width], least[width - size :])
        place = (least & low).astype(np.int64)
        valid = np.ones(len(place) + 1, bool)
        for edge in bounds[1:].tolist():
            valid[max(0, edge - length + 1) : edge] = False
        valid = valid[:-1]
        change = np.concatenate(([True], (place[1:] != place[:-1]) | ~valid[:-1]))
        start = np.flatnonzero(change & valid)
        stop = np.flatnonzero(valid & np.concatenate((change[1:] | ~valid[1:], [True]))) + 1
        piece = np.searchsorted(bounds, start, side="right") - 1
        a = b = np.zeros(len(start), np.int64)
        if whole:
            end = stop + length - 1
            a, b = _hash(first, start, end).view(np.int64), PrimeHash(data).of(start, end).view(np.int64)
        return hashes[place[start]].view(np.int64), rows[piece], offsets[piece] + start - bounds[piece], stop - start, a, b


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchors, n = np.unique(Runs(batch.column(0).to_pylist(), whole=False).anchor, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(n, pa.int64())], ["anchor", "n"])


RUNS = "doc_id long, text_hash long, anchor long, start long, n int, a long, b long"


def _list_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        r = Runs(batch.column(2).to_pylist())
        row = pa.array(r.row, pa.int64())
        made = [batch.column(0).take(row), batch.column(1).take(row), pa.array(r.anchor, pa.int64()), pa.array(r.start, pa.int64())]
        made += [pa.array(r.n, pa.int32()), pa.array(r.a, pa.int64()), pa.array(r.b, pa.int64())]
        yield pa.RecordBatch.from_arrays(made, ["doc_id", "text_hash", "anchor", "start", "n", "a", "b"])


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


HITS = "doc_id long, text_hash long, start long, end long"


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: doc_id, text_hash, anchor, start, n, bytes. Whole buckets are gathered to blocks."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(r[5]) for r in rows])
        counts = np.array([r[4] for r in rows])
        begin = np.cumsum(sizes) - sizes
        first = np.cumsum(counts) - counts
        places = np.arange(counts.sum()) - np.repeat(first, counts) + np.repeat(begin, counts)
        flags = repeated(b"".join(r[5] for r in rows), np.repeat(np.array([r[2] for r in rows]), counts), places, LENGTH)
        out = [
            (r[0], r[1], r[3] + s, r[3] + e - 1 + LENGTH)
            for r, f, n in zip(rows, first.tolist(), counts.tolist())
            for s, e in _stretches(flags[f : f + n])
        ]
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "text_hash", "start", "end"])

    waiting: list[tuple] = []
    held, mark = 0, 0  # mark: where the last bucket in waiting begins
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if waiting and waiting[-1][2] != r[2]:
                mark = len(waiting)
                if held >= BLOCK:
                    yield solve(waiting)
                    waiting, held, mark = [], 0, 0
            waiting.append(r)
            held += len(r[5])
    if waiting:
        yield solve(waiting)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every string of the runs; doc_id, text_hash and start are the string's."""
    for batch in batches:
        doc, text_hash, _, start, n, context = (c.to_pylist() for c in batch.columns)
        for i in range(len(doc)):
            data = np.frombuffer(context[i], np.uint8)
            at = np.arange(n[i])
            made = [_hash(_sums(data), at, at + LENGTH).view(np.int64), PrimeHash(data).of(at, at + LENGTH).view(np.int64)]
            ids = [pa.array([x] * n[i], pa.int64()) for x in (doc[i], text_hash[i])]
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(at + start[i], pa.int64()), *(pa.array(x, pa.int64()) for x in made)],
                ["doc_id", "text_hash", "start", "a", "b"],
            )


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def hits(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The stretches to remove (doc_id, text_hash, start, end), not yet merged, of docs (doc_id, text_hash, data)."""
    own = docs.where(F.octet_length("data") >= LENGTH)
    # 1. anchors that occur again; counts are summed by task before they are exchanged
    anchors = own.select("data").mapInArrow(_count_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    again = staged(anchors.where("n > 1"), "anchors")
    found = own.select("doc_id", "text_hash", "data").mapInArrow(_list_runs, RUNS)
    # an anchor with over a SHARES-th of the runs is hot; there are fewer than SHARES of those. Their runs are dealt out by salt
    total = again.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head().n
    warm = F.broadcast(again.where(F.col("n") > total // SHARES).select("anchor", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "text_hash", "start"), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.when(F.col("n") > total // SHARES, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = again.select("anchor", F.explode(salts).alias("salt"))
    runs = staged(found.join(warm, "anchor", "left").withColumn("salt", salt).join(known.hint("merge"), ["anchor", "salt"]).drop("salt", "hot"), "runs")
    # 2. runs that occur again as a whole
    kinds = staged(
        runs.groupBy("anchor", "a", "b").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "text_hash", "start", "n")).alias("one")),
        "kinds",
    )
    keys = ["anchor", "a", "b"]
    # kinds with more than a SHARES-th of the runs are fewer than that too: their runs stay where they are
    often = F.broadcast(kinds.where(F.col("times") > max(1, total // SHARES)).select(keys))
    twice = kinds.where("times > 1").select(keys)
    seldom = runs.join(often, keys, "left_anti").join(twice.hint("merge"), keys)
    whole = runs.join(often, keys).unionByName(seldom).select("doc_id", "text_hash", "start", (F.col("start") + F.col("n") - 1 + LENGTH).alias("end"))
    # 3. anchors with several different runs; of equal runs one stands for all
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    edges = kinds.join(mixed.hint("merge"), "anchor").select("anchor", "kinds", "one.*")
    wanted = edges.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "start", "n", "kinds")).alias("own"))
    wanted = wanted.withColumnsRenamed({"doc_id": "want_id", "text_hash": "want_hash"})
    met = own.join(wanted, _same(F.col("doc_id"), F.col("want_id")) & (F.col("text_hash") == F.col("want_hash")))
    # cut out before the rows are multiplied, so that a long text is not copied for each of its runs
    cut = F.transform(
        "own",
        lambda r: F.struct(
            r["anchor"].alias("anchor"),
            r["start"].alias("start"),
            r["n"].alias("n"),
            F.substring(F.col("data"), r["start"].cast("int") + 1, r["n"] + (LENGTH - 1)).alias("context"),
            r["kinds"].alias("kinds"),
        ),
    )
    contexts = staged(met.select("doc_id", "text_hash", F.explode(cut).alias("r")).select("doc_id", "text_hash", "r.*"), "contexts")
    columns = ["doc_id", "text_hash", "anchor", "start", "n", "context"]
    sorted_rows = contexts.where(F.col("kinds") <= hot).select(columns).repartition("anchor").sortWithinPartitions("anchor")
    out = whole.unionByName(sorted_rows.mapInArrow(_sort_buckets, HITS))
    many = contexts.where(F.col("kinds") > hot)
    if many.isEmpty():
        return out
    strings = staged(many.select(columns).mapInArrow(_fingerprints, "doc_id long, text_hash long, start long, a long, b long"), "strings")
    twice = strings.groupBy("a", "b").agg(F.count("*").alias("times")).where("times > 1").select("a", "b")
    found = strings.join(twice.hint("merge"), ["a", "b"])
    return out.unionByName(found.select("doc_id", "text_hash", "start", (F.col("start") + LENGTH).alias("end")))


def _cut(data_at: int, hits_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(data_at).to_pylist()
            kept, spans = [], []
            for text, own in zip(texts, batch.column(hits_at).to_pylist()):
                merged: list[list[int]] = []
                for s, e in sorted((h["start"], h["end"]) for h in own or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                end, out = 0, []
                for s, e in merged:
                    out.append(text[end:s])
                    end = e
                kept.append(b"".join(out) + text[end:] if merged else text)
                spans.append([{"start": s, "end": e} for s, e in merged])
            rest = [batch.column(i) for i in range(batch.num_columns) if i not in (data_at, hits_at)]
            made = [pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(rest + made, names)

    return run


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, kept (the bytes left) and spans (byte stretches removed)."""
    small_arrow_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("data"))
    found = hits(own, hot).distinct().groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("hits"))
    found = staged(found.withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"}), "hits")
    met = own.join(found, _same(F.col("doc_id"), F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    rows = met.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), "data", "hits")
    names = ["doc_id", "n_bytes", "kept", "spans"]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("spans", span)]
    )
    return rows.mapInArrow(_cut(2, 3, names), schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = deduplicate(docs, id_col, text_col)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
