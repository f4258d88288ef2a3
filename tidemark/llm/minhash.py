"""Near-duplicate detection by BagMinHash over multisets of word shingles.

A document is the multiset of its five-word shingles (all of its words where it has fewer). A shingle of count w stands
for the levels (0, w]; levels are cut at powers of two, each cut carries a Poisson process of points in time whose rate is
the cut's height, and a point halves its cut again and again, by the bits of its hash, until it has one level: cuts are powers of
two high, so the halvings' bits are taken at once, as a remainder, which is the same level as one bit after the other gives. Only points at levels
within w count. A point falls on one of COMPONENTS positions, and the earliest point at each position is the signature:
two documents agree at a position with a probability that is exactly their weighted Jaccard similarity. Points are
made in order of time and stop as soon as they are later than the whole signature.

Signatures are banded (BANDS bands of ROWS rows: a pair of similarity 0.8 is missed with a probability of 2e-5), copies
of one word sequence are one node, and candidates are verified by the exact multiset overlap of their texts.
Buckets are never expanded into pairs: each bucket's members are compared with its pivot, the member with the most company.
Members that are not linked to their pivot are then compared with all members of their bucket, in blocks of bounded
size, and a block gives a spanning forest of what it links. So no link that would join two classes is lost, and rows stay
in proportion to the members. A class is a component of the links, so two of its members may be linked through others
only and be less similar than the threshold; keep_one() keeps one document of a class all the same.

Defined results: null, empty and wordless texts are near-duplicates of nothing, each a class of its own; repeated rows
and copies share a class; the class id is its least document id (null ids come last); an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, free_name, small_arrow_batches, staged, text_or_empty
from .components import connected
from .decontaminate import words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 36, 6
COMPONENTS = BANDS * ROWS
#: Members of a bucket that are compared with as many others at once.
BLOCK = 1024

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[list[bytes]], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each shingle of each document."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((zlib.crc32(w) for own in words for w in own), np.uint64, int(n.sum()))
    start = np.cumsum(n) - n
    count = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    doc = np.repeat(np.arange(len(words)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + start[doc]
    size = np.minimum(n, k)[doc]
    out = mix(size.astype(np.uint64) * _A)
    with np.errstate(over="ignore"):
        for j in range(k):
            inside = size > j
            own = flat[np.minimum(at + j, max(0, len(flat) - 1))] if len(flat) else np.zeros(len(at), np.uint64)
            out = np.where(inside, mix(out * _A + own + np.uint64(j)), out)
    return doc, out


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """Signatures (n_docs, m) of multisets given as (document, element, count); 64-bit marks of the earliest points."""
    tops = np.frexp(np.maximum(weight, 1) - 0.5)[1].clip(0)  # cuts above the lowest that a weight reaches into
    repeat = tops + 1
    own = np.repeat(np.arange(len(doc)), repeat)
    cut = np.arange(len(own)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    low = np.where(cut == 0, 0, 1 << np.maximum(cut - 1, 0))
    height = np.maximum(low, 1)
    with np.errstate(over="ignore"):
        seed = mix(element[own] + (cut.astype(np.uint64) + np.uint64(1)) * _A)
    doc, weight = doc[own], weight[own]
    time, made = np.zeros(len(own)), np.zeros(len(own), np.uint64)
    best = np.full(n_docs * m, np.inf)
    live, step = np.arange(len(own)), 1
    while len(live):
        number = made[live][:, None] + np.arange(1, step + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            h = mix(seed[live][:, None] + number * _C)
            where, level = mix(h + _A), mix(h + _B)
        gap = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / height[live][:, None]
        gap[:, 0] += time[live]
        times = np.cumsum(gap, axis=1)
        place = low[live][:, None] + 1 + (level % height[live].astype(np.uint64)[:, None]).astype(np.int64)
        good = place <= weight[live][:, None]
        to = doc[live][:, None] * m + (where % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, to[good], times[good])
        time[live], made[live] = times[:, -1], number[:, -1]
        latest = best.reshape(n_docs, m).max(axis=1)
        live = live[time[live] < latest[doc[live]]]
        step = min(2 * step, 64)
    return best.reshape(n_docs, m).view(np.uint64)


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, -1)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _A), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(parts.shape[2]):
            out = mix(out * _A + parts[:, :, r])
    return out.view(np.int64)


def node_of(words: list[bytes]) -> bytes | None:
    return hashlib.md5(b" ".join(words), usedforsecurity=False).digest() if words else None


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [words_of(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()]
        doc, h = shingle_hashes(words)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if len(doc) else order
        weight = np.diff(np.append(first, len(doc)))
        keys = band_keys(bag_minhash(doc[first], h[first], weight, len(words)))
        bands = [k if w else None for k, w in zip(keys, words)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(list(map(node_of, words)), pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "text_hash", "node", "bands"],
        )


def bag(text: str, k: int = SHINGLE) -> Counter:
    words = words_of(text.encode())
    size = min(k, len(words))
    return Counter(b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: the overlap of two multisets over their union."""
    if len(a) > len(b):
        a, b = b, a
    common = sum(min(n, b[x]) for x, n in a.items() if x in b)
    total = a.total() + b.total() - common
    return common / total if total else 0.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, kept = None, Counter()
    for batch in batches:
        node, pivot, text, pivot_text = (batch.column(i).to_pylist() for i in range(4))
        out = []
        for p, t, q in zip(pivot, text, pivot_text):
            if p != last:
                last, kept = p, bag(q)
            out.append(similarity(bag(t), kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["node", "pivot", "sim"])


def _similarities(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (node, pivot) with their exact similarity."""
    small_arrow_batches(pairs.sparkSession)
    of_pivot = texts.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text"))
    both = pairs.join(texts, "node").join(of_pivot, "pivot").select("node", "pivot", "text", "pivot_text")
    return staged(both.mapInArrow(_verify, "node binary, pivot binary, sim double"), "verified")


def expanded(text: str, k: int = SHINGLE) -> np.ndarray:
    """A multiset as a set: 32-bit hashes of (shingle, how often it has come), so that overlaps of sets are those of multisets."""
    doc, h = shingle_hashes([words_of(text.encode())], k)
    h.sort()
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    times = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    with np.errstate(over="ignore"):
        return (mix(h + times.astype(np.uint64) * _C) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [expanded(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "elements"])


def overlaps(queries: list[np.ndarray], others: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections, by products of 0/1 matrices over the elements that several sets have."""
    sets = queries + others
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    value, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[column]
    row = np.repeat(np.arange(len(sets)), sizes)
    row, place = row[place >= 0], place[place >= 0]
    out = np.zeros((len(queries), len(others)), np.float32)
    for a in range(0, int((n > 1).sum()), width):
        inside = (place >= a) & (place < a + width)
        x = np.zeros((len(sets), min(width, int((n > 1).sum()) - a)), np.float32)
        x[row[inside], place[inside] - a] = 1
        out += x[: len(queries)] @ x[len(queries) :].T
    return out


def _search_blocks(threshold: float):
    """Rows sorted by block: bucket, query block, block, node, label, role (1 query, 2 other, 3 both), elements."""

    def solve(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        queries, others = [r for r in rows if r[5] & 1], [r for r in rows if r[5] & 2]
        if not queries or len({r[4] for r in rows}) == 1:
            return []
        q, e = ([np.frombuffer(r[6], np.int32) for r in own] for own in (queries, others))
        common = overlaps(q, e)
        sizes = np.fromiter(map(len, q), np.float32)[:, None] + np.fromiter(map(len, e), np.float32)[None, :]
        top: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while x in top:
                x = top[x]
            return x

        out = []
        # links inside a class tell nothing new: a spanning forest over the classes is enough
        for i, j in zip(*np.nonzero(common >= (threshold - 1e-6) * (sizes - common))):
            a, b = root(queries[i][4]), root(others[j][4])
            if a != b:
                top[a] = b
                out.append((queries[i][3], others[j][3]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if waiting and waiting[-1][:3] != r[:3]:
                    out += solve(waiting)
                    waiting = []
                waiting.append(r)
            yield _pairs(out)
        yield _pairs(solve(waiting) if waiting else [])

    return run


def _pairs(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], ["node", "pivot"])


def links(nodes: DataFrame, texts_of, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Verified links (node, pivot, sim) among ``nodes`` (node, bands), enough to connect all that similar members of a bucket connect.

    ``texts_of`` gives the texts (node, text) of the nodes asked for.
    """
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    # reduced before the exchange: a hot bucket is a row for each task
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    entries = staged(rows.join(shared.hint("merge"), "bucket"), "entries")
    texts = staged(texts_of(entries.select("node").distinct()), "texts")
    # the pivot is the member with the most company in all of its buckets: what others are copies of
    company = entries.groupBy("node").agg(F.sum("n").alias("company"))
    weighed = entries.join(company, "node")
    pivots = weighed.groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("top")).select("bucket", F.col("top.node").alias("pivot"))
    met = staged(entries.join(pivots.hint("merge"), "bucket").where("node <> pivot"), "met")
    found = _similarities(met.select("node", "pivot").distinct(), texts)
    good = found.where(F.col("sim") >= threshold)
    open_ = met.join(found.where(F.col("sim") < threshold).select("node", "pivot"), ["node", "pivot"]).select("bucket", "node")
    open_ = staged(open_.withColumn("open", F.lit(True)), "open")
    if open_.isEmpty():
        return good
    # members that are not linked to their pivot are compared with all members of their bucket, in blocks of bounded size;
    # what leaves a block is a spanning forest, never its pairs
    labels = connected(good, "node", "pivot").select("node", "root")
    busy = open_.groupBy("bucket").agg(F.count("*").alias("n_open"))
    sets = texts.join(open_.select("bucket").distinct().join(entries, "bucket").select("node").distinct(), "node", "left_semi")
    sets = staged(sets.select("node", "text").mapInArrow(_elements, "node binary, elements binary"), "elements")
    members = (
        entries.join(busy.hint("merge"), "bucket")
        .join(open_, ["bucket", "node"], "left")
        .join(labels, "node", "left")
        .select(
            "bucket",
            "node",
            F.coalesce("root", "node").alias("label"),
            F.coalesce("open", F.lit(False)).alias("open"),
            F.ceil(F.col("n_open") / block).cast("int").alias("n_q"),
            F.ceil(F.col("n") / block).cast("int").alias("n_e"),
        )
    )
    h = F.xxhash64("node")
    one = (F.col("n_q") == 1) & (F.col("n_e") == 1)
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_query = F.transform(every("n_e"), lambda b: F.struct(F.pmod(h, F.col("n_q")).cast("int").alias("q"), b.alias("e"), F.lit(1).alias("role")))
    as_other = F.transform(every("n_q"), lambda b: F.struct(b.alias("q"), F.pmod(h, F.col("n_e")).cast("int").alias("e"), F.lit(2).alias("role")))
    both = F.array(F.struct(F.lit(0).alias("q"), F.lit(0).alias("e"), F.when(F.col("open"), 3).otherwise(2).alias("role")))
    dealt = members.select("bucket", "node", "label", F.explode(F.when(one, both).when(F.col("open"), F.concat(as_query, as_other)).otherwise(as_other)).alias("at"))
    dealt = dealt.join(sets, "node").select("bucket", "at.q", "at.e", "node", "label", "at.role", "elements")
    dealt = dealt.repartition("bucket", "q", "e").sortWithinPartitions("bucket", "q", "e")
    more = staged(dealt.mapInArrow(_search_blocks(threshold), "node binary, pivot binary").distinct(), "more")
    return good.unionByName(_similarities(more, texts).where(F.col("sim") >= threshold))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``docs``: doc_id, text_hash, class_id, class_size, n_links, least_sim, alone (it has no words).

    n_links are the verified links between different texts that hold the class together, least_sim the least of their similarities
    (null without a link).
    """
    small_arrow_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    sketches = staged(own.mapInArrow(_sketch, "doc_id long, text_hash long, node binary, bands array<long>"), "sketches")
    wordy = sketches.where("node is not null")
    nodes = staged(
        wordy.groupBy("node").agg(
            F.min(F.struct("doc_id", "text_hash")).alias("row"),
            F.min_by("doc_id", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("least"),
            F.count("*").alias("copies"),
            F.first("bands").alias("bands"),
        ),
        "nodes",
    )

    def texts_of(wanted: DataFrame) -> DataFrame:
        rows = nodes.join(wanted, "node", "left_semi").select(
            "node", F.col("row.doc_id").alias("want_id"), F.col("row.text_hash").alias("want_hash")
        )
        met = own.join(rows, F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("text_hash") == F.col("want_hash")))
        # rows repeated with their id would stand for their node more than once
        return met.groupBy("node").agg(F.first("text").alias("text")) if repeated else met.select("node", "text")

    repeated = not wordy.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
    linked = staged(links(nodes.select("node", "bands"), texts_of, threshold), "links")
    roots = connected(linked, "node", "pivot")
    by_root = linked.join(roots, linked["node"] == roots["node"]).groupBy("root").agg(F.count("*").alias("n_links"), F.min("sim").alias("least_sim"))
    rooted = staged(
        nodes.select("node", "least", "copies")
        .join(roots, "node", "left")
        .select("node", F.coalesce("root", "node").alias("root"), "least", "copies"),
        "rooted",
    )
    sizes = rooted.groupBy("root").agg(
        F.min_by("least", F.struct(F.col("least").isNull(), "least")).alias("class_id"), F.sum("copies").alias("class_size")
    )
    sizes = sizes.join(by_root, "root", "left")
    named = staged(rooted.select("node", "root").join(sizes, "root").drop("root"), "named")
    return (
        sketches.select("doc_id", "text_hash", "node")
        .join(named.hint("merge"), "node", "left")
        .select(
            "doc_id",
            "text_hash",
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            "least_sim",
            F.col("node").isNull().alias("alone"),
        )
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = classes(docs, id_col, text_col)
    return found.select(
        "doc_id", "class_id", "class_size", "n_links", "least_sim", (F.col("alone") | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, that of the least id, and all its columns."""
    found = classes(docs, id_col, text_col)
    # names that no column of the caller has
    of_id, of_text, alone, times, of_class = (free_name(n, docs) for n in ("__id", "__hash", "__alone", "__times", "__class"))
    stays = staged(
        found.where(F.col("alone") | F.col("doc_id").eqNullSafe(F.col("class_id")))
        .groupBy(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_text), F.col("alone").alias(alone))
        .agg(F.count("*").alias(times), F.first("class_id").alias(of_class)),
        "stays",
    )
    # where one id has several texts of a class, one of them stays
    twice = stays.where(~F.col(alone)).groupBy(F.col(of_id).alias("i"), F.col(of_class).alias("c")).agg(F.count("*").alias("n"), F.min(of_text).alias("least"))
    if not twice.where("n > 1").isEmpty():
        met = F.col(of_id).eqNullSafe(F.col("i")) & F.col(of_class).eqNullSafe(F.col("c"))
        stays = stays.join(twice, met, "left").where(F.col(alone) | (F.col(of_text) == F.col("least"))).drop("i", "c", "n", "least")
    met = docs[id_col].cast("long").eqNullSafe(F.col(of_id)) & (F.xxhash64(text_or_empty(text_col)) == F.col(of_text))
    kept = docs.join(stays.hint("merge"), met)
    once = kept.where((F.col(times) == 1) | F.col(alone))
    once = once.select(*columns_of(once, docs.columns))
    more = (F.col(times) > 1) & ~F.col(alone)
    if stays.where(more).isEmpty():
        return once
    again = kept.where(more).dropDuplicates([of_id, of_text])
    return once.unionByName(again.select(*columns_of(again, docs.columns)))
