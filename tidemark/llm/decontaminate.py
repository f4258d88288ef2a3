"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over token windows.

Words are runs of characters that are not ASCII punctuation, space or control characters, with A-Z lower-cased. A window
is 13 consecutive words of a benchmark item; an item of fewer words is one window. The scan numbers words by the
benchmark's vocabulary, hashes windows of numbers, looks the hashes up in the sorted set, and verifies each find word
by word, so hash collisions cannot mark anything.

The benchmark is broadcast in blocks of at most ``block_bytes`` of text; more blocks mean more passes over the documents,
each adding to the marks of the ones before. What is broadcast at once therefore never grows beyond the block.

Defined results: null or wordless texts have no words and are never contaminated; a null benchmark text has no window; an
item without an id marks words but is counted in no item list; repeated items and items with equal windows are all
counted; an empty benchmark marks nothing; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_arrow_batches, staged, text_or_empty

WINDOW = 13
BLOCK_BYTES = 32 << 20
#: A document is contaminated if one word in this many is hit.
SHARE = 20
#: Upper case to lower case, other ASCII outside of 0-9 and a-z to a space; all bytes of longer characters stay.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    # bytes.split() without a separator parts at ASCII white space only, and all of it has become spaces
    return text.translate(WORD_BYTES).split()


class WindowSet:
    """The windows of some benchmark items, by length: sorted hashes, the windows' word numbers and their items."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            k = min(width, len(numbers))
            for i in range(len(numbers) - k + 1 if k else 0):
                own = owners.setdefault(k, {}).setdefault(tuple(numbers[i : i + k]), set())
                if item is not None:
                    own.add(item)
        self.by_length = {}
        for k, found in owners.items():
            rows = np.array(list(found), dtype=np.int64).reshape(-1, k)
            sets = list(found.values())
            multiplier = np.uint64(0x9E3779B97F4A7C15)
            while True:
                keys = self.hashed(rows.T, multiplier)
                order = np.argsort(keys, kind="stable")
                if len(keys) == len(np.unique(keys)):
                    break
                multiplier += np.uint64(2)
            self.by_length[k] = (multiplier, keys[order], rows[order], [sets[i] for i in order])

    @staticmethod
    def hashed(columns, multiplier: np.uint64) -> np.ndarray:
        out = None
        with np.errstate(over="ignore"):
            for c in columns:
                c = c.astype(np.uint64)
                out = c if out is None else out * multiplier + c
            return out ^ (out >> np.uint64(31))

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, set[str]]]:
        """Word numbers' bounds by text, hit marks by word, hits by text and the items found by text."""
        parts = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        bounds = np.concatenate(([0], np.cumsum(counts + 1)))  # a 0 after each text, which is no word's number
        ids = np.zeros(bounds[-1], np.int64)
        get = self.vocabulary.get
        for start, own in zip(bounds[:-1], parts):
            ids[start : start + len(own)] = np.fromiter(map(get, own, repeat(0)), np.int64, len(own))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        edge = np.zeros(len(ids) + 1, np.int64)
        found: dict[int, set[str]] = {}
        for k, (multiplier, keys, rows, sets) in self.by_length.items():
            if len(ids) < k:
                continue
            at = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(at):
                continue
            own = self.hashed((ids[at + j] for j in range(k)), multiplier)
            where = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            same = keys[where] == own
            at, where = at[same], where[same]
            for j in range(k):
                same = rows[where, j] == ids[at + j]
                at, where = at[same], where[same]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + k, -1)
            docs = np.searchsorted(bounds, at, side="right") - 1
            for d, w in set(zip(docs.tolist(), where.tolist())):
                found.setdefault(d, set()).update(sets[w])
        hit = np.cumsum(edge[:-1]) > 0
        sums = np.concatenate(([0], np.cumsum(hit)))
        return counts, hit, sums[bounds[1:]] - sums[bounds[:-1]], found


MARKS = T.StructType(
    [
        T.StructField("__n_words", T.LongType()),
        T.StructField("__n_hit", T.LongType()),
        T.StructField("__items", T.ArrayType(T.StringType())),
        T.StructField("__hits", T.BinaryType()),
    ]
)


def _marker(shared, text_col: str, has_marks: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: WindowSet = shared.value
        for batch in batches:
            names = batch.schema.names
            texts = [t or b"" for t in batch.column(names.index(text_col)).cast(pa.binary()).to_pylist()]
            counts, hit, n_hit, found = windows.scan(texts)
            items = [found.get(i, set()) for i in range(len(texts))]
            starts = np.concatenate(([0], np.cumsum(counts + 1)))
            before = batch.column(names.index("__hits")).to_pylist() if has_marks else [None] * len(texts)
            if has_marks:
                for i, old in enumerate(batch.column(names.index("__items")).to_pylist()):
                    items[i] = items[i] | set(old or ())
            n_hit, hits = n_hit.tolist(), [None] * len(texts)
            for i in range(len(texts)):
                if n_hit[i] or before[i]:
                    own = hit[starts[i] : starts[i] + counts[i]]
                    if before[i]:
                        own = own | np.unpackbits(np.frombuffer(before[i], np.uint8), count=len(own)).astype(bool)
                    n_hit[i], hits[i] = int(own.sum()), np.packbits(own).tobytes()
            marks = [
                pa.array(counts, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                pa.array(hits, pa.binary()),
            ]
            keep = [i for i, n in enumerate(names) if n not in MARKS.names]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + marks, [names[i] for i in keep] + MARKS.names)

    return run


def marked(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with MARKS: words, hit words, items found and a bit for each word that is hit."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), text_or_empty(item_text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("b")).head().b
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    schema = T.StructType([f for f in docs.schema.fields if f.name not in MARKS.names] + MARKS.fields)
    out = docs
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        windows = WindowSet([(r.item, r.text.encode()) for r in own.collect()], width)
        out = out.mapInArrow(_marker(spark.sparkContext.broadcast(windows), text_col, b > 0), schema)
        if b + 1 < blocks:
            out = staged(out, "marks")
    return out


def is_contaminated(share: int = SHARE):
    return (F.col("__n_hit") > 0) & (F.lit(share) * F.col("__n_hit") >= F.col("__n_words"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = marked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), benchmark)
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
        F.col("__items").alias("items"),
    )


def _numbered(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with its columns named by their places, so that none has a mark's name, and the text's name there."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index(text_col)]


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones."""
    own, text = _numbered(docs, text_col)
    return marked(own, benchmark, text).where(~is_contaminated()).select(own.columns).toDF(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each run of hit words, and what stands between them, cut out of its text."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    own, text = _numbered(docs, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index(text)
            texts = batch.column(at).to_pylist()
            for i, bits in enumerate(batch.column(names.index("__hits")).to_pylist()):
                if bits:
                    # A-Z must be lower-cased first: the pattern has only the small letters
                    low = texts[i].translate({c: c + 32 for c in range(0x41, 0x5B)})
                    spans = [m.span() for m in word.finditer(low)]
                    hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(spans)).astype(bool)
                    out, end, k = [], 0, 0
                    while k < len(spans):
                        if hit[k]:
                            first = k
                            while k + 1 < len(spans) and hit[k + 1]:
                                k += 1
                            out.append(texts[i][end : spans[first][0]])
                            end = spans[k][1]
                        k += 1
                    texts[i] = "".join(out) + texts[i][end:]
            columns = [pa.array(texts, pa.string()) if j == at else batch.column(j) for j in range(len(names))]
            keep = [j for j, n in enumerate(names) if n not in MARKS.names]
            yield pa.RecordBatch.from_arrays([columns[j] for j in keep], [names[j] for j in keep])

    return marked(own, benchmark, text).mapInArrow(cut, own.schema).toDF(*docs.columns)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
