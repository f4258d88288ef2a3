"""Vector code compression: a vector's parts as indexes into codebooks of integer entries, found by partial-distance search.

Each component x becomes floor(256 x). Codebooks start as the parts of the rows of the smallest ids; a round assigns each part of each vector to its nearest
entry and replaces the entry by the floor of its parts' means. Tasks add up their own parts first, so that a round exchanges at most one row for
each task, entry and position, and the driver gets the sums of the entries, which the codebooks' size bounds.

The search takes a part's dimensions in descending variance of the codebook's entries. An entry leaves a row's candidates as soon as what has been added up
strictly exceeds the row's best complete distance so far, so ties stay and the lowest index wins them. Entries are taken in blocks of BLOCK, each of which starts
with the best of the blocks before; the first complete distance is that to the entry that is nearest in the first dimension.

Defined results: rows whose vector is null or holds null, NaN or an infinite component are dropped. A vector of another length than that of the smallest id, or
of one that cannot be cut into equal parts, stays with a null code and error and shapes no codebook (the smallest id is looked for among vectors that can be
cut). Rows of one id are told apart by their vectors; null ids come last. With fewer rows than entries the codebooks are shorter. Integers are clamped at 2^62 either way, and errors
that a long cannot hold are told as the largest long; up to 2^27 all is done by numpy, beyond by Python's integers. Repeated rows count as often as they
are there; an empty table gives an empty result; columns of the caller pass through encode(), but for those of its output's names.
"""

from __future__ import annotations

import decimal
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_arrow_batches, staged

ENTRIES, PARTS, ROUNDS, SCALE = 64, 16, 2, 256
#: Entries that are searched at once.
BLOCK = 16
#: Integers below this are numpy's: four such differences, squared, are far from overflow, and so are 4,096.
PLAIN, CLAMP, LARGEST = 1 << 24, 1 << 62, (1 << 63) - 1


@dataclass(frozen=True)
class Codebooks:
    """For each part its entries, as lists of Python integers."""

    entries: list[list[list[int]]]

    @property
    def parts(self) -> int:
        return len(self.entries)

    @property
    def dimension(self) -> int:
        return sum(len(book[0]) for book in self.entries)

    def digest(self) -> str:
        numbers = (str(x) for book in self.entries for entry in book for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def integers(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 x) of each component as 64-bit integers, and which rows hold one that is not below PLAIN."""
    scaled = np.floor(vectors * SCALE)
    return np.clip(scaled, -float(CLAMP), float(CLAMP)).astype(np.int64), (np.abs(scaled) >= PLAIN).any(axis=1)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each point's nearest entry; of equally near ones the lowest index."""
    n, k = len(points), len(entries)
    # n times the sum of squares less the square of the sum has the order of the variance, in integers
    spread = k * (entries**2).sum(axis=0) - entries.sum(axis=0) ** 2
    order = np.argsort(-spread, kind="stable")
    points, entries = points[:, order], entries[:, order]
    first = (points[:, :1] - entries[:, 0]) ** 2
    index = first.argmin(axis=1)
    best = ((points - entries[index]) ** 2).sum(axis=1)
    for start in range(0, k, BLOCK):
        row, column = np.nonzero(first[:, start : start + BLOCK] <= best[:, None])
        column += start
        total = first[row, column]
        for d in range(1, points.shape[1]):
            total = total + (points[row, d] - entries[column, d]) ** 2
            live = total <= best[row]
            row, column, total = row[live], column[live], total[live]
        if len(row):
            # rows are in order: the first of each by distance, then index
            by = np.lexsort((column, total, row))
            row, column, total = row[by], column[by], total[by]
            lead = np.r_[True, row[1:] != row[:-1]]
            row, column, total = row[lead], column[lead], total[lead]
            better = (total < best[row]) | (column < index[row])
            index[row[better]], best[row[better]] = column[better], total[better]
    assert len(index) == n
    return index, best


def nearest_exactly(point: list[int], entries: list[list[int]]) -> tuple[int, int]:
    """The same for one point of any size: an entry is given up once its sum exceeds the best."""
    spread = [len(entries) * sum(x * x for x in own) - sum(own) ** 2 for own in zip(*entries)]
    order = sorted(range(len(point)), key=lambda d: (-spread[d], d))
    index, best = -1, None
    for i, entry in enumerate(entries):
        total = 0
        for d in order:
            total += (point[d] - entry[d]) ** 2
            if best is not None and total > best:
                break
        else:
            if best is None or total < best:
                index, best = i, total
    return index, best


class Search:
    """Codes of a batch of vectors by given codebooks."""

    def __init__(self, books: Codebooks):
        self.books = books
        self.width = len(books.entries[0][0])
        self.plain = all(abs(x) < PLAIN for book in books.entries for entry in book for x in entry) and self.width <= 4096
        self.arrays = [np.array(book, np.int64) for book in books.entries] if self.plain else []

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]] | None]:
        """Integers of the vectors, their indexes by part, and the distances by part: (row, part)."""
        own, large = integers(vectors)
        index, distance = np.zeros((len(own), self.books.parts), np.int64), np.zeros((len(own), self.books.parts), object)
        plain = np.flatnonzero(~large) if self.plain else np.zeros(0, np.int64)
        for p in range(self.books.parts):
            at = slice(p * self.width, (p + 1) * self.width)
            if len(plain):
                index[plain, p], distance[plain, p] = nearest(own[plain, at], self.arrays[p])
        for r in range(len(own)) if not self.plain else np.flatnonzero(large).tolist():
            point = own[r].tolist()
            for p in range(self.books.parts):
                index[r, p], distance[r, p] = nearest_exactly(point[p * self.width : (p + 1) * self.width], self.books.entries[p])
        return own, index, distance


def _finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))


def usable(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows that are kept, their vectors as doubles."""
    own = vectors.withColumn(vector_col, F.col(vector_col).cast("array<double>"))
    return own.where(_finite(F.col(vector_col)))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the usable rows; None if none can be cut into parts. Reads the rows once to start and once a round."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    small_arrow_batches(vectors.sparkSession)
    own = usable(vectors, vector_col).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    by_id = [F.col("id").asc_nulls_last(), F.col("v")]
    own = own.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    first = own.orderBy(*by_id).select(F.size("v").alias("n")).first()
    if first is None:
        return None
    own = own.where(F.size("v") == first.n)
    seeds = integers(np.array([r.v for r in own.orderBy(*by_id).limit(entries).collect()]))[0].tolist()
    width = first.n // parts
    books = Codebooks([[s[p * width : (p + 1) * width] for s in seeds] for p in range(parts)])
    for _ in range(rounds):
        books = _moved(own.select("v"), books)
    return books


def _moved(own: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after a round: each entry the floor of the mean of its parts; unused ones stay."""
    width, size = books.dimension // books.parts, len(books.entries[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(books)
        sums, counts = np.zeros((books.parts * size, width), object), np.zeros(books.parts * size, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            found, index, _ = search.codes(_matrix(batch.column(0)))
            low, high = found & 0xFFFFFFFF, found >> 32  # halves, whose sums do not overflow
            for p in range(books.parts):
                place, at = p * size + index[:, p], slice(p * width, (p + 1) * width)
                counts += np.bincount(place, minlength=len(counts))
                for d in range(width):
                    part = np.zeros((2, len(counts)), np.int64)
                    np.add.at(part[0], place, low[:, at][:, d])
                    np.add.at(part[1], place, high[:, at][:, d])
                    sums[:, d] += part[1].astype(object) * (1 << 32) + part[0].astype(object)
        used = np.flatnonzero(counts)
        flat = [(int(e), d, int(counts[e]), decimal.Decimal(int(sums[e, d]))) for e in used for d in range(width)]
        columns = list(zip(*flat)) or [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["entry", "d", "n", "total"])

    found = own.mapInArrow(run, "entry int, d int, n bigint, total decimal(38,0)").groupBy("entry", "d").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    entries = [[list(entry) for entry in book] for book in books.entries]
    for r in found.collect():  # bounded by the codebooks' size
        entries[r.entry // size][r.entry % size][r.d] = int(r.total) // r.n
    return Codebooks(entries)


def encode(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding") -> DataFrame:
    """The usable rows with ``code`` (two hex digits for each part) and ``error`` (squared distances, summed) in place of the vector."""
    small_arrow_batches(vectors.sparkSession)
    taken = {vector_col.lower(), "code", "error"}
    fields = [f for f in vectors.schema.fields if f.name.lower() not in taken]
    schema = T.StructType(fields + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(books)
        for batch in batches:
            names = batch.schema.names
            column = batch.column(names.index(vector_col))
            fits = np.asarray(column.value_lengths()) == books.dimension
            code, error = [None] * len(fits), [None] * len(fits)
            rows = np.flatnonzero(fits)
            if len(rows):
                _, index, distance = search.codes(_matrix(column.filter(pa.array(fits))))
                digits = index.astype(np.uint8).tobytes().hex()
                for k, (r, d) in enumerate(zip(rows.tolist(), distance.sum(axis=1).tolist())):
                    code[r], error[r] = digits[2 * books.parts * k : 2 * books.parts * (k + 1)], min(d, LARGEST)
            keep = [i for i, n in enumerate(names) if n.lower() not in taken]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(code, pa.string()), pa.array(error, pa.int64())], schema.names)

    return usable(vectors, vector_col).mapInArrow(run, schema)


def report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For each usable row: vec_id, code, error, the error summed over its label, and the digest of the codebooks.

    Labels' errors are added up before they are exchanged; how they come back, by broadcast or by an exchange, Spark decides by their size.
    """
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    books = fit(own, "vec_id", "embedding")
    if books is None:
        coded = usable(own).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        coded = encode(own, books)
    coded = staged(coded, "codes")
    errors = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    errors = errors.withColumn("total", F.when(F.col("total") > LARGEST, F.lit(LARGEST)).otherwise(F.col("total")).cast("long"))
    return coded.join(errors, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", F.col("total").alias("label_error"), F.lit(books.digest() if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256")
    )
