"""The bounded sample of labelled rows that a classifier is fitted on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import Grams

_PARTS = 1 << 30


def bounded(rows: DataFrame, size: int, id_col: str) -> DataFrame:
    """About ``size`` of the rows, and never more than twice as many, chosen by their id's hash: all ids alike."""
    total = rows.count()
    share = min(_PARTS, -(-size * _PARTS // max(1, total)))
    return rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(_PARTS)) < share).limit(2 * size)


def bounded_by_label(rows: DataFrame, size: int, id_col: str, label_col: str) -> DataFrame:
    """As ``bounded``, but every label has rows: from rare ones up to half of ``size`` more is taken, in equal parts.

    A label has one row at least, that of its least hash, so labels must be fewer than ``size``.
    """
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(_PARTS))
    found = rows.groupBy(F.col(label_col).alias("__of")).agg(F.count("*").alias("n"), F.min(at).alias("least")).collect()
    if not found:
        return rows.limit(0)
    share, part = -(-size * _PARTS // sum(r.n for r in found)), size // (2 * len(found))
    below = [(r["__of"], min(_PARTS, max(share, part * _PARTS // r.n, r.least + 1))) for r in found]
    bound = F.broadcast(rows.sparkSession.createDataFrame(below, "__of string, __below long"))
    met = rows.join(bound, F.col(label_col).cast("string") == F.col("__of")).where(at < F.col("__below"))
    return met.drop("__of", "__below").limit(2 * size)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    values = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _arrays(found: pa.Table, name: str) -> list[np.ndarray]:
    """The lists of a column as views of one array: no copies on the driver."""
    out: list[np.ndarray] = []
    for chunk in found.column(name).chunks:
        values, offsets = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    return out


def bags(rows: DataFrame, grams: Grams, id_col: str, label_col: str, text_col: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, features, counts) of a sample's rows, in the order of their ids. The features are found by executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = grams.bags(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    _lists([x[0] for x in found]),
                    _lists([x[1] for x in found]),
                ],
                ["id", "label", "features", "counts"],
            )

    own = rows.select(F.col(id_col).cast("string"), F.col(label_col).cast("string"), F.col(text_col).cast("string"))
    found = own.mapInArrow(run, "id string, label string, features array<int>, counts array<int>").toArrow()
    found = found.combine_chunks()
    order = np.argsort(np.array([x or "" for x in found.column("id").to_pylist()]), kind="stable") if found.num_rows else []
    labels, features, counts = found.column("label").to_pylist(), _arrays(found, "features"), _arrays(found, "counts")
    return [(labels[i], features[i], counts[i]) for i in order]
