"""Quality classifier: supervised subword embeddings.

Words and character n-grams are hashed to learned vectors, a document is their average, and a softmax layer gives its
class; vectors and layer are trained together by numpy stochastic gradient descent on a bounded sample of labelled rows
(SAMPLE rows, chosen by the hash of their ids). Average and layer are both linear, so after training each feature
is one number, and scoring adds up the numbers of the whole text's features.

Defined results: null and empty texts have no features and get the layer's score of the zero vector; labels other than 0 and 1
and null labels are not learnt from; of a document labelled twice each label counts; with nothing to learn from, every score is 0.5; repeated rows get equal scores; other columns
pass through, but for one of the output's name, which annotate() replaces; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, fold_of, small_arrow_batches
from .grams import Grams
from .sampling import bags, bounded

GRAMS = Grams(orders=(2, 3, 4), bits=17, words=True)
#: Rows that are learnt from, about; never more than twice as many.
SAMPLE = 4000
THRESHOLD = 0.3


@dataclass
class Model:
    table: np.ndarray
    bias: float
    grams: Grams = GRAMS

    def scores(self, texts: list[str | None]) -> np.ndarray:
        sums, n = self.grams.sums(texts, self.table)
        return 1 / (1 + np.exp(-(sums[:, 0] / np.maximum(n, 1) + self.bias)))


def train(
    examples: list[tuple[int, np.ndarray, np.ndarray]],
    grams: Grams,
    dim: int = 16,
    epochs: int = 12,
    rate: float = 5.0,
    seed: int = 5,
) -> Model:
    """Vectors (size, dim) and a layer (dim, 2), one example at a time, with a rate that falls to 0."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dim, 1 / dim, (grams.size, dim)).astype(np.float32)
    layer, bias = random.normal(0, 0.1, (dim, 2)), np.zeros(2)
    steps, step = epochs * len(examples), 0
    for _ in range(epochs):
        for i in random.permutation(len(examples)):
            label, at, n = examples[i]
            own = rate * (1 - step / steps)
            step += 1
            share = (n / n.sum()).astype(np.float32) if len(n) else np.zeros(0, np.float32)
            mean = share @ vectors[at]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= 0.1 * own * np.outer(mean, p)
            bias -= 0.01 * own * p
            # features are many and each has a small share; scaled so that a step moves the mean by about the rate
            if len(at):
                vectors[at] -= ((own / (share @ share)) * share)[:, None] * (back * 0.1).astype(np.float32)
    difference = layer[:, 1] - layer[:, 0]
    return Model((vectors @ difference).astype(np.float32)[:, None], float(bias[1] - bias[0]), grams)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    grams: Grams = GRAMS,
) -> Model:
    small_arrow_batches(docs.sparkSession)
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold_of(id_col) != 0))
    usable = usable.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"))
    # the sample is bounded, 16 bytes a row, whatever the size of the tables
    chosen = F.broadcast(bounded(usable, sample, "__id"))
    own = docs.select(*[c.alias(n) for c, n in zip(columns_of(docs, [id_col, text_col]), ("__of", "__text"))])
    rows = own.join(chosen, F.col("__of") == F.col("__id")).select("__id", "__label", "__text")
    found = [(int(y), at, n) for y, at, n in bags(rows, grams, "__id", "__label", "__text")]
    if not found:
        return Model(np.zeros((grams.size, 1), np.float32), 0.0, grams)
    return train(found, grams)


def annotate(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            scores = shared.value.scores(batch.column(names.index(text_col)).cast(pa.string()).to_pylist())
            keep = [i for i, n in enumerate(names) if n != out]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(scores)], schema.names)

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return annotate(own, fit(docs, labels, id_col, text_col)).select(
        "doc_id",
        (fold_of("doc_id") == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
