"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all documents that may be learnt from. The weights are fitted on a bounded sample
of them (SAMPLE rows, chosen by the hash of their ids, with rows of every language) by follow-the-regularised-leader with an elastic-net penalty,
and a temperature is calibrated on a part of the sample that the weights have not seen. A text's TF-IDF vector is
linear in its n-grams, so prediction adds one table row for each n-gram of the whole text.

Defined results: texts that are null, empty or without a letter are ``und`` with score 1; with nothing to learn from,
every text is ``und`` with score 0; repeated rows get equal predictions; rows with a null language are predicted but never learnt from; other columns pass through, but
for those of the output's names, which annotate() replaces; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, fold_of, free_name, small_arrow_batches
from .grams import Grams, has_letter
from .sampling import bags, bounded_by_label

GRAMS = Grams(orders=(1, 2, 3), bits=15, only_letters=True)
#: Rows that the weights are fitted on, about; never more than twice as many.
SAMPLE = 3000
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    grams: Grams = GRAMS

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        sums, n = self.grams.sums(texts, self.table)
        return softmax((sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), [float(not has_letter(t)) for t in texts]
        p = self.probabilities(texts)
        best = p.argmax(axis=1)
        known = [has_letter(t) for t in texts]
        names = [self.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known)]
        return names, [float(s) if k else 1.0 for s, k in zip(p[np.arange(len(p)), best].tolist(), known)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(
    examples: list[tuple[np.ndarray, np.ndarray, int]],
    size: int,
    classes: int,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.1,
    epochs: int = 4,
    seed: int = 11,
) -> np.ndarray:
    """Weights (size, classes) by FTRL-proximal: most of them exactly 0."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(at) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(examples)):
            at, x, y = examples[i]
            w = weights(at)
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            n_new = n[at] + g * g
            z[at] += g - (np.sqrt(n_new) - np.sqrt(n[at])) / alpha * w
            n[at] = n_new
    return weights(slice(None))


def temperature_of(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(truth):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean())

    low, high, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(rows: DataFrame, grams: Grams, text_col: str) -> tuple[np.ndarray, int]:
    """In how many texts each feature is, over all rows, and the number of rows: sums by task, then by feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(grams.size, np.int64), 0
        for batch in batches:
            seen += grams.document_counts(batch.column(0).to_pylist())
            total += batch.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], total), pa.int64())], ["feature", "n"]
        )

    found = rows.select(F.col(text_col).cast("string")).mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    out, total = np.zeros(grams.size, np.int64), 0
    for r in found.collect():
        if r.feature < 0:
            total = r.n
        else:
            out[r.feature] = r.n
    return out, total


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE,
    grams: Grams = GRAMS,
) -> Model:
    """Learns from rows with a language whose id is not in the held-out fold."""
    small_arrow_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & (fold_of(id_col) != 0))
    seen, total = document_frequencies(rows, grams, text_col)
    idf = np.log((1 + total) / (1 + seen)) + 1
    found = [(a, at, n) for a, at, n in bags(bounded_by_label(rows, sample, id_col, lang_col), grams, id_col, lang_col, text_col) if len(at)]
    languages = sorted({a for a, _, _ in found})
    if not languages:
        return Model([], np.zeros((grams.size, 0), np.float32), np.zeros(0), 1.0, grams)
    # the last feature is the constant 1; the rest of a vector is TF-IDF with counts over the text's n-grams, of norm about 1
    scale = 10.0
    examples = [
        (np.append(at, grams.size), np.append(scale * n / n.sum() * idf[at], 1.0), languages.index(a)) for a, at, n in found
    ]
    kept, checked = examples[len(examples) // 5 :], examples[: len(examples) // 5]
    # a language that only the checked part has is learnt from
    fitted = {y for _, _, y in kept}
    kept, checked = kept + [e for e in checked if e[2] not in fitted], [e for e in checked if e[2] in fitted]
    w = follow_the_leader(kept, grams.size + 1, len(languages))
    logits = np.array([x @ w[at] for at, x, _ in checked]).reshape(-1, len(languages))
    t = temperature_of(logits, np.array([y for _, _, y in checked], np.int64))
    return Model(languages, (w[:-1] * idf[:, None] * scale).astype(np.float32), w[-1], t, grams)


def annotate(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language of each whole text and its calibrated probability."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name not in (lang_out, score_out)]
    schema = T.StructType(fields + [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            lang, score = shared.value.predict(batch.column(names.index(text_col)).cast(pa.string()).to_pylist())
            keep = [i for i, n in enumerate(names) if n not in (lang_out, score_out)]
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + made, schema.names)

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return annotate(own, fit(docs, id_col, text_col, lang_col)).select(
        "doc_id", (fold_of("doc_id") == 0).alias("held_out"), "lang_pred", "score"
    )


def keep_recognised(docs: DataFrame, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without texts that have no language, or none that is likelier than all others together."""
    lang, score = (free_name(n, docs) for n in ("__lang_pred", "__lang_score"))
    found = annotate(docs, fit(docs, text_col=text_col), text_col, lang, score)
    good = (F.col(lang) != UNDETERMINED) & (F.col(score) >= least)
    return found.where(good).select(*columns_of(found, docs.columns))
