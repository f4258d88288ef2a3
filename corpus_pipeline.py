"""A corpus pipeline over `documents`: each stage works on all that the one before has kept.

language ID -> exact deduplication -> near-deduplication -> benchmark decontamination -> byte-level BPE

Defined results: a row with a null or empty text, or one without a letter, goes at the first stage, so that no later stage sees it; a null id, language or
source stays as it is; of rows that are repeated with their id one stays; very long texts are read whole; an empty table gives an empty result; columns
that documents has besides stay up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, exact_dedup, langid, minhash
from tidemark.llm.common import drop_path, fresh_path, scratch, table
from tidemark.llm.queries import tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts for which no language is likelier than all others together."""
    return langid.keep_recognised(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest stays, then that of the smallest id."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest id stays."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows hit one word in twenty or more."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, whose decoded bytes are checked by their digest."""
    own = docs.select("doc_id", "lang", "source", "text")
    coded = bpe.encode(own, *tokenizer(), decoded=True)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("decontaminate", decontamination),
    ("byte_bpe", tokens),
]

#: Language ID and near-deduplication cannot be stated in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        # what a stage has staged is not needed once its rows are written, nor are the rows of the stage before
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
