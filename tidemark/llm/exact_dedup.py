"""Exact deduplication against a persistent digest index.

The index is a Parquet table, bucketed and sorted by digest. New data is reduced to one row per digest, compared with
the index by a sort-merge anti-join (the index side needs no exchange) and the digests that are new are appended.

Every digest carries the batch that brought it, which whoever gives an index must name. A batch never counts its own digests as known, so a
batch that is run again under its name, because its job failed after the append or before its rows were written, gets the same decisions
again; the same rows under another name are a delivery of their own, and are all duplicates.

Defined results: null text counts as empty; empty texts are equal to each other; repeated rows (same id and text) are
members of one group, and the row with the smallest id stays; an empty table gives an empty result; a null id sorts
before every other; columns other than the id and the text are never read by the operator, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, drop_path, free_name, fresh_path, staged, text_or_empty

WHITE_SPACE = r"[\x20\x09-\x0D]+"
BUCKETS = 64
#: Files of one bucket from which on an index is worth merging: each append adds one to every bucket.
MERGE_FILES = 16


def digest_of(text: Column) -> Column:
    """SHA-256 (lowercase hex) of a text without its white space."""
    return F.sha2(F.regexp_replace(text, WHITE_SPACE, ""), 256)


class DigestIndex:
    """Digests of everything kept so far, in ``path``, which one writer at a time appends to.

    ``keep_id`` is the document that stays for a digest. Opening a path again, in any session, finds what was appended.
    A path holds generations, of which the last whole one counts; merge() writes the next.
    """

    COLUMNS = "digest STRING, keep_id BIGINT, n_chars BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets, self.name = spark, path.rstrip("/"), buckets, ""
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._open(max(self.generations(), default=1))

    def _folder(self, generation: int) -> str:
        return f"{self.path}/generation-{generation:08d}"

    def generations(self) -> list[int]:
        """Those that have been written to their end: Spark's mark of success is in them."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))] if self._fs.exists(self._at(self.path)) else []
        found = [int(n.rpartition("-")[2]) for n in names if n.startswith("generation-")]
        return sorted(g for g in found if self._fs.exists(self._at(f"{self._folder(g)}/_SUCCESS")))

    def _table(self, folder: str) -> str:
        name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{folder}'"
        )
        return name

    def _open(self, generation: int) -> None:
        self.close()
        self.generation, self.name = generation, self._table(self._folder(generation))

    def close(self) -> None:
        """Takes the session's table out of its catalogue; the files stay."""
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            self.name = ""

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def known(self, batch: str) -> DataFrame:
        """(digest, known_id) of other batches. The index is bucketed by digest, so nothing is exchanged."""
        return self.rows().where(F.col("batch") != batch).groupBy("digest").agg(F.min_by("keep_id", "batch").alias("known_id"))

    def _write(self, rows: DataFrame, name: str, folder: str) -> None:
        # by the number of the bucket, as Spark finds it: one file for each bucket, however many partitions the rows are dealt to
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        (
            rows.select("digest", "keep_id", "n_chars", "batch")
            .repartition(self.buckets, bucket)
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .format("parquet")
            .option("path", folder)
            .saveAsTable(name)
        )
        self.spark.catalog.refreshTable(name)

    def append(self, winners: DataFrame, batch: str) -> None:
        """Adds the winners (digest, keep_id, n_chars) of a batch that it has not added before."""
        own = self.rows().where(F.col("batch") == batch).select("digest")
        if not own.isEmpty():
            winners = winners.join(own.hint("merge"), "digest", "left_anti")
        self._write(winners.withColumn("batch", F.lit(batch)), self.name, self._folder(self.generation))

    def files(self) -> int:
        return len(self.rows().inputFiles())

    def merge(self) -> None:
        """Writes all rows as the next generation, one sorted file for each bucket; older ones stay for their readers until vacuum()."""
        nxt = self.generation + 1
        drop_path(self.spark, self._folder(nxt))
        name = self._table(self._folder(nxt))
        # read as plain files: a bucketed scan would pass for the exchange that the new files need
        rows = self.spark.read.schema(self.COLUMNS).parquet(self._folder(self.generation))
        self._write(rows, name, self._folder(nxt))
        self.spark.sql(f"DROP TABLE {name}")
        self._open(nxt)

    def vacuum(self) -> None:
        for g in self.generations():
            if g < self.generation:
                drop_path(self.spark, self._folder(g))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), digest_of(text).alias("digest"), F.length(text).cast("long").alias("n_chars")
    )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """A decision for each row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts in ``docs`` the longest original stays, then the smallest id; what other batches brought to the index
    stays before either. ``batch`` names the delivery, and is required with an index: run again under its name it gets the same decisions. Groups are
    reduced before they are exchanged, so that a hot digest moves one row per task; the join
    back is a sort-merge join of two exchanged sides, which AQE splits where a digest is hot.
    """
    if index is not None and not batch:
        raise ValueError("a batch that goes to an index needs a name")
    spark = docs.sparkSession
    own = index or DigestIndex(spark, fresh_path(spark, "digests"))
    rows = staged(keyed(docs, id_col, text_col), "keyed")
    best = staged(
        rows.groupBy("digest")
        .agg(F.min(F.struct((-F.col("n_chars")).alias("less"), "doc_id")).alias("best"), F.count("*").alias("group_size"))
        .select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("n_chars"), "group_size"),
        "best",
    )
    batch = batch or "only"
    known = own.known(batch)
    if known.isEmpty():
        fresh, decided = best, best.select("digest", "keep_id", "group_size", F.lit(False).alias("known"))
    else:
        fresh = staged(best.join(known.hint("merge"), "digest", "left_anti"), "fresh")
        decided = staged(
            best.join(known.hint("merge"), "digest", "left").select(
                "digest",
                F.coalesce("known_id", "keep_id").alias("keep_id"),
                "group_size",
                F.col("known_id").isNotNull().alias("known"),
            ),
            "decided",
        )
    own.append(fresh, batch)
    if own.files() > MERGE_FILES * own.buckets:
        own.merge()
    if index is None:
        own.close()
    return (
        rows.join(decided.hint("merge"), "digest")
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("known")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows repeated with their id, one stays."""
    decisions = deduplicate(docs, index, id_col, text_col, batch)
    # names that no column of the caller has
    of_id, of_text, times, own_text = (free_name(n, docs) for n in ("__id", "__digest", "__times", "__text_digest"))
    stays = decisions.where("kept").groupBy(F.col("doc_id").alias(of_id), F.col("text_sha256").alias(of_text)).agg(F.count("*").alias(times))
    stays = staged(stays, "stays")
    own = docs.withColumn(own_text, digest_of(text_or_empty(text_col)))
    found = own.join(stays.hint("merge"), own[id_col].cast("long").eqNullSafe(F.col(of_id)) & (F.col(own_text) == F.col(of_text)))
    once = found.where(F.col(times) == 1)
    once = once.select(*columns_of(once, docs.columns))
    if stays.where(F.col(times) > 1).isEmpty():
        return once
    repeated = found.where(F.col(times) > 1).dropDuplicates([of_id, of_text])
    return once.unionByName(repeated.select(*columns_of(repeated, docs.columns)))
