"""Size-tiered compaction of immutable shards under a versioned manifest, in DataFrame functions only.

Arrivals are appended as small Parquet shards. Shards whose sizes fall in one tier (each tier spans a factor of FAN) are merged
when FAN of them have come together, into files of about the target size, until no tier is due; files of the target size
are never rewritten. A change becomes visible by its manifest alone: the next version's folder is written
under another name and renamed, which fails if another writer committed that version first. A writer that lost commits
again on top of the winner's version, where what it did still holds.

A version's folder holds what it adds and removes; every SNAPSHOT-th holds all live shards instead, so that no version
needs more than SNAPSHOT folders. Manifests are read and written by executors, and a commit costs as much as it changes.

Nothing is shuffled: a merge reads a tier's shards and writes as many files as the target size asks for, each by one
task from neighbouring partitions. What is planned on the driver is names and sizes of the files of one merge, never rows.

Files are deleted by vacuum() alone, which keeps everything that the last KEEP versions name, and everything younger than
a grace period, as it may belong to a writer that has not committed yet. A rename must be atomic in the store.

Defined results: every row of every arrival is in exactly one live shard, repeated rows and nulls included; an empty
arrival commits a version without shards; columns are kept as they are, whatever their names, and later arrivals must have the same columns.
"""

from __future__ import annotations

import math
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, drop_path, free_name, fresh_path

FAN = 4
TARGET_BYTES = 128 << 20
#: Shards below this are one tier.
LEAST_BYTES = 1 << 20
#: Every so many versions the manifest is written whole.
SNAPSHOT = 16
#: Versions that stay readable, and seconds that a file must be old before it may be deleted.
KEEP, GRACE = 4, 24 * 3600
#: How often a writer tries to commit on top of others.
TRIES = 20

MANIFEST = T.StructType(
    [
        T.StructField("shard", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("since", T.LongType()),
        T.StructField("live", T.BooleanType()),
    ]
)


class Conflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass(frozen=True)
class Shard:
    shard: str
    bytes: int
    tier: int
    since: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan: int = FAN, snapshot: int = SNAPSHOT):
        self.spark, self.root, self.target, self.fan, self.snapshot = spark, root.rstrip("/"), target_bytes, fan, snapshot
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _list(self, folder: str) -> list[tuple[str, int, float]]:
        """Names, sizes and ages in seconds."""
        where, now = self._path(folder), time.time()
        found = self._fs.listStatus(where) if self._fs.exists(where) else []
        return sorted((s.getPath().getName(), s.getLen(), now - s.getModificationTime() / 1000) for s in found)

    def tier(self, size: int) -> int:
        return 0 if size <= LEAST_BYTES else 1 + int(math.log(size / LEAST_BYTES, self.fan))

    def versions(self) -> list[int]:
        return [int(n[1:]) for n, *_ in self._list(f"{self.root}/manifest") if n.startswith("v")]

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(shard, bytes, tier, since): the live shards of a version, from the last whole manifest and the changes after it."""
        v = self.version() if version is None else version
        first = max(1, v - v % self.snapshot)
        folders = [f"{self.root}/manifest/v{i:08d}" for i in range(first, v + 1)]
        own = ["shard", "bytes", "tier", "since"]
        if not folders:
            return self.spark.createDataFrame([], MANIFEST).select(own)
        # a shard's name is never used again, so that one removal ends it
        rows = self.spark.read.schema(MANIFEST).json(folders)
        return rows.groupBy(own).agg(F.bool_and("live").alias("live")).where("live").select(own)

    def _shards(self, rows: DataFrame) -> list[Shard]:
        return sorted((Shard(*r) for r in rows.collect()), key=lambda s: s.shard)

    def shards(self, version: int | None = None) -> list[Shard]:
        return self._shards(self.manifest(version))

    def read(self, version: int | None = None, schema: T.StructType | None = None) -> DataFrame:
        """All live rows; those of an older version until vacuum() has deleted its shards."""
        names = [f"{self.root}/{r.shard}" for r in self.manifest(version).select("shard").orderBy("shard").collect()]
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        if not names and schema is None:
            raise ValueError("an empty store has no schema of its own")
        return reader.parquet(*names) if names else self.spark.createDataFrame([], schema)

    def _commit(self, added: list[Shard], removed: list[Shard], base: int) -> int:
        """Writes version base + 1 beside the manifests and renames it; exactly one of several writers succeeds."""
        staging, final = f"{self.root}/staging-{uuid.uuid4().hex}", f"{self.root}/manifest/v{base + 1:08d}"
        rows = [(s.shard, s.bytes, s.tier, base + 1, True) for s in added] + [(s.shard, s.bytes, s.tier, s.since, False) for s in removed]
        change = self.spark.createDataFrame(rows, MANIFEST)
        if (base + 1) % self.snapshot:
            change.coalesce(1).write.json(staging)
        else:
            gone = change.where("not live").select("shard")
            whole = self.manifest(base).join(gone, "shard", "left_anti").withColumn("live", F.lit(True))
            whole.unionByName(change.where("live")).write.json(staging)
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = getattr(rename, "NONE")
        try:
            files.rename(self._path(staging), self._path(final), options)
        except Exception as e:
            drop_path(self.spark, staging)
            raise Conflict(final) from e
        return base + 1

    def _found(self, run: str) -> list[Shard]:
        return [Shard(f"{run}/{n}", size, self.tier(size), 0) for n, size, _ in self._list(f"{self.root}/{run}") if n.endswith(".parquet")]

    def _write(self, rows: DataFrame) -> list[Shard]:
        run = f"data/run-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{run}")
        return self._found(run)

    def _add(self, made: list[Shard]) -> int:
        for _ in range(TRIES):
            try:
                return self._commit(made, [], self.version())
            except Conflict as e:
                lost = e
        raise lost

    def append(self, rows: DataFrame) -> int:
        """Adds an arrival as it is partitioned; returns the version that shows it. Arrivals of several writers do not conflict."""
        return self._add(self._write(rows))

    def arrivals(self, rows: DataFrame, number: Column, n: int) -> list[list[Shard]]:
        """Writes ``n`` arrivals, told apart by ``number`` (0 to n - 1), in one pass; none of them is committed yet."""
        of = free_name("arrival", rows)
        run = f"data/run-{uuid.uuid4().hex}"
        rows.withColumn(of, number.cast("int")).write.partitionBy(of).parquet(f"{self.root}/{run}")
        return [self._found(f"{run}/{of}={i}") for i in range(n)]

    def due(self, version: int | None = None) -> list[Shard]:
        """The shards of the lowest tier that has enough of them; those near the target size are finished."""
        small = self.manifest(version).where(F.col("bytes") < self.target // 2)
        tier = small.groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= self.fan).agg(F.min("tier").alias("tier")).head().tier
        return [] if tier is None else self._shards(small.where(F.col("tier") == tier))

    def compact(self) -> int:
        """Merges tiers until none is due. Each merge is a version; the rows of the store stay the same."""
        while merged := self.due(self.version()):
            files = max(1, round(sum(s.bytes for s in merged) / self.target))
            rows = self.spark.read.parquet(*[f"{self.root}/{s.shard}" for s in merged]).coalesce(files)
            made, names = self._write(rows), self.spark.createDataFrame([(s.shard,) for s in merged], "shard string")
            for _ in range(TRIES):
                base = self.version()
                # a merge stands only while all that it has merged is live; else the tiers are looked at again
                if self.manifest(base).join(names, "shard", "left_semi").count() < len(merged):
                    break
                try:
                    self._commit(made, merged, base)
                    break
                except Conflict as e:
                    lost = e
            else:
                raise lost
        return self.version()

    def vacuum(self, keep: int = KEEP, grace: float = GRACE) -> None:
        """Deletes files that none of the last ``keep`` versions names and that are older than ``grace`` seconds, and the manifests before those."""
        have = sorted(self.versions())
        kept = have[-keep:]
        if not kept:
            return
        live = {s.shard for v in kept for s in self.shards(v)}

        def clear(folder: str) -> None:
            for name, _, age in self._list(f"{self.root}/{folder}"):
                if name.endswith(".parquet"):
                    if age > grace and f"{folder}/{name}" not in live:
                        drop_path(self.spark, f"{self.root}/{folder}/{name}")
                elif name.startswith("run-") or "=" in name:
                    clear(f"{folder}/{name}")

        clear("data")
        # manifests from the last whole one before the first version that stays
        first = kept[0] - kept[0] % self.snapshot
        for v in have:
            if v < first:
                drop_path(self.spark, f"{self.root}/manifest/v{v:08d}")


def report(docs: DataFrame, arrivals: int = 4, id_col: str = "doc_id", root: str | None = None) -> DataFrame:
    """Shards ``docs`` in as many arrivals, compacting after each; a row for each document, with the shard that holds it.

    Columns: doc_id, shard, shard_bytes, tier, since (the version that wrote the shard), version (the last).
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root or fresh_path(spark, "shards"))
    for made in store.arrivals(docs, F.pmod(F.xxhash64(*columns_of(docs, [id_col])), F.lit(arrivals)), arrivals):
        store._add(made)
        store.compact()
    version = store.version()
    held = store.read(schema=docs.schema)
    # without a shard there is no file that a row could be in
    path = F.lit("") if store.manifest().isEmpty() else F.col("_metadata.file_path")
    rows = held.select(columns_of(held, [id_col])[0].alias("doc_id"), F.regexp_extract(path, r"(data/run-.+)$", 1).alias("shard"))
    named = store.manifest().select("shard", F.col("bytes").alias("shard_bytes"), "tier", "since")
    return rows.join(named, "shard").select("doc_id", "shard", "shard_bytes", "tier", "since", F.lit(version).cast("long").alias("version"))
