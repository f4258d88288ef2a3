"""Immutable, versioned relations: a commit is a folder that is renamed into place, so that it is seen whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was based on."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def versions(self) -> list[int]:
        where = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def current(self) -> int:
        return max(self.versions(), default=0)

    def read(self, relation: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{(self.current() if version is None else version):08d}/{relation}")

    def commit(self, relations: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], base: int, partition_by: dict[str, list[str]] | None = None) -> int:
        """Writes all relations as version base + 1, or none: compare-and-set on the base version.

        A relation that is made from others of this version is a function of those before it, as they have been written.
        """
        staging, written = f"{self.root}/staging-{uuid.uuid4().hex}", {}
        for name, rows in relations.items():
            rows = rows(written) if callable(rows) else rows
            writer = rows.write
            if keys := (partition_by or {}).get(name):
                writer = writer.partitionBy(*keys)
            writer.parquet(f"{staging}/{name}")
            written[name] = self.spark.read.schema(rows.schema).parquet(f"{staging}/{name}")
        self.publish(staging, base + 1)
        return base + 1

    def publish(self, staging: str, version: int) -> None:
        """Shows a folder that has been written to its end as a version, unless there is one already."""
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = getattr(kind, "NONE")
        try:
            files.rename(self._path(staging), self._path(f"{self.root}/v{version:08d}"), options)
        except Exception as e:
            self._fs.delete(self._path(staging), True)
            raise Conflict(f"version {version}") from e

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def vacuum(self, keep: int = 2) -> None:
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.root}/v{v:08d}"), True)
