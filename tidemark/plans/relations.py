"""Relations that change together: immutable Parquet segments, and a small manifest that is renamed into place.

A version is a manifest: which segments make up each relation. A change writes new segments only (rows, and the owners whose older rows no longer hold), so it costs what it
changes; one rename shows all of it or nothing. Three kinds of relations:

- rows: what is appended stays, until its owner is removed.
- owned: rows of an owner replace the owner's rows of before.
- sums: rows hold signed counts; what is read is their sum by key, without sums of 0. Such rows are never taken back but by their negatives.

A row knows the version that wrote it, and the removal of an owner only touches rows of versions before its own. So segments can be merged in any grouping: merging is size-tiered, FAN
segments of a size class at once, so that each row is rewritten once for each class.

A transaction reads one version, checks what its decision rests on, and commits onto that version only. If another writer came first it is decided anew on the new version:
checks hold at the version that the commit follows, never only at the one that was read first.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .snapshots import Conflict, Snapshots

VERSION = "__version"
#: Segments of one size class that are merged at once, and the factor between size classes.
FAN = 4
_MANIFEST = "relation string, part string, path string, rows long"


class Refused(ValueError):
    """What a change rests on does not hold; nothing has been written."""


@dataclass(frozen=True)
class Relation:
    """``owner``: the column whose value removes rows. ``sums``: key columns, counts to add, stamps of which the latest counts."""

    name: str
    schema: str | T.StructType
    owner: str | None = None
    key: tuple[str, ...] = ()
    counts: tuple[str, ...] = ()
    stamps: tuple[str, ...] = ()

    @property
    def fields(self) -> T.StructType:
        return T.StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema


@dataclass
class Change:
    """What one commit does: appended rows, rows that replace their owners' rows, and removed owners (one column), by relation."""

    append: dict[str, DataFrame] = field(default_factory=dict)
    replace: dict[str, DataFrame] = field(default_factory=dict)
    remove: dict[str, DataFrame] = field(default_factory=dict)
    result: object = None

    def __bool__(self) -> bool:
        return bool(self.append or self.replace or self.remove)


class State:
    """One version, as DataFrames."""

    def __init__(self, store: Relations, version: int, manifest: list):
        self.store, self.version, self.manifest = store, version, manifest

    def paths(self, relation: str, part: str) -> list[str]:
        return [f"{self.store.root}/{m.path}" for m in self.manifest if (m.relation, m.part) == (relation, part)]

    def _versioned(self, relation: str, part: str, fields: T.StructType) -> DataFrame:
        spark, paths = self.store.spark, self.paths(relation, part)
        schema = T.StructType([*fields.fields, T.StructField(VERSION, T.LongType())])
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def gone(self, relation: str) -> DataFrame | None:
        """(owner, version): removed owners, or None."""
        of = self.store.relations[relation]
        if not self.paths(relation, "gone"):
            return None
        rows = self._versioned(relation, "gone", T.StructType([of.fields[of.owner]]))
        return rows.groupBy(F.col(of.owner).alias("__gone")).agg(F.max(VERSION).alias("__gone_at"))

    def versioned(self, relation: str) -> DataFrame:
        """The rows that hold, with the version that wrote them."""
        of = self.store.relations[relation]
        rows, gone = self._versioned(relation, "rows", of.fields), self.gone(relation)
        if gone is None:
            return rows
        return rows.join(gone, (rows[of.owner] == gone["__gone"]) & (gone["__gone_at"] > rows[VERSION]), "left_anti")

    def read(self, relation: str) -> DataFrame:
        of = self.store.relations[relation]
        rows = self.versioned(relation).drop(VERSION)
        return summed(rows, of).select(*of.fields.names) if of.counts else rows


def summed(rows: DataFrame, of: Relation) -> DataFrame:
    """Counts added up by key; keys that come to nothing are left out."""
    sums = [F.sum(c).cast("long").alias(c) for c in of.counts] + [F.max(c).alias(c) for c in of.stamps]
    some = F.greatest(*[F.col(c) != 0 for c in of.counts]) if len(of.counts) > 1 else F.col(of.counts[0]) != 0
    return rows.groupBy(*of.key).agg(*sums).where(some)


class Relations:
    def __init__(self, spark: SparkSession, root: str, relations: Iterable[Relation]):
        self.spark, self.root = spark, root.rstrip("/")
        self.relations = {r.name: r for r in relations}
        self.versions = Snapshots(spark, f"{self.root}/versions")

    def open(self, version: int | None = None) -> State:
        version = self.versions.current() if version is None else version
        rows = self.versions.read("manifest", version).orderBy("path").collect() if version else []
        return State(self, version, rows)

    def _write(self, rows: DataFrame, fields: T.StructType, version: int | None, name: str, part: str) -> tuple:
        """A new segment; ``version`` marks its rows, unless they know theirs."""
        path = f"segments/{name}-{part}-{uuid.uuid4().hex}"
        own = [F.col(f.name).cast(f.dataType).alias(f.name) for f in fields.fields]
        marked = rows.select(*own, F.col(VERSION) if version is None else F.lit(version).cast("long").alias(VERSION))
        marked.write.parquet(f"{self.root}/{path}")
        # the files' footers tell how many rows there are
        return name, part, path, self.spark.read.parquet(f"{self.root}/{path}").count()

    def commit(self, state: State, change: Change) -> int:
        """Writes a change as the version after ``state``; Conflict if another one has been committed since."""
        version, new = state.version + 1, []
        try:
            for name, rows in change.append.items():
                new.append(self._write(rows, self.relations[name].fields, version, name, "rows"))
            for name, rows in change.replace.items():
                of = self.relations[name]
                new.append(self._write(rows, of.fields, version, name, "rows"))
                written = self.spark.read.parquet(f"{self.root}/{new[-1][2]}")
                new.append(self._write(written.select(of.owner).distinct(), T.StructType([of.fields[of.owner]]), version, name, "gone"))
            for name, owners in change.remove.items():
                of = self.relations[name]
                new.append(self._write(owners.toDF(of.owner).distinct(), T.StructType([of.fields[of.owner]]), version, name, "gone"))
            self._publish([tuple(m) for m in state.manifest] + [n for n in new if n[3]], version)
        except Exception:
            self._delete(n[2] for n in new)
            raise
        self._delete(n[2] for n in new if not n[3])
        return version

    def _publish(self, manifest: list[tuple], version: int) -> None:
        staging = f"{self.versions.root}/staging-{uuid.uuid4().hex}"
        self.spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.parquet(f"{staging}/manifest")
        self.versions.publish(staging, version)

    def _delete(self, paths: Iterable[str]) -> None:
        for path in paths:
            self.versions.delete(f"{self.root}/{path}")

    def transact(self, decide: Callable[[State], Change], tries: int = 5) -> object:
        """Commits what ``decide`` makes of the current version, and gives its result; decides anew where another writer came first."""
        for left in reversed(range(tries)):
            state = self.open()
            change = decide(state)
            if not change:
                return change.result
            try:
                self.commit(state, change)
                return change.result
            except Conflict:
                if not left:
                    raise

    def merge(self, name: str, whole: bool = False) -> int | None:
        """Merges the segments of a size class that has FAN or more, or all of them; the new version, or None if there was nothing to do.

        Rows that no longer hold are left out. Removals are merged too, and forgotten once no older row is left.
        """
        state, of = self.open(), self.relations[name]
        rows = [m for m in state.manifest if (m.relation, m.part) == (name, "rows")]
        gone = [m for m in state.manifest if (m.relation, m.part) == (name, "gone")]
        classes: dict[int, list] = {}
        for m in rows:
            classes.setdefault(0 if whole else int(math.log(max(m.rows, 1), FAN)), []).append(m)
        full = [own for own in classes.values() if len(own) >= (2 if whole else FAN)]
        if not full and not (whole and gone) and len(gone) < FAN:
            return None
        version, new, dropped = state.version + 1, [], []
        try:
            for own in full or ([rows] if whole and rows else []):
                part = State(self, state.version, [*own, *gone]).versioned(name)
                if of.counts:
                    part = summed(part, of).withColumn(VERSION, F.lit(state.version).cast("long"))
                new.append(self._write(part, of.fields, None, name, "rows"))
                dropped += own
            if gone:
                if not (whole or not rows):
                    merged = state.gone(name).select(F.col("__gone").alias(of.owner), F.col("__gone_at").alias(VERSION))
                    new.append(self._write(merged, T.StructType([of.fields[of.owner]]), None, name, "gone"))
                dropped += gone
            old = {m.path for m in dropped}
            self._publish([tuple(m) for m in state.manifest if m.path not in old] + [n for n in new if n[3]], version)
        except Exception:
            self._delete(n[2] for n in new)
            raise
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all versions but the last ``keep``, and the segments that only those had."""
        held = {m.path for v in self.versions.versions()[-keep:] for m in self.open(v).manifest}
        for v in self.versions.versions()[:-keep]:
            self._delete({m.path for m in self.open(v).manifest} - held)
        self.versions.vacuum(keep)
