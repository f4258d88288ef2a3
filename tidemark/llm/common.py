"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What Spark hands to Python at once, the same for all operators: whichever bound is met first ends a batch. The bytes
#: bound a worker's memory where texts are long; one text is never parted.
ARROW_ROWS, ARROW_BYTES = 256, 8 << 20

#: Folders that this process has staged rows in and not deleted yet.
_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset on one machine, as in tests, a temporary
    folder is made and set; on a cluster that is an error, as no other machine would see such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what was staged inside. For results that have been written; rows still to be computed would miss it."""
    before = len(_STAGED)
    try:
        yield
    finally:
        while len(_STAGED) > before:
            drop_path(spark, _STAGED.pop())


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: cuts the lineage, and is computed once."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_arrow_batches(spark: SparkSession) -> None:
    """Bounds the memory of a Python worker by what it gets at once, and lets it import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    own, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [x for x in (env.get("PYTHONPATH"), os.environ.get("PYTHONPATH")) if x]
    if not any(own in x.split(os.pathsep) for x in known):
        env["PYTHONPATH"] = os.pathsep.join([own, *known[:1]])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is the held-out fold. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, or with underscores after it, so that no column of the frames has it; names differ by more than case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(frame: DataFrame, names: list[str]) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [frame["`" + n.replace("`", "``") + "`"] for n in names]
