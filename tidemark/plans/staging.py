"""Written intermediate relations: computed once, read by many, with their lineage cut."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share; on one machine a temporary one where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Folders that this process has staged rows in and not deleted yet.
_STAGED: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what was staged inside. For results that have been written; rows still to be computed would miss it."""
    before, paths = len(_STAGED), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    try:
        yield
    finally:
        while len(_STAGED) > before:
            where = paths(_STAGED.pop())
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_blocks(rows: DataFrame, key: str, limit: int = 10_000) -> list[DataFrame]:
    """A query set as parts that are safe to broadcast: about ``limit`` rows each, by the hash of a key; usually one.

    Joins that only a nested loop can do (a text contains another) take the parts one after the other.
    """
    n = -(-rows.count() // limit)
    if n <= 1:
        return [F.broadcast(rows)]
    return [F.broadcast(rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)) for i in range(n)]


#: Rows of a few short columns that every task may hold.
FEW = 200_000


def if_few(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, at most n, as the side of a join that is broadcast if they are few; else the join exchanges both sides."""
    return F.broadcast(rows) if n <= FEW else rows


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
