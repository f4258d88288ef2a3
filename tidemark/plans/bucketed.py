"""Tables that are bucketed by their keys, in a folder: groups and joins by the keys exchange none of their rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _named(spark: SparkSession, path: str, columns: str, keys: list[str], buckets: int) -> str:
    name = f"tidemark_{uuid.uuid4().hex}"
    by = ", ".join(keys)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def write(rows: DataFrame, path: str, columns: str, keys: list[str], buckets: int) -> None:
    """Writes ``rows`` as a new table in an empty folder. They are dealt by the keys to as many partitions as there are buckets, so that none is exchanged here."""
    spark = rows.sparkSession
    name = _named(spark, path, columns, keys, buckets)
    writer = rows.write.bucketBy(buckets, *keys)
    writer.mode("append").format("parquet").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")


def read(spark: SparkSession, path: str, columns: str, keys: list[str], buckets: int) -> DataFrame:
    """The table of a folder, as whoever wrote it has bucketed it."""
    return spark.table(_named(spark, path, columns, keys, buckets))
