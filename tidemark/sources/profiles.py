"""Inputs described by data: field mappings of hook payloads, sessions found by their header, turns frozen by their hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def mapped(payloads: DataFrame, fields: dict[str, str | list[str]], payload_col: str = "payload") -> DataFrame:
    """One column for each field, from dotted paths of a JSON payload; of several paths the first that is there counts."""
    found = {n: F.coalesce(*[F.get_json_object(payload_col, f"$.{p}") for p in ([paths] if isinstance(paths, str) else paths)]) for n, paths in fields.items()}
    return payloads.select(*[c.alias(n) for n, c in found.items()])


def newest_sessions(spark: SparkSession, folder: str, session_id: str, keep: int = 80) -> DataFrame:
    """Of the newest ``keep`` session files, those whose first line is the header of a session."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(folder)
    newest = files.select("path", "modificationTime", F.substring(F.col("content"), F.lit(1), F.lit(65536)).alias("head")).orderBy(F.desc("modificationTime"), "path").limit(keep)
    first = F.substring_index(F.decode("head", "UTF-8"), "\n", 1)
    return newest.where(F.get_json_object(first, "$.payload.id") == session_id).select("path", "modificationTime")


def frozen(turns: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dead letters): turns whose source hash is still what it was when they were queued (path, expected_hash)."""
    met = turns.join(expected, "path")
    same = F.col("source_hash") == F.col("expected_hash")
    return met.where(same).drop("expected_hash"), met.where(~same).select("path", F.lit("turn_changed").alias("reason"))


def end_bound(text: Column) -> Column:
    """The end of a range given as text: a date alone means the end of that day."""
    return F.when(F.char_length(text) == 10, F.to_timestamp(text) + F.expr("INTERVAL '1' DAY") - F.expr("INTERVAL '1' MICROSECOND")).otherwise(F.to_timestamp(text))


def append_jsonl(rows: DataFrame, path: str, secret_cols: tuple[str, ...] = ()) -> None:
    """Adds rows to an audit log; the given columns are redacted."""
    from ..functions.text import redact

    rows.withColumns({c: redact(F.col(c)) for c in secret_cols}).write.mode("append").json(path)
