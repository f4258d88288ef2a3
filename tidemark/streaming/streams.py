"""Streams: idempotent ingestion, a bounded ledger of probes, late timing events, and learning in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RING = 32
#: Keys that a note spells out; the rest is one sum, and all of them are in the relation of counts.
MAX_KEYS = 100


def ingest(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events once each: repeats of (agent, session, type, payload) within the watermark are dropped.

    ``created_at`` must be a timestamp; a zoneless one is read as UTC.
    """
    at = events.withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("payload_hash", F.sha2("payload", 256))
    return at.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["agent_id", "session_id", "event_type", "payload_hash"])


LEDGER = "project_key string, knowledge_id string, hits long, query_hashes array<string>"


def _ledger_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    hits, ring = state.get if state.exists else (0, [])
    ring = list(ring)
    for pdf in batches:
        for query in pdf.sort_values("seq")["query_hash"]:
            hits += 1
            if query in ring:
                ring.remove(query)
            ring.append(query)
        ring = ring[-RING:]
    state.update((hits, ring))
    yield pd.DataFrame({"project_key": [key[0]], "knowledge_id": [key[1]], "hits": [hits], "query_hashes": [ring]})


def shadow_ledger(probes: DataFrame) -> DataFrame:
    """Hits of each retired record and the last 32 distinct queries that found it; the state of a key is bounded by that."""
    return probes.groupBy("project_key", "knowledge_id").applyInPandasWithState(
        _ledger_step, LEDGER, "hits long, query_hashes array<string>", "update", GroupStateTimeout.NoTimeout
    )


def timed_turns(stops: DataFrame, timings: DataFrame, wait: str = "30 seconds") -> DataFrame:
    """Stops with their timing event, which may come later; without one when the watermark has passed it is unavailable."""
    s = stops.withColumn("stopped_at", F.col("stopped_at").cast("timestamp")).withWatermark("stopped_at", wait).alias("s")
    t = timings.withColumn("timed_at", F.col("timed_at").cast("timestamp")).withWatermark("timed_at", wait).alias("t")
    near = (F.col("s.turn_id") == F.col("t.turn_id")) & (F.col("t.timed_at") >= F.col("s.stopped_at")) & (F.col("t.timed_at") <= F.col("s.stopped_at") + F.expr(f"INTERVAL {wait}"))
    met = s.join(t, near, "leftOuter")
    return met.select(F.col("s.turn_id").alias("turn_id"), "s.stopped_at", "t.ttft_ms", "t.total_ms", F.when(F.col("t.turn_id").isNull(), "unavailable").otherwise("measured").alias("timing_status"))


def activity_sessions(events: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of activity: a run that has been silent for longer than the gap can be taken over."""
    at = events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
    own = at.groupBy(F.session_window("created_at", gap).alias("w"), "session_id").agg(F.count("*").alias("events"))
    return own.select("session_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "events")


def learn(turns: DataFrame, batch: Callable[[DataFrame, int], None], dead_letter: str, checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch of turns to ``batch``; turns without a user text go to the dead-letter folder instead.

    A batch that is run again after a failure has the same number, so ``batch`` can tell what it has committed already.
    """

    def run(rows: DataFrame, number: int) -> None:
        bad = F.coalesce(F.trim("user_text"), F.lit("")) == ""
        rows.where(bad).withColumn("batch", F.lit(number)).write.mode("append").json(dead_letter)
        batch(rows.where(~bad), number)

    return turns.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def announce(changes: DataFrame, by: list[str], publish: Callable[[dict], None], checkpoint: str, counts_to: str | None = None) -> StreamingQuery:
    """Tells ``publish`` of each micro-batch of changes: its number, how many rows and keys it has, and how many rows by key.

    A note spells out the keys of most rows; ``other`` has the rows of all other keys, so that a note always adds up to its rows. ``counts_to`` is a folder that gets
    the counts of every key, one subfolder for each batch. A note holds counts, never rows; a batch that is run again has the same number and replaces its counts.
    """

    def run(rows: DataFrame, number: int) -> None:
        key = F.concat_ws("/", *[F.coalesce(F.col(b).cast("string"), F.lit("")) for b in by])
        counts = rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
        if counts_to is not None:
            path = f"{counts_to}/batch={number}"
            counts.write.mode("overwrite").parquet(path)
            counts = rows.sparkSession.read.schema("key string, n long").parquet(path)
        sums = counts.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).head()
        told = {r["key"]: r["n"] for r in counts.orderBy(F.desc("n"), "key").limit(MAX_KEYS).collect()}
        publish({"batch": number, "rows": sums.rows, "keys": sums["keys"], "changes": told, "other": sums.rows - sum(told.values())})

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
