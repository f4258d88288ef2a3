"""Reuse of records in turns: packing a context, matching turns to traces, showing items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pack_prefix(rows: DataFrame, budget: int) -> DataFrame:
    """Blocks in order until the first that does not fit: a running sum."""
    by = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum("chars").over(by)).where(F.col("used") <= budget)


def pack_greedy(rows: DataFrame, budget: int) -> DataFrame:
    """Blocks in order, passing over those that do not fit: a fold over the page, which has a bounded number of blocks."""
    page = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "id", "chars"))).alias("blocks"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("ids"))

    def step(a: Column, b: Column) -> Column:
        fits = a["used"] + b["chars"] <= budget
        return F.struct(
            F.when(fits, a["used"] + b["chars"]).otherwise(a["used"]).alias("used"),
            F.when(fits, F.array_append(a["ids"], b["id"])).otherwise(a["ids"]).alias("ids"),
        )

    return page.select("query_id", F.aggregate("blocks", start, step).alias("p")).select("query_id", "p.used", "p.ids")


def associate(turns: DataFrame, traces: DataFrame) -> DataFrame:
    """(turn, trace_id, association): by turn id, boundary, cited trace, then equal prompt; the best way must be unambiguous."""
    open_ = traces.where("completed_at is null")
    keys = ["agent_id", "project_key", "session_id"]
    t = turns.select(*keys, "turn_key", "turn_id", "boundary", "prompt_hash", "cited_traces")
    ways = [
        t.where("turn_id is not null").join(open_, [*keys, "turn_id"]).select("turn_key", "trace_id", F.lit(1).alias("way")),
        t.join(open_, [*keys, "prompt_hash", "boundary"]).select("turn_key", "trace_id", F.lit(2).alias("way")),
        t.select(*keys, "turn_key", F.explode("cited_traces").alias("trace_id")).join(open_, [*keys, "trace_id"]).select("turn_key", "trace_id", F.lit(3).alias("way")),
        t.join(open_, [*keys, "prompt_hash"]).select("turn_key", "trace_id", F.lit(4).alias("way")),
    ]
    met = ways[0]
    for w in ways[1:]:
        met = met.unionByName(w)
    best = met.groupBy("turn_key", "way").agg(F.countDistinct("trace_id").alias("n"), F.min("trace_id").alias("trace_id"))
    first = best.groupBy("turn_key").agg(F.min_by(F.struct("n", "trace_id", "way"), "way").alias("b")).select("turn_key", "b.*").where("n = 1")
    names = F.array(*[F.lit(x) for x in ("turn_id", "transcript_boundary", "trace_citation", "unique_prompt_hash")])
    return first.select("turn_key", "trace_id", F.element_at(names, F.col("way")).alias("association"))


def holding(traces: DataFrame, knowledge_id: Column) -> DataFrame:
    return traces.where(F.exists("items", lambda i: i["knowledge_id"] == knowledge_id))


def listed(traces: DataFrame) -> DataFrame:
    """Traces as they are shown: without prompts, and with an origin for items that predate origins."""
    fill = F.transform("items", lambda i: i.withField("origin", F.coalesce(i["origin"], F.lit("direct"))))
    return traces.drop("prompt_hash", "session_id").withColumn("items", fill)


def live(items: DataFrame, records: DataFrame) -> DataFrame:
    """Emitted items checked against the current snapshot: state, content and version must still hold."""
    now = records.select(F.col("id").alias("knowledge_id"), F.col("status").alias("now_status"), F.col("content_hash").alias("now_hash"))
    met = items.join(now, "knowledge_id", "left")
    why = (
        F.when(F.col("now_status").isNull(), "removed")
        .when(~F.col("now_status").isin("active", "stale"), "retired")
        .when(F.col("now_hash") != F.col("content_hash"), "content_changed")
    )
    return met.withColumn("omitted_reason", why)


def scrubbed(traces: DataFrame, removed: DataFrame) -> DataFrame:
    """Traces without items of removed records, however many are removed; traces that become empty stay.

    Only traces that hold a removed record are changed: their items are joined with the removed ids one by one.
    """
    gone = removed.select(F.col("id").alias("__gone")).distinct()
    held = traces.select(F.col("id").alias("__id"), F.explode("items").alias("__item")).select("__id", F.col("__item.knowledge_id").alias("__gone"))
    # a trace holds a bounded number of items, and so of removed ids
    hits = held.join(gone, "__gone").groupBy("__id").agg(F.collect_set("__gone").alias("__gone"))
    met = traces.join(hits, F.col("id") == F.col("__id"), "left")
    kept = F.filter("items", lambda i: ~F.coalesce(F.array_contains(F.col("__gone"), i["knowledge_id"]), F.lit(False)))
    return met.withColumn("items", F.when(F.col("__gone").isNull(), F.col("items")).otherwise(kept)).drop("__id", "__gone")
