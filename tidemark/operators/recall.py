"""Recall and its aftermath: search, recovery of retired records, a packed context, its trace, and what a turn made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_hash, record_digest
from ..plans.staging import staged
from ..schemas import with_defaults
from . import gates, reuse
from .search import Policy, insert_recovered, search


def recover(requests: DataFrame, records: DataFrame, policy: Policy, limit: int = 8) -> DataFrame:
    """(query_id, id, rank, score): verified archived records that a search with retired ones finds, with evidence."""
    wide = Policy(limit=limit, slack=0, stages=(), statuses=(*policy.statuses, "archived"))
    archived = records.where("status = 'archived'")
    if archived.isEmpty():
        return requests.sparkSession.createDataFrame([], "query_id long, id long, rank long, score double")
    found, _ = search(requests, records, wide)
    own = with_defaults(archived.where("verified_count > 0")).where("superseded_by is null")
    met = found.join(own, "id").join(requests.select("query_id", "query"), "query_id")
    scored = met.withColumn("s", gates.evidence_support(F.col("query"), F.col("title"), F.col("search_terms"), F.col("content")))
    return scored.where("s.supported").select("query_id", "id", F.col("position").alias("rank"), "s.score")


def recall(requests: DataFrame, records: DataFrame, policy: Policy = Policy(), budget: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(traces, transitions) for requests (query_id, query, project_key, agent_id, session_id, prompt).

    A trace holds the packed items in order; a retired record that is packed becomes active by the transitions, which a
    snapshot commit applies together with the traces.
    """
    selected, _ = search(requests, records, policy)
    own = with_defaults(records)
    texts = own.select("id", "title", "search_terms", "content", "source_agent", "status")
    pages = selected.join(texts, "id").join(requests.select("query_id", "query"), "query_id")
    scored = pages.withColumn("score", gates.evidence_support(F.col("query"), F.col("title"), F.col("search_terms"), F.col("content"))["score"])
    merged = staged(insert_recovered(scored.select("query_id", "id", "position", "score"), recover(requests, records, policy)), "pages")
    sized = merged.join(texts.select("id", (F.char_length("title") + F.char_length("content")).cast("long").alias("chars")), "id")
    packed = staged(reuse.pack_greedy(sized, budget), "packed")
    found_by = selected.select("query_id", "id", "origin", "parent")
    items = packed.select("query_id", F.posexplode("ids").alias("rank", "id")).join(texts, "id").join(found_by, ["query_id", "id"], "left")
    item = F.struct(
        "rank", F.col("id").alias("knowledge_id"), "source_agent", F.when(F.col("status") == "archived", "lfhv_recovered").otherwise(F.coalesce("origin", F.lit("direct"))).alias("origin"), F.col("parent").alias("related_to"),
        F.lit(True).alias("emitted"), record_digest(F.col("title"), F.col("content")).alias("content_hash"), F.lit(False).alias("citation_observed"),
    )
    lists = items.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    keys = requests.select("query_id", "agent_id", "project_key", "session_id", query_hash(F.col("prompt")).alias("prompt_hash"))
    traces = keys.join(lists, "query_id").join(packed.select("query_id", F.col("used").alias("context_chars")), "query_id")
    traces = traces.withColumn("trace_id", F.concat(F.lit("rt_"), F.sha2(F.concat_ws("\x1f", F.col("query_id").cast("string"), "agent_id", "session_id", "prompt_hash"), 256)))
    back = items.where("status = 'archived'").select("id", F.lit("archived").alias("expected_status"), F.lit("active").alias("to_status")).distinct()
    return traces, back


def cited(traces: DataFrame, turns: DataFrame) -> DataFrame:
    """Traces with citations observed: a turn (trace_id, assistant_text) that names a record's id has cited it."""
    met = traces.join(turns, "trace_id", "left")
    seen = lambda i: F.coalesce(F.regexp_like("assistant_text", F.concat(F.lit(r"\bkn_\Q"), i["knowledge_id"].cast("string"), F.lit(r"\E\b"))), F.lit(False))
    return met.withColumn("items", F.transform("items", lambda i: i.withField("citation_observed", seen(i)))).drop("assistant_text")
