"""Views of records for readers: public fields, sharing, related accepted records, counters of reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lifecycle import confidence


def public(records: DataFrame, requester: Column) -> DataFrame:
    """What a requester sees of records: no raw columns, how sure they are, and whether they came from another agent."""
    return records.select(
        "id", "title", "knowledge_type", "scope", "status", "source_agent", confidence(F.col("verified_count"), F.col("rejected_count")).alias("confidence"),
        (F.col("source_agent") != requester).alias("cross_agent"),
    )


def sharing(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """Records with the agents that gave evidence, and whether another agent than the author has confirmed them."""
    own = evidence.groupBy(F.col("knowledge_id").alias("id")).agg(
        F.array_sort(F.collect_set("agent_id")).alias("agents"), F.array_sort(F.collect_set(F.when(F.col("outcome") == "verified", F.col("agent_id")))).alias("confirmed_by")
    )
    met = records.join(own, "id", "left")
    empty = F.array().cast("array<string>")
    others = F.array_remove(F.coalesce("confirmed_by", empty), F.col("source_agent"))
    state = F.when(F.size(others) > 0, "confirmed").when(F.col("status").isin("active", "stale"), "available").otherwise("private")
    return met.select("id", F.coalesce("agents", empty).alias("agents"), state.alias("sharing_state"))


def related_accepted(candidates: DataFrame, serving: DataFrame) -> DataFrame:
    """Candidates (id, project_key, term) that share a title term with a serving record of their project."""
    other = serving.select("project_key", "term", F.col("id").alias("other"))
    return candidates.join(other, (candidates["project_key"] == other["project_key"]) & (candidates["term"] == other["term"]) & (candidates["id"] != other["other"]), "left_semi").select("id").distinct()


def reasons(rows: DataFrame, *by: str) -> DataFrame:
    """Rejections by key as a map from reason to count."""
    counts = rows.where("reason is not null").groupBy(*by, "reason").agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("rejection_reasons"))


def retention_audit(cases: DataFrame, kept: DataFrame) -> DataFrame:
    """By outcome of cases (query_id): how many have a kept record (query_id, id, holds) that holds the answer literally, any kept record, none."""
    met = cases.join(kept.select("query_id", "id", "holds"), "query_id", "left")
    case = met.groupBy("query_id").agg(F.bool_or(F.coalesce("holds", F.lit(False))).alias("answered"), F.count("id").alias("n_kept"))
    outcome = F.when(F.col("answered"), "answer_kept").when(F.col("n_kept") > 0, "evidence_kept").otherwise("lost")
    return case.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("cases"))


def provenance(links: DataFrame, runs: DataFrame, agents: DataFrame) -> DataFrame:
    """Records (knowledge_id, relation) with the runs that made them and the agents behind those."""
    known = runs.select("run_id", "status")
    return links.join(known, "run_id").join(agents.select("agent_key", "agent_name"), "agent_key")


def with_members(runs: DataFrame, links: DataFrame, relation: str = "produced") -> DataFrame:
    """Runs that have made at least one record."""
    return runs.join(links.where(F.col("relation") == relation).select("run_id"), "run_id", "left_semi")


def turn_groups(turns: DataFrame) -> DataFrame:
    """(conv_id, turn_group, user_chars, replies, reply_chars) of turns (conv_id, turn, role, text): each user turn with what follows it."""
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    number = F.sum(user.cast("long")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("turn_group", number).where("turn_group > 0").groupBy("conv_id", "turn_group").agg(
        F.max(F.when(user, F.char_length("text"))).cast("long").alias("user_chars"),
        F.count_if(reply).alias("replies"),
        F.coalesce(F.sum(F.when(reply, F.char_length("text"))), F.lit(0)).cast("long").alias("reply_chars"),
    )
