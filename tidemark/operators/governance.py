"""Governance plans: previews with guards, application only while guards hold, undo, and counterfactual probes of retired records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gates import obsolete

ACTIONS = ("approve", "quarantine", "archive", "merge", "supersede")
PLAN_HOURS, MAX_ACTIONS, RING = 24, 20, 32


def guards(records: DataFrame, evidence: DataFrame, audit: DataFrame) -> DataFrame:
    """(id, guard): a hash over a record, its evidence and its audit; it changes when any of them does."""
    ev, au = (_checksum(rows, prefix) for rows, prefix in ((evidence, "e"), (audit, "a")))
    row = F.to_json(F.struct(*sorted(records.columns)))
    met = records.select("id", row.alias("r")).join(ev, "id", "left").join(au, "id", "left")
    parts = ["r", *[F.coalesce(F.col(f"{p}{k}").cast("string"), F.lit("")) for p in "ea" for k in range(3)]]
    return met.select("id", F.sha2(F.concat_ws("\x1f", *parts), 256).alias("guard"))


def _checksum(rows: DataFrame, prefix: str) -> DataFrame:
    """(id, ...): how many rows a record has and two sums of their hashes, in whatever order; a row told twice counts twice."""
    text = F.to_json(F.struct(*sorted(rows.columns)))
    own = [F.count("*"), F.sum(F.xxhash64(text).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), text).cast("decimal(38,0)"))]
    return rows.groupBy(F.col("knowledge_id").alias("id")).agg(*[c.alias(f"{prefix}{k}") for k, c in enumerate(own)])


def _refusal() -> Column:
    """Why an action (a row of action, r.*, t.*) is not possible."""
    r, t = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"t.{c}"))
    act = F.col("action")
    wants_target = act.isin("merge", "supersede")
    same = (t("scope") == r("scope")) & ((r("scope") == "user") | (t("project_key") == r("project_key")))
    return F.coalesce(
        F.when(~act.isin(*ACTIONS), "unsupported_action"),
        F.when(r("id").isNull(), "record_not_found"),
        F.when(wants_target != F.col("target_id").isNotNull(), "target_only_for_merge_and_supersede"),
        F.when(wants_target & t("id").isNull(), "target_not_found"),
        F.when(~F.char_length(F.trim("reason")).between(1, 500), "reason_required"),
        F.when(r("superseded_by").isNotNull(), "superseded_record"),
        F.when(act.isin("approve", "supersede") & (~r("status").isin("candidate", "quarantined") | obsolete(r("title"), r("content"))), "not_reviewable"),
        F.when((act == "quarantine") & ~r("status").isin("candidate", "active", "stale"), "not_eligible_for_isolation"),
        F.when((act == "archive") & ~r("status").isin("active", "stale"), "not_serving"),
        F.when(
            (act == "merge")
            & ~((r("status") == "candidate") & t("status").isin("active", "stale") & (t("verified_count") > 0) & (r("content") == t("content")) & (r("knowledge_type") == t("knowledge_type"))),
            "not_an_exact_duplicate_of_accepted_knowledge",
        ),
        F.when(wants_target & ((t("id") == r("id")) | ~same), "target_in_another_scope"),
    )


def preview(actions: DataFrame, records: DataFrame, current: DataFrame) -> DataFrame:
    """Actions (plan_id, n, action, knowledge_id, target_id, reason) with refusal, guards and whether an operator must approve.

    A plan has 1 to 20 actions, and none may touch a record that another one touches.
    """
    met = (
        actions.alias("a")
        .join(records.alias("r"), F.col("a.knowledge_id") == F.col("r.id"), "left")
        .join(records.alias("t"), F.col("a.target_id") == F.col("t.id"), "left")
        .join(current.alias("g"), F.col("a.knowledge_id") == F.col("g.id"), "left")
        .join(current.alias("h"), F.col("a.target_id") == F.col("h.id"), "left")
    )
    judged = met.select("a.*", _refusal().alias("refusal"), F.col("g.guard").alias("guard"), F.col("h.guard").alias("target_guard"), ((F.col("action") != "merge") | (F.col("r.scope") != "project")).alias("requires_approval"))
    touched = actions.select("plan_id", F.explode(F.filter(F.array("knowledge_id", "target_id"), lambda x: x.isNotNull())).alias("id"))
    overlap = touched.groupBy("plan_id", "id").count().where("count > 1").select("plan_id").distinct().withColumn("overlap", F.lit(True))
    sizes = actions.groupBy("plan_id").agg(F.count("*").alias("size"))
    out = judged.join(overlap, "plan_id", "left").join(sizes, "plan_id")
    why = F.when(F.col("size") > MAX_ACTIONS, "too_many_actions").when(F.col("overlap"), "overlapping_actions").otherwise(F.col("refusal"))
    return out.withColumn("refusal", why).drop("overlap", "size")


def apply_plan(plan: DataFrame, current: DataFrame, approved: DataFrame, as_of: str) -> DataFrame:
    """Transitions (plan_id, id, to_status, superseded_by, target_id) of plans that still hold: a plan applies as a whole.

    Every guard must be unchanged, no action refused, the plan not older than a day, and approved where that is required.
    """
    now = F.lit(as_of).cast("timestamp")
    met = (
        plan.join(current.select(F.col("id").alias("knowledge_id"), F.col("guard").alias("now")), "knowledge_id", "left")
        .join(current.select(F.col("id").alias("target_id"), F.col("guard").alias("target_now")), "target_id", "left")
        .join(approved.select("plan_id", F.lit(True).alias("approved")), "plan_id", "left")
    )
    holds = (
        F.col("refusal").isNull()
        & F.col("guard").eqNullSafe(F.col("now"))
        & F.col("target_guard").eqNullSafe(F.col("target_now"))
        & (F.col("created_at") + F.expr(f"INTERVAL {PLAN_HOURS} HOURS") > now)
        & (~F.col("requires_approval") | F.coalesce("approved", F.lit(False)))
    )
    whole = met.groupBy("plan_id").agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("ok")).where("ok").select("plan_id")
    to = F.when(F.col("action").isin("approve", "supersede"), "active").when(F.col("action") == "quarantine", "quarantined").otherwise("archived")
    done = met.join(whole, "plan_id").withColumn("to_status", to)
    own = done.select("plan_id", F.col("knowledge_id").alias("id"), "to_status", F.when(F.col("action") == "merge", F.col("target_id")).alias("superseded_by"))
    replaced = done.where("action = 'supersede'").select("plan_id", F.col("target_id").alias("id"), F.lit("archived").alias("to_status"), F.col("knowledge_id").alias("superseded_by"))
    return own.unionByName(replaced)


def undo_plan(before: DataFrame, after: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of the snapshot before a plan, for records that have not changed since it was applied (by guard)."""
    same = after.select("id", "guard").join(current.select("id", F.col("guard").alias("now")), "id").where("guard = now").select("id")
    return before.join(same, "id", "left_semi")


def probe_ledger(probes: DataFrame, digests: DataFrame) -> DataFrame:
    """(project_key, knowledge_id, hits, query_hashes, digest): what retired records would have been found by.

    Probes (project_key, knowledge_id, query_hash, seq) are folded in order of seq; the last 32 distinct queries are kept.
    """
    firsts = probes.groupBy("project_key", "knowledge_id", "query_hash").agg(F.max("seq").alias("seq"), F.count("*").alias("n"))
    hits = firsts.groupBy("project_key", "knowledge_id").agg(F.sum("n").cast("long").alias("hits"))
    # only the last of each record are gathered: the window's limit is pushed below the exchange
    by = Window.partitionBy("project_key", "knowledge_id").orderBy(F.desc("seq"), F.desc("query_hash"))
    last = firsts.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= RING)
    recent = last.groupBy("project_key", "knowledge_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "query_hash"))), lambda x: x["query_hash"]).alias("query_hashes"))
    return hits.join(recent, ["project_key", "knowledge_id"]).select("project_key", "knowledge_id", "hits", "query_hashes").join(digests, "knowledge_id", "left")


def resurrect_plan(ledger: DataFrame, records: DataFrame, threshold: int = 1) -> DataFrame:
    """Archived, unreplaced records that were found often enough while their text is still what was probed."""
    met = ledger.join(records.select(F.col("id").alias("knowledge_id"), "status", "superseded_by", F.col("digest").alias("now")), "knowledge_id")
    ok = (F.col("status") == "archived") & F.col("superseded_by").isNull() & (F.col("hits") >= threshold) & (F.col("digest") == F.col("now"))
    return met.where(ok).select(F.col("knowledge_id").alias("id"), F.lit("archived").alias("expected_status"), F.lit("active").alias("to_status"))


def prune_ledger(ledger: DataFrame, records: DataFrame) -> DataFrame:
    return ledger.join(records.where("status = 'archived'").select(F.col("id").alias("knowledge_id")), "knowledge_id", "left_semi")


def recovery_candidates(requests: DataFrame, retired: DataFrame) -> DataFrame:
    """Archived rows found for a request that were verified once and are supported by evidence."""
    return retired.where("status = 'archived' and verified_count > 0 and superseded_by is null and supported").join(requests.select("query_id"), "query_id", "left_semi")
