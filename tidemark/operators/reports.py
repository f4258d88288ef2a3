"""Reports of evaluations: rates by arm, mode, category and stage, and what they differ by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged
from .metrics import at_ranks, nearest_rank, ratio

MODES = ("baseline", "auto", "oracle")


def rate(flag: Column, among: Column | None = None, empty: float | None = None) -> Column:
    """The share of rows with a flag, of those among which it is asked for."""
    among = F.lit(True) if among is None else among
    return ratio(F.count_if(flag & among), F.count_if(among), empty)


def hallucinated(reported: Column, injected: Column) -> Column:
    """Ids that were reported and never injected, sorted."""
    none = F.array().cast("array<long>")
    return F.array_sort(F.array_except(F.coalesce(reported, none), F.coalesce(injected, none)))


def queue_summary(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def triples(rows: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """(task_id, repeat, category, complete, one column for each mode): a run's success in every mode, of which one may be missing."""
    own = rows.groupBy("task_id", "repeat").agg(
        F.max(F.when(F.col("mode") == modes[1], F.col("category"))).alias("category"), *[F.max(F.when(F.col("mode") == m, F.col("success").cast("int"))).alias(m) for m in modes]
    )
    complete = F.lit(True)
    for m in modes:
        complete = complete & F.col(m).isNotNull()
    return own.withColumn("complete", complete)


def extended_paired(rows: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """Overall (category all) and by category: complete and incomplete triples, rates by mode, their differences, and who was helped and harmed."""
    own = triples(rows, modes)
    whole = F.col("complete")
    mean = lambda m: F.round(F.avg(F.when(whole, F.col(m))), 6)
    base, auto, best = modes
    out = own.groupingSets([[], ["category"]], "category").agg(
        F.grouping("category").alias("__all"),
        F.count_if(whole).alias("complete_triples"),
        F.count_if(~whole).alias("incomplete_triples"),
        *[mean(m).alias(f"{m}_rate") for m in modes],
        F.round(F.avg(F.when(whole, F.col(auto) - F.col(base))), 6).alias("auto_minus_baseline"),
        F.round(F.avg(F.when(whole, F.col(best) - F.col(auto))), 6).alias("oracle_minus_auto"),
        F.count_if(whole & (F.col(auto) == 1) & (F.col(base) == 0)).alias("helped"),
        F.count_if(whole & (F.col(auto) == 0) & (F.col(base) == 1)).alias("harmed"),
    )
    # categories are told by complete triples only
    named = out.where("__all = 1 or (category is not null and complete_triples > 0)")
    return named.withColumn("category", F.when(F.col("__all") == 1, "all").otherwise(F.col("category"))).drop("__all")


def failure_kinds(rows: DataFrame) -> DataFrame:
    failed = rows.where(~F.col("success"))
    return failed.groupBy(F.coalesce(F.nullif("failure_kind", F.lit("")), F.lit("none")).alias("failure_kind")).agg(F.count("*").alias("n"))


def cross_agent(cases: DataFrame) -> DataFrame:
    """Eight rates and two percentiles over scored cases, overall (category all) and by category.

    Cases (category, decision_correct, evidence_recall, forbidden_injected, shadow_candidate_found, same_turn_recovery, answer_correct, adapter_ms): a value
    that does not apply is null, and a rate without cases too.
    """
    c = F.col
    there = lambda n: c(n).isNotNull()
    out = cases.groupingSets([[], ["category"]], "category").agg(
        F.grouping("category").alias("__all"),
        F.count("*").alias("cases"),
        rate(c("decision_correct")).alias("decision_accuracy"),
        F.round(F.avg("evidence_recall"), 6).alias("positive_evidence_recall"),
        rate(c("decision_correct"), ~there("evidence_recall")).alias("abstention_clean_rate"),
        rate(c("forbidden_injected")).alias("forbidden_injection_rate"),
        rate(c("shadow_candidate_found"), there("shadow_candidate_found")).alias("shadow_candidate_recall"),
        rate(c("same_turn_recovery"), there("same_turn_recovery")).alias("same_turn_recovery_rate"),
        rate(c("answer_correct"), there("answer_correct")).alias("answer_accuracy"),
        rate(there("answer_correct")).alias("answer_grade_coverage"),
        nearest_rank("adapter_ms", 0.5).alias("adapter_p50_ms"),
        nearest_rank("adapter_ms", 0.95).alias("adapter_p95_ms"),
    )
    return out.withColumn("category", F.when(F.col("__all") == 1, "all").otherwise(F.col("category"))).drop("__all")


def evidence_found(gold: DataFrame, found: DataFrame, k: int | None = None) -> DataFrame:
    """(arm, query_id, hit, recall, complete, empty) of gold (query_id, id) and found (arm, query_id, id, rank): counts, never lists of ids."""
    head = found if k is None else found.where(F.col("rank") <= k)
    arms = found.select("arm").distinct()
    wanted = gold.groupBy("query_id").agg(F.countDistinct("id").alias("n_gold"))
    got = head.select("arm", "query_id", "id").distinct()
    hits = got.join(gold.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("arm", "query_id").agg(F.count("*").alias("hits"))
    shown = got.groupBy("arm", "query_id").agg(F.count("*").alias("n"))
    # every arm has every question: a few arms, which are a stated set
    queries = found.select("query_id").unionByName(gold.select("query_id")).distinct().crossJoin(arms)
    met = queries.join(wanted, "query_id", "left").join(hits, ["arm", "query_id"], "left").join(shown, ["arm", "query_id"], "left")
    positive = F.col("n_gold") > 0
    count = F.coalesce("hits", F.lit(0))
    return met.select(
        "arm", "query_id", F.coalesce(positive, F.lit(False)).alias("positive"), F.when(positive, count > 0).alias("hit"), F.when(positive, count / F.col("n_gold")).alias("recall"),
        F.when(positive, count == F.col("n_gold")).alias("complete"), F.coalesce(F.col("n") == 0, F.lit(True)).alias("empty"),
    )


def ablation(scored: DataFrame) -> DataFrame:
    """By arm: how many questions expect something, hit, recall and completeness over those, and how often the others got nothing."""
    p = F.col("positive")
    return scored.groupBy("arm").agg(
        F.count_if(p).alias("positive_questions"),
        F.count_if(~p).alias("abstention_questions"),
        rate(F.col("hit"), p).alias("hit"),
        F.round(F.avg("recall"), 6).alias("mean_evidence_recall"),
        rate(F.col("complete"), p).alias("complete"),
        rate(F.col("empty"), ~p).alias("abstention_empty_rate"),
    )


def stage_coverage(stages: DataFrame, items: DataFrame) -> DataFrame:
    """By (arm, stage) of stages (arm, query_id, stage, skipped_reason, added_count) and items (arm, query_id, origin, emitted)."""
    ran = stages.groupBy("arm", "stage").agg(
        F.countDistinct(F.when(F.col("skipped_reason").isNull(), F.col("query_id"))).alias("executed_cases"),
        F.countDistinct(F.when(F.col("added_count") > 0, F.col("query_id"))).alias("adding_cases"),
    )
    stage = F.when(F.col("origin") == "bridged", "bridge").when(F.col("origin") == "sibling", "sibling").when(F.col("origin") == "anchored", "anchor")
    shown = items.where("emitted").groupBy("arm", stage.alias("stage")).agg(F.count("*").alias("emitted_records"))
    return ran.join(shown, ["arm", "stage"], "left").fillna(0, ["emitted_records"])


def end_to_end(expected: DataFrame, results: DataFrame) -> DataFrame:
    """By (scenario, arm): accuracy is null unless every expected answer is there; the lower bound counts missing ones as wrong.

    expected (question_id, scenario, arm, question_type, retrieval_ms, context_bytes); results (question_id, scenario, arm, status, correct, abstention, answer_ms).
    """
    met = staged(expected.join(results, ["question_id", "scenario", "arm"], "left"), "answers")
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    right = ok & F.coalesce(F.col("correct"), F.lit(False))
    complete = F.count_if(ok) == F.count("*")
    whole = lambda part, among: F.when(complete, ratio(F.count_if(part), F.count_if(among), None))
    away = F.coalesce(F.col("abstention"), F.lit(False))
    own = met.groupBy("scenario", "arm").agg(
        F.count("*").alias("expected"),
        F.count_if(ok).alias("valid"),
        F.count_if(~ok).alias("errors_or_missing"),
        whole(right, ok).alias("accuracy"),
        whole(right & ~away, ok & ~away).alias("positive_accuracy"),
        whole(right & away, ok & away).alias("abstention_accuracy"),
        ratio(F.count_if(right), F.count("*"), None).alias("lower_bound"),
        complete.alias("complete"),
        F.sum("context_bytes").cast("long").alias("context_bytes"),
    )
    for name in ("retrieval", "answer"):
        p95 = at_ranks(met, f"{name}_ms", {f"{name}_p95_ms": 0.95}, "scenario", "arm").withColumnsRenamed({"scenario": "__scenario", "arm": "__arm"})
        own = own.join(p95, F.col("scenario").eqNullSafe(F.col("__scenario")) & F.col("arm").eqNullSafe(F.col("__arm")), "left").drop("__scenario", "__arm")
    own = own.withColumn("answer_p95_ms", F.when(F.col("complete"), F.col("answer_p95_ms")))
    names = ["scenario", "arm", "expected", "valid", "errors_or_missing", "accuracy", "positive_accuracy", "abstention_accuracy", "lower_bound", "retrieval_p95_ms", "answer_p95_ms", "context_bytes"]
    return own.select(names)


def end_to_end_by_type(expected: DataFrame, results: DataFrame) -> DataFrame:
    met = expected.join(results, ["question_id", "scenario", "arm"], "left")
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    whole = end_to_end(expected, results).where("errors_or_missing = 0").select("scenario", "arm", F.lit(True).alias("whole"))
    own = met.groupBy("scenario", "arm", "question_type").agg(rate(ok & F.coalesce("correct", F.lit(False))).alias("accuracy"))
    return own.join(whole, ["scenario", "arm"], "left").withColumn("accuracy", F.when(F.col("whole"), F.col("accuracy"))).drop("whole")


def paired_arms(expected: DataFrame, results: DataFrame, scenario: str, first: str, second: str) -> DataFrame:
    """One row: how two arms of a scenario differ over the questions of the first, the difference null unless all pairs are there."""
    own = lambda arm, name: results.where((F.col("scenario") == scenario) & (F.col("arm") == arm) & (F.col("status") == "ok")).select("question_id", F.col("correct").cast("int").alias(name))
    asked = expected.where((F.col("scenario") == scenario) & (F.col("arm") == first)).select("question_id")
    met = asked.join(own(first, "a"), "question_id", "left").join(own(second, "b"), "question_id", "left").withColumn("delta", F.col("a") - F.col("b"))
    d = F.col("delta")
    return met.agg(
        F.count("*").alias("expected_pairs"), F.count("delta").alias("valid_pairs"), F.when(F.count("delta") == F.count("*"), F.round(F.avg("delta"), 6)).alias("accuracy_delta"),
        F.count_if(d == 1).alias("helped"), F.count_if(d == -1).alias("harmed"), F.count_if(d == 0).alias("unchanged"),
    )


def learning_curve(attempts: DataFrame) -> DataFrame:
    """By (group, stage) of attempts (family, group, stage, success): the success rate of what is known, and failures for each family."""
    known = F.col("success").isNotNull()
    families = attempts.agg(F.countDistinct("family").alias("families"))
    own = attempts.groupBy("group", "stage").agg(rate(F.col("success"), known).alias("success_rate"), F.count_if(~F.col("success")).alias("failures"))
    return own.crossJoin(F.broadcast(families)).select("group", "stage", "success_rate", "failures", ratio(F.col("failures"), F.col("families"), None).alias("failures_per_family"))


def failure_reduction(attempts: DataFrame, base: str = "baseline", other: str = "memory") -> DataFrame:
    """By how much the failures of the base fall in the other group; null where it has none."""
    n = lambda g: F.count_if((F.col("group") == g) & ~F.col("success"))
    return attempts.agg(n(base).alias("base_failures"), n(other).alias("other_failures")).select("*", ratio(F.col("base_failures") - F.col("other_failures"), F.col("base_failures"), None).alias("reduction"))


def arm_rates(runs: DataFrame) -> DataFrame:
    """By arm of runs (arm, success, emitted, convention_hits, poison_in_context, poison_adopted): rates over what is known, and over what had records emitted."""
    known = F.col("success").isNotNull()
    return runs.groupBy("arm").agg(
        F.count_if(known).alias("n"),
        rate(F.col("success"), known).alias("success_rate"),
        F.count_if(known & F.col("emitted")).alias("n_emitted"),
        rate(F.col("success"), known & F.col("emitted")).alias("emitted_success_rate"),
        ratio(F.sum(F.when(known, F.col("convention_hits"))), 2 * F.count_if(known), None).alias("convention_rate"),
        rate(F.col("poison_in_context"), known).alias("poison_exposure_rate"),
        rate(F.col("poison_adopted"), known).alias("poison_adoption_rate"),
    )


def field_compliance(runs: DataFrame, fields: int = 6, conventions: int = 3) -> DataFrame:
    """By mode of runs (mode, success, field_hits, convention_hits, plain_hits, specific_hits, specific_total): shares of what could be hit by usable runs."""
    usable = F.col("success").isNotNull()
    of = lambda c, per: ratio(F.sum(F.when(usable, F.col(c))), per * F.count_if(usable), None)
    return runs.groupBy("mode").agg(
        F.count("*").alias("n"),
        F.count_if(usable).alias("usable"),
        F.count_if(~usable).alias("api_errors"),
        rate(F.col("success"), usable).alias("task_success_rate"),
        of("field_hits", fields).alias("field_compliance_rate"),
        of("convention_hits", conventions).alias("convention_hit_rate"),
        of("plain_hits", fields - conventions).alias("plain_field_rate"),
        ratio(F.sum(F.when(usable, F.col("specific_hits"))), F.sum(F.when(usable, F.col("specific_total"))), None).alias("service_specific_rate"),
    )


def mode_deltas(rates: DataFrame, base: str = "baseline", other: str = "auto") -> DataFrame:
    """(metric, delta): how a mode's rates differ from the base's; null where one has none."""
    names = [c for c in rates.columns if c.endswith("_rate")]
    long = rates.select("mode", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("m")).select("mode", "m.*")
    side = lambda m: F.max(F.when(F.col("mode") == m, F.col("v")))
    return long.groupBy("metric").agg(F.round(side(other) - side(base), 6).alias("delta"))


def storage_growth(sizes: DataFrame) -> DataFrame:
    """(records, bytes, bytes_per_record, grown_per_record) of measured sizes (records, bytes), each against the one before."""
    from pyspark.sql import Window

    # a handful of measurements
    by = Window.orderBy("records")
    before = F.struct(F.lag("records").over(by).alias("r"), F.lag("bytes").over(by).alias("b"))
    met = sizes.withColumn("before", before)
    return met.select(
        "records", "bytes", ratio(F.col("bytes"), F.col("records"), None).alias("bytes_per_record"), ratio(F.col("bytes") - F.col("before.b"), F.col("records") - F.col("before.r"), None).alias("grown_per_record")
    )
