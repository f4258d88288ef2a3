"""Quality of retrieval and of paired runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import nearest_rank, ratio


def case_results(cases: DataFrame, retrieved: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, ..., n_gold, n_got, hits, first_hit) of cases: how many records a query expects, got among its first k, and had right, and at which place first.

    Counts by query, so that a query may expect any number of records.
    """
    wanted = gold.select("query_id", "id").distinct()
    got = retrieved.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("n_got"))
    right = retrieved.join(wanted, ["query_id", "id"]).groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first_hit"))
    n = wanted.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    met = cases.join(got, "query_id", "left").join(right, "query_id", "left").join(n, "query_id", "left")
    return met.fillna(0, ["n_got", "hits", "n_gold"])


def judged(results: DataFrame, k: int) -> DataFrame:
    """Each case with its precision at k (of k places), recall, reciprocal rank of the first hit."""
    return results.withColumns(
        {
            "positive": F.col("n_gold") > 0,
            "precision": F.col("hits") / F.lit(float(k)),
            "recall": F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("n_gold").cast("double")), F.lit(0.0)),
            "rr": F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)),
            "injected": F.col("n_got") > 0,
        }
    )


def retrieval_metrics(results: DataFrame, k: int = 3, *by: str) -> DataFrame:
    """Averages over cases that expect something; how often cases that expect nothing got anything."""
    j = judged(results, k)
    on = lambda c: F.when(F.col("positive"), F.col(c))
    return j.groupBy(*by).agg(
        F.count_if("positive").alias("positives"),
        F.count_if(~F.col("positive")).alias("negatives"),
        F.round(F.avg(on("precision")), 6).alias("precision_at_k"),
        F.round(F.avg(on("recall")), 6).alias("recall_at_k"),
        F.round(F.avg(on("rr")), 6).alias("mrr"),
        ratio(F.count_if(~F.col("positive") & F.col("injected")), F.count_if(~F.col("positive")), None).alias("negative_injection"),
    )


def quality_block(results: DataFrame, k: int, category: str) -> DataFrame:
    """hit@1, hit@k, recall and MRR overall and by category: grouping sets, one pass."""
    j = judged(results, k).where("positive").withColumns({"first": F.coalesce(F.col("first_hit") == 1, F.lit(False)), "any": F.col("hits") > 0})
    return j.groupingSets([[], [category]], category).agg(
        F.count("*").alias("cases"),
        ratio(F.count_if("first"), F.count("*")).alias("hit_1"),
        ratio(F.count_if("any"), F.count("*")).alias("hit_k"),
        F.round(F.avg("recall"), 6).alias("mean_recall"),
        F.round(F.avg("rr"), 6).alias("mrr"),
    ).withColumn(category, F.coalesce(category, F.lit("all")))


def paired_modes(rows: DataFrame, modes: tuple[str, ...] = ("baseline", "auto")) -> DataFrame:
    """Success by (task, repeat) in each mode, complete pairs only; helped and harmed compare the second with the first."""
    wide = rows.groupBy("task_id", "repeat").pivot("mode", list(modes)).agg(F.max(F.col("success").cast("int")))
    a, b = modes[0], modes[1]
    full = wide.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return full.agg(
        F.count("*").alias("pairs"),
        F.round(F.avg(a), 6).alias(f"{a}_rate"),
        F.round(F.avg(b), 6).alias(f"{b}_rate"),
        F.round(F.avg(F.col(b) - F.col(a)), 6).alias("delta"),
        F.count_if((F.col(b) == 1) & (F.col(a) == 0)).alias("helped"),
        F.count_if((F.col(b) == 0) & (F.col(a) == 1)).alias("harmed"),
    )


def arm_changes(judged_arms: DataFrame, base: str, other: str) -> DataFrame:
    """(query_id, change) of (query_id, arm, complete) between two arms."""
    a = judged_arms.where(F.col("arm") == base).select("query_id", F.col("complete").alias("before"))
    b = judged_arms.where(F.col("arm") == other).select("query_id", F.col("complete").alias("after"))
    return a.join(b, "query_id").where("before <> after").select("query_id", F.when(F.col("after"), "helped").otherwise("harmed").alias("change"))


def stratified_sample(rows: DataFrame, strata: list[str], seed: str, size: int) -> DataFrame:
    """A fixed sample, round-robin over strata: the first of each stratum by hash, then the second of each."""
    hashed = rows.withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256))
    turn = hashed.withColumn("turn", F.row_number().over(Window.partitionBy(*strata).orderBy("h", "id")))
    # no stratum gives more than the whole sample, which bounds what the last ordering sees
    return turn.where(F.col("turn") <= size).orderBy("turn", *strata).limit(size).drop("h")


def unanswered_left_join(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Missing predictions are wrong answers, never abstentions."""
    met = gold.join(predictions.withColumn("found", F.lit(True)), "query_id", "left")
    return met.withColumn("found", F.coalesce("found", F.lit(False)))


def naive_vs_gated(arms: DataFrame) -> DataFrame:
    """By arm of (arm, query_id, id, relevant, bytes): recall of evidence and what was injected without need."""
    return arms.groupBy("arm").agg(
        F.count("*").alias("injected"),
        F.count_if("relevant").alias("relevant"),
        F.count_if(~F.col("relevant")).alias("unnecessary"),
        F.coalesce(F.sum(F.when(~F.col("relevant"), F.col("bytes"))), F.lit(0)).cast("long").alias("unnecessary_bytes"),
    )


def distribution(rows: DataFrame, outcome: str) -> DataFrame:
    total = rows.agg(F.count("*").alias("total"))
    return rows.groupBy(outcome).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(outcome, "n", ratio(F.col("n"), F.col("total")).alias("share"))


def timing(rows: DataFrame, column: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(nearest_rank(column, 0.5).alias("p50"), nearest_rank(column, 0.95).alias("p95"))


def levels(rows: DataFrame, keys: list[str], flag: Column, name: str) -> DataFrame:
    """Counts over all rows, by the first key, by the first two, and so on; ``level`` is how many keys a row sums over."""
    level = sum((F.grouping(k).cast("long") for k in keys), F.lit(0).cast("long"))
    return rows.rollup(*keys).agg(level.alias("level"), F.count("*").alias("n"), F.count_if(flag).alias(name))
