"""Metrics of learning, recall, reuse and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged


def nearest_rank(column: str, p: float) -> Column:
    """The value at place ceil(n * p) of the sorted column; nulls are passed over."""
    return F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})"), 3)


def at_place(rows: DataFrame, column: str, p: float, shift: float, *by: str) -> DataFrame:
    """(by, x): the value at a truncated place, int(n * p + shift) - 1 from 0, as older reports have it.

    Values are counted first; places are sums of counts, so that a group is one row for each value that it has, in whatever task.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("x")).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("x")))
    place = F.greatest(F.lit(1), F.floor(F.col("total") * p + shift))
    met = upto.join(total, list(by)) if by else upto.crossJoin(total)
    return met.where((F.col("upto") - F.col("n") < place) & (place <= F.col("upto"))).select(*by, "x")


#: Ranges that the values of a group are cut into, to find the one that holds a place.
RANGES = 4096


def at_ranks(rows: DataFrame, column: str, places: dict[str, float], *by: str) -> DataFrame:
    """(by, names of ``places``): what ``nearest_rank`` gives, by counts in place of a buffer that holds all values of a group.

    Values are counted once. The counts of a group's equal ranges tell which range holds the place; only the values of that range are put in order.
    """
    counts = staged(rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("x")).agg(F.count("*").alias("n")), "values")
    same = lambda df, names: df.select(*[F.col(c).alias(f"__{c}") if c in names else F.col(c) for c in df.columns])
    met = lambda left, right, names: left.join(F.broadcast(same(right, names)), _same(names)).drop(*[f"__{c}" for c in names])
    bounds = counts.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("total"))
    part = F.coalesce(F.try_divide((F.col("x") - F.col("lo")).cast("double") * RANGES, (F.col("hi") - F.col("lo")).cast("double")), F.lit(0.0))
    cut = met(counts, bounds, by).withColumn("range", F.least(F.floor(part).cast("int"), F.lit(RANGES - 1)))
    sums = staged(cut.groupBy(*by, "range", "total").agg(F.sum("n").alias("m")), "ranges")
    upto = sums.withColumn("upto", F.sum("m").over(Window.partitionBy(*by).orderBy("range")))
    out = bounds.select(*by, "total")
    for name, p in places.items():
        place = F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(p)))
        held = upto.withColumn("place", place).where((F.col("upto") - F.col("m") < F.col("place")) & (F.col("place") <= F.col("upto")))
        held = held.select(*by, "range", "place", (F.col("upto") - F.col("m")).alias("before"))
        own = met(cut.select(*by, "range", "x", "n"), held, (*by, "range"))
        ranked = own.withColumn("at", F.col("before") + F.sum("n").over(Window.partitionBy(*by).orderBy("x")))
        found = ranked.where((F.col("at") - F.col("n") < F.col("place")) & (F.col("place") <= F.col("at"))).select(*by, F.round("x", 3).alias(name))
        out = out.join(F.broadcast(same(found, by)), _same(by), "left").drop(*[f"__{c}" for c in by])
    return out.drop("total")


def _same(names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return out


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part / whole; ``empty`` (null or 0.0: reports differ) where there is nothing to divide by."""
    out = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.round(out if empty is None else F.coalesce(out, F.lit(empty)), 6)


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(
        F.count("*").alias("n"), F.sum("verified_count").cast("long").alias("verified"), F.sum("rejected_count").cast("long").alias("rejected")
    )


def projects(records: DataFrame) -> DataFrame:
    """(project_key, n, last_updated): all projects, the one that changed last first."""
    own = records.groupBy("project_key").agg(F.count("*").alias("n"), F.max("updated_at").alias("last_updated"))
    return own.orderBy(F.desc("last_updated"), "project_key")


def run_metrics(runs: DataFrame, *by: str) -> DataFrame:
    done = F.col("status") == "completed"
    return runs.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("completed"),
        F.sum("proposal_count").cast("long").alias("proposals"),
        F.sum("promoted_count").cast("long").alias("promoted"),
        F.round(F.avg(F.when(done, F.col("latency_ms"))), 3).alias("avg_latency_ms"),
    )


def recall_metrics(recalls: DataFrame, *by: str) -> DataFrame:
    return recalls.groupBy(*by).agg(
        F.count("*").alias("attempts"),
        F.count_if("hit").alias("hits"),
        ratio(F.count_if("hit"), F.count("*")).alias("hit_rate"),
        F.count("successful_validation").alias("evaluated"),
        F.count_if("successful_validation").alias("successes"),
        F.round(F.avg("latency_ms"), 3).alias("avg_latency_ms"),
    )


def timing_metrics(samples: DataFrame, *by: str) -> DataFrame:
    return samples.groupBy(*by).agg(
        F.count("latency_ms").alias("samples"), nearest_rank("latency_ms", 0.5).alias("p50"), nearest_rank("latency_ms", 0.95).alias("p95")
    )


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key, reduced by task before it is exchanged."""
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(rest, order).alias("r")).select(*keys, "r.*")


def latency_pairs(samples: DataFrame) -> DataFrame:
    """(experiment, pair, on, off): pairs that have both arms, one sample for each."""
    arms = samples.groupBy("experiment", "pair", "mode").agg(F.min("ttft_ms").alias("ttft_ms"), F.min("total_ms").alias("total_ms"))
    on = arms.where("mode = 'on'").select("experiment", "pair", F.col("ttft_ms").alias("on_ttft"), F.col("total_ms").alias("on_total"))
    off = arms.where("mode = 'off'").select("experiment", "pair", F.col("ttft_ms").alias("off_ttft"), F.col("total_ms").alias("off_total"))
    return on.join(off, ["experiment", "pair"])


def latency_deltas(pairs: DataFrame, *by: str, least: int = 20) -> DataFrame:
    """Percentiles of the deltas, which are not deltas of percentiles."""
    d = pairs.withColumn("delta", F.col("on_ttft") - F.col("off_ttft"))
    return d.groupBy(*by).agg(
        F.count("*").alias("pairs"), nearest_rank("delta", 0.5).alias("p50_delta"), nearest_rank("delta", 0.95).alias("p95_delta"), (F.count("*") < least).alias("limited_sample")
    )


TRACE_FIELDS = {"agent_id": "string", "completed_at": "timestamp", "retrieval_ms": "double", "task_success": "boolean"}
ITEM_FIELDS = {
    "knowledge_id": "long", "source_agent": "string", "origin": "string", "emitted": "boolean", "citation_observed": "boolean", "source_attribution_observed": "boolean",
    "check_status": "string", "lfhv_recovery_outcome": "string",
}


def reuse_metrics(traces: DataFrame, *by: str) -> DataFrame:
    """Counters over traces and their items: by origin, what was emitted, cited and attributed, across agents, checks, and retrieval times.

    A turn counts once whatever it shows; an item without an origin is direct. Fields that a trace or an item does not have are unknown.
    """
    has = {f.name for f in traces.schema["items"].dataType.elementType.fields}
    own = traces.withColumns({n: F.lit(None).cast(t) for n, t in TRACE_FIELDS.items() if n not in traces.columns})
    fields = [(F.col(f"i.{n}") if n in has else F.lit(None)).cast(t).alias(n) for n, t in ITEM_FIELDS.items()]
    items = own.select(*by, "id", *TRACE_FIELDS, F.explode_outer("items").alias("i")).select(*by, "id", *TRACE_FIELDS, F.col("i").isNotNull().alias("there"), *fields)
    items = staged(items, "items")
    c = F.col
    yes = lambda n: F.coalesce(c(n), F.lit(False))
    origin = F.coalesce(c("origin"), F.lit("direct"))
    emitted, cited, shown = yes("emitted"), yes("emitted") & yes("citation_observed"), yes("emitted") & yes("source_attribution_observed")
    recovered = c("there") & (origin == "lfhv_recovered")
    cross = emitted & (c("agent_id") != c("source_agent"))
    done = cross & c("completed_at").isNotNull()
    checked = emitted & F.coalesce(c("check_status").isin("constraint_pass", "constraint_fail"), F.lit(False))
    passed = emitted & F.coalesce(c("check_status") == "constraint_pass", F.lit(False))
    of = lambda name: F.count_if(c("there") & (origin == name))
    counts = {
        "retrieved": F.count_if("there"),
        "emitted": F.count_if(emitted),
        "direct": of("direct"),
        "inferred": of("sibling"),
        "bridged": of("bridged"),
        "anchored": of("anchored"),
        "recovery_candidates": F.count_if(recovered),
        "recovery_emitted": F.count_if(recovered & emitted),
        "recovery_restored": F.count_if(recovered & F.coalesce(c("lfhv_recovery_outcome") == "restored", F.lit(False))),
        "recovery_not_emitted": F.count_if(recovered & ~emitted),
        "cited": F.count_if(cited),
        "checked": F.count_if(checked),
        "cross_agent_checked": F.count_if(checked & cross),
        "constraint_pass": F.count_if(passed),
        "cross_agent_constraint_pass": F.count_if(passed & cross),
    }
    turns = {
        "turns": F.lit(True),
        "turns_emitted": emitted,
        "turns_cited": cited,
        "turns_attributed": shown,
        "turns_shown": cited | shown,
        "turns_successful": emitted & yes("task_success"),
        "cross_agent_turns_emitted": cross,
        "cross_agent_turns_cited": done & cited,
        "cross_agent_turns_attributed": done & shown,
        "cross_agent_turns_shown": done & (cited | shown),
    }
    # by turn first: distinct counts side by side would multiply every item by their number
    by_turn = items.groupBy(*by, "id").agg(*[x.alias(n) for n, x in counts.items()], *[F.bool_or(F.coalesce(x, F.lit(False))).alias(n) for n, x in turns.items()])
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts] + [F.count_if(c(n) & c("id").isNotNull()).alias(n) for n in turns]
    records = items.where(emitted & c("knowledge_id").isNotNull()).select(*by, "knowledge_id").distinct().groupBy(*by).agg(F.count("*").alias("records_emitted"))
    times = at_ranks(own, "retrieval_ms", {"retrieval_p50_ms": 0.5, "retrieval_p95_ms": 0.95}, *by)
    out = by_turn.groupBy(*by).agg(*sums)
    # groups are few; a group may be null, and may have no records or times
    for more in (records, times):
        renamed = more.withColumnsRenamed({n: f"__{n}" for n in by})
        out = out.join(renamed, _same(by), "left").drop(*[f"__{n}" for n in by])
    first = ["turns", "retrieved", "emitted", "direct", "inferred", "bridged", "anchored", "recovery_candidates", "recovery_emitted", "recovery_restored", "recovery_not_emitted", "cited"]
    first += ["turns_emitted", "turns_cited", "turns_attributed", "turns_shown", "turns_successful", "records_emitted"]
    first += ["cross_agent_turns_emitted", "cross_agent_turns_cited", "cross_agent_turns_attributed", "cross_agent_turns_shown"]
    first += ["checked", "cross_agent_checked", "constraint_pass", "cross_agent_constraint_pass", "retrieval_p50_ms", "retrieval_p95_ms"]
    return out.fillna(0, ["records_emitted"]).select(*by, *first)


def latest_experiment(pairs: DataFrame) -> DataFrame:
    """The pairs (experiment, created_at, ...) of the newest experiment only."""
    newest = pairs.agg(F.max_by("experiment", F.struct("created_at", "experiment")).alias("experiment"))
    return pairs.join(newest, "experiment", "left_semi")


def overview(records: DataFrame) -> DataFrame:
    """By project: what is available, confirmed and retrievable, and how many agents it came from."""
    serving = F.col("status").isin("active", "stale")
    return records.groupBy("project_key").agg(
        F.count("*").alias("available"),
        F.count_if(F.col("verified_count") > 0).alias("confirmed"),
        F.count_if(serving).alias("retrievable"),
        F.count_if(serving & (F.col("scope") == "user")).alias("shared"),
        F.countDistinct("source_agent").alias("source_agents"),
    )


def experience_metrics(outcomes: DataFrame, records: DataFrame) -> DataFrame:
    met = records.join(outcomes, "knowledge_id")
    return met.agg(
        F.countDistinct("knowledge_id").alias("experiences"),
        F.coalesce(F.sum("passed"), F.lit(0)).cast("long").alias("passed"),
        F.coalesce(F.sum("failed"), F.lit(0)).cast("long").alias("failed"),
        F.count_if(F.col("failed") > 0).alias("with_failures"),
    )


def failure_then_pass(attempts: DataFrame) -> DataFrame:
    """By (session, command): the last known outcome and the failures before it; unknown outcomes are passed over."""
    known = attempts.where("success is not null")
    own = known.groupBy("session_id", "command").agg(F.max_by("success", F.struct("created_at", "id")).alias("passed"), F.count_if(~F.col("success")).alias("failures"))
    return own.withColumn("recovered", F.col("passed") & (F.col("failures") > 0))


def reranked(rows: DataFrame) -> DataFrame:
    """Rows of one group trade their places by Laplace score; places of other groups stay."""
    score = (F.col("passed") + 1) / (F.col("passed") + F.col("failed") + 2)
    by_place = Window.partitionBy("query_id", "group_id").orderBy("position")
    by_score = Window.partitionBy("query_id", "group_id").orderBy(F.desc("laplace"), "position")
    own = rows.withColumn("laplace", F.round(score, 6)).withColumn("slot", F.row_number().over(by_place)).withColumn("place", F.row_number().over(by_score))
    slots = own.select("query_id", "group_id", F.col("slot").alias("place"), F.col("position").alias("new_position"))
    return own.drop("slot").join(slots, ["query_id", "group_id", "place"]).drop("place")


def lfhv_report(probes: DataFrame, records: DataFrame) -> DataFrame:
    """How often a probe found a retired record that it should have had, and how many retired records were missed.

    Rates are null where there was nothing to judge.
    """
    by_query = probes.agg(F.countDistinct("query_id").alias("probed"), F.countDistinct(F.when(F.col("retired_hit"), F.col("query_id"))).alias("missed"))
    retired = records.where("status = 'archived'").select("id").distinct()
    hit = probes.where("retired_hit").select("id").distinct()
    kills = retired.join(hit.withColumn("hit", F.lit(1)), "id", "left").agg(F.count("*").alias("archived"), F.count("hit").alias("false_kills"))
    met = by_query.crossJoin(kills)
    return met.select("probed", "missed", "archived", "false_kills", ratio(F.col("missed"), F.col("probed"), None).alias("miss_rate"), ratio(F.col("false_kills"), F.col("archived"), None).alias("false_kill_rate"))
