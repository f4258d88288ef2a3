"""Lifecycle of records: publication, review outcomes, ageing, capacity, transitions. Every change is a plan relation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..schemas import KNOWLEDGE_TYPES, LIMITS, SCOPES, STATUSES, with_defaults

STALE_DAYS, ARCHIVE_DAYS, CAPACITY, FLOOR, REVIEW_DAYS, AUDIT_ROWS = 30, 90, 200, 5, 1, 50
OBJECTIVE = ("test", "command", "user_approval", "artifact")


def numbered(rows: DataFrame, keys: list, order: list, name: str = "n") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


#: The order in which records are given up: what is confirmed stays longest, then what is served, then what is used.
GIVEN_UP = ("verified_count", "hit_count", "adopted_count", "updated_at")


def first_of(rows: DataFrame, keys: list[str], leading: list[Column], order: list, quota: DataFrame, name: str = "n") -> DataFrame:
    """The first rows of each key by ``leading`` and then ``order``, as many as ``quota`` (keys, quota) says, with their rank.

    Rows are counted by key and leading values; what the counts decide needs no sort. Only rows of equal leading values are ranked among each other,
    so that a key with a third of all rows is ranked in many tasks.
    """
    names = [f"__l{i}" for i in range(len(leading))]
    own = rows.withColumns(dict(zip(names, leading)))
    counts = own.groupBy(*keys, *names).agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.withColumn("__before", F.coalesce(before, F.lit(0))).join(quota, keys).where("__before < quota").drop("__size")
    of = {c: f"__of_{c}" for c in (*keys, *names)}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in of.items()]
    met = own.join(placed.withColumnsRenamed(of), _all(same)).drop(*of.values())
    ranked = met.withColumn(name, (F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order)) + F.col("__before")).cast("long"))
    return ranked.where(F.col(name) <= F.col("quota")).drop(*names, "__before", "quota")


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def with_counters(records: DataFrame) -> DataFrame:
    """Records with all that the order of giving up reads; a counter that is not there is 0, and the last change is the creation."""
    neutral = {"verified_count": F.lit(0).cast("long"), "hit_count": F.lit(0).cast("long"), "adopted_count": F.lit(0).cast("long"), "updated_at": F.col("created_at")}
    return records.withColumns({n: c for n, c in neutral.items() if n not in records.columns})


def publish(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, duplicate evidence): of equal requests the earliest becomes a record, the others confirm it."""
    own = content_hash(F.col("project_key"), F.col("scope"), F.col("knowledge_type"), F.col("title"), F.col("content"))
    ranked = numbered(requests.withColumn("content_hash", own), ["content_hash"], ["created_at", "id"])
    first = ranked.where("n = 1").drop("n")
    again = ranked.where("n > 1").select("content_hash", F.col("id").alias("request_id"), "source_agent", F.lit("confirmed_duplicate").alias("outcome"))
    return first, again.join(first.select("content_hash", F.col("id").alias("knowledge_id")), "content_hash")


def body_duplicates(requests: DataFrame, records: DataFrame) -> DataFrame:
    """(request_id, knowledge_id): the earliest open candidate with the same body, project, scope, type and speaker."""
    keys = ["project_key", "scope", "knowledge_type", "source_agent", "content"]
    open_ = records.where("status = 'candidate'").groupBy(*keys).agg(F.min_by("id", F.struct("created_at", "id")).alias("knowledge_id"))
    return requests.join(open_, keys).where("id <> knowledge_id").select(F.col("id").alias("request_id"), "knowledge_id")


def merge_plan(records: DataFrame) -> DataFrame:
    """(candidate_id, target_id): candidates whose body a serving record of the same project, scope and type has already."""
    keys = ["project_key", "scope", "knowledge_type", "content"]
    serving = records.where("status in ('active', 'stale')").groupBy(*keys).agg(F.min("id").alias("target_id"))
    return records.where("status = 'candidate'").join(serving, keys).select(F.col("id").alias("candidate_id"), "target_id")


def confidence(verified: Column, rejected: Column) -> Column:
    """round(verified / (verified + rejected), 3), and 0 without any outcome."""
    return F.round(F.coalesce(F.try_divide(verified.cast("double"), verified + rejected), F.lit(0.0)), 3)


def last_confirmed(records: DataFrame, evidence: DataFrame) -> DataFrame:
    last = evidence.where("outcome in ('used', 'verified')").groupBy(F.col("knowledge_id").alias("id")).agg(F.max("created_at").alias("last_confirmed_at"))
    return records.join(last, "id", "left")


def idle_days(as_of: Column, *stamps: Column) -> Column:
    """Days since the last of the stamps; nulls are passed over."""
    last = F.greatest(*stamps) if len(stamps) > 1 else stamps[0]
    return (F.unix_micros(as_of) - F.unix_micros(last)) / F.lit(86_400e6)


def sweep_plan(records: DataFrame, as_of: str, capacity: int = CAPACITY, floor: int = FLOOR) -> DataFrame:
    """(id, from_status, to_status, reason): ageing in up to two steps, expired candidates, and the weakest over capacity.

    Capacity is per project and counts all active records; records that age already are not replaced by stronger ones.
    """
    now = F.lit(as_of).cast("timestamp")
    days = idle_days(now, F.col("created_at"), F.col("last_confirmed_at"))
    aged = records.withColumn("days", days).withColumn("over", F.lit(False))
    over = evictions(records, capacity, floor)
    rows = aged.drop("over").join(over.select("id", F.lit(True).alias("over")), "id", "left")
    expired = (F.col("status") == "candidate") & (F.col("created_at") + F.expr(f"INTERVAL {REVIEW_DAYS} DAYS") <= now)
    to = (
        F.when(F.col("status").isin("active", "stale") & (F.col("days") >= ARCHIVE_DAYS), "archived")
        .when((F.col("status") == "active") & (F.col("days") >= STALE_DAYS), "stale")
        .when((F.col("status") == "active") & F.col("over"), "stale")
        .when(expired, "quarantined")
    )
    why = (
        F.when(F.col("status") == "candidate", "review_deadline")
        .when(F.col("days") >= ARCHIVE_DAYS, "idle_archive")
        .when(F.col("days") >= STALE_DAYS, "idle_stale")
        .otherwise("capacity")
    )
    return rows.withColumn("to_status", to).where("to_status is not null").select("id", "project_key", F.col("status").alias("from_status"), "to_status", why.alias("reason"))


def evictions(records: DataFrame, capacity: int, floor: int) -> DataFrame:
    """The weakest active records of each project beyond its capacity, never below the floor; ties by the last change, then the id."""
    active = with_counters(records.where("status = 'active'"))
    sizes = active.groupBy("project_key").agg(F.count("*").alias("n_active"))
    quota = sizes.withColumn("quota", F.least(F.col("n_active") - capacity, F.col("n_active") - floor)).where("quota > 0")
    leading = [F.col(c) for c in GIVEN_UP[:-1]] + [F.to_date(GIVEN_UP[-1])]
    weakest = first_of(active, ["project_key"], leading, [GIVEN_UP[-1], "id"], quota.select("project_key", "quota"), "weakness")
    return weakest.join(sizes, "project_key")


def oldest_half(records: DataFrame) -> DataFrame:
    """The older half of each project's records, with their rank."""
    quota = records.groupBy("project_key").agg(F.floor(F.count("*") / 2).alias("quota")).where("quota > 0")
    return first_of(records, ["project_key"], [F.to_date("created_at")], ["created_at", "id"], quota)


def expired(records: DataFrame, as_of: str) -> DataFrame:
    return records.where((F.col("status") == "candidate") & (F.col("created_at") + F.expr(f"INTERVAL {REVIEW_DAYS} DAYS") <= F.lit(as_of).cast("timestamp")))


def prune(rows: DataFrame, keys: list, order: list, keep: int = AUDIT_ROWS) -> DataFrame:
    return numbered(rows, keys, order).where(F.col("n") <= keep)


def transitions(records: DataFrame, requested: DataFrame) -> DataFrame:
    """Compare-and-set: (id, expected_status, to_status, applied, conflict); a request applies if the state is as expected."""
    met = requested.join(records.select("id", "status"), "id", "left")
    applied = F.coalesce(F.col("status") == F.col("expected_status"), F.lit(False))
    return met.withColumn("applied", applied).withColumn("conflict", F.when(F.col("status").isNull(), "missing").when(~applied, "status_changed"))


def apply_transitions(records: DataFrame, plan: DataFrame) -> DataFrame:
    """The next snapshot: records whose transition applied have their new state."""
    done = plan.where("applied").select("id", "to_status")
    return records.join(done, "id", "left").withColumn("status", F.coalesce("to_status", "status")).drop("to_status")


def apply_hits(records: DataFrame, emitted: DataFrame) -> DataFrame:
    hits = emitted.groupBy("id").agg(F.count("*").alias("hits"), F.max("emitted_at").alias("hit_at"))
    return records.join(hits, "id", "left").select(
        *[c for c in records.columns if c not in ("hit_count", "last_hit_at")],
        (F.col("hit_count") + F.coalesce("hits", F.lit(0))).alias("hit_count") if "hit_count" in records.columns else F.coalesce("hits", F.lit(0)).alias("hit_count"),
        F.greatest("hit_at", "last_hit_at").alias("last_hit_at") if "last_hit_at" in records.columns else F.col("hit_at").alias("last_hit_at"),
    )


def remove(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids, "id", "left_anti")


def feedback(records: DataFrame, feed: DataFrame) -> DataFrame:
    """The snapshot after an ordered change feed (id, seq, outcome, evidence_kind, has_ref).

    Counters are sums. Of the outcomes with objective evidence and a reference, which alone change a state, three facts decide it, however many there are: when the record
    was last rejected, when a user last approved it, and whether it was verified at all. Of equal seq, an approval comes after a rejection.
    """
    sound = F.col("evidence_kind").isin(*OBJECTIVE) & F.coalesce(F.col("has_ref"), F.lit(False))
    verified, rejected = F.col("outcome") == "verified", F.col("outcome") == "rejected"
    own = feed.groupBy("id").agg(
        F.count_if(F.col("outcome").isin("used", "verified")).alias("adopted"),
        F.count_if(verified).alias("verified"),
        F.count_if(rejected).alias("rejected"),
        F.max(F.when(rejected & sound, F.col("seq"))).alias("last_rejected"),
        F.max(F.when(verified & sound & (F.col("evidence_kind") == "user_approval"), F.col("seq"))).alias("last_approved"),
        F.count_if(verified & sound).alias("n_sound"),
    )
    met = records.join(own, "id", "left")
    approved = F.col("last_approved").isNotNull()
    open_ = F.col("status").isin("candidate", "active", "stale")
    status = (
        F.when(F.col("last_rejected").isNotNull(), F.when(approved & (F.col("last_approved") >= F.col("last_rejected")), "active").otherwise("quarantined"))
        .when(approved | ((F.col("n_sound") > 0) & open_), "active")
        .otherwise(F.col("status"))
    )
    keep = [c for c in records.columns if c not in ("status", "adopted_count", "verified_count", "rejected_count")]
    add = lambda name, col: ((F.col(name) if name in records.columns else F.lit(0)) + F.coalesce(col, F.lit(0))).cast("long").alias(name)
    return met.select(*keep, status.alias("status"), add("adopted_count", "adopted"), add("verified_count", "verified"), add("rejected_count", "rejected"))


def review(records: DataFrame, decisions: DataFrame, claims: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(results, changes) of review decisions (id, outcome, evidence_kind, expected_status, supersedes: ids or null), one for each record.

    A verification of a record whose value is in conflict with served ones must name exactly those; then they are archived and replaced in the same
    change. results: id, error (null: done), result. changes: id, status, superseded_by, valid_from, valid_until. ``claims`` (id, slot, value, source_changed) are
    the records' assertions. Conflicts are counted, never listed.
    """
    own = records.select("id", "status", "superseded_by")
    verified = F.col("outcome") == "verified"
    met = decisions.join(own, "id", "left").join(claims, "id", "left")
    serving = claims.join(own.where("status in ('active', 'stale') and superseded_by is null").select("id"), "id", "left_semi")
    other = serving.select("slot", F.col("id").alias("peer"), F.col("value").alias("peer_value"), F.col("source_changed").alias("peer_changed"))
    pairs = met.where(verified & F.col("slot").isNotNull()).select("id", "slot", "value", "supersedes").join(other, "slot").where("peer <> id and peer_value <> value")
    named = F.array_contains(F.coalesce("supersedes", F.array().cast("array<long>")), F.col("peer"))
    counts = pairs.groupBy("id").agg(F.count("*").alias("n_conflicts"), F.count_if(named).alias("n_named"), F.bool_or(F.coalesce("peer_changed", F.lit(False))).alias("peer_changed"))
    met = met.join(counts, "id", "left").fillna(0, ["n_conflicts", "n_named"])
    n_given = F.coalesce(F.size(F.array_distinct("supersedes")), F.lit(0))
    exact = (n_given == F.col("n_conflicts")) & (F.col("n_named") == F.col("n_conflicts"))
    why = F.coalesce(
        F.when(F.col("status").isNull(), "record_not_found"),
        F.when(F.col("expected_status").isNotNull() & (F.col("expected_status") != F.col("status")), "status_changed"),
        F.when(verified & F.col("superseded_by").isNotNull(), "superseded_record"),
        F.when((F.col("n_conflicts") > 0) & ~exact & (n_given == 0), "conflicting_values"),
        F.when((n_given > 0) & ~exact, "conflicts_changed"),
        F.when(verified & F.coalesce("source_changed", F.lit(False)), "source_changed"),
        F.when(F.coalesce("peer_changed", F.lit(False)), "conflict_source_changed"),
    )
    approval = F.col("evidence_kind") == "user_approval"
    already = verified & approval & (F.col("status") == "active") & (F.col("n_conflicts") == 0) & (n_given == 0)
    to = (
        F.when(F.col("outcome") == "rejected", "quarantined")
        .when(verified & (F.col("status").isin("candidate", "active", "stale") | approval), "active").otherwise(F.col("status"))
    )
    judged = met.withColumns({"error": why, "to_status": to}).withColumn("result", F.when(F.col("error").isNull(), F.when(already, "already_active").otherwise("recorded")))
    now, none = F.lit(at).cast("timestamp"), F.lit(None)
    done = judged.where("result = 'recorded'")
    begun = F.when((F.col("to_status") == "active") & (F.col("status") != "active"), now)
    changed = done.where("to_status <> status").select("id", F.col("to_status").alias("status"), none.cast("long").alias("superseded_by"), begun.alias("valid_from"), none.cast("timestamp").alias("valid_until"))
    replaced = pairs.join(done.where("n_conflicts > 0").select("id"), "id", "left_semi").select(
        F.col("peer").alias("id"), F.lit("archived").alias("status"), F.col("id").alias("superseded_by"), none.cast("timestamp").alias("valid_from"), now.alias("valid_until")
    )
    return judged.select("id", "error", "result"), changed.unionByName(replaced)


def deadline_migration(records: DataFrame, old_days: int = 3) -> DataFrame:
    """Candidates whose deadline is exactly the old number of days after their creation get the current one; others keep theirs."""
    stale = (F.col("status") == "candidate") & (F.col("candidate_expires_at") == F.col("created_at") + F.expr(f"INTERVAL {old_days} DAYS"))
    return records.withColumn("candidate_expires_at", F.when(stale, F.col("created_at") + F.expr(f"INTERVAL {REVIEW_DAYS} DAYS")).otherwise(F.col("candidate_expires_at")))


def list_records(
    records: DataFrame, project_key: str, *, status: str = "all", limit: int = 100, offset: int = 0, query: str = "", knowledge_type: str = "all", scope: str = "all",
    source_agent: str | None = None, updated_from: str | None = None, updated_to: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(page, total): the records that a project sees and that match, newest change first, and how many there are in all.

    A query is literal, in any case, over title, content, search terms, agent and project; a date without a time ends with its day.
    """
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit 1 to 1000, offset from 0")
    if status != "all" and status not in STATUSES or scope not in ("all", *SCOPES) or knowledge_type != "all" and knowledge_type not in KNOWLEDGE_TYPES:
        raise ValueError("unknown status, scope or type")
    query = (query or "").strip()
    if len(query) > LIMITS["query"]:
        raise ValueError("query of at most 500 characters")
    bounds = [dt.datetime.fromisoformat(b) if b else None for b in (updated_from, updated_to)]
    if updated_to and len(updated_to) == 10:
        bounds[1] += dt.timedelta(days=1, microseconds=-1)
    c = F.col
    own, shared = (c("scope") == "project") & (c("project_key") == project_key), c("scope") == "user"
    keep = {"user": shared, "project": own, "all": shared | (c("project_key") == project_key)}[scope]
    for column, value in (("status", status), ("knowledge_type", knowledge_type), ("source_agent", source_agent or "all")):
        keep = keep & (c(column) == value) if value != "all" else keep
    for bound, holds in zip(bounds, (c("updated_at").__ge__, c("updated_at").__le__)):
        keep = keep & holds(F.lit(bound)) if bound else keep
    found = with_defaults(with_counters(records)).where(keep)
    if query:
        said = F.lit(query.lower())
        texts = [F.contains(F.lower(F.coalesce(n, F.lit(""))), said) for n in ("title", "content", "search_terms", "source_agent", "project_key")]
        found = found.where(_any(texts))
    return found.orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit), found.agg(F.count("*").alias("total"))


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def register_agents(agents: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert: the latest row of each agent.

    Of rows of one time a change comes after what is there, and of changes the one of the highest ``seq``, where they have one; what then is still equal is decided by the
    rows' own values, never by their place.
    """
    seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
    new = changes.withColumn("__seq", seq).select(*agents.columns, "__seq", F.lit(1).alias("__new"))
    both = agents.withColumns({"__seq": F.lit(None).cast("long"), "__new": F.lit(0)}).unionByName(new)
    order = [F.desc("updated_at"), F.desc("__new"), F.desc("__seq"), F.to_json(F.struct(*sorted(agents.columns)))]
    return numbered(both, ["agent_id"], order).where("n = 1").drop("n", "__seq", "__new")


def admitted_agents(requests: DataFrame, agents: DataFrame, require_registration: bool = False) -> DataFrame:
    """Requests of enabled agents; unknown agents pass unless registration is required."""
    met = requests.join(agents.select("agent_id", "enabled"), "agent_id", "left")
    return met.where(F.coalesce("enabled", F.lit(not require_registration))).drop("enabled")
