"""A knowledge base as relations that change together: publication, removal and governance plans, each one commit.

Publication writes a record with all that follows from it: its evidence, postings, term counts, the graph's edges, the claim that it makes, and the new dispute state of those that claim
another value. Removal takes all of that back in one commit; what to clean is declared in CASCADES. Governance plans rest on guards, and are applied and undone only while those hold.

Derived counts (document frequencies, corpus numbers, term counts, edges) are sums of signed rows, so a change costs its own records' terms. Which pairs of terms a record asserts is decided once, when it
is published, by the frequencies in its project up to then and with its own batch; the pairs are kept as rows of the record, so its removal takes back exactly those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsers import assertion_slot
from ..functions.text import bridge_terms, content_hash, indexed_text
from ..plans.relations import Change, Refused, Relation, Relations, State
from ..plans.staging import staged
from ..schemas import EVIDENCE, RECORD, publish_rules, validated
from . import expand, governance, index, lifecycle, versions

AUDIT = "id string, knowledge_id string, from_status string, to_status string, reason string, actor string, created_at timestamp"
ITEM = "struct<knowledge_id: string, rank: int, origin: string, related_to: string, content_hash: string, emitted: boolean, removed: boolean>"
#: What removal and undo leave of a record's state.
STATE_FIELDS = ("status", "adopted_count", "verified_count", "rejected_count", "superseded_by", "valid_from", "valid_until")

RELATIONS = (
    Relation("records", RECORD, owner="id"),
    Relation("evidence", EVIDENCE, owner="knowledge_id"),
    Relation("audit", AUDIT, owner="knowledge_id"),
    Relation("experience_outcomes", "knowledge_id string, passed long, failed long, admission string", owner="knowledge_id"),
    Relation("shadow_hits", "knowledge_id string, project_key string, hits long, query_hashes array<string>, digest string", owner="knowledge_id"),
    Relation("event_links", "knowledge_id string, event_id string, link string", owner="knowledge_id"),
    Relation("compilation_links", "knowledge_id string, run_id string, link string", owner="knowledge_id"),
    Relation("traces", f"id string, agent_id string, project_key string, session_id string, turn_id string, context_text string, items array<{ITEM}>, created_at timestamp", owner="id"),
    Relation("postings", "id string, term string, tf long, doc_len long, places array<int>", owner="id"),
    Relation("pairs", "id string, project_key string, a string, b string, at timestamp", owner="id"),
    Relation("terms", "id string, project_key string, term string", owner="id"),
    Relation("frequencies", "term string, n long", key=("term",), counts=("n",)),
    Relation("numbers", "corpus string, docs long, tokens long", key=("corpus",), counts=("docs", "tokens")),
    Relation("term_counts", "project_key string, term string, n long", key=("project_key", "term"), counts=("n",)),
    Relation("edges", "project_key string, a string, b string, n long, last_seen timestamp", key=("project_key", "a", "b"), counts=("n",), stamps=("last_seen",)),
    Relation("plans", "plan_id string, n int, action string, knowledge_id string, target_id string, reason string, guard string, target_guard string, requires_approval boolean", owner="plan_id"),
    Relation("plan_states", "plan_id string, project_key string, actor string, status string, approved_by string, created_at timestamp, applied_at timestamp, undone_at timestamp", owner="plan_id"),
    Relation("undo", "plan_id string, guard string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RECORD if f.name in ("id", *STATE_FIELDS)), owner="plan_id"),
)

#: What goes with a record: the relations whose rows it owns. What some of those rows were counted in is taken back, see _withdraw().
CASCADES = ("records", "evidence", "audit", "experience_outcomes", "shadow_hits", "event_links", "compilation_links", "postings", "pairs", "terms")


def open_base(spark: SparkSession, root: str) -> Relations:
    return Relations(spark, root, RELATIONS)


def _id(prefix: str, *parts: Column) -> Column:
    """An id that a change which is decided anew gives again."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 24))


def source_fingerprint(rows: DataFrame) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[rows[c] for c in ("title", "content", "scope", "project_key")]), 256)


# ---------------------------------------------------------------- publication


def publish(base: Relations, requests: DataFrame, at: str) -> DataFrame:
    """Publishes requests (request_id, title, content, knowledge_type, scope, project_key, source_agent, evidence_summary, search_terms, subject_terms, created_at) and tells of each: request_id, knowledge_id, outcome.

    outcome: created; existing (the same text is there, or came earlier in the same call: it is confirmed by one more row of evidence, and new search terms replace its old ones); else the rule that the request
    breaks. Null search terms and subjects count as none. All of it is one commit.
    """
    requests = staged(requests, "requests")
    return base.transact(lambda state: _publication(state, requests, at))


def _publication(state: State, requests: DataFrame, at: str) -> Change:
    now = F.lit(at).cast("timestamp")
    good, bad = validated(requests.withColumn("search_terms", F.coalesce("search_terms", F.lit(""))), publish_rules())
    good = good.withColumn("content_hash", content_hash(*[F.col(c) for c in ("title", "content", "knowledge_type", "scope", "project_key")]))
    good = lifecycle.numbered(good, ["content_hash"], ["created_at", "request_id"])
    there = state.read("records")
    known = there.select("content_hash", F.col("id").alias("known_id"), F.col("status").alias("known_status"), F.col("search_terms").alias("known_terms"))
    met = staged(good.join(known, "content_hash", "left").withColumn("id", F.coalesce("known_id", _id("kn_", F.col("content_hash")))), "publication")
    fresh = met.where("known_id is null and n = 1")
    own = {c: F.lit(0).cast("long") for c in ("adopted_count", "verified_count", "rejected_count", "hit_count")}
    slot = assertion_slot(F.col("content"), F.col("knowledge_type"))
    own |= {"status": F.lit("candidate"), "created_at": now, "updated_at": now, "candidate_expires_at": now + F.expr(f"INTERVAL {lifecycle.REVIEW_DAYS} DAYS")}
    made = fresh.withColumns(own).withColumn("__slot", slot)
    made = made.withColumns({"claim_topic": F.coalesce("__slot.topic", F.lit("")), "claim_value": F.coalesce("__slot.value", F.lit("")), "claim_conflicted": F.lit(False)})
    made = made.withColumn("claim_fingerprint", F.when(F.col("claim_topic") != "", source_fingerprint(made)).otherwise(""))
    made = staged(_as(made, RECORD), "made")
    # of the requests that a record has already, the last one with terms of its own says what it is found by
    again = met.where("known_id is not null and search_terms <> '' and search_terms <> known_terms")
    terms = again.groupBy("id").agg(F.max_by("search_terms", F.struct("created_at", "request_id")).alias("__terms"))
    retold = there.join(terms, "id").withColumns({"search_terms": F.col("__terms"), "updated_at": now}).drop("__terms")
    retold = staged(_as(retold, RECORD), "retold")
    touched = staged(made.unionByName(retold), "touched")
    created = F.col("known_id").isNull() & (F.col("n") == 1)
    evidence = met.select(
        _id("ev_", F.col("request_id"), F.lit(at)).alias("id"), F.col("id").alias("knowledge_id"), F.col("source_agent").alias("agent_id"),
        F.when(created, "proposed").otherwise("confirmed_duplicate").alias("outcome"), F.col("evidence_summary").alias("summary"),
        F.when(created, "observation").otherwise("duplicate").alias("evidence_kind"), F.lit("").alias("evidence_ref"),
        F.when(~created, F.coalesce("known_status", F.lit("candidate"))).alias("status_before"), F.coalesce("known_status", F.lit("candidate")).alias("status_after"), now.alias("created_at"),
    )
    change = Change(append={"evidence": evidence})
    if not touched.isEmpty():
        _index(state, change, touched, retold, at)
        after = there.join(touched.select("id"), "id", "left_anti").unionByName(touched)
        disputed = versions.refreshed(after, touched.where("claim_topic <> ''"))
        change.replace["records"] = staged(_merged(touched, disputed), "records-to-write")
    told = met.select("request_id", F.col("id").alias("knowledge_id"), F.when(created, "created").otherwise("existing").alias("outcome"))
    change.result = told.unionByName(bad.select("request_id", F.lit(None).cast("string").alias("knowledge_id"), F.col("reason").alias("outcome")))
    return change


def _as(rows: DataFrame, schema) -> DataFrame:
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _merged(own: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows with those of ``changed`` (whole rows) in place of their own."""
    return own.join(changed.select("id"), "id", "left_anti").unionByName(changed)


def _negative(rows: DataFrame, *counts: str) -> DataFrame:
    return rows.withColumns({c: -F.col(c) for c in counts})


def _counted(change: Change, name: str, rows: DataFrame) -> None:
    change.append[name] = change.append[name].unionByName(rows) if name in change.append else rows


def _index(state: State, change: Change, touched: DataFrame, retold: DataFrame, at: str) -> None:
    """Postings, frequencies, and what the graph of terms gets of new or retold records; of the latter what they had is taken back."""
    _withdraw(state, change, retold.select("id"))
    text = indexed_text(F.col("title"), F.col("content"), F.col("search_terms"))
    posted = staged(index.postings(touched, text=text, places=True), "postings")
    change.replace["postings"] = posted
    _counted(change, "frequencies", posted.groupBy("term").agg(F.count("*").alias("n")))
    _counted(change, "numbers", posted.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).crossJoin(touched.agg(F.count("*").alias("docs"))).select(F.lit("all").alias("corpus"), "docs", "tokens"))
    own = staged(touched.select("id", "project_key", F.explode(bridge_terms(F.col("title"), F.col("search_terms"))).alias("term")).distinct(), "terms")
    change.replace["terms"] = own
    new = own.groupBy("project_key", "term").agg(F.count("*").alias("n"))
    # frequencies up to now, without what is taken back, and with this batch
    before = state.read("term_counts").join(own.select("project_key", "term").distinct(), ["project_key", "term"], "left_semi")
    back = change.append.get("term_counts", before.limit(0))
    counts = before.unionByName(back).unionByName(new).groupBy("project_key", "term").agg(F.sum("n").alias("df"))
    pairs = staged(expand.asserted_pairs(own.withColumn("created_at", F.lit(at).cast("timestamp")), counts), "pairs")
    change.replace["pairs"] = pairs
    _counted(change, "term_counts", new)
    _counted(change, "edges", pairs.groupBy("project_key", "a", "b").agg(F.count("*").alias("n"), F.max("at").alias("last_seen")))


def _withdraw(state: State, change: Change, ids: DataFrame) -> None:
    """Takes back what records have added to the counts."""
    if ids.isEmpty():
        return
    held = {n: staged(state.read(n).join(ids, "id", "left_semi"), f"withdrawn-{n}") for n in ("postings", "terms", "pairs")}
    _counted(change, "frequencies", _negative(held["postings"].groupBy("term").agg(F.count("*").alias("n")), "n"))
    sums = held["postings"].agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).crossJoin(ids.agg(F.count("*").alias("docs")))
    _counted(change, "numbers", _negative(sums.select(F.lit("all").alias("corpus"), "docs", "tokens"), "docs", "tokens"))
    _counted(change, "term_counts", _negative(held["terms"].groupBy("project_key", "term").agg(F.count("*").alias("n")), "n"))
    edges = held["pairs"].groupBy("project_key", "a", "b").agg(F.count("*").alias("n"), F.max("at").alias("last_seen"))
    _counted(change, "edges", _negative(edges, "n"))


def open_index(state: State) -> index.Index:
    """The index that search reads, as the segments of this version have it."""
    found = state.read("numbers").where("corpus = 'all'").head()
    docs, tokens = (found.docs, found.tokens) if found else (0, 0)
    terms = staged(state.read("frequencies").select("term", F.col("n").alias("df")), "frequencies")
    return index.Index(state.read("postings").select("term", "id", "tf", "doc_len", "places"), terms, float(docs), tokens / docs if docs else 0.0)


def rebuilt_edges(state: State) -> DataFrame:
    """The graph made anew from what each record asserts."""
    return state.read("pairs").groupBy("project_key", "a", "b").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- removal


def remove(base: Relations, project_key: str, ids: DataFrame) -> dict:
    """Removes records (id) for good, with all that goes with them: removed_count, already_missing_count.

    Nothing is removed if one of them belongs to another project; records of scope user are everyone's. Traces that show one of them, or a row that was inferred from it, stay as an audit trail: their text
    goes and their items are marked. What a removed record had replaced stays replaced.
    """
    ids = staged(ids.select(F.col("id").cast("string").alias("id")).where("id is not null").distinct(), "to-remove")

    def decide(state: State) -> Change:
        met = staged(state.read("records").join(ids, "id", "left_semi"), "removed")
        if not met.where((F.col("scope") != "user") & ~F.col("project_key").eqNullSafe(F.lit(project_key))).isEmpty():
            raise Refused("a record outside of the project")
        n = met.count()
        result = {"removed_count": n, "already_missing_count": ids.count() - n}
        if not n:
            return Change(result=result)
        gone = met.select("id")
        change = Change(remove={name: gone for name in CASCADES}, result=result)
        _withdraw(state, change, gone)
        change.replace["traces"] = _blanked(state.read("traces"), gone)
        rest = state.read("records").join(gone, "id", "left_anti")
        disputed = staged(versions.refreshed(rest, met.where("claim_topic <> ''")), "disputed")
        if not disputed.isEmpty():
            change.replace["records"] = disputed
        return change

    return base.transact(decide)


def _blanked(traces: DataFrame, gone: DataFrame) -> DataFrame:
    """The traces that show a removed record: without their text, and with its items marked."""
    named = traces.select(F.col("id").alias("__trace"), F.explode("items").alias("i")).select("__trace", F.explode(F.array("i.knowledge_id", "i.related_to")).alias("id"))
    # a trace holds a bounded number of items, and so of removed ids
    hits = named.join(gone, "id").groupBy("__trace").agg(F.collect_set("id").alias("__ids"))
    met = traces.join(hits, F.col("id") == F.col("__trace"))
    mark = F.transform("items", lambda i: F.when(F.array_contains(F.col("__ids"), i["knowledge_id"]), i.withField("removed", F.lit(True))).otherwise(i))
    return met.withColumns({"context_text": F.lit(""), "items": mark}).drop("__trace", "__ids")


# ---------------------------------------------------------------- governance plans


def guards(state: State) -> DataFrame:
    """(id, guard): changes with a record, its evidence, its audit rows, and with the records that claim another value of its slot."""
    records = state.read("records")
    own = governance.guards(records, state.read("evidence"), state.read("audit"))
    met = own.join(versions.peer_sums(records), "id", "left")
    parts = ["guard", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in versions.PEER_SUMS]]
    return met.select("id", F.sha2(F.concat_ws("\x1f", *parts), 256).alias("guard"))


def judged(state: State, actions: DataFrame) -> DataFrame:
    """governance.preview() of actions on this version, with what claims add to it: disputes are only settled by naming the one version in dispute."""
    records = state.read("records")
    plan = governance.preview(actions, records, guards(state))
    facts = records.select("id", "claim_topic", ((F.col("claim_topic") != "") & (F.col("claim_fingerprint") != source_fingerprint(records))).alias("changed"))
    facts = facts.join(versions.peer_sums(records), "id", "left")
    a, t = facts.alias("a"), facts.alias("t")
    met = plan.join(a, F.col("knowledge_id") == F.col("a.id"), "left").join(t, F.col("target_id") == F.col("t.id"), "left")
    slot = records.select("id", versions.slot_of().alias("slot"), "claim_value", versions.standing().alias("stands"))
    met = met.join(slot.alias("s"), F.col("knowledge_id") == F.col("s.id"), "left").join(slot.alias("u"), F.col("target_id") == F.col("u.id"), "left")
    peers = F.coalesce(F.col("a.n_peers"), F.lit(0))
    is_peer = F.coalesce((F.col("s.slot") == F.col("u.slot")) & (F.col("s.claim_value") != F.col("u.claim_value")) & F.col("u.stands"), F.lit(False))
    act = F.col("action")
    why = F.coalesce(
        F.col("refusal"),
        F.when(act.isin("approve", "supersede") & F.col("a.changed"), "assertion_source_changed"),
        F.when((act == "approve") & (peers > 0), "conflicting_versions_need_supersede"),
        F.when((act == "supersede") & ~((peers == 1) & is_peer), "not_the_exact_conflicting_version"),
        F.when((act == "supersede") & F.col("t.changed"), "conflict_source_changed"),
    )
    return met.select(*[plan[c] for c in plan.columns if c != "refusal"], why.alias("refusal"))


def preview_plan(base: Relations, actions: DataFrame, project_key: str, actor: str, at: str) -> None:
    """Keeps plans (plan_id, n, action, knowledge_id, target_id, reason) with the guards of all that they touch; Refused if one of their actions is not possible."""
    actions = staged(actions, "actions")

    def decide(state: State) -> Change:
        plan = staged(judged(state, actions), "plan")
        touched = plan.select(F.explode(F.array("knowledge_id", "target_id")).alias("id")).where("id is not null")
        outside = state.read("records").where((F.col("scope") != "user") & ~F.col("project_key").eqNullSafe(F.lit(project_key))).join(touched, "id", "left_semi")
        _refuse(plan, outside)
        now = F.lit(at).cast("timestamp")
        states = plan.select("plan_id").distinct().withColumns({"project_key": F.lit(project_key), "actor": F.lit(actor), "status": F.lit("preview"), "created_at": now})
        states = states.withColumns({"approved_by": F.lit(None).cast("string"), "applied_at": F.lit(None).cast("timestamp"), "undone_at": F.lit(None).cast("timestamp")})
        return Change(append={"plans": plan, "plan_states": states})

    base.transact(decide)


def _refuse(plan: DataFrame, outside: DataFrame | None = None) -> None:
    bad = plan.where("refusal is not null").orderBy("plan_id", "n").head()
    if bad is not None:
        raise Refused(bad.refusal)
    if outside is not None and not outside.isEmpty():
        raise Refused("record_not_found")


def _plan(state: State, plan_id: str, project_key: str, at: str, stages: tuple[str, ...]) -> tuple[DataFrame, object]:
    """A plan of the project in one of the stages, that still holds."""
    own = state.read("plan_states").where((F.col("plan_id") == plan_id) & (F.col("project_key") == project_key)).head()
    if own is None:
        raise Refused("plan_not_found")
    if own.status not in stages:
        raise Refused(f"plan_is_{own.status}")
    return state.read("plans").where(F.col("plan_id") == plan_id), own


def _still_holds(state: State, plan: DataFrame, own, at: str) -> DataFrame:
    """The plan judged anew, or Refused: it is a day old at most, its guards are what they were, its actions are possible, and none of them makes another one impossible."""
    spark = plan.sparkSession
    if spark.range(1).select(F.lit(own.created_at) + F.expr(f"INTERVAL {governance.PLAN_HOURS} HOURS") <= F.lit(at).cast("timestamp")).head()[0]:
        raise Refused("preview_expired")
    now = guards(state)
    a, t = (now.select(F.col("id").alias(k), F.col("guard").alias(g)) for k, g in (("knowledge_id", "__now"), ("target_id", "__target_now")))
    met = plan.join(a, "knowledge_id", "left").join(t, "target_id", "left")
    if not met.where(~F.col("guard").eqNullSafe(F.col("__now")) | ~F.col("target_guard").eqNullSafe(F.col("__target_now"))).isEmpty():
        raise Refused("knowledge_or_evidence_changed")
    again = staged(judged(state, plan.drop("guard", "target_guard", "requires_approval")), "again")
    _refuse(again)
    # two approvals of one plan may claim different values of one slot
    slots = state.read("records").select(F.col("id").alias("knowledge_id"), versions.slot_of().alias("slot"), "claim_value")
    raised = again.where("action in ('approve', 'supersede')").join(slots, "knowledge_id").where("slot is not null")
    if not raised.groupBy("slot").agg(F.countDistinct("claim_value").alias("n")).where("n > 1").isEmpty():
        raise Refused("conflicting_versions_in_one_plan")
    return again


def _with_status(state: State, plan_id: str, **values) -> DataFrame:
    return state.read("plan_states").where(F.col("plan_id") == plan_id).withColumns(values)


def approve_plan(base: Relations, plan_id: str, project_key: str, operator: str, at: str) -> None:
    def decide(state: State) -> Change:
        plan, own = _plan(state, plan_id, project_key, at, ("preview", "approved"))
        _still_holds(state, plan, own, at)
        return Change(replace={"plan_states": staged(_with_status(state, plan_id, status=F.lit("approved"), approved_by=F.lit(operator)), "states")})

    base.transact(decide)


def apply_plan(base: Relations, plan_id: str, project_key: str, actor: str, at: str) -> str:
    """Applies a plan whole, with evidence, audit rows and an undo log, in one commit; a plan that has been applied stays as it is."""

    def decide(state: State) -> Change:
        plan, own = _plan(state, plan_id, project_key, at, ("preview", "approved", "applied"))
        if own.status == "applied":
            return Change(result="already_applied")
        plan = staged(_still_holds(state, plan, own, at), "plan")
        if own.approved_by is None and not plan.where("requires_approval").isEmpty():
            raise Refused("operator_approval_required")
        now = F.lit(at).cast("timestamp")
        records = state.read("records")
        act = F.col("action")
        raised = act.isin("approve", "supersede")
        new = records.join(plan.select("action", "target_id", F.col("knowledge_id").alias("id")), "id")
        add = lambda c, flag: F.coalesce(F.col(c), F.lit(0)) + F.when(flag, 1).otherwise(0)
        new = new.withColumns(
            {
                "__from": F.col("status"), "__verb": act, "status": F.when(raised, "active").when(act == "quarantine", "quarantined").otherwise("archived"), "updated_at": now,
                "verified_count": add("verified_count", raised), "adopted_count": add("adopted_count", raised), "rejected_count": add("rejected_count", act == "quarantine"),
                "valid_from": F.when(raised, now).otherwise(F.col("valid_from")), "valid_until": F.when(raised, F.lit(None)).when(act == "merge", now).otherwise(F.col("valid_until")),
                "superseded_by": F.when(act == "merge", F.col("target_id")).otherwise(F.col("superseded_by")),
            }
        ).drop("action", "target_id")
        by = plan.where("action = 'supersede'").select(F.col("target_id").alias("id"), F.col("knowledge_id").alias("__by"))
        old = records.join(by, "id").withColumns({"__from": F.col("status"), "__verb": F.lit("superseded"), "status": F.lit("archived"), "updated_at": now, "valid_until": now, "superseded_by": F.col("__by")}).drop("__by")
        changed = staged(new.unionByName(old), "changed")
        touched = plan.select(F.explode(F.array("knowledge_id", "target_id")).alias("id")).where("id is not null").distinct()
        evidence = changed.where("__verb <> 'superseded'").select(
            _id("ev_", F.lit(plan_id), F.col("id")).alias("id"), F.col("id").alias("knowledge_id"), F.lit(actor).alias("agent_id"),
            F.when(F.col("__verb").isin("approve", "supersede"), "verified").when(F.col("__verb") == "quarantine", "rejected").when(F.col("__verb") == "merge", "duplicate").otherwise(F.col("__verb")).alias("outcome"),
            F.lit("governance action").alias("summary"), F.when(F.col("__verb") == "merge", "duplicate").when(F.col("__verb") == "archive", "observation").otherwise("user_approval").alias("evidence_kind"),
            F.lit(f"governance-plan:{plan_id}").alias("evidence_ref"), F.col("__from").alias("status_before"), F.col("status").alias("status_after"), now.alias("created_at"),
        )
        change = _restated(state, changed, plan_id, actor, at)
        change.append["evidence"] = staged(evidence, "evidence")
        before = records.join(touched, "id", "left_semi").select("id", *STATE_FIELDS)
        after = after_guards(state, change)
        change.append["undo"] = staged(before.join(after, "id").withColumn("plan_id", F.lit(plan_id)), "undo")
        change.replace["plan_states"] = staged(_with_status(state, plan_id, status=F.lit("applied"), applied_at=now), "states")
        change.result = "applied"
        return change

    return base.transact(decide)


def _restated(state: State, changed: DataFrame, plan_id: str, actor: str, at: str) -> Change:
    """The change that gives records their new state (rows with __from and __verb), with audit rows and the dispute state of all in their slots."""
    own = changed.drop("__from", "__verb")
    after = state.read("records").join(own.select("id"), "id", "left_anti").unionByName(own)
    disputed = versions.refreshed(after, own.where("claim_topic <> ''"))
    audit = changed.select(
        _id("lc_", F.lit(plan_id), F.col("id"), F.col("__verb")).alias("id"), F.col("id").alias("knowledge_id"), F.col("__from").alias("from_status"), F.col("status").alias("to_status"),
        F.concat("__verb", F.lit(f"; governance plan {plan_id}")).alias("reason"), F.lit(actor).alias("actor"), F.lit(at).cast("timestamp").alias("created_at"),
    )
    return Change(append={"audit": staged(audit, "audit")}, replace={"records": staged(_merged(own, disputed), "restated")})


class _After:
    """A version with a change that has not been committed yet."""

    def __init__(self, state: State, change: Change):
        self.state, self.change = state, change

    def read(self, relation: str) -> DataFrame:
        of, rows = self.state.store.relations[relation], self.state.read(relation)
        if relation in self.change.replace:
            new = self.change.replace[relation]
            rows = rows.join(new.select(of.owner).distinct(), of.owner, "left_anti").unionByName(new)
        return rows.unionByName(self.change.append[relation]) if relation in self.change.append else rows


def after_guards(state: State, change: Change) -> DataFrame:
    return guards(_After(state, change))


def undo_plan(base: Relations, plan_id: str, project_key: str, operator: str, at: str) -> str:
    """Gives records back the state that they had before a plan, unless one of them, its evidence or its peers have changed since; the plan's evidence is marked as reverted."""

    def decide(state: State) -> Change:
        _, own = _plan(state, plan_id, project_key, at, ("applied", "undone"))
        if own.status == "undone":
            return Change(result="already_undone")
        log = state.read("undo").where(F.col("plan_id") == plan_id)
        now = guards(state).select("id", F.col("guard").alias("__now"))
        if not log.join(now, "id", "left").where(~F.col("guard").eqNullSafe(F.col("__now"))).isEmpty():
            raise Refused("later_activity_prevents_undo")
        back = log.select("id", *[F.col(c).alias(f"__{c}") for c in STATE_FIELDS])
        met = state.read("records").join(back, "id").withColumns({"__from": F.col("status"), "__verb": F.lit("undo"), "updated_at": F.lit(at).cast("timestamp")})
        changed = staged(met.withColumns({c: F.col(f"__{c}") for c in STATE_FIELDS}).drop(*[f"__{c}" for c in STATE_FIELDS]), "changed")
        change = _restated(state, changed, plan_id, operator, at)
        of_plan = F.col("evidence_ref") == f"governance-plan:{plan_id}"
        evidence = state.read("evidence")
        held = evidence.join(evidence.where(of_plan).select("knowledge_id").distinct(), "knowledge_id", "left_semi")
        change.replace["evidence"] = staged(held.withColumn("outcome", F.when(of_plan, "reverted").otherwise(F.col("outcome"))), "evidence")
        change.replace["plan_states"] = staged(_with_status(state, plan_id, status=F.lit("undone"), undone_at=F.lit(at).cast("timestamp")), "states")
        change.result = "undone"
        return change

    return base.transact(decide)
