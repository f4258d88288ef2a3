import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import evaluate, governance, lifecycle, metrics, reuse, versions
from tidemark.plans.snapshots import Conflict, Snapshots
from tidemark.streaming import streams

AT = dt.datetime(2024, 1, 1)


def test_snapshots_commit_whole_and_once(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    a = spark.range(3)
    assert store.commit({"a": a, "b": a.withColumn("p", F.lit("x"))}, 0, {"b": ["p"]}) == 1
    with pytest.raises(Conflict):
        store.commit({"a": a}, 0)
    assert store.commit({"a": spark.range(5)}, 1) == 2
    assert (store.read("a").count(), store.read("a", 1).count(), store.read("b", 1).count()) == (5, 3, 3)
    store.commit({"a": a}, 2)
    store.vacuum(2)
    assert store.versions() == [2, 3]


def test_validation_names_the_first_broken_rule(spark):
    rows = [("a", "p", "t", "c", "fact", "user"), ("-", "p", "t", "c", "fact", "user"), ("a", "p", " ", "c", "fact", "user"), ("a", "p", "t", "c", None, "user")]
    df = spark.createDataFrame(rows, "source_agent string, project_key string, title string, content string, knowledge_type string, scope string")
    good, bad = schemas.validated(df, schemas.publish_rules())
    assert good.count() == 1 and [r.reason for r in bad.collect()] == ["agent_id", "title", "knowledge_type"]


def records(spark, rows):
    base = dict(project_key="p", scope="project", status="active", verified_count=0, rejected_count=0, created_at=AT, last_confirmed_at=None, title="t",
                content="c", knowledge_type="fact", superseded_by=None, source_agent="a")
    schema = """id long, project_key string, scope string, status string, verified_count long, rejected_count long, created_at timestamp, last_confirmed_at timestamp,
     title string, content string, knowledge_type string, superseded_by long, source_agent string"""
    return spark.createDataFrame([base | r for r in rows], schema)


def test_sweep_boundaries_and_idempotence(spark):
    days = lambda n, s=0: AT - dt.timedelta(days=n, seconds=s)
    rows = [
        dict(id=1, created_at=days(30)), dict(id=2, created_at=days(30, -1)), dict(id=3, created_at=days(90)), dict(id=4, status="stale", created_at=days(90)),
        dict(id=5, created_at=days(200), last_confirmed_at=days(1)), dict(id=6, status="candidate", created_at=days(1)), dict(id=7, status="candidate", created_at=days(1, -1)),
        dict(id=8, status="archived", created_at=days(300)),
    ]
    own = records(spark, rows)
    plan = lifecycle.sweep_plan(own, "2024-01-01 00:00:00")
    assert {r.id: (r.to_status, r.reason) for r in plan.collect()} == {
        1: ("stale", "idle_stale"), 3: ("archived", "idle_archive"), 4: ("archived", "idle_archive"), 6: ("quarantined", "review_deadline"),
    }
    after = lifecycle.apply_transitions(own, plan.withColumn("applied", F.lit(True)))
    assert lifecycle.sweep_plan(after, "2024-01-01 00:00:00").count() == 0


def test_capacity_evicts_the_weakest_but_keeps_the_floor(spark):
    own = records(spark, [dict(id=i, verified_count=i % 4, created_at=AT - dt.timedelta(hours=i)) for i in range(10)])
    plan = {r.id for r in lifecycle.sweep_plan(own, "2024-01-01 00:00:00", capacity=7, floor=5).collect()}
    assert plan == {8, 4, 0}
    assert lifecycle.evictions(own, 2, 5).count() == 5


@pytest.mark.parametrize(
    "status, steps, want",
    [
        ("candidate", [("verified", "test", True)], "active"),
        ("candidate", [("verified", "observation", True)], "candidate"),
        ("candidate", [("verified", "test", False)], "candidate"),
        ("archived", [("verified", "test", True)], "archived"),
        ("archived", [("verified", "user_approval", True)], "active"),
        ("active", [("rejected", "test", True), ("verified", "test", True)], "quarantined"),
        ("active", [("rejected", "test", True), ("verified", "user_approval", True)], "active"),
        ("active", [("used", None, False)], "active"),
    ],
)
def test_feedback_folds_in_order(spark, status, steps, want):
    feed = spark.createDataFrame([(1, i, *s) for i, s in enumerate(steps)], "id long, seq long, outcome string, evidence_kind string, has_ref boolean")
    got = lifecycle.feedback(records(spark, [dict(id=1, status=status), dict(id=2)]), feed).where("id = 1").head()
    assert got.status == want
    assert (got.verified_count, got.rejected_count, got.adopted_count) == tuple(sum(s[0] in k for s in steps) for k in (("verified",), ("rejected",), ("used", "verified")))


def test_publish_is_idempotent(spark):
    own = records(spark, [dict(id=1), dict(id=2, created_at=AT - dt.timedelta(1)), dict(id=3, content="other")])
    first, again = lifecycle.publish(own)
    assert sorted(r.id for r in first.collect()) == [2, 3] and [(r.request_id, r.knowledge_id) for r in again.collect()] == [(1, 2)]


def test_agents(spark):
    agents = spark.createDataFrame([("a", True, 1), ("b", False, 1)], "agent_id string, enabled boolean, updated_at long")
    new = lifecycle.register_agents(agents, spark.createDataFrame([("b", True, 2)], agents.schema))
    assert {(r.agent_id, r.enabled) for r in new.collect()} == {("a", True), ("b", True)}
    same = spark.createDataFrame([("b", True, 1), ("c", False, 5)], agents.schema)
    for rows in (same, same.orderBy("agent_id"), same.orderBy(F.desc("agent_id"))):
        assert {(r.agent_id, r.enabled) for r in lifecycle.register_agents(agents, rows).collect()} == {("a", True), ("b", True), ("c", False)}
    several = spark.createDataFrame([("b", True, 1, 2), ("b", False, 1, 3), ("b", True, 1, 1)], "agent_id string, enabled boolean, updated_at long, seq long")
    assert {(r.agent_id, r.enabled) for r in lifecycle.register_agents(agents, several).collect()} == {("a", True), ("b", False)}
    asked = spark.createDataFrame([("b",), ("z",)], "agent_id string")
    assert [r.agent_id for r in lifecycle.admitted_agents(asked, agents).collect()] == ["z"]
    assert lifecycle.admitted_agents(asked, agents, True).count() == 0


def test_governance_plans(spark):
    own = records(spark, [dict(id=1, status="candidate"), dict(id=2, verified_count=1), dict(id=3), dict(id=4, status="archived")])
    ev = spark.createDataFrame([(1, "proposed")], "knowledge_id long, outcome string")
    audit = spark.createDataFrame([], "knowledge_id long, reason string")
    acts = [("p1", 1, "merge", 1, 2, "same"), ("p2", 1, "archive", 3, None, "old"), ("p3", 1, "archive", 4, None, "x"), ("p4", 1, "archive", 3, None, "x"), ("p4", 2, "quarantine", 3, None, "x")]
    actions = spark.createDataFrame(acts, "plan_id string, n int, action string, knowledge_id long, target_id long, reason string")
    plan = governance.preview(actions, own, governance.guards(own, ev, audit)).withColumn("created_at", F.lit(AT))
    assert {(r.plan_id, r.refusal) for r in plan.collect()} == {("p1", None), ("p2", None), ("p3", "not_serving"), ("p4", "overlapping_actions")}
    none, yes = spark.createDataFrame([], "plan_id string"), spark.createDataFrame([("p2",)], "plan_id string")
    now = governance.guards(own, ev, audit)
    done = lambda current, ok, at="2024-01-01 10:00:00": {(r.plan_id, r.id, r.to_status) for r in governance.apply_plan(plan, current, ok, at).collect()}
    assert done(now, none) == {("p1", 1, "archived")}
    assert done(now, yes) == {("p1", 1, "archived"), ("p2", 3, "archived")}
    assert done(now, yes, "2024-01-02 00:00:00") == set()
    changed = governance.guards(own, ev.union(spark.createDataFrame([(1, "used")], ev.schema)), audit)
    assert done(changed, yes) == {("p2", 3, "archived")}


def test_probe_ledger_keeps_the_last_32_distinct_queries(spark):
    probes = spark.createDataFrame([("p", 1, f"q{i % 40}", i) for i in range(100)], "project_key string, knowledge_id long, query_hash string, seq long")
    digests = spark.createDataFrame([(1, "d")], "knowledge_id long, digest string")
    r = governance.probe_ledger(probes, digests).head()
    assert r.hits == 100 and r.query_hashes == [f"q{i % 40}" for i in range(68, 100)]
    own = spark.createDataFrame([(1, "archived", None, "d")], "id long, status string, superseded_by long, digest string")
    ledger = governance.probe_ledger(probes, digests)
    assert [x.id for x in governance.resurrect_plan(ledger, own).collect()] == [1]
    assert governance.resurrect_plan(ledger, own.withColumn("digest", F.lit("new"))).count() == 0


def test_packing(spark):
    page = spark.createDataFrame([(1, 1, 10, 60), (1, 2, 11, 50), (1, 3, 12, 40), (1, 4, 13, 1)], "query_id long, position long, id long, chars long")
    assert [r.id for r in reuse.pack_prefix(page, 100).orderBy("position").collect()] == [10]
    assert reuse.pack_greedy(page, 100).head().ids == [10, 12]


def test_turns_are_matched_by_the_best_unambiguous_way(spark):
    keys = "agent_id string, project_key string, session_id string"
    turns = spark.createDataFrame(
        [("a", "p", "s", "k1", "t1", None, "h", []), ("a", "p", "s", "k2", None, "b2", "h2", []), ("a", "p", "s", "k3", None, None, "x", ["r3"]), ("a", "p", "s", "k4", None, None, "dup", [])],
        f"{keys}, turn_key string, turn_id string, boundary string, prompt_hash string, cited_traces array<string>",
    )
    traces = spark.createDataFrame(
        [("a", "p", "s", "r1", "t1", None, "z"), ("a", "p", "s", "r2", None, "b2", "h2"), ("a", "p", "s", "r3", None, None, "y"), ("a", "p", "s", "r4", None, None, "dup"), ("a", "p", "s", "r5", None, None, "dup")],
        f"{keys}, trace_id string, turn_id string, boundary string, prompt_hash string",
    ).withColumn("completed_at", F.lit(None).cast("timestamp"))
    got = {r.turn_key: (r.trace_id, r.association) for r in reuse.associate(turns, traces).collect()}
    assert got == {"k1": ("r1", "turn_id"), "k2": ("r2", "transcript_boundary"), "k3": ("r3", "trace_citation")}


def test_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0)], "a int, b int")
    assert df.select(metrics.ratio(F.col("a"), F.col("b"))).head()[0] == 0.0
    assert df.select(metrics.ratio(F.col("a"), F.col("b"), None)).head()[0] is None


def test_percentiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 21)] + [(None,)], "v double")
    assert df.agg(metrics.nearest_rank("v", 0.95).alias("x")).head().x == 19.0
    assert metrics.at_place(df, "v", 0.95, 0.0).head().x == 19.0
    two = df.withColumn("g", F.lit(1)).union(spark.createDataFrame([(5.0, 2), (5.0, 2), (7.0, 2)], "v double, g int"))
    assert {(r.g, r.x) for r in metrics.at_place(two, "v", 0.5, 0.5, "g").collect()} == {(1, 10.0), (2, 5.0)}


def test_versions(spark):
    claims = spark.createDataFrame([(1, "s", "a"), (2, "s", "b"), (3, "s", "a"), (4, "t", "a")], "id long, slot string, value string")
    # 1 and 3 claim the same, and the first of them speaks for both
    assert {(r.id, r.peer_id) for r in versions.peers(claims).collect()} == {(1, 2), (2, 1)}
    assert {(r.slot, r.value, r.id, r.n_records) for r in versions.standpoints(claims).collect()} == {("s", "a", 1, 2), ("s", "b", 2, 1), ("t", "a", 4, 1)}
    assert {(r.id, r.n_peers) for r in versions.peer_counts(claims).collect()} == {(1, 1), (2, 2), (3, 1), (4, 0)}


def test_missing_predictions_are_wrong_and_not_abstentions(spark):
    gold = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = evaluate.unanswered_left_join(gold, spark.createDataFrame([(1, "x")], "query_id long, answer string"))
    assert {(r.query_id, r.found) for r in got.collect()} == {(1, True), (2, False)}


def files(tmp_path, spark, rows, schema, name):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def collect(stream, mode, name, spark, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_stream_drops_repeated_events(spark, tmp_path):
    rows = [("a", "s", "t", "x", AT), ("a", "s", "t", "x", AT + dt.timedelta(minutes=1)), ("a", "s", "t", "y", AT)]
    stream = files(tmp_path, spark, rows, "agent_id string, session_id string, event_type string, payload string, created_at timestamp", "ev")
    assert len(collect(streams.ingest(stream), "append", "once", spark, tmp_path)) == 2


def test_stream_ledger_equals_the_batch_ledger(spark, tmp_path):
    rows = [("p", str(i % 2), f"q{i % 50}", i) for i in range(200)]
    schema = "project_key string, knowledge_id string, query_hash string, seq long"
    got = {r.knowledge_id: (r.hits, r.query_hashes) for r in collect(streams.shadow_ledger(files(tmp_path, spark, rows, schema, "pr")), "update", "ledger", spark, tmp_path)}
    batch = governance.probe_ledger(spark.createDataFrame(rows, schema), spark.createDataFrame([], "knowledge_id string, digest string"))
    assert got == {r.knowledge_id: (r.hits, r.query_hashes) for r in batch.collect()}


def test_stream_learning_sends_bad_turns_aside(spark, tmp_path):
    stream = files(tmp_path, spark, [("k1", "hello"), ("k2", " "), ("k3", None)], "turn_key string, user_text string", "tu")
    seen = []
    q = streams.learn(stream, lambda rows, n: seen.extend(r.turn_key for r in rows.collect()), str(tmp_path / "dead"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert seen == ["k1"] and spark.read.json(str(tmp_path / "dead")).count() == 2


def test_query_sets_are_broadcast_in_blocks(spark):
    from tidemark.plans.staging import broadcast_blocks, union_all

    parts = broadcast_blocks(spark.range(25), "id", 10)
    assert len(parts) == 3 and union_all(parts).count() == union_all(parts).distinct().count() == 25
    assert len(broadcast_blocks(spark.range(5), "id", 10)) == 1


def test_visible_records(spark):
    from tidemark.operators.index import visible

    own = spark.createDataFrame([(1, "user", "q"), (2, "project", "p"), (3, "project", "q")], "id long, scope string, project_key string")
    asked = spark.createDataFrame([(1, "p"), (2, "z")], "query_id long, project_key string")
    assert {(r.query_id, r.id) for r in visible(asked, own).collect()} == {(1, 1), (2, 1), (1, 2)}
