import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import governance, lifecycle, metrics, reports, reuse, versions
from tidemark.streaming import streams

AT = dt.datetime(2024, 1, 1)


def one(df):
    return df.head().asDict()


def test_first_rows_of_a_hot_key_equal_a_plain_sort(spark):
    r = random.Random(2)
    rows = [(i, r.choice("aaaab"), r.randint(0, 2), AT + dt.timedelta(hours=r.randint(0, 90))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, v long, at timestamp")
    quota = spark.createDataFrame([("a", 70), ("b", 5)], "k string, quota long")
    got = lifecycle.first_of(df, ["k"], [F.col("v"), F.to_date("at")], ["at", "id"], quota)
    want = {(x[0], n) for k, q in (("a", 70), ("b", 5)) for n, x in enumerate(sorted((x for x in rows if x[1] == k), key=lambda x: (x[2], x[3], x[0]))[:q], 1)}
    assert {(x.id, x.n) for x in got.collect()} == want


def test_evictions_go_by_evidence_then_use(spark):
    rows = [(1, "p", "active", 0, 5, 0, AT, AT), (2, "p", "active", 0, 1, 9, AT, AT), (3, "p", "active", 0, 1, 2, AT, AT), (4, "p", "active", 1, 0, 0, AT, AT), (5, "p", "active", 0, 1, 2, AT, AT - dt.timedelta(1))]
    df = spark.createDataFrame(rows, "id long, project_key string, status string, verified_count long, hit_count long, adopted_count long, created_at timestamp, updated_at timestamp")
    assert [x.id for x in lifecycle.evictions(df, 1, 1).orderBy("weakness").collect()] == [5, 3, 2, 1]
    assert lifecycle.evictions(df, 1, 4).count() == 1 and lifecycle.evictions(df, 9, 1).count() == 0


def reviewed(spark, *decisions):
    records = spark.createDataFrame([(1, "candidate", None), (2, "active", None), (3, "stale", None), (4, "archived", 2), (5, "active", None)], "id long, status string, superseded_by long")
    claims = spark.createDataFrame([(1, "s", "a", False), (2, "s", "b", False), (3, "s", "c", False), (5, "t", "z", True)], "id long, slot string, value string, source_changed boolean")
    schema = "id long, outcome string, evidence_kind string, expected_status string, supersedes array<long>"
    results, changes = lifecycle.review(records, spark.createDataFrame(decisions, schema), claims, "2024-02-01 00:00:00")
    return {r.id: r.error or r.result for r in results.collect()}, {r.id: (r.status, r.superseded_by) for r in changes.collect()}


@pytest.mark.parametrize(
    "decision, result, changes",
    [
        ((9, "verified", "test", None, None), "record_not_found", {}),
        ((1, "used", "test", "active", None), "status_changed", {}),
        ((4, "verified", "user_approval", None, None), "superseded_record", {}),
        ((1, "verified", "user_approval", None, None), "conflicting_values", {}),
        ((1, "verified", "user_approval", None, [2]), "conflicts_changed", {}),
        ((1, "verified", "user_approval", None, [2, 3, 5]), "conflicts_changed", {}),
        ((5, "verified", "test", None, None), "source_changed", {}),
        ((1, "verified", "user_approval", None, [3, 2]), "recorded", {1: ("active", None), 2: ("archived", 1), 3: ("archived", 1)}),
        ((5, "rejected", "test", None, None), "recorded", {5: ("quarantined", None)}),
        ((2, "used", "test", "active", None), "recorded", {}),
    ],
)
def test_reviews_replace_what_they_name(spark, decision, result, changes):
    assert reviewed(spark, decision) == ({decision[0]: result}, changes)


def test_approving_what_is_active_changes_nothing(spark):
    records = spark.createDataFrame([(1, "active", None)], "id long, status string, superseded_by long")
    claims = spark.createDataFrame([], "id long, slot string, value string, source_changed boolean")
    asked = spark.createDataFrame([(1, "verified", "user_approval", "active", None)], "id long, outcome string, evidence_kind string, expected_status string, supersedes array<long>")
    results, changes = lifecycle.review(records, asked, claims, "2024-02-01 00:00:00")
    assert results.head().result == "already_active" and changes.count() == 0


def test_old_deadlines_move(spark):
    day = dt.timedelta(1)
    rows = [(1, "candidate", AT, AT + 3 * day), (2, "candidate", AT, AT + 2 * day), (3, "active", AT, AT + 3 * day)]
    got = lifecycle.deadline_migration(spark.createDataFrame(rows, "id long, status string, created_at timestamp, candidate_expires_at timestamp"))
    assert {r.id: r.candidate_expires_at for r in got.collect()} == {1: AT + day, 2: AT + 2 * day, 3: AT + 3 * day}


def test_listing_checks_its_arguments(spark):
    df = spark.createDataFrame([], "id long, status string, scope string, project_key string, title string, content string, source_agent string, created_at timestamp")
    for bad in (dict(limit=0), dict(status="gone"), dict(scope="all of it"), dict(query="x" * 501), dict(updated_from="tomorrow")):
        with pytest.raises(ValueError):
            lifecycle.list_records(df, "p", **bad)
    assert lifecycle.list_records(df, "p")[1].head().total == 0


def test_only_the_newest_experiment_counts(spark):
    df = spark.createDataFrame([("a", AT, 1), ("b", AT + dt.timedelta(1), 2), ("b", AT, 3)], "experiment string, created_at timestamp, n int")
    assert {r.n for r in metrics.latest_experiment(df).collect()} == {2, 3}


def test_blocked_records(spark):
    df = spark.createDataFrame([(1, None, "f", "f", False), (2, 1, "", "x", False), (3, None, "f", "g", True), (4, None, "", "x", True)], "id int, superseded_by int, claim_fingerprint string, fingerprint string, claim_conflicted boolean")
    why = lambda h: {r.id: r.w for r in df.select("id", versions.blocked_reason(h).alias("w")).collect()}
    assert why(None) == {1: None, 2: "superseded_version", 3: "assertion_source_changed", 4: "unresolved_value_conflict"}
    assert why(F.lit(True)) == {1: None, 2: None, 3: "assertion_source_changed", 4: None}


def test_undo_and_prune_and_recovery(spark):
    guards = lambda *g: spark.createDataFrame(list(enumerate(g, 1)), "id long, guard string")
    before = spark.createDataFrame([(1, "active"), (2, "stale")], "id long, status string")
    assert [r.id for r in governance.undo_plan(before, guards("a", "b"), guards("a", "c")).collect()] == [1]
    ledger = spark.createDataFrame([(1, 3), (2, 4)], "knowledge_id long, hits long")
    records = spark.createDataFrame([(1, "archived"), (2, "active")], "id long, status string")
    assert [r.knowledge_id for r in governance.prune_ledger(ledger, records).collect()] == [1]
    rows = [(1, 10, "archived", 1, None, True), (1, 11, "archived", 0, None, True), (1, 12, "archived", 1, 5, True), (1, 13, "archived", 1, None, False), (2, 10, "archived", 1, None, True)]
    retired = spark.createDataFrame(rows, "query_id long, id long, status string, verified_count long, superseded_by long, supported boolean")
    asked = spark.createDataFrame([(1,)], "query_id long")
    assert [r.id for r in governance.recovery_candidates(asked, retired).collect()] == [10]


def test_guards_change_with_what_they_guard(spark):
    records = spark.createDataFrame([(1, "active")], "id long, status string")
    none = spark.createDataFrame([], "knowledge_id long, outcome string")
    row = spark.createDataFrame([(1, "used")], none.schema)
    guard = lambda e, a: governance.guards(records, e, a).head().guard
    assert len({guard(none, none), guard(row, none), guard(none, row), guard(row.union(row), none)}) == 4
    assert guard(row.union(row).repartition(3), none) == guard(row.union(row), none)


def test_shown_and_live_items(spark):
    item = "struct<knowledge_id:long,origin:string,content_hash:string>"
    traces = spark.createDataFrame([(1, "h", "s", [(5, None, "x"), (6, "sibling", "y")])], f"id long, prompt_hash string, session_id string, items array<{item}>")
    shown = reuse.listed(traces).head()
    assert "prompt_hash" not in shown and [i.origin for i in shown["items"]] == ["direct", "sibling"]
    items = spark.createDataFrame([(5, "x"), (6, "y"), (7, "z"), (8, "w")], "knowledge_id long, content_hash string")
    now = spark.createDataFrame([(5, "active", "x"), (6, "archived", "y"), (7, "stale", "q")], "id long, status string, content_hash string")
    assert {r.knowledge_id: r.omitted_reason for r in reuse.live(items, now).collect()} == {5: None, 6: "retired", 7: "content_changed", 8: "removed"}


def test_late_timings_in_a_stream(spark, tmp_path):
    s = spark.createDataFrame([("a", AT), ("b", AT)], "turn_id string, stopped_at timestamp")
    t = spark.createDataFrame([("a", AT + dt.timedelta(seconds=9), 3, 7), ("b", AT + dt.timedelta(minutes=9), 1, 1)], "turn_id string, timed_at timestamp, ttft_ms int, total_ms int")
    assert {(r.turn_id, r.timing_status, r.ttft_ms) for r in streams.timed_turns(s, t).collect()} == {("a", "measured", 3), ("b", "unavailable", None)}
    for name, df in (("s", s), ("t", t)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    stream = lambda n, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / n))
    q = streams.timed_turns(stream("s", s), stream("t", t)).writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert ("a", "measured") in {(r.turn_id, r.timing_status) for r in spark.table("timed").collect()}


def test_hallucinated_ids(spark):
    df = spark.createDataFrame([([3, 1, 9, 9], [1]), (None, [1]), ([2], None)], "r array<long>, i array<long>")
    assert [x.h for x in df.select(reports.hallucinated(F.col("r"), F.col("i")).alias("h")).collect()] == [[3, 9], [], [2]]


def test_stage_coverage(spark):
    stages = spark.createDataFrame([("x", 1, "bridge", None, 2), ("x", 2, "bridge", "full", 0), ("x", 1, "anchor", None, 0)], "arm string, query_id long, stage string, skipped_reason string, added_count int")
    items = spark.createDataFrame([("x", 1, "bridged", True), ("x", 1, "bridged", False), ("x", 1, "direct", True)], "arm string, query_id long, origin string, emitted boolean")
    got = {r.stage: (r.executed_cases, r.adding_cases, r.emitted_records) for r in reports.stage_coverage(stages, items).collect()}
    assert got == {"bridge": (1, 1, 1), "anchor": (1, 0, 0)}


def test_paired_arms_need_all_pairs(spark):
    expected = spark.createDataFrame([(q, "native", a, "t", 1.0, 1) for q in (1, 2, 3) for a in "xy"], "question_id long, scenario string, arm string, question_type string, retrieval_ms double, context_bytes long")
    schema = "question_id long, scenario string, arm string, status string, correct boolean, abstention boolean, answer_ms double"
    rows = [(1, "native", "x", "ok", True, False, 1.0), (1, "native", "y", "ok", False, False, 1.0), (2, "native", "x", "ok", True, False, 1.0), (2, "native", "y", "ok", True, False, 1.0), (3, "native", "x", "ok", False, False, 1.0)]
    part, whole = spark.createDataFrame(rows, schema), spark.createDataFrame([*rows, (3, "native", "y", "ok", True, False, 1.0)], schema)
    got = one(reports.paired_arms(expected, part, "native", "x", "y"))
    assert got == {"expected_pairs": 3, "valid_pairs": 2, "accuracy_delta": None, "helped": 1, "harmed": 0, "unchanged": 1}
    assert one(reports.paired_arms(expected, whole, "native", "x", "y"))["accuracy_delta"] == 0.0
    by_type = {(r.arm, r.accuracy) for r in reports.end_to_end_by_type(expected, part).collect()}
    assert by_type == {("x", 0.666667), ("y", None)}


def test_learning_arms_and_fields(spark):
    runs = spark.createDataFrame([("m", True, True, 2, True, False), ("m", False, False, 0, True, True), ("m", None, True, 2, True, True)], "arm string, success boolean, emitted boolean, convention_hits int, poison_in_context boolean, poison_adopted boolean")
    assert one(reports.arm_rates(runs)) == {"arm": "m", "n": 2, "success_rate": 0.5, "n_emitted": 1, "emitted_success_rate": 1.0, "convention_rate": 0.5, "poison_exposure_rate": 1.0, "poison_adoption_rate": 0.5}
    attempts = spark.createDataFrame([("baseline", False), ("baseline", False), ("memory", False), ("memory", True)], "group string, success boolean")
    assert one(reports.failure_reduction(attempts))["reduction"] == 0.5
    rates = spark.createDataFrame([("baseline", 0.25, None), ("auto", 0.75, 0.5)], "mode string, a_rate double, b_rate double")
    assert {(r.metric, r.delta) for r in reports.mode_deltas(rates).collect()} == {("a_rate", 0.5), ("b_rate", None)}
    sizes = spark.createDataFrame([(200, 2000), (1000, 6000)], "records long, bytes long")
    assert [(r.bytes_per_record, r.grown_per_record) for r in reports.storage_growth(sizes).orderBy("records").collect()] == [(10.0, None), (6.0, 5.0)]
