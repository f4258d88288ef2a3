import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import parsers
from tidemark.operators import gates, queue
from tidemark.streaming import streams

AT, NOW = dt.datetime(2024, 1, 1, 12), "2024-01-01 12:00:00"


def jobs(spark, *rows):
    return spark.createDataFrame([(i, s, n, AT + dt.timedelta(seconds=r), AT + dt.timedelta(seconds=u), "") for i, s, n, r, u in rows], queue.JOB)


def state(df):
    return {r.id: (r.status, r.attempts) for r in df.collect()}


def test_requests_are_let_in_once_and_while_there_is_room(spark):
    own = jobs(spark, ("a", "running", 1, 0, 0), ("b", "completed", 1, 0, 0))
    asked = spark.createDataFrame([("b", 1), ("c", 2), ("d", 3), ("c", 4), ("e", 5)], "id string, seq int")
    after, answers = queue.enqueue(own, asked, NOW, room=3)
    assert {r.id: (r.status, r.duplicate, r.error) for r in answers.collect()} == {"b": ("completed", True, None), "c": ("queued", False, None), "d": ("queued", False, None), "e": (None, False, "queue_full")}
    assert state(after) == {"a": ("running", 1), "b": ("completed", 1), "c": ("queued", 0), "d": ("queued", 0)}


def test_leases_claims_and_attempts(spark):
    own = jobs(spark, ("a", "queued", 0, -5, 0), ("b", "queued", 1, -9, 0), ("c", "queued", 0, 5, 0), ("d", "running", 1, 0, -301), ("e", "running", 1, 0, -300))
    again = queue.reclaimed(own, NOW)
    assert state(again)["d"] == ("queued", 1) and state(again)["e"] == ("running", 1)
    assert state(queue.claim(again, NOW, 2)) == {"b": ("running", 2), "a": ("running", 1)}
    assert set(state(queue.claim(again, NOW, 9))) == {"a", "b", "d"}
    running = jobs(spark, ("a", "running", 1, 0, 0), ("b", "running", 3, 0, 0), ("c", "running", 2, 0, 0), ("d", "queued", 1, 0, 0), ("e", "running", 9, 0, 0))
    told = spark.createDataFrame([("a", "failed", "x"), ("b", "failed", "y"), ("c", "completed", None), ("d", "completed", None)], "id string, outcome string, error string")
    after = queue.settle(running, told, NOW)
    assert state(after) == {"a": ("queued", 1), "b": ("failed", 3), "c": ("completed", 2), "d": ("queued", 1), "e": ("running", 9)}
    assert {r.id: (r.ready_at - AT).total_seconds() for r in after.collect()} == {"a": 2, "b": 8, "c": 4, "d": 0, "e": 0}


def test_finished_jobs_are_pruned_and_members_told(spark):
    own = jobs(spark, *[(str(i), "completed", 1, 0, i) for i in range(5)], ("q", "queued", 0, 0, -9))
    assert set(state(queue.pruned(own, 2))) == {"4", "3", "q"}
    runs = spark.createDataFrame([(1, "p"), (2, "q")], "run_id long, project_key string")
    links = spark.createDataFrame([(1, 10), (2, 11)], "run_id long, knowledge_id long")
    asked = spark.createDataFrame([(1, "p", 10), (1, "q", 10), (2, "q", 10), (2, "q", 11)], "run_id long, project_key string, knowledge_id long")
    assert {tuple(r) for r in queue.members(asked, runs, links).collect()} == {(1, "p", 10), (2, "q", 11)}


def test_secrets_go_by_their_keys_at_any_depth(spark):
    text = '{"a": {"apiKey": "x", "list": [{"password": 1}, "sk-abcdefghijklmnop"]}, "Authorization": ["y"], "n": 2}'
    got = spark.createDataFrame([(text,), ("plain bearer abcdefghijklmnop",), (None,)], "t string").select(parsers.redact_value("t").alias("x")).collect()
    assert [r.x for r in got] == ['{"a": {"apiKey": "[REDACTED]", "list": [{"password": "[REDACTED]"}, "[REDACTED]"]}, "Authorization": "[REDACTED]", "n": 2}', "plain bearer [REDACTED]", None]


def test_subjects_as_text(spark):
    rows = [('["Ann", "ann", 3, "Bob"]',), ("Ann, Bob;Carl | ann",), ("",), (None,), ('{"a": 1}',), ("x" * 101,)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").select(gates.normalized_subjects(gates.subject_list(F.col("t"))).alias("x")).collect()]
    assert got == [["ann", "bob"], ["ann", "bob", "carl"], [], [], ['{"a": 1}'], []]


def test_changes_are_announced_once_for_each_batch(spark, tmp_path):
    spark.createDataFrame([(1, "active"), (2, "stale")], "id long, status string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, status string").parquet(str(tmp_path / "in"))
    seen = []
    streams.announce(stream, ["status"], lambda note: seen.append(note), str(tmp_path / "ck")).awaitTermination(120)
    assert seen == [{"batch": 0, "rows": 2, "keys": 2, "changes": {"active": 1, "stale": 1}, "other": 0}]


def test_notes_add_up_and_counts_of_every_key_are_written(spark, tmp_path):
    spark.range(0, 350).selectExpr("id", "concat('k', id % 140) AS status").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, status string").parquet(str(tmp_path / "in"))
    seen = []
    streams.announce(stream, ["status"], lambda note: seen.append(note), str(tmp_path / "ck"), str(tmp_path / "counts")).awaitTermination(120)
    (note,) = seen
    assert (note["rows"], note["keys"], len(note["changes"])) == (350, 140, streams.MAX_KEYS)
    assert sum(note["changes"].values()) + note["other"] == 350 and note["other"] == 40 * 2 + (350 - 140 * 2 - 70)
    counts = spark.read.parquet(str(tmp_path / "counts")).where("batch = 0")
    assert counts.count() == 140 and counts.agg({"n": "sum"}).head()[0] == 350
