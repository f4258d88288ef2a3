import json
import os

from pyspark.sql import functions as F

from tidemark.operators import projections
from tidemark.sources import profiles


def test_profiles_map_dotted_paths(spark):
    rows = spark.createDataFrame([('{"a": {"b": "x"}, "session_id": "s"}',), ('{"session": "t"}',), ("broken",)], "payload string")
    got = [tuple(r) for r in profiles.mapped(rows, {"cwd": "a.b", "session": ["session", "session_id"]}).collect()]
    assert got == [("x", "s"), (None, "t"), (None, None)]


def test_sessions_are_found_by_their_header(spark, tmp_path):
    for i in range(4):
        p = tmp_path / "d" / f"{i}.jsonl"
        p.parent.mkdir(exist_ok=True)
        p.write_text(json.dumps({"type": "session_meta", "payload": {"id": f"s{i % 2}"}}) + "\n{}\n")
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    names = lambda keep: sorted(r.path[-7:] for r in profiles.newest_sessions(spark, str(tmp_path), "s1", keep).collect())
    assert names(80) == ["1.jsonl", "3.jsonl"] and names(2) == ["3.jsonl"]


def test_changed_turns_are_dead_letters(spark):
    turns = spark.createDataFrame([("a", "h"), ("b", "h")], "path string, source_hash string")
    kept, dead = profiles.frozen(turns, spark.createDataFrame([("a", "h"), ("b", "old")], "path string, expected_hash string"))
    assert [r.path for r in kept.collect()] == ["a"] and [(r.path, r.reason) for r in dead.collect()] == [("b", "turn_changed")]


def test_end_bounds(spark):
    df = spark.createDataFrame([("2024-01-02",), ("2024-01-02 03:00:00",)], "t string").select(profiles.end_bound(F.col("t")).alias("x"))
    assert [str(r.x) for r in df.collect()] == ["2024-01-02 23:59:59.999999", "2024-01-02 03:00:00"]


def test_audit_log_is_redacted_and_appended(spark, tmp_path):
    rows = spark.createDataFrame([("password=abc",)], "message string")
    for _ in range(2):
        profiles.append_jsonl(rows, str(tmp_path / "log"), ("message",))
    assert [r.message for r in spark.read.json(str(tmp_path / "log")).collect()] == ["password=[REDACTED]"] * 2


def test_reason_maps(spark):
    rows = spark.createDataFrame([("r1", "a"), ("r1", "a"), ("r1", "b"), ("r2", None)], "run string, reason string")
    assert [(r.run, r.rejection_reasons) for r in projections.reasons(rows, "run").collect()] == [("r1", {"a": 2, "b": 1})]
