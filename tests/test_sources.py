import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import corpora, transcripts


def write(path, items):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in items) + "\n", encoding="utf-8")
    return str(path)


def test_tail_drops_a_cut_line_and_ends_where_it_was_frozen(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", ["x" * 50, "second", "third"])
    got = [r.line for r in transcripts.tails(spark, p, max_bytes=20).orderBy("n").collect()]
    assert got == ["second", "third"]
    path = transcripts.tails(spark, p).head().path
    frozen = spark.createDataFrame([(path, 58)], "path string, end_offset long")
    assert [r.line for r in transcripts.tails(spark, p, frozen=frozen).orderBy("n").collect()] == ["x" * 50, "second"]


def test_claude_turn(spark, tmp_path):
    p = write(
        tmp_path / "c.jsonl",
        [
            {"type": "user", "uuid": "u1", "message": {"role": "user", "content": "first"}},
            "not json",
            {"type": "user", "uuid": "u2", "message": {"role": "user", "content": [{"type": "text", "text": "fix it password=abc"}]}},
            {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "on it"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "pytest -q"}}]}},
            {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "exit code: 1"}]}},
            {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "t2", "name": "Bash", "input": {"command": "ls"}}]}},
            {"type": "user", "toolUseResult": {"interrupted": True}, "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t2", "content": "x"}]}},
            {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "t3", "name": "Read", "input": {}}, {"type": "text", "text": "done"}]}},
        ],
    )
    r = transcripts.read_turns(spark, p, "claude").head()
    assert r.user_text == "fix it password=[REDACTED]" and r.assistant_text == "on it\ndone"
    assert [(t.id, t.success, t.objective_kind) for t in r.tools] == [("t1", False, "test"), ("t2", False, None), ("t3", None, None)]
    assert r.source_turn_key != r.previous_turn_key and r.source_turn_key.startswith("transcript:")


def test_codex_turn(spark, tmp_path):
    p = write(
        tmp_path / "x.jsonl",
        [
            {"type": "session_meta", "payload": {"id": "s"}},
            {"payload": {"type": "user_message", "message": "run it"}},
            {"payload": {"type": "function_call", "call_id": "1", "name": "shell_command", "arguments": '{"command": "make test"}'}},
            {"payload": {"type": "function_call_output", "call_id": "1", "output": "Process exited with code 0"}},
            {"payload": {"type": "custom_tool_call", "call_id": "2", "name": "exec", "input": 'text(await tools.exec_command({cmd: "pytest -q"}));'}},
            {"payload": {"type": "custom_tool_call_output", "call_id": "2", "output": 'Script completed\nWall: 1\nOutput:\n{"output": "x", "exit_code": 2}'}},
            {"payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "passed"}]}},
        ],
    )
    r = transcripts.read_turns(spark, p, "codex").head()
    assert (r.user_text, r.assistant_text) == ("run it", "passed")
    assert [(t.name, t.success, t.objective_kind) for t in r.tools] == [("shell_command", True, "test"), ("exec_command", False, "test")]


def test_gemini_log_is_folded(spark, tmp_path):
    p = write(
        tmp_path / "g.jsonl",
        [
            {"id": "1", "type": "user", "content": "old"},
            {"id": "2", "type": "gemini", "content": "answer"},
            {"$rewindTo": "1"},
            {"id": "3", "type": "user", "content": "new"},
            {"id": "4", "type": "gemini", "content": "draft"},
            {"id": "4", "type": "gemini", "content": "final", "toolCalls": [{"id": "c", "name": "Shell", "args": {"command": "x"}, "status": "error"}]},
        ],
    )
    r = transcripts.read_turns(spark, p, "gemini").head()
    assert (r.user_text, r.assistant_text, r.previous_turn_key) == ("new", "final", None)
    assert [(t.id, t.success) for t in r.tools] == [("c", False)]


def test_codebuddy_follows_the_newest_branch(spark, tmp_path):
    say = lambda i, parent, role, text: {"id": i, "parentId": parent, "type": "message", "role": role, "content": [{"type": "text", "text": text}]}
    p = write(tmp_path / "b.jsonl", [say("1", None, "user", "q"), say("2", "1", "assistant", "dropped"), say("3", "1", "assistant", "kept")])
    r = transcripts.read_turns(spark, p, "codebuddy").head()
    assert (r.user_text, r.assistant_text) == ("q", "kept")


def test_gemini_steps_in_order(spark, tmp_path):
    say = lambda i, text, kind="gemini": {"id": i, "type": kind, "content": text}
    cases = {
        "batch": ([{"messages": [say("1", "a", "user"), say("2", "b")]}, {"messages": [say("2", "c"), say("3", "d")]}], ["a", "c", "d"]),
        "checkpoint": ([say("1", "x", "user"), {"$set": {"messages": [say("5", "q", "user"), say("6", "r")]}}, say("7", "s")], ["q", "r", "s"]),
        "unknown": ([say("1", "x", "user"), {"$rewindTo": "9"}, say("2", "y", "user"), say("3", "z")], ["y", "z"]),
        "again": ([say("1", "x", "user"), say("2", "y"), {"$rewindTo": "2"}, say("3", "z"), say("2", "w"), {"$rewindTo": "2"}], ["x", "z"]),
    }
    for name, (items, _) in cases.items():
        write(tmp_path / f"{name}.jsonl", [*items, "not an object"])
    got = transcripts.gemini(transcripts.tails(spark, str(tmp_path))).orderBy("path", "n").collect()
    for name, (_, want) in cases.items():
        assert [r.text for r in got if r.path.endswith(f"{name}.jsonl")] == want


def test_codebuddy_internal_entries_and_cycles(spark, tmp_path):
    say = lambda i, parent, role, text, **more: {"id": i, "parentId": parent, "type": "message", "role": role, "content": [{"type": "text", "text": text}]} | more
    hidden = {"providerData": {"isCompactInternal": True}}
    one = write(tmp_path / "one.jsonl", [say("1", None, "user", "q"), say("2", "1", "user", "summary", **hidden), say("3", "2", "assistant", "kept"), say("4", "3", "assistant", "inner", **hidden)])
    r = transcripts.read_turns(spark, one, "codebuddy").head()
    assert (r.user_text, r.assistant_text) == ("q", "kept")
    two = write(tmp_path / "two.jsonl", [say("1", "2", "user", "q"), say("2", "1", "assistant", "a")])
    lines = transcripts.tails(spark, two)
    assert transcripts.codebuddy(lines).count() == 0
    assert [x.reason for x in transcripts.dead_letters(lines).collect()] == ["branch_contains_a_cycle"]
    roots = write(tmp_path / "three.jsonl", [say("1", None, "user", "old"), {"id": "2", "logicalParentId": "1", "type": "message", "role": "user", "content": "new"}, say("3", "2", "assistant", "a"), say("9", "8", "user", "lost"), say("4", "3", "assistant", "b")])
    r = transcripts.read_turns(spark, roots, "codebuddy").head()
    assert (r.user_text, r.assistant_text) == ("new", "a\nb")


def test_identity_is_stable(spark, tmp_path):
    p = write(tmp_path / "c.jsonl", [{"type": "user", "uuid": "u", "message": {"role": "user", "content": "hello"}}])
    one, two = (transcripts.compilation_identity(transcripts.read_turns(spark, p, "claude")).head().manifest_hash for _ in range(2))
    assert one == two


def test_chunks(spark):
    rows = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None), (4, "é" * 6)], "id long, text string")
    got = sorted((r.id, r.chunk, r.text) for r in corpora.chunks(rows, 3).collect())
    assert got == [(1, 0, "abc"), (1, 1, "def"), (1, 2, "g"), (2, 0, ""), (3, 0, ""), (4, 0, "ééé"), (4, 1, "ééé")]


def test_dialogue_sets(spark, tmp_path):
    sample = [{"sample_id": "s", "conversation": {"speaker_a": "A", "session_1": [{"speaker": "A", "text": "hi", "dia_id": "D1:1"}], "session_1_date_time": "x"},
               "qa": [{"question": "q?", "answer": "a", "evidence": ["D1:1"], "category": 5}]}]
    (tmp_path / "l.json").write_text(json.dumps(sample))
    records, cases = corpora.dialogue_sets(spark, str(tmp_path / "l.json"))
    assert [(r.id, r.content) for r in records.collect()] == [("s:D1:1", "A: hi")]
    assert [(r.query_id, r.evidence) for r in cases.collect()] == [("s-0", ["D1:1"])]


def test_haystacks(spark, tmp_path):
    row = [{"question_id": "q_abs", "question_type": "t", "question": "?", "answer": "", "haystack_sessions": [[{"role": "user", "content": "abcdef"}]],
            "haystack_dates": ["2023/05/20 (Sat) 02:21"], "haystack_session_ids": ["h1"], "answer_session_ids": []}]
    (tmp_path / "h.json").write_text(json.dumps(row))
    parts, cases = corpora.haystacks(spark, str(tmp_path / "h.json"), 8)
    assert [(r.chunk, r.text) for r in parts.orderBy("chunk").collect()] == [(0, "user: ab"), (1, "cdef")]
    assert str(parts.head().created_at) == "2023-05-20 02:21:00" and cases.head().abstain


def test_cases_are_validated(spark, tmp_path):
    p = write(tmp_path / "cases.jsonl", [{"case_id": "a", "query": "x"}, {"case_id": "b"}, {"case_id": "b"}, "{broken", {"query": "no id"}])
    schema = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("query", T.StringType())])
    valid, rejected = corpora.cases_jsonl(spark, p, schema)
    assert [r.case_id for r in valid.collect()] == ["a"]
    assert sorted(r.reason for r in rejected.collect()) == ["no_key", "repeated_key", "repeated_key", "unparsed"]


@pytest.mark.parametrize("value", ["2023/05/20 (Sat) 02:21"])
def test_source_dates(spark, value):
    df = spark.createDataFrame([(value,)], "t string").select(corpora.source_date(F.col("t")).alias("x"))
    assert str(df.head().x) == "2023-05-20 02:21:00"
