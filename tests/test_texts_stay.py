"""Whole texts are exchanged only for those who ask for them, and a result of few rows that is read several times is found once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import text as tx
from tidemark.functions.parsers import holds_literally
from tidemark.operators import index, projections
from tidemark.plans import staging
from tidemark.sources import adapters as src

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_what_is_read_of_texts_is_made_before_labels_are_met(spark):
    kr = src.knowledge_records(spark, SF, digest=tx.record_digest(F.col("title"), F.col("content")))
    plan = _plan(kr.select("id", "status", "title", "digest"))
    above, below = plan[: plan.index("Join")], plan[plan.index("Join") :]
    assert "sha2(" in below and "regexp_extract(" in below and "sha2(" not in above and "regexp_extract(" not in above
    assert "labels" not in "".join(src.record_texts(spark, SF).inputFiles())


def _texts(seed: int):
    r = random.Random(seed)
    words = ["red", "reds", "tired", "fox", "den", "ox", "a", "éa", "."]
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(40)]


def test_quotes_of_too_many_candidates_are_looked_for_without_exchanging_texts(spark, monkeypatch):
    for module in (index, staging):
        monkeypatch.setattr(module, "FEW", 5, raising=False)
    texts = _texts(3)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    idx = index.Index.build(rows, "text")
    quotes = ["red", "a", "x ", "red fox", " ", "den den", "zebra", "ire"]
    asked = spark.createDataFrame(list(enumerate(quotes)), "query_id long, quote string")
    found = index.containing(asked, rows, idx)
    want = sorted((q, i) for q, own in enumerate(quotes) for i, t in enumerate(texts) if own in t)
    assert sorted((x.query_id, x.id) for x in found.collect()) == want and len(want) > 60
    frequent = index.containing(asked.where("quote in ('red', 'a')"), rows, idx)
    plan = frequent._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" in plan and "Exchange hashpartitioning" not in plan
    assert sorted((x.query_id, x.id) for x in frequent.collect()) == [x for x in want if x[0] < 2]


@pytest.mark.parametrize("few", [5, 200_000])
def test_pairs_are_told_of_where_they_are_verified(spark, monkeypatch, few):
    for module in (index, staging):
        monkeypatch.setattr(module, "FEW", few, raising=False)
    rows = spark.createDataFrame([(1, "Red fox. Then den!"), (2, "red fox. then DEN"), (3, "Red fox. no"), (4, "other")], "id long, text string")
    asked = spark.createDataFrame([(1, "Red fox.", "then den"), (2, "ed", "x"), (3, "none", "x"), (4, "", "x")], "query_id long, quote string, answer string")
    held = index.containing(asked, rows, index.Index.build(rows, "text"), told={"holds": holds_literally("text", "answer")})
    got = {(x.query_id, x.id): x.holds for x in held.collect()}
    assert got == {(1, 1): True, (1, 3): False, (2, 1): False, (2, 2): False, (2, 3): False}
    outcomes = projections.retention_audit(asked.select("query_id"), held)
    assert {x.outcome: x.cases for x in outcomes.collect()} == {"answer_kept": 1, "evidence_kept": 1, "lost": 2}


@pytest.mark.parametrize("name", ["ablation_summary", "ablation_arms", "naive_vs_gated"])
def test_arms_and_what_they_should_find_are_found_once(spark, monkeypatch, name):
    calls, own = [], catalog._quoting
    monkeypatch.setattr(catalog, "_quoting", lambda *a, **k: calls.append(a) or own(*a, **k))
    assert not any("documents" in f for f in catalog.queries()[name](spark, SF).inputFiles())
    assert len(calls) == 1
