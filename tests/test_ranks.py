"""Values at a rank, without a buffer of all values, and counts of turns without a row for each count."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.operators.metrics import at_ranks, nearest_rank, reuse_metrics


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_those_of_percentile_disc(spark):
    rng = random.Random(7)
    rows = [(g, rng.choice([None, 5.0, -1.5, rng.random(), rng.random() * 1e9])) for g in ("a", "b", None) for _ in range(400)] + [("c", None), ("d", 2.0), ("e", float("inf")), ("e", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = at_ranks(df, "x", {"p50": 0.5, "p95": 0.95, "p0": 0.0}, "g")
    want = df.where("x is not null").groupBy("g").agg(*[nearest_rank("x", p).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p0", 0.0))])
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert "percentile" not in _plan(got).lower()
    one = at_ranks(df, "x", {"p50": 0.5}).collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in df.agg(nearest_rank("x", 0.5)).collect()]
    assert at_ranks(df.limit(0), "x", {"p50": 0.5}).collect()[0].p50 is None


def test_turns_are_counted_without_expanding_items(spark):
    item = "struct<knowledge_id:long,emitted:boolean,citation_observed:boolean>"
    rows = [(1, 5.0, [(7, True, True), (8, False, None)]), (2, 6.0, [(7, True, False)]), (3, None, []), (None, 9.0, [(9, True, True)])]
    out = reuse_metrics(spark.createDataFrame(rows, f"id long, retrieval_ms double, items array<{item}>"))
    assert "Expand" not in _plan(out)
    r = out.head()
    assert (r.turns, r.retrieved, r.emitted, r.turns_emitted, r.turns_cited, r.records_emitted, r.retrieval_p50_ms) == (3, 4, 3, 2, 1, 2, 6.0)
