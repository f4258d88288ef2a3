"""An index is bucketed by record: neither its making nor scoring exchanges postings."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import index

TEXTS = [(1, "red fox red"), (2, ""), (3, None), (4, "fox, Fox; den"), (5, "-- !"), (6, "den")]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_counted_in_their_rows(spark):
    rows = spark.createDataFrame(TEXTS, "id long, text string")
    got = index.postings(rows, text=F.col("text"), places=True)
    assert "Exchange" not in _plan(got) and "Aggregate" not in _plan(got)
    want = {}
    for i, text in TEXTS:
        words = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
        for term, n in Counter(words).items():
            want[i, term] = (n, len(words), [p for p, w in enumerate(words) if w == term])
    assert {(r.id, r.term): (r.tf, r.doc_len, r.places) for r in got.collect()} == want


def test_scores_are_summed_inside_of_buckets(spark):
    idx = index.Index.build(spark.createDataFrame(TEXTS, "id long, text string"), "text")
    terms = spark.createDataFrame([(1, "fox"), (1, "den"), (2, "red")], "query_id long, term string")
    got = idx.scores(terms)
    # the only exchange is the broadcast of the query's terms
    assert "Exchange hashpartitioning" not in _plan(got)
    assert {(r.query_id, r.id) for r in got.collect()} == {(1, 1), (1, 4), (1, 6), (2, 1)}
