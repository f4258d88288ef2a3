import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup
from tidemark.llm.common import fresh_path

from . import awkward


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i is not None, i if i is not None else 0, i))
    out = []
    for i, t in rows:
        own = re.sub(r"[\x20\x09-\x0D]", "", t)
        keep = min(groups[own])[3]
        out.append((i, keep, len(groups[own]), i == keep, hashlib.sha256(own.encode()).hexdigest()))
    return out


def test_equals_brute_force_on_awkward_rows(spark):
    got = [tuple(r) for r in exact_dedup.deduplicate(awkward.documents(spark)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(awkward.texts())))


def test_index_persists_and_keeps_what_came_first(spark):
    path = fresh_path(spark, "index-test")
    old = spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string")
    exact_dedup.deduplicate(old, exact_dedup.DigestIndex(spark, path, 4), batch="old").collect()
    new = spark.createDataFrame([(1, "ab  "), (2, "d"), (3, "d ")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, path, 4)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(new, index, batch="new").collect()}
    assert got == {1: (5, False), 2: (3, False), 3: (3, True)}
    assert index.rows().count() == 3
    assert "Exchange" not in index.rows().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString().replace("AdaptiveSparkPlan", "")


def test_a_batch_that_is_run_again_gets_the_same_decisions(spark):
    path = fresh_path(spark, "index-again")
    old = spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "ab  "), (2, "d"), (3, "d ")], "doc_id long, text string")
    run = lambda df, b: sorted(map(repr, exact_dedup.deduplicate(df, exact_dedup.DigestIndex(spark, path, 4), batch=b).collect()))
    first = run(old, "monday"), run(new, "tuesday")
    assert (run(old, "monday"), run(new, "tuesday")) == first
    assert exact_dedup.DigestIndex(spark, path, 4).rows().count() == 3
    with pytest.raises(ValueError):
        exact_dedup.deduplicate(new, exact_dedup.DigestIndex(spark, path, 4))


def test_a_delivery_that_comes_again_is_all_duplicates(spark):
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "index-redelivery"), 4)
    kept = lambda rows, b: [r.kept for r in sorted(exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), index, batch=b).collect())]
    rows = [(1, "aa"), (2, "bb")]
    assert kept(rows, "1") == [True, True] and kept(rows, "2") == [False, False]
    assert kept([*rows, (3, "cc")], "3") == [False, False, True] and kept([*rows, (3, "cc")], "3") == [False, False, True]


def test_a_batch_that_failed_half_way_is_finished(spark):
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "index-half"), 4)
    new = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    keyed = exact_dedup.keyed(new).withColumnRenamed("doc_id", "keep_id")
    index.append(keyed.where("keep_id < 15"), "b")
    got = exact_dedup.deduplicate(new, index, batch="b").collect()
    assert all(r.kept for r in got) and len(got) == 40 and index.rows().count() == 40


def test_merged_index_keeps_its_rows(spark):
    path = fresh_path(spark, "index-merge")
    index = exact_dedup.DigestIndex(spark, path, 2)
    for k in range(3):
        exact_dedup.deduplicate(spark.createDataFrame([(i, f"text {i}") for i in range(5 * k, 5 * k + 10)], "doc_id long, text string"), index, batch=str(k))
    before = sorted(map(repr, index.rows().collect()))
    index.merge()
    again = exact_dedup.DigestIndex(spark, path, 2)
    assert index.generation == again.generation == 2 and again.files() == 2
    assert sorted(map(repr, again.rows().collect())) == before and len(before) == 20
    again.vacuum()
    assert again.generations() == [2] and again.rows().count() == 20


def test_a_bucket_gets_one_file_however_many_partitions_there_are(spark, monkeypatch):
    kind = type(spark.range(0))
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *by: plain(self, max(n, 13), *by) if by and isinstance(n, int) else plain(self, n, *by))
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "index-test"), 4)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 300).alias("text"))
    got = exact_dedup.deduplicate(docs, index, batch="a").collect()
    assert index.files() == 4 and index.generation == 1
    assert sum(r.kept for r in got) == index.rows().count() == 300
    index.merge()
    assert index.files() == 4
    assert "Exchange" not in index.known("b")._jdf.queryExecution().executedPlan().toString()
    index.close()


def test_names_of_helper_columns_may_be_the_callers(spark):
    docs = awkward.documents(spark)
    for c in ("__id", "__digest", "__times", "__text_digest", "a.b"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    got = exact_dedup.keep_first(docs)
    assert got.columns == docs.columns and got.count() == 9
    assert {r["__times"] for r in got.collect()} == {"own __times"}


def test_keep_first_keeps_columns_and_one_of_repeated_rows(spark):
    docs = awkward.documents(spark)
    got = exact_dedup.keep_first(docs)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id if r.doc_id is not None else -1) for r in got.collect())
    # doc 1 is there twice; of the empty texts (3, 4, 5, null) the longest is doc 5's, and doc 11 is longer than doc 10
    assert kept == [-1, 1, 2, 5, 6, 7, 9, 11, 12]


def test_empty_table(spark):
    assert exact_dedup.deduplicate(awkward.empty(spark)).count() == 0
    assert exact_dedup.keep_first(awkward.empty(spark)).count() == 0
