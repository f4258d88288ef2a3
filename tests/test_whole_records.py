"""Records keep the whole text of long documents."""

import pytest
from pyspark.sql import functions as F

from tidemark import catalog

HEAD = "alpha beta gamma delta " * 400  # over 8000 characters


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("long"))
    texts = {1: "one", 41: "two", 81: "three", 121: "one", 161: "three", 201: "zebrafish quagmire"}
    docs = [(i, HEAD + t, "en", "src0", len(HEAD + t)) for i, t in texts.items()]
    docs += [(i, f"short text {i}", "en", "src0", 14) for i in range(1001, 1021)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(81, 1, 0), (201, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "zebrafish quagmire")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_documents_that_differ_after_8000_characters_are_not_duplicates(spark, tables):
    found = lambda name, *c: {tuple(r[x] for x in c) for r in catalog.queries()[name](spark, tables).collect()}
    assert {i for i, in found("publish_dedup", "id") if i < 1000} == {1, 41, 161, 201}
    assert found("duplicate_evidence", "request_id", "knowledge_id") == {(121, 1), (81, 161)}
    assert found("candidate_body_dedup", "request_id", "knowledge_id") == {(121, 1), (81, 161)}
    assert found("merge_plan", "candidate_id", "target_id") == {(161, 81)}


def test_evidence_ladder_reads_the_end_of_a_long_document(spark, tables):
    assert 201 in {r.id for r in catalog.queries()["evidence_ladder"](spark, tables).collect()}


def test_traces_are_scrubbed_of_more_than_100_removed_records(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([(k, "n", "b", "t", 1 if k <= 250 else 2, 1.0) for k in range(1, 301)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{at}/part.parquet")
    lines = [(1, k, k, "N", 1.0) for k in range(1, 301)] + [(2, k, k, "N", 1.0) for k in range(101, 251)] + [(3, 300, 1, "N", 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber long, l_returnflag string, l_quantity double").withColumn("l_suppkey", F.lit(1)).write.parquet(f"{at}/lineitem.parquet")
    orders = spark.createDataFrame([(i, "F") for i in (1, 2, 3)], "o_orderkey long, o_orderstatus string")
    orders.withColumns({"o_custkey": F.lit(1), "o_orderdate": F.lit("2024-01-01").cast("timestamp"), "o_totalprice": F.lit(1.0)}).write.parquet(f"{at}/orders.parquet")
    assert {r.id: r.n_items for r in catalog.queries()["trace_scrub"](spark, at).collect()} == {1: 50, 2: 0, 3: 1}
