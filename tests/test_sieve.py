"""The sieve of concepts and the looking up of inflections: one pass over a text, and the same results as without."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.concepts import _NEEDLES, _STARTS, _STEMS, CONCEPTS, concepts, leads
from tidemark.functions.tables import INFLECTIONS
from tidemark.operators import index
from tidemark.plans.snapshots import Snapshots


def test_needles_that_start_words():
    assert leads(r"查询|\bquer(?:y|ies)\b", "quer") and not leads(r"\b(?:compare|compared) fairly\b", "compare")
    assert not leads(r"Codex.{0,20}Claude", "claude") and not leads(r"\bfail closed\b", " closed") and not leads(r"检索", "检索")
    stems = set(_STEMS.values())
    assert not any(a != b and a.startswith(b) for a in stems for b in stems) and all(n.startswith(s) for n, s in _STEMS.items())


def test_one_pass_finds_all_that_a_scan_for_each_needle_finds(spark):
    r = random.Random(4)
    own = [n for key, pattern, _ in CONCEPTS for n in _NEEDLES[key]]
    forms = [alias for _, _, some in CONCEPTS for alias in some]
    odd = ["", " ", "-", "_", "é", "ı", "ſ", "İ", "̇", "K", "词", "\n", "s", "ed", "ies", "(", "🙂", "1"]
    texts = ["".join(f(r.choice(own if r.random() < 0.5 else forms)) + r.choice(odd) for f in r.choices([str, str.upper, str.title], k=r.randint(1, 7))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    got = rows.select("t", concepts(F.col("t"), None).alias("a"), concepts(F.col("t"), None, sifted=True).alias("b")).collect()
    assert [x.t for x in got if x.a != x.b] == [] and len({k for x in got for k in x.a}) > 60


def test_the_sieve_reads_a_text_once_for_all_needles_that_start_words(spark):
    plan = spark.range(1).select(concepts(F.col("id").cast("string"), None, sifted=True))._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"(?i)(?<!array_)contains\(", plan)) < sum(map(len, _NEEDLES.values())) - 100 and len(_STARTS) > 500


def test_inflections_are_undone_as_the_map_has_them(spark):
    names = [*INFLECTIONS, *(w.upper() for w in INFLECTIONS), *INFLECTIONS.values(), "Straße", "ledger"]
    rows = spark.createDataFrame([(w,) for w in names], "w string").select("w", tx.normalize_word(F.col("w")).alias("n")).collect()
    fold = lambda w: w.lower().replace("ß", "ss")
    assert all(x.n == INFLECTIONS.get(fold(x.w), fold(x.w)) for x in rows)


def test_a_relation_of_a_commit_is_made_from_those_that_have_been_written(spark, tmp_path):
    made = Snapshots(spark, str(tmp_path / "s"))
    seen = []
    made.commit({"a": spark.range(5), "b": lambda done: seen.append(done["a"].inputFiles()) or done["a"].where("id > 2")}, 0)
    assert sorted(x.id for x in made.read("b", 1).collect()) == [3, 4] and all("/a/" in f for f in seen[0]) and seen[0]


def test_an_index_of_no_records_is_empty(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, title string")
    idx = index.Index.build(rows, "title", path=str(tmp_path / "ix"))
    assert idx.postings.count() == idx.frequencies.count() == idx.n_docs == 0
