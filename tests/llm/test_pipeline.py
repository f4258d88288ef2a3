import base64
import hashlib

import numpy as np
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import exact_dedup
from tidemark.llm.queries import tokenizer

from . import awkward
from .test_decontaminate import brute as contaminated
from .test_exact_dedup import brute as equal
from .test_minhash import brute as similar
from .test_minhash import family


def corpus():
    rows = [(i, t, "en", "s") for i, t in enumerate(family(1, 12) + family(2, 8))]
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows += [(50, f"{passage} and so on", "en", "s"), (51, "1234 !!", "en", "s"), (52, None, "en", "s"), (53, rows[0][1] + "  ", "en", "s")]
    return rows + [(60 + i, f"plain sentence number {w} about another thing altogether {w}", "en", "s") for i, w in enumerate("pqrs")], [(1, passage)]


def test_run_equals_the_stages_by_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [(i, t) for i, t, _, _ in rows if t and any(map(str.isalpha, t))]
    left = [(i, t) for (i, t), d in zip(left, equal(left)) if d[3]]
    classes = {eval(x)[0]: eval(x)[1] for x in similar(left)}
    left = [(i, t) for i, t in left if classes[i] == i]
    hit = contaminated(left, items)
    left = [(i, t) for i, t in left if not hit[i][4]]
    path, pattern = tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = {i: (public.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in left}
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and len(got) < len(rows)


def test_stages_keep_columns_of_awkward_rows(spark, tmp_path):
    spark.createDataFrame([(1, "lazy dog near the")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (awkward.documents(spark), awkward.empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_the_digests_of_exact_dedup_take_one_file_a_bucket_however_many_partitions_there_are(spark, monkeypatch):
    kind, found = type(spark.range(0)), []
    plain, close = kind.repartition, exact_dedup.DigestIndex.close
    monkeypatch.setattr(kind, "repartition", lambda self, n, *by: plain(self, max(n, 131), *by) if by and isinstance(n, int) else plain(self, n, *by))
    monkeypatch.setattr(exact_dedup.DigestIndex, "close", lambda self: (found.append((self.generation, self.files())) if self.name else None, close(self))[1])
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 900).alias("text"))
    assert corpus_pipeline.exact_duplicates(spark, docs, "").count() == 900
    assert found == [(1, exact_dedup.BUCKETS)]
