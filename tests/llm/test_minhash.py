import random

import numpy as np
import pyarrow as pa

from tidemark.llm import minhash
from tidemark.llm.components import connected

from . import awkward


def brute(rows):
    """Classes by all pairs: the least id (null last) of each connected component of similarity 0.8 or more."""
    bags = [minhash.bag(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bags[a] and bags[b] and minhash.similarity(bags[a], bags[b]) >= 0.8:
                top[root(a)] = root(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {g: min(own, key=lambda x: (x is None, x or 0)) for g, own in groups.items()}
    return sorted(repr((rows[i][0], least[root(i)], len(groups[root(i)]))) for i in range(len(rows)))


def family(seed=1, size=40, words=90):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(words)] = f"w{r.randint(0, 5000)}"
        out.append(" ".join(own))
    return out


def test_signatures_estimate_weighted_jaccard():
    a, b = np.array([1, 1, 3, 7, 2, 0, 5]), np.array([1, 2, 3, 3, 0, 4, 6])
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    found = []
    for s in range(40):
        element = minhash.mix(np.arange(7, dtype=np.uint64) + np.uint64(100 * s + 1))
        doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        sig = minhash.bag_minhash(doc, np.concatenate((element[a > 0], element[b > 0])), np.concatenate((a[a > 0], b[b > 0])), 2)
        found.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(found) - truth) < 0.03


def test_signature_depends_on_the_text_alone():
    texts = family(3, 6)
    batch = lambda own: pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int64()), pa.array(range(len(own)), pa.int64()), pa.array(own)], ["i", "h", "t"])
    together = next(minhash._sketch(iter([batch(texts)]))).column(3).to_pylist()
    alone = [next(minhash._sketch(iter([batch([t])]))).column(3).to_pylist()[0] for t in texts]
    assert together == alone


def test_overlaps_are_those_of_multisets():
    texts = family(4, 12) + ["a a a a a a a a", "a a a a a a", "a b c", ""]
    sets = [minhash.expanded(t) for t in texts]
    got = minhash.overlaps(sets[:5], sets[5:], width=16)
    for i in range(5):
        for j in range(5, len(sets)):
            assert got[i, j - 5] == sum((minhash.bag(texts[i]) & minhash.bag(texts[j])).values())


def test_classes_equal_all_pairs(spark):
    rows = [(i, t) for i, t in enumerate(family(1) + family(2, 25) + family(1)[:5])]
    rows += [(100 + i, t) for i, t in enumerate(["one two three", "One, two: three!", "one two", "", None, "***", "a b c d e", "a b c d e"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(repr((r.doc_id, r.class_id, r.class_size)) for r in minhash.report(docs).collect())
    assert got == brute([(i, t or "") for i, t in rows])


def test_small_blocks_lose_no_link(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(family(7, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = minhash.links
    monkeypatch.setattr(minhash, "links", lambda n, t, th: whole(n, t, th, 8))
    got = sorted(repr((r.doc_id, r.class_id, r.class_size)) for r in minhash.report(docs).collect())
    assert got == brute(rows)


def test_awkward_rows(spark):
    docs = awkward.documents(spark)
    got = sorted(repr((r.doc_id, r.class_id, r.class_size)) for r in minhash.report(docs).collect())
    assert got == brute(awkward.texts())
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert ids == [-1, -1, 1, 3, 4, 5, 6, 7, 9, 10, 12]
    assert minhash.report(awkward.empty(spark)).count() == 0
    assert minhash.keep_one(awkward.empty(spark)).count() == 0


def test_components_of_a_chain_a_ring_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)] + [(200, 200 + i) for i in range(1, 20)] + [(7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, **{200 + i: 200 for i in range(20)}}
