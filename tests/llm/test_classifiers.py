import random
import zlib

import numpy as np

from tidemark.llm import langid, quality
from tidemark.llm.grams import Grams
from tidemark.llm.sampling import bounded

from . import awkward

SYLLABLES = {"en": ["the", "ing", "and", "of", "wh"], "de": ["sch", "ung", "der", "ein", "über"], "fr": ["eau", "le", "que", "tion", "é"]}
held_out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=400, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 60))]
        good = r.random() < 0.7
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), lang, "s"))
        labels.append((i, int(good)))
    return rows, labels


def test_languages_are_recognised_in_the_held_out_fold(spark):
    rows, _ = corpus()
    got = {r.doc_id: r for r in langid.report(awkward.documents(spark, rows)).collect()}
    checked = [i for i, *_ in rows if held_out(i)]
    assert all(got[i].held_out == held_out(i) for i, *_ in rows)
    assert np.mean([got[i].lang_pred == rows[i][2] for i in checked]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_and_source_of_a_row_do_not_matter(spark):
    rows, _ = corpus(150)
    other = [(i, t, "zz" if held_out(i) else a, "other") for i, t, a, _ in rows]
    one = {r.doc_id: r for r in langid.report(awkward.documents(spark, rows)).collect()}
    two = {r.doc_id: r for r in langid.report(awkward.documents(spark, other)).collect()}
    assert one == two


def test_awkward_rows_for_languages(spark):
    got = langid.report(awkward.documents(spark)).collect()
    assert len(got) == len(awkward.ROWS)
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 6)} == {"und"}
    assert langid.report(awkward.empty(spark)).count() == 0
    kept = langid.keep_recognised(awkward.documents(spark), 0.0)
    assert kept.columns == awkward.documents(spark).columns and {3, 4, 5, 6}.isdisjoint(r.doc_id for r in kept.collect())


def test_temperature_mends_overconfidence():
    r = np.random.default_rng(1)
    truth = r.integers(0, 3, 2000)
    z = np.eye(3)[truth] + r.normal(0, 1, (2000, 3))
    assert abs(langid.temperature_of(z * 8, truth) / (8 * langid.temperature_of(z, truth)) - 1) < 0.05


def test_leader_weights_are_sparse():
    r = np.random.default_rng(2)
    rows = [(np.sort(r.choice(500, 20, replace=False)), np.full(20, 0.2), int(r.integers(2))) for _ in range(200)]
    rows = [(np.append(a, 500 + y), np.append(x, 1.0), y) for a, x, y in rows]
    w = langid.follow_the_leader(rows, 502, 2, l1=0.5)
    assert (w[:500] == 0).mean() > 0.5 and w[500, 0] > 0 > w[500, 1]


def test_quality_in_the_held_out_fold(spark):
    rows, labels = corpus()
    docs = awkward.documents(spark, rows)
    got = {r.doc_id: r for r in quality.report(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    checked = [(i, y) for i, y in labels if held_out(i)]
    assert np.mean([got[i].predicted == y for i, y in checked]) >= 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())


def test_awkward_rows_for_quality(spark):
    labels = spark.createDataFrame([(1, 1), (9, 0), (9, 1), (7, None), (None, 1), (12, 5)], "doc_id long, quality int")
    got = quality.report(awkward.documents(spark), labels).collect()
    assert len(got) == len(awkward.ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.report(awkward.empty(spark), labels).count() == 0
    none = quality.report(awkward.documents(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_sample_is_bounded_and_fixed(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    one = {r.doc_id for r in bounded(rows, 500, "doc_id").collect()}
    assert 350 < len(one) < 650
    assert one == {r.doc_id for r in bounded(rows.repartition(7), 500, "doc_id").collect()}


def test_features_do_not_depend_on_batch_or_chunk(monkeypatch):
    from tidemark.llm import grams

    own = Grams(orders=(1, 2, 3), bits=12, only_letters=True)
    table = np.random.default_rng(3).normal(size=(own.size, 2))
    texts = ["abc def", "", None, "über straße", "x" * 5000 + " yz"]
    whole = own.sums(texts, table)
    for alone, t in enumerate(texts):
        assert np.allclose(own.sums([t], table)[0], whole[0][alone])
    monkeypatch.setattr(grams, "CHUNK", 64)
    parts = own.sums(texts, table)
    assert np.allclose(parts[0], whole[0]) and (parts[1] == whole[1]).all()


def test_quality_learns_from_all_of_its_sample():
    import inspect

    assert quality.SAMPLE == 4000 and inspect.signature(quality.train).parameters["epochs"].default == 12


def test_a_rare_language_has_a_class(spark):
    rows = [(i, f"the and of {i}", "en", "s") for i in range(4000)] + [(4001, "zyx qwv zyx", "xx", "s"), (4002, "zyx qwv", "xx", "s"), (4003, "qwv zyx zyx", "xx", "s")]
    docs = awkward.documents(spark, rows)
    model = langid.fit(docs, sample=40)
    assert model.languages == ["en", "xx"] and model.predict(["zyx qwv qwv"])[0] == ["xx"]


MASK, MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15


def plain_features(own, text):
    """All features of a text by the definition, one at a time, in Python's own integers."""
    points = [ord(c) for c in (text.lower() if own.only_letters else text)]
    if own.only_letters:
        points = [p if chr(p).isalpha() else 32 for p in points]
    out = []
    for a in range(len(points)):
        h = 0
        for k in range(1, max(own.orders) + 1):
            h = (h + (points[a + k - 1] if a + k <= len(points) else 32) + k) * MIX & MASK
            h ^= h >> 29
            if k in own.orders:
                out.append((h * MIX & MASK) >> 64 - own.bits)
    word = []
    for p in [*points, 32] if own.words else []:
        if p > 32:
            word.append(p)
        elif word:
            total = 0
            for i, q in enumerate(word):
                v = (q + 7) * (2 * i + 1) * MIX & MASK
                total += (v ^ v >> 31) * MIX
            out.append((total * MIX & MASK) >> 64 - own.bits)
            word = []
    return out


WORDY = ["", "one", " two  words ", "x" * 700, "a " + "y" * 130 + " b", "ends in a" + "z" * 64, "w" * 64 + " " + "v" * 63 + " " + "u" * 65, "über straße\tund " * 30, "p" * 64 + "q" * 64 + " r"]


def test_features_equal_those_found_one_by_one_whatever_the_chunks(monkeypatch):
    from collections import Counter

    from tidemark.llm import grams

    for own in (Grams(orders=(2, 3, 4), bits=14, words=True), Grams(orders=(1, 2, 3), bits=12, only_letters=True)):
        want = [Counter(plain_features(own, t)) for t in WORDY]
        for chunk, block in ((1 << 18, 1 << 19), (64, 128), (7, 1000), (1, 5)):
            monkeypatch.setattr(grams, "CHUNK", chunk)
            monkeypatch.setattr(grams, "BLOCK", block)
            assert [dict(zip(a.tolist(), n.tolist())) for a, n in own.bags(WORDY)] == want


def test_a_word_over_a_chunks_edge_is_one_word():
    from tidemark.llm.grams import CHUNK

    text = "ab " * (CHUNK // 3 - 1) + "straddles the edge"
    assert len(text) > CHUNK > text.index("straddles")
    own = Grams(orders=(2,), bits=16, words=True)
    at, n = own.bags([text])[0]
    assert n.sum() == len(text) + len(text.split())


def test_quality_equals_plain_descent(spark):
    """The model, trained one number at a time in plain Python, gives the same scores."""
    own, dim, epochs, rate = Grams(orders=(2, 3), bits=7, words=True), 4, 3, 5.0
    rows = [(i, t, "en", "s") for i, t in enumerate(["good words here", "BAD!! WORDS!!", "fine text", "!!! x", "more good text", "", "WORSE!!", "fine words"])]
    labels = [(i, int(not ("!" in t or not t))) for i, t, *_ in rows]
    docs = awkward.documents(spark, rows)
    model = quality.train([(y, *own.bags([rows[i][1]])[0]) for i, y in labels], own, dim, epochs, rate)
    got = {r.doc_id: r.score for r in quality.annotate(docs, model).selectExpr("doc_id", "score").collect()}
    random_ = np.random.default_rng(5)
    vectors = [[float(x) for x in v] for v in random_.uniform(-1 / dim, 1 / dim, (own.size, dim)).astype(np.float32)]
    layer, bias = [[float(x) for x in v] for v in random_.normal(0, 0.1, (dim, 2))], [0.0, 0.0]
    bags = [plain_features(own, t) for _, t, *_ in rows]
    mean = lambda b: [sum(vectors[f][d] for f in b) / max(1, len(b)) for d in range(dim)]
    step = 0
    for _ in range(epochs):
        for i in random_.permutation(len(rows)):
            own_rate, bag, x = rate * (1 - step / (epochs * len(rows))), bags[i], mean(bags[i])
            step += 1
            z = [sum(x[d] * layer[d][c] for d in range(dim)) + bias[c] for c in (0, 1)]
            p = [1 / (1 + np.exp(z[1 - c] - z[c])) - (c == labels[i][1]) for c in (0, 1)]
            back = [sum(layer[d][c] * p[c] for c in (0, 1)) for d in range(dim)]
            for d in range(dim):
                for c in (0, 1):
                    layer[d][c] -= 0.1 * own_rate * x[d] * p[c]
            bias = [bias[c] - 0.01 * own_rate * p[c] for c in (0, 1)]
            shares = {f: bag.count(f) / len(bag) for f in bag}
            square = sum(s * s for s in shares.values())
            for f, s in shares.items():
                vectors[f] = [v - own_rate / square * s * 0.1 * b for v, b in zip(vectors[f], back)]
    for i, bag in enumerate(bags):
        x = mean(bag)
        z = [sum(x[d] * layer[d][c] for d in range(dim)) + bias[c] for c in (0, 1)]
        assert abs(got[i] - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-4


def test_language_weights_equal_plain_follow_the_leader(spark):
    """Document frequencies, weights and probabilities, one number at a time in plain Python."""
    own = Grams(orders=(1, 2), bits=6, only_letters=True)
    texts = ["the and of", "und der die", "the of", "der und", "and the", "die der", None, "of and the the"]
    rows = [(i, t, ("en", "de")[i % 2], "s") for i, t in enumerate(texts)]
    docs = awkward.documents(spark, rows)
    bags = [plain_features(own, t or "") for t in texts]
    seen, total = langid.document_frequencies(docs, own, "text")
    assert total == len(texts) and seen.tolist() == [sum(f in b for b in bags) for f in range(own.size)]
    examples = [([*sorted(set(b)), own.size], {**{f: 3.0 * b.count(f) / len(b) for f in b}, own.size: 1.0}, i % 2) for i, b in enumerate(bags)]
    got = langid.follow_the_leader([(np.array(at), np.array([x[f] for f in at]), y) for at, x, y in examples], own.size + 1, 2)
    z = {(f, c): 0.0 for f in range(own.size + 1) for c in (0, 1)}
    n = dict(z)
    weight = lambda k: 0.0 if abs(z[k]) <= 0.02 else -(z[k] - np.sign(z[k]) * 0.02) / ((1 + n[k] ** 0.5) / 0.5 + 0.1)
    random_ = np.random.default_rng(11)
    for _ in range(4):
        for i in random_.permutation(len(examples)):
            at, x, y = examples[i]
            w = {(f, c): weight((f, c)) for f in at for c in (0, 1)}
            score = [sum(x[f] * w[f, c] for f in at) for c in (0, 1)]
            p = [1 / (1 + np.exp(score[1 - c] - score[c])) for c in (0, 1)]
            for f in at:
                for c in (0, 1):
                    g = x[f] * (p[c] - (c == y))
                    z[f, c] += g - ((n[f, c] + g * g) ** 0.5 - n[f, c] ** 0.5) / 0.5 * w[f, c]
                    n[f, c] += g * g
    assert np.allclose(got, [[weight((f, c)) for c in (0, 1)] for f in range(own.size + 1)], atol=1e-9)
    model = langid.Model(["en", "de"], got[:-1].astype(np.float32), got[-1], 1.7, own)
    found = {r.doc_id: r for r in langid.annotate(docs, model).selectExpr("doc_id", "lang_pred", "score").collect()}
    for i, b in enumerate(bags):
        if b:
            s = [(sum(got[f, c] for f in b) / len(b) + got[-1, c]) / 1.7 for c in (0, 1)]
            assert found[i].lang_pred == model.languages[int(s[1] > s[0])] and abs(found[i].score - 1 / (1 + np.exp(-abs(s[0] - s[1])))) < 1e-5
