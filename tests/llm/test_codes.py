import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import codes


def plain(rows, entries=64, parts=16, rounds=2):
    """(vec_id, label, vector) rows by the definition, one number at a time."""
    kept = [(i, label, [max(-(1 << 62), min(1 << 62, math.floor(x * 256))) for x in v], v) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    fit = [r for r in order if r[2] and len(r[2]) % parts == 0]
    if not fit:
        return [], hashlib.sha256(b"").hexdigest()
    width = len(fit[0][2]) // parts
    fit = [r for r in fit if len(r[2]) == width * parts]
    cut = lambda q, p: q[p * width : (p + 1) * width]
    books = [[cut(r[2], p) for r in fit[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        moved = []
        for p, book in enumerate(books):
            own = {}
            for r in fit:
                own.setdefault(nearest(cut(r[2], p), book)[1], []).append(cut(r[2], p))
            moved.append([[sum(x) // len(own[e]) for x in zip(*own[e])] if e in own else entry for e, entry in enumerate(book)])
        books = moved
    out, labels = [], {}
    for i, label, q, _ in kept:
        if len(q) == width * parts:
            found = [nearest(cut(q, p), books[p]) for p in range(parts)]
            out.append([i, "".join(f"{e:02x}" for _, e in found), min(sum(d for d, _ in found), (1 << 63) - 1), label])
            labels[label] = min(labels.get(label, 0) + out[-1][2], (1 << 63) - 1)
        else:
            out.append([i, None, None, label])
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, error, labels.get(label), digest) for i, code, error, label in out], digest


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("own") for c in ("code", "error", "part", "entry")})


def got(spark, rows):
    return sorted(map(repr, map(tuple, codes.report(frame(spark, rows)).collect())))


def same(spark, rows):
    want = plain(rows)[0]
    assert got(spark, rows) == sorted(map(repr, want))
    return want


def test_equals_the_definition(spark):
    r = random.Random(3)
    centres = [[r.gauss(0, 0.3) for _ in range(64)] for _ in range(5)]
    rows = [(i * 3, r.choice([None, 0, 1]), [x + r.gauss(0, 0.05) for x in r.choice(centres)]) for i in range(300)]
    assert len({x[1] for x in same(spark, rows)}) > 100


def test_ties_take_the_lowest_index(spark):
    r = random.Random(4)
    rows = [(i, 0, [r.choice([-1.0, 0.0, 1.0]) / 256 for _ in range(32)]) for i in range(200)]
    same(spark, rows)


def test_awkward_rows(spark):
    r = random.Random(5)
    vector = lambda n=16: [r.uniform(-1, 1) for _ in range(n)]
    twice = vector()
    rows = [(1, 1, None), (2, 1, [None] * 16), (3, 1, [math.nan] * 16), (4, 1, [math.inf] + vector(15)), (5, None, vector()), (None, 2, vector())]
    rows += [(6, 2, twice), (6, 2, twice), (6, 3, vector()), (7, 3, vector(32)), (8, 3, vector(5)), (9, 3, []), (10, None, vector()), (11, 4, [])]
    same(spark, rows)


def test_very_large_components(spark):
    r = random.Random(6)
    rows = [(i, i % 2, [r.uniform(-1, 1) * 10.0 ** r.choice([0, 3, 6, 9, 30]) for _ in range(16)]) for i in range(90)]
    same(spark, rows)


def test_empty(spark):
    assert codes.report(frame(spark, [])).count() == 0
    assert codes.report(frame(spark, [(1, 1, None)])).count() == 0
    assert got(spark, [(1, 1, [0.5])]) == [repr((1, None, None, None, hashlib.sha256(b"").hexdigest()))]


def test_partial_distance_finds_what_full_distances_do():
    r = np.random.default_rng(7)
    for width, size in ((1, 5), (4, 64), (7, 33)):
        for spread in (2, 50, 100_000):
            points, entries = r.integers(-spread, spread, (400, width)), r.integers(-spread, spread, (size, width))
            full = ((points[:, None, :] - entries) ** 2).sum(axis=2)
            index, distance = codes.nearest(points, entries)
            assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
            assert [codes.nearest_exactly(p, entries.tolist()) for p in points[:50].tolist()] == list(zip(index[:50].tolist(), distance[:50].tolist()))


def test_encode_keeps_other_columns(spark):
    rows = [(i, i % 3, [float(i + j) / 100 for j in range(16)]) for i in range(20)]
    own = frame(spark, rows).drop("code", "error")
    books = codes.fit(own, entries=8)
    found = codes.encode(own, books)
    assert found.columns == ["vec_id", "label", "part", "entry", "code", "error"] and found.count() == 20
    assert books.dimension == 16 and len(books.entries[0]) == 8
