import collections
import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import substring_dedup, suffixes

from . import awkward


def brute(rows, length=200):
    seen = collections.Counter(t[p : p + length] for _, t in rows for p in range(len(t) - length + 1))
    out = collections.Counter()
    for i, t in rows:
        flags = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                flags[p] += 1
                flags[p + length] -= 1
        gone = np.cumsum(flags)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out[i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def rows(seed=1):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passages = [word(n) for n in (199, 200, 201, 260, 700)]
    out = [(i, word(r.randint(0, 300)) + r.choice(passages)[r.randint(0, 30) :] + word(r.randint(0, 300))) for i in range(60)]
    out += [(100, passages[4] + passages[4]), (101, "a" * 1000), (102, "ab" * 300 + "x"), (103, "é" * 150), (104, "x" + "é" * 120)]
    return out + [(105, "y" * 199), (106, None), (107, ""), (100, passages[4] + passages[4]), (None, passages[3])]


def result(df):
    return collections.Counter(
        (r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()
    )


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 2])
def test_equals_brute_force(spark, hot):
    own = rows() + [(i, t) for i, t, _, _ in awkward.ROWS if t is None or len(t) < 10_000]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    assert result(substring_dedup.deduplicate(docs, hot=hot)) == brute([(i, (t or "").encode()) for i, t in own])


def test_texts_over_a_part(spark, monkeypatch):
    texts = [t.encode() for _, t in rows() if t] + [("".join(t or "" for _, t in rows()) * 2).encode()]
    whole = substring_dedup.Runs(texts)
    monkeypatch.setattr(substring_dedup, "PART", 1500)
    cut = substring_dedup.Runs(texts)
    # the strings are the same, though a part's end may cut a run in two
    places = lambda r: {(i, s + k) for i, s, n in zip(r.row.tolist(), r.start.tolist(), r.n.tolist()) for k in range(n)}
    assert places(cut) == places(whole) == {(i, p) for i, t in enumerate(texts) for p in range(len(t) - 199)}


def test_awkward_rows(spark):
    got = substring_dedup.report(awkward.documents(spark)).collect()
    assert len(got) == len(awkward.ROWS)
    assert all(r.n_removed == r.n_bytes for r in got if r.doc_id in (7, 8))
    assert substring_dedup.report(awkward.empty(spark)).count() == 0


def test_cover_has_every_difference():
    assert {(a - b) % suffixes.V for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.V))


def test_suffixes_are_sorted_even_with_long_ties():
    r = random.Random(2)
    for letters, n in (("ab", 900), ("abcdefgh", 900), ("a", 600)):
        part = "".join(r.choice(letters) for _ in range(n)).encode()
        text = part + part[100:] + b"z" + part
        places = np.arange(len(text) - 300)
        order = suffixes.Block(text).sort(np.zeros(len(places), int), places)
        assert [text[p : p + 256] for p in places[order]] == sorted(text[p : p + 256] for p in places)


def test_repeats_within_buckets():
    r = random.Random(3)
    part = bytes(r.choice(b"abc") for _ in range(400))
    text = part + b"-" + part[50:350] + b"=" + part[:260]
    places = np.arange(len(text) - 199)
    bucket = np.array([text[p + 5] for p in places])
    seen = collections.Counter(text[p : p + 200] for p in places)
    assert suffixes.repeated(text, bucket, places, 200).tolist() == [seen[text[p : p + 200]] > 1 for p in places]


def test_structured_texts_do_not_make_both_hashes_fail():
    """Sums modulo a power of two cannot tell a Thue-Morse word from its complement; sums modulo a prime can."""
    word = np.array([bin(i).count("1") % 2 for i in range(2048)], np.uint8)
    own, other = word + 97, 98 - word
    start, end = np.array([0]), np.array([2048])
    one = [substring_dedup._hash(substring_dedup._sums(x), start, end)[0] for x in (own, other)]
    two = [substring_dedup.PrimeHash(x).of(start, end)[0] for x in (own, other)]
    assert one[0] == one[1] and two[0] != two[1]


def test_prime_hashes_equal_plain_arithmetic():
    data = np.frombuffer(b"some bytes, some bytes", np.uint8)
    found = substring_dedup.PrimeHash(data).of(np.array([0, 12, 1]), np.array([10, 22, 22]))
    p = (1 << 31) - 1
    for k, base in enumerate(substring_dedup._PRIME_BASES):
        numbers = [(int(x) >> 2) % p for x in substring_dedup._powers()[2][k + 1]]
        want = [sum(numbers[c] * pow(base, i, p) for i, c in enumerate(data[a:b].tolist())) % p for a, b in ((0, 10), (12, 22), (1, 22))]
        assert [int(x) >> 31 * (1 - k) & p for x in found] == want
