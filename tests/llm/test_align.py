import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import align
from tidemark.llm.queries import aligned_tokenizers

from . import awkward


@pytest.fixture(scope="module")
def public():
    """The whole text by the public libraries at once, and the bytes of their tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = aligned_tokenizers()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    letters = align.byte_letters()

    def both(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = map(b.id_to_piece, ids_b)
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        want = (" " + text).encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            return [], []
        return list(zip(ids_a, map(len, bytes_a))), list(zip(ids_b, map(len, bytes_b)))

    return both


def brute(rows, both):
    """Rows of (id, text) by the definition: every pair of tokens whose ranges end together."""
    told = []
    for i, text in rows:
        a, b = both(text or "")
        groups, links, own_a, own_b = [], [], [], []
        ends_b, at = {}, 0
        for k, (t, n) in enumerate(b):
            at += n
            ends_b[at] = (k, t)
        at, done = 0, 0
        for t, n in a:
            at += n
            own_a.append(t)
            if at in ends_b:
                k, other = ends_b[at]
                own_b = [x for x, _ in b[done : k + 1]]
                groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                links.append((t, other))
                own_a, done = [], k + 1
        told.append((i, len(a), len(b), groups, links))
    counts = Counter(x for *_, links in told for x in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (i, a, b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for i, a, b, groups, links in told
    ]


def made(n=60):
    r = random.Random(9)
    pool = ["the", " ", "  ", "\n", "\n\n", "\t", "Straße", "日本語", ".", ",", "1234", "'s", "<|endoftext|>", "<s>", "<0x41>", "\U0001f600", " ", "\r\n", "\x00", "ﬁ", "word", "underneath", "\x1c", "\x85", "▁"]
    return ["".join(r.choice(pool) for _ in range(r.randint(1, 30))) for _ in range(n)] + [" ", "a ", " a", "\n", "a\n b", "x" * 3000, "a" + " " * 40 + "b", "end. "]


def test_chunks_give_the_tokens_of_whole_texts(public):
    own = align.pair(*aligned_tokenizers())
    texts = made(3000) + [t for _, t in awkward.texts()]
    for _ in range(2):  # the second time from what the worker keeps
        sides = [np.split(ids, np.cumsum(n)[:-1]) for ids, n in own.encode(texts)]
        for text, a, b in zip(texts, *sides):
            want_a, want_b = public(text)
            assert a.tolist() == [i for i, _ in want_a] and b.tolist() == [i for i, _ in want_b], repr(text)


def test_a_full_cache_forgets(monkeypatch, public):
    monkeypatch.setattr(align, "CACHE", 500)
    own = align.Pair(*aligned_tokenizers())
    for k in range(40):
        text = f"words number{k} of many{k} kinds{k}"
        (a, _), (b, _) = own.encode([text, None])
        assert [a.tolist(), b.tolist()] == [[i for i, _ in side] for side in public(text)]
    assert own.words.size <= 800 and len(own.words.number) < 20


@pytest.mark.parametrize("bound", [align.BROADCAST_PAIRS, 0])
def test_report_equals_brute_force(spark, public, bound):
    rows = awkward.texts() + [(100 + k, t) for k, t in enumerate(made())]
    docs = awkward.documents(spark, [(i, t, None, None) for i, t in rows])
    got = align.report(docs, *aligned_tokenizers(), broadcast_pairs=bound).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, public)))


def test_empty(spark):
    assert align.report(awkward.empty(spark), *aligned_tokenizers()).count() == 0


def test_groups_and_links_are_columns(spark, public):
    docs = awkward.documents(spark, [(1, "the Straße is underneath 1234", None, None), (2, None, None, None)])
    found = {r.doc_id: r for r in align.groups(align.align(align.tokenise(docs, *aligned_tokenizers()))).collect()}
    assert [x for g in found[1].groups for x in g.a] == found[1].a_ids and [x for g in found[1].groups for x in g.b] == found[1].b_ids
    assert [x >> 32 for x in found[1].links] == [g.a[-1] for g in found[1].groups]
    assert found[2].groups == found[2].links == [] and found[1].n_words == "own n_words"


def test_marks_and_group_texts_of_all_sizes(spark):
    """Ways from one cut to the next, and groups, below, at and above the sizes that have a way of their own."""
    gaps = [1, 2, align.SHORT - 1, align.SHORT, align.SHORT + 1, 40, 1]
    cuts = [sum(gaps[: k + 1]) for k in range(len(gaps))]
    rows = spark.createDataFrame([(cuts,)], "cuts array<int>")
    got = [bytes(r[0]) for r in rows.select(align._marks(F.col("cuts"))).collect()]
    assert got == ["".join("0" * (n - 1) + "1" for n in gaps).encode()]
    a, b = [[1], [2, 3], [4, 5, 6], [7], [8, 9, 10, 11]], [[1, 2, 3], [4], [5, 6], [7], [8, 9]]
    last = lambda own: [sum(map(len, own[: k + 1])) - 1 for k in range(len(own))]
    aligned = spark.createDataFrame([(sum(a, []), sum(b, []), last(a), last(b))], "a_ids array<int>, b_ids array<int>, a_last array<int>, b_last array<int>")
    assert aligned.select(align.groups_text()).head()[0] == "1|1,2,3;2,3|4;4,5,6|5,6;7|7;8,9,10,11|8,9"
