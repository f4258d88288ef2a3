import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken

from tidemark.llm import bpe
from tidemark.llm.queries import tokenizer

from . import awkward


@pytest.fixture(scope="module")
def public():
    path, pattern = tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(4)
    made = ["".join(r.choice(letters) for _ in range(n)) for letters in ("abcde ", "theinrosa", "étè ßü", "01 .", "日本語") for n in (1, 7, 60, 900)]
    return made + ["a" * 5000, "\n\n  x", "it's I'LL don't", awkward.LONG, "", "é\U0001f600"]


def test_ids_equal_the_public_library(public):
    got = bpe.encoder(*tokenizer()).encode(texts())
    for t, ids in zip(texts(), got):
        assert np.frombuffer(ids, "<u4").tolist() == public.encode_ordinary(t)


def test_heap_and_matrix_agree():
    own, r = bpe.encoder(*tokenizer()).vocabulary, random.Random(5)
    pieces = ["".join(r.choice("theinrosa é") for _ in range(r.randint(2, 90))).encode() for _ in range(500)]
    for p, ids in own.encode_pieces(pieces).items():
        if p not in own.ranks:
            assert ids == own.merge_long(p).astype("<u4").tobytes()


def test_pair_table_finds_what_it_holds():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1000, (3000, 2)), axis=0)
    t = bpe.PairTable(keys[:, 0], keys[:, 1], np.arange(len(keys), dtype=np.int32))
    assert (t.find(keys[:, 0], keys[:, 1]) == np.arange(len(keys))).all()
    assert t.find(np.array([2000, -1]), np.array([1, 1])).tolist() == [bpe.NONE] * 2


def test_report_and_round_trip_on_awkward_rows(spark, public):
    got = bpe.report(awkward.documents(spark), *tokenizer()).collect()
    want = []
    for i, t in awkward.texts():
        ids = public.encode_ordinary(t)
        packed = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    docs = awkward.documents(spark).select("doc_id", "text")
    back = bpe.decode(bpe.encode(docs, *tokenizer()), tokenizer()[0]).collect()
    assert sorted(bytes(r.decoded).decode() for r in back) == sorted(t for _, t in awkward.texts())
    assert bpe.report(awkward.empty(spark), *tokenizer()).count() == 0
