import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import pytest

from tidemark.llm import secret_scan as s

from . import awkward

ACCESS = "AKIA" + "Q7X2" * 4
ASSIGN = "api_key = 'hunter2hunter2'"


def brute_base(text):
    """Matches by walking the text one position at a time, without prefilters or shortened patterns."""
    ascii_lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    value = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")
    found, i = [], 0
    while i < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if ascii_lower.startswith(word, i):
                j = i + len(word)
                j += text[j : j + 1] in ("'", '"') and j < len(text)
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] in (":", "=") and j < len(text):
                    j += 1
                    while text[j : j + 1] == " ":
                        j += 1
                    j += text[j : j + 1] in ("'", '"') and j < len(text)
                    k = j
                    while k < len(text) and text[k] in value:
                        k += 1
                    if k > j:
                        end = k
                        if k - j >= 6:
                            found.append((i, 0, k))
                break
        i = end or i + 1
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(found)


def encodings():
    return {
        "url": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
        "url_some": lambda t: urllib.parse.quote(t, safe=""),
        "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        "braces": lambda t: "".join(f"\\u{{{ord(c):x}}}" for c in t),
        "hex_escape": lambda t: "".join(f"\\x{ord(c):02x}" for c in t),
        "entity": lambda t: "".join(f"&#{ord(c)};" for c in t),
        "base64": lambda t: base64.b64encode(t.encode()).decode(),
        "base64_url": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="),
        "base64_lines": lambda t: base64.encodebytes(t.encode() * (1 if len(t) > 60 else 4)).decode().strip(),
        "gzip": lambda t: base64.b64encode(gzip.compress(t.encode())).decode(),
        "zlib": lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
        "bz2": lambda t: base64.b64encode(bz2.compress(t.encode())).decode(),
        "xz": lambda t: base64.b64encode(lzma.compress(t.encode())).decode(),
        "url_of_gzip": lambda t: "".join(f"%{b:02x}" for b in gzip.compress(t.encode())),
    }


def test_base_equals_a_walk_of_single_positions():
    r = random.Random(1)
    bits = ["password", "PassWd", "secret", "token", "ToKen", "api_key", "APIKEY", "apikey", "=", ":", " ", "  ", "'", '"', "abc", "abcdef12", "==", "AKIA", "AKIA" + "Z9" * 8, "0123456789abcdef", "f" * 24, "é", "ſecret", "toKen", "\n", ".", "X"]
    for _ in range(5000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert s.matches(text) == brute_base(text), text


def test_a_failing_match_is_not_tried_again():
    assert s.matches("secret=token:abcdefg") == [] == brute_base("secret=token:abcdefg")


@pytest.mark.parametrize("kind,secret", [("access", ACCESS), ("assign", ASSIGN), ("hex", "0f" * 13)])
@pytest.mark.parametrize("way", list(encodings()))
def test_encoded_once_and_twice(kind, secret, way):
    own = encodings()
    for inner in ("", "base64", "gzip", "unicode", "url"):
        told = own[inner](secret) if inner else secret
        hidden = own[way](f"so the {told} is there")
        text = f"Ünïcode words 😀 before, {hidden} and after"
        at = text.index(hidden)
        added = [x for x in s.Document(text).spans() if x["kind"] == kind]
        assert added, (inner, way)
        assert all(at <= x["start"] < x["end"] <= at + len(hidden) for x in added)


def test_spans_are_mapped_to_the_letters_that_spell_them():
    text = "x pass%77ord=hunter2hunter2 y"
    assert [(x["kind"], text[x["start"] : x["end"]]) for x in s.Document(text).spans()] == [("assign", "pass%77ord=hunter2hunter2")]
    text = "\\u0041KIA" + "Q7X2" * 4 + " tail"
    assert [text[x["start"] : x["end"]] for x in s.Document(text).spans()] == ["\\u0041KIA" + "Q7X2" * 4]
    for pad in range(6):
        own = "é" * pad + "." * pad + " " + ACCESS + " and more words after it"
        text = "blob: " + base64.b64encode(own.encode()).decode() + " end"
        (x,) = s.Document(text).spans()
        cut = text[x["start"] : x["end"]]
        first = len(own[: own.index(ACCESS)].encode())
        assert (x["start"], x["end"]) == (6 + first * 8 // 6, 6 + -(-(first + len(ACCESS)) * 8 // 6)) and cut


def test_two_places_of_one_secret_are_two_spans():
    one = base64.b64encode(f"the key {ACCESS} twice".encode()).decode()
    assert len(s.Document(f"{one} , {one}").spans()) == 2


def test_prefix_glued_to_base64():
    for prefix in ("a/", "ab/", "abc/", "abcd/"):
        text = prefix + base64.b64encode(f"the long key of this place is {ACCESS} and nothing else at all".encode()).decode()
        assert "access" in {x["kind"] for x in s.Document(text).spans()}, prefix


def test_base_spans_stay_and_cover():
    text = f"{ACCESS} %41 {'ab' * 12}"
    found = s.Document(text).spans()
    assert [x["base"] for x in found] == [True, True]


def test_cycles_end(monkeypatch):
    # an archive that unpacks to itself
    calls = []
    monkeypatch.setattr(s, "unpacked", lambda data, limit=s.LAYER: (calls.append(1), (data, True))[1] if data.startswith(b"LOOP") else None)
    s.Document(base64.b64encode(b"LOOP" * 9).decode())
    assert 1 <= len(calls) < 12
    nested = ACCESS
    for _ in range(12):
        nested = base64.b64encode(f"again {nested}".encode()).decode()
    assert [x["way"].count("base64") for x in s.Document(nested).spans() if x["kind"] == "access"] == [12]


def test_archive_bombs_are_told():
    bomb = base64.b64encode(gzip.compress(b"." * (1 << 20))).decode()
    found = s.Document(f"{ACCESS} {bomb}", limit=1 << 10)
    assert not found.whole and [x["kind"] for x in found.spans()] == ["access"]
    assert s.Document(bomb).whole


def test_masked():
    text = f"a {ACCESS} b token=abcdef c"
    assert s.masked(text, s.Document(text).spans()) == "a [secret] b [secret] c"


def test_report_on_awkward_rows(spark):
    rows = awkward.ROWS + [(20, f"{ASSIGN} {base64.b64encode(ACCESS.encode()).decode()}", "en", "z"), (21, "token=" + "a" * 5000 + " " + "f" * 30, "en", "z")]
    got = s.report(awkward.documents(spark, rows)).collect()
    want = []
    for i, t in awkward.texts(rows):
        base = brute_base(t)
        told = ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append((i, *(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(told.encode()).hexdigest()))
    assert sorted(map(repr, [tuple(r)[:5] for r in got])) == sorted(map(repr, want))
    by = {r.doc_id: r for r in got}
    assert by[20].spans.split(",")[1].startswith("access:") and by[20].n_layers >= 1 and by[20].whole
    assert s.report(awkward.empty(spark)).count() == 0
    kept = s.scan(awkward.documents(spark, rows).withColumnRenamed("n", "way"), mask="***")
    assert "way" in kept.columns and all("AKIA" not in (r.text or "") for r in kept.collect())
