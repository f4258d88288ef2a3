import re

from tidemark.llm import decontaminate

from . import awkward

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    windows = []
    for item, t in items:
        w = words(t)
        k = min(13, len(w))
        windows += [(item, w[i : i + k]) for i in range(len(w) - k + 1) if k]
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in windows:
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit |= set(range(p, p + len(x)))
                    found.add(item)
        ids = sorted(str(x) for x in found)
        out[i] = (len(w), len(hit), len(ids), decontaminate.items_digest(ids), bool(hit) and 20 * len(hit) >= len(w))
    return out


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def fixture(spark):
    docs = [
        (1, f"before {PASSAGE} after"),
        (2, PASSAGE.upper().replace(" ", ", ")),
        (3, PASSAGE.replace("seven", "SEVEN!")),
        (4, " ".join(PASSAGE.split()[:12])),
        (5, "short item"),
        (6, "a short  item, a SHORT item"),
        (7, ""),
        (8, None),
        (9, "word " * 400 + PASSAGE),
        (10, "über größe"),
    ]
    items = [(100, PASSAGE), (20, PASSAGE), (3, "short item"), (4, ""), (5, None), (6, "Über Größe"), (7, " ".join(PASSAGE.split()[2:]))]
    make = lambda rows, names: spark.createDataFrame(rows, names)
    return docs, items, make(docs, "doc_id long, text string"), make(items, "item_id long, text string")


def rows_of(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_equals_brute_force(spark):
    docs, items, d, b = fixture(spark)
    assert rows_of(decontaminate.report(d, b)) == brute([(i, t or "") for i, t in docs], [(i, t or "") for i, t in items])


def test_blocks_give_the_same_marks(spark):
    docs, items, d, b = fixture(spark)
    whole = decontaminate.marked(d, b).drop("__hits").collect()
    parts = decontaminate.marked(d, b, block_bytes=150).drop("__hits").collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, parts))


def test_removes_documents_or_spans(spark):
    _, _, d, b = fixture(spark)
    left = {r.doc_id: r.text for r in decontaminate.remove_documents(d, b).collect()}
    assert set(left) == {4, 7, 8, 9, 10}  # only A-Z are lower-cased, so "Über" is not "über"
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(d, b).collect()}
    assert cut[1] == "before  after" and cut[5] == "" and cut[8] is None and cut[6] == "a , a "


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward.documents(spark)
    items = spark.createDataFrame([(None, "lazy dog"), (1, "same text")], "item_id long, text string")
    got = decontaminate.report(docs, items).collect()
    assert len(got) == len(awkward.ROWS)
    assert sorted(r.n_hit for r in got if r.n_items) == [2, 2]
    assert decontaminate.remove_documents(docs, items).columns == docs.columns
    assert decontaminate.report(awkward.empty(spark), items).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(docs, items.limit(0)).collect())


def test_columns_with_the_marks_names_stay(spark):
    from pyspark.sql import functions as F

    docs = awkward.documents(spark)
    for c in ("__hits", "__items", "__n_words", "__n_hit", "a.b"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    bench = spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")
    for out in (decontaminate.remove_documents(docs, bench), decontaminate.remove_spans(docs, bench)):
        assert out.columns == docs.columns and {r["__hits"] for r in out.collect()} == {"own __hits"}
