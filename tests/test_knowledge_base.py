import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import indexed_text
from tidemark.operators import expand, index, versions
from tidemark.operators import knowledge_base as kb
from tidemark.plans.relations import Change, Refused

AT = "2024-05-01 10:00:00"
LATER = "2024-05-01 12:00:00"
COLUMNS = "request_id string, title string, content string, knowledge_type string, scope string, project_key string, source_agent string, evidence_summary string, search_terms string, subject_terms array<string>, created_at timestamp"


@pytest.fixture
def base(spark, tmp_path):
    return kb.open_base(spark, str(tmp_path / "kb"))


def publish(spark, base, *rows, at=AT):
    """Rows of (title, content) or dicts; the ids that they get."""
    own = []
    for n, row in enumerate(rows):
        r = dict(title=row[0], content=row[1]) if isinstance(row, tuple) else row
        full = dict(request_id=f"r{n}", knowledge_type="fact", scope="project", project_key="p", source_agent="claude-code", evidence_summary="seen", search_terms="", subject_terms=[], created_at=dt.datetime(2024, 1, 1)) | r
        own.append(tuple(full[c.split()[0]] for c in COLUMNS.split(", ")))
    told = {r.request_id: r for r in kb.publish(base, spark.createDataFrame(own, COLUMNS), at).collect()}
    return [told[f"r{n}"] for n in range(len(rows))]


def status(base, key):
    r = base.open().read("records").where(F.col("id") == key).head()
    return r and r.status


def preview(spark, base, *actions, plan="g1", project="p", at=AT):
    rows = [(plan, n, kind, key, target, "reason") for n, (kind, key, target) in enumerate(actions)]
    kb.preview_plan(base, spark.createDataFrame(rows, "plan_id string, n int, action string, knowledge_id string, target_id string, reason string"), project, "codex", at)


def state_of(base, plan="g1"):
    return base.open().read("plan_states").where(F.col("plan_id") == plan).head().status


def served(spark, base, key, **values):
    own = base.open().read("records").where(F.col("id") == key)
    values = {"status": "active", "verified_count": 1} | values
    base.commit(base.open(), Change(replace={"records": own.withColumns({c: F.lit(v) for c, v in values.items()})}))


LIGHT = dict(title="Theme old version", content="主题默认为浅色。", knowledge_type="preference")
DARK = dict(title="Theme new version", content="主题默认为深色。", knowledge_type="preference")


def edges(df):
    return sorted((r.project_key, r.a, r.b, r.n) for r in df.collect())


def scores(idx, spark, query="alpha beta cache gamma"):
    terms = spark.createDataFrame([(1, t) for t in query.split()], "query_id int, term string")
    return {r.id: r.score for r in idx.scores(terms).collect()}


def test_publication_writes_all_that_follows(spark, base):
    first = publish(spark, base, ("Alpha cache", "The alpha cache is on."), ("Beta cache", "The beta cache is off."), ("", "no title"), ("Alpha cache", "The alpha cache is on."))
    assert [r.outcome for r in first] == ["created", "created", "title", "existing"] and first[0].knowledge_id == first[3].knowledge_id
    state = base.open()
    assert state.version == 1 and {r.status for r in state.read("records").collect()} == {"candidate"}
    assert sorted(r.outcome for r in state.read("evidence").collect()) == ["confirmed_duplicate", "proposed", "proposed"]
    read = state.read("records").head()
    assert read.candidate_expires_at - read.created_at == dt.timedelta(days=1)
    # the index and the graph equal those that are built of all records, after appends, a retold record and a merge
    publish(spark, base, ("Gamma alpha", "The gamma alpha store holds alpha pages."), dict(title="Alpha cache", content="The alpha cache is on.", search_terms="delta epsilon"), at=LATER)
    publish(spark, base, *[(f"Alpha topic{k}", f"alpha beta item{k}") for k in range(3)])
    for merged in (False, True):
        if merged:
            assert [base.merge(n, whole=True) for n in ("postings", "frequencies", "numbers", "edges", "pairs")]
        state = base.open()
        records = state.read("records")
        whole = index.Index.build(records, text=indexed_text(F.col("title"), F.col("content"), F.col("search_terms")), places=True)
        got, want = scores(kb.open_index(state), spark), scores(whole, spark)
        assert got.keys() == want.keys() and len(got) == 6 and all(abs(got[i] - want[i]) < 1e-6 for i in got)
        assert edges(state.read("edges")) == edges(kb.rebuilt_edges(state))
        terms = records.select("project_key", "id", F.explode(kb.bridge_terms(F.col("title"), F.col("search_terms"))).alias("term"), "created_at")
        assert edges(state.read("edges")) == edges(expand.cooccurrence(terms))


def test_publication_reads_its_own_records_only(spark, base):
    publish(spark, base, ("Alpha cache", "alpha"), ("Beta cache", "beta"))
    before = {m.path for m in base.open().manifest}
    publish(spark, base, ("Gamma store", "gamma"))
    new = {(m.relation, m.part): m.rows for m in base.open().manifest if m.path not in before}
    assert new["records", "rows"] == 1 and new["frequencies", "rows"] == new["postings", "rows"] and before <= {m.path for m in base.open().manifest}


def test_removal_cleans_everything(spark, base):
    (gone, stays) = (r.knowledge_id for r in publish(spark, base, dict(LIGHT), dict(title="beta", content="beta reusable fact")))
    state = base.open()
    of = {n: base.relations[n].fields for n in ("experience_outcomes", "shadow_hits", "event_links", "compilation_links", "traces", "audit")}
    item = lambda key, parent=None: (key, 1, "direct", parent, "h", True, False)
    rows = {
        "experience_outcomes": [(gone, 1, 0, "test"), (stays, 1, 0, "test")],
        "shadow_hits": [(gone, "p", 1, ["q"], "d")],
        "event_links": [(gone, "e1", "evidence"), (stays, "e1", "evidence")],
        "compilation_links": [(gone, "run", "compiled")],
        "traces": [("t1", "codex", "p", "s", "t", f"text {gone}", [item(gone), item(stays)], None), ("t2", "codex", "p", "s", "u", "text", [item(stays, gone)], None), ("t3", "codex", "p", "s", "v", "text", [item(stays)], None)],
        "audit": [("a1", gone, "candidate", "active", "x", "y", None)],
    }
    base.commit(state, Change(append={n: spark.createDataFrame(r, of[n]) for n, r in rows.items()}))
    ids = spark.createDataFrame([(gone,), (gone,), ("kn_none",)], "id string")
    with pytest.raises(Refused, match="outside"):
        kb.remove(base, "other", ids)
    assert kb.remove(base, "p", ids) == {"removed_count": 1, "already_missing_count": 1}
    state = base.open()
    for name in kb.CASCADES:
        key = base.relations[name].owner
        assert state.read(name).where(F.col(key) == gone).isEmpty(), name
    assert not state.read("evidence").isEmpty() and state.read("event_links").count() == 1 and state.read("experience_outcomes").count() == 1
    traces = {r.id: r for r in state.read("traces").collect()}
    assert [traces[t].context_text for t in ("t1", "t2", "t3")] == ["", "", "text"]
    assert [[i.removed for i in traces[t].items] for t in ("t1", "t2", "t3")] == [[True, False], [False], [False]]
    assert edges(state.read("edges")) == edges(kb.rebuilt_edges(state))
    assert "主题" not in {r.term for r in state.read("frequencies").collect()} and kb.open_index(state).n_docs == 1
    version = state.version
    assert kb.remove(base, "p", ids) == {"removed_count": 0, "already_missing_count": 2} and base.open().version == version


def test_a_user_record_is_everyones_and_a_failure_removes_nothing(spark, base, monkeypatch):
    keys = [r.knowledge_id for r in publish(spark, base, dict(title="shared", content="x", scope="user", project_key="other"), ("own", "y"))]
    ids = spark.createDataFrame([(k,) for k in keys], "id string")
    monkeypatch.setattr(base, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("disk")))
    with pytest.raises(RuntimeError):
        kb.remove(base, "p", ids)
    assert base.open().read("records").count() == 2 and base.open().read("postings").count() > 0
    monkeypatch.undo()
    assert kb.remove(base, "p", ids)["removed_count"] == 2


def test_a_dispute_is_settled_by_explicit_replacement_and_undone(spark, base):
    (old,) = (r.knowledge_id for r in publish(spark, base, LIGHT))
    served(spark, base, old)
    (new,) = (r.knowledge_id for r in publish(spark, base, DARK))
    assert {r.id: r.claim_conflicted for r in base.open().read("records").collect()} == {old: False, new: True}
    with pytest.raises(Refused, match="need_supersede"):
        preview(spark, base, ("approve", new, None))
    preview(spark, base, ("supersede", new, old))
    with pytest.raises(Refused, match="operator_approval"):
        kb.apply_plan(base, "g1", "p", "codex", LATER)
    kb.approve_plan(base, "g1", "p", "operator", LATER)
    assert kb.apply_plan(base, "g1", "p", "operator", LATER) == "applied" and kb.apply_plan(base, "g1", "p", "operator", LATER) == "already_applied"
    rows = {r.id: r for r in base.open().read("records").collect()}
    assert (rows[old].status, rows[old].superseded_by, rows[new].status) == ("archived", new, "active") and rows[old].valid_until == rows[new].valid_from
    assert not rows[new].claim_conflicted and rows[new].verified_count == 1
    audit = base.open().read("audit").collect()
    assert sorted((r.knowledge_id == old, r.from_status, r.to_status) for r in audit) == [(False, "candidate", "active"), (True, "active", "archived")]
    assert kb.undo_plan(base, "g1", "p", "operator", "2024-05-03 00:00:00") == "undone"
    rows = {r.id: r for r in base.open().read("records").collect()}
    assert (rows[old].status, rows[old].superseded_by, rows[new].status) == ("active", None, "candidate") and rows[new].claim_conflicted
    assert {r.outcome for r in base.open().read("evidence").collect()} == {"proposed", "reverted"} and state_of(base) == "undone"


@pytest.mark.parametrize("stage, change", [("approve", "edit"), ("apply", "feedback"), ("apply", "delete"), ("apply", "new_conflict"), ("undo", "feedback"), ("undo", "new_conflict")])
def test_later_activity_is_never_overwritten(spark, base, stage, change):
    (key,) = (r.knowledge_id for r in publish(spark, base, LIGHT))
    preview(spark, base, ("approve", key, None))
    if stage != "approve":
        kb.approve_plan(base, "g1", "p", "operator", AT)
    if stage == "undo":
        kb.apply_plan(base, "g1", "p", "operator", AT)
    if change == "feedback":
        row = ("e9", key, "codex", "used", "later", "observation", "", None, None, None)
        base.commit(base.open(), Change(append={"evidence": spark.createDataFrame([row], base.relations["evidence"].fields)}))
    elif change == "edit":
        served(spark, base, key, status=status(base, key), content="Changed source")
    elif change == "delete":
        kb.remove(base, "p", spark.createDataFrame([(key,)], "id string"))
    else:
        (peer,) = (r.knowledge_id for r in publish(spark, base, DARK))
        served(spark, base, peer)
    before = status(base, key)
    with pytest.raises(Refused):
        {"approve": kb.approve_plan, "apply": kb.apply_plan, "undo": kb.undo_plan}[stage](base, "g1", "p", "operator", LATER)
    assert status(base, key) == before


def test_plans_expire_belong_to_a_project_and_are_whole(spark, base):
    first, second = (r.knowledge_id for r in publish(spark, base, LIGHT, DARK))
    preview(spark, base, ("approve", first, None), ("approve", second, None))
    with pytest.raises(Refused, match="conflicting"):
        kb.approve_plan(base, "g1", "p", "operator", LATER)
    assert status(base, first) == status(base, second) == "candidate" and state_of(base) == "preview"
    preview(spark, base, ("approve", first, None), plan="g2")
    with pytest.raises(Refused, match="expired"):
        kb.approve_plan(base, "g2", "p", "operator", "2024-05-03 10:00:00")
    with pytest.raises(Refused, match="not_found"):
        kb.approve_plan(base, "g2", "other", "operator", AT)
    with pytest.raises(Refused, match="not_found"):
        preview(spark, base, ("approve", first, None), plan="g3", project="other")
    with pytest.raises(Refused, match="overlapping"):
        preview(spark, base, ("approve", first, None), ("quarantine", first, None), plan="g4")


def test_two_plans_on_one_record_one_is_refused(spark, base):
    old, = (r.knowledge_id for r in publish(spark, base, LIGHT))
    served(spark, base, old)
    for plan in ("g1", "g2"):
        preview(spark, base, ("archive", old, None), plan=plan)
        kb.approve_plan(base, plan, "p", "operator", AT)
    decide, first = base.commit, [True]

    def interleaved(state, change):
        if first[0]:  # the other plan is applied between this one's reading and its commit
            first[0] = False
            kb.apply_plan(base, "g2", "p", "operator", LATER)
        return decide(state, change)

    base.commit = interleaved
    with pytest.raises(Refused, match="changed"):
        kb.apply_plan(base, "g1", "p", "operator", LATER)
    assert (state_of(base, "g1"), state_of(base, "g2"), status(base, old)) == ("approved", "applied", "archived")


def claims(spark, rows):
    schema = "id string, scope string, project_key string, claim_topic string, claim_value string, status string, verified_count long, superseded_by string, claim_conflicted boolean"
    return spark.createDataFrame(rows, schema)


def test_disputes_by_scope_and_state_equal_pairs(spark):
    import random

    r = random.Random(8)
    rows = [
        (f"k{i}", r.choice(["user", "project"]), r.choice("pq"), r.choice(["", "t1", "t2"]), r.choice("abc"), r.choice(["candidate", "active", "stale", "archived", "quarantined"]), r.choice([0, 1]), r.choice([None, None, "x"]), r.choice([True, False]))
        for i in range(80)
    ]
    own = claims(spark, rows)
    slot = lambda x: (x[1], None if x[1] == "user" else x[2], x[3])
    stands = lambda x: x[7] is None and (x[5] in ("active", "stale") or x[5] == "archived" and x[6] > 0)
    peers = {x[0]: sum(y[0] != x[0] and slot(y) == slot(x) and stands(y) and y[4] != x[4] for y in rows) for x in rows if x[3]}
    assert {x.id: x.n_peers for x in versions.peer_sums(own).collect()} == peers
    want = {}
    for x in rows:
        if x[3]:
            values = {y[4] for y in rows if slot(y) == slot(x) and stands(y) and (y[5] != "archived" or x[5] not in ("active", "stale"))}
            want[x[0]] = x[7] is None and bool(values - {x[4]})
    assert {x.id: x.disputed for x in versions.disputed(own).collect()} == want
    changed = {x.id: x.claim_conflicted for x in versions.refreshed(own, own).collect()}
    assert changed == {x[0]: want[x[0]] for x in rows if x[3] and want[x[0]] != x[8]}


def test_chains_are_followed_in_few_rounds(spark, monkeypatch):
    rounds = []
    plain = versions.staged
    monkeypatch.setattr(versions, "staged", lambda df, name: (rounds.append(name), plain(df, name))[1])
    chain = spark.range(0, 1001).selectExpr("cast(id AS string) AS id", "if(id < 1000, cast(id + 1 AS string), null) AS superseded_by")
    gone = chain.where("id not in ('0', '500')").select("id")
    got = {r.id: (r.predecessor, r.steps) for r in versions.restored(chain, gone).collect()}
    assert got == {str(i): ("0" if i < 500 else "500", i if i < 500 else i - 500) for i in range(1, 1001) if i != 500}
    assert len(rounds) <= 11
    lone = spark.createDataFrame([("a", None)], "id string, superseded_by string")
    assert versions.restored(lone, lone.select("id")).count() == 0
