import random
import threading

import pytest

from tidemark.plans.relations import Change, Refused, Relation, Relations
from tidemark.plans.snapshots import Conflict

KINDS = (
    Relation("log", "knowledge_id long, text string", owner="knowledge_id"),
    Relation("records", "id long, v string", owner="id"),
    Relation("edges", "a string, b string, n long, seen long", key=("a", "b"), counts=("n",), stamps=("seen",)),
)


def rows(state, name):
    return sorted(tuple(r) for r in state.read(name).collect())


@pytest.fixture
def store(spark, tmp_path):
    return Relations(spark, str(tmp_path / "kb"), KINDS)


def frame(spark, name, data):
    return spark.createDataFrame(data, next(r.schema for r in KINDS if r.name == name))


def test_a_change_is_seen_whole_and_older_versions_stay(spark, store):
    first = store.open()
    assert first.version == 0 and rows(first, "records") == []
    store.commit(first, Change(append={"log": frame(spark, "log", [(1, "a"), (1, "b"), (2, "c")])}, replace={"records": frame(spark, "records", [(1, "x"), (2, "y")])}))
    second = store.open()
    store.commit(second, Change(replace={"records": frame(spark, "records", [(2, "z"), (3, "w")])}, remove={"log": spark.createDataFrame([(1,)], "id long")}))
    third = store.open()
    assert rows(second, "records") == [(1, "x"), (2, "y")] and rows(second, "log") == [(1, "a"), (1, "b"), (2, "c")]
    assert rows(third, "records") == [(1, "x"), (2, "z"), (3, "w")] and rows(third, "log") == [(2, "c")]
    store.commit(third, Change(append={"log": frame(spark, "log", [(1, "again")])}))
    assert rows(store.open(), "log") == [(1, "again"), (2, "c")]


def test_two_writers_of_one_version(spark, store):
    state = store.open()
    store.commit(state, Change(append={"log": frame(spark, "log", [(1, "a")])}))
    with pytest.raises(Conflict):
        store.commit(state, Change(append={"log": frame(spark, "log", [(2, "b")])}))
    assert rows(store.open(), "log") == [(1, "a")]


def test_decisions_are_made_anew_after_another_writer(spark, store):
    store.commit(store.open(), Change(replace={"records": frame(spark, "records", [(1, "free")])}))
    seen = []

    def take(name):
        def decide(state):
            seen.append((name, state.version))
            if len(seen) == 1:  # another writer, between the reading and the commit
                store.transact(take("other"))
            if state.read("records").where("id = 1 and v = 'free'").isEmpty():
                raise Refused("taken")
            return Change(replace={"records": frame(spark, "records", [(1, name)])})

        return decide

    with pytest.raises(Refused):
        store.transact(take("own"))
    assert rows(store.open(), "records") == [(1, "other")] and [n for n, _ in seen] == ["own", "other", "own"]


def test_the_slower_writer_is_tried_again(spark, store):
    begun = threading.Barrier(2)

    def add(i):
        first = [True]

        def decide(state):
            if first[0]:
                first[0] = False
                begun.wait(60)
            return Change(append={"log": frame(spark, "log", [(i, f"at {state.version}")])})

        store.transact(decide)

    both = [threading.Thread(target=add, args=(i,)) for i in (1, 2)]
    [t.start() for t in both]
    [t.join(120) for t in both]
    assert sorted(r[1] for r in rows(store.open(), "log")) == ["at 0", "at 1"]


def test_random_changes_and_merges_equal_a_dictionary(spark, store):
    r = random.Random(2)
    records, log, edges = {}, [], {}
    for step in range(14):
        put = {i: f"{step}" for i in r.sample(range(8), 2)}
        said = [(r.randrange(8), f"{step}/{k}") for k in range(2)]
        met = [(r.choice("ab"), r.choice("cd"), r.choice([1, 1, -1]), step) for _ in range(3)]
        out = r.sample(range(8), 1) if step % 3 == 2 else []
        store.commit(
            store.open(),
            Change(
                append={"log": frame(spark, "log", said), "edges": frame(spark, "edges", met)},
                replace={"records": frame(spark, "records", list(put.items()))},
                remove={"log": spark.createDataFrame([(i,) for i in out], "id long")} if out else {},
            ),
        )
        records |= put
        log = [x for x in log if x[0] not in out] + said
        for a, b, n, at in met:
            old = edges.get((a, b), (0, 0))
            edges[a, b] = (old[0] + n, max(old[1], at))
        if step % 4 == 3:
            for name in ("records", "log", "edges"):
                store.merge(name, whole=step == 11)
        state = store.open()
        assert rows(state, "records") == sorted(records.items())
        assert rows(state, "log") == sorted(log)
        assert [x[:3] for x in rows(state, "edges")] == sorted((a, b, n) for (a, b), (n, _) in edges.items() if n)
    assert store.merge("records", whole=True) and store.merge("records", whole=True) is None
    assert len(store.open().paths("records", "rows")) == 1 and not store.open().paths("records", "gone")
    store.vacuum()
    assert rows(store.open(), "records") == sorted(records.items()) and len(store.versions.versions()) == 2
