import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding
from tidemark.llm.common import fresh_path

from . import awkward


def rows_of(df):
    return sorted(repr(r) for r in df.collect())


def test_rows_survive_appends_and_compaction(spark):
    docs = awkward.documents(spark)
    store = sharding.ShardStore(spark, fresh_path(spark, "store"), target_bytes=1 << 20)
    seen = []
    for i in range(6):
        seen.append(docs.withColumn("source", F.lit(str(i))))
        store.append(seen[-1].coalesce(1))
    before = store.shards()
    assert len(before) == 6 and store.version() == 6
    store.compact()
    assert len(store.shards()) == 1 < len(before)
    want = seen[0]
    for d in seen[1:]:
        want = want.unionByName(d)
    assert rows_of(store.read()) == rows_of(want)
    # the merged shard is the only one of this version, and older versions can still be read
    assert rows_of(store.read(6)) == rows_of(want)
    store.vacuum(keep=1, grace=0)
    assert len(files_of(store)) == 1 and rows_of(store.read()) == rows_of(want)


def files_of(store):
    return [n for r, *_ in store._list(f"{store.root}/data") for n, *_ in store._list(f"{store.root}/data/{r}") if n.endswith(".parquet")]


def test_large_shards_are_not_rewritten_and_small_tiers_wait(spark):
    store = sharding.ShardStore(spark, fresh_path(spark, "store"))
    shard = lambda i, size: sharding.Shard(i, size, store.tier(size), 1)
    big, small = [shard(f"b{i}", store.target) for i in range(9)], [shard(f"s{i}", 1000) for i in range(4)]
    store._commit(big + small[:3], [], 0)
    assert store.due() == []
    store._commit(small[3:], [], 1)
    assert [s.shard for s in store.due()] == ["s0", "s1", "s2", "s3"]


def test_only_one_writer_commits_a_version_and_the_other_tries_again(spark):
    root = fresh_path(spark, "store")
    one, two = sharding.ShardStore(spark, root), sharding.ShardStore(spark, root)
    docs = spark.range(3)
    made = [s._write(docs) for s in (one, two)]
    assert one._commit(made[0], [], 0) == 1
    with pytest.raises(sharding.Conflict):
        two._commit(made[1], [], 0)
    assert one.version() == 1 and two.read().count() == 3
    assert two._add(made[1]) == 2 and one.read().count() == 6


def test_vacuum_leaves_what_another_writer_has_not_committed_yet(spark):
    root = fresh_path(spark, "store")
    one, two = sharding.ShardStore(spark, root), sharding.ShardStore(spark, root)
    one.append(spark.range(3))
    pending = two._write(spark.range(3, 5))
    one.append(spark.range(5, 9))
    one.vacuum(keep=1)
    two._add(pending)
    assert sorted(r.id for r in one.read().collect()) == list(range(9))


def test_a_merge_that_lost_to_a_merge_loses_no_rows(spark, monkeypatch):
    root = fresh_path(spark, "store")
    one, two = sharding.ShardStore(spark, root), sharding.ShardStore(spark, root)
    for i in range(4):
        one.append(spark.range(3 * i, 3 * i + 3).coalesce(1))
    write = two._write

    def while_the_other_merges(rows):
        monkeypatch.setattr(two, "_write", write)
        made = write(rows)
        one.append(spark.range(12, 15).coalesce(1))
        one.compact()
        return made

    monkeypatch.setattr(two, "_write", while_the_other_merges)
    two.compact()
    assert sorted(r.id for r in two.read().collect()) == list(range(15))
    two.vacuum(keep=1, grace=0)
    assert sorted(r.id for r in two.read().collect()) == list(range(15))


def test_changes_and_whole_manifests_say_the_same(spark):
    whole, changes = (sharding.ShardStore(spark, fresh_path(spark, "store"), snapshot=n) for n in (2, 1000))
    for store in (whole, changes):
        for i in range(5):
            store.append(spark.range(i).coalesce(1))
            store.compact()
    for v in range(1, whole.version() + 1):
        assert [rows_of(s.read(v)) for s in (whole, changes)] == [rows_of(changes.read(v))] * 2
        assert [(s.tier, s.since) for s in whole.shards(v)] != [] and sorted((s.tier, s.since) for s in whole.shards(v)) == sorted((s.tier, s.since) for s in changes.shards(v))
    whole.vacuum(keep=1, grace=0)
    assert rows_of(whole.read()) == rows_of(changes.read())


def brute(sizes, arrivals, target, fan, tier):
    """The row sets of all shards after each arrival: plain lists, with sizes by row set."""
    live = []
    for own in arrivals:
        live.append(frozenset(own))
        while True:
            tiers = {}
            for s in live:
                if sizes[s] < target // 2:
                    tiers.setdefault(tier(sizes[s]), []).append(s)
            due = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fan), None)
            if not due:
                break
            live = [s for s in live if s not in due] + [frozenset().union(*due)]
    return live


def test_tiers_equal_those_of_plain_lists(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_BYTES", 600)
    store, sizes = sharding.ShardStore(spark, fresh_path(spark, "store"), target_bytes=4000, fan=2), {}
    arrivals = [range(100 * i, 100 * i + 1 + 40 * (i % 3)) for i in range(7)]
    names = {}

    def note():
        for s in store.shards():
            if s.shard not in names:
                names[s.shard] = frozenset(r.id for r in spark.read.parquet(f"{store.root}/{s.shard}").collect())
                sizes[names[s.shard]] = s.bytes

    commit = store._commit
    monkeypatch.setattr(store, "_commit", lambda *a: (commit(*a), note())[0])
    for own in arrivals:
        store.append(spark.createDataFrame([(i,) for i in own], "id long").coalesce(1))
        store.compact()
    assert {names[s.shard] for s in store.shards()} == set(brute(sizes, arrivals, 4000, 2, store.tier))
    assert len(names) > len(arrivals)


def test_report_covers_each_row_once(spark):
    got = sharding.report(awkward.documents(spark)).collect()
    assert len(got) == len(awkward.ROWS)
    assert sharding.report(awkward.empty(spark)).count() == 0
