import pytest

from brindle.llm.compaction import CommitConflict, Shard, ShardStore


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return ShardStore(spark, str(tmp_path / "t"), target=40_000, small=2_000)


def frame(spark, lo, hi, parts=5):
    return spark.createDataFrame([(i if i % 7 else None, f"text {i}" * (i % 40), None) for i in range(lo, hi)], "doc_id long, text string, `a b` double").repartition(parts)


def test_arrivals_and_compaction(spark, store):
    parts = [frame(spark, 0, 500), frame(spark, 500, 900, 9), frame(spark, 0, 500), frame(spark, 0, 0)]
    for p in parts:
        store.append(p, 50)
    want = sorted((r for p in parts for r in rows(p)), key=str)
    before = store.shards()
    assert rows(store.read()) == want and len(before) >= 30
    version = store.compact()
    after = store.shards()
    assert rows(store.read()) == want and len(after) < len(before) / 3 and version > 4
    assert not store.plan(after) and store.compact() == version
    assert sum(s.rows for s in after) == len(want)
    assert rows(store.read(1)) == rows(parts[0])  # older versions stay readable
    assert store.vacuum() > 0 and rows(store.read()) == want and store.version() == version


def test_row_groups_are_merged(spark, store):
    import pyarrow.parquet as pq

    for lo in range(0, 400, 20):
        store.append(frame(spark, lo, lo + 20, 1), 10)
    store.compact()
    merged = [s for s in store.shards() if s.rows > 100]
    assert merged and all(pq.read_metadata(f"{store.base}/data/{s.name}").num_row_groups <= 4 for s in merged)  # of 13 or more shards
    assert rows(store.read()) == rows(frame(spark, 0, 400))


def test_two_writers(spark, store):
    store.append(frame(spark, 0, 10))
    m = store.manifest()
    store.append(frame(spark, 10, 20))
    with pytest.raises(CommitConflict):
        store._commit(m["version"], m["schema"], [])
    assert store.read().count() == 20
    with pytest.raises(ValueError):
        store.append(spark.range(3))


def test_empty(spark, store):
    assert store.version() == 0
    with pytest.raises(ValueError):
        store.read()
    for _ in range(5):
        store.append(frame(spark, 0, 0))
    store.compact()
    assert store.read().count() == 0 and len(store.shards()) == 1


def test_plan(store):
    def shards(*sizes):
        return [Shard(f"{i:03d}", s, 1, i) for i, s in enumerate(sizes)]

    assert store.plan(shards(10, 10, 10)) == []
    assert [len(g) for g in store.plan(shards(10, 10, 10, 10, 3000))] == [4]
    groups = store.plan(shards(*[9_000] * 20, 39_000))
    assert all(sum(s.bytes for s in g) <= store.target for g in groups) and sum(map(len, groups)) == 20
