import numpy as np
import pytest

from brindle.llm import ann
from brindle.llm.queries import QUERIES


def brute(ids, x, qs, k):
    out = {}
    for q in qs:
        i = ids.index(q)
        s = [((x[j] * x[i]).sum(), ids[j]) for j in range(len(ids)) if ids[j] != q]
        out[q] = sorted(s, key=lambda t: (-t[0], t[1]))[:k]
    return out


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    code = rng.integers(0, 2**64, 3000, dtype=np.uint64) & rng.integers(0, 2**64, 3000, dtype=np.uint64)
    index = ann.MultiIndex(code)
    for q in code[:20]:
        for r in (0, 3, 8, 15, 22):
            assert index.within(q, r).tolist() == np.flatnonzero(np.bitwise_count(code ^ q) <= r).tolist()
        assert len(index.search(q, 0, 50)) >= 50


def test_recall_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    pdf = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(pdf.embedding.to_numpy()).astype(float), pdf.vec_id.tolist()
    got = QUERIES["op3_nearest"](spark, sf).toPandas()
    qs = [i for i in ids if i % 20 == 0]
    want = brute(ids, x, qs, 20)
    assert set(got.groupby("query_id").size()) == {20} and got.query_id.nunique() == len(qs)
    hits = 0
    for q, g in got.sort_values("rank").groupby("query_id"):
        hits += len({i for _, i in want[q]} & set(g.vec_id))
        assert g["rank"].tolist() == list(range(1, 21))
        assert [(-s, i) for s, i in zip(g.score, g.vec_id)] == sorted((-s, i) for s, i in zip(g.score, g.vec_id))
        assert np.allclose(g.score, x[[ids.index(i) for i in g.vec_id]] @ x[ids.index(q)], atol=1e-12)
    assert hits / (20 * len(qs)) >= 0.9


@pytest.mark.parametrize("rows", [10_000, 7])
def test_odd_vectors(spark, rows):
    nan, inf = float("nan"), float("inf")
    vs = [(i, [float(i % 5), 1.0, float(i % 3)], "x") for i in range(1, 45)]
    vs += [(60, None, "x"), (80, [0.0, 0.0, 0.0], "x"), (100, [nan, 1.0, 1.0], "x"), (120, [inf, 1.0, 1.0], "x"), (140, [None, 1.0, 1.0], "x"), (160, [1.0], "x"), (None, [1.0, 1.0, 1.0], "x"), (21, [1.0, 1.0, 0.0], "x")]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<float>, id string")
    got = ann.nearest(df, (ann.F.col("id") % 20) == 0, k=5, rows=rows, queries=1).toPandas()
    assert set(got.query_id) == {20, 40} and len(got) == 10
    full = ann.nearest(df, (ann.F.col("id") % 20) == 0, k=500, rows=rows).toPandas()
    assert len(full) == 88
    assert ann.nearest(df.limit(0), ann.F.col("id") == 0).count() == 0


def test_ties_go_to_smaller_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in (9, 3, 7, 0, 5)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, ann.F.col("id") == 0, k=3).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 3, 5.0), (2, 5, 5.0), (3, 7, 5.0)]


def test_repeated_rows_cost_no_results(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    # id 0 lies far off, 30 times; id 1 comes twice, with equal vectors; id 2 with two vectors
    vs = [(0, [100.0] * 8 + [0.0] * 8)] * 30 + [(i, v.tolist()) for i, v in enumerate(x) if i]
    vs += [(1, x[1].tolist()), (2, (-x[2]).tolist())]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<double>")
    got = ann.nearest(df, ann.F.col("id") < 3).toPandas()
    assert got.groupby("query_id").size().to_dict() == {0: 20, 1: 20, 2: 40}
    assert sorted(got[got.query_id == 1]["rank"]) == list(range(1, 21))
    assert sorted(got[got.query_id == 2]["rank"]) == sorted([*range(1, 21)] * 2)
    assert set(got[got.query_id == 0].vec_id) == {0}  # the 29 other rows
    two = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [0.5, 0.1])], "vec_id long, embedding array<double>")
    got = ann.nearest(two, ann.F.col("id") == 5).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 5, 1.0), (2, 6, 0.5)]


@pytest.mark.parametrize("scale", [1e-200, 1e-320, 1.0, 1e150])
def test_lengths_beyond_squares(spark, scale):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)) * scale
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, ann.F.col("id") == 0, k=5).orderBy("rank").collect()
    assert len(got) == 5 and 0 not in {r.vec_id for r in got}
    with np.errstate(all="ignore"):
        assert [r.score for r in got] == [(x[r.vec_id] * x[0]).sum() for r in got]
