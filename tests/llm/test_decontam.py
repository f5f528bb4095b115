import random
import re
from collections import Counter

import pytest

from brindle.llm import decontam
from brindle.llm.queries import QUERIES


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items, percent=80):
    """Best similarity for (doc, item) over all windows."""
    out = {}
    for item, t in items:
        w = words(t)
        if len(w) < 5:
            continue
        n, want = len(w), Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        for doc, text in docs:
            d = words(text)
            for s in range(max(1, len(d) - n + 1)):
                v = d[s : s + n]
                have = Counter(tuple(v[i : i + 5]) for i in range(len(v) - 4))
                both = (have & want).total()
                if both and 100 * both >= percent * (have | want).total():
                    sim = both / (have | want).total()
                    out[doc, item] = max(sim, out.get((doc, item), 0))
    return out


def got(df):
    return {(r.doc_id, r.item_id): r.similarity for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    rng = random.Random(seed)

    def prose(n):
        return [rng.choice("abcdefghij") + rng.choice("klmnop") * rng.randrange(3) for _ in range(n)]

    items = [(i, prose(rng.randrange(5, 60))) for i in range(25)] + [(90, ["x", "y"]), (91, []), (92, ["r"] * 30), (93, prose(6))]
    docs = []
    for i in range(60):
        d = prose(rng.randrange(80))
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(items)[1])
            for _ in range(rng.randrange(4)):
                if p:
                    at = rng.randrange(len(p))
                    rng.choice([lambda: p.pop(at), lambda: p.insert(at, "new"), lambda: p.__setitem__(at, "put"), lambda: None])()
            at = rng.randrange(len(d) + 1)
            d[at:at] = p
        docs.append((i, (", " if i % 3 else "*** ").join(d).upper() if i % 2 else " ".join(d)))
    docs += [(100, None), (101, ""), (102, " ".join(items[0][1])), (103, "r " * 500), (None, " ".join(items[1][1]))]
    texts = [(i, " ".join(p)) for i, p in items]
    want = brute(docs, texts)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*r, "x") for r in [*texts, (None, None)]], "item_id long, text string, n string")
    assert len(want) > 20
    assert got(decontam.matches(d, b)) == pytest.approx(want)
    assert got(decontam.matches(d, b, pass_shingles=100)) == pytest.approx(want)
    kept = {r.doc_id for r in decontam.decontaminated(d.union(d), b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}
    assert decontam.matches(d.limit(0), b).count() == 0 and decontam.matches(d, b.limit(0)).count() == 0


def test_altered_run_of_a_repeated_word(spark):
    rng = random.Random(3)

    def prose(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    docs, items = [], []
    for i in range(9):
        p, run = prose(200 + 200 * (i % 3 == 2)), 40 if i % 3 == 2 else 20
        items.append((i, " ".join([*p, *["0"] * run])))
        docs.append((i, " ".join(p if i % 3 == 1 else [*p, *prose(run)])))
    # five shingles against four of them
    for i in range(60, 70):
        p = prose(9)
        items.append((i, " ".join(p)))
        docs.append((i, " ".join(p[:-1])))
    want = {}
    for doc, item in zip(docs, items, strict=True):
        want |= brute([doc], [item])
    assert len(want) == 19
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = got(decontam.matches(d, b))
    assert len(found) == 19 and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_long_item(spark):
    rng = random.Random(6)
    item = [f"w{rng.randrange(10**6)}" for _ in range(2000)] + ["a"] * 100
    near = [w if rng.random() > 0.01 else "x" for w in item]
    far = [w if rng.random() > 0.1 else "x" for w in item]
    docs = [(1, " ".join(["b"] * 50 + near + ["c"] * 5000)), (2, " ".join(far)), (3, " ".join(item[:1900])), (4, " ".join(item[100:]))]
    b = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: (r.similarity, r.start_word) for r in decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}

    def features(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    want = features(item)
    assert set(found) == {1, 3, 4}
    assert found[1] == (pytest.approx((features(near) & want).total() / (features(near) | want).total()), 50)
    assert found[3][0] == pytest.approx(1896 / 2096) and found[4][0] == pytest.approx(1996 / 2096)


def test_recall_of_the_index_at_the_threshold(spark):
    rng = random.Random(8)
    items, docs = [], []
    for i in range(400):  # one word put in for another near the end: similarity just above 0.8
        w = [f"w{rng.randrange(10**6)}" for _ in range(49 + i % 5)]
        v = list(w)
        v[10] = "x"
        items.append((i, " ".join(w)))
        docs.append((i, " ".join(v)))
    want = {k: s for d, i in zip(docs, items, strict=True) for k, s in brute([d], [i]).items()}
    assert len(want) == 400 and max(want.values()) < 0.83
    found = got(decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert found == pytest.approx(want)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    tables = {n: [tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").select(k, "text").collect()] for n, k in (("documents", "doc_id"), ("benchmark", "item_id"))}
    assert got(QUERIES["op2_decontamination"](spark, sf)) == pytest.approx(brute(tables["documents"], tables["benchmark"]))


def test_no_python_in_the_plan(spark):
    sf = "/root/testdata/sf0.001"
    plan = QUERIES["op2_decontamination"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
