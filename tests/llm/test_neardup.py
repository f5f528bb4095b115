import itertools
import random
import re

import numpy as np
import pytest

from brindle.llm import neardup
from brindle.llm.components import connected
from brindle.llm.queries import QUERIES


def shingles(text, k):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute(rows, k, percent):
    """Components by comparing whatever shares a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {p for v in by.values() for p in itertools.combinations(v, 2)}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(rows[i][0]), find(rows[j][0])
            root[max(a, b)] = min(a, b)
    return {(i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets, strict=True)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 900), (900, 7), (7, 3), (2000, 2001)] + [(50, i) for i in range(3000, 3100)] + [(9, 9), (None, 4)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 5: 3, 900: 3, 7: 3, 2001: 2000, **{i: 50 for i in range(3000, 3100)}}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def made(seed):
    """Chains of edits from small to large texts, exact copies, and texts of nothing."""
    rng, rows = random.Random(seed), []
    for size in (1, 2, 3, 5, 6, 10, 20, 60, 200, 900):
        for _ in range(6):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, size // 20, size // 12):
                w = list(base)
                for _ in range(edits):
                    w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
                if rng.random() < 0.3:
                    w.append("tail")
                rows.append("  ".join(w) if rng.random() < 0.2 else " ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    rows += ["", None, " \t\n", "", "\xa0", "a", "A", "a\x0bb", "É é", "é É"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(2, 80), (5, 80)])
def test_as_brute_force(spark, k, percent):
    rows = made(k)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = {tuple(r) for r in neardup.near_duplicates(df, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_whole_table_as_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in QUERIES["op7_near_duplicates"](spark, sf).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert got == brute(rows, 2, 80)


def test_repeats_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "q r s t"), (2, "A B C"), (3, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, 2).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 3, None, True), (2, 2, 1, False), (3, 0, 3, True)], key=str)
    assert neardup.near_duplicates(df.limit(0), 2).count() == 0
    assert neardup.unique_rows(df.limit(0)).count() == 0


def test_an_id_with_several_texts(spark):
    x, y, z = "a b c d", "e f g h", "i j k l"
    df = spark.createDataFrame([(1, x), (2, x), (2, y), (3, y), (3, ""), (4, z), (None, z), (5, "")], "doc_id long, text string")
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, 2).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), (3, 0, 1, False), (4, 3, 4, True), (None, 3, 4, False), (5, 0, 5, True)]
    assert got == sorted(want, key=str)
    wide = df.withColumn("uid", df.text).withColumn("root", df.doc_id)
    rows = neardup.unique_rows(wide, 2)
    assert rows.columns == wide.columns
    assert sorted(((r.doc_id, r.text) for r in rows.collect()), key=str) == sorted([(1, x), (2, y), (3, ""), (4, z), (5, "")], key=str)


def test_words_that_polynomial_hashes_confuse(spark):
    t = "a"
    while len(t) < 4096:
        t += t.translate(str.maketrans("ab", "ba"))
    other = t.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, f"x {t}"), (2, f"x {other}"), (3, f"X  {t}"), (4, f"p q r {t}"), (5, f"p q r {other}")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 2).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_sets_are_compared_by_their_words():
    rng = random.Random(5)
    for k in (1, 2, 5):
        for _ in range(200):
            a = [rng.choice("abc") for _ in range(rng.randrange(14))]
            b = list(a) if rng.random() < 0.5 else [rng.choice("abc") for _ in range(rng.randrange(14))]
            if b and rng.random() < 0.5:
                b[rng.randrange(len(b))] = "D"
            one, two = " ".join(a), "\t".join(b).upper()
            x, y = shingles(one, k), shingles(two, k)
            want = bool(x & y) and 100 * len(x & y) >= 80 * len(x | y)
            assert neardup.reaches(one.encode(), two.encode(), k, 80) == want
    long = b"word " * 500_000
    assert neardup.reaches(long, long + b"end", 2, 50) and not neardup.reaches(long, b"word", 2, 50)


def test_a_text_in_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MEETS", 3)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in neardup.near_duplicates(df, 2).collect()} == brute(rows, 2, 80)


def test_estimate_follows_similarity():
    rng = np.random.default_rng(0)
    for j in (0.5, 0.8, 0.9):
        got = []
        for _ in range(30):
            n = 3000
            common = rng.integers(0, 2**63, int(n * j), dtype=np.uint64) * np.uint64(2)
            rest = rng.integers(0, 2**63, (2, (n - len(common)) // 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            a, b = (neardup.sketch(np.unique(np.concatenate((common, r)))) for r in rest)
            got.append(np.mean(a.view("<u2") == b.view("<u2")))
        assert abs(np.mean(got) - j) < 0.03
