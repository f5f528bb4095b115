import random
import zlib

import numpy as np
import pytest

from brindle.llm import langid, quality
from brindle.llm import text as tx
from brindle.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_word_hashes_do_not_depend_on_place():
    a, n = tx.word_hashes([b"the cat", b"", b" a the\tthe ", b"The"])
    assert n.tolist() == [0, 2, 2, 5, 6]
    assert a[0] == a[3] == a[4] != a[1] and a[0] != a[5]
    folded, _ = tx.word_hashes([b"THE the"], fold=True)
    assert folded[0] == folded[1]
    long = b"word " * 500_000 + b"x" * 100
    h, n = tx.word_hashes([long, b"word"])
    assert n.tolist() == [0, 500_001, 500_002] and len(set(h[:500_000].tolist())) == 1 and h[0] == h[-1]


def test_pieces_are_as_the_whole():
    rng = random.Random(4)
    text = "".join(rng.choice("abc \nÄéΣσ𝒳ß") for _ in range(5000))
    whole = langid.counts(text, 10**6)
    assert whole.sum() == 3 * len(text.lower()) - 3
    raw = text.encode()
    grams = np.bincount(np.concatenate(list(quality.features(raw))), minlength=quality.BUCKETS)
    for piece in (1, 2, 7, 4096):
        assert (langid.counts(text, piece) == whole).all()
        assert (np.bincount(np.concatenate(list(quality.features(raw, piece))), minlength=quality.BUCKETS) == grams).all()
    words = raw.split()
    assert len(np.concatenate(list(quality.features(raw)))) == 3 * len(words) - 4 + 2 * len(raw) - 6
    assert [p for size in (1, 50, 10**6) for p in b"".join(tx.pieces_at_space(raw, size)).split()] == words * 3


def test_samples_are_bounded_by_rows(spark):
    rows = [(7, f"eins zwei {i}", "de") for i in range(60)] + [(8, "one two", "en")] * 60 + [(i, f"drei {i}", "de") for i in range(100, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid._sampled(df, 20)
    assert sorted((r.lang, r["count"]) for r in got.groupBy("lang").count().collect()) == [("de", 20), ("en", 1)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()
    labelled = spark.createDataFrame([(7, 1), (8, 0), (100, 1), (101, 0), (None, 1)], "doc_id long, label int")
    taken = quality._sampled(labelled, df, 3)
    assert taken.count() == 3
    assert sorted(r.doc_id for r in quality._sampled(labelled, df, 1000).collect()) == [7] * 4 + [8] * 4 + [100, 101]


def test_language_on_held_out(spark):
    got = QUERIES["op1_langid"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").toPandas()
    assert len(got) == len(docs)
    m = got.merge(docs, on="doc_id")
    assert (m.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in m.doc_id]).all()
    assert (m[m.held_out].lang_pred == m[m.held_out].lang).mean() > 0.97
    assert m.score.between(0, 1).all()


def test_quality_on_held_out(spark):
    got = QUERIES["op8_quality"](spark, SF).toPandas()
    m = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    m = m[m.held_out]
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (m.predicted == m.quality).mean() > 0.97
    assert m.score[m.quality == 1].mean() > m.score[m.quality == 0].mean() + 0.5
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


@pytest.fixture
def odd(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "123 !!", None, "a"), (4, "the cat and the dog", "en", "b"), (4, "the cat and the dog", "en", "b"), (5, "der Hund und die Katze " * 30_000, "de", None), (None, "ein Haus", "de", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_odd_rows(spark, odd):
    got = sorted(langid.identify(odd).collect(), key=str)
    assert len(got) == 7 and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id in (4, 5)} <= {"en", "de"}
    assert {r.lang_pred for r in langid.identify(odd, odd.doc_id.isNotNull() | odd.doc_id.isNull()).collect()} == {"und"}
    assert langid.identify(odd.limit(0)).count() == 0
    labels = spark.createDataFrame([(4, 1, "x"), (5, 0, "x"), (None, 1, "x"), (2, None, "x")], "doc_id long, quality int, text string")
    scored = quality.quality(odd, labels).toPandas()
    assert len(scored) == 7 and scored.score.between(0, 1).all()
    none = quality.quality(odd, labels.limit(0)).toPandas()
    assert np.allclose(none.score, 0.5)
    one = quality.quality(odd, labels.filter("quality = 1")).toPandas()
    assert (one.predicted == 1).all()
    assert quality.quality(odd.limit(0), labels).count() == 0
