import hashlib
import re

import public_tokenizers as P

import corpus_pipeline
from brindle.llm import bpe, pii
from brindle.llm.queries import DEMO_KEY
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_neardup import brute as components


def test_stages_as_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append({r.doc_id: r for r in docs.collect()})
    original = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    labelled = [i for i in quality if i in original]
    assert sum((i in seen[0]) == quality[i] for i in labelled) / len(labelled) > 0.95
    rows = [(i, r.text) for i, r in sorted(seen[0].items())]
    assert set(seen[1]) == {i for i, _, _, kept in components(rows, 5, 80) if kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, _ in leaks([(i, r.text) for i, r in seen[1].items()], items)}
    assert bad and set(seen[2]) == set(seen[1]) - bad
    p = pii.Pseudonyms(DEMO_KEY)
    assert {i: r.text for i, r in seen[3].items()} == {i: p.replace(r.text)[0] for i, r in seen[2].items()}
    assert any(seen[3][i].text != seen[2][i].text for i in seen[3])
    assert not any(re.search(r"@mail\d\.example", r.text) and r.text == seen[2][i].text for i, r in seen[3].items())
    enc = bpe.loaded(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for i, r in seen[4].items():
        raw = next(iter(enc.encode_all([seen[3][i].text])))
        assert r.n_tokens == len(raw) // 4 and r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(seen[3][i].text.encode()).hexdigest()
    whole = {tuple(r) for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {tuple(r) for r in seen[4].values()}


def test_stages_take_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", 5), (3, long, "en", "s", 5), (4, long + " tail", None, "s", 5), (None, "call +1 (389) 555-5010", None, None, None), (None, "call +1 (389) 555-5010", None, None, None), (5, "call +1 (389) 555-5010 now", "en", None, 1)]
    odd = spark.createDataFrame([(*r, 9.0, 1, "k", "h") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, kinds string, n_found string")
    for docs in (odd, odd.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            got = out.collect()
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            if docs is odd and i == 1:
                assert sorted((r.doc_id or 0, len(r.text or "")) for r in got) == sorted([(1, 0), (2, 0), (3, len(long)), (0, 22), (5, 26)])
            if docs is odd and i == 3:
                assert not any("389) 555-5010" in (r.text or "") for r in got) and len(got) == len(rows)
