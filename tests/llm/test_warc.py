import base64
import hashlib
import io
import random
import tracemalloc
import zlib

import pyarrow as pa
import pytest

from brindle.llm import warc
from brindle.llm.queries import QUERIES


def expected(rows):
    """Rows of the round trip by the definition."""
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and (b not in first or i < first[b]):
            first[b] = i
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = i is not None and first[b] != i
        out.append((i, len(b), warc.base32_sha1(b), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def test_round_trip_of_odd_pages(spark):
    rng = random.Random(0)
    rows = [(i, f"http://x/{i}", "é" * rng.randrange(50) if i % 3 else "same payload") for i in range(300)]
    rows += [(1000, None, None), (1001, "u\r\nX: y", ""), (1002, "u", None), (None, "u", "same payload"), (None, "u", "other"), (5, "u", "same id, other payload"), (1003, "u", "z" * 3_000_000), (0, "twice", "same payload")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == expected(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_headers_longer_than_a_read():
    rng = random.Random(4)
    urls = ["data:text/plain;base64," + base64.b64encode(rng.randbytes(n)).decode() for n in (75_000, 600_000)]
    members = [warc.page_record(i, u, b"payload", None, "2024-01-01T00:00:00Z") for i, u in enumerate([*urls, "http://x/"])]
    data = b"".join([members[0], zlib.compress(b"WARX/1.1" * 30_000, wbits=31), zlib.compress(b"WARC/1.1" * 30_000, wbits=31), *members[1:]])
    got = list(warc.records(warc._Window(io.BytesIO(data), len(data)), 0, len(data)))
    assert [(h["warc-target-uri"], b.endswith(b"payload")) for _, h, b in got] == [(u, True) for u in [*urls, "http://x/"]]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, QUERIES["op4_warc"](spark, sf).collect()), key=str) == expected(rows)


def test_smaller_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    assert {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df, 5).collect()} == {(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)}


@pytest.fixture
def archive(tmp_path):
    rng = random.Random(3)
    blocks = [rng.randbytes(rng.randrange(2000)) + warc.MAGIC * 3 + b"\x1f\x8b\x08\x00WARC/1.1" for _ in range(60)]
    members = [warc.record("resource", [("WARC-Record-ID", f"<urn:x:{i}>")], b) for i, b in enumerate(blocks)]
    return tmp_path, blocks, members


@pytest.mark.parametrize("split", [1, 17, 500, 4096, 10**7])
def test_every_record_has_one_owner(archive, split):
    folder, blocks, members = archive
    data = b"".join(members)
    (folder / "a.warc.gz").write_bytes(data)
    got = []
    with open(folder / "a.warc.gz", "rb") as f:
        for start in range(0, len(data), split) if split > 1 else range(0, 3000):
            got += [b for _, _, b in warc.records(warc._Window(f, len(data), 999), start, min(len(data), start + split))]
    assert got == blocks if split > 1 else got == blocks[: len(got)]


def test_damage_costs_only_what_is_damaged(archive):
    folder, blocks, members = archive
    bad = bytearray(members[7])
    bad[len(bad) // 2] ^= 0xFF
    data = b"".join(members[:7]) + bytes(bad) + b"noise" + b"".join(members[8:20]) + members[20][:-9]
    (folder / "b.warc.gz").write_bytes(data)
    with open(folder / "b.warc.gz", "rb") as f:
        got = [b for _, _, b in warc.records(warc._Window(f, len(data)), 0, len(data))]
    assert got == blocks[:7] + blocks[8:20]


def test_plain_gzip_tools_read_it():
    m = warc.page_record(1, "http://x", b"hello", None, "2024-01-01T00:00:00Z")
    text = zlib.decompress(m, 31)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"hello\r\n\r\n")
    assert hashlib.sha1(b"hello").digest()


def test_pages_of_a_batch_are_made_one_at_a_time():
    html = ["é" * 500_000 + "\U0001f600", None] * 30
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(["u"] * 60), pa.array(html), pa.nulls(60, pa.int64())], ["page_id", "url", "html", "refers_to"])
    tracemalloc.start()
    got = [(i, u, len(h), h[-4:], r) for i, u, h, r in warc._pages(batch)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(i, "u", 0 if i % 2 else 1_000_004, b"" if i % 2 else "\U0001f600".encode(), None) for i in range(60)]
    assert peak < 4_000_000


def test_payloads_stay_in_the_workers_where_nobody_wants_them(spark, tmp_path):
    rows = [(i, "u", "é" * i) for i in range(40)] + [(50, None, "é" * 7), (51, "u", None)]
    files = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), warc.uri(str(tmp_path / "w")))
    whole, narrow = warc.read_archives(spark, files, 300), warc.read_archives(spark, files, 300, with_payload=False)
    assert narrow.columns == whole.columns[:-1]
    assert sorted(map(tuple, narrow.collect()), key=str) == sorted((tuple(r)[:-1] for r in whole.collect()), key=str)
    assert all(r.digest_ok for r in narrow.filter("warc_type = 'response'").collect())
    assert "payload#" not in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))._jdf.queryExecution().analyzed().toString()
