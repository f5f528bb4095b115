import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from brindle.llm import repeats
from brindle.llm.queries import QUERIES


def brute(rows, length):
    """Per row: n_bytes, n_removed, n_spans, kept_sha256, by counting every string."""
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        gone[-1] = False
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone[:-1], strict=True) if not g)
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed, length):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (length - 1, length, length + 1, length * 2, length * 5)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(4)):
            parts.append("".join(rng.choice("abcdé ") for _ in range(rng.randrange(length * 2))))
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randrange(len(p) // 3 + 1)
                parts.append(p[a : len(p) - rng.randrange(len(p) // 3 + 1)] if rng.random() < 0.5 else p)
        rows.append((i, "".join(parts)))
    rows += [(200, "x" * (length * 3)), (201, "x" * (length - 1)), (202, "xy" * length), (203, None), (204, ""), (205, rows[3][1]), (3, rows[3][1]), (None, rows[5][1] + "z"), (206, "ab" * length + "ab" * length), (207, "\x00" * (length + 5))]
    return rows


@pytest.mark.parametrize(("seed", "length", "gram", "block", "hot"), [(1, 40, 8, 8192, 6000), (2, 40, 8, 5, 6000), (3, 24, 8, 100, 3), (4, 200, 32, 40, 0)])
def test_as_brute_force(spark, seed, length, gram, block, hot):
    rows = made(seed, length)
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, row string").repartition(3)
    got = sorted(map(tuple, repeats.without_repeats(df, length, gram, block, hot).collect()), key=str)
    assert got == brute(rows, length)


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.without_repeats(df).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op9_repeats"](spark, sf).collect()), key=str) == brute(rows, 200)


@pytest.mark.parametrize("seed", range(8))
def test_transform_finds_what_rows_share(seed):
    rng = np.random.default_rng(seed)
    n, width, length = 60, 23, 9
    bucket = np.sort(rng.integers(0, 6, n))
    bases = rng.integers(97, 100, (6, width))
    cells = np.where(rng.random((n, width)) < 0.06, rng.integers(97, 100, (n, width)), bases[bucket]).astype(np.uint8)
    for i in range(n):
        cells[i, : rng.integers(0, 5)] = repeats._SEPARATOR
        cells[i, width - rng.integers(0, 5) :] = repeats._SEPARATOR
    got = repeats.repeated_starts(cells, bucket, length)
    for i in range(n):
        for c in range(width - length + 1):
            s = cells[i, c : c + length]
            same = any(j != i and bucket[j] == bucket[i] and (cells[j, c : c + length] == s).all() for j in range(n))
            assert got[i, c] == (same and repeats._SEPARATOR not in s)


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_equal_strings_choose_equal_windows(monkeypatch, piece):
    monkeypatch.setattr(repeats.tx, "PIECE", piece)
    rng = random.Random(5)
    same = bytes(rng.randrange(97, 100) for _ in range(50))
    a, b = (np.frombuffer(bytes(rng.randrange(97, 100) for _ in range(n)) + same + b"tail" * n, np.uint8) for n in (33, 70))
    (pa_, ha), (pb, hb) = (repeats.chosen(x, 40, 8) for x in (a, b))
    for off in range(11):
        one = {(p - 33 - off, h) for p, h in zip(pa_.tolist(), ha.tolist(), strict=True) if 0 <= p - 33 - off <= 32}
        two = {(p - 70 - off, h) for p, h in zip(pb.tolist(), hb.tolist(), strict=True) if 0 <= p - 70 - off <= 32}
        assert one & two


class Direct:
    """Stands for a DataFrame: mapInArrow gives the function itself."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_texts_of_a_batch_are_made_a_group_at_a_time():
    column = pa.array([None, "é" * 150_000, "", "x" * 2_000_000, "y" * 300_000] * 12).slice(1)
    tracemalloc.start()
    got = [(lo + i, len(t), hashlib.sha256(t).digest()) for lo, texts in repeats._texts(column) for i, t in enumerate(texts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(i, len(t), hashlib.sha256(t).digest()) for i, t in enumerate((x or "").encode() for x in column.to_pylist())]
    assert peak < 5_000_000
    assert list(repeats._texts(column.slice(0, 0))) == []


def test_contexts_of_a_long_text_come_in_several_batches(tmp_path):
    text = "".join(random.Random(6).choices("abcdé", k=300_000))
    raw = text.encode()
    pos = np.arange(0, len(raw) - 32, 40)
    (tmp_path / "fid=7").mkdir()
    pq.write_table(pa.table({"row": np.full(len(pos), 1), "pos": pos, "n": np.ones(len(pos), np.int64), "fp": pos * 3, "d": np.full(len(pos), 2)}), tmp_path / "fid=7/a.parquet")
    batch = pa.RecordBatch.from_arrays([pa.array([None, text]), pa.array([7, 7]), pa.array([0, 1])], ["text", "fid", "row"])
    got = list(repeats._contexts(Direct(), f"file://{tmp_path}", 200, 32)([batch]))
    assert len(got) > 1 and all(sum(map(len, b.column(7).to_pylist())) <= (1 << 20) + 368 for b in got)
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert rows == [(p * 3, 2, False, 7, 1, p, max(0, p - 168), raw[max(0, p - 168) : p + 200]) for p in pos.tolist()]
