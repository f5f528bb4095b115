import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    return bpe.loaded(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(ours, text):
    return np.frombuffer(next(iter(ours.encode_all([text]))), "<u4").tolist()


TEXTS = ["", " ", "a", "the cat's  hat\n\n x", "Größe élève niño 中文字 😀😀", "a" * 5000, "ab" * 700, "x" * 257, "\x1c\x1d\x85   ​ b", "1234567890" * 60, "<|endoftext|>", "\x00\x01", "aAbB" * 300 + "é" * 400]


@pytest.mark.parametrize("text", TEXTS)
def test_as_tiktoken(ours, theirs, text):
    assert ids(ours, text) == theirs.encode_ordinary(text)
    assert ours.decode(np.array(ids(ours, text), np.int64)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(ours, theirs, text):
    assert ids(ours, text) == theirs.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abthe nioéß", min_size=200, max_size=700))
def test_long_pieces_either_way(ours, theirs, text):
    text = text.replace(" ", "")
    raw = text.encode()
    assert ours.merge_long(raw).tolist() == theirs._core_bpe.encode_single_piece(raw)
    m, n = ours.merge_matrix(np.frombuffer(raw, np.uint8).reshape(1, -1))
    assert m[0, : n[0]].tolist() == theirs._core_bpe.encode_single_piece(raw)


@pytest.mark.parametrize("text", ["a" * 20_001, "ab" * 10_000, "abc" * 7000, "the" * 5000, "é" * 9000])
def test_repetitive_pieces_take_few_rounds(ours, theirs, text):
    import time

    began = time.process_time()
    got = ours.merge_long(text.encode()).tolist()
    assert time.process_time() - began < 5
    assert got == theirs._core_bpe.encode_single_piece(text.encode())


def test_every_character_splits_alike(ours, theirs):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    bad = [c for c in chars if c.isprintable() is False or c.isspace()]
    for at in range(0, len(bad), 2000):
        text = "".join(f"a{c} {c}1{c}" for c in bad[at : at + 2000])
        assert ids(ours, text) == theirs.encode_ordinary(text)


def test_documents(spark, ours, theirs):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world", "y"), (3, "Hello  world", "y"), (None, "z" * 300, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(df, PATH, P.PATTERN).collect()}
    want = set()
    for i, t, _ in rows:
        x = np.array(theirs.encode_ordinary(t or ""), "<u4")
        want.add((i, len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert bpe.encode_documents(df.limit(0), PATH, P.PATTERN).count() == 0
    assert bpe.encode_documents(df, PATH, P.PATTERN, with_ids=True).filter("doc_id = 3").first().ids == theirs.encode_ordinary("Hello  world")
