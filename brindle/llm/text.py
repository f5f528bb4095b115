"""Texts as bytes: words and their hashes, rolling hashes of substrings, bounded pieces of long texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_digest

#: Bytes of text that are worked on at once; longer texts come in several pieces.
PIECE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit value for each byte, and odd powers with their inverses: hashes of substrings by prefix sums.
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_P = int(0x9E3779B97F4A7C15) | 1
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        have += take
    return out


_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n, kept and grown on demand."""
    if not _POW or len(_POW["up"]) < n:
        size = max(n, PIECE + 4096)
        _POW["up"], _POW["down"] = _powers(_P, size), _powers(pow(_P, -1, 1 << 64), size)
    return _POW["up"][:n], _POW["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix(buf: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """Prefix sums of table[byte] * P**i, one longer than buf."""
    up, _ = powers(len(buf))
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    np.cumsum(table[buf] * up, out=out[1:])
    return out


def spans_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each buf[start:end], the same wherever it lies."""
    _, down = powers(len(pre))
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def raw(column: pa.Array) -> list[bytes]:
    """The texts of a string column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def groups(texts: list[bytes], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``limit`` bytes in all; a longer text comes alone."""
    at = total = 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > limit:
            yield at, i
            at, total = i, 0
        total += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def pieces_at_space(text: bytes, size: int = 0) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that end at white space, so that no word is cut."""
    size, at = size or PIECE, 0
    while len(text) - at > size:
        m = _SPACE.search(text, at + size)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def word_hashes(texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space) of the texts in order, and the number of words up to each
    text (one longer than texts). fold: A-Z count as a-z. Unlike hashes by prefix sums, these have no structure that
    two words could share."""
    parts, count = [np.zeros(0, np.uint64)], [0]
    for t in texts:
        n = 0
        for piece in pieces_at_space(t):
            found = (piece.lower() if fold else piece).split()  # of bytes: ASCII only, in both
            parts.append(np.frombuffer(b"".join(map(xxh3_64_digest, found)), "<u8"))
            n += len(found)
        count.append(count[-1] + n)
    return np.concatenate(parts), np.array(count)
