"""Byte-level BPE encoding and decoding over length-bucketed padded numpy matrices.

Pieces of equal length form the rows of one matrix of token ids. In each round every row finds its adjacent pair of
minimum rank (the leftmost on ties) through a hashed pair table, merges it and is compacted by one column; rows with
no pair left drop out. A piece that is itself a token is that token, as in the tiktoken library. Pieces longer than
LONG_PIECE bytes would need as many rounds as they have bytes, so they are rows of their own, in which a round merges
every pair of the minimum rank: the same merges in as many rounds as there are different ranks.

Defined results: a null text is encoded as the empty text (no ids); an empty table gives no rows; repeated rows are
each encoded; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes beyond which a piece is a row of its own.
LONG_PIECE = 256
#: Matrix cells that are worked on at once, and pieces that a worker remembers.
CELLS, REMEMBERED = 1 << 18, 300_000
#: Characters that are split into pieces at once.
LONG_TEXT = 1 << 20

#: Letters and numbers that the regex module knows and Unicode 16, to which the tiktoken library keeps, doesn't.
LATER = {
    r"\p{L}": (
        "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf "
        "10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 "
        "187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 "
        "1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed "
        "1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
    ),
    r"\p{N}": "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6",
}

_NONE = np.uint32(0xFFFFFFFF)
_M1 = np.uint64(0x9E3779B97F4A7C15)


def _set(ranges: str) -> str:
    return "".join("-".join(rf"\U{int(x, 16):08x}" for x in r.split("-")) for r in ranges.split())


class PairTable:
    """Open addressing from (left id, right id) to the id of the merged token, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.vals = np.full(size, _NONE, np.uint32)
        key = self.key(left, right)
        todo, slot, self.probes = np.arange(len(key)), self.slot(key), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            at, who = np.unique(slot[todo][free], return_index=True)
            put = todo[free][who]
            self.keys[at], self.vals[at] = key[put], merged[put]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _M1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; 0xFFFFFFFF where the pair merges into no token."""
        key = self.key(left, right)
        slot = self.slot(key)
        out = np.where(self.keys[slot] == key, self.vals[slot], _NONE)
        todo = np.flatnonzero((self.keys[slot] != key) & (self.vals[slot] != _NONE))
        for _ in range(1, self.probes):
            if not len(todo):
                break
            s = (slot[todo] + 1) & ((1 << self.bits) - 1)
            slot[todo] = s
            same = self.keys[s] == key[todo]
            out[todo[same]] = self.vals[s][same]
            todo = todo[~same & (self.vals[s] != _NONE)]
        return out


class BytePairs:
    """Encoder and decoder for one rank file. Ids are ranks; any rank file with all 256 single bytes will do."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.later, strict = regex.compile(f"[{''.join(map(_set, LATER.values()))}]"), pattern
        for name, ranges in LATER.items():
            strict = strict.replace(name, f"[{name}--[{_set(ranges)}]]")
        self.strict = regex.compile(strict, regex.V1)
        n = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * n
        for token, i in ranks.items():
            self.tokens[i] = token
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.uint32)
        triples = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        cols = np.array(triples, np.uint32).reshape(-1, 3)
        self.pairs = PairTable(cols[:, 0], cols[:, 1], cols[:, 2])
        self.known: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def merge_matrix(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges each row (equal-length byte pieces, k x length) to the end. Returns padded ids and the ids' counts."""
        k, width = rows.shape
        out, count = np.zeros((k, width), np.uint32), np.full(k, width)
        live, ids = np.arange(k), self.single[rows]
        ranks = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(k, width - 1) if width > 1 else np.zeros((k, 0), np.uint32)
        while True:
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(live), np.int64)
            each = np.arange(len(live))
            go = ranks[each, best] != _NONE if ranks.shape[1] else np.zeros(len(live), bool)
            if not go.all():
                done = live[~go]
                out[done, : ids.shape[1]], count[done] = ids[~go], ids.shape[1]
                live, ids, ranks, best = live[go], ids[go], ranks[go], best[go]
                each = np.arange(len(live))
            if not len(live):
                return out, count
            ids[each, best] = ranks[each, best]
            w = ids.shape[1]
            keep = np.arange(w) != (best + 1)[:, None]
            ids = ids[keep].reshape(len(live), w - 1)
            ranks = ranks[keep[:, 1:]].reshape(len(live), w - 2)  # the merged pair's own column goes
            if w > 2:
                r = np.flatnonzero(best > 0)
                ranks[r, best[r] - 1] = self.pairs.find(ids[r, best[r] - 1], ids[r, best[r]])
                r = np.flatnonzero(best < w - 2)
                ranks[r, best[r]] = self.pairs.find(ids[r, best[r]], ids[r, best[r] + 1])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: a row of its own, whose pairs of minimum rank are merged in one round.

        The row's next rounds would merge just these, from the left, unless a merge makes a pair of its rank or below;
        the round ends with the first that does.
        """
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == least)
            if len(at) > 1:  # of pairs that overlap every other one, from the left
                each = np.arange(len(at))
                run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, each, 0))
                at = at[(each - run) % 2 == 0]
                # the pairs that each merge makes: what is left of it is merged by then, what is right of it isn't
                before = np.where(np.diff(at, prepend=-3) == 2, least, ids[at - 1])
                new = self.pairs.find(before, np.full(len(at), least))
                new[at == 0] = _NONE
                after = self.pairs.find(np.full(len(at), least), ids[np.minimum(at + 2, len(ids) - 1)])
                after[at + 2 >= len(ids)] = _NONE
                early = np.flatnonzero(np.minimum(new, after) <= least)
                at = at[: early[0] + 1] if len(early) else at
            ids[at] = least
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids = ids[stays]
            ranks = np.delete(ranks, at)
            at = at - np.arange(len(at))  # where the merged ones are now
            near = np.unique(np.concatenate((at[at > 0] - 1, at[at < len(ids) - 1])))
            ranks[near] = self.pairs.find(ids[near], ids[near + 1])
        return ids

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Each distinct piece's ids as little-endian unsigned 32-bit integers."""
        found: dict[str, bytes] = {}
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode()
            if (whole := self.ranks.get(raw)) is not None:
                found[p] = whole.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                found[p] = self.merge_long(raw).astype("<u4").tobytes()
            else:
                by_length.setdefault(len(raw), []).append((p, raw))
        for length, rows in by_length.items():
            step = max(1, CELLS // length)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                ids, count = self.merge_matrix(np.frombuffer(b"".join(r for _, r in part), np.uint8).reshape(len(part), length))
                flat = ids[np.arange(length) < count[:, None]].astype("<u4").tobytes()
                ends = np.cumsum(count * 4).tolist()
                begin = 0
                for (p, _), end in zip(part, ends, strict=True):
                    found[p] = flat[begin:end]
                    begin = end
        return found

    def pattern_for(self, text: str) -> regex.Pattern:
        """The pattern itself, or where the text holds characters of a later Unicode, its slower exact form."""
        return self.strict if not text.isascii() and self.later.search(text) else self.pattern

    def learn(self, pieces: set[str]) -> None:
        """Encodes what is not yet known, in one go; forgets all else when too much would be known."""
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = pieces
        self.known.update(self.encode_pieces(list(new)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers. For texts of up to about LONG_TEXT in all."""
        split = [self.pattern_for(t).findall(t) for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]

    def encode_long(self, text: str) -> bytes:
        """The same for one text of any length, holding a bounded number of pieces at a time."""
        found, out = (m.group() for m in self.pattern_for(text).finditer(text)), []
        while pieces := list(itertools.islice(found, 100_000)):
            self.learn(set(pieces))
            out.append(b"".join(map(self.known.__getitem__, pieces)))
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, in order, working on groups of up to LONG_TEXT characters."""
        group: list[str] = []
        n = 0
        for t in texts:
            if len(t) > LONG_TEXT or n + len(t) > LONG_TEXT:
                yield from self.encode(group)
                group, n = [], 0
            if len(t) > LONG_TEXT:
                yield self.encode_long(t)
            else:
                group.append(t)
                n += len(t)
        yield from self.encode(group)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after the other."""
        size = self.size[ids]
        total = int(size.sum())
        if not total:
            return b""
        ends = np.cumsum(size)
        at = np.arange(total) + np.repeat(self.start[ids] - (ends - size), size)
        return self.bytes[at].tobytes()


_LOADED: dict[tuple[str, str], BytePairs] = {}


def loaded(path: str, pattern: str) -> BytePairs:
    """One encoder for each rank file and Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = BytePairs.from_file(path, pattern)
    return _LOADED[path, pattern]


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 of the round trip; with_ids adds the ids as array<int>.

    One narrow pass without a shuffle: the rank file is read once by each worker (it must be there on every
    executor, as the tokenizer package is), texts stream through in Arrow batches.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        bpe = loaded(path, pattern)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                part = [t or "" for t in texts.slice(at, 256).to_pylist()]
                n, ids_sha, dec_sha, lists = [], [], [], []
                for raw in bpe.encode_all(part):
                    ids = np.frombuffer(raw, "<u4")
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    dec_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    if with_ids:
                        lists.append(ids.astype(np.int32))
                cols = [batch.column(0).slice(at, 256), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
