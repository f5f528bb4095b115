"""Removal of repeated substrings: every byte covered by a string of LENGTH bytes that also starts elsewhere.

Three narrow passes over the texts, which are never shuffled:

1. Fingerprints. Of each run of LENGTH - GRAM + 1 consecutive GRAM-byte windows the one of least hash is chosen, so
   two equal strings of LENGTH bytes choose the same windows in them. Each choice is noted with its place and a hash of
   its context, all the bytes that strings of LENGTH around it can cover. Choices that occur once are done with.
   Contexts that occur twice are covered as they stand.
2. For what is left (equal windows in different contexts: the edges of repeated passages) the contexts are read again
   from the places noted and brought together by fingerprint. Within a fingerprint they are aligned, so the
   Burrows-Wheeler transform is kept in its positional form, and all intervals are extended backward together, a byte
   a step: the common prefixes of neighbours grow from 0 and are followed up to LENGTH, no further. Strings of LENGTH
   bytes that a neighbour shares are repeated. Fingerprints with more contexts than one task should hold (a passage in
   a third of all documents) are resolved by grouping hashes of their LENGTH-byte strings instead.
3. Each text is read once more, next to the intervals noted for its place, and cut.

Places are (file, row in the file), which do not depend on how files are split into tasks, so lost tasks can be run
again; a DataFrame that isn't a plain file scan is written to the shared folder first. Fingerprints and contexts are
compared as 64-bit hashes, two to a decision; the transform compares bytes.

Defined results: a null text is empty: 0 bytes, nothing removed, the hash of nothing. Texts under LENGTH bytes stay
whole. Repeated rows are different places, so texts of LENGTH bytes or more that occur twice go in full. An empty table
gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import shared
from brindle.llm import text as tx

LENGTH, GRAM = 200, 32
#: Contexts in one transform; contexts of a fingerprint beyond which hashes are grouped.
BLOCK, HOT = 8192, 100_000
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SEPARATOR = 0xFF  # not in UTF-8


def _sliding(h: np.ndarray, w: int, f) -> np.ndarray:
    """f.reduce over each run of w values, in constant time a value."""
    n = len(h)
    pad = -n % w
    x = np.concatenate((h, np.full(pad, h[-1]))).reshape(-1, w)
    ahead = f.accumulate(x, axis=1).ravel()
    back = f.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - w + 1], ahead[w - 1 : n])


def chosen(buf: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows chosen in a text; every string of ``length`` bytes holds one."""
    w = length - gram + 1
    n = len(buf) - gram + 1
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, hashes = [], []
    for at in range(0, n, tx.PIECE):  # long texts in pieces that overlap by the windows' reach
        lo, hi = max(0, at - w + 1), min(n, at + tx.PIECE + w - 1)
        part = buf[lo : hi + gram - 1]
        pre = tx.prefix(part)
        _, down = tx.powers(len(pre))
        h = tx.mix((pre[gram:] - pre[:-gram]) * down[: hi - lo])
        if len(h) < w:
            continue
        least = _sliding(h, w, np.minimum)
        most = _sliding(np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64))), w, np.maximum)
        p = np.flatnonzero(most == h)
        p = p[(p + lo >= at) & (p + lo < at + tx.PIECE)]
        places.append(p + lo)
        hashes.append(h[p])
    return np.concatenate(places), np.concatenate(hashes)


def context(p: np.ndarray, n: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the bytes that strings of ``length`` around the windows at p can cover, in a text of n."""
    return np.maximum(0, p - (length - gram)), np.minimum(n, p + length)


def context_hashes(buf: np.ndarray, p: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Equal only for equal contexts around windows at the same place in them."""
    out = np.empty(len(p), np.uint64)
    start, end = context(p, len(buf), length, gram)
    at = 0
    while at < len(p):
        base = start[at]
        stop = int(np.searchsorted(end, base + tx.PIECE, "right"))
        stop = max(stop, at + 1)
        pre = tx.prefix(buf[base : end[stop - 1]])
        h = tx.spans_hash(pre, start[at:stop] - base, end[at:stop] - base)
        out[at:stop] = tx.mix(h + (p[at:stop] - start[at:stop]).astype(np.uint64) * _C1 + _C3)
        at = stop
    return out


def repeated_starts(cells: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Where strings of ``length`` bytes begin that another row of the same bucket has at the same column.

    cells: a row of bytes for each context, aligned by its fingerprint, _SEPARATOR where the text has ended. bucket:
    the rows' fingerprints as ascending numbers. The transform is kept column by column: from the last column on, the
    rows of a bucket stand in the order of the bytes that follow, together with the common prefix of each with the row
    before. Extending all strings backward by one byte is a stable sort by that byte; rows that it leaves or makes
    neighbours share one byte more than the least of what lay between them, others nothing. Prefixes are counted up to
    ``length`` and no further.
    """
    n, width = cells.shape
    out = np.zeros((n, max(0, width - length + 1)), bool)
    order, common = np.arange(n), np.zeros(n + 1, np.int16)
    base = bucket.astype(np.int64) << 8
    columns = np.ascontiguousarray(cells.T)
    for c in range(width - 1, -1, -1):
        key = base + columns[c][order]
        turn = np.argsort(key, kind="stable")
        key = key[turn]
        shared_byte = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] & 0xFF != _SEPARATOR))
        above, below = turn[shared_byte], turn[shared_byte + 1]
        least = common[below]
        far = np.flatnonzero(below != above + 1)
        if len(far):
            ranges = np.stack((above[far] + 1, below[far] + 1), axis=1).ravel()
            least[far] = np.minimum.reduceat(common, ranges)[::2]
        common = np.zeros(n + 1, np.int16)
        common[shared_byte + 1] = np.minimum(least + 1, length)
        order = order[turn]
        if c <= width - length:
            enough = common >= length
            out[order[enough[:-1] | enough[1:]], c] = True
    return out


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint ones, not touching, in order."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    start, reach = start[o], np.maximum.accumulate(end[o])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], np.append(reach[:-1][new[1:]], reach[-1])


class Notes:
    """Rows noted for places of a file, in Parquet partitioned by file and sorted by row, read a row range at a time."""

    def __init__(self, path: str, columns: list[str]):
        self.fs, self.root = pafs.FileSystem.from_uri(path)
        self.columns, self.files = columns, {}

    def read(self, fid: int, low: int, high: int) -> dict[str, np.ndarray]:
        if fid not in self.files:
            found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/fid={fid}", allow_not_found=True))
            self.files = {fid: [f.path for f in found if f.is_file and f.path.endswith(".parquet")]}
        parts = [pq.read_table(f, filesystem=self.fs, columns=self.columns, partitioning=None, filters=[("row", ">=", low), ("row", "<=", high)]) for f in self.files[fid]]
        if not parts:
            return {c: np.zeros(0, np.int64) for c in self.columns}
        got = {c: np.concatenate([t.column(c).to_numpy() for t in parts]) for c in self.columns}
        o = np.argsort(got["row"], kind="stable")
        return {c: v[o] for c, v in got.items()}


def _noted(df: DataFrame, name: str) -> str:
    """Writes rows with fid and row for Notes, in files of small row groups; a long file's rows go to several tasks."""
    path = shared.fresh(df.sparkSession, name)
    spread = df.repartition("fid", F.expr("row div 65536")).sortWithinPartitions("fid", "row")
    spread.write.partitionBy("fid").option("parquet.block.size", 4 << 20).parquet(path)
    return path if "://" in path else ("file:///" + path.removeprefix("file:").lstrip("/"))


def _placed(docs: DataFrame) -> DataFrame:
    """docs with fid and row, the place of each row in its file."""
    try:
        return docs.select("doc_id", "text", F.xxhash64("_metadata.file_path").alias("fid"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        docs = shared.written(docs.select("doc_id", "text"), "documents")
        return docs.select("doc_id", "text", F.xxhash64("_metadata.file_path").alias("fid"), F.col("_metadata.row_index").alias("row"))


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The place of the first and the texts as bytes, null as empty, of groups of rows up to tx.PIECE bytes in all; made
    a group at a time, since a batch holds many times that. A longer text comes alone."""
    at = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > at and total + n > tx.PIECE:
            yield at, tx.raw(column.slice(at, i - at))
            at, total = i, 0
        total += n + 1
    if at < len(column):
        yield at, tx.raw(column.slice(at))


def _fingerprints(placed: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            fids, rows = (c.to_numpy() for c in batch.columns[1:])
            for lo, texts in _texts(batch.column(0)):
                hi = lo + len(texts)
                n, pos, fp, ctx, size = [], [], [], [], []
                for t in texts:
                    buf = np.frombuffer(t, np.uint8)
                    p, h = chosen(buf, length, gram)
                    n.append(len(p))
                    pos.append(p)
                    fp.append(h)
                    ctx.append(context_hashes(buf, p, length, gram) if len(p) else h)
                    size.append(np.full(len(p), len(t)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fids[lo:hi], n)), pa.array(np.repeat(rows[lo:hi], n)), pa.array(np.concatenate(pos)), pa.array(np.concatenate(size)), pa.array(np.concatenate(fp).view(np.int64)), pa.array(np.concatenate(ctx).view(np.int64))], ["fid", "row", "pos", "size", "fp", "ctx"])

    return placed.select("text", "fid", "row").mapInArrow(run, "fid long, row long, pos long, size long, fp long, ctx long")


def _contexts(placed: DataFrame, noted: str, length: int, gram: int) -> DataFrame:
    """The bytes around the places noted (fid, row, pos, n, fp, d)."""

    def run(batches):
        notes = Notes(noted, ["row", "pos", "n", "fp", "d"])
        for batch in batches:
            fids, rows = (c.to_numpy() for c in batch.columns[1:])
            texts = batch.column(0).cast(pa.binary())
            for fid in dict.fromkeys(fids.tolist()):
                at = np.flatnonzero(fids == fid)
                got = notes.read(fid, int(rows[at].min()), int(rows[at].max()))
                begin = np.searchsorted(got["row"], rows[at])
                end = np.searchsorted(got["row"], rows[at], "right")
                out, held = [], 0
                for i in np.flatnonzero(end > begin):
                    t = texts[int(at[i])].as_py()
                    for k in range(begin[i], end[i]):
                        p = got["pos"][k]
                        s, e = context(p, len(t), length, gram)
                        out.append((int(got["fp"][k]), int(got["d"][k]), bool(got["n"][k] > 1), fid, int(rows[at[i]]), int(p), int(s), t[s:e]))
                        held += e - s
                        if held > tx.PIECE:  # within a text too: a long one has contexts of many times its size
                            yield _batch(out)
                            out, held = [], 0
                if out:
                    yield _batch(out)

    return placed.select("text", "fid", "row").mapInArrow(run, _CONTEXT)


_CONTEXT = "fp long, d long, many boolean, fid long, row long, pos long, start long, bytes binary"
_KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_INTERVAL = "fid long, row long, start long, stop long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], [x.split()[0] for x in _CONTEXT.split(", ")])


def _expanded(contexts: DataFrame, length: int, gram: int, block: int) -> DataFrame:
    """Intervals of single contexts that are repeated, by transforms over blocks of whole fingerprints."""
    reach = length - gram

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        fp, many, fid, row, pos, start = (t.column(c).to_numpy() for c in ("fp", "many", "fid", "row", "pos", "start"))
        bucket = np.cumsum(np.concatenate(([False], fp[1:] != fp[:-1])))
        cells = np.full((len(fp), reach + length), _SEPARATOR, np.uint8)
        for i, (b, at) in enumerate(zip(t.column("bytes").to_pylist(), (reach - (pos - start)).tolist(), strict=True)):
            cells[i, at : at + len(b)] = np.frombuffer(b, np.uint8)
        hit = repeated_starts(cells, bucket, length)
        hit[many] = False
        rows = np.flatnonzero(hit.any(axis=1))
        hit = hit[rows]
        # starts in a context lie closer than ``length``, so what they cover is one run
        first, last = hit.argmax(axis=1), hit.shape[1] - 1 - hit[:, ::-1].argmax(axis=1)
        origin = pos[rows] - reach
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (fid[rows], row[rows], origin + first, origin + last + length)], ["fid", "row", "start", "stop"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            fp = batch.column(0).to_numpy()
            new = np.flatnonzero(np.concatenate(([len(fp) > 0 and fp[0] != last], fp[1:] != fp[:-1])))
            at = 0
            while at < len(fp):  # a block ends before the first new fingerprint beyond its size
                cut = new[new > at] if size + len(fp) - at > block else new[:0]
                cut = cut[size + cut - at >= min(block, size + len(fp) - at)] if len(cut) else cut
                if size >= block and at in new:
                    yield work(held)
                    held, size = [], 0
                end = int(cut[0]) if len(cut) else len(fp)
                held.append(batch.slice(at, end - at))
                size, at = size + end - at, end
            last = fp[-1] if len(fp) else last
        if held:
            yield work(held)

    return contexts.repartition("fp").sortWithinPartitions("fp").mapInArrow(run, _INTERVAL)


def _grouped(contexts: DataFrame, length: int) -> DataFrame:
    """The same for fingerprints of any number of contexts, by grouping 128-bit hashes of their strings."""

    def run(batches):
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                buf = np.frombuffer(r[7], np.uint8)
                n = len(buf) - length + 1
                if n <= 0:
                    continue
                one, two = tx.prefix(buf), tx.prefix(buf, tx.BYTE[::-1])
                s = np.arange(n)
                full = [np.full(n, x) for x in (r[3], r[4])]
                yield pa.RecordBatch.from_arrays([pa.array(full[0]), pa.array(full[1]), pa.array(s + r[6]), pa.array(np.full(n, 1 + r[2])), pa.array(tx.spans_hash(one, s, s + length).view(np.int64)), pa.array(tx.spans_hash(two, s, s + length).view(np.int64))], ["fid", "row", "start", "n", "h1", "h2"])

    each = contexts.mapInArrow(run, "fid long, row long, start long, n long, h1 long, h2 long")
    origin = F.struct("fid", "row", "start")
    groups = each.groupBy("h1", "h2").agg(F.max("n").alias("n"), F.min(origin).alias("x"), F.max(origin).alias("y")).filter("n > 1 OR x <> y").select("h1", "h2")
    return each.filter("n = 1").join(groups, ["h1", "h2"]).select("fid", "row", "start", (F.col("start") + length).alias("stop")).distinct()


def repeats(placed: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, hot: int = HOT) -> str:
    """Writes the intervals to remove, by place, and returns where: fid, row, start, stop (may overlap)."""
    prints = shared.written(_fingerprints(placed, length, gram), "fingerprints")
    twice = prints.groupBy("fp").agg(F.count("*").alias("c")).filter("c > 1").select("fp")
    open_ = shared.written(prints.join(twice, "fp"), "open")
    place = F.min(F.struct("fid", "row", "pos")).alias("place")
    kinds = shared.written(open_.groupBy("fp", "ctx").agg(F.count("*").alias("n"), place), "contexts")

    low, high = f"greatest(0, pos - {length - gram})", f"least(size, pos + {length})"
    whole = open_.join(kinds.filter("n > 1").select("fp", "ctx"), ["fp", "ctx"]).select("fid", "row", F.expr(low).alias("start"), F.expr(high).alias("stop"))

    mixed = kinds.groupBy("fp").agg(F.count("*").alias("d"), F.min("n").alias("least")).filter("d > 1 AND least = 1").select("fp", "d")
    wanted = kinds.join(mixed, "fp").select("place.fid", "place.row", "place.pos", F.col("n"), "fp", "d")
    contexts = shared.written(_contexts(placed, _noted(wanted, "wanted"), length, gram), "bytes")
    found = whole.filter(f"stop - start >= {length}").union(_expanded(contexts.filter(F.col("d") <= hot), length, gram, block))
    if not contexts.filter(F.col("d") > hot).limit(1).isEmpty():
        found = found.union(_grouped(contexts.filter(F.col("d") > hot), length))
    return _noted(found, "intervals")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row; with_text adds the kept bytes."""
    placed = _placed(docs)
    noted = repeats(placed, length, gram, block, hot)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        notes = Notes(noted, ["row", "start", "stop"])
        for batch in batches:
            fids, rows = (c.to_numpy() for c in batch.columns[2:])
            spans: dict[int, tuple] = {}
            for fid in dict.fromkeys(fids.tolist()):
                at = np.flatnonzero(fids == fid)
                got = notes.read(fid, int(rows[at].min()), int(rows[at].max()))
                begin, end = np.searchsorted(got["row"], rows[at]), np.searchsorted(got["row"], rows[at], "right")
                for i in np.flatnonzero(end > begin):
                    spans[int(at[i])] = merged(got["start"][begin[i] : end[i]], got["stop"][begin[i] : end[i]])
            for lo, texts in _texts(batch.column(1)):
                cols = [[], [], [], [], []]
                for i, t in enumerate(texts, lo):
                    kept, removed = [], 0
                    s, e = spans.get(i, ((), ()))
                    last = 0
                    for a, b in zip(s, e, strict=True):
                        kept.append(t[last:a])
                        removed, last = removed + int(b - a), b
                    kept.append(t[last:])
                    whole = b"".join(kept)
                    for c, v in zip(cols, (len(t), removed, len(s), hashlib.sha256(whole).hexdigest(), whole if with_text else None), strict=True):
                        c.append(v)
                arrays = [batch.column(0).slice(lo, len(texts)), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + with_text], names[: 5 + with_text])

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return placed.select("doc_id", "text", "fid", "row").mapInArrow(run, schema)
