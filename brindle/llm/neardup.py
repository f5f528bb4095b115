"""Near-duplicate documents with HyperMinHash sketches.

A document's set is that of its distinct ``k``-word shingles. The hash space is cut into REGISTERS ranges; each keeps
its least hash in compressed form, the place of the leading one and MANTISSA bits after it. Four registers make a
band; documents that share a band are candidates. Before texts are fetched, the share of equal registers, corrected
for accidental collisions of the compressed form, estimates the similarity of a candidate pair and drops pairs that
are five standard deviations below the threshold. What remains is confirmed on the full sets, word by word: hashes
only propose.

Rows of equal sets are one class from the start, so copies are never expanded. Within a band's bucket each class is
first compared with the smallest one only; components of the confirmed links follow. Members of one bucket that are
then still in different components (documents around a passage that thousands share, say) are not paired by bucket,
whose pairs grow with its square, but by their rarest shingles, one of which similar sets must share. So no link is
lost that the bands can see, and buckets of mutual near copies cost as many comparisons as members. At similarity 0.8
a pair shares none of the 24 bands with a probability of about 3e-6. A text that is in many pairs is repeated, and its
pairs are spread over the copies, before they meet.

Rows carry a number of their own, so ids may repeat or be null. ``near_duplicates`` speaks of documents: rows of one
id are one document, which is linked with whatever one of them is linked with. ``unique_rows`` speaks of rows.

Defined results: null and empty texts, and texts of white space, have an empty set (n_shingles 0) and are linked with
nothing. Rows that repeat a doc_id each come out, with that id's component. Rows of null doc_id are documents of their
own; a null is never a component_id, and such a row is kept only if its component has no id at all. Further columns are
ignored (unique_rows keeps them), whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import shared
from brindle.llm import text as tx
from brindle.llm.components import connected

BANDS, ROWS, MANTISSA = 24, 4, 10
REGISTERS = BANDS * ROWS
_EDGES = np.array([(i << 64) // REGISTERS for i in range(1, REGISTERS)], np.uint64)
_FIRST = np.concatenate((np.zeros(1, np.uint64), _EDGES))
_LANES = np.array([0, 16, 32, 48], np.uint64)
#: Sets of fewer shingles leave registers empty, which are then filled from the next; no estimate is taken from them.
ESTIMABLE = 400
#: Pairs that one copy of a text meets at most (about).
MEETS = 2000
#: Rows of two numbers that are broadcast at most.
BROADCAST = 1_000_000


def shingle_sets(texts: list[bytes], k: int):
    """Sorted distinct shingle hashes of each text; A-Z count as a-z."""
    for lo, hi in tx.groups(texts):
        w, at = tx.word_hashes(texts[lo:hi], fold=True)
        h = np.full(max(0, len(w) - k + 1), np.uint64(k))
        for j in range(k if len(h) else 0):
            h = tx.mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j])
        for i in range(hi - lo):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= k:
                yield np.unique(h[a : b - k + 1])
            elif b > a:
                one = np.full(1, np.uint64(b - a))
                for x in w[a:b]:
                    one = tx.mix(one * np.uint64(0xC2B2AE3D27D4EB4F) + x)
                yield one
            else:
                yield np.zeros(0, np.uint64)


def reaches(one: bytes, two: bytes, k: int, percent: int) -> bool:
    """Whether the shingle sets of two texts reach the threshold, decided on the words themselves."""
    number: dict[bytes, int] = {}
    ids = []
    for t in (one, two):
        parts = [np.fromiter((number.setdefault(w, len(number)) for w in piece.lower().split()), np.int64) for piece in tx.pieces_at_space(t)]
        ids.append(np.concatenate(parts))
    if min(map(len, ids)) < k:
        return len(ids[0]) > 0 and np.array_equal(*ids)
    n = len(ids[0]) - k + 1
    code = np.concatenate([x[: len(x) - k + 1] for x in ids])
    for j in range(1, k):  # equal numbers for equal runs of words, word by word
        code = code * len(number) + np.concatenate([x[j : len(x) - k + 1 + j] for x in ids])
        if j < k - 1:
            _, code = np.unique(code, return_inverse=True)
    a, b = np.unique(code[:n]), np.unique(code[n:])
    both = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def sketch(u: np.ndarray) -> np.ndarray:
    """BANDS 64-bit words of four 16-bit registers each, of a sorted non-empty set of hashes."""
    at = np.concatenate(([0], np.searchsorted(u, _EDGES), [len(u)]))
    full = at[1:] > at[:-1]
    first = u[np.minimum(at[:-1], len(u) - 1)]
    least = first - _FIRST
    part, place = np.frexp(least.astype(np.float64) + 1.0)
    reg = (place.astype(np.uint64) << np.uint64(MANTISSA)) | ((part * 2 - 1) * (1 << MANTISSA)).astype(np.uint64)
    if not full.all():  # an empty register takes bits of the next full one's hash, others at every distance
        where, empty = np.flatnonzero(full), np.flatnonzero(~full)
        nxt = where[np.searchsorted(where, empty) % len(where)]
        away = ((nxt - empty) % REGISTERS).astype(np.uint64)
        reg[empty] = tx.mix(first[nxt] + away * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(0xFFFF)
    return (reg.reshape(BANDS, ROWS) << _LANES).sum(axis=1, dtype=np.uint64)


_SKETCH = [T.StructField(c, T.LongType()) for c in ("uid", "n", "hi", "lo")] + [T.StructField("regs", T.ArrayType(T.LongType()))]


def sketches(docs: DataFrame, at: int, k: int) -> DataFrame:
    """docs (columns c0, c1, ...; the text is number ``at``) with a number for each row, n_shingles, a 128-bit
    fingerprint of the set (hi, lo) and its sketch; the last three are null for an empty set."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                n, his, los, regs = [], [], [], []
                for u in shingle_sets(tx.raw(part.column(at)), k):
                    n.append(len(u))
                    his.append(int(np.add.reduce(tx.mix(u)).view(np.int64)) if len(u) else None)
                    los.append(int(np.bitwise_xor.reduce(tx.mix(u * np.uint64(0x165667B19E3779F9))).view(np.int64)) if len(u) else None)
                    regs.append(sketch(u).view(np.int64) if len(u) else None)
                more = [pa.array(n, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(regs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "n", "hi", "lo", "regs"])

    return docs.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(run, T.StructType([*docs.schema.fields, *_SKETCH]))


def _spread(pairs: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """Pairs (a, b), a written table, joined with ``one`` (which has each a once) and ``two`` (each b). Keys of many
    pairs, if there are any, are salted: their row of one or two is repeated, their pairs are spread over the copies."""
    if pairs.count() <= MEETS:
        return pairs.join(one, "a").join(two, "b")
    each = pairs.select(F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.col(x).alias("key")) for x in "ab"])).alias("x")).select("x.*")
    hot = shared.written(each.groupBy("side", "key").count().filter(F.col("count") > MEETS), "hot")
    many = {r.side: r["count"] for r in hot.groupBy("side").count().collect()}
    for key, side in (("a", one), ("b", two)):
        if key not in many:
            pairs = pairs.join(side, key)
            continue
        copies = hot.filter(F.col("side") == key).select(F.col("key").alias(key), F.expr(f"int(ceil(count / {MEETS}D))").alias("copies"))
        copies = F.broadcast(copies) if many[key] <= BROADCAST else copies
        salt = F.expr("CASE WHEN copies IS NULL THEN 0 ELSE pmod(xxhash64(a, b), copies) END").cast("int")
        side = side.join(copies, key, "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(copies, 1) - 1)"))).drop("copies")
        pairs = pairs.join(copies, key, "left").withColumn("salt", salt).drop("copies").join(side, [key, "salt"]).drop("salt")
    return pairs


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may reach the threshold, by size and by collision-corrected estimate."""
    floor = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5
    one = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    two = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    lanes = " + ".join(f"int(shiftrightunsigned(z, {s}) & 65535L = 0)" for s in (0, 16, 32, 48))
    same = F.expr(f"aggregate(zip_with(ra, rb, (x, y) -> x ^ y), 0, (acc, z) -> acc + {lanes})")
    chance = F.expr(f"0.72D / {1 << MANTISSA} * na * nb / ((na + nb) * (na + nb))")
    return (
        _spread(pairs, one, two)
        .filter(F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)"))
        .withColumn("chance", chance)
        .withColumn("estimate", (same / F.lit(REGISTERS) - F.col("chance")) / (1 - F.col("chance")))
        .filter((F.least("na", "nb") < ESTIMABLE) | (F.col("estimate") >= floor))
        .select("a", "b")
    )


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                ok = [reaches(x, y, k, percent) for x, y in zip(tx.raw(part.column(2)), tx.raw(part.column(3)), strict=True)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in part.columns[:2]], ["a", "b"])

    one = texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b"))
    return _spread(pairs, one, two).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _tokens(texts: DataFrame, k: int) -> DataFrame:
    """(rep, n, h) for every distinct shingle of the texts (uid, text)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = list(shingle_sets(tx.raw(part.column(1)), k))
                n = np.array([len(u) for u in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], ["rep", "n", "h"])

    return texts.select("uid", "text").mapInArrow(run, "rep long, n long, h long")


def _sharing(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a > b, that share one of their rarest shingles, as many as similar sets must.

    Of a set's n shingles in order of rarity, a similar set must have one of the first n - ceil(percent / 100 * n) + 1.
    Shingles that only one set has come first, so they are only counted. What two sets share begins with the first
    that they share in this order, so the shingles that follow it in both bound how much that is.
    """
    common = tokens.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    known = tokens.join(common, "h")
    order = Window.partitionBy("rep").orderBy("df", "h")
    whole = Window.partitionBy("rep").orderBy("df", "h").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = known.withColumn("r", F.row_number().over(order)).withColumn("common", F.count("*").over(whole)).withColumn("left", F.expr("common - r"))
    prefix = ranked.filter(f"n - left <= n - ceil(n * {percent} / 100D) + 1").select("rep", "n", "h", "left")
    prefix = shared.written(prefix, "prefix")
    one, two = (prefix.select("h", F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("left").alias(f"left_{x}")) for x in "ab")
    pairs = one.join(two, "h").filter(f"a > b AND 100 * least(na, nb) >= {percent} * greatest(na, nb)")
    pairs = pairs.groupBy("a", "b").agg(F.max(F.expr("na + nb")).alias("sum"), F.max("left_a").alias("left_a"), F.max("left_b").alias("left_b"))
    return pairs.filter(f"(1 + least(left_a, left_b)) * {100 + percent} >= {percent} * sum").select("a", "b")


def _linked(docs: DataFrame, at: int, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The written sketches of docs (see there) and (hi, lo, root) for every class of equal non-empty sets; classes of
    one root are connected."""
    sk = shared.written(sketches(docs, at, k), "sketches")
    classes = sk.filter("n > 0").groupBy("hi", "lo").agg(F.min("uid").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = shared.written(classes, "classes")
    bands = classes.select("rep", F.posexplode("regs")).select("rep", F.xxhash64("pos", "col").alias("bucket"))
    several = bands.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).filter("lead <> last")
    members = shared.written(bands.join(several.select("bucket", "lead"), "bucket"), "members")
    texts = sk.select("uid", F.col(f"c{at}").alias("text"))
    texts = shared.written(texts.join(members.select(F.col("rep").alias("uid")).distinct(), "uid", "left_semi"), "texts")

    def links(pairs: DataFrame) -> DataFrame:
        near = shared.written(_estimated(pairs, classes, percent), "near")
        return shared.written(_confirmed(near, texts, k, percent), "links")

    tried = shared.written(members.filter("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct(), "tried")
    roots = connected(links(tried))

    def named(roots: DataFrame) -> DataFrame:
        placed = classes.select("hi", "lo", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        return placed.select("hi", "lo", F.coalesce("root", "rep").alias("root"))

    # the rest: members of a bucket whom the comparison with the smallest did not bring together
    placed = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("bucket")
    apart = placed.join(split, "bucket").select("rep", "root").distinct()
    apart = shared.written(apart, "apart")
    if apart.isEmpty():
        return sk, named(roots)
    tokens = _tokens(texts.join(apart.select(F.col("rep").alias("uid")), "uid", "left_semi"), k)
    pairs = _sharing(shared.written(tokens, "tokens"), percent).join(tried, ["a", "b"], "left_anti")
    pairs = pairs.join(apart.select(F.col("rep").alias("a"), F.col("root").alias("x")), "a").join(apart.select(F.col("rep").alias("b"), F.col("root").alias("y")), "b")
    more = links(shared.written(pairs.filter("x <> y").select("a", "b"), "pairs"))
    if not more.isEmpty():
        roots = connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    return sk, named(roots)


def _columns(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1, ..., whatever their names were."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Links join documents with 100 * intersection >= percent * union of their k-word shingle sets.
    """
    sk, named = _linked(_columns(docs.select(F.col("doc_id").cast("long"), "text")), 1, k, percent)
    rows = sk.filter("n > 0").select(F.col("c0").alias("doc_id"), "n", "hi", "lo").join(named, ["hi", "lo"]).select("doc_id", "n", "root")
    rows = shared.written(rows, "rows")
    # an id with several sets connects them
    several = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("root").alias("b"), F.max("root").alias("last")).filter("b <> last")
    both = shared.written(rows.join(several, "doc_id").filter("root <> b").select(F.col("root").alias("a"), "b").distinct(), "several")
    if not both.isEmpty():
        further = connected(both).select(F.col("node").alias("root"), F.col("root").alias("upper"))
        rows = rows.join(further, "root", "left").select("doc_id", "n", F.coalesce("upper", "root").alias("root"))
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    full = rows.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = sk.filter("n = 0").select(F.col("c0").alias("doc_id"), F.col("n").alias("n_shingles"))
    same = full.join(empty.select("doc_id"), "doc_id", "left_semi").select("doc_id", "component_id").distinct()
    empty = empty.join(same, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return full.union(empty).withColumn("kept", F.expr("CASE WHEN component_id IS NULL THEN true ELSE coalesce(doc_id = component_id, false) END"))


def unique_rows(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of linked rows: that of smallest doc_id, of no id only if none has one. Rows with
    an empty set all stay. No row goes for what another row of its id is linked with."""
    sk, named = _linked(_columns(docs), docs.columns.index("text"), k, percent)
    rows = sk.filter("n > 0").select("uid", F.col(f"c{docs.columns.index('doc_id')}").alias("doc_id"), "hi", "lo").join(named, ["hi", "lo"])
    rows = shared.written(rows.select("uid", "doc_id", "root"), "rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("best")).select("root", "best.uid")
    gone = rows.join(best.withColumnRenamed("uid", "first"), "root").filter("uid <> first").select("uid")
    kept = sk.join(gone, "uid", "left_anti").select(*[f"c{i}" for i in range(len(docs.columns))])
    return kept.toDF(*docs.columns)
