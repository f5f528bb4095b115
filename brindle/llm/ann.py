"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: vectors are placed on the unit sphere of one more dimension, where nearness in angle is that of the inner
product whatever their lengths, then centred and rotated so that the signs of their coordinates lose least (iterative quantisation, by
alternating signs and an orthogonal Procrustes step), learnt on a bounded sample. Index: rows are spread over blocks;
in a block the code is split into PARTS substrings, each with its own table from value to rows. Search: a code within
Hamming radius r of the query's agrees with it to within r // PARTS in some substring, so probing all values that
near in each table retrieves every code within r; what is within r is then ranked by the inner product of the
original vectors in double precision. The radius is the one that reached TARGET recall against brute force within
the sample (whose neighbours are farther than those among all rows), and is widened for a query whose block holds
fewer than k + 1 codes within it, so a query always gets min(k, candidates) results.

Queries and rows meet block by block; each pair of blocks keeps k results a query, which one aggregation merges. No
vector is compared outside its block's candidates. Sample, rotation and radius have fixed size.

Defined results: null and zero vectors, those with null or non-finite components, of another dimension than the most
frequent one, or with a null id take no part. Rows that repeat an id are candidates each; only the query's own row is
none of its candidates. Equal query rows are asked once; a query id with several vectors gets k results for each. Ties
go to the smaller id. Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, PARTS = 64, 4
SUB = BITS // PARTS
#: Vectors that codes are learnt from at most; recall aimed at within them; rows and queries of a block.
SAMPLE, TARGET, ROWS, QUERIES = 6000, 0.97, 16_384, 4096
_POP = np.array([bin(i).count("1") for i in range(1 << SUB)], np.uint8)


class Codes:
    """Mean, rotation (dimension x BITS) and radius."""

    def __init__(self, mean: np.ndarray, rotation: np.ndarray, radius: int):
        self.mean, self.rotation, self.radius = mean, rotation, radius

    def of(self, x: np.ndarray) -> np.ndarray:
        """64-bit codes."""
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1, bitorder="little").view("<u8").ravel()

    @classmethod
    def learn(cls, raw: np.ndarray, longest: float, k: int, rounds: int = 30, seed: int = 0) -> Codes:
        rng = np.random.default_rng(seed)
        x = on_sphere(raw, longest)
        mean = x.mean(axis=0)
        c = x - mean
        dim = x.shape[1]
        _, _, axes = np.linalg.svd(c, full_matrices=False) if len(c) >= dim else (0, 0, np.eye(dim))
        base = axes.T[:, :BITS]
        if base.shape[1] < BITS:  # fewer dimensions than bits: random directions in addition
            base = np.concatenate((base, rng.normal(size=(dim, BITS - base.shape[1])) / np.sqrt(dim)), axis=1)
        v = c @ base
        r, _ = np.linalg.qr(rng.normal(size=(BITS, BITS)))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out = cls(mean, base @ r, BITS)
        out.radius = out._radius(raw, longest, k)
        return out

    def _radius(self, x: np.ndarray, longest: float, k: int) -> int:
        """The least radius that holds TARGET of the k nearest of up to 300 vectors of the sample."""
        q = np.arange(0, len(x), max(1, len(x) // 300))
        if len(x) <= k + 1:
            return BITS
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -np.inf
        near = np.argpartition(-s, k, axis=1)[:, :k]
        far = np.bitwise_count(self.of(as_query(x[q]))[:, None] ^ self.of(on_sphere(x, longest))[near]).ravel()
        return int(np.quantile(far, TARGET, method="higher"))


def on_sphere(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows as unit vectors of one more dimension, whose angle to as_query(q) orders as their inner product with q."""
    u = x / longest
    return np.column_stack((u, np.sqrt(np.maximum(0.0, 1 - (u * u).sum(axis=1)))))


def as_query(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, for squares neither to vanish nor to overflow
    return np.column_stack((x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))))


class MultiIndex:
    """Tables from the value of each substring to the rows that have it."""

    def __init__(self, code: np.ndarray):
        self.code, self.tables = code, []
        for part in self.substrings(code):
            order = np.argsort(part, kind="stable")
            values, begin = np.unique(part[order], return_index=True)
            self.tables.append((values, np.append(begin, len(part)), order))

    @staticmethod
    def substrings(code: np.ndarray) -> list[np.ndarray]:
        return [((code >> np.uint64(SUB * i)) & np.uint64((1 << SUB) - 1)).astype(np.int64) for i in range(PARTS)]

    def within(self, q: np.uint64, radius: int) -> np.ndarray:
        """All rows whose code is within the radius of q, in order."""
        hit = np.zeros(len(self.code), bool)
        for (values, begin, order), s in zip(self.tables, self.substrings(np.array([q], np.uint64)), strict=True):
            at = np.flatnonzero(_POP[values ^ s[0]] <= radius // PARTS)
            size = begin[at + 1] - begin[at]
            if size.sum():
                ends = np.cumsum(size)
                hit[order[np.arange(ends[-1]) + np.repeat(begin[at] - (ends - size), size)]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.code[rows] ^ q) <= radius]

    def search(self, q: np.uint64, radius: int, k: int) -> np.ndarray:
        """The same, with the radius widened until there are k or all rows."""
        while len(rows := self.within(q, radius)) < min(k, len(self.code)) and radius < BITS:
            radius += PARTS
        return rows


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, as doubles, all of the most frequent dimension."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    fine = fine.filter("NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)")
    top = fine.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return fine.filter(F.size("v") == (top.dim if top else 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for the rows where is_query (over the id) holds."""
    fine = usable(vectors, id_col, vector_col)
    # by the largest component first, bound once, for squares neither to vanish nor to overflow
    length = "transform(array(array_max(transform(v, x -> abs(x)))), m -> m * sqrt(aggregate(v, 0D, (acc, x) -> acc + (x / m) * (x / m))))[0]"
    n, longest = fine.agg(F.count("*"), F.max(F.expr(length))).first()

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("id").v.to_numpy()).astype(np.float64)
        c = Codes.learn(x, longest, k)
        return pd.DataFrame({"mean": [c.mean.tolist()], "rotation": [c.rotation.ravel().tolist()], "radius": [c.radius]})

    # one task on purpose: at most ``sample`` vectors
    picked = fine.orderBy(F.xxhash64("id"), "id").limit(sample)
    got = picked.groupBy().applyInPandas(learn, "mean array<double>, rotation array<double>, radius int").collect()
    empty = fine.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not got:
        return empty
    codes = Codes(np.array(got[0].mean), np.array(got[0].rotation).reshape(-1, BITS), got[0].radius)
    row_blocks = max(1, -(-n // rows))
    chosen = fine.filter(is_query).distinct().withColumn("key", F.xxhash64("v"))
    query_blocks = max(1, -(-chosen.count() // queries))
    spread = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(row_blocks)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    left = fine.select("id", "v", spread.alias("rb")).withColumn("qb", each)
    other = F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))
    right = chosen.select("id", "v", "key", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(query_blocks)).cast("int").alias("qb")).withColumn("rb", other)

    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            ids = t.column("id").to_numpy()
            flat = t.column("v").combine_chunks().flatten().to_numpy() if t.num_rows else np.zeros(0)
            return ids, flat.reshape(len(ids), -1)

        out = [[], [], [], []]
        if block.num_rows and asked.num_rows:
            ids, x = matrix(block)
            qids, q = matrix(asked)
            keys = asked.column("key").to_numpy()

            index, code = MultiIndex(codes.of(on_sphere(x, longest))), codes.of(as_query(q))
            for i in range(len(qids)):
                found = index.search(code[i], codes.radius, k + 1)
                own = np.flatnonzero(ids[found] == qids[i])
                own = own[(x[found[own]] == q[i]).all(axis=1)]
                found = np.delete(found, own[:1])  # rows of one id lie in one block
                score = (x[found] * q[i]).sum(axis=1)
                best = np.lexsort((ids[found], -score))[:k]
                for c, v in zip(out, (np.full(len(best), qids[i]), np.full(len(best), keys[i]), ids[found][best], score[best]), strict=True):
                    c.append(v)
        kinds = (np.int64, np.int64, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, t)) for c, t in zip(out, kinds, strict=True)], names=["query_id", "key", "vec_id", "score"])

    met = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(search, "query_id long, key long, vec_id long, score double")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
