"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased texts are read as code points; every 1-, 2- and 3-gram is hashed to one of BUCKETS. Document frequencies
are counted over all rows that may be learnt from, in one pass that sums by bucket; weights are learnt from a bounded
sample (``per_language`` rows of smallest hash of each language, of which a fifth only serves the calibration) by
follow-the-regularised-leader with elastic-net penalties, in one executor task; a temperature fitted on the
calibration rows then scales the logits. The model's size is BUCKETS x languages, whatever the input. Prediction is a
narrow pass over whole texts, long ones in bounded pieces.

Defined results: a null text and one without any letter is ``und`` with score 0. With nothing to learn from, every
row is ``und``. Rows with a null language are predicted but not learnt from; an empty table gives no rows; repeated
rows are each predicted; further columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 15
#: Characters of a text that are hashed at once.
PIECE = 1 << 19
#: Rows of each language that are learnt from at most, and passes over them.
PER_LANGUAGE, EPOCHS = 1000, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05

_SHIFT = np.uint64(64 - 15)
_LETTER = regex.compile(r"\p{L}")
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def counts(text: str, piece: int = PIECE) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text. Pieces overlap by the reach of an n-gram."""
    total, low = np.zeros(BUCKETS, np.int64), text.lower()
    for at in range(0, len(low), piece):
        c = np.frombuffer(low[at : at + piece + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        one = c * _A
        two = (one[:-1] ^ (one[:-1] >> np.uint64(31))) * _B + c[1:] * _C
        three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * _B + c[2:] * _C
        h = np.concatenate((one[:piece], two[:piece] * _A, three * _C))
        total += np.bincount(((h ^ (h << np.uint64(23))) >> _SHIFT).astype(np.int64), minlength=BUCKETS)
    return total


class Model:
    """Idf, weights (buckets x languages), bias and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights, bias, temperature

    def vector(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of non-zero weight and their values; the values have length 1."""
        at = np.flatnonzero(n)
        v = np.log1p(n[at]) * self.idf[at]
        norm = np.sqrt((v * v).sum())
        return at, v / norm if norm > 0 else v

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        z = self.logits(*self.vector(counts(text))) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(min(1.0, p[k]))

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> None:
        """FTRL-proximal: per-coordinate rates, L1 and L2 penalties; most weights stay exactly 0."""
        k = len(self.langs)
        z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

        def weights(z, n):
            return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                at, v = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 1.0)  # the last is the bias
                zz, nn = z[at], n[at]
                w = weights(zz, nn)
                s = v @ w
                p = np.exp(s - s.max())
                p /= p.sum()
                p[y[i]] -= 1
                g = v[:, None] * p
                more = nn + g * g
                z[at] = zz + g - (np.sqrt(more) - np.sqrt(nn)) / ALPHA * w
                n[at] = more
        w = weights(z, n)
        self.weights, self.bias = w[:-1], w[-1]

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        """The temperature of least cross-entropy on rows that weren't trained on."""
        if not len(rows):
            return
        z = np.stack([self.logits(*r) for r in rows])

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

        lo, hi = np.log(0.05), np.log(20)
        for _ in range(50):  # golden section
            a, b = hi - (hi - lo) * 0.618, lo + (hi - lo) * 0.618
            lo, hi = (lo, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, hi)
        self.temperature = float(np.exp((lo + hi) / 2))

    def to_row(self) -> tuple[str, bytes]:
        head = {"langs": self.langs, "temperature": self.temperature}
        return json.dumps(head), np.concatenate((self.idf, self.weights.ravel(), self.bias)).astype("<f8").tobytes()

    @classmethod
    def from_row(cls, head: str, body: bytes) -> Model:
        h, x = json.loads(head), np.frombuffer(body, "<f8")
        k = len(h["langs"])
        return cls(h["langs"], x[:BUCKETS], x[BUCKETS : BUCKETS * (k + 1)].reshape(BUCKETS, k), x[BUCKETS * (k + 1) :], h["temperature"])


def _document_frequencies(learnable: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows each bucket occurs, over all of them; BUCKETS pairs of numbers come back."""

    def run(batches):
        n = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n[:-1] += counts(t or "") > 0
                n[-1] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    got = learnable.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(BUCKETS + 1, np.int64)
    for r in got:
        n[r.bucket] = r.n
    return n[:-1], int(n[-1])


def _sampled(learnable: DataFrame, per_language: int) -> DataFrame:
    """(lang, key, text) of the ``per_language`` different rows of smallest hash of each language.

    Narrow ranks first, limited in each partition before they are shuffled (as long as per_language is within
    spark.sql.optimizer.windowGroupLimitThreshold); then the rows up to the last rank's hash. Repeated rows count once.
    """
    keyed = learnable.withColumn("key", F.xxhash64("doc_id", "text"))
    ranked = keyed.select("lang", "key").withColumn("r", F.dense_rank().over(Window.partitionBy("lang").orderBy("key")))
    most = ranked.filter(F.col("r") <= per_language).groupBy("lang").agg(F.max("key").alias("most"))
    return keyed.join(F.broadcast(most), "lang").filter("key <= most").groupBy("lang", "key").agg(F.first("text").alias("text"))  # a row a language


def fit(learnable: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from the columns doc_id, text and lang of ``learnable``."""
    learnable = learnable.filter("lang IS NOT NULL")
    df, n = _document_frequencies(learnable)
    idf = np.log((1 + n) / (1 + df))
    rows = _sampled(learnable, per_language)

    def extract(batches):
        for batch in batches:
            feats = []
            for t in batch.column("text").to_pylist():
                c = counts(t or "")
                at = np.flatnonzero(c)
                feats.append(at.astype("<u2").tobytes() + c[at].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lang"), pa.array(feats, pa.binary())], ["key", "lang", "feats"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "lang", "feats"]).reset_index(drop=True)
        langs = sorted(pdf.lang.unique())
        model = Model(langs, idf, np.zeros((BUCKETS, len(langs))), np.zeros(len(langs)))
        rows = []
        for b in pdf.feats:
            k, c = len(b) // 6, np.zeros(BUCKETS, np.int64)
            c[np.frombuffer(b, "<u2", k)] = np.frombuffer(b, "<u4", k, 2 * k)
            rows.append(model.vector(c))
        y = pdf.lang.map({k: i for i, k in enumerate(langs)}).to_numpy()
        aside = np.arange(len(rows)) % 5 == 4
        model.train([r for r, a in zip(rows, aside, strict=True) if not a], y[~aside])
        model.calibrate([r for r, a in zip(rows, aside, strict=True) if a], y[aside])
        head, body = model.to_row()
        return pd.DataFrame({"head": [head], "body": [body]})

    # one task on purpose: at most per_language x languages rows of at most 6 x BUCKETS bytes
    got = rows.mapInArrow(extract, "key long, lang string, feats binary").groupBy().applyInPandas(learn, "head string, body binary").collect()
    return Model.from_row(got[0].head, bytes(got[0].body)) if got else Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0))


def predict(df: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of df with lang_pred and score, from the text column alone."""
    shared = df.sparkSession.sparkContext.broadcast(model.to_row())  # BUCKETS x (languages + 1) doubles
    chosen = df.select(F.col(f"`{text_col}`"), *[F.col(f"`{c}`") for c in keep])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])

    def run(batches):
        model = Model.from_row(*shared.value)
        for batch in batches:
            got = [model.predict(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    return chosen.mapInArrow(run, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, held_out: Column | None = None, keep: list[str] | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fits on the rows that are not held out and predicts every row."""
    learnable = docs if held_out is None else docs.filter(~held_out)
    return predict(docs, fit(learnable.select("doc_id", "text", "lang"), per_language), keep or ["doc_id"])
