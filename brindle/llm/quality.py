"""Quality classifier: supervised subword embeddings.

Every word, word pair and byte n-gram of a text is hashed to a row of an embedding table, and so is the form of every
word 4-gram, which says which of its words are equal and not which words they are (so what is learnt of repetition in
one vocabulary holds in others); the rows are averaged over the document and a softmax over the labels follows, all
trained by plain numpy stochastic gradient descent. Trained on
whole texts of a bounded sample of labelled rows (``sample``, by hash of the id), in one executor task; the model has a
fixed size (BUCKETS x DIM floats) whatever the input. Scoring uses what a linear readout of an average allows: with the
output weights multiplied into the table once, each feature has one logit, and a text's logit is the mean of these.
So whole texts of any length are scored without a shuffle, n-grams in bounded pieces that overlap by their reach.

Defined results: null and empty texts (no feature) are scored by the output bias alone, as the training settled it;
an empty or one-sided training table gives 0.5 or the share of its only label, limited to 0.01 and 0.99. Repeated rows
are each scored; of rows that repeat a labelled id at most PER_ID are learnt from. Further columns are ignored. Labels
with a null label or doc_id are not learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import text as tx

BUCKETS, DIM = 1 << 15, 12
#: Byte lengths of the character n-grams, rising; words of the n-grams of which only the form counts.
GRAMS, FORM = (3, 5), 4
#: Labelled rows that are learnt from at most, rows of one id among them, passes over them.
SAMPLE, PER_ID, EPOCHS = 4000, 4, 5
#: Documents that training steps over at least, in more passes where the sample is small.
STEPS = 8000

_SHIFT = np.uint64(64 - 15)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> _SHIFT).astype(np.int64)


def features(text: bytes, piece: int = tx.PIECE) -> Iterator[np.ndarray]:
    """Buckets of all features of a text, part by part: words, word pairs, forms of word 4-grams, n-grams of bytes."""
    w, _ = tx.word_hashes([text])
    yield _bucket(w)
    yield _bucket(tx.mix(w[:-1] * np.uint64(3) + w[1:]))
    if len(w) >= FORM:
        form = np.zeros(len(w) - FORM + 1, np.uint64)
        for i in range(FORM):
            for j in range(i):
                form = form << np.uint64(1) | (w[i : len(w) - FORM + 1 + i] == w[j : len(w) - FORM + 1 + j])
        yield _bucket(tx.mix(form + np.uint64(1)))
    for at in range(0, len(text), piece):
        last = np.zeros(0, np.uint64)
        for k, before in zip(GRAMS, (0, *GRAMS), strict=False):
            buf = np.frombuffer(text[at : at + piece + k - 1], np.uint8)
            n = len(buf) - k + 1
            if n > 0:
                last = last[:n]
                for i in range(before, k):  # the bytes of the shorter n-gram are there already
                    last = (last << np.uint64(8) if i else np.zeros(n, np.uint64)) | buf[i : n + i]
                yield _bucket((last + np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9))


def counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text has features in, and how many."""
    total = np.zeros(BUCKETS, np.int64)
    for f in features(text):
        total += np.bincount(f, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


class Embeddings:
    """Embedding table, output weights and bias of a softmax over two labels."""

    def __init__(self, table: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.table, self.out, self.bias = table, out, bias

    @classmethod
    def train(cls, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.5, seed: int = 7) -> Embeddings:
        """Stochastic gradient descent on counts, one document a step, with linearly falling rate."""
        rng = np.random.default_rng(seed)
        table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
        share = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
        share = min(0.99, max(0.01, share))
        bias[:] = np.log([1 - share, share])
        if len(set(labels.tolist())) > 1:
            epochs = max(epochs, -(-STEPS // len(docs)))
            step, steps = 0, epochs * len(docs)
            out[:] = rng.normal(0, 0.1, out.shape)
            for _ in range(epochs):
                for i in rng.permutation(len(docs)):
                    lr, step = rate * (1 - step / steps), step + 1
                    at, n = docs[i]
                    if not len(at):
                        continue
                    share = (n / n.sum()).astype(np.float32)
                    hidden = share @ table[at]
                    z = out @ hidden + bias
                    p = np.exp(z - z.max())
                    p /= p.sum()
                    p[labels[i]] -= 1
                    back = (out.T @ p) * (lr * 20)  # averaged features move little each; 20 evens that out
                    out -= lr * np.outer(p, hidden)
                    bias -= 0.1 * lr * p
                    table[at] -= share[:, None] * back.astype(np.float32)
        return cls(table, out, bias)

    def to_bytes(self) -> bytes:
        return b"".join(x.astype("<f4").tobytes() for x in (self.table, self.out, self.bias))

    @classmethod
    def from_bytes(cls, b: bytes) -> Embeddings:
        x = np.frombuffer(b, "<f4")
        n = BUCKETS * DIM
        return cls(x[:n].reshape(BUCKETS, DIM), x[n : n + 2 * DIM].reshape(2, DIM), x[n + 2 * DIM :])

    def logits(self) -> tuple[np.ndarray, float]:
        """Each bucket's part of the logit of label 1 against 0, and the bias's."""
        return (self.table @ (self.out[1] - self.out[0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def _sampled(labelled: DataFrame, docs: DataFrame, sample: int) -> DataFrame:
    """Text and label of up to ``sample`` labelled rows, chosen by hash of the id: ids first, then their texts, of an
    id that repeats a few. Both limits are partial top-k before anything is shuffled."""
    ids = labelled.select("doc_id", "label").filter("doc_id IS NOT NULL AND label IS NOT NULL")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label")]
    ids = ids.orderBy(*order).limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most ``sample`` pairs of numbers
    each = Window.partitionBy("doc_id", "label").orderBy(F.xxhash64("text"))
    return rows.withColumn("r", F.row_number().over(each)).filter(F.col("r") <= PER_ID).orderBy(*order, "r").limit(sample).drop("r")


def fit(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Embeddings:
    """Learns from labelled (doc_id, label 0 or 1) and the whole texts of docs, of at most ``sample`` rows."""

    def extract(batches):
        for batch in batches:
            feats = [counts(t) for t in tx.raw(batch.column("text"))]
            feats = [at.astype("<u2").tobytes() + n.astype("<u4").tobytes() for at, n in feats]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(feats, pa.binary())], ["id", "label", "feats"])

    def read(b: bytes) -> tuple[np.ndarray, np.ndarray]:
        k = len(b) // 6  # views: the sample is held once
        return np.frombuffer(b, "<u2", k), np.frombuffer(b, "<u4", k, 2 * k)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf.id, pdf.label, pdf.feats, strict=True))
        model = Embeddings.train([read(b) for _, _, b in rows], np.array([y for _, y, _ in rows], np.int64))
        return pd.DataFrame({"model": [model.to_bytes()]})

    rows = _sampled(labelled, docs, sample).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label"))
    rows = rows.mapInArrow(extract, "id long, label int, feats binary")
    # one task on purpose: at most ``sample`` rows of at most 6 x BUCKETS bytes
    got = rows.groupBy().applyInPandas(learn, "model binary").collect()
    return Embeddings.from_bytes(bytes(got[0].model)) if got else Embeddings.train([], np.zeros(0, np.int64))


def score(df: DataFrame, model: Embeddings, keep: list[str], threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns of df with score and predicted (or other names), from its column text alone."""
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast((model.logits()))  # BUCKETS doubles
    schema = df.select("text", *[F.col(f"`{c}`") for c in keep]).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[1:])

    def run(batches):
        weight, bias = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                mean = np.zeros(part.num_rows)
                for i, t in enumerate(tx.raw(part.column(0))):
                    total = n = 0
                    for f in features(t):
                        total, n = total + weight[f].sum(), n + len(f)
                    mean[i] = total / n if n else 0.0
                p = 1 / (1 + np.exp(-np.clip(mean + bias, -500, 500)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*part.schema.names[1:], *names])

    return df.select("text", *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, f"{fields}, `{names[0]}` double, `{names[1]}` int")


def quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, held_out=None, sample: int = SAMPLE, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Fits on the labels that are not held out and scores every row of docs."""
    labelled = labels.select("doc_id", F.col("quality").alias("label"))
    if held_out is not None:
        labelled = labelled.filter(~held_out)
    return score(docs, fit(docs, labelled, sample), keep or ["doc_id"], names=names)
