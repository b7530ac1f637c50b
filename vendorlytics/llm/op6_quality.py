"""Quality classifier: a factorisation machine.

A document's features are its hashed words (log counts, unit length),
statistics of its structure and its length. The machine scores

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so all pairwise interactions cost time linear in the features. Weights are
fitted by Adam on the logistic loss over at most ``MAX_TRAINING`` labelled
rows, taken by the smallest hash of doc_id; their feature vectors are computed
by Spark and only they reach the driver (bounded by that parameter and the
hash size). Scoring is one narrow pass over whole texts.

Labels, language, source and doc_id are never features. Rows whose
crc32(doc_id as text) mod 5 is 0 are held out of the fit.

Defined cases: null and empty texts are scored (features 0); a null doc_id is
not held out; repeated rows are scored each; a doc_id with several labels
counts by the smallest; without usable labels, or with one class only, the
score is the smoothed share of label 1 (0.5 without labels). Other columns
pass through, and a clash with an output name raises ``ValueError``.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlytics.llm.common import sub_batches, table

WORD_BITS = 12
WORDS = 1 << WORD_BITS
STATS = 16
FEATURES = WORDS + STATS
RANK = 8
MAX_TRAINING = 12_000
EPOCHS = 12
THRESHOLD = 0.3
FOLDS = 5


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


class WordIndex(dict):
    """word -> hashed feature; bounded by starting anew when full."""

    def __missing__(self, w):
        if len(self) > 500_000:
            self.clear()
        x = self[w] = zlib.crc32(w.lower().encode("utf-8", "replace")) & (WORDS - 1)
        return x


def features(text: str | None, index: WordIndex):
    """(word feature ids, word feature values, structure statistics)."""
    stats = np.zeros(STATS, np.float32)
    text = text or ""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        stats[15] = 1
        return np.empty(0, np.int32), np.empty(0, np.float32), stats
    ids, tf = np.unique(np.fromiter(map(index.__getitem__, words), np.int32, n), return_counts=True)
    x = np.log1p(tf).astype(np.float32)
    x /= np.sqrt((x * x).sum())
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    by = np.bincount(raw, minlength=256)
    letters_up, letters_low, digits = by[65:91].sum(), by[97:123].sum(), by[48:58].sum()
    high, spaces = by[128:].sum(), by[32] + by[9]
    lines = by[10] + 1
    marks = {c: by[ord(c)] for c in "!|#$%&*.,"}
    odd = sum(marks[c] for c in "#$%&*")
    total = max(1, len(raw))
    distinct = len(set(words))
    stats[:] = [
        letters_up / total * 4, letters_low / total, digits / total * 10, high / total, spaces / total * 4,
        odd / n * 4, marks["!"] / n * 4, marks["|"] / n * 4, (marks["."] + marks[","]) / n * 2,
        distinct / n, distinct / n * min(1.0, n / 200), size / n / 10, min(1.0, lines / n * 4),
        np.log1p(n) / 10, np.log1p(size / lines) / 8, 0]
    return ids.astype(np.int32), x, np.minimum(stats, 3)


class Machine:
    """Fitted weights; ``score`` by the sum-of-squares identity."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def score(self, ids, x, stats) -> float:
        i = np.concatenate((ids, np.arange(WORDS, FEATURES)))
        x = np.concatenate((x, stats)).astype(np.float64)
        vx = self.v[i] * x[:, None]
        pairs = 0.5 * ((vx.sum(0) ** 2).sum() - (vx * vx).sum())
        z = self.w0 + float(self.w[i] @ x) + float(pairs)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Adam over mini-batches in a fixed order; deterministic."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(FEATURES), rng.normal(0, 0.02, (FEATURES, RANK))
    share = (labels.sum() + 1) / (len(labels) + 2)
    w0 = float(np.log(share / (1 - share))) if len(labels) else 0.0
    if len(set(labels.tolist())) < 2:
        return Machine(w0, w, np.zeros_like(v))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v), 0.0, 0.0]
    step, size, l2 = 0, 64, 1e-4
    every = np.arange(WORDS, FEATURES)
    for epoch in range(epochs):
        rate = 0.02 / (1 + 0.3 * epoch)
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), size):
            batch = order[lo:lo + size]
            step += 1
            ids = [np.concatenate((rows[k][0], every)) for k in batch]
            x = np.concatenate([np.concatenate((rows[k][1], rows[k][2])) for k in batch]).astype(np.float64)
            n = np.array([len(i) for i in ids])
            first = np.concatenate(([0], np.cumsum(n)[:-1]))
            flat, doc = np.concatenate(ids), np.repeat(np.arange(len(batch)), n)
            vi = v[flat]
            vx = vi * x[:, None]
            s = np.add.reduceat(vx, first)
            z = w0 + np.add.reduceat(w[flat] * x, first) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), first))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            gx = g[doc] * x
            used, at = np.unique(flat, return_inverse=True)
            gw = np.bincount(at, gx, len(used)) + l2 * w[used]
            dv = gx[:, None] * (s[doc] - vx)
            gv = np.stack([np.bincount(at, dv[:, f], len(used)) for f in range(RANK)], 1) + l2 * v[used]
            for k, (p, grad) in enumerate(((w, gw), (v, gv))):
                m, u = state[2 * k], state[2 * k + 1]
                m[used] = 0.9 * m[used] + 0.1 * grad
                u[used] = 0.999 * u[used] + 0.001 * grad * grad
                p[used] -= rate * (m[used] / (1 - 0.9 ** step)) / (np.sqrt(u[used] / (1 - 0.999 ** step)) + 1e-8)
            state[4], state[5] = 0.9 * state[4] + 0.1 * g.sum(), 0.999 * state[5] + 0.001 * g.sum() ** 2
            w0 -= rate * (state[4] / (1 - 0.9 ** step)) / (np.sqrt(state[5] / (1 - 0.999 ** step)) + 1e-8)
    return Machine(w0, w, v)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = MAX_TRAINING) -> Machine:
    """Fit on at most ``most`` labelled rows outside the held-out fold."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0))
                    .groupBy("doc_id").agg(F.min("quality").alias("y"))
                    .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def extract(batches):
        import pyarrow as pa

        index = WordIndex()
        for batch in batches:
            for part in sub_batches(batch, "text"):
                found = [features(t, index) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("y").cast(pa.int32()), *(pa.array([f[k].tobytes() for f in found], pa.binary()) for k in range(3))],
                    names=["doc_id", "y", "ids", "x", "stats"])

    # one row a doc_id, so the driver gets at most ``most`` rows however often an id repeats
    found = rows.mapInArrow(extract, "doc_id long, y int, ids binary, x binary, stats binary")
    one = found.groupBy("doc_id").agg(F.min(F.struct("ids", "x", "stats", "y")).alias("r")).select("doc_id", "r.*")
    got = sorted(one.toArrow().to_pylist(), key=lambda r: r["doc_id"])
    data = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["x"], np.float32), np.frombuffer(r["stats"], np.float32)) for r in got]
    return fit(data, np.array([r["y"] for r in got], np.float64))


def score(df: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of label 1 to every row."""
    if out in df.columns:
        raise ValueError(f"column {out} exists already")

    def run(batches):
        import pyarrow as pa

        index = WordIndex()
        for batch in batches:
            for part in sub_batches(batch, text):
                s = [machine.score(*features(t, index)) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from the threshold on)."""
    if "predicted" in docs.columns:
        raise ValueError("column predicted exists already")
    scored = score(docs, train(docs, labels, text), text)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
