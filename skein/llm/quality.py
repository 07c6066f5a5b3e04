"""Quality rules: a hashed word and character n-gram logistic regression with calibrated probabilities and fixed thresholds.

Features of a text are the relative frequencies of its hashed n-grams: white-space separated words (1 and 2 in a row,
case and punctuation kept, a word after itself being one n-gram whichever word it is) and characters (1 to 3 in a row), each kind summing to 1, so a text of any length is scored
as a whole: z = bias + sum over kinds of the mean weight. Training: L2-regularised logistic regression by L-BFGS on four of five
labelled rows, Platt scaling on the fifth. The labelled rows are bounded by SAMPLE (those with the least hash of
doc_id); everything else is over all rows.

Decision: "reject" below REJECT, "accept" from ACCEPT, "review" between. Only "reject" removes a document.

Edge cases: null text is scored as empty text; a text without n-grams of a kind has 0 for that kind. A document whose
doc_id is null is scored like any other. Repeated rows give repeated results. Labels that are null or whose document is
missing are not used; if one of the classes has no row, every document has probability 1 (0 if all are bad), without
labels 1. Columns other than doc_id, text, quality are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BITS = 18
#: Most labelled rows that the model is fitted on.
SAMPLE = 2_000
REJECT, ACCEPT = 0.3, 0.9
L2 = 1e-6
SCALE = 30.0
KINDS = 5
SCHEMA = "doc_id long, quality_prob double, decision string"


def features(cp: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind: hashed n-grams (feature numbers) and each document's offsets into them."""
    n = len(offsets) - 1
    m = C.mix_table()[cp]
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    shift = C.U(64 - BITS)
    h = m
    for k in range(1, 4):
        if k > 1:
            h = h[:-1] * C.BASE + m[k - 1 :]
            at = np.flatnonzero(doc[: len(h)] == doc[k - 1 :]) if len(h) else np.empty(0, np.int64)
        else:
            at = None
        x = h if at is None else h[at]
        per = np.maximum(np.diff(offsets) - k + 1, 0)
        yield ((x * C.U(0xD6E8FEB86659FD93 + 2 * k)) >> shift).astype(np.int32), np.concatenate([[0], np.cumsum(per)])
    on = ~((cp == 32) | ((cp >= 9) & (cp <= 13)))
    start, end = C.runs(on, offsets)
    w = C.hash_runs(cp, on, start, end)
    at = np.searchsorted(start, offsets)
    yield (w >> shift).astype(np.int32), at
    g, d, first = C.shingles(w, at, 2)
    g[w[first] == w[np.minimum(first + 1, len(w) - 1)]] = C.U(0x5EED) << shift  # a word twice in a row, whichever it is
    yield (g >> shift).astype(np.int32), np.searchsorted(d, np.arange(n + 1))


def means(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean of each document's values, 0 where it has none."""
    n = np.diff(offsets)
    some = n > 0
    out = np.zeros(len(n))
    if some.any():
        out[some] = np.add.reduceat(values, offsets[:-1][some], dtype=np.float64) / n[some]
    return out


def logits(cp: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """weights: KINDS x 2^BITS, then the bias."""
    z = np.full(len(offsets) - 1, float(weights[-1]))
    table = weights[:-1].reshape(KINDS, -1)
    for k, (x, at) in enumerate(features(cp, offsets)):
        z += SCALE * means(table[k][x], at)
    return z


def minimise(f, x: np.ndarray, steps: int = 40, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking."""
    v, g = f(x)
    s, y = [], []
    for _ in range(steps):
        q, a = g.copy(), []
        for i in range(len(s) - 1, -1, -1):
            a.append(s[i] @ q / (y[i] @ s[i]))
            q -= a[-1] * y[i]
        if s:
            q *= (s[-1] @ y[-1]) / (y[-1] @ y[-1])
        for i in range(len(s)):
            q += s[i] * (a[len(s) - 1 - i] - y[i] @ q / (y[i] @ s[i]))
        t, slope = (1.0 if s else 1 / max(1e-9, np.abs(g).sum())), g @ q
        for _ in range(20):
            to = x - t * q
            v2, g2 = f(to)
            if v2 <= v - 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        ds, dy = to - x, g2 - g
        if ds @ dy > 1e-12:
            s, y = [*s, ds][-memory:], [*y, dy][-memory:]
        done = abs(v - v2) < 1e-7 * abs(v)
        x, v, g = to, v2, g2
        if done:
            break
    return x


def fit(texts: pa.Array, good: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights, and slope and offset of the calibration. fold: true for the rows of the calibration."""
    n = len(good)
    if not n or good.all() or not good.any():
        return np.zeros(KINDS * (1 << BITS) + 1, np.float32), 0.0, 40.0 if not n or good.all() else -40.0
    rows, cols, vals, base = [], [], [], 0
    for part in C.slices(pa.RecordBatch.from_arrays([texts], names=["text"])):  # a slice at a time: all n-grams of the sample at once would take a gigabyte
        for k, (x, at) in enumerate(features(*C.codepoints(part.column(0)))):
            doc = np.repeat(np.arange(part.num_rows), np.diff(at))
            key, count = np.unique(doc << BITS | x, return_counts=True)
            d = key >> BITS
            vals.append((SCALE * count / np.maximum(np.diff(at), 1)[d]).astype(np.float32))
            cols.append(((key & ((1 << BITS) - 1)) + (k << BITS)).astype(np.int32))
            rows.append((d + base).astype(np.int32))
        base += part.num_rows
    rows, cols, vals = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    seen = np.bincount(cols, minlength=KINDS << BITS) > 0  # features of the sample alone are fitted
    used, cols = np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[cols]
    train = ~fold if (good[~fold].any() and not good[~fold].all()) else np.ones(n, bool)
    y = np.where(good, 1.0, -1.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(rows, w[:-1][cols] * vals, n) + w[-1]
        e = np.exp(-np.abs(y * z))
        p = np.where(y * z > 0, e / (1 + e), 1 / (1 + e))
        v = (np.maximum(-y * z, 0) + np.log1p(e))[train].mean() + L2 / 2 * (w[:-1] @ w[:-1])
        r = np.where(train, -y * p, 0) / train.sum()
        return v, np.append(np.bincount(cols, r[rows] * vals, len(used)) + L2 * w[:-1], r.sum())

    w = minimise(loss, np.zeros(len(used) + 1))
    z = np.bincount(rows, w[:-1][cols] * vals, n) + w[-1]
    held = fold if (good[fold].any() and not good[fold].all()) else train
    a, b = platt(z[held], good[held])
    full = np.zeros(KINDS * (1 << BITS) + 1, np.float32)
    full[used], full[-1] = w[:-1], w[-1]
    return full, a, b


def platt(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through held-out scores, with the usual smoothed targets."""
    pos, neg = good.sum(), (~good).sum()
    t = np.where(good, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        u = x[0] * z + x[1]
        e = np.exp(-np.abs(u))
        p = np.where(u > 0, 1 / (1 + e), e / (1 + e))
        v = (np.maximum(u, 0) - t * u + np.log1p(e)).mean()
        return v, np.array([((p - t) * z).mean(), (p - t).mean()])

    a, b = minimise(loss, np.array([1.0, 0.0]), 100)
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, float]:
    """The model, fitted in one task on at most `sample` labelled rows."""
    some = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
        .where("id is not null and quality is not null").groupBy("id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(F.broadcast(some), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))  # a bounded side

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        good = t.column("quality").to_numpy() > 0
        fold = C.mix(t.column("id").to_numpy().astype(np.int64).view(C.U)) % C.U(5) == 0
        w, a, b = fit(t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string()), good, fold)
        return pa.table({"w": [w.astype("<f4").tobytes()], "a": [a], "b": [b]})

    got = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: one(t.drop_columns(["all"])), "w binary, a double, b double").first()
    if got is None:
        return np.zeros(KINDS * (1 << BITS) + 1, np.float32), 0.0, 40.0
    return np.frombuffer(got.w, "<f4"), got.a, got.b


def scored(docs: DataFrame, model: tuple[np.ndarray, float, float], reject: float = REJECT, accept: float = ACCEPT, keep_rows: bool = False) -> DataFrame:
    """doc_id, quality_prob, decision of every row; with keep_rows the rows of docs themselves, without the rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, a, b = shared.value
        for whole in it:
            for x in C.slices(whole):
                p = 1 / (1 + np.exp(-np.clip(a * logits(*C.codepoints(x.column(x.schema.get_field_index("text"))), w) + b, -40, 40)))
                if keep_rows:
                    yield x.filter(pa.array(p >= reject))
                else:
                    said = np.where(p < reject, "reject", np.where(p < accept, "review", "accept"))
                    yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(p.round(6)), pa.array(said, pa.string())], names=["doc_id", "quality_prob", "decision"])

    if keep_rows:
        return C.mapped(docs, batches, docs.schema)
    return C.mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), batches, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    return scored(docs, train(docs, C.read(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rejected documents. Training texts are those of the documents table."""
    return scored(docs, train(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")), keep_rows=True)
