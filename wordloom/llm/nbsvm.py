"""Quality classifier: naive Bayes support vectors.

Features are hashed indicators of 1- to 3-grams of the lower-cased words, and of 1- to 3-grams of the words' shapes (case,
length class, mark at the end, whether the word repeats the one before it, whether it starts a line).  They are scaled
by class log-count ratios, and a linear hinge-loss model is fitted by dual coordinate descent on the scaled,
length-normalised vectors.  A logistic fit turns margins to scores.

The model is fitted on a bounded sample of labelled documents, in order of a hash of doc_id: ``max_rows`` at most and
``max_bytes`` of their features at most.  Scoring covers every row and whole texts.  Labels that are null or whose
document is missing teach nothing; a doc_id with several labels has the largest, and one with several rows
teaches once, by its greatest text.  With labels of one class or none, every score is that class's share.  Null and empty
texts have no features and are scored by the intercept; texts with equal features have equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, kernels
from .kernels import U64

BITS = 18
MAX_ROWS, MAX_BYTES = 20_000, 24 << 20
EPOCHS, COST, ALPHA = 8, 1.0, 1.0


def shape_tokens(text) -> tuple[np.ndarray, np.ndarray]:
    """A shape code for each word, and the words' offsets by document."""
    words = kernels.Words(text)
    if not len(words.start):
        return np.zeros(0, U64), words.off
    buf, start, end = words.buf, words.start, words.end
    upper = np.concatenate([[0], np.cumsum((buf >= 65) & (buf <= 90))])
    lower = np.concatenate([[0], np.cumsum(((buf >= 97) & (buf <= 122)) | (buf >= 128))])
    digit = np.concatenate([[0], np.cumsum((buf >= 48) & (buf <= 57))])
    size = end - start
    ups, lows, digits = upper[end] - upper[start], lower[end] - lower[start], digit[end] - digit[start]
    case = np.select([(ups == 0) & (lows > 0), (ups > 0) & (lows == 0), (ups == 1) & (lows > 0), ups > 1], [1, 2, 3, 4], 0)
    marks = np.minimum(size - ups - lows - digits, 3)
    last = buf[end - 1]
    tail = np.where((last >= 128) | ((last >= 48) & (last <= 57)) | ((last >= 65) & (last <= 90)) | ((last >= 97) & (last <= 122)), 0, last)
    long = np.digitize(size, [2, 4, 8, 16, 32])
    same = np.append(False, words.hash[1:] == words.hash[:-1])
    line = np.append(True, buf[start[1:] - 1] == 10)
    line[words.off[:-1][words.counts > 0]] = True
    same[words.off[:-1][words.counts > 0]] = False
    code = ((((case * 4 + marks) * 256 + tail) * 8 + long) * 2 + same) * 2 + line
    return code.astype(U64) * 2 + (digits > 0).astype(U64) + U64(1), words.off


def features(text, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashed n-grams of each document, flat, and their offsets."""
    code, off = shape_tokens(text)
    n_docs, n = len(off) - 1, len(code)
    doc = np.repeat(np.arange(n_docs), np.diff(off))
    keys, kind_of = [], np.uint32 if n_docs << bits <= 1 << 32 else U64  # narrow keys sort faster
    owner = doc.astype(kind_of) << kind_of(bits)
    for kind, tokens in enumerate((code, kernels.Words(text, lower=True).hash)):
        h = np.zeros(n, U64)
        for k in range(min(3, n)):
            h = h[: n - k] * U64(0x100000001B3) + tokens[k:]
            inside = np.arange(n - k) + k < off[1:][doc[: n - k]]
            x = kernels.mix(h, 20 + k + 10 * kind) >> U64(64 - bits)
            keys.append((owner[: n - k] | x.astype(kind_of))[inside])
    flat = np.sort(np.concatenate(keys)) if keys else np.zeros(0, kind_of)
    flat = flat[np.append(True, flat[1:] != flat[:-1])] if len(flat) else flat
    cuts = np.searchsorted(flat >> kind_of(bits), np.arange(n_docs + 1).astype(kind_of))
    return (flat & kind_of((1 << bits) - 1)).astype(np.int32), cuts


class Model:
    def __init__(self, weights: np.ndarray, ratio: np.ndarray, intercept: float, scale: tuple[float, float]):
        self.weights, self.ratio, self.intercept, self.scale = weights, ratio, intercept, scale

    def margins(self, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = np.diff(off)
        out = np.full(len(n), self.intercept)
        full = np.flatnonzero(n)
        if len(full):
            at = off[:-1][full]
            r = self.ratio[ids]
            norm = np.sqrt(np.maximum(np.add.reduceat(r * r, at), 1e-12))
            out[full] += np.add.reduceat(self.weights[ids] * r, at) / norm
        return out

    def score(self, text) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.margins(*features(text)) + b, -30, 30)))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, epochs: int) -> tuple[np.ndarray, float]:
    """Linear model of least hinge loss: one dual variable for each row, box-constrained by its cost."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    order, rng = np.arange(len(y)), np.random.default_rng(7)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            ids, x = rows[i]
            q = float(x @ x) + 1.0
            g = y[i] * (float(w[ids] @ x) + bias) - 1
            new = min(max(alpha[i] - g / q, 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[ids] += step * x
                bias += step
    return w, bias


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift of a logistic fit of labels on margins, by Newton steps with smoothed targets."""
    t = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y < 0) + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        s, d = p * (1 - p) + 1e-9, t - p
        h = np.array([[np.sum(s * m * m) + 1e-6, np.sum(s * m)], [np.sum(s * m), np.sum(s) + 1e-6]])
        da, db = np.linalg.solve(h, [np.sum(d * m), np.sum(d)])
        a, b = max(a + da, 1e-3), b + db
    return float(a), float(b)


def train(ids: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> Model:
    size, y = 1 << bits, np.where(labels > 0, 1.0, -1.0)
    n1, n0 = int(np.sum(y > 0)), int(np.sum(y < 0))
    if not n1 or not n0:
        share = min(max(n1 / max(n1 + n0, 1), 1e-6), 1 - 1e-6) if n1 + n0 else 0.5
        return Model(np.zeros(size), np.zeros(size), 0.0, (1.0, float(np.log(share / (1 - share)))))
    p, q = np.full(size, ALPHA), np.full(size, ALPHA)
    for x, label in zip(ids, y, strict=True):
        (p if label > 0 else q)[x] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    rows = []
    for x in ids:
        v = ratio[x]
        rows.append((x, v / max(np.sqrt(v @ v), 1e-6)))
    cost = np.where(y > 0, COST * (n1 + n0) / (2 * n1), COST * (n1 + n0) / (2 * n0))
    w, bias = dual_coordinate_descent(rows, y, size, cost, EPOCHS)
    model = Model(w, ratio, bias, (1.0, 0.0))
    flat, off = np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    model.scale = _logistic(model.margins(flat, off), y)
    return model


def _featurise(batches):
    for batch in batches:
        for part in kernels.slices(batch):
            ids, off = features(part.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "label": part.column("label"), "ids": pa.array([ids[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """labels: doc_id, label (0 or 1)."""
    common.small_batches(docs.sparkSession)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = labels.where("doc_id is not null and label is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label")).orderBy(*order).limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    seen = common.materialize(rows.select("doc_id", "label", "text").mapInArrow(_featurise, "doc_id long, label int, ids binary"), "features")
    sizes = seen.select("doc_id", F.sum(F.octet_length("ids")).over(Window.orderBy(*order)).alias("_bytes"))  # max_rows rows
    got = seen.join(F.broadcast(sizes.where(F.col("_bytes") <= max_bytes)), "doc_id").select("ids", "label").collect()
    common.discard(seen)
    got.sort(key=lambda r: (r["ids"], r["label"]))
    return train([np.frombuffer(r["ids"], np.int32) for r in got], np.array([r["label"] for r in got], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: likelier label 1 the higher."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in kernels.slices(batch):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": pa.array(sent.value.score(part.column("text")))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(common.crc_mod(column, 3) == 1, F.lit(False))


def op9_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels.where(~held_out()).select("doc_id", F.col("quality").alias("label")))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
