"""Quality classifier: naive Bayes support vectors.

Binary n-gram indicators are scaled by the classes' log-count ratios; a linear hinge-loss model over them
is fitted by dual coordinate descent; a logistic curve turns its margin into a score. Log-count ratios
cover all training rows; the linear model is fitted on a bounded sample (`sample_rows`)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import U64, Words, mix, slices, text_buffer

BITS = 17
#: Added to a row's squared norm, so that the few features of a short text weigh less than the bias.
SHRINK = 10.0
#: Counts travel in this many blocks of the feature space.
BLOCKS = 32


def indicators(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every distinct n-gram feature of each text, sorted: bytes in runs of 4, each
    with the case it has, single words, and words that directly repeat."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(off))
    b = raw.astype(np.uint64)
    m = max(0, len(b) - 3)
    code = b[:m] | (b[1 : m + 1] << U64(8)) | (b[2 : m + 2] << U64(16)) | (b[3 : m + 3] << U64(24))
    same = doc[:m] == doc[3 : m + 3]
    words = Words(raw, off)
    again = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1]))
    key = [
        (doc[:m][same] << U64(BITS)) | (mix(code[same] + U64(1 << 40)) >> U64(64 - BITS)),
        (words.doc.astype(np.uint64) << U64(BITS)) | (mix(words.hash + U64(7)) >> U64(64 - BITS)),
        (words.doc[again].astype(np.uint64) << U64(BITS)) | (mix(np.full(len(again), 11, np.uint64)) >> U64(64 - BITS)),
    ]
    # a bitmap over (text, feature) where it is small, else a sort
    key = np.concatenate(key).astype(np.int64)
    if n << BITS <= 1 << 25:
        seen = np.zeros(n << BITS, bool)
        seen[key] = True
        key = np.flatnonzero(seen)
    else:
        key = np.unique(key)
    return key >> BITS, key & ((1 << BITS) - 1)


def log_ratios(n: np.ndarray, rows: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of (share of class 1's rows with the feature) / (share of class 0's), n being 2 x features counts."""
    p = (n + smooth) / (rows[:, None] + 2 * smooth)
    return np.log(p[1] / p[0])


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + c sum max(0, 1 - y (w x + b)), x a row's ratios at its features over their norm; the
    bias is one more feature of value 1. One coordinate of the dual at a time, in a seeded random order."""
    w, b = np.zeros(len(r)), 0.0
    value = [r[f] / np.sqrt((r[f] ** 2).sum() + SHRINK) for f in rows]
    square = np.array([(v**2).sum() + 1 for v in value])
    alpha = np.zeros(len(rows))
    cost = np.where(y > 0, c / max(1, (y > 0).sum()), c / max(1, (y < 0).sum())) * len(y) / 2
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ value[i] + b) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * value[i]
                b += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w, b


def fit_curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """a, b of the score 1 / (1 + exp(-(a margin + b))) by Newton steps on smoothed labels."""
    pos, neg = (label > 0).sum(), (label <= 0).sum()
    t = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margin**2).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        if size > 5:
            step *= 5 / size
        a, b = a - step[0], b - step[1]
        if size < 1e-6:
            break
    return float(max(a, 1e-6)), float(b)


class Model:
    def __init__(self, weight: np.ndarray, ratio: np.ndarray, bias: float, a: float, b: float):
        self.scaled, self.square, self.bias, self.a, self.b = weight * ratio, ratio**2, bias, a, b

    def margin(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        doc, feature = indicators(raw, off)
        n = len(off) - 1
        up = np.bincount(doc, self.scaled[feature], n)
        return up / np.sqrt(np.bincount(doc, self.square[feature], n) + SHRINK) + self.bias

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margin(raw, off) + self.b, -40, 40)))


def fit_model(counts: np.ndarray, rows: np.ndarray, sample: list[np.ndarray], label: np.ndarray, c: float = 1.0, epochs: int = 30) -> Model:
    """From class-wise feature counts over all training rows and a bounded sample of rows. Every fifth sample
    row is kept from the linear fit and places the logistic curve. One class only, or no row: a constant score."""
    ratio = log_ratios(counts, rows)
    if len(set(label.tolist())) < 2:
        share = (rows[1] + 1) / (rows.sum() + 2)
        return Model(np.zeros(len(ratio)), ratio, 0.0, 1.0, float(np.log(share / (1 - share))))
    y = np.where(label > 0, 1.0, -1.0)
    apart = np.zeros(len(y), bool)
    for k in (1.0, -1.0):  # of each class
        own = np.flatnonzero(y == k)
        if len(own) >= 10:
            apart[own[::5]] = True
    w, b = dual_coordinate_descent([sample[i] for i in np.flatnonzero(~apart)], y[~apart], ratio, c, epochs)
    model = Model(w, ratio, b, 1.0, 0.0)
    margin = np.array([(w[f] @ ratio[f]) / np.sqrt((ratio[f] ** 2).sum() + SHRINK) + b for f in sample])
    use = apart if apart.any() else ~apart
    model.a, model.b = fit_curve(margin[use], y[use])
    return model


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, c: float = 1.0, epochs: int = 30) -> Model:
    """Learn from all rows of docs (doc_id, text) with a non-null label of labels (doc_id, quality 0 or 1).

    Counts: each task adds up its rows' indicators and sends 2 x 2**17 sums in blocks, so neither shuffle nor driver
    grows with the vocabulary. The linear model sees one row for each of the sample_rows labelled ids that come first by a
    hash of doc_id (ties by doc_id; of rows that share an id the one whose features come first); repeated rows count each in
    the sums. A document labelled several times takes its highest label; null ids, null labels and ids without a document teach nothing; null
    and empty texts have no features, very long ones are read whole; with empty tables the score is constant."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = {r[0] for r in known.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).orderBy("h", "doc_id").limit(sample_rows).collect()}
    held = docs.sparkSession.sparkContext.broadcast(chosen)
    size = 1 << BITS
    step = size // BLOCKS

    def count(batches):
        picked: dict[int, tuple[bytes, int]] = {}
        sums = np.zeros((2, size), np.int64)
        rows = np.zeros(2, np.int64)
        ids = held.value
        for batch in batches:
            for part in slices(batch):
                raw, off = text_buffer(part.column("text"))
                label = np.clip(part.column("quality").to_numpy(), 0, 1)
                doc, feature = indicators(raw, off)
                for k in (0, 1):
                    sums[k] += np.bincount(feature[label[doc] == k], minlength=size)
                    rows[k] += (label == k).sum()
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                for i, x in enumerate(part.column("doc_id").to_pylist()):
                    if x in ids:
                        own = feature[cut[i] : cut[i + 1]].astype(np.int32).tobytes(), int(label[i])
                        name = int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=7).digest())
                        picked[name] = min(picked.get(name, own), own)
        yield from sampled(picked)
        for j in range(BLOCKS):
            block = np.concatenate([sums[:, j * step : (j + 1) * step], rows[:, None] if j == 0 else np.zeros((2, 1), np.int64)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([0], pa.int64()), pa.array([block.tobytes()], pa.binary())], names=["block", "n", "data"])

    def sampled(picked):
        """Rows (-1, twice the id's hash plus the label, features)."""
        if picked:
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(picked), pa.int32()), pa.array([2 * x + label for x, (_, label) in picked.items()], pa.int64()), pa.array([data for data, _ in picked.values()], pa.binary())], names=["block", "n", "data"])

    def add(batches):
        total: dict = {}
        picked: dict[int, tuple[bytes, int]] = {}
        for batch in batches:
            for j, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if j < 0:
                    own = data, n & 1
                    picked[n >> 1] = min(picked.get(n >> 1, own), own)
                else:
                    own = np.frombuffer(data, np.int64)
                    total[j] = total[j] + own if j in total else own.copy()
        yield from sampled(picked)
        for j, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([0], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["block", "n", "data"])

    schema = "block int, n long, data binary"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(known.hint("shuffle_hash"), "doc_id")
    parts = rows.mapInArrow(count, schema).repartitionById(BLOCKS, F.when(F.col("block") < 0, F.shiftright("n", 1) % BLOCKS).otherwise(F.col("block")).cast("int")).mapInArrow(add, schema)
    counts, n_rows, sample, label = np.zeros((2, size)), np.zeros(2), [], []
    for j, n, data in parts.toLocalIterator():
        if j < 0:
            sample.append(np.frombuffer(bytes(data), np.int32))
            label.append(n & 1)
        else:
            block = np.frombuffer(bytes(data), np.int64).reshape(2, step + 1)
            counts[:, j * step : (j + 1) * step] = block[:, :-1]
            n_rows += block[:, -1] if j == 0 else 0
    order = sorted(range(len(sample)), key=lambda i: (label[i], len(sample[i]), sample[i].tobytes()))
    return fit_model(counts, n_rows, [sample[i] for i in order], np.array([label[i] for i in order]), c, epochs)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs (text; further columns ride along, but for those named score or predicted) with score (0 to 1; higher: label 1
    likelier) and predicted (1 if score >= threshold, also at a tie). Null texts are scored as empty ones, very long ones
    whole, repeated rows alike; an empty table gives none. Only the text is read. No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("score", "predicted")
    own = base.columns
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                s = held.value.score(*text_buffer(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=schema.names)

    return base.mapInArrow(run, schema)
