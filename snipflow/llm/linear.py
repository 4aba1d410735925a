"""Linear text classifiers on n-gram indicators scaled by naive Bayes ratios.

A document is the set of its n-grams, hashed into ``2**bits`` columns. Column j
has the value r_j, the log of the smoothed ratio of its rates in the two
classes. A hinge-loss model is fitted to these by dual coordinate descent, and
a logistic curve, fitted on sample rows held back from the descent, turns
margins into probabilities.

Fitting uses a bounded sample: at most ``per_class`` labelled rows of each class,
chosen by a seeded hash of the id (``PER_CLASS``, a documented parameter), so
the driver holds the same amount at any scale. Rates are corrected for the
sampling of the classes. Scoring covers every row and whole texts and reads the
text only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from snipflow.llm.common import buffers, slices, text_frame
from snipflow.session import Scratch

PER_CLASS = 3000
Extract = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def sample_ids(labels: DataFrame, id_col: str, label_col: str, usable: Column, per_class: int, seed: int):
    """At most ``per_class`` ids of each class by seeded hash, and the classes'
    counts among all usable rows."""
    rows = (labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
            .select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    picked = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    return picked, counts


def _feature_rows(extract: Extract):
    def run(batches):
        for batch in batches:
            data, off = buffers(batch["text"])
            ids, ys = batch["doc_id"].to_numpy(zero_copy_only=False), batch["y"].to_numpy(zero_copy_only=False)
            for i, j in slices(off):
                doc, feat = extract(data, off[i:j + 1])
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j]), pa.array(ys[i:j], pa.int32()),
                     pa.array([feat[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                    ["doc_id", "y", "feat"])
    return run


class Model:
    """Weight and squared scale per hashed n-gram, bias, logistic slope and offset."""

    def __init__(self, weight, square, bias: float, slope: float, offset: float):
        self.weight, self.square, self.bias, self.slope, self.offset = weight, square, bias, slope, offset

    def scores(self, doc: np.ndarray, feat: np.ndarray, n: int) -> np.ndarray:
        """Probability of class 1 of ``n`` rows from their (row, n-gram) pairs."""
        num = np.bincount(doc, self.weight[feat], n)
        norm = np.sqrt(np.bincount(doc, self.square[feat], n))
        margin = num / np.where(norm > 0, norm, 1.0) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _norm(x: np.ndarray) -> float:
    return float(np.sqrt(x @ x)) or 1.0


def fit(feats: list[np.ndarray], y: np.ndarray, rate: float, dims: int, cost: float = 1.0,
        epochs: int = 12, smooth: float = 1.0, seed: int = 7) -> Model:
    """Fit from the sets of n-grams of the sample; ``rate`` is the share of class
    1 among all labelled rows. Rows are scaled to unit length."""
    n = len(feats)
    if n == 0 or len(set(y.tolist())) < 2:      # nothing to tell apart
        p = min(max(rate, 1e-6), 1 - 1e-6)
        return Model(np.zeros(dims), np.zeros(dims), 0.0, 0.0, float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    held = np.zeros(n, bool)
    for c in (0, 1):
        own = rng.permutation(np.flatnonzero(y == c))
        held[own[:len(own) // 5]] = True
    train = np.flatnonzero(~held)
    count = np.full((2, dims), smooth)
    for i in train:
        count[y[i], feats[i]] += 1
    ratio = np.log(count[1] / (np.sum(y[train] == 1) + 2 * smooth)) - np.log(count[0] / (np.sum(y[train] == 0) + 2 * smooth))
    sign = np.where(y == 1, 1.0, -1.0)
    scale = np.array([1.0 / _norm(ratio[f]) for f in feats])
    w, b = np.zeros(dims), 0.0          # values are ratio x scale, made when needed: only ids are held
    alpha = np.zeros(n)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(train):
            x = ratio[feats[i]] * scale[i]
            g = sign[i] * (w[feats[i]] @ x + b) - 1.0
            new = min(max(alpha[i] - g / 2.0, 0.0), cost)      # unit row and constant: Q_ii = 2
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[feats[i]] += step * sign[i] * x
                b += step * sign[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    test = np.flatnonzero(held)
    if len(set(y[test].tolist())) < 2:
        test = np.arange(n)
    m = np.array([w[feats[i]] @ ratio[feats[i]] * scale[i] + b for i in test])
    t = (y[test] == 1).astype(float)
    share = t.mean()
    weight = np.where(t == 1, rate / share, (1 - rate) / (1 - share))
    slope, offset = _logistic(m, t, weight)
    return Model(w * ratio, ratio * ratio, b, slope, offset)


def _logistic(m, t, weight, ridge=1e-3, steps=50):
    a, c = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
        g = np.array([(weight * (p - t)) @ m + ridge * a, (weight * (p - t)).sum()])
        h = weight * p * (1 - p)
        hess = np.array([[h @ (m * m) + ridge, h @ m], [h @ m, h.sum() + 1e-6]])
        d = np.linalg.solve(hess, g)
        d *= min(1.0, 5.0 / (np.abs(d).max() + 1e-12))
        a, c = a - d[0], c - d[1]
        if np.abs(d).max() < 1e-7:
            break
    return float(max(a, 1e-3)), float(c)


def train(df: DataFrame, labels: DataFrame, extract: Extract, dims: int, label_col: str, usable: Column,
          id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, seed: int = 11) -> Model:
    """Fit on a bounded sample of the labelled rows where ``usable`` holds."""
    picked, counts = sample_ids(labels, id_col, label_col, usable, per_class, seed)
    # At most 2 x per_class ids: a proven bound, so the texts need no shuffle. The
    # sample's n-gram ids are written and then read part by part.
    scratch = Scratch(df.sparkSession, "sample")
    saved = scratch.save(text_frame(df, id_col, text_col).join(F.broadcast(picked), "doc_id")
                         .mapInArrow(_feature_rows(extract), "doc_id bigint, y int, feat binary"), "rows")
    rows = [(r["doc_id"], r["y"], bytes(r["feat"])) for r in saved.toLocalIterator()]
    scratch.drop()
    rows.sort()
    total = sum(counts.values())
    rate = counts.get(1, 0) / total if total else 0.5
    return fit([np.frombuffer(f, np.int32) for _, _, f in rows], np.array([y for _, y, _ in rows], int), rate, dims)


def score(df: DataFrame, model: Model, extract: Extract, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)      # fixed size: 2**bits numbers

    def run(batches):
        model = shared.value
        for batch in batches:
            data, off = buffers(batch["text"])
            out = np.zeros(batch.num_rows)
            for i, j in slices(off):
                doc, feat = extract(data, off[i:j + 1])
                out[i:j] = model.scores(doc, feat, j - i)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out)], ["doc_id", "score"])

    return text_frame(df, id_col, text_col).mapInArrow(run, "doc_id bigint, score double")
