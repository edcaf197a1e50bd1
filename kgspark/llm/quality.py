"""Quality classifier: Naive Bayes support vectors (Wang and Manning, ACL 2012).

N-gram indicators are scaled by class log-count ratios, and a linear hinge-loss model is fitted on them by
dual coordinate descent (Hsieh et al., ICML 2008). Training uses a bounded sample of the labelled texts:
the grams are counted by Spark, and the sample's sparse rows are solved on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, labelled_texts
from .wordgrams import class_counts, known_grams, scored, shape_and_word_grams, sparse_rows


@dataclass
class QualityModel:
    weights: tuple[np.ndarray, np.ndarray]  # ascending gram hashes, and their weights
    slope: float
    offset: float


def dual_coordinate_descent(y, rows: list[np.ndarray], values: np.ndarray, c: float = 1.0, epochs: int = 30, seed: int = 5) -> np.ndarray:
    """Weights of a linear model with hinge loss; y is -1 or 1, a row is its columns, a column's entries are all its value; the last weight is the bias."""
    n, m = len(y), len(values)
    w, alpha = np.zeros(m + 1), np.zeros(n)
    # both classes get the same total cost
    cost = np.where(y > 0, c * n / (2 * max(1, (y > 0).sum())), c * n / (2 * max(1, (y < 0).sum())))
    square = values * values
    norm = np.array([square[r].sum() + 1 for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(n):
            v = values[rows[i]]
            g = y[i] * (v @ w[rows[i]] + w[m]) - 1
            step = min(g, 0.0) if alpha[i] == 0 else max(g, 0.0) if alpha[i] == cost[i] else g
            if step:
                most = max(most, abs(step))
                old, alpha[i] = alpha[i], min(max(alpha[i] - g / norm[i], 0.0), cost[i])
                move = (alpha[i] - old) * y[i]
                w[rows[i]] += move * v
                w[m] += move
        if most < 1e-3:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to the probability of y = 1, by Newton steps."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    want = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    ab = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        grad = x.T @ (p - want) + 1e-6 * ab
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        ab -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(ab[0], 1e-6)), float(ab[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", train_on: Column | None = None, bound: int = 10_000, chars: int = 40_000_000, min_docs: int = 5, smooth: float = 1.0) -> QualityModel:
    """Fit on at most about `bound` labelled texts of about `chars` characters together (a hash of the id chooses;
    `train_on` filters labels first).

    Grams in fewer than `min_docs` of them are left out, all others are used. Without both classes the model scores
    0.5 everywhere. Of the texts only the grams are used: no other column, and no label of a row outside the sample.
    Repeated rows of an id count as often as they occur.
    """
    sample = bounded_labels(labels.where(train_on) if train_on is not None else labels, label, bound, id_col)
    texts = labelled_texts(docs, sample, id_col, text_col, chars).withColumn("y", (F.col("y") > 0).cast("int"))
    index, n0, n1 = known_grams(class_counts(texts, shape_and_word_grams, 2).where(F.col("n0") + F.col("n1") >= min_docs))
    y, start, cols = sparse_rows(texts, shape_and_word_grams, index)
    if len(np.unique(y)) < 2:
        return QualityModel((index[:0], np.empty(0)), 1e-6, 0.0)
    p, q = n1 + smooth, n0 + smooth
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    sign = np.where(y > 0, 1.0, -1.0)
    rows = [cols[x:z] for x, z in zip(start[:-1], start[1:], strict=True)]
    filled = [float((ratio[r] ** 2).sum()) for r in rows if len(r)]
    scale = ratio / max(1.0, float(np.sqrt(np.mean(filled))) if filled else 1.0)
    # margins for the probability curve come from halves that the model did not see
    half = np.arange(len(y)) % 2
    margin = np.zeros(len(y))
    for k in (0, 1):
        at = np.flatnonzero(half == k)
        w = dual_coordinate_descent(sign[at], [rows[i] for i in at], scale)
        for i in np.flatnonzero(half != k):
            margin[i] = scale[rows[i]] @ w[rows[i]] + w[-1]
    slope, offset = platt(margin, sign)
    w = dual_coordinate_descent(sign, rows, scale)
    full = w[:-1] * scale
    used = np.abs(full) > 1e-9
    return QualityModel((index[used], full[used]), slope, offset + slope * float(w[-1]))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, *more) -> DataFrame:
    """`(id_col, *more, score, predicted)` for every row.

    Null and empty texts are scored as texts without words, very long ones whole; repeated rows are scored alike; an
    empty table gives an empty one. Columns of `docs` that are not named are not read.
    """

    def finish(sums: np.ndarray):
        s = 1 / (1 + np.exp(-np.clip(model.slope * sums + model.offset, -500, 500)))
        return s, (s >= threshold).astype(np.int32)

    return scored(docs, id_col, text_col, shape_and_word_grams, model.weights, finish, "score double, predicted int", *more)
