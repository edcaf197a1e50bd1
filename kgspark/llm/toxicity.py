"""Toxicity grades by cumulative-link ordinal regression (McCullagh, 1980) on sparse word indicators.

P(grade <= k) = logistic(theta_k - w x): all thresholds share the weights w, and the expected severity is
the sum over k of P(grade > k). The grams are counted by Spark; a bounded labelled sample is fitted on
the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, labelled_texts
from .wordgrams import class_counts, known_grams, plain_words, scored, sparse_rows


@dataclass
class OrdinalModel:
    weights: tuple[np.ndarray, np.ndarray]  # ascending word hashes, and their weights
    thresholds: list[float]


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_cumulative_link(y, start, cols, features: int, grades: int, l2: float = 1e-3, steps: int = 400, rate: float = 0.1):
    """Weights and ordered thresholds by gradient steps with moments; each grade weighs the same in total."""
    n = len(y)
    row = np.repeat(np.arange(n), np.diff(start))
    share = np.bincount(y, minlength=grades).astype(float)
    weight = (n / (grades * np.maximum(share, 1)))[y] / n
    w = np.zeros(features)
    gap = np.concatenate([[0.0], np.zeros(grades - 2)])  # theta_0, then logs of the distances
    m, v = np.zeros(features + grades - 1), np.zeros(features + grades - 1)
    for t in range(1, steps + 1):
        theta = gap[0] + np.concatenate([[0.0], np.cumsum(np.exp(gap[1:]))])
        eta = np.bincount(row, w[cols], n)
        upper = np.where(y < grades - 1, _logistic(theta[np.minimum(y, grades - 2)] - eta), 1.0)
        lower = np.where(y > 0, _logistic(theta[np.maximum(y - 1, 0)] - eta), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        geta = weight * (du - dl) / p
        gw = np.bincount(cols, geta[row], features) + l2 * w
        gtheta = np.bincount(np.minimum(y, grades - 2), np.where(y < grades - 1, -weight * du / p, 0), grades - 1)
        gtheta += np.bincount(np.maximum(y - 1, 0), np.where(y > 0, weight * dl / p, 0), grades - 1)
        tail = np.cumsum(gtheta[::-1])[::-1]
        g = np.concatenate([gw, [tail[0]], tail[1:] * np.exp(gap[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, gap = w - step[:features], gap - step[features:]
    return w, gap[0] + np.concatenate([[0.0], np.cumsum(np.exp(gap[1:]))])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade: str = "toxic", train_on: Column | None = None, bound: int = 20_000, chars: int = 200_000_000, min_docs: int = 3, z: float = 4.5) -> OrdinalModel:
    """Fit on at most about `bound` graded texts of about `chars` characters together, chosen by a hash of the id.

    `grade` counts from 0 (harmless). Where it holds only 0 and 1, grade 1 is divided: a text with more
    than the median number of marker words (those at least e^2 times likelier in grade 1) gets grade 2.
    The words used are all those in at least `min_docs` texts whose shares among harmless and other texts differ by
    at least `z` standard errors. Without such words nothing parts the texts: the probability of a grade above 0 is
    then its share in the sample for every text. Without two grades it is 0. Of one label for all texts nothing is
    learned. Repeated rows of an id count as often as they occur; null, empty and very long texts are counted whole.
    """
    sample = bounded_labels(labels.where(train_on) if train_on is not None else labels, grade, bound, id_col)
    texts = labelled_texts(docs, sample, id_col, text_col, chars)
    sizes = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    none = np.empty(0, np.uint64), np.empty(0)
    if len(sizes) < 2 or 0 not in sizes:
        return OrdinalModel(none, [500.0])
    some = texts.withColumn("y", (F.col("y") > 0).cast("int"))
    n0, n1 = sizes[0], sum(sizes.values()) - sizes[0]
    pooled = (F.col("n0") + F.col("n1")) / (n0 + n1)
    differ = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    index, c0, c1 = known_grams(class_counts(some, plain_words, 2).where((F.col("n0") + F.col("n1") >= min_docs) & (differ >= z)))
    if not len(index):
        return OrdinalModel(none, [float(np.log((n0 + 0.5) / (n1 + 0.5)))])
    y, start, cols = sparse_rows(texts, plain_words, index)
    odds = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
    if max(sizes) == 1:
        strong = np.bincount(np.repeat(np.arange(len(y)), np.diff(start)), (odds >= 2)[cols], len(y))
        y = np.where(y == 1, 1 + (strong > np.median(strong[y == 1])), 0)
    grades = int(y.max()) + 1
    w, theta = fit_cumulative_link(y, start, cols, len(index), max(grades, 2))
    return OrdinalModel((index, w), [float(x) for x in theta])


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """`(id_col, severity, grade, toxic)` for every row.

    severity is the expected grade, grade the likeliest one (of equals the lower), toxic whether the
    probability of a grade above 0 is over `cut` by more than rounding can make it. Null and empty texts are scored as
    texts without words, very long ones whole; repeated rows are scored alike; an empty table gives an empty one.
    Columns of `docs` that are not named are not read.
    """
    theta = np.array(model.thresholds)

    def finish(sums: np.ndarray):
        over = _logistic(sums[:, None] - theta[None, :])
        cum = np.concatenate([1 - over, np.ones((len(sums), 1))], axis=1)
        p = np.diff(cum, axis=1, prepend=0)
        return over.sum(axis=1), p.argmax(axis=1).astype(np.int32), over[:, 0] > cut + 1e-6

    return scored(docs, id_col, text_col, plain_words, model.weights, finish, "severity double, grade int, toxic boolean")
