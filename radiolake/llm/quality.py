"""Quality classifier learnt from trusted positives and unlabelled text.

The model is linear in features of the whole text and minimises the non-negative unbiased
positive-unlabelled risk with the logistic loss. As that loss differs by the margin z between
the two labels, the unbiased risk is ``mean_u softplus(z) - prior * mean_p z``; its part for
negatives, ``mean_u softplus(z) - prior * mean_p softplus(z)``, may not fall below zero, and a
step that finds it there goes up that part's gradient instead.

Every row counts: each Newton step is one Spark pass over a staged feature table, in which tasks
return sums of fixed size that a second small layer adds up before the driver sees them.

The class prior is estimated from positives and unlabelled text alone: above any threshold of a
score, the share of all texts divided by the share of positives is at least the prior, and comes
near it where hardly any negative is left. The least such ratio is taken, over thresholds that leave
enough positives, of a score fitted on one half of the positives and read on the other.

Defined cases: a null or empty text has the features of an empty text and is scored; null labels
are ignored; a document with several label rows counts as positive if any of them says so; labels of
quality 0 are not used at all; without any positive, or without any row, every score is 0.5.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiolake.llm.shared import drop_staged, stage_table, table

KINDS = "LMNPSZC"
N_BINS = 128 + len(KINDS) + 3
N_FEATURES = N_BINS + 10


@cache
def bins() -> np.ndarray:
    """Histogram bin of each code point of the basic plane; the last entry stands for all others."""
    out = np.arange(1 << 16, dtype=np.uint8)
    for i in range(128, 1 << 16):
        kind = unicodedata.category(chr(i))
        out[i] = 128 + ({"Lu": 7, "Ll": 8}.get(kind) or KINDS.index(kind[0]))
    out[-1] = N_BINS - 1
    return out


def features_of(text: str | None) -> np.ndarray:
    """Square roots of character shares, then shapes of words and lines."""
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        return out
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out[:N_BINS] = np.sqrt(np.bincount(bins()[np.minimum(codes, 0xFFFF)], minlength=N_BINS) / len(codes))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)
    if n:
        lengths = np.fromiter(map(len, words), np.float32, n)
        out[N_BINS:] = (
            np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()), np.sqrt(len(set(words)) / n),
            sum(not w[-1].isalnum() for w in words) / n, sum(w.isupper() for w in words) / n, sum(not any(map(str.isalnum, w)) for w in words) / n,
            1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        )
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: Column) -> Column:
        """Probability, 0 to 1, that a text is of good quality."""
        model = self

        @F.pandas_udf(T.DoubleType())
        def scored(texts: pd.Series) -> pd.Series:
            return pd.Series(model.scores(np.array([features_of(x) for x in texts], np.float64).reshape(-1, N_FEATURES)))

        return scored(text)


FEATURES = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32()))])


def feature_table(docs: DataFrame) -> DataFrame:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features_of(t) for t in b.column("text").to_pylist()], np.float32).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, N_FEATURES), pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], schema=FEATURES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(extract, "doc_id long, x array<float>")


def summed(df: DataFrame, per_batch) -> np.ndarray | None:
    """Sum over all rows of ``per_batch(x, mark)``, an array of fixed size."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                part = per_batch(x, b.column("mark").to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"s": [total.tolist()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for row in b.column("s"):
                part = row.values.to_numpy()
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"s": [total.tolist()]})

    rows = df.mapInArrow(sums, "s array<double>").repartition(8).mapInArrow(add, "s array<double>").collect()
    return np.sum([r[0] for r in rows], axis=0) if rows else None


@dataclass
class Scaler:
    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)


def fitted(rows: DataFrame, n_u: float, standard: Scaler, prior: float, halves: tuple[int, ...], steps: int, ridge: float) -> np.ndarray:
    """Weights and bias that minimise the risk over ``rows(x, mark)``, of the positives of some halves, by Newton steps.

    The penalty is ``ridge`` times features per positive, as the positives' means are that uncertain.
    """
    d = N_FEATURES
    w = np.zeros(d + 1)
    w[-1] = np.log(prior / (1 - prior))
    for _ in range(steps):

        def parts(x, mark, w=w):
            x, positive = np.hstack([standard(x), np.ones((len(x), 1))]), np.isin(mark, halves)
            return risk_parts(x, positive, w)

        s = summed(rows, parts)
        value, step = newton_step(s, n_u, prior, w, ridge)
        w = w + step
        if value >= 0 and np.abs(step).max() < 1e-4:
            break
    return w


def risk_parts(x: np.ndarray, positive: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows that the risk, its gradient and its curvature are made of."""
    z = np.clip(x @ w, -30, 30)
    p, soft = 1 / (1 + np.exp(-z)), np.logaddexp(0, z)
    xp, pp = x[positive], p[positive]
    return np.concatenate([[positive.sum(), soft.sum(), soft[positive].sum()], x.T @ p, xp.sum(0), xp.T @ pp, (x.T @ (x * (p * (1 - p))[:, None])).ravel()])


def newton_step(s: np.ndarray, n_u: float, prior: float, w: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The risk's part for negatives, and the step: down the risk, or up that part's gradient if it is below zero."""
    n = len(w)
    n_p = max(1.0, s[0])
    grad_u, sum_p, grad_p = (s[3 + i * n : 3 + (i + 1) * n] for i in range(3))
    penalty = np.append(np.full(n - 1, max(1e-3, ridge * (n - 1) / n_p)), 0)
    hessian = s[3 + 3 * n :].reshape(n, n) / n_u + np.diag(penalty + 1e-6)
    negative = s[1] / n_u - prior * s[2] / n_p
    if negative < 0:
        step = np.linalg.solve(hessian, grad_u / n_u - prior * grad_p / n_p)
        return negative, 0.5 * step * min(1, 1 / max(1e-9, np.abs(step).max()))
    step = np.linalg.solve(hessian, grad_u / n_u - prior * sum_p / n_p + penalty * w)
    return negative, -step * min(1, 4 / max(1e-9, np.abs(step).max()))


def least_ratio(of_all: np.ndarray, of_positives: np.ndarray, fewest: int = 20) -> float:
    """The prior, from histograms of a score over all texts and over positives."""
    share_u, share_p = (np.cumsum(h[::-1]) / max(1, h.sum()) for h in (of_all, of_positives))
    least = min(0.9, max(0.3, fewest / max(1, of_positives.sum())))
    ratios = share_u[share_p >= least] / share_p[share_p >= least]
    return float(np.clip(ratios.min(), 0.01, 0.99))


def estimated_prior(rows: DataFrame, n_u: float, standard: Scaler, ridge: float) -> float:
    w = fitted(rows, n_u, standard, 0.5, (1,), 4, ridge)

    def histograms(x, mark):
        z = np.clip((standard(x) @ w[:-1] + w[-1]) * 10 + 300, 0, 599).astype(np.int64)
        return np.concatenate([np.bincount(z, minlength=600), np.bincount(z[mark == 2], minlength=600)]).astype(np.float64)

    s = summed(rows, histograms)
    return least_ratio(s[:600], s[600:]) if s[600:].sum() else 0.5


def train(docs: DataFrame, labels: DataFrame, steps: int = 10, ridge: float = 0.3) -> Model:
    """Fit on every row of ``docs(doc_id, text)``; ``labels(doc_id, quality)`` holds what may be learnt from."""
    half = F.when(F.xxhash64("doc_id") % 2 == 0, 1).otherwise(2)
    positives = labels.filter("doc_id is not null and quality = 1").select("doc_id").distinct().withColumn("mark", half)
    # mark: 0 unlabelled, 1 and 2 positives of either half
    rows = stage_table(feature_table(docs).join(positives, "doc_id", "left").select("x", F.coalesce("mark", F.lit(0)).cast("int").alias("mark")), "quality-features")
    d = N_FEATURES

    def moments(x, mark):
        return np.concatenate([[len(x), (mark > 0).sum()], x.sum(0), (x * x).sum(0)])

    s = summed(rows, moments)
    if s is None or not s[1]:
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 0.5)
    mean = s[2 : 2 + d] / s[0]
    scale = np.sqrt(np.maximum(s[2 + d :] / s[0] - mean**2, 0))
    standard = Scaler(mean, np.where(scale < 1e-6, 1e6, scale))  # a constant feature says nothing
    prior = estimated_prior(rows, s[0], standard, ridge)
    w = fitted(rows, s[0], standard, prior, (1, 2), steps, ridge)
    drop_staged(rows)
    return Model(mean, standard.scale, w[:-1], float(w[-1]), prior)


def fit_on_corpus(docs: DataFrame, labels: DataFrame) -> Model:
    return train(docs, labels.filter(~held_out(F.col("doc_id"))))


THRESHOLD = 0.7


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on_corpus(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
