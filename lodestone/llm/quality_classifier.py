"""Quality scores by positive-unlabelled learning with the non-negative risk.

Trusted positives are rows labelled good; unlabelled rows are a sample of the
corpus. The class prior of the unlabelled rows is estimated (the share of
unlabelled over the share of positive rows above a score, at the score where
that upper bound is tightest), then a small network is trained to minimise the
non-negative unbiased risk. Features are measured on whole texts: character
classes, word shapes, repetition and line structure. Labels, ids, language and
source are never inputs.

Bounds: about ``sample_rows`` positives and twice as many unlabelled rows train
the model at most. Both are drawn from all rows by a hash of id and text against
the rows' exact count, rows repeating both counting once, so their number exceeds
that only by chance (by 5 % less than once in 10^10); only features reach the driver. All rows are scored, in one scan without a shuffle.

Defined results: a null or empty text is scored by its (zero) features. Null
ids or labels never train. Repeated rows are scored one by one. With no
positives at all every score is 0.5. Other columns of the input stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS = np.zeros(256, np.int64)  # place of each byte's class: marks, then upper, lower, digit, blank, line end, rest
for _c in range(256):
    _CLASS[_c] = len(_MARKS) + 5
for _k, _c in enumerate(_MARKS):
    _CLASS[_c] = _k
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\x0c", "\n")):
    for _c in _chars.encode():
        _CLASS[_c] = len(_MARKS) + _k
N_CLASSES = len(_MARKS) + 6


def features(text: str) -> np.ndarray:
    """Measures of one whole text, most of them square roots of shares."""
    raw = np.frombuffer(text.encode(), np.uint8)
    shares = np.bincount(_CLASS[raw], minlength=N_CLASSES) / max(1, len(raw))
    words = text.split()
    n = len(words)
    if not n:
        return np.concatenate([np.sqrt(shares), np.zeros(10)])
    sizes = np.fromiter(map(len, words), np.int64, n)
    distinct = len(set(words))
    again = sum(map(str.__eq__, words, words[1:])) / n
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    shouted = sum(map(str.isupper, words)) / n
    bare = sum(1 for w in words if not w[0].isalnum() and not w[-1].isalnum()) / n
    tail = sum(1 for w in words if len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum()) / n
    more = [
        again,
        1 - pairs if n > 1 else 0.0,
        1 - distinct / n,
        shouted,
        bare,
        tail,
        1 - len(set(lines)) / max(1, len(lines)),
    ]
    scale = [sizes.mean() / 10, min(3.0, sizes.std() / 5), np.log1p(n) / 8]
    return np.concatenate([np.sqrt(shares), np.sqrt(more), scale])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased logistic risk of margins: of the positives, and of the rest, which must not fall below zero."""
    rest = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    return float(prior * np.logaddexp(0, -positive).mean()), float(rest)


def slopes(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> np.ndarray:
    """Slopes of the mean logistic loss of positives against unlabelled rows."""
    p, u = 1 / (1 + np.exp(-positive)), 1 / (1 + np.exp(-unlabelled))
    return np.concatenate([(p - 1) / len(p), u / len(u)])


def risk_slopes(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Slopes of the risk for the margins; where the rest has fallen below zero, those that raise it again."""
    p, u = 1 / (1 + np.exp(-positive)), 1 / (1 + np.exp(-unlabelled))
    rest = np.concatenate([-prior * p / len(p), u / len(u)])
    if risk(positive, unlabelled, prior)[1] < 0:
        return -rest
    return rest + np.concatenate([prior * (p - 1) / len(p), np.zeros(len(u))])


def _train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int, hidden: int, seed: int) -> Model:
    """Adam on the non-negative risk for ``prior``; on plain positive-against-unlabelled risk where it is None."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 0.02
    model = Model(mean, scale, rng.normal(0, 0.3, (both.shape[1], hidden)) / np.sqrt(both.shape[1]) * 3, np.zeros(hidden), rng.normal(0, 0.3, hidden), 0.0, prior or 0.5)
    weights = [model.w1, model.b1, model.w2, np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    size = min(1024, len(positive), len(unlabelled))
    for step in range(1, steps + 1):
        xp = positive[rng.integers(0, len(positive), size)]
        xu = unlabelled[rng.integers(0, len(unlabelled), size)]
        z = np.clip((np.concatenate([xp, xu]) - mean) / scale, -6, 6)
        h = np.tanh(z @ weights[0] + weights[1])
        g = np.clip(h @ weights[2] + weights[3][0], -30, 30)
        slope = (slopes if prior is None else risk_slopes)(g[:size], g[size:], prior)
        back = slope[:, None] * weights[2] * (1 - h * h)
        steps_of = [z.T @ back + 1e-4 * weights[0], back.sum(0), h.T @ slope + 1e-4 * weights[2], np.array([slope.sum()])]
        for w, m, v, d in zip(weights, first, second, steps_of, strict=True):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            w -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    return model


def estimate_prior(score_positive: np.ndarray, score_unlabelled: np.ndarray) -> float:
    """Smallest upper bound of the positives' share: P(unlabelled above t) / P(positive above t), with slack for small tails."""
    cuts = np.quantile(score_positive, np.linspace(0, 0.95, 96))
    above_p = 1 - np.searchsorted(np.sort(score_positive), cuts) / len(score_positive)
    above_u = 1 - np.searchsorted(np.sort(score_unlabelled), cuts) / len(score_unlabelled)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(score_positive)) + 1 / np.sqrt(len(score_unlabelled)))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 800, hidden: int = 24, seed: int = 1) -> Model | None:
    """The model for two feature matrices; None without positives or unlabelled rows."""
    if not len(positive) or not len(unlabelled):
        return None
    half_p, half_u = positive[::2], unlabelled[::2]
    check_p, check_u = (positive[1::2], unlabelled[1::2]) if min(len(positive), len(unlabelled)) > 1 else (half_p, half_u)
    raw = _train(half_p, half_u, None, steps // 2, hidden, seed)
    prior = estimate_prior(raw.margin(check_p), raw.margin(check_u))
    return _train(positive, unlabelled, prior, steps, hidden, seed)


def is_held_out(doc_id: Column) -> Column:
    """Rows that never train: CRC-32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _measured(rows: DataFrame) -> np.ndarray:
    """Features of the rows of ``key, text``, each key once, in the order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["key", "x"])

    found = rows.mapInArrow(run, "key long, x array<double>").groupBy("key").agg(F.first("x").alias("x")).toArrow().sort_by("key")
    return np.array(found.column("x").to_pylist(), np.float64).reshape(-1, len(features("")))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Model | None:
    """A model from labelled positives and an unlabelled sample, held-out rows apart from both."""
    drawn = lambda rows, n, most: rows.where(F.pmod(F.col("key"), F.lit(1 << 30)) < int(min(1.0, most / max(1, n)) * (1 << 30)))
    good = labels.where((F.col(quality) == 1) & F.col(doc_id).isNotNull() & ~is_held_out(F.col(doc_id))).select(F.col(doc_id).alias("good_id")).distinct()
    ids = drawn(good.withColumn("key", F.xxhash64(F.lit(3), "good_id")), good.count(), sample_rows)
    free = docs.where(F.col(doc_id).isNotNull() & ~is_held_out(F.col(doc_id))).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    trusted = free.join(F.broadcast(ids), free["doc_id"] == ids["good_id"], "left_semi")  # about sample_rows ids at most
    picked = lambda rows, seed: rows.select(F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"), "text")
    positive = _measured(drawn(picked(trusted, 1), trusted.count(), sample_rows))
    return train(positive, _measured(drawn(picked(free, 2), free.count(), 2 * sample_rows)))


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """``doc_id, score`` of every row, or with ``keep`` all columns of ``docs`` and ``quality_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(at if keep else 1).to_pylist()
            found = np.full(len(texts), 0.5) if m is None or not texts else m.score(np.stack([features(t or "") for t in texts]))
            columns = batch.columns if keep else batch.columns[:1]
            names = batch.schema.names if keep else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], [*names, "quality_score" if keep else "score"])

    if keep:
        held = docs.drop("quality_score")
        at = held.columns.index(text)
        return held.mapInArrow(run, T.StructType([*held.schema.fields, T.StructField("quality_score", T.DoubleType())]))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")
