"""Quality by a regularised quadratic discriminant (operator 9).

Statistics of a text (lengths, shares of kinds of characters, repetition, word shapes) are transformed and scaled. Each
class has a mean and a covariance shrunk towards the pooled one and its diagonal; its Cholesky factor is computed once
and kept. A text's score is the difference of the two Gaussian log-densities, from Mahalanobis distances, put through a
logistic curve fitted on training rows that the densities have not seen.

Training rows: of each label the `per_class` that come first by a hash of the id, texts up to `most_bytes`.

Every fourth training row of each class is kept for the curve. With fewer than four rows of a class the curve is fitted on
all rows, and covariances lean on the pooled one, so that any two rows of different labels give a model.

Defined results: null text counts as empty and gets a score as any other; one label only in training: every score is
that label's, none at all: 0.5; repeated rows are each scored, rows without an id too; labels without an id or with an id
that no document has are left out; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, apart, distinct, grams, held, inside, labelled_sample, runs, sigmoid, text_bytes, words

PER_CLASS, MOST_BYTES, SHRINK, CUT = 3000, 1 << 20, 0.15, 0.7

_KINDS = [range(65, 91), range(97, 123), range(48, 58), (10,), (32, 9, 13), b".,;:'\"?-()", b"!", b"#$%&*@|<>{}[]=_~^\\`+/", range(192, 256)]
_PACKED = np.zeros((3, 256), np.uint64)
for _i, _kind in enumerate(_KINDS):  # three counters of 21 bits in each number
    _PACKED[_i // 3, list(_kind)] += np.uint64(1 << (21 * (_i % 3)))


def _counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many bytes of each kind every row has."""
    out = np.zeros((len(off) - 1, len(_KINDS)), np.int64)
    for a in range(0, len(data), CHUNK):
        b = min(a + CHUNK, len(data))
        r0, r1 = np.searchsorted(off, a, "right") - 1, np.searchsorted(off, b, "left")
        at = np.clip(off[r0 : r1 + 1] - a, 0, b - a)
        for j in range(3):
            c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_PACKED[j][data[a:b]])])
            d = c[at[1:]] - c[at[:-1]]
            for i in range(3):
                out[r0:r1, 3 * j + i] += (d >> np.uint64(21 * i)).astype(np.int64) & ((1 << 21) - 1)
    return out


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Transformed statistics of every row."""
    size = np.diff(off)
    kind = _counts(data, off)
    (h,), at, start, end = words(data, off, lower=True, bounds=True)
    n = np.diff(at)
    length = (end - start).astype(float)
    total, square = np.concatenate([[0], np.cumsum(length)]), np.concatenate([[0], np.cumsum(length**2)])
    mean = (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)
    sd = np.sqrt(np.maximum((square[at[1:]] - square[at[:-1]]) / np.maximum(n, 1) - mean**2, 0))
    _, _, some = distinct(h, at)
    keep, to = inside(at, 3)
    _, _, triples = distinct(grams(h, 3)[keep] if len(h) >= 3 else np.zeros(0, np.uint64), to)
    upper, lower, digit, line, blank, stop, shout, sign, accent = kind.T.astype(float)
    letters, chars, lines = upper + lower + accent, np.maximum(size, 1), line + 1
    share = lambda x, of: np.log((x + 0.5) / (np.maximum(of, 0) + 10))
    return np.column_stack([
        np.log1p(size), np.log1p(n), np.log1p(lines), np.log1p(size / lines), mean, sd, share(upper, letters), share(digit, chars), share(stop, n), share(shout, n), share(sign, n),
        share(accent, letters), share(blank, chars), share(letters, chars), np.log((np.diff(some) + 1) / (n + 1)), np.log((np.diff(triples) + 1) / (np.diff(to) + 1)),
    ])


class Discriminant:
    """Shrunk class covariances with cached Cholesky factors, and the logistic curve over the difference."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: float = SHRINK):
        self.only = None if len(set(y.tolist())) == 2 else (float(y[0]) if len(y) else 0.5)
        if self.only is not None:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        later = apart(y)  # for the curve
        fit = ~later
        pooled = sum(np.cov(z[(y == c) & fit].T, bias=True) * ((y == c) & fit).sum() for c in (0, 1)) / fit.sum()
        target = 0.5 * pooled + 0.5 * np.diag(np.diag(pooled)) + 1e-3 * np.eye(z.shape[1])
        self.classes = []
        for c in (0, 1):
            own = z[(y == c) & fit]
            mine = min(1 - shrink, len(own) / (len(own) + z.shape[1]))  # few rows say little of their own covariance
            factor = np.linalg.cholesky(mine * np.cov(own.T, bias=True) + (1 - mine) * target + 1e-3 * np.eye(z.shape[1]))
            self.classes.append((own.mean(0), np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()))
        later = later if later.any() else fit
        # Equal weight for both labels' rows, so that a sample balanced by label does not shift the curve.
        d, t = self.difference(x[later]), y[later].astype(float)
        w = np.where(t == 1, 0.5 / max(t.mean(), 1e-6), 0.5 / max(1 - t.mean(), 1e-6))
        a, b, spread = 1.0, 0.0, np.abs(d).mean() + 1e-9
        d = d / spread
        for _ in range(500):
            g = w * (sigmoid(a * d + b) - t)
            a, b = a - 0.5 * ((g * d).mean() + 1e-3 * a), b - 0.5 * g.mean()
        self.a, self.b = a / spread, b

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        z = (x - self.mean) / self.scale
        logs = [-0.5 * (((z - m) @ inverse.T) ** 2).sum(1) - 0.5 * log_det for m, inverse, log_det in self.classes]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.only) if self.only is not None else sigmoid(self.a * self.difference(x) + self.b)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> Discriminant:
    """labels: doc_id, quality; rows kept back for tests are not among them."""
    rows = labelled_sample(docs, labels.select("doc_id", F.col("quality").cast("int").alias("y")), per_class, most_bytes)
    return Discriminant(features(*text_bytes(pa.array(rows["text"].tolist(), pa.string()))), rows["y"].to_numpy(int))


def scored(docs: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score of every row."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            for a, b in runs(off, 1 << 21):
                s = known.value.score(features(data[off[a] : off[b]], off[a : b + 1] - off[a]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, score double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, learnt from the labels of three quarters of the ids."""
    model = fit(docs, labels.where(~held(F.col("doc_id"), 4, 2)))
    return scored(docs, model).select("doc_id", held(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
