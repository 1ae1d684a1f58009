"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance that is shrunk to the pooled one and to its diagonal; the score comes from the
difference of the two Mahalanobis log densities, computed with Cholesky factors that are inverted once, and calibrated to
a probability. Fitting uses a bounded sample of labelled rows (`per_class` of each label); scoring is a map.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import logistic
from .common import map_arrow, text_column
from .sampling import bounded

PER_CLASS = 10000
STATISTICS = ("length", "word_length", "signs", "upper", "digits", "variety", "repeats", "line_copies", "bars", "doubled_signs")


@functools.cache
def _kinds() -> np.ndarray:
    """0 white space, 1 letters without case or small, 2 capitals, 3 digits, 4 the rest, by code point."""
    out = np.full(0x110000, 4, dtype=np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isspace():
            out[c] = 0
        elif x.isalpha():
            out[c] = 2 if x.isupper() else 1
        elif x.isdigit():
            out[c] = 3
    return out


def statistics(texts: list[str]) -> np.ndarray:
    """A row of transformed statistics for each text; shares are taken to the square root, counts to the logarithm."""
    out = np.zeros((len(texts), len(STATISTICS)))
    if not texts:
        return out
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    kind = _kinds()[points]
    share = np.bincount(owner * 5 + kind, minlength=5 * len(texts)).reshape(-1, 5).astype(float)
    signs = (kind[1:] == 4) & (points[1:] == points[:-1]) & (owner[1:] == owner[:-1])
    doubled = np.bincount(owner[1:][signs], minlength=len(texts))
    solid = np.maximum(share[:, 1:].sum(axis=1), 1)
    letters = np.maximum(share[:, 1] + share[:, 2], 1)
    for k, text in enumerate(texts):
        words = text.split()
        n = len(words)
        lines = [x for x in text.split("\n") if x]
        out[k, 0] = np.log1p(n)
        out[k, 1] = np.log1p(solid[k] / max(n, 1)) if n else 0
        out[k, 5] = np.log(len(set(words)) / n) if n else 0
        out[k, 6] = np.sqrt(sum(map(str.__eq__, words, words[1:])) / n) if n else 0
        out[k, 7] = np.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0
        out[k, 8] = np.sqrt(words.count("|") / n) if n else 0
    out[:, 2] = np.sqrt(share[:, 4] / solid)
    out[:, 3] = np.sqrt(share[:, 2] / letters)
    out[:, 4] = np.sqrt(share[:, 3] / solid)
    out[:, 9] = np.sqrt(doubled / solid)
    return out


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray  # of classes 0 and 1
    whiteners: np.ndarray  # inverted Cholesky factors
    log_scales: np.ndarray  # logarithms of the factors' determinants
    slope: float
    intercept: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0."""
        density = [-0.5 * (((x - self.means[c]) @ self.whiteners[c].T) ** 2).sum(axis=1) - self.log_scales[c] for c in (0, 1)]
        return density[1] - density[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return logistic.sigmoid(self.slope * self.squashed(x) + self.intercept)

    def squashed(self, x: np.ndarray) -> np.ndarray:
        """The difference on a scale on which far outliers don't rule the calibration."""
        d = self.difference(x)
        return np.sign(d) * np.log1p(np.abs(d))


def train(x: np.ndarray, y: np.ndarray, prior: float, shrink: float = 0.1, diagonal: float = 0.1) -> Discriminant:
    """Fit on statistics `x` and labels `y`, both labels present; label 1 has the share `prior`."""
    size = x.shape[1]
    means = np.stack([x[y == c].mean(axis=0) for c in (0, 1)])
    scatter = [(x[y == c] - means[c]).T @ (x[y == c] - means[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / max(len(y) - 2, 1)
    floor = np.diag(np.maximum(np.diag(pooled), 1e-4)) * 1e-2
    whiteners, scales = [], []
    for c in (0, 1):
        own = (1 - shrink) * scatter[c] / max((y == c).sum() - 1, 1) + shrink * pooled
        own = (1 - diagonal) * own + diagonal * np.diag(np.diag(own)) + floor
        factor = np.linalg.cholesky(own)
        whiteners.append(np.linalg.solve(factor, np.eye(size)))
        scales.append(np.log(np.diag(factor)).sum())
    raw = Discriminant(means, np.stack(whiteners), np.array(scales), 1.0, 0.0)
    weights, intercept = logistic.fit(raw.squashed(x)[:, None], y, prior)
    return Discriminant(means, raw.whiteners, raw.log_scales, max(float(weights[0]), 0.0), intercept)


def _measured(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(statistics([x or "" for x in batch.column(1).to_pylist()])), pa.list_(pa.float64()))], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Discriminant:
    """Fit on at most `per_class` labelled documents of each label; rows with a null id, text or label are skipped.

    With one label only (or none) the classifier returns that label's share, 1 or 0, for every text.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    prior = shares.get(1, 0) / max(sum(shares.values()), 1)
    size = len(STATISTICS)
    nothing = Discriminant(np.zeros((2, size)), np.stack([np.eye(size)] * 2), np.zeros(2), 0.0, 50.0 if prior == 1 else -50.0)
    if len(shares) < 2:
        return nothing
    chosen = F.broadcast(bounded(known, "id", "y", per_class).dropDuplicates(["id"]))  # 2 * per_class rows of 12 bytes
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(chosen, "id").select("y", "text")
    rows = map_arrow(sample, _measured, "y int, x array<double>").collect()
    y = np.array([r["y"] for r in rows])
    if len(set(y)) < 2:
        return nothing
    return train(np.array([r["x"] for r in rows]), y, prior)


def scorer(model: Discriminant):
    def score(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(model.probability(statistics([t or "" for t in texts])), pa.float64())]

    return score


def quality(df: DataFrame, text: Column, model: Discriminant) -> Column:
    """A struct (score); a null text is the empty one, whose statistics are all 0."""
    return text_column(df.sparkSession, scorer(model), "score double")(text)


def score(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted), a row for each input row, repeated ones too; other columns are not read.

    Null and empty texts have the score of the empty text's statistics; a score equal to the threshold predicts 1. An empty
    input gives no rows.
    """
    found = docs.select(F.col(id_col), quality(docs, F.col(text_col), model).alias("found"))
    return found.select(id_col, "found.score", (F.col("found.score") >= threshold).cast("int").alias("predicted"))
