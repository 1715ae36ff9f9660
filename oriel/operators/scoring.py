"""Models that score by column expressions: PREDICTION, PREDICTION_PROBABILITY, PREDICTION_SET and PREDICTION_DETAILS.

Fitting sums products of features over all rows, a row of sums for each pass, which Spark adds up before anything is
shuffled; the driver solves equations of as many unknowns as there are features.  What is fitted are plain numbers, so a model is stored as JSON and scores
any table with those columns inside whole-stage code.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _features(features: dict[str, str]) -> list[Column]:
    """The constant, then each feature; a null counts as that feature's missing value, 0 after scaling."""
    return [F.lit(1.0), *[F.expr(e).cast("double") for e in features.values()]]


@dataclass(frozen=True)
class LinearModel:
    """Coefficients over scaled features; ``logistic`` models give the probability of class 1."""

    features: dict[str, str]
    means: list[float]
    scales: list[float]
    weights: list[float]
    logistic: bool

    def _terms(self) -> dict[str, Column]:
        """What each feature adds, by name."""
        columns = _features(self.features)[1:]
        return {n: F.coalesce((c - F.lit(m)) / F.lit(s), F.lit(0.0)) * F.lit(w) for n, c, m, s, w in zip(self.features, columns, self.means, self.scales, self.weights[1:])}

    def linear(self) -> Column:
        out = F.lit(self.weights[0])
        for term in self._terms().values():
            out = out + term
        return out

    def probability(self, of: int = 1) -> Column:
        """PREDICTION_PROBABILITY(model, class)."""
        if not self.logistic:
            raise ValueError("a regression has no probabilities")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-self.linear()))
        return p if of == 1 else F.lit(1.0) - p

    def prediction(self) -> Column:
        """PREDICTION(model): the likelier class, or a regression's value."""
        return F.when(self.linear() >= 0, F.lit(1)).otherwise(F.lit(0)) if self.logistic else self.linear()

    def prediction_set(self) -> Column:
        """PREDICTION_SET(model): classes with their probabilities, the likelier first."""
        p = self.probability()
        both = F.array(F.struct(F.lit(1).alias("prediction"), p.alias("probability")), F.struct(F.lit(0).alias("prediction"), (F.lit(1.0) - p).alias("probability")))
        return F.when(p >= 0.5, both).otherwise(F.reverse(both))

    def details(self, top: int = 5) -> Column:
        """PREDICTION_DETAILS(model): the features that move the prediction most, with what they add."""
        parts = F.array(*[F.struct(F.abs(t).alias("size"), F.lit(n).alias("feature"), t.alias("adds")) for n, t in self._terms().items()])
        return F.transform(F.slice(F.sort_array(parts, asc=False), 1, top), lambda x: F.struct(x["feature"].alias("feature"), x["adds"].alias("adds")))

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> LinearModel:
        return cls(**json.loads(text))


def _scaling(rows: DataFrame, features: dict[str, str]) -> tuple[list[float], list[float]]:
    aggs = [f(c) for c in _features(features)[1:] for f in (F.avg, F.stddev_pop)]
    got = [float(x or 0.0) for x in rows.agg(*aggs).first()]
    return got[::2], [s if s > 0 else 1.0 for s in got[1::2]]


def _scaled(features: dict[str, str], means: list[float], scales: list[float]) -> list[Column]:
    return [F.lit(1.0), *[F.coalesce((c - F.lit(m)) / F.lit(s), F.lit(0.0)) for c, m, s in zip(_features(features)[1:], means, scales)]]


def fit_linear(df: DataFrame, features: dict[str, str], target: str) -> LinearModel:
    """Least squares; rows with a null target take no part."""
    rows = df.where(F.expr(target).isNotNull())
    means, scales = _scaling(rows, features)
    x, y = _scaled(features, means, scales), F.expr(target).cast("double")
    a, b = _products(rows, x, F.lit(1.0), y)
    return LinearModel(features, means, scales, np.linalg.lstsq(a, b, rcond=None)[0].tolist(), False)


def fit_logistic(df: DataFrame, features: dict[str, str], target: str, rounds: int = 12, ridge: float = 1e-3, near: float = 1e-8) -> LinearModel:
    """Newton's method for the logistic loss with a small ridge, one pass over the rows a round; the target is 0 or 1.

    It ends when a step is ``near`` nothing, or after ``rounds``.
    """
    rows = df.where(F.expr(target).isNotNull())
    means, scales = _scaling(rows, features)
    x, y = _scaled(features, means, scales), F.expr(target).cast("double")
    w = np.zeros(len(x))
    keep = np.diag([0.0] + [ridge] * (len(x) - 1))
    n = max(rows.count(), 1)
    for _ in range(rounds):
        z = F.lit(0.0)
        for c, v in zip(x, w.tolist()):
            z = z + c * F.lit(v)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        a, b = _products(rows, x, p * (F.lit(1.0) - p), y - p, weighted_target=False)
        step = np.linalg.lstsq(a / n + keep + 1e-12 * np.eye(len(x)), b / n - keep @ w, rcond=None)[0]
        w = w + step
        if np.abs(step).max() < near:
            break
    return LinearModel(features, means, scales, w.tolist(), True)


def _products(rows: DataFrame, x: list[Column], weight: Column, y: Column, weighted_target: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(sums of weight * x_i * x_j, sums of x_i * y): one row of sums."""
    k = len(x)
    named = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], weight.alias("w"), (weight * y if weighted_target else y).alias("y"))
    cells = [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i, k)]
    got = [float(v or 0.0) for v in named.agg(*cells, *[F.sum(F.col("y") * F.col(f"x{i}")) for i in range(k)]).first()]
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = got[: k * (k + 1) // 2]
    return a + np.triu(a, 1).T, np.array(got[k * (k + 1) // 2 :])
