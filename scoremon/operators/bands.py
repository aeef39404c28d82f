"""Confidence bands around observed or predicted rates.

Wilson and Vasicek are column expressions.  Beta quantiles are not among
Spark's functions; they run as an Arrow function over the monthly rows, never
over applications.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(32)
_PANELS = 64


class _Beta:
    """Beta distribution in the angle t with x = sin(t)^2, where its density has no poles.

    The density is taken relative to its peak through small differences of the
    angle, so the same quadrature serves all sizes of the parameters (1/2 and up).
    """

    def __init__(self, a: float, b: float):
        self.up, self.down = 2 * a - 1, 2 * b - 1
        if self.up < 0 or self.down < 0:
            raise ValueError("parameters are 1/2 and up")
        self.peak = math.atan2(math.sqrt(self.up), math.sqrt(self.down)) if self.up + self.down else math.pi / 4
        width = 40 / math.sqrt(4 * (a + b))
        self.edges = np.linspace(max(0.0, self.peak - width), min(math.pi / 2, self.peak + width), _PANELS + 1)
        self.sums = np.concatenate([[0.0], np.cumsum([
            self._integral(s, e) for s, e in zip(self.edges[:-1], self.edges[1:], strict=True)
        ])])

    def _density(self, t: np.ndarray) -> np.ndarray:
        d = t - self.peak
        bend = -2 * np.sin(d / 2) ** 2
        out = np.zeros_like(t)
        with np.errstate(divide="ignore"):
            if self.up:
                out = out + self.up * np.log1p(np.maximum(bend + np.sin(d) / math.tan(self.peak), -1.0))
            if self.down:
                out = out + self.down * np.log1p(np.maximum(bend - np.sin(d) * math.tan(self.peak), -1.0))
        return np.exp(out)

    def _integral(self, start: float, end: float) -> float:
        half = (end - start) / 2
        return half * float(_WEIGHTS @ self._density(start + half * (_NODES + 1)))

    def cdf(self, x: float) -> float:
        t = math.asin(math.sqrt(min(max(x, 0.0), 1.0)))
        if t <= self.edges[0]:
            return 0.0
        if t >= self.edges[-1]:
            return 1.0
        i = int(np.searchsorted(self.edges, t, side="right")) - 1
        return (self.sums[i] + self._integral(self.edges[i], t)) / self.sums[-1]

    def quantile(self, p: float) -> float:
        goal = p * self.sums[-1]
        i = min(max(int(np.searchsorted(self.sums, goal, side="right")) - 1, 0), _PANELS - 1)
        lo, hi = float(self.edges[i]), float(self.edges[i + 1])
        start, rest = lo, goal - self.sums[i]
        for _ in range(100):
            mid = (lo + hi) / 2
            if mid in (lo, hi):
                break
            lo, hi = (mid, hi) if self._integral(start, mid) < rest else (lo, mid)
        return math.sin((lo + hi) / 2) ** 2


def beta_cdf(a: float, b: float, x: float) -> float:
    return _Beta(a, b).cdf(x)


def beta_quantile(p: float, a: float, b: float) -> float:
    return _Beta(a, b).quantile(p)


def _once(x: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function: 1/2 + density * (x + x^3/3 + x^5/15 + ...)."""

    def series(v: Column) -> Column:
        total = F.aggregate(
            F.sequence(F.lit(1), F.lit(200)),
            F.struct(v.alias("term"), v.alias("total")),
            lambda acc, k: _once(
                acc["term"] * v * v / (2 * k + 1),
                lambda t: F.struct(t.alias("term"), (acc["total"] + t).alias("total")),
            ),
            lambda acc: acc["total"],
        )
        return F.lit(0.5) + total * F.exp(-v * v / 2) / math.sqrt(2 * math.pi)

    return _once(x, series)


def normal_quantile(p: Column) -> Column:
    """Its inverse for 0 < p < 1, by bisection between -9 and 9."""

    def search(q: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(60)),
            F.struct(F.lit(0.0).alias("at"), F.lit(4.5).alias("step")),
            lambda acc, _: F.struct(
                (acc["at"] + F.when(normal_cdf(acc["at"]) < q, acc["step"]).otherwise(-acc["step"])).alias("at"),
                (acc["step"] / 2).alias("step"),
            ),
            lambda acc: acc["at"],
        )

    return F.when(p.isNotNull(), _once(p, search))


def vasicek_quantile(pd_: Column, rho: float, q: float) -> Column:
    """Default rate at quantile ``q`` of the one-factor model; 0 and 1 stay as they are."""
    z = NormalDist().inv_cdf(q)
    inner = (normal_quantile(pd_) + math.sqrt(rho) * z) / math.sqrt(1.0 - rho)
    return F.when((pd_ <= 0) | (pd_ >= 1), pd_).otherwise(normal_cdf(inner))


def _inside(df: DataFrame, rate: str) -> DataFrame:
    return df.withColumn("inside", F.col(rate).between(F.col("lower"), F.col("upper")))


def bands_wilson(df: DataFrame, count: str, events: str, rate: str, level: float = 0.95) -> DataFrame:
    """Wilson score interval of ``events / count``; ``inside`` tests ``rate``."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    n = F.nullif(F.col(count).cast("double"), F.lit(0.0))
    p = F.col(events).cast("double") / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return _inside(df.withColumns({"lower": centre - half, "upper": centre + half}), rate)


def bands_jeffreys(df: DataFrame, count: str, events: str, rate: str, level: float = 0.95) -> DataFrame:
    """Jeffreys interval: quantiles of Beta(events + 1/2, count - events + 1/2)."""
    tail = (1 - level) / 2

    @F.pandas_udf("lower double, upper double")
    def limits(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for n, d in parts:
            rows = [
                (None, None) if not k > 0
                else tuple(beta_quantile(q, e + 0.5, k - e + 0.5) for q in (tail, 1 - tail))
                for k, e in zip(n, d)
            ]
            yield pd.DataFrame(rows, columns=["lower", "upper"], dtype="float64")

    out = df.withColumn("_band", limits(F.col(count).cast("double"), F.col(events).cast("double")))
    return _inside(out.withColumns({"lower": F.col("_band.lower"), "upper": F.col("_band.upper")}).drop("_band"), rate)


def bands_vasicek(df: DataFrame, pd_col: str, rate: str, rho: float = 0.15, level: float = 0.95) -> DataFrame:
    """One-factor (Vasicek) band around the predicted rate ``pd_col``."""
    tail = (1 - level) / 2
    p = F.col(pd_col).cast("double")
    limits = {"lower": vasicek_quantile(p, rho, tail), "upper": vasicek_quantile(p, rho, 1 - tail)}
    return _inside(df.withColumns(limits), rate)


def add_bands(
    df: DataFrame, kind: str, count: str, events: str, predicted: str, observed: str, level: float = 0.95,
    rho: float = 0.15,
) -> DataFrame:
    """Band by name: ``jeffreys`` and ``wilson`` lie around the observed rate and
    test the predicted one, ``vasicek`` the other way round."""
    if kind == "jeffreys":
        return bands_jeffreys(df, count, events, predicted, level)
    if kind == "wilson":
        return bands_wilson(df, count, events, predicted, level)
    if kind == "vasicek":
        return bands_vasicek(df, predicted, observed, rho, level)
    raise ValueError("kind is jeffreys, wilson or vasicek")
