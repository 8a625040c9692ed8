"""Probabilistic and deflated Sharpe ratios. Moments come from one aggregation; the rest is a handful of numbers."""

from __future__ import annotations

import math
from statistics import NormalDist, stdev
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.schema import HORIZON, TRADING_DAYS

#: Fixed value: Euler's constant as the method's authors round it.
EULER = 0.5772156649
_NORMAL = NormalDist()


def moments(returns: DataFrame, column: str = "ret") -> DataFrame:
    """``n, mean, sd, sharpe, skew, kurtosis``: sample deviation, biased skewness, kurtosis with 3 for the normal."""
    c = F.col(column)
    return returns.where(c.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.try_divide(F.avg(c), F.stddev_samp(c)).alias("sharpe"), F.skewness(c).alias("skew"), (F.kurtosis(c) + 3).alias("kurtosis")
    )


def probabilistic_sharpe(n: int, sharpe: float, skew: float, kurtosis: float, benchmark: float = 0.0) -> float:
    spread = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe
    return _NORMAL.cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(spread))


def expected_best(trials: list[float]) -> float:
    """The Sharpe ratio that the best of as many skill-less trials would show, given how far these lie apart."""
    n = len(trials)
    if n < 2:
        raise ValueError("needs two trials or more")
    near, far = _NORMAL.inv_cdf(1 - 1 / n), _NORMAL.inv_cdf(1 - 1 / (n * math.e))
    return stdev(trials) * ((1 - EULER) * near + EULER * far)


class Deflated(NamedTuple):
    n_trials: int
    sharpe: float
    expected_best: float
    deflated: float


def deflated_sharpe(returns: DataFrame, trials: list[float], column: str = "ret") -> Deflated:
    m, bar = moments(returns, column).first(), expected_best(trials)
    return Deflated(len(trials), m.sharpe, bar, probabilistic_sharpe(m.n, m.sharpe, m.skew, m.kurtosis, bar))


def per_period_trials(folds: DataFrame) -> DataFrame:
    """``trial, sharpe`` per period from ``trial, sharpe`` a year and fold: the mean over folds with a figure."""
    known = F.col("sharpe").isNotNull() & ~F.isnan("sharpe")
    return folds.where(known).groupBy("trial").agg((F.avg("sharpe") / math.sqrt(TRADING_DAYS / HORIZON)).alias("sharpe"))


def read_trials(spark, paths: dict[str, str]) -> DataFrame:
    """``trial, sharpe`` rows of fold results in JSON files, one file per named trial: the list is explicit."""
    out = spark.createDataFrame([], "trial string, sharpe double")
    for name, path in paths.items():
        rows = spark.read.option("multiLine", True).schema("sharpe double").json(path)
        out = out.unionByName(rows.select(F.lit(name).alias("trial"), "sharpe"))
    return out
