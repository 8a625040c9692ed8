"""Baseline models with one contract: ``fit_predict(train, test, features) -> (test with alpha, feature/importance)``."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.guards import complete
from ridgeline.operators.boosting import boost
from ridgeline.operators.combine import Gram, descend, descend_together, objective, weighted, wide_grams
from ridgeline.operators.folds import Fold, test_rows

#: Mixing ratios, folds and path length of the elastic-net search.
RATIOS, CV_FOLDS, PATH, LEAST = (0.1, 0.5, 0.9, 1.0), 3, 100, 1e-3


def training_parts(rows: DataFrame, cutoffs: list, folds: int) -> DataFrame:
    """``_part``: for several training sets at once, the rows up to each of ``cutoffs``, which of ``folds`` equal runs of
    that set in (ticker, date) order a row is in, as digits of one number (0: not in the set). One window over the tickers
    serves all sets, since each has the first rows of a ticker; only per-ticker counts are ordered globally."""
    within = [F.col("date") <= F.lit(c) if c is not None else F.lit(True) for c in cutoffs]
    names = range(len(cutoffs))
    counts = rows.groupBy("ticker").agg(*(F.count(F.when(w, 1)).alias(f"_n{k}") for k, w in enumerate(within)))
    order, every = Window.orderBy("ticker"), Window.partitionBy()  # a row per ticker
    before = counts.select("ticker", *(c for k in names for c in ((F.sum(f"_n{k}").over(order) - F.col(f"_n{k}")).alias(f"_before{k}"), F.sum(f"_n{k}").over(every).alias(f"_all{k}"))))
    place = F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1
    digits = [F.when(w, F.least(F.floor((F.col(f"_before{k}") + place) * folds / F.col(f"_all{k}")), F.lit(folds - 1)) + 1).otherwise(0) for k, w in enumerate(within)]
    part = sum((d * (folds + 1) ** k for k, d in enumerate(digits)), F.lit(0)).cast("long")
    return rows.join(before, "ticker").withColumn("_part", part).drop(*(f"_{c}{k}" for k in names for c in ("before", "all")))


def _centred(g: Gram, k: int) -> tuple[Gram, np.ndarray]:
    """Gram of centred columns from one whose last column is the constant 1, and the means (target's last)."""
    means = np.append(g.xx[k, :k], g.xy[k]) / max(1, g.n)
    xx = g.xx[:k, :k] - g.n * np.outer(means[:k], means[:k])
    return Gram(g.n, xx, g.xy[:k] - g.n * means[:k] * means[k], g.yy - g.n * means[k] ** 2), means


class Fit(NamedTuple):
    weights: np.ndarray
    intercept: float
    penalty: float
    ratio: float


def elastic_nets(rows: DataFrame, cutoffs: list, features: list[str], y: str = "fwd_ret") -> list[Fit]:
    """An elastic net on the rows up to each of ``cutoffs`` (None: all), penalty and ratio chosen by cross-validation over
    contiguous runs of the rows. The Gram matrices of all runs of all training sets come from one pass, and all problems walk
    down their paths together."""
    k = len(features)
    rows = training_parts(complete(rows, [*features, y]), cutoffs, CV_FOLDS).withColumn("_one", F.lit(1.0))
    none = Gram(0, np.zeros((k + 1, k + 1)), np.zeros(k + 1), 0.0)
    sums = [[none] * CV_FOLDS for _ in cutoffs]
    for part, g in wide_grams(rows, [*features, "_one"], y, "_part").items():
        for c in range(len(cutoffs)):
            if digit := part // (CV_FOLDS + 1) ** c % (CV_FOLDS + 1):
                sums[c][digit - 1] = sums[c][digit - 1] + g
    sets = []
    for own in sums:
        parts = [p for p in own if p.n]
        whole = sum(parts, none)
        centred, means = _centred(whole, k)
        fits = [_centred(Gram(whole.n - p.n, whole.xx - p.xx, whole.xy - p.xy, whole.yy - p.yy), k) for p in parts]
        top = {r: max(np.abs(centred.xy).max() / max(1, centred.n) / r, 1e-12) for r in RATIOS}
        sets.append((parts, centred, means, fits, {r: np.geomspace(t, t * LEAST, PATH) for r, t in top.items()}))
    cases = [(c, r, f) for c, own in enumerate(sets) for r in RATIOS for f in range(len(own[0]))]
    w, errors = np.zeros((len(cases), k)), [{r: np.zeros(PATH) for r in RATIOS} for _ in sets]
    for a in range(PATH if cases else 0):
        w = descend_together([sets[c][3][f][0] for c, _, f in cases], np.array([sets[c][4][r][a] for c, r, _ in cases]), np.array([r for _, r, _ in cases]), 5000, 1e-4, w)
        for row, (c, r, f) in zip(w, cases, strict=True):
            mu = sets[c][3][f][1]
            errors[c][r][a] += objective(sets[c][0][f], np.append(row, mu[k] - mu[:k] @ row), 0.0) * 2
    out = []
    for (_, centred, means, _, paths), error in zip(sets, errors, strict=True):
        best = min((error[r].min(), paths[r][error[r].argmin()], r) for r in RATIOS)
        own = descend(centred, best[1], best[2], 5000, 1e-8 * max(centred.yy / max(1, centred.n), 1e-24) ** 0.5)
        out.append(Fit(own, float(means[k] - means[:k] @ own), float(best[1]), best[2]))
    return out


def elastic_net(train: DataFrame, features: list[str], y: str = "fwd_ret") -> Fit:
    """The fit of ``elastic_nets`` on all rows."""
    return elastic_nets(train, [None], features, y)[0]


def _importance(df: DataFrame, features: list[str], values) -> DataFrame:
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)], "feature string, importance double")


def elastic_net_fit_predict(train: DataFrame, test: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    fit = elastic_net(train, features)
    return weighted(test, features, fit.weights).withColumn("alpha", F.col("alpha") + F.lit(fit.intercept)), _importance(train, features, fit.weights)


def elastic_net_folds(rows: DataFrame, folds: list[Fold], features: list[str]) -> tuple[DataFrame, DataFrame]:
    """The test rows of all folds with ``fold`` and ``alpha``, and ``fold, feature, importance``: all folds are fitted together
    and scored by one expression."""
    fits = elastic_nets(rows, [f.train_cutoff for f in folds], features)
    place = F.array_position(F.array(*(F.lit(f.fold) for f in folds)), F.col("fold")).cast("int")

    def of_fold(values) -> Column:
        return F.element_at(F.array(*(F.lit(float(v)) for v in values)), place)

    alpha = of_fold([f.intercept for f in fits])
    for k, c in enumerate(features):
        alpha = alpha + F.col(c) * of_fold([f.weights[k] for f in fits])
    own = [(f.fold, c, float(v)) for f, fit in zip(folds, fits, strict=True) for c, v in zip(features, fit.weights, strict=True)]
    return test_rows(rows, folds).withColumn("alpha", alpha), rows.sparkSession.createDataFrame(own, "fold int, feature string, importance double")


def boosted_trees_fit_predict(train: DataFrame, test: DataFrame, features: list[str], trees: int = 200, importance: str = "split") -> tuple[DataFrame, DataFrame]:
    """Boosted trees of depth 4 at rate 0.05 on draws of 80 % of the features; importance counts the cuts on each feature, or
    with ``gain`` adds up what they gain. Rows of ``test`` with an unknown feature are left out."""
    model = boost(complete(train, features), features, trees=trees)
    return complete(test, features).withColumn("alpha", model.alpha()), _importance(train, features, model.importance(importance))


FIT_PREDICT = {"elasticnet": elastic_net_fit_predict, "boosted_trees": boosted_trees_fit_predict}
#: Models that fit all folds at once.
FOLDS_FIT_PREDICT = {"elasticnet": elastic_net_folds}
