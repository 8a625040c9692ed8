"""Expanding-window folds and time splits. Only the distinct dates reach the driver."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fold(NamedTuple):
    fold: int
    train_cutoff: object
    test_start: object
    test_end: object


def distinct_dates(rows: DataFrame) -> list:
    return [r.date for r in rows.select("date").distinct().orderBy("date").collect()]


def fold_bounds(n: int, folds: int, least: float) -> list[int]:
    first = int(n * least)
    step = (n - first) / folds
    return [int(first + k * step) for k in range(folds)] + [n]


def make_folds(dates: list, folds: int = 5, least: float = 0.4, embargo: int = 0) -> list[Fold]:
    """Folds over sorted dates. Training ends ``embargo`` dates before the last date ahead of the test; with 0 the
    labels of the last training dates reach into the test window, with the label's horizon they don't."""
    bounds = fold_bounds(len(dates), folds, least)
    out = []
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if a < b and a - 1 - embargo >= 0:
            out.append(Fold(k + 1, dates[a - 1 - embargo], dates[a], dates[b - 1]))
    return out


def fold_frame(spark, folds: list[Fold]) -> DataFrame:
    return spark.createDataFrame([tuple(f) for f in folds], "fold int, train_cutoff date, test_start date, test_end date")


def test_rows(rows: DataFrame, folds: list[Fold]) -> DataFrame:
    """Rows with the fold whose test window holds their date; other rows go."""
    which = F.lit(None).cast("int")
    for f in folds:
        which = F.when(F.col("date").between(F.lit(f.test_start), F.lit(f.test_end)), f.fold).otherwise(which)
    return rows.withColumn("fold", which).where("fold is not null")


test_rows.__test__ = False


def split(rows: DataFrame, share: float, embargo: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training before and test from the cut-off date on; a share of 0 or less trains on everything."""
    dates = distinct_dates(rows)
    if share <= 0 or not dates:
        return rows, rows.limit(0)
    at = int(len(dates) * (1 - share))
    train = rows.where(F.col("date") < F.lit(dates[max(0, at - embargo)]))
    return train, rows.where(F.col("date") >= F.lit(dates[at]))
