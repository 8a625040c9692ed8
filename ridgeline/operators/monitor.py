"""Prediction log, drift test and re-mining policy."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.guards import nonzero
from ridgeline.operators.backtest import rebalance_rows
from ridgeline.operators.ic import daily_ic
from ridgeline.schema import HORIZON


def normal_cdf(z: Column) -> Column:
    """The normal distribution function as an expression, to the precision of doubles: up to 7 deviations from the mean by
    its power series, whose terms all have one sign, beyond by the asymptotic expansion of the tail (relative error below
    1e-6 of a tail below 2e-12)."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) / (2 * math.pi) ** 0.5
    start = F.struct(x.alias("term"), x.alias("sum"))

    def step(held: Column, k: Column) -> Column:
        term = held["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (held["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(150)), start, step, lambda held: held["sum"])
    far = density / x * (1 - 1 / (x * x) + 3 / F.pow(x, 4) - 15 / F.pow(x, 6) + 105 / F.pow(x, 8))
    tail = F.when(x < 7, 0.5 - density * series).otherwise(far)
    return F.when(z < 0, tail).when(z.isNotNull(), 1 - tail)


def record(scored: DataFrame, date: Column) -> DataFrame:
    """Log rows for a scoring run: outcome unknown."""
    return scored.select(date.alias("predict_date"), "ticker", "alpha", F.lit(None).cast("double").alias("realized_fwd_ret"), F.lit(False).alias("resolved"))


def resolve(log: DataFrame, realized: DataFrame) -> DataFrame:
    """Fill outcomes of unresolved rows from ``date, ticker, fwd_ret``; resolved rows and unknown outcomes stay as they are."""
    new = realized.select(F.col("date").alias("predict_date"), "ticker", F.when(~F.isnan("fwd_ret"), F.col("fwd_ret")).alias("_new"))
    fill = F.col("_new").isNotNull() & ~F.col("resolved")
    return log.join(new, ["predict_date", "ticker"], "left").select(
        "predict_date", "ticker", "alpha", F.when(fill, F.col("_new")).otherwise(F.col("realized_fwd_ret")).alias("realized_fwd_ret"), (F.col("resolved") | fill).alias("resolved")
    )


def weekly_ic(log: DataFrame) -> DataFrame:
    """``predict_date, ic`` of resolved rows, without degenerate dates."""
    return daily_ic(log.where("resolved"), "alpha", "realized_fwd_ret", policy="skip", by=("predict_date",))


def period_ic(scored: DataFrame, horizon: int = HORIZON) -> DataFrame:
    return daily_ic(rebalance_rows(scored, horizon), "alpha", "fwd_ret", policy="skip")


def baseline(ics: DataFrame) -> DataFrame:
    return ics.agg(F.avg("ic").alias("mean"), F.stddev_pop("ic").alias("std"))


def drift_timeline(ics: DataFrame, mean: Column | float, std: Column | float, window: int = 8, least: int = 3, level: float = 0.10) -> DataFrame:
    """The drift test as of every date of ``date, ic``: trailing mean against the baseline (numbers, or columns of
    ``ics``), one-sided. Fewer than ``least`` dates so far are not enough. One row per period, so one partition orders
    them."""
    w = Window.orderBy("date").rowsBetween(1 - window, 0)
    mean, std = (x if isinstance(x, Column) else F.lit(x) for x in (mean, std))
    rows = ics.select("date", "ic", mean.alias("_mean"), std.alias("_std"), F.row_number().over(Window.orderBy("date")).alias("as_of"), F.count("ic").over(w).alias("n_weeks"), F.avg("ic").over(w).alias("_m"))
    return drift_status(rows, least, level)


def drift_status(rows: DataFrame, least: int = 3, level: float = 0.10) -> DataFrame:
    """The one-sided test of trailing means ``as_of, date, n_weeks, _m`` against ``_mean, _std``, for tables and streams."""
    enough = F.col("n_weeks") >= least
    z = F.when(enough, (F.col("_m") - F.col("_mean")) / nonzero(F.col("_std") / F.sqrt("n_weeks")))
    rows = rows.withColumn("z_score", z).withColumn("p_value", normal_cdf(F.col("z_score")))
    status = F.when(~enough, "insufficient_data").when(F.col("p_value") < level, "drift_flagged").otherwise("normal")
    return rows.select("as_of", "date", status.alias("status"), "n_weeks", F.when(enough, F.col("_m")).alias("recent_mean_ic"), F.col("_mean").alias("baseline_mean_ic"), "z_score", "p_value")


def replay(scored: DataFrame, horizon: int = HORIZON, window: int = 8) -> DataFrame:
    """Every state of the monitor over a scored history, from the first full window on; the baseline is that history's own."""
    every = Window.partitionBy()  # one row a period
    ics = period_ic(scored, horizon).withColumns({"_all": F.avg("ic").over(every), "_spread": F.stddev_pop("ic").over(every)})
    return drift_timeline(ics, F.col("_all"), F.col("_spread"), window).where(F.col("as_of") >= window)


def should_remine(last: str, status: str | None, now: datetime, most_days: int = 90) -> tuple[bool, list[str], int]:
    """Whether to search anew, why, and how many days have gone by."""
    days = (now - datetime.fromisoformat(last)).days
    reasons = [f"stale: {days} days, at most {most_days}"] if days >= most_days else []
    if status == "drift_flagged":
        reasons.append("drift flagged")
    return bool(reasons), reasons, days


def remine_column(days: Column, status: Column, most_days: int = 90) -> Column:
    return (days >= most_days) | (F.coalesce(status, F.lit("")) == "drift_flagged")


def remine_reasons(days: Column, status: Column, most_days: int = 90) -> Column:
    """The reasons of ``should_remine`` as an array column; empty where nothing calls for it."""
    stale = F.when(days >= most_days, F.concat(F.lit("stale: "), days.cast("string"), F.lit(f" days, at most {most_days}")))
    drift = F.when(F.coalesce(status, F.lit("")) == "drift_flagged", F.lit("drift flagged"))
    return F.array_compact(F.array(stale, drift))
