"""Per-date information coefficients, with the policy for degenerate dates spelled out."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.guards import average_rank, correlation

#: Population deviation below which a date counts as constant.
FLAT = 1e-12
#: Runs of about as many rows that values are put in to be ordered.
RUNS = 256


def daily_ic(rows: DataFrame, pred: str, y: str, policy: str = "zero", method: str = "pearson", by: tuple[str, ...] = ("date",)) -> DataFrame:
    """``by..., ic``: one coefficient per date. ``policy`` for dates where a side is constant: ``zero`` counts them as 0,
    ``skip`` leaves them out. ``spearman`` correlates average ranks."""
    if policy not in ("zero", "skip"):
        raise ValueError(f"unknown policy {policy}")
    rows = rows.select(*by, F.col(pred).alias("_p"), F.col(y).alias("_y")).where("_p is not null and _y is not null")
    if method == "spearman":
        rows = rows.withColumns({"_p": average_rank("_p", *by), "_y": average_rank("_y", *by)})
    flat = (F.stddev_pop("_p") < FLAT) | (F.stddev_pop("_y") < FLAT)
    out = rows.groupBy(*by).agg(F.when(flat, F.lit(None)).otherwise(correlation("_p", "_y")).alias("ic"))
    return out.withColumn("ic", F.coalesce("ic", F.lit(0.0))) if policy == "zero" else out.where("ic is not null")


def mean_ic(rows: DataFrame, pred: str, y: str, method: str = "pearson", policy: str = "zero") -> DataFrame:
    """One row ``ic``: the mean over dates, 0 without dates."""
    return daily_ic(rows, pred, y, policy, method).agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("ic"))


def ic_series(rows: DataFrame, pred: str, y: str, method: str = "pearson", policy: str = "skip") -> DataFrame:
    """``date, ic`` in the order of dates."""
    return daily_ic(rows, pred, y, policy, method).orderBy("date")


def _runs(edges: list[float]):
    """How many of ``edges`` a value is above."""
    at = np.unique(np.array(edges, float))

    def place(values: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(at, values.to_numpy(zero_copy_only=False)).astype(np.int32))

    return F.arrow_udf(place, "int")


def _off_middle(counts: DataFrame, c: str, n: int) -> DataFrame:
    """``counts``, a row for each value of ``c`` with its number ``_n`` and its run ``_run``, with ``_r``: the average rank of the
    value among all ``n`` rows, less the mean of all ranks. Runs are put in order each by itself."""
    sizes = sorted((r["_run"], r["_all"]) for r in counts.groupBy("_run").agg(F.sum("_n").alias("_all")).collect())  # 256 rows
    before, at = [0] * RUNS, 0
    for run, size in sizes:
        before[run], at = at, at + size
    within = F.sum("_n").over(Window.partitionBy("_run").orderBy(c)) - F.col("_n")
    start = F.element_at(F.array(*(F.lit(b).cast("long") for b in before)), F.col("_run") + 1)
    return counts.withColumn("_r", start + within + (F.col("_n") - n) / 2)


def _rank_corr(rows: DataFrame) -> float:
    """Correlation of the average ranks of ``_p`` and ``_y``, both known; 0 where one is constant. A row meets the rank of its
    ``_p`` and is added up by its ``_y`` at once, so only distinct values are kept and ordered. Ranks are counted from their
    mean, so the sums lose no digits however many rows there are."""
    shares = F.array(*(F.lit(k / RUNS) for k in range(1, RUNS)))
    about = rows.agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(c, shares, 10_000).alias(c) for c in ("_p", "_y"))).first()
    if not about["n"]:
        return 0.0
    firsts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_run", _runs(about["_p"])(F.col("_p").cast("double"))).persist(StorageLevel.MEMORY_AND_DISK)
    ranks = _off_middle(firsts, "_p", about["n"]).select("_p", "_r")
    met = rows.join(ranks, "_p").groupBy("_y").agg(F.count(F.lit(1)).alias("_n"), F.sum("_r").alias("_rp"), F.sum(F.col("_r") * F.col("_r")).alias("_pp"))
    met = met.withColumn("_run", _runs(about["_y"])(F.col("_y").cast("double"))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sums = _off_middle(met, "_y", about["n"]).agg(F.sum("_pp").alias("pp"), F.sum(F.col("_r") * F.col("_r") * F.col("_n")).alias("yy"), F.sum(F.col("_r") * F.col("_rp")).alias("py")).first()
    finally:
        met.unpersist()
        firsts.unpersist()
    return sums.py / math.sqrt(sums.pp) / math.sqrt(sums.yy) if sums.pp and sums.yy else 0.0


def global_corr(rows: DataFrame, pred: str, y: str, method: str = "pearson") -> DataFrame:
    """One row ``ic`` over all rows, whatever their date. By rank, ties are counted per value and only distinct values
    are ordered, each with the number of rows below it."""
    if method == "spearman":
        ic = _rank_corr(rows.select(F.col(pred).alias("_p"), F.col(y).alias("_y")).where("_p is not null and _y is not null"))
        return rows.sparkSession.createDataFrame([(ic,)], "ic double")
    return rows.agg(F.coalesce(F.when((F.stddev_pop(pred) < FLAT) | (F.stddev_pop(y) < FLAT), F.lit(0.0)).otherwise(correlation(pred, y)), F.lit(0.0)).alias("ic"))


def unpivoted(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep..., feature, value``: one row per column, so one aggregation serves them all. Rows that lie together by a key
    among ``keep`` still do, so what groups by it needs no shuffle."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns)))
    return rows.select(*keep, cells.alias("_cell")).select(*keep, "_cell.feature", "_cell.value")


def drawn(seed: int) -> Column:
    """A number from 0 to 1 that hangs on the date and ``seed`` alone."""
    return F.pmod(F.xxhash64("date", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0


def sampled_dates(rows: DataFrame, batch: int, seed: int) -> DataFrame:
    """Rows of a Bernoulli sample of dates with ``batch`` expected; the draw hangs on seed and date alone."""
    n = rows.select(F.count_distinct("date")).first()[0]
    return rows.where(drawn(seed) < (batch / n if n else 1.0))
