"""Long-short backtests on every ``horizon``-th date, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.guards import nonzero
from ridgeline.operators.quantiles import beside, exact_edges
from ridgeline.schema import BUCKETS, COST_BPS, HORIZON, MIN_NAMES, TRADING_DAYS


def rebalance_rows(rows: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Rows on every ``horizon``-th distinct date; the numbering runs over the distinct dates, not over the rows."""
    dates = rows.select("date").distinct().withColumn("_k", F.row_number().over(Window.orderBy("date")) - 1)
    return rows.join(F.broadcast(dates.where(F.col("_k") % horizon == 0).select("date")), "date", "left_semi")


#: Rows of a group that one task may order; wider groups have their edges from range counts.
WIDE = 1_000_000


def _fractions(n: int) -> list[float]:
    return [*(k * (1 / n) for k in range(n)), 1.0]


def _edges(n: int) -> Column:
    return F.percentile("alpha", F.array(*map(F.lit, _fractions(n))))


def decile_periods(rows: DataFrame, buckets: int = BUCKETS, cost_bps: float = COST_BPS, horizon: int = HORIZON, neutral: bool = False, wide: int = WIDE) -> DataFrame:
    """``date, ret, long_only``: mean return of the top less the bottom quantile bucket, after costs.

    Bucket edges are exact linear quantiles; equal edges merge. Groups (dates, or sectors of a date) of fewer than two
    rows a bucket sit out. A date whose alphas are all equal has no buckets and a null return. Groups of more than ``wide``
    rows are not put in order in one task: their edges, the same ones, come from counts of ranges.
    """
    cost = cost_bps / 10_000
    by = ["date", "sector"] if neutral else ["date"]
    group = Window.partitionBy(*by)
    day = rebalance_rows(rows, horizon)
    sizes = day.groupBy(*by).count()
    about = sizes.agg(F.max("count").alias("most"), F.count(F.lit(1)).alias("groups")).first()
    if (about.most or 0) > wide:
        met = beside(day, exact_edges(day, by, "alpha", _fractions(buckets)), by, about.groups).withColumn("_e", F.array_distinct("_e"))
    else:
        met = day.withColumns({"_n": F.count(F.lit(1)).over(group), "_e": F.array_distinct(_edges(buckets).over(group))})
    met = met.where(F.col("_n") >= 2 * buckets)
    some = F.size("_e") >= 2
    top = some & (F.col("alpha") > F.element_at("_e", F.when(some, F.size("_e") - 1).otherwise(1)))
    low = some & (F.col("alpha") <= F.element_at("_e", F.when(some, 2).otherwise(1)))
    both = met.groupBy("date").agg(F.avg(F.when(top, F.col("fwd_ret"))).alias("_t"), F.avg(F.when(low, F.col("fwd_ret"))).alias("_b"))
    return both.select("date", (F.col("_t") - F.col("_b") - 4 * cost).alias("ret"), (F.col("_t") - 2 * cost).alias("long_only"))


def weighted_periods(rows: DataFrame, cost_bps: float = COST_BPS, horizon: int = HORIZON, neutral: bool = False, least: int = MIN_NAMES) -> DataFrame:
    """``date, ret, long_only``: every name weighted by its z-scored alpha at a gross exposure of 2. Dates with fewer
    than ``least`` names, or all of weight 0, sit out. Plain z-scores use the population deviation, those within
    sectors the sample deviation."""
    cost = cost_bps / 10_000
    day = rebalance_rows(rows, horizon).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("date"))).where(F.col("_n") >= least)
    w = Window.partitionBy("date", "sector") if neutral else Window.partitionBy("date")
    spread = F.stddev_samp("alpha").over(w) if neutral else F.stddev_pop("alpha").over(w)
    z = F.coalesce((F.col("alpha") - F.avg("alpha").over(w)) / nonzero(spread), F.lit(0.0))
    long_ = F.when(F.col("_z") > 0, F.col("_z"))
    sums = day.withColumn("_z", z).groupBy("date").agg(
        F.sum(F.abs("_z")).alias("_g"), F.sum(F.col("_z") * F.col("fwd_ret")).alias("_r"), F.sum(long_).alias("_lg"), F.sum(long_ * F.col("fwd_ret")).alias("_lr")
    )
    only = F.when(F.col("_lg") > 0, F.col("_lr") / F.col("_lg") - 2 * cost).otherwise(0.0)
    return sums.where("_g > 0").select("date", (2 * F.col("_r") / F.col("_g") - 4 * cost).alias("ret"), only.alias("long_only"))


PERIODS = {"decile": decile_periods, "ic_weighted": weighted_periods}


def metrics(periods: DataFrame, horizon: int = HORIZON, by: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """Summary of ``date, ret, long_only`` (per group of ``by``). Fewer than two periods have no figures; with
    ``strict`` a period without a return voids them too, else it is left out."""
    per_year = TRADING_DAYS / horizon
    if not strict:
        periods = periods.where("ret is not null")
    n, known = F.count(F.lit(1)), F.count("ret")
    out = periods.groupBy(*by).agg(
        n.alias("n_periods"), (known == n).alias("_ok"), F.product(1 + F.col("ret")).alias("_eq"), F.stddev_pop("ret").alias("_sd"), F.product(1 + F.col("long_only")).alias("_lo"),
        F.transform(F.array_sort(F.collect_list(F.struct("date", "ret"))), lambda x: x["ret"]).alias("period_returns"),
    )
    ok = (F.col("n_periods") >= 2) & F.col("_ok")
    power = F.lit(per_year) / F.col("n_periods")
    out = out.withColumns({"ann_return": F.when(ok, F.pow("_eq", power) - 1), "ann_vol": F.when(ok, F.col("_sd") * per_year**0.5)})
    return out.select(
        *by, "n_periods", "ann_return", "ann_vol", F.when(F.col("ann_vol") > 0, F.col("ann_return") / F.col("ann_vol")).alias("sharpe"),
        F.when(ok, F.pow("_lo", power) - 1).alias("long_only_ann_return"), F.when(ok, F.col("_eq")).alias("equity_multiple"), "period_returns",
    )


def equity_curve(periods: DataFrame) -> DataFrame:
    """Running product of 1 + ret; returns stay above -1. One row per rebalance date, so one partition holds them."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return periods.select("date", F.exp(F.sum(F.log1p("ret")).over(w)).alias("equity"))
