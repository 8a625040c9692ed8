"""Quantile edges from range counts against Spark's percentile, with ties, nulls and groups of every size."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import backtest as B
from ridgeline.operators.quantiles import exact_edges

FRACTIONS = B._fractions(10)


@pytest.fixture(scope="module")
def rows(spark):
    rng, made = random.Random(1), []
    for k, n in enumerate([1, 2, 7, 300, 5000, 5000]):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=k)
        for i in range(n):
            a = rng.gauss(0, 1) if k != 5 else float(rng.choice([0, 0, 0, 1, 2]))  # the last date is nearly all ties
            made.append((day, rng.choice(["x", "y", None]), None if k == 3 and i % 11 == 0 else a, rng.gauss(0, 0.02)))
    made += [(dt.date(2024, 3, 1), None, None, 0.1)] * 3
    return spark.createDataFrame(made, "date date, sector string, alpha double, fwd_ret double").repartition(7).persist()


@pytest.mark.parametrize("by", [["date"], ["date", "sector"]])
@pytest.mark.parametrize("ranges", [8, 256])
def test_edges_equal_percentile(rows, by, ranges):
    want = {tuple(r)[:-2]: (r._n, r._e) for r in rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile("alpha", F.array(*map(F.lit, FRACTIONS))).alias("_e")).collect()}
    got = {tuple(r)[:-2]: (r._n, r._e) for r in exact_edges(rows, by, "alpha", FRACTIONS, ranges).collect()}
    assert got == want


@pytest.mark.parametrize("neutral", [False, True])
def test_wide_dates_have_the_same_periods(rows, neutral):
    slim = B.decile_periods(rows, 5, horizon=1, neutral=neutral).orderBy("date").collect()
    wide = B.decile_periods(rows, 5, horizon=1, neutral=neutral, wide=100).orderBy("date").collect()
    assert len(slim) == len(wide) > 1
    for a, b in zip(slim, wide, strict=True):
        assert a.date == b.date and a.ret == pytest.approx(b.ret, rel=1e-12) and a.long_only == pytest.approx(b.long_only, rel=1e-12)


def test_no_window_orders_a_whole_date(rows):
    """Windows of rows go by range within a group; those by group alone run over ranges."""
    plan = exact_edges(rows, ["date"], "alpha", FRACTIONS)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_range" in line for line in windows)
    assert "percentile(" not in plan.lower()
