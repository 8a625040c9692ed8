"""Ranking scored names into lists, with an optional cap per sector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def priority(ascending: bool = False) -> list[Column]:
    """By alpha with unknown ones last either way, then by ticker."""
    return [F.col("alpha").asc_nulls_last() if ascending else F.col("alpha").desc_nulls_last(), F.col("ticker").asc()]


def top(rows: DataFrame, n: int, per_sector: int | None = None, ascending: bool = False) -> DataFrame:
    """The first ``n`` rows by priority of which no sector has more than ``per_sector``. Taking rows greedily and
    skipping full sectors picks just those among the first ``per_sector`` of their sector."""
    rows = rows.withColumn("alpha", F.when(~F.isnan("alpha"), F.col("alpha")))
    if per_sector:
        place = F.row_number().over(Window.partitionBy("sector").orderBy(*priority(ascending)))
        rows = rows.withColumn("_place", place).where(F.col("_place") <= per_sector).drop("_place")
    return rows.orderBy(*priority(ascending)).limit(n)


def both_sides(rows: DataFrame, n: int, per_sector: int | None = None) -> DataFrame:
    """``top`` from either end, as ``side`` long and short. With a cap each sector's best and worst rows are found in one
    pass over it, and what is ordered across sectors is as small as the cap times their number."""
    if not per_sector:
        return top(rows, n).withColumn("side", F.lit("long")).unionByName(top(rows, n, ascending=True).withColumn("side", F.lit("short")))
    rows = rows.withColumn("alpha", F.when(~F.isnan("alpha"), F.col("alpha")))
    sides = (("long", False), ("short", True))
    rows = rows.withColumns({f"_{s}": F.row_number().over(Window.partitionBy("sector").orderBy(*priority(up))) for s, up in sides})
    kept = F.filter(F.array(*(F.when(F.col(f"_{s}") <= per_sector, F.lit(s)) for s, _ in sides)), lambda x: x.isNotNull())
    rows = rows.withColumn("side", F.explode(kept)).drop("_long", "_short")
    key = F.when(F.col("side") == "long", -F.col("alpha")).otherwise(F.col("alpha"))
    place = F.row_number().over(Window.partitionBy("side").orderBy(key.asc_nulls_last(), "ticker"))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def sector_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))
