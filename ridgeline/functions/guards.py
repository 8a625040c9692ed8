"""Null-safe arithmetic: NaN becomes null at the border, and nothing divides by zero under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clean(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column."""
    return df.select(*(null_nan(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def complete(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where all ``columns`` are known. One predicate on a count: twenty null checks of their own would each
    become a constraint that the optimizer carries through every projection above, at exponential cost."""
    unknown = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return rows.withColumn("_unknown", unknown).where("_unknown = 0").drop("_unknown")


def nonzero(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def correlation(x: str, y: str) -> Column:
    """Pearson as an aggregate over rows where both are known; null for constant input."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_rank(value: str, *by: str) -> Column:
    """Rank from 1 within ``by``, ties sharing their mean rank; null values have none. One sort: the rows up to and with a
    value's ties give its last place, as its rank gives the first."""
    order = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    upto = F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(F.col(value).isNotNull(), (F.rank().over(order) + upto) / 2)


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)
