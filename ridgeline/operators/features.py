"""Panel features: rolling operators per ticker, then cross-sectional z-scores per date.

Two exchanges in all: every rolling column shares the window (ticker, date), every cross-sectional one the date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ridgeline.functions.guards import clean, complete, nonzero
from ridgeline.schema import FEATURE_COLS, HORIZON, WINDOWS


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def _full(value: Column, agg: Column, rows: int) -> Column:
    """``agg`` over the last ``rows`` rows, null unless all of them hold a value."""
    frame = by_ticker().rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(frame) == rows, agg.over(frame))


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def simple_return(pad: bool = True) -> Column:
    """Change against the row before; with ``pad`` a missing close counts as the last one known."""
    known = F.last(F.col("close"), ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)) if pad else F.col("close")
    before = F.last(F.col("close"), ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, -1)) if pad else F.lag(F.col("close")).over(by_ticker())
    return F.try_divide(known, before) - 1


def change(rows: int) -> Column:
    return F.col("close") - F.lag(F.col("close"), rows).over(by_ticker())


def rolling_correlation(rows: int) -> Column:
    both = F.when(F.col("close").isNotNull() & F.col("volume").isNotNull(), F.lit(1))
    frame = by_ticker().rowsBetween(1 - rows, 0)
    spread = F.stddev_pop(F.col("close")).over(frame) * F.stddev_pop(F.col("volume")).over(frame)
    return F.when(F.count(both).over(frame) == rows, F.try_divide(F.covar_pop(F.col("close"), F.col("volume")).over(frame), spread))


#: Rows of a ticker that count as one block of the decayed means. A power of two per half-life stays finite over a
#: block for half-lives of 2.5 rows and more; two blocks back it is lost in rounding for those of up to 40 rows.
BLOCK = 2500


def with_decayed_means(rows: DataFrame, halflives: list[int], sums: bool = False, seeded: bool = False) -> DataFrame:
    """``ewma_close_<h>``: exponentially weighted means over all rows so far.

    Weighted sums grow along each block of a ticker, and what the last block with a close came to is carried into them,
    so every row costs the same however long the half-life. All windows have one order, and one exchange.

    ``sums`` adds ``_closes<h>`` and ``_weights<h>``, the decayed sums of closes and of weights as of each row. ``seeded`` goes on from
    them: rows with ``_old`` are the end of a history, of which the last row's sums stand for all of it.
    """
    if not all(BLOCK / 1000 <= h <= BLOCK / 60 for h in halflives):
        raise ValueError(f"half-lives must lie between {BLOCK / 1000} and {BLOCK // 60} rows")
    block = Window.partitionBy("ticker", "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("ticker").orderBy("_b", "date").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_i", F.row_number().over(by_ticker()) - 1).withColumn("_b", F.floor(F.col("_i") / BLOCK))
    if seeded:
        rows = rows.withColumn("_seed", F.col("_old") & ~F.coalesce(F.lead("_old").over(by_ticker()), F.lit(False)))
    growth = {h: F.pow(F.lit(2.0), F.pmod("_i", F.lit(BLOCK)) / h) for h in halflives}

    def share(h: int, held: str, value: Column) -> Column:
        own = F.when(F.col("close").isNotNull(), growth[h] * value)
        return F.when(F.col("_seed"), growth[h] * F.col(f"{held}{h}")).when(~F.col("_old"), own) if seeded else own

    parts = {f"_s{h}": share(h, "_closes", F.col("close")) for h in halflives} | {f"_w{h}": share(h, "_weights", F.lit(1.0)) for h in halflives}
    rows = rows.withColumns({c: F.coalesce(F.sum(x).over(block), F.lit(0.0)) for c, x in parts.items()})
    ends = {h: (F.pmod("_i", F.lit(BLOCK)) == BLOCK - 1) & (F.col(f"_w{h}") > 0) for h in halflives}
    carried = {f"_{k}{h}_": F.last(F.when(ends[h], F.col(f"_{k}{h}" if k != "b" else "_b")), ignorenulls=True).over(before) for h in halflives for k in "swb"}
    rows = rows.withColumns({c: F.coalesce(x, F.lit(0.0)) for c, x in carried.items()})

    def total(h: int, k: str) -> Column:
        fade = F.pow(F.lit(2.0), (F.col(f"_b{h}_") - F.col("_b")) * (BLOCK / h))
        return F.when(F.col(f"_w{h}") > 0, F.col(f"_{k}{h}") + F.col(f"_{k}{h}_") * fade).otherwise(F.col(f"_{k}{h}_"))

    out = {f"ewma_close_{h}": F.try_divide(total(h, "s"), total(h, "w")) for h in halflives}
    if sums:
        shrink = {h: F.when(F.col(f"_w{h}") > 0, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), (F.col(f"_b{h}_") - F.col("_b")) * (BLOCK / h))) / growth[h] for h in halflives}
        out |= {f"{name}{h}": total(h, k) * shrink[h] for h in halflives for k, name in (("s", "_closes"), ("w", "_weights"))}
    return rows.withColumns(out).drop("_i", "_b", "_seed", *parts, *carried)


def forward_return(horizon: int = HORIZON) -> Column:
    return F.try_divide(F.lead(F.col("close"), horizon).over(by_ticker()), F.col("close")) - 1


def operand_expressions() -> dict[str, Column]:
    out = {"vwap": typical_price(), "ret_1d": simple_return()}
    for w in WINDOWS:
        out[f"mean_close_{w}"] = _full(F.col("close"), F.avg(F.col("close")), w)
        out[f"std_close_{w}"] = _full(F.col("close"), F.stddev_samp(F.col("close")), w)
        out[f"sum_volume_{w}"] = _full(F.col("volume"), F.sum(F.col("volume")), w)
        out[f"delta_close_{w}"] = change(w)
    return out | {"mom_60": change(60), "corr_close_volume_10": rolling_correlation(10)}


def with_operands(panel: DataFrame, names: list[str] | None = None, target: bool = False, sums: bool = False, seeded: bool = False) -> DataFrame:
    """The panel and the named rolling columns (all 19 by default), and ``fwd_ret`` if asked; for ``sums`` and ``seeded``
    see ``with_decayed_means``."""
    made = operand_expressions()
    names = names or FEATURE_COLS
    rows = clean(panel)
    if decayed := [int(n.rsplit("_", 1)[1]) for n in names if n.startswith("ewma")]:
        rows = with_decayed_means(rows, decayed, sums, seeded)
    return rows.withColumns({n: made[n] for n in names if n in made} | ({"fwd_ret": forward_return()} if target else {}))


def attach_sector(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Left join on ticker; a ticker that the universe lacks is in sector ``Unknown``."""
    return rows.join(universe.select("ticker", "sector"), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))


def zscored(rows: DataFrame, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """Each column less its date's mean over its date's sample deviation; where that is undefined, 0. With ``order``, dates are
    read in the order that windows by date and those columns have, so that one sort, held once, serves both."""
    day = Window.partitionBy("date")
    if order:
        day = day.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({c: F.coalesce((F.col(c) - F.avg(c).over(day)) / nonzero(F.stddev_samp(c).over(day)), F.lit(0.0)) for c in columns})


def sector_neutral(rows: DataFrame, column: str = "fwd_ret", name: str = "fwd_ret_neutral") -> DataFrame:
    return rows.withColumn(name, F.col(column) - F.avg(column).over(Window.partitionBy("date", "sector")))


def build_operands(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows with all operands known, their sector, and the label where it is known already."""
    return complete(attach_sector(with_operands(panel, target=True), universe), FEATURE_COLS)


def training(operands: DataFrame) -> DataFrame:
    """Training rows of ``build_operands``: a known label, the sector-neutral label, operands z-scored by date."""
    return zscored(sector_neutral(operands.where("fwd_ret is not null")), FEATURE_COLS, ["sector"])


def build_features(panel: DataFrame, universe: DataFrame) -> DataFrame:
    return training(build_operands(panel, universe))


def live_features(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """Scoring rows: as for training, without a label."""
    return zscored(build_operands(panel, universe).drop("fwd_ret"), FEATURE_COLS)


def latest(rows: DataFrame) -> DataFrame:
    """The rows of the last date."""
    last = rows.agg(F.max("date").alias("_last"))
    return rows.join(F.broadcast(last), F.col("date") == F.col("_last"), "left_semi")


def live_latest(operands: DataFrame) -> DataFrame:
    """Scoring rows of the last date there is, from stored operands: only that date is read and z-scored."""
    last = operands.agg(F.max("date")).first()[0]
    return zscored(operands.where(F.col("date") == F.lit(last)).drop("fwd_ret"), FEATURE_COLS)
