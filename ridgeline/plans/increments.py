"""Features kept up to date by new bars alone: what a ticker's history comes to is a short tail and a few sums.

Three tables change together. ``tails`` has the last rows of every ticker with the decayed sums as of each; ``operands``
and ``features`` are what ``build_operands`` and ``training`` make of all bars so far, by month. New bars meet the tails
only. Labels of the tickers' last rows become known with them, so the months of those rows and of the new ones are written
again, the cross-sections of all their dates with them; older months are neither read nor written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions.guards import complete
from ridgeline.operators import features as P
from ridgeline.schema import FEATURE_COLS, HORIZON, PANEL, PANEL_COLS, WINDOWS
from ridgeline.sources.versions import VersionedTable

#: Rows of a ticker that a window of a new row can reach back over.
TAIL = 60
#: Folders of the tails, by hash of the ticker; only those of tickers with new bars are written.
SPREAD = 16
_SUMS = [f"{k}{h}" for h in WINDOWS for k in ("_closes", "_weights")]
_TAILS = T.StructType([*PANEL.fields, *(T.StructField(c, T.DoubleType()) for c in _SUMS), T.StructField("spread", T.StringType())])
_OPERANDS = T.StructType([*PANEL.fields[:2], T.StructField("sector", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in [*PANEL_COLS[2:], *FEATURE_COLS, "fwd_ret"]), T.StructField("month", T.StringType())])
_FEATURES = T.StructType([*_OPERANDS.fields[:-1], T.StructField("fwd_ret_neutral", T.DoubleType()), T.StructField("month", T.StringType())])


def _spread(ticker: Column) -> Column:
    return F.pmod(F.xxhash64(ticker), F.lit(SPREAD)).cast("string")


class FeatureStore:
    """The tables at ``path``; ``append`` takes bars that are newer than all of their ticker's so far."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.tails = VersionedTable(spark, f"{path}/tails", _TAILS, "spread")
        self.operands = VersionedTable(spark, f"{path}/operands", _OPERANDS, "month")
        self.features = VersionedTable(spark, f"{path}/features", _FEATURES, "month")

    def append(self, bars: DataFrame, universe: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
        """Take in ``bars`` (columns of the panel, a row per date and ticker). False if ``writer`` has brought that
        ``batch`` before; one that failed half-way can be brought again. Bars that are not newer than their ticker's
        last one are an error and change nothing. Sectors are those of ``universe`` for new rows and stay for old ones.
        """
        if self.tails.seen(writer, batch):
            return False
        new = bars.select(*PANEL_COLS).withColumn("spread", _spread(F.col("ticker")))
        met = [r.spread for r in new.select("spread").distinct().collect()]
        tails = self.tails.read(met)
        last = tails.groupBy("ticker").agg(F.max("date").alias("_last"))
        if late := new.join(last, "ticker").where("date <= _last").count():
            raise ValueError(f"{late} bars are not newer than the last ones of their tickers; build the store anew")
        rows = tails.withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False)), allowMissingColumns=True)
        made = P.with_operands(rows, target=True, sums=True, seeded=True)
        made = made.withColumn("_place", F.row_number().over(Window.partitionBy("ticker", "_old").orderBy(F.desc("date"))))
        known = self._operands(made, universe)
        # Only the last rows of a ticker had no label yet.
        labels = made.where(f"_old and _place <= {HORIZON} and fwd_ret is not null").select("date", "ticker", F.col("fwd_ret").alias("_label"), _month().alias("month"))
        # The new bars' own keys say which months and rows are meant; asking ``known`` would make all operands again each time.
        months = sorted({r.month for r in new.select(_month().alias("month")).union(labels.select("month")).where("month is not null").distinct().collect()})
        before = self.operands.read(months).join(labels.drop("month"), ["date", "ticker"], "left")
        before = before.withColumn("fwd_ret", F.coalesce("fwd_ret", "_label")).drop("_label")
        before = before.join(new.select("date", "ticker"), ["date", "ticker"], "left_anti")  # from a try that failed half-way
        self.operands.replace(before.unionByName(known), writer, batch)
        trained = P.training(self.operands.read(months))
        self.features.replace(trained, writer, batch)
        self.tails.replace(_tail(made), writer, batch)
        return True

    def _operands(self, made: DataFrame, universe: DataFrame) -> DataFrame:
        rows = complete(P.attach_sector(made.where("not _old"), universe), FEATURE_COLS)
        return rows.withColumn("month", _month()).select(*_OPERANDS.fieldNames())

    def read(self) -> DataFrame:
        return self.features.read().drop("month")

    def live(self) -> DataFrame:
        """Scoring rows of the last date there is; one month is read."""
        parts = sorted(p.split("=", 1)[1] for p in self.operands.state()["parts"])
        return P.live_latest(self.operands.read(parts[-1:]).drop("month"))


def _month() -> Column:
    return F.date_format("date", "yyyy-MM")


def _tail(made: DataFrame) -> DataFrame:
    """The last rows of each ticker, and before them the last one with a close if they have none."""
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    shut = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("close").isNull(), F.desc("date")))
    rows = made.withColumns({"_back": back, "_shut": shut})
    return rows.where((F.col("_back") <= TAIL) | ((F.col("_shut") == 1) & F.col("close").isNotNull())).select(*_TAILS.fieldNames())
