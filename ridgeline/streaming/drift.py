"""Drift monitoring as state on streams: coefficients of dates that are complete, then their trailing mean.

``period_ics`` joins predictions with outcomes that come later, in any order, and keeps six running moments per date;
when the watermark says that no outcome of a date is to come, its coefficient goes out and its state is cleared.
``drift_states`` reads such coefficients and keeps the last few of them. Both go on from their checkpoints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ridgeline.operators.ic import FLAT
from ridgeline.operators.monitor import drift_status

ICS = "date date, n long, ic double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DAY_MS = 86_400_000


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that such processors need, for queries started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before is not None else spark.conf.unset(_PROVIDER)


def merged_moments(a: tuple, x, y) -> tuple:
    """Count, means and centred sums ``(n, mx, my, sxx, syy, sxy)`` of what ``a`` has seen and the values ``x, y``."""
    n, mx, my = len(x), x.mean(), y.mean()
    b = (n, mx, my, ((x - mx) ** 2).sum(), ((y - my) ** 2).sum(), ((x - mx) * (y - my)).sum())
    if not a[0]:
        return tuple(map(float, b))
    total, dx, dy = a[0] + n, mx - a[1], my - a[2]
    w = a[0] * n / total
    return (total, a[1] + dx * n / total, a[2] + dy * n / total, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w)


class DateMoments(StatefulProcessor):
    """Moments of a date's pairs as value state; an event-time timer ``wait`` days after the date ends it."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.moments = handle.getValueState("moments", "n double, mx double, my double, sxx double, syy double, sxy double")

    def handleInputRows(self, key, rows, timerValues):
        held = tuple(self.moments.get()) if self.moments.exists() else None
        if held is None:
            self.handle.registerTimer(int(pd.Timestamp(key[0]).timestamp() * 1000) + self.wait * DAY_MS)
        held = held or (0.0,) * 6
        for batch in rows:
            known = batch[batch["alpha"].notna() & batch["fwd_ret"].notna()]
            if len(known):
                held = merged_moments(held, known["alpha"].to_numpy(), known["fwd_ret"].to_numpy())
        self.moments.update(held)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, _, _, sxx, syy, sxy = self.moments.get()
        self.moments.clear()
        if n and math.sqrt(sxx / n) >= FLAT and math.sqrt(syy / n) >= FLAT:
            yield pd.DataFrame({"date": [key[0]], "n": [int(n)], "ic": [sxy / math.sqrt(sxx * syy)]})

    def close(self) -> None:
        pass


class Trailing(StatefulProcessor):
    """The last ``window`` coefficients of a series in a list state, and how many there have been in all."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.recent = handle.getListState("recent", "ic double")

    def handleInputRows(self, key, rows, timerValues):
        came = pd.concat(list(rows)).sort_values("date")
        seen = self.count.get()[0] if self.count.exists() else 0
        recent = [r[0] for r in self.recent.get()]
        out = []
        for date, ic in zip(came["date"], came["ic"], strict=True):
            seen, recent = seen + 1, [*recent, ic][-self.window :]
            out.append((key[0], seen, date, len(recent), sum(recent) / len(recent)))
        self.count.update((seen,))
        self.recent.put([(ic,) for ic in recent])
        yield pd.DataFrame(out, columns=["series", "as_of", "date", "n_weeks", "recent"])

    def close(self) -> None:
        pass


def period_ics(predictions: DataFrame, outcomes: DataFrame, wait: int = 14, late: str = "0 seconds") -> DataFrame:
    """A stream of ``ICS`` from streams ``predict_date, ticker, alpha`` and ``predict_date, ticker, fwd_ret, known_at``.

    ``known_at`` (a timestamp) says when an outcome was known, ``wait`` days after the prediction at the latest; both sides
    may be ``late`` and in any order by that much. A date without spread on a side has no coefficient. Dates come out in order.
    """
    left = predictions.select(F.col("predict_date").cast("timestamp").alias("made_at"), "ticker", "alpha").withWatermark("made_at", late).alias("p")
    right = outcomes.select(F.col("predict_date").cast("timestamp").alias("of"), F.col("ticker").alias("name"), "fwd_ret", "known_at").withWatermark("known_at", late).alias("o")
    on = (F.col("p.ticker") == F.col("o.name")) & (F.col("p.made_at") == F.col("o.of")) & F.col("known_at").between(F.col("made_at"), F.col("made_at") + F.expr(f"interval {wait} days"))
    pairs = left.join(right, on).select("made_at", "alpha", "fwd_ret", F.to_date("made_at").alias("date"))
    return pairs.groupBy("date").transformWithStateInPandas(DateMoments(wait), ICS, "append", "eventtime")


def drift_states(ics: DataFrame, mean: float, std: float, window: int = 8, least: int = 3, level: float = 0.10) -> DataFrame:
    """The drift test as of every coefficient of a stream of ``ICS`` that comes in order of dates, against a fixed baseline."""
    rows = ics.select(F.lit("model").alias("series"), "date", "ic").groupBy("series")
    rows = rows.transformWithStateInPandas(Trailing(window), "series string, as_of int, date date, n_weeks long, recent double", "append", "none")
    return drift_status(rows.select("as_of", "date", "n_weeks", F.col("recent").alias("_m"), F.lit(mean).alias("_mean"), F.lit(std).alias("_std")), least, level)


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append ``rows`` to Parquet until what is there has been read; each batch counts once."""
    with rocksdb(rows.sparkSession):
        return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
