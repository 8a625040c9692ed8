"""The prediction log: recorded and resolved once, by a table of changes or by a stream, whatever fails in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ridgeline.schema import PREDICTIONS
from ridgeline.sources.versions import VersionedTable

#: What a stream of log events holds: a prediction has ``alpha``, an outcome ``fwd_ret``.
EVENTS = "predict_date date, ticker string, alpha double, fwd_ret double"


class PredictionLog:
    """Predictions by date, CSV or Parquet, one row for each date and ticker.

    The prediction recorded first stays, and so does an outcome once it is known. An outcome that comes before its
    prediction waits in the log, unseen by ``read``, until that is recorded. Null and NaN values count as not there.
    Only the dates that a change touches are read and written.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "csv"):
        self.table = VersionedTable(spark, path, PREDICTIONS, "predict_date", kind)

    def read(self) -> DataFrame:
        return self.table.read().where("alpha is not null")

    def upsert(self, events: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
        """Merge rows of ``EVENTS``; False if ``writer`` has committed that ``batch`` before."""
        if self.table.seen(writer, batch):
            return False
        known = {c: F.when(~F.isnan(c), F.col(c)) for c in ("alpha", "fwd_ret")}
        new = events.withColumns(known).select("predict_date", "ticker", F.col("alpha").alias("new_alpha"), F.col("fwd_ret").alias("new_ret"))
        dates = [r.predict_date for r in new.select("predict_date").distinct().collect()]  # of one batch
        old = self.table.read(dates).select("predict_date", "ticker", "alpha", "realized_fwd_ret")
        rows = old.unionByName(new, allowMissingColumns=True).groupBy("predict_date", "ticker")
        first = rows.agg(F.coalesce(F.max("alpha"), F.min("new_alpha")).alias("alpha"), F.coalesce(F.max("realized_fwd_ret"), F.min("new_ret")).alias("realized_fwd_ret"))
        merged = first.where("alpha is not null or realized_fwd_ret is not null").withColumn("resolved", F.expr("alpha is not null and realized_fwd_ret is not null"))
        return self.table.replace(merged, writer, batch)

    def record(self, scored: DataFrame, date, writer: str | None = None, batch: int | None = None) -> bool:
        """Log the ``ticker, alpha`` of a scoring run; ``date`` is a date or a column."""
        day = F.lit(date).cast("date")
        return self.upsert(scored.select(day.alias("predict_date"), "ticker", "alpha", F.lit(None).cast("double").alias("fwd_ret")), writer, batch)

    def resolve(self, realized: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
        """Fill in outcomes ``date, ticker, fwd_ret`` of dates that the log has predictions for."""
        dates = sorted(p.split("=", 1)[1] for p in self.table.state()["parts"])
        rows = realized.where(F.col("date").cast("string").isin(dates))
        return self.upsert(rows.select(F.col("date").alias("predict_date"), "ticker", F.lit(None).cast("double").alias("alpha"), "fwd_ret"), writer, batch)

    def follow(self, events: DataFrame, writer: str, checkpoint: str) -> StreamingQuery:
        """Merge a stream of ``EVENTS`` until what is there has been read. A batch counts once: it is committed together
        with its number, so one that fails after that, and is replayed, finds itself done."""
        merge = lambda batch, number: self.upsert(batch.persist(), writer, number) or None
        return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
