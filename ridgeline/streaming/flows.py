"""Structured Streaming forms: book features appended per snapshot, and predictions met by late outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ridgeline.operators.orderbook import book_features


def collect_books(snapshots: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the features of a stream of snapshots to Parquet; runs until what is there has been read."""
    return book_features(snapshots).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Counts and value sums per event-time window and type; rows later than ``late`` are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def resolve_stream(predictions: DataFrame, outcomes: DataFrame, days: int = 14) -> DataFrame:
    """Left join of streams ``predict_ts, ticker, alpha`` and ``outcome_ts, ticker, fwd_ret``: an outcome counts for the
    prediction of that ticker up to ``days`` before it; one that never comes leaves a null when the watermark has passed."""
    left = predictions.withWatermark("predict_ts", "1 hour").alias("p")
    right = outcomes.withWatermark("outcome_ts", "1 hour").alias("o")
    on = (F.col("p.ticker") == F.col("o.ticker")) & F.col("o.outcome_ts").between(F.col("p.predict_ts"), F.col("p.predict_ts") + F.expr(f"interval {days} days"))
    return left.join(right, on, "leftOuter").select("p.predict_ts", "p.ticker", "p.alpha", "o.fwd_ret", F.col("o.fwd_ret").isNotNull().alias("resolved"))
