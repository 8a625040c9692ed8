"""Adapters from the star-schema tables to the panel, universe, order-book and event shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import features as P
from ridgeline.schema import FEATURE_COLS
from ridgeline.sources.store import bucket_count, even_buckets, is_stored, stored


UNIVERSE_TABLES = ["supplier", "nation", "region"]
OPERAND_SOURCES = ["lineitem", *UNIVERSE_TABLES]
#: The total order of lines.
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
#: What operands and features are stored with.
KEYS = ["date", "ticker", "sector"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Weekly bars per supplier: unit prices first, highest, lowest and last by a total order of the lines, and quantity.

    With ``parts`` the lines meet by ticker in so many partitions, once: bars are made where they stay, and no pair of
    aggregation buffers, several times as wide as a line and hardly fewer, is sorted and shuffled for each."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.col("l_suppkey").cast("string").alias("ticker"),
        F.try_divide("l_extendedprice", "l_quantity").alias("px"), *(c for c in ORDER if c != "l_quantity"), "l_quantity",
    )
    rows = (rows.repartition(parts, "ticker") if parts else rows).withColumn("k", F.struct(*ORDER))
    return rows.groupBy("date", "ticker").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.sum("l_quantity").alias("volume")
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their region as sector."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return table(spark, sf_dir, "supplier").join(F.broadcast(named), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("r_name").alias("sector"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``panel``, stored in buckets of tickers, so that windows over a ticker's history need no shuffle."""

    def build():
        buckets = bucket_count(spark, table(spark, sf_dir, "lineitem").count())
        return panel(spark, sf_dir, buckets), buckets

    return stored(spark, sf_dir, "bars", "ticker", "date", build, ["lineitem"])


def operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operand rows of all bars with sector and label, stored in buckets of dates."""

    def build():
        return _made(spark, sf_dir), even_buckets(spark, bars(spark, sf_dir), "date")

    return stored(spark, sf_dir, "operands", "date", "ticker", build, OPERAND_SOURCES)


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.build_operands(bars(spark, sf_dir), universe(spark, sf_dir)).select(*KEYS, *FEATURE_COLS, "fwd_ret")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows, stored in buckets of dates; made from the operands where a query has stored those, without a shuffle,
    and else from the bars, so that what nobody asked for is not written."""

    def build():
        buckets = even_buckets(spark, bars(spark, sf_dir), "date")
        if is_stored(spark, sf_dir, "operands", OPERAND_SOURCES):
            return P.training(operands(spark, sf_dir)), buckets
        return P.training(_made(spark, sf_dir).where("fwd_ret is not null").repartition(buckets, "date")), buckets

    return stored(spark, sf_dir, "features", "date", "ticker", build, OPERAND_SOURCES)


def book_levels(events: DataFrame) -> DataFrame:
    """One row per level: events in six-hour buckets, even ids bids below 500, odd ids asks above."""
    bid = F.col("event_id") % 2 == 0
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return events.select(
        (seconds - seconds % 21600).alias("bucket"),
        F.when(bid, "bid").otherwise("ask").alias("side"),
        F.when(bid, 500 - F.col("value")).otherwise(500 + F.col("value")).alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
        "event_id",
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots ``symbol, bucket, bids, asks`` with the best level first; ties by event id."""
    levels = book_levels(table(spark, sf_dir, "events"))
    key = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    ordered = F.struct(key.alias("k"), "event_id", "price", "size")

    def side(name):
        rows = F.array_sort(F.collect_list(F.when(F.col("side") == name, ordered)))
        return F.transform(rows, lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size"))).alias(f"{name}s")

    return levels.groupBy("bucket").agg(side("bid"), side("ask")).select(F.lit("EVT").alias("symbol"), "bucket", "bids", "asks")
