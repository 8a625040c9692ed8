"""What one task holds when stored tables are built: dates are dealt evenly over the buckets, and sorted once for all windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import features as P
from ridgeline.schema import FEATURE_COLS
from ridgeline.sources import store
from ridgeline.sources import testdata as T

SMALL = "/root/testdata/sf0.001"


def fullest(rows, buckets, key="date"):
    return max(r["count"] for r in rows.repartition(buckets, key).groupBy(F.spark_partition_id()).count().collect())


@pytest.mark.parametrize(("most", "allowed"), [(150, 150), (10, 80), (10**6, 10**6)])
def test_no_bucket_is_crowded(spark, monkeypatch, most, allowed):
    monkeypatch.setattr(store, "BUCKET_ROWS", most)
    rows = spark.range(120 * 40).select(F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 120).cast("int") * 7).alias("date"))
    buckets, plain = store.even_buckets(spark, rows, "date"), store.bucket_count(spark, 120 * 40)
    assert fullest(rows, buckets) <= allowed
    assert buckets == plain if most == 10**6 else buckets > plain and fullest(rows, plain) > allowed


def test_where_no_number_is_even_the_best_is_taken(spark, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ROWS", 1)
    rows = spark.range(2000).select((F.col("id") % 1000).alias("k"))
    buckets = store.even_buckets(spark, rows, "k")
    assert buckets <= 4000 and 4 <= fullest(rows, buckets, "k") <= 8
    assert store.even_buckets(spark, rows.where("false"), "k") == store.bucket_count(spark, 0)


def test_stored_features_and_operands_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ROWS", 60)
    store.forget(spark, SMALL)
    try:
        widest = max(r["count"] for r in T.bars(spark, SMALL).groupBy("date").count().collect())
        for table in (T.features(spark, SMALL), T.operands(spark, SMALL)):
            sizes = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
            assert len(sizes) > 1 and max(sizes) <= max(60, 2 * widest)
    finally:
        store.forget(spark, SMALL)


def test_training_rows_are_sorted_once(spark):
    fields = ", ".join(["date date", "ticker string", "sector string", "fwd_ret double", *(f"{c} double" for c in FEATURE_COLS)])
    rows = spark.createDataFrame([], fields).repartition(3, "date")
    plan = P.training(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Window [") == 2
