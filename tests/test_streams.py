"""Streams with state, and tables that change at once: replays, failures at every step, restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import monitor as D
from ridgeline.sources import web
from ridgeline.sources.versions import VersionedTable
from ridgeline.streaming import drift as S
from ridgeline.streaming.log import EVENTS, PredictionLog

DATES = [dt.date(2024, 1, 1) + dt.timedelta(days=7 * k) for k in range(14)]


@pytest.fixture()
def scored(spark):
    rng = random.Random(4)
    rows = [(d, f"t{k}", rng.gauss(0, 1), rng.gauss(0, 1)) for d in DATES for k in range(12) if rng.random() < 0.9]
    rows += [(DATES[3] + dt.timedelta(days=1), f"t{k}", 1.0, rng.gauss(0, 1)) for k in range(5)]  # no spread: no coefficient
    return spark.createDataFrame(rows, "date date, ticker string, alpha double, fwd_ret double").persist()


def _feed(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def _source(spark, folder, name, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")


def test_drift_states_of_shuffled_streams_equal_the_table(spark, scored, tmp_path):
    """Every date's rows come in two batches, outcomes 5 to 9 days later and before older predictions of other dates; the
    queries end and start anew in between."""
    left, right = "predict_date date, ticker string, alpha double", "predict_date date, ticker string, fwd_ret double, known_at timestamp"
    rows, rng = scored.collect(), random.Random(1)
    baseline = (0.02, 0.3)

    def run():
        ics = S.period_ics(_source(spark, tmp_path, "p", left), _source(spark, tmp_path, "o", right), wait=10, late="14 days")
        S.write_stream(ics, f"{tmp_path}/ics", f"{tmp_path}/cp1").awaitTermination()
        if spark.read.schema(S.ICS).parquet(f"{tmp_path}/ics").count():
            found = spark.readStream.schema(S.ICS).parquet(f"{tmp_path}/ics")
            S.write_stream(S.drift_states(found, *baseline), f"{tmp_path}/drift", f"{tmp_path}/cp2").awaitTermination()

    for start in range(0, 14, 7):
        week = [r for r in rows if DATES[start] <= r.date < DATES[start] + dt.timedelta(days=49)]
        rng.shuffle(week)
        half = len(week) // 2
        for part in (week[:half], week[half:]):
            known = [(r.date, r.ticker, r.fwd_ret, dt.datetime.combine(r.date, dt.time()) + dt.timedelta(days=rng.randint(5, 9))) for r in part]
            _feed(spark, sorted(known, key=lambda x: rng.random()), right, tmp_path, "o")
            _feed(spark, [(r.date, r.ticker, r.alpha) for r in part], left, tmp_path, "p")
        if start == 0:
            run()
            run()  # nothing new: nothing changes
    far = dt.date(2024, 12, 1)
    _feed(spark, [(far, "end", 0.0)], left, tmp_path, "p")
    _feed(spark, [(far, "end", 0.0, dt.datetime(2024, 12, 1))], right, tmp_path, "o")
    run()
    ics = D.period_ic(scored, 1)
    want = [tuple(r) for r in D.drift_timeline(ics, *baseline).orderBy("as_of").collect()]
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/drift").orderBy("as_of").collect()]
    assert len(got) == 14 and [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[4:] == pytest.approx(b[4:], rel=1e-9, nan_ok=True) if b[4] is not None else a[4] is None


def test_a_versioned_table_changes_by_partition(spark, tmp_path):
    schema = spark.createDataFrame([], "day string, x long").schema
    table = VersionedTable(spark, f"{tmp_path}/t", schema, "day")
    assert table.read().count() == 0 and table.state()["version"] == 0
    table.replace(spark.createDataFrame([("a", 1), ("b", 2)], schema))
    assert table.replace(spark.createDataFrame([("b", 3), ("c", 4)], schema), "w", 0)
    assert not table.replace(spark.createDataFrame([("a", 9)], schema), "w", 0)
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert [tuple(r) for r in table.read(["b", "nothing"]).collect()] == [("b", 3)]
    files = table.read(["c"]).inputFiles()
    assert files and all("_part=c" in f for f in files)
    assert table.vacuum() == 0 and table.read().count() == 3
    table.replace(spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], schema))
    assert table.vacuum() == 2 and [r.x for r in table.read().collect()] == [5, 5, 5]


def test_two_writers_at_once(spark, tmp_path):
    schema = spark.createDataFrame([], "day string, x long").schema
    one, two = (VersionedTable(spark, f"{tmp_path}/t", schema, "day") for _ in range(2))
    plain = one._commit

    def slow(version, state):
        two.replace(spark.createDataFrame([("a", 2)], schema))
        plain(version, state)

    one._commit = slow
    with pytest.raises(Exception, match="exist"):
        one.replace(spark.createDataFrame([("a", 1)], schema))
    assert [tuple(r) for r in two.read().collect()] == [("a", 2)]


def test_a_replayed_batch_of_addresses_has_its_rows_again(spark, tmp_path):
    """Fetched in tasks; a batch that failed is read from the log although the pages have changed; the next turn fetches anew."""
    for k in range(6):
        (tmp_path / f"{k}.txt").write_text(f"old {k}")
    pages = {f"k{k}": (tmp_path / f"{k}.txt").as_uri() for k in range(6)}
    options = {"batch": 2, "log": str(tmp_path / "log"), "keep": 2}
    seen = []

    def run(every, fail=False):
        def take(batch, number):
            rows = batch.withColumn("part", F.spark_partition_id()).collect()
            seen.append((number, {r.symbol: (r.payload, r.timestamp) for r in rows}, len({r.part for r in rows})))
            if fail:
                raise RuntimeError("lost")

        stream = web.payloads(spark, pages, True, every=every, **options)
        stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(60)

    with pytest.raises(Exception, match="lost"):
        run(0.01, fail=True)
    for k in range(6):
        (tmp_path / f"{k}.txt").write_text(f"new {k}")
    run(0.01)
    (_, first, tasks), (number, again, _), *later = seen
    assert tasks == 3 and number == 0 and again == first and first["k4"][0] == "old 4"
    run(0.01)
    assert {v[0] for v in seen[-1][1].values()} == {f"new {k}" for k in range(6)}
    run(0.01)
    assert len(list((tmp_path / "log").iterdir())) <= 3
    assert all(set(s[1]) == set(pages) for s in seen)
    for _ in range(2):  # the second time no turn has passed
        web.payloads(spark, pages, True, every=1e9, batch=4, log=f"{tmp_path}/slow").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


@pytest.mark.parametrize("step", ["before", "written", "committed"])
@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_log_survives_a_failure_at_each_step(spark, scored, tmp_path, step, kind):
    rows, rng = scored.collect(), random.Random(2)
    events = [(r.date, r.ticker, r.alpha, None) for r in rows] + [(r.date, r.ticker, None, r.fwd_ret) for r in rows if r.date < DATES[9]]
    events += [(DATES[0], "never predicted", None, 0.5), (DATES[1], "nan", float("nan"), None)]
    rng.shuffle(events)
    for k in range(0, len(events), 100):
        _feed(spark, events[k : k + 100], EVENTS, tmp_path, "e")
    log = PredictionLog(spark, f"{tmp_path}/log", kind)
    table, failed = log.table, []
    commit, replace = table._commit, table.replace

    def failing(call, after):
        def run(*args):
            if after:
                call(*args)
            if table.state()["version"] >= 2 and not failed:
                failed.append(1)
                raise RuntimeError("lost")
            return None if after else call(*args)

        return run

    if step == "before":
        table.replace = failing(replace, False)
    else:
        table._commit = failing(commit, step == "committed")
    query = log.follow(_source(spark, tmp_path, "e", EVENTS), "w", f"{tmp_path}/cp")
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    log.follow(_source(spark, tmp_path, "e", EVENTS), "w", f"{tmp_path}/cp").awaitTermination()
    assert failed
    want = {(r.date, r.ticker): (r.alpha, r.fwd_ret if r.date < DATES[9] else None) for r in rows}
    got = log.read().collect()
    assert len(got) == len(want) and {(r.predict_date, r.ticker): (r.alpha, r.realized_fwd_ret) for r in got} == want
    assert all(r.resolved == (r.realized_fwd_ret is not None) for r in got)


def test_log_by_tables(spark, tmp_path):
    log = PredictionLog(spark, f"{tmp_path}/log")
    day = dt.date(2024, 3, 1)
    log.record(spark.createDataFrame([("A", 1.0), ("B", 2.0)], "ticker string, alpha double"), day)
    log.record(spark.createDataFrame([("A", 7.0)], "ticker string, alpha double"), day)
    log.resolve(spark.createDataFrame([(day, "A", 0.5), (dt.date(2023, 1, 1), "A", 0.1)], "date date, ticker string, fwd_ret double"))
    log.resolve(spark.createDataFrame([(day, "A", 0.9)], "date date, ticker string, fwd_ret double"))
    assert sorted(map(tuple, log.read().collect())) == [(day, "A", 1.0, 0.5, True), (day, "B", 2.0, None, False)]
    assert log.read().where(F.col("predict_date") != F.lit(day)).count() == 0
