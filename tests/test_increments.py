"""Features by increments against the full build."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import features as P
from ridgeline.plans.increments import TAIL, FeatureStore
from ridgeline.schema import FEATURE_COLS, PANEL

DAYS = [dt.date(2023, 1, 2) + dt.timedelta(days=7 * k) for k in range(110)]


@pytest.fixture(scope="module")
def panel():
    """Weekly bars: a ticker with gaps, one with missing closes, one that starts late, one that ends early."""
    rng, rows = random.Random(6), []
    for t in "ABCDEFG":
        close = 50.0
        for k, d in enumerate(DAYS):
            close *= 1 + rng.gauss(0, 0.03)
            if (t == "B" and k % 9 == 4) or (t == "E" and k < 35) or (t == "F" and k > 100):
                continue
            shown = None if t == "C" and k % 23 == 7 else float("nan") if t == "D" and k == 104 else close
            rows.append((d, t, close, close * 1.01, close * 0.99, shown, rng.uniform(1, 100)))
    return rows


def _close(got, want):
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert (a.date, a.ticker, a.sector) == (b.date, b.ticker, b.sector)
        for c in [*FEATURE_COLS, "fwd_ret", "fwd_ret_neutral"]:
            assert a[c] == pytest.approx(b[c], rel=1e-8, abs=1e-9), (a.date, a.ticker, c)


def test_appending_equals_the_full_build(spark, panel, tmp_path):
    universe = spark.createDataFrame([(t, "one" if t < "D" else "two") for t in "ABCDEFG"], "ticker string, sector string")
    frame = lambda lo, hi: spark.createDataFrame([r for r in panel if lo <= r[0] < hi], PANEL)
    store, ends = FeatureStore(spark, str(tmp_path)), [DAYS[90], DAYS[91], DAYS[97], dt.date(2030, 1, 1)]
    assert store.append(frame(DAYS[0], ends[0]), universe, "w", 0)
    for k, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False), 1):
        parts = store.operands.state()["parts"]
        assert store.append(frame(lo, hi), universe, "w", k) and not store.append(frame(lo, hi), universe, "w", k)
        kept = {m for m, folder in store.operands.state()["parts"].items() if parts.get(m) == folder}
        assert max(kept) < f"_part={lo - dt.timedelta(days=28):%Y-%m}~" and len(kept) >= 3  # older months are left alone
    whole = spark.createDataFrame(panel, PANEL)
    order = lambda df: df.orderBy("date", "ticker").collect()
    _close(order(store.read()), order(P.build_features(whole, universe)))
    live = {r.ticker: r for r in store.live().collect()}
    full = {r.ticker: r for r in P.latest(P.live_features(whole, universe)).collect()}
    assert live.keys() == full.keys() and all(live[t][c] == pytest.approx(full[t][c], rel=1e-8, abs=1e-9) for t in live for c in FEATURE_COLS)
    assert store.tails.read().groupBy("ticker").count().agg(F.max("count")).first()[0] <= TAIL + 1


def test_an_append_reads_tails_and_late_months_only(spark, panel, tmp_path):
    universe = spark.createDataFrame([("A", "one")], "ticker string, sector string")
    store = FeatureStore(spark, str(tmp_path))
    store.append(spark.createDataFrame([r for r in panel if r[0] < DAYS[100]], PANEL), universe)
    read, plain = [], store.operands.read
    store.operands.read = lambda only=None: read.append(only) or plain(only)
    store.append(spark.createDataFrame([r for r in panel if r[0] == DAYS[100]], PANEL), universe)
    first = f"{DAYS[100] - dt.timedelta(days=7 * 12):%Y-%m}"
    assert read and all(only and min(only) >= first for only in read)


def test_failures_and_late_bars(spark, panel, tmp_path):
    """An append that fails between its tables can be brought again, with and without a batch number."""
    universe = spark.createDataFrame([("A", "one")], "ticker string, sector string")
    cut = [DAYS[80], DAYS[90], DAYS[110 - 1]]
    frame = lambda lo, hi: spark.createDataFrame([r for r in panel if lo <= r[0] < hi], PANEL)
    store = FeatureStore(spark, str(tmp_path))
    store.append(frame(DAYS[0], cut[0]), universe)
    for k, (lo, hi, token) in enumerate(((cut[0], cut[1], ()), (cut[1], cut[2], ("w", 1)))):
        table = (store.features, store.tails)[k]
        plain = table._commit

        def broken(*args):
            raise RuntimeError("lost")

        table._commit = broken
        with pytest.raises(RuntimeError, match="lost"):
            store.append(frame(lo, hi), universe, *token)
        table._commit = plain
        assert store.append(frame(lo, hi), universe, *token)
    order = lambda df: df.orderBy("date", "ticker").collect()
    _close(order(store.read()), order(P.build_features(frame(DAYS[0], cut[2]), universe)))
    before = store.tails.state()
    with pytest.raises(ValueError, match="not newer"):
        store.append(frame(cut[0], DAYS[85]), universe)
    assert store.tails.state() == before


def test_keys_of_new_bars_say_what_is_written(spark, tmp_path, monkeypatch):
    """Which months a batch touches is known from its bars: their operands are not made for it."""
    asked, plain = [], FeatureStore._operands

    class Watched:
        def __init__(self, rows):
            self.rows = rows

        def __getattr__(self, name):
            asked.append(name)
            return getattr(self.rows, name)

    monkeypatch.setattr(FeatureStore, "_operands", lambda self, *a: Watched(plain(self, *a)))
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.unionByName", (lambda old: lambda a, b, **k: old(a, b.rows if isinstance(b, Watched) else b, **k))(type(spark.range(1)).unionByName))
    bars = spark.range(80).selectExpr("date_add(date'2024-01-01', cast(id as int)) as date", "'a' as ticker", *(f"cast(id % 7 + 1 as double) as {c}" for c in ("open", "high", "low", "close", "volume")))
    assert FeatureStore(spark, str(tmp_path)).append(bars, spark.createDataFrame([("a", "x")], "ticker string, sector string"))
    assert asked == []
