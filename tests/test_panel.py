import datetime as dt
import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import formula as X
from ridgeline.operators import backtest as B
from ridgeline.operators import combine as C
from ridgeline.operators import features as P
from ridgeline.operators import folds as V
from ridgeline.operators import ic as I
from ridgeline.operators import monitor as D
from ridgeline.operators import orderbook as O
from ridgeline.operators import selection as L
from ridgeline.operators import significance as G
from ridgeline import schema
from ridgeline.plans import mining as N
from ridgeline.plans import serving as R2
from ridgeline.plans.oracles import oracle_sql
from ridgeline.plans.queries import queries
from ridgeline.sources import providers as R
from ridgeline.sources import store
from ridgeline.sources import testdata as T

SF = "/root/testdata/sf0.001"


def dated(rows):
    return pd.DataFrame(rows)


def one_ticker(spark, closes, volumes=None):
    days = pd.date_range("2024-01-01", periods=len(closes)).date
    rows = [(d, "A", c, c, c, c, v) for d, c, v in zip(days, closes, volumes or [1.0] * len(closes), strict=True)]
    return spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume double")


def column(df, name):
    return [r[0] for r in df.orderBy("date").select(name).collect()]


def test_return_pads_missing_closes(spark):
    assert column(P.with_operands(one_ticker(spark, [1.0, None, 2.0, 3.0]), ["ret_1d"]), "ret_1d") == [None, 0.0, 1.0, 0.5]


def test_decayed_mean_against_pandas(spark):
    rng = np.random.default_rng(3)
    for closes, h in (([1.0, 2.0, None, 4.0], 5), (rng.uniform(50, 60, 3000).tolist(), 5)):
        panel = one_ticker(spark, closes)
        want = pd.Series(closes, dtype=float).ewm(halflife=h).mean()
        assert np.allclose(column(P.with_operands(panel, [f"ewma_close_{h}"]), f"ewma_close_{h}"), want, rtol=1e-12)


def test_rolling_correlation_of_constant_window(spark):
    got = column(P.with_operands(one_ticker(spark, [1.0] * 11 + [2.0], list(map(float, range(12)))), ["corr_close_volume_10"]), "corr_close_volume_10")
    assert got[:11] == [None] * 11 and got[11] == pytest.approx(np.corrcoef([1.0] * 9 + [2.0], range(10))[0, 1])


def test_degenerate_dates_by_policy(spark):
    rows = spark.createDataFrame([("d1", 1.0, 0.1), ("d1", 1.0, 0.2), ("d2", 1.0, 0.1), ("d2", 2.0, 0.2), ("d2", 5.0, 0.4)], "date string, p double, y double")
    assert {r.date: r.ic for r in I.daily_ic(rows, "p", "y").collect()}["d1"] == 0.0
    assert [r.date for r in I.daily_ic(rows, "p", "y", policy="skip").collect()] == ["d2"]


def test_folds_and_embargo():
    assert V.fold_bounds(2450, 5, 0.4) == [980, 1274, 1568, 1862, 2156, 2450]
    folds = V.make_folds(list(range(100)), 5, 0.4, embargo=5)
    assert all(f.train_cutoff + 5 < f.test_start for f in folds) and [f.test_end for f in folds][-1] == 99


def test_quantile_buckets_against_pandas(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for k in range(12):
        alpha = rng.integers(0, 15, 60).astype(float) if k % 2 else rng.normal(size=60)
        ret = rng.normal(size=60)
        rows += [(f"d{k:02}", float(a), float(r)) for a, r in zip(alpha, ret, strict=True)]
        bucket = pd.qcut(pd.Series(alpha), 10, labels=False, duplicates="drop")
        want[f"d{k:02}"] = ret[bucket == bucket.max()].mean() - ret[bucket == bucket.min()].mean() - 0.002
    frame = spark.createDataFrame(rows, "date string, alpha double, fwd_ret double")
    got = {r.date: r.ret for r in B.decile_periods(frame, horizon=1).collect()}
    assert got == pytest.approx(want)
    flat = spark.createDataFrame([("d", 1.0, float(i)) for i in range(30)], "date string, alpha double, fwd_ret double")
    assert B.decile_periods(flat).first().ret is None


def test_metrics_of_known_returns(spark):
    ret = [0.01, -0.02, 0.03, 0.005]
    m = B.metrics(spark.createDataFrame([(k, r, r) for k, r in enumerate(ret)], "date int, ret double, long_only double")).first()
    eq = np.prod(1 + np.array(ret))
    assert m.equity_multiple == pytest.approx(eq) and m.ann_return == pytest.approx(eq ** (50.4 / 4) - 1) and m.sharpe == pytest.approx(m.ann_return / (np.std(ret) * 50.4**0.5))
    assert m.period_returns == ret


def test_expected_best_and_psr():
    trials = [0.04120, 0.02924, 0.03835, 0.02763, 0.09363, 0.04066]
    assert G.expected_best(trials) > 0
    assert G.probabilistic_sharpe(295, 0.06385278, 0.341778, 3.783674, 0.03180253) == pytest.approx(0.71049784, abs=2e-6)


def test_formula_syntaxes_agree_and_round_trip(spark):
    rows = spark.createDataFrame([(1.0, 4.0), (-2.0, 0.0), (None, 3.0)], "a double, b double")
    pairs = [("add(a, mul(b, 2))", "a + b * 2"), ("sub(neg(a), b)", "-a - b"), ("div(abs(a), sqrt(b))", "abs(a) / sqrt(b)"), ("square(a)", "a * a"), ("a", "(a)"), ("-1.5e-3", "-0.0015")]
    for prefix, infix in pairs:
        p, q = X.parse(prefix), X.parse(infix)
        assert X.from_json(X.to_json(p)) == p and X.parse(X.show(p)) == p and X.parse(X.show(q, infix=True)) == q
        got = rows.select(X.compile_text(prefix).alias("x"), X.compile_text(infix).alias("y")).collect()
        assert all(r.x == r.y for r in got)
    assert [r[0] for r in rows.select(X.compile_text("div(a, b)", "protected")).collect()] == [0.25, 1.0, None]
    with pytest.raises(ValueError):
        X.parse("add(a)")
    tree = X.explain_nodes(rows.limit(1).withColumn("ticker", F.lit("A")), "add(a, sqrt(b))").collect()
    assert X.render(tree)[0] == "add(a, sqrt(b)) = 3" and X.render(tree)[-1].startswith("   └─ b")


def test_lasso_keeps_constant_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = 0.5 + x @ [0.3, 0.0] + rng.normal(size=400) * 0.01
    frame = spark.createDataFrame([(1.0, float(a), float(b), float(t)) for (a, b), t in zip(x, y, strict=True)], "c double, a double, b double, y double")
    g = C.gram(frame, ["c", "a", "b"], "y")
    w = C.descend(g, 1e-3)
    assert w[0] == pytest.approx(0.5, abs=0.01) and w[1] == pytest.approx(0.3, abs=0.01) and abs(w[2]) < 0.002
    assert all(C.objective(g, w, 1e-3) <= C.objective(g, w + d, 1e-3) + 1e-12 for d in np.eye(3) * 1e-4)


def test_wide_grams_are_the_sums(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    frame = spark.createDataFrame([(int(k % 2), *map(float, r)) for k, r in enumerate(x)], "part int, a double, b double, y double").repartition(3)
    for got, part in zip(C.wide_grams(frame, ["a", "b"], "y", "part").values(), (x[::2], x[1::2]), strict=True):
        assert got.n == 30 and np.allclose(got.xx, part[:, :2].T @ part[:, :2]) and np.allclose(got.xy, part[:, :2].T @ part[:, 2]) and np.isclose(got.yy, part[:, 2] @ part[:, 2])


def test_folds_fitted_together_are_those_alone(spark):
    from ridgeline.operators import models as M

    rng = np.random.default_rng(8)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(30)]
    rows = [(d, f"t{t}", *map(float, x), float(0.4 * x[0] - 0.1 * x[1] + rng.normal(0, 0.2))) for d in days for t in range(9) if rng.random() < 0.9 for x in [rng.normal(size=3)]]
    frame = spark.createDataFrame(rows, "date date, ticker string, a double, b double, c double, fwd_ret double").repartition(5).cache()
    cutoffs = [days[9], days[17], days[29]]
    for cutoff, fit in zip(cutoffs, M.elastic_nets(frame, cutoffs, ["a", "b", "c"]), strict=True):
        alone = M.elastic_net(frame.where(F.col("date") <= F.lit(cutoff)), ["a", "b", "c"])
        assert fit.weights == pytest.approx(alone.weights, abs=1e-9) and fit.intercept == pytest.approx(alone.intercept, abs=1e-9)
        assert (fit.penalty, fit.ratio) == pytest.approx((alone.penalty, alone.ratio))
    # the runs are those that a sort of the training rows gives
    parts = M.training_parts(frame, cutoffs, 3).collect()
    for k, cutoff in enumerate(cutoffs):
        train = sorted((r.ticker, r.date) for r in parts if r.date <= cutoff)
        assert {(r.ticker, r.date): r._part // 4**k % 4 for r in parts} == {(r.ticker, r.date): 0 for r in parts} | {key: n * 3 // len(train) + 1 for n, key in enumerate(train)}
    folds = V.make_folds(days, 3, 0.4)
    scored, _ = M.elastic_net_folds(frame, folds, ["a", "b", "c"])
    for f in folds:
        alone, _ = M.elastic_net_fit_predict(frame.where(F.col("date") <= F.lit(f.train_cutoff)), frame.where(F.col("date").between(F.lit(f.test_start), F.lit(f.test_end))), ["a", "b", "c"])
        want = {(r.date, r.ticker): r.alpha for r in alone.collect()}
        got = {(r.date, r.ticker): r.alpha for r in scored.where(F.col("fold") == f.fold).collect()}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-9) for x in got)
    frame.unpersist()


def test_descents_together_are_those_alone():
    rng = np.random.default_rng(2)
    grams = []
    for n in (50, 80):
        x = rng.normal(size=(n, 4)) * [1, 1, 0, 2]
        y = x @ [0.5, -1, 0, 0.2] + rng.normal(size=n)
        grams.append(C.Gram(n, x.T @ x, x.T @ y, float(y @ y)))
    got = C.descend_together(grams, np.array([0.1, 0.02]), np.array([1.0, 0.5]), 5000, 1e-13, np.zeros((2, 4)))
    for row, g, a, r in zip(got, grams, (0.1, 0.02), (1.0, 0.5), strict=True):
        assert np.allclose(row, C.descend(g, a, r), atol=1e-9)


def test_capped_list_is_the_greedy_one(spark):
    rng = np.random.default_rng(5)
    rows = [(f"t{k:02}", f"s{rng.integers(4)}", float(rng.integers(30))) for k in range(60)]
    want, seen = [], {}
    for t, s, a in sorted(rows, key=lambda r: (-r[2], r[0])):
        if len(want) < 10 and seen.get(s, 0) < 3:
            want.append(t)
            seen[s] = seen.get(s, 0) + 1
    frame = spark.createDataFrame([*rows, ("nan", "s0", float("nan"))], "ticker string, sector string, alpha double")
    assert [r.ticker for r in L.top(frame, 10, 3).collect()] == want
    assert L.top(frame, 99, ascending=True).collect()[-1].ticker == "nan"


def test_resolve_fills_only_open_known_outcomes(spark):
    log = spark.createDataFrame([("d", "A", 1.0, None, False), ("d", "B", 1.0, 0.5, True), ("d", "C", 1.0, None, False)], "predict_date string, ticker string, alpha double, realized_fwd_ret double, resolved boolean")
    new = spark.createDataFrame([("d", "A", 0.1), ("d", "B", 0.9), ("d", "C", float("nan"))], "date string, ticker string, fwd_ret double")
    got = {r.ticker: (r.realized_fwd_ret, r.resolved) for r in D.resolve(log, new).collect()}
    assert got == {"A": (0.1, True), "B": (0.5, True), "C": (None, False)}


def test_drift_needs_three_weeks_and_normal_cdf(spark):
    ics = spark.createDataFrame([(k, v) for k, v in enumerate([0.0, 0.0, -0.5, -0.5])], "date int, ic double")
    got = [r.status for r in D.drift_timeline(ics, 0.1, 0.1).orderBy("as_of").collect()]
    assert got == ["insufficient_data"] * 2 + ["drift_flagged"] * 2
    z = spark.createDataFrame([(x / 4,) for x in range(-40, 41)], "z double").select("z", D.normal_cdf(F.col("z")).alias("p")).collect()
    assert all(r.p == pytest.approx(0.5 * math.erfc(-r.z / 2**0.5), rel=1e-5 if r.z <= -7 else 1e-9) for r in z)


def test_shallow_and_empty_books(spark):
    level = "array<struct<price:double,size:double>>"
    rows = spark.createDataFrame([("X", [(99.0, 1.0), (98.0, 2.0)], [(101.0, 3.0)]), ("Y", [(1.0, 0.0)], [(2.0, 0.0)]), ("Z", [], [])], f"symbol string, bids {level}, asks {level}")
    x, y, z = O.book_features(rows).orderBy("symbol").collect()
    assert (x.mid_price, x.spread, x.bid_depth_top5, x.ask_depth_top25) == (100.0, 2.0, 3.0, 3.0) and x.microprice == pytest.approx((99 * 3 + 101) / 4)
    assert y.imbalance_top5 == 0.0 and y.microprice is None and z.best_bid is None and z.imbalance_top10 == 0.0


def test_providers_and_payloads(spark):
    page = "<table><tr><th>Symbol</th><th>GICS Sector</th></tr><tr><td>BRK.B</td><td>Financials</td></tr></table><table><tr><td>no</td></tr></table>"
    assert [tuple(r) for r in R.universe_from_html(spark, page).collect()] == [("BRK-B", "Financials")]
    with pytest.raises(ValueError):
        R.market("nowhere")
    raw = spark.createDataFrame([("B", '{"bids": [["9.5", "2", 3], ["9", "1", 1]], "asks": [["10", "4", 1]]}')], "symbol string, payload string").withColumn("timestamp", F.current_timestamp())
    book = R.read_level2(raw, 1).first()
    assert [tuple(x) for x in book.bids] == [(9.5, 2.0)] and [tuple(x) for x in book.asks] == [(10.0, 4.0)]
    keyed = raw.withColumn("payload", F.lit('{"error": [], "result": {"XYZ": {"asks": [["2", "1", "7"]], "bids": []}}}'))
    assert [tuple(x) for x in R.read_keyed(keyed).first().asks] == [(2.0, 1.0)]
    with pytest.raises(Exception, match="order book error"):
        R.read_keyed(keyed.withColumn("payload", F.lit('{"error": ["EGeneral"], "result": null}'))).collect()


def test_sources_behind_addresses(spark, tmp_path):
    from ridgeline.sources import web
    from ridgeline.streaming.flows import collect_books

    (tmp_path / "page.html").write_text("<table><tr><th>Symbol</th><th>GICS Sector</th></tr><tr><td>BRK.B</td><td>Financials</td></tr><tr><td>ZZZ</td><td>Energy</td></tr></table>")
    (tmp_path / "BRK-B.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\n2024-01-03,,,,,\n2024-01-04,2,3,1,2.5,20\n")
    base = tmp_path.as_uri()
    market = R.market("web", f"{base}/page.html", base + "/{ticker}.csv", str(tmp_path / "universe"))
    assert sorted(r.ticker for r in market.universe(spark).collect()) == ["BRK-B", "ZZZ"]
    (tmp_path / "page.html").write_text("<table><tr><th>Symbol</th><th>GICS Sector</th></tr><tr><td>NEW</td><td>Energy</td></tr></table>")
    assert market.universe(spark).count() == 2 and [r.ticker for r in market.universe(spark, refresh=True).collect()] == ["NEW"]
    bars = market.bars(spark, ["BRK-B", "ZZZ"]).orderBy("date").collect()
    assert [(r.ticker, r.close, r.volume) for r in bars] == [("BRK-B", 1.5, 10.0), ("BRK-B", 2.5, 20.0)]
    with pytest.raises(Exception, match="ZZZ"):
        web.payloads(spark, {"ZZZ": f"{base}/ZZZ.csv"}).collect()

    (tmp_path / "book.json").write_text('{"bids": [["9.5", "2"]], "asks": [["10", "4"]]}')
    books = R.order_books("web_books", {"X": f"{base}/book.json"})
    assert books.snapshots(spark).first().symbol == "X"
    books = R.order_books("web_books", {"X": f"{base}/book.json"})
    with pytest.raises(Exception, match="log"):
        books.snapshots(spark, stream=True).writeStream.format("noop").trigger(availableNow=True).start().awaitTermination(60)
    books.options = {"log": str(tmp_path / "fetched")}
    collect_books(books.snapshots(spark, stream=True), str(tmp_path / "features"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "features")).first().mid_price == 9.75


def test_book_stream_appends(spark, tmp_path):
    from ridgeline.streaming.flows import collect_books

    level = "array<struct<price:double,size:double>>"
    rows = spark.createDataFrame([("X", [(99.0, 1.0)], [(101.0, 3.0)])], f"symbol string, bids {level}, asks {level}")
    rows.write.parquet(str(tmp_path / "in"))
    collect_books(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().mid_price == 100.0


def test_search_is_repeatable(spark):
    rng = np.random.default_rng(2)
    rows = [(d, float(a), float(b), float(a - b + rng.normal() * 0.1)) for d in range(6) for a, b in rng.normal(size=(20, 2))]
    frame = spark.createDataFrame(rows, "date int, a double, b double, fwd_ret double").cache()
    engine = N.Genetic(N.Settings(population=12, generations=2))
    pool = engine.mine(frame, ["a", "b"], "fwd_ret", 1)
    assert pool.formulas == engine.mine(frame, ["a", "b"], "fwd_ret", 1).formulas and pool.scores[0] > 0.5


@pytest.mark.parametrize("name", ["rolling_std", "ewma", "features_full", "daily_ic", "feature_screen", "top_n_sector_capped", "explain_ticker", "book_features", "drift_timeline", "decile_sector_neutral", "global_rank_ic", "pool_report", "oos_sample", "deflated_sharpe", "least_squares"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries()[name](spark, SF).toPandas()
    want = con.execute(oracle_sql()[name]).df()[list(got.columns)]
    keys = [c for c in got.columns if got[c].dtype == object or c in ("bucket", "as_of")]
    got, want = (x.assign(**{c: x[c].astype(str).str[: 10 if "date" in c else None] for c in keys}).sort_values(keys).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in got.columns:
        if c in keys or got[c].dtype == bool:
            assert (got[c] == want[c]).all()
        else:
            assert np.allclose(got[c].astype(float), want[c].astype(float), atol=2e-6, equal_nan=True), c


def test_decayed_mean_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 300)
    rng = np.random.default_rng(4)
    closes = [None, None, *rng.uniform(50, 60, 1300).tolist()]
    closes[900:1250] = [None] * 350
    got = column(P.with_operands(one_ticker(spark, closes), ["ewma_close_5"]), "ewma_close_5")
    want = pd.Series(closes, dtype=float).ewm(halflife=5, ignore_na=False).mean()
    assert got[:2] == [None, None] and None not in got[2:] and np.allclose(got[2:], want[2:], rtol=1e-12)
    with pytest.raises(ValueError):
        P.with_decayed_means(one_ticker(spark, closes), [50])


def test_ticker_outside_the_universe(spark):
    rows = P.attach_sector(one_ticker(spark, [1.0]), spark.createDataFrame([("B", "Energy")], "ticker string, sector string"))
    assert rows.first().sector == "Unknown"


def test_stored_tables_need_no_shuffle(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "Exchange" not in plan(P.with_operands(T.bars(spark, SF)))
    features = T.features(spark, SF)
    ics = plan(I.daily_ic(features, "vwap", "fwd_ret"))
    assert "Exchange" not in ics and "ReadSchema: struct<date:date,vwap:double,fwd_ret:double>" in ics
    assert "PushedFilters: [IsNotNull(date), EqualTo(date" in plan(T.operands(spark, SF).where("date = date'2000-01-03'"))
    same = T.features(spark, SF)
    assert same.inputFiles() == features.inputFiles()
    store.forget(spark, SF)
    assert T.features(spark, SF).inputFiles() != same.inputFiles()


def test_stored_tables_follow_their_sources(spark, tmp_path):
    """A changed file, or a table too old, is built anew by itself, and the old files go."""
    for name in ("lineitem", "supplier", "nation", "region"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    first = T.bars(spark, str(tmp_path))
    n, files = first.count(), first.inputFiles()
    assert T.bars(spark, str(tmp_path)).inputFiles() == files
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_suppkey <= 3")
    lines.write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    again = T.bars(spark, str(tmp_path))
    assert again.count() == T.panel(spark, str(tmp_path)).count() < n
    assert not any(Path(f.removeprefix("file://")).exists() for f in files)
    features = T.features(spark, str(tmp_path)).inputFiles()
    spark.read.parquet(f"{SF}/supplier.parquet").where("s_suppkey <= 2").write.mode("overwrite").parquet(f"{tmp_path}/supplier.parquet")
    assert T.bars(spark, str(tmp_path)).inputFiles() == again.inputFiles() and T.features(spark, str(tmp_path)).inputFiles() != features
    build = lambda: (spark.range(3).withColumnRenamed("id", "k"), 2)
    old = store.stored(spark, str(tmp_path), "aged", "k", "k", build, ["lineitem"], max_age=3600).inputFiles()
    assert store.stored(spark, str(tmp_path), "aged", "k", "k", build, ["lineitem"], max_age=3600).inputFiles() == old
    assert store.stored(spark, str(tmp_path), "aged", "k", "k", build, ["lineitem"], max_age=0).inputFiles() != old
    store.forget(spark, str(tmp_path))


def test_live_rows_are_the_last_bars(spark):
    operands = T.operands(spark, SF)
    last = operands.agg(F.max("date")).first()[0]
    live = P.live_latest(operands)
    assert {r.date for r in live.collect()} == {last} and T.features(spark, SF).agg(F.max("date")).first()[0] < last
    slow = P.latest(P.live_features(T.panel(spark, SF), T.universe(spark, SF)))
    assert {r.ticker: round(r.vwap, 9) for r in live.collect()} == {r.ticker: round(r.vwap, 9) for r in slow.collect()}


def test_stored_model_and_its_checks(spark, tmp_path):
    model = R2.StoredModel(["vwap + mom_60", "ret_1d"], [0.5, 0.0], ["vwap", "mom_60", "ret_1d"])
    R2.save_model(spark, str(tmp_path / "m"), model)
    assert R2.load_model(spark, str(tmp_path / "m")) == model
    with pytest.raises(ValueError, match="no model"):
        R2.load_model(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="2 formulas, 1 weights"):
        R2.StoredModel(model.formulas, [1.0], model.features).check()
    with pytest.raises(ValueError, match="mom_60"):
        R2.StoredModel(model.formulas, model.weights, ["vwap", "ret_1d"]).check()
    with pytest.raises(ValueError, match="lacks columns"):
        R2.score_live(T.operands(spark, SF).drop("mom_60"), model)
    with pytest.raises(ValueError, match="no formula"):
        R2.explain_ticker(T.operands(spark, SF), R2.StoredModel(["vwap"], [0.0], ["vwap"]), "1")


def test_both_sides_are_the_two_lists(spark):
    rng = np.random.default_rng(5)
    rows = [(f"t{k:02}", f"s{rng.integers(4)}", float(rng.integers(20))) for k in range(50)] + [("x", "s0", None), ("nan", "s1", float("nan"))]
    frame = spark.createDataFrame(rows, "ticker string, sector string, alpha double")
    for cap in (None, 2):
        got = {(r.ticker, r.side) for r in L.both_sides(frame, 6, cap).collect()}
        assert got == {(r.ticker, s) for s, up in (("long", False), ("short", True)) for r in L.top(frame, 6, cap, up).collect()}


def test_global_rank_correlation_with_ties(spark):
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 40, 3000).astype(float), rng.normal(size=3000)
    y[:1500] += x[:1500] / 10
    frame = spark.createDataFrame([*((float(a), float(b)) for a, b in zip(x, y, strict=True)), (None, 1.0), (1.0, None)], "p double, y double")
    want = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    assert I.global_corr(frame, "p", "y", "spearman").first().ic == pytest.approx(want, abs=1e-12)
    assert I.global_corr(frame.limit(0), "p", "y", "spearman").first().ic == 0.0


def test_population_ic_by_rank(spark):
    rng = np.random.default_rng(9)
    rows = [(d, float(a), float(b), float(a + rng.normal())) for d in range(5) for a, b in rng.normal(size=(30, 2))]
    frame = spark.createDataFrame(rows, "date int, a double, b double, fwd_ret double")
    nodes = [X.parse("a"), X.parse("mul(a, b)"), X.parse("0.5")]
    got = N.population_ic(frame, nodes, "fwd_ret", "protected", "spearman")
    data = pd.DataFrame(rows, columns=["date", "a", "b", "y"]).assign(ab=lambda t: t.a * t.b)
    want = [np.mean([t[c].rank().corr(t.y.rank()) for _, t in data.groupby("date")]) for c in ("a", "ab")]
    assert got == pytest.approx([*want, 0.0])


def test_pools_of_several_seeds_hold_each_formula_once(spark):
    class Fixed:
        def mine(self, rows, features, y, seed):
            return N.Pool([f"a{seed % 3}", "b"], [seed / 10, 0.5], "plain")

    pool = N.mine_seeds(Fixed(), None, [], "y")
    assert pool.formulas == ["a0", "b", "a1", "a2"] and pool.scores == [0.0, 0.5, 0.1, 0.2] and pool.dialect == "plain"


def test_trials_from_fold_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"sharpe": 0.5, "fold": 1}, {"sharpe": NaN}, {"sharpe": 1.5}, {"other": 1}]')
    (tmp_path / "b.json").write_text('[{"sharpe": -1.0}]')
    got = {r.trial: r.sharpe for r in G.per_period_trials(G.read_trials(spark, {n: str(tmp_path / f"{n}.json") for n in "ab"})).collect()}
    assert got == pytest.approx({"a": 1.0 / 50.4**0.5, "b": -1.0 / 50.4**0.5})


def test_feature_subsets():
    assert schema.feature_columns(["date", "ticker", "close", "vwap", "sector", "fwd_ret", "mom_60"]) == ["vwap", "mom_60"]
    assert schema.resolve_subset(None, ["a"]) == ["a"] and schema.resolve_subset(" a, b", ["a", "b", "c"]) == ["a", "b"] and schema.resolve_subset("preflight", ["a"], ["x"]) == ["x"]
    for bad in ("a,z", "preflight"):
        with pytest.raises(ValueError):
            schema.resolve_subset(bad, ["a"])


def test_global_rank_correlation_reads_the_rows_three_times(spark):
    import random

    from ridgeline.operators.ic import global_corr

    rng = random.Random(5)
    data = [(float(rng.randrange(40)), rng.gauss(0, 1) if k % 3 else 0.5) for k in range(900)] + [(None, 1.0), (1.0, None)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.createDataFrame(data, "p double, y double").repartition(3).mapInArrow(seen, "p double, y double")
    ic = global_corr(rows, "p", "y", "spearman").first().ic
    ranks = []
    for v in zip(*data[:900], strict=True):
        v = np.array(v)
        ranks.append((v[:, None] > v).sum(1) + ((v[:, None] == v).sum(1) + 1) / 2)
    assert ic == pytest.approx(np.corrcoef(*ranks)[0, 1], abs=1e-12)
    assert read.value <= 3 * len(data)
    for flat in (rows.where("p is null"), rows.where("p = 3.0")):
        assert global_corr(flat, "p", "y", "spearman").first().ic == 0.0


def test_folds_of_a_model_are_fitted_side_by_side(spark, monkeypatch):
    import threading

    from ridgeline.operators import models as M
    from ridgeline.plans.validation import baseline

    met = threading.Barrier(2, timeout=60)

    def fit(train, test, features):
        met.wait()  # breaks where one fold waits for the other
        return test.withColumn("alpha", F.col("a")), train.sparkSession.createDataFrame([("a", 1.0)], "feature string, importance double")

    monkeypatch.setitem(M.FIT_PREDICT, "together", fit)
    days = [dt.date(2020, 1, 6) + dt.timedelta(weeks=k) for k in range(12)]
    frame = spark.createDataFrame([(d, f"t{k}", "s", float(k), float(k)) for d in days for k in range(12)], "date date, ticker string, sector string, a double, fwd_ret double")
    found, importance = baseline(frame, ["a"], V.make_folds(days, 2, 0.4), "together")
    assert [(r.fold, round(r.test_ic, 9)) for r in found.orderBy("fold").collect()] == [(1, 1.0), (2, 1.0)]
    assert sorted(r.fold for r in importance.collect()) == [1, 2]


def test_preflight_of_a_clear_signal(spark):
    from ridgeline.plans.validation import preflight

    rng = np.random.default_rng(3)
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(50)]
    rows = [(d, f"t{i:02}", "s", float(a), float(b), float(0.2 * a + rng.normal() * 0.05)) for d in days for i, (a, b) in enumerate(rng.normal(size=(25, 2)))]
    frame = spark.createDataFrame(rows, "date date, ticker string, sector string, a double, b double, fwd_ret double").cache()
    found = preflight(frame, ["a", "b"], V.make_folds(days, 2, 0.4), 1, "elasticnet")
    assert found["go"] and found["recommended_top_n"] == ["a"] and found["elasticnet"]["mean_ic"] > 0.9 and "worth" in found["reasoning"][0]
    frame.unpersist()


def test_logs_and_reports_round_trip(spark, tmp_path):
    log = spark.createDataFrame([(dt.date(2024, 1, 1), "A", 1.0, None, False), (dt.date(2024, 1, 1), "B", 2.0, None, False)], schema.PREDICTIONS)
    path = str(tmp_path / "log")
    store.append_log(log.where("ticker = 'A'"), path)
    store.append_log(log.where("ticker = 'B'"), path)
    assert store.read_log(spark, path, schema.PREDICTIONS).count() == 2
    new = spark.createDataFrame([(dt.date(2024, 1, 1), "A", 0.25)], "date date, ticker string, fwd_ret double")
    got = D.resolve(store.read_log(spark, path, schema.PREDICTIONS), new)
    assert sorted((r.ticker, r.realized_fwd_ret, r.resolved) for r in got.collect()) == [("A", 0.25, True), ("B", None, False)]
    store.write_report(log, str(tmp_path / "report"))
    assert store.read_report(spark, str(tmp_path / "report")).count() == 2


def test_streamed_outcomes_meet_predictions(spark, tmp_path):
    from ridgeline.streaming.flows import resolve_stream

    t0 = dt.datetime(2024, 1, 1)
    day = dt.timedelta(days=1)
    p = spark.createDataFrame([(t0, "A", 1.0), (t0, "B", 2.0), (t0 + 60 * day, "C", 0.0)], "predict_ts timestamp, ticker string, alpha double")
    o = spark.createDataFrame([(t0 + 5 * day, "A", 0.1), (t0 + 30 * day, "B", 0.9), (t0 + 61 * day, "Z", 0.0)], "outcome_ts timestamp, ticker string, fwd_ret double")
    for name, rows in (("p", p), ("o", o)):
        rows.coalesce(1).write.parquet(str(tmp_path / name))
    streams = [spark.readStream.schema(x.schema).parquet(str(tmp_path / n)) for n, x in (("p", p), ("o", o))]
    out = resolve_stream(*streams).writeStream.format("memory").queryName("met").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = {(r.ticker, r.fwd_ret, r.resolved) for r in spark.table("met").collect()}
    assert ("A", 0.1, True) in got and ("B", None, False) in got


def test_validation_goes_over_all_folds(spark, monkeypatch):
    from ridgeline.plans import queries as Q

    seen = {}
    for name in ("walk_forward", "complexity_sweep", "baseline"):
        monkeypatch.setattr(Q.W, name, lambda rows, features, folds, *a, name=name, **b: seen.update({name: [f.fold for f in folds]}) or [None])
    for query in (Q.walk_forward, Q.complexity_sweep, Q.elasticnet_baseline):
        query(spark, SF)
    assert seen == dict.fromkeys(("walk_forward", "complexity_sweep", "baseline"), [1, 2, 3, 4, 5])


def test_average_ranks_sort_once(spark):
    from ridgeline.functions.guards import average_rank

    rows = spark.createDataFrame([("a", 2.0), ("a", None), ("a", 2.0), ("a", -1.0), ("b", None), ("b", 5.0)], "k string, v double").withColumn("r", average_rank("v", "k"))
    assert rows._jdf.queryExecution().sparkPlan().toString().count("Window") == 1
    assert sorted((r.k, r.v, r.r) for r in rows.collect() if r.v is not None) == [("a", -1.0, 1.0), ("a", 2.0, 2.5), ("a", 2.0, 2.5), ("b", 5.0, 1.0)]
    assert all(r.r is None for r in rows.collect() if r.v is None)


def test_overall_ranks_hold_no_value_against_every_edge(spark):
    """Runs of values are found by search: no expression with a lambda over all edges for each value."""
    frame = spark.range(3000).select((F.col("id") % 700).cast("double").alias("p"), ((F.col("id") * 37) % 911).cast("double").alias("y"))
    got = I.global_corr(frame, "p", "y", "spearman")
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.first().ic == pytest.approx(frame.toPandas().rank().corr().iloc[0, 1], abs=1e-12)


def test_bars_meet_by_ticker_once_and_features_alone_store_no_operands(spark):
    store.forget(spark, SF)
    features = T.features(spark, SF)
    assert {name for app, d, name in store._stored if d == SF} == {"bars", "features"}
    alone = {(r.date, r.ticker): r.asDict() for r in features.collect()}
    T.operands(spark, SF)
    found = (spark.sparkContext.applicationId, SF, "features")
    store._drop(spark, found)
    again = T.features(spark, SF)
    assert set(again.columns) == {*T.KEYS, *schema.FEATURE_COLS, "fwd_ret", "fwd_ret_neutral"} and again.count() == len(alone)
    for r in again.collect():
        assert all(v == pytest.approx(alone[r.date, r.ticker][c], abs=1e-9) for c, v in r.asDict().items() if isinstance(v, float))
    placed = T.panel(spark, SF, 6)
    assert placed._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1 and placed.rdd.getNumPartitions() == 6
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, T.panel(spark, SF).collect()))
    store.forget(spark, SF)
