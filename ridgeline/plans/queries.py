"""Registered queries of the panel operators, over panels, universes and books adapted from the star-schema tables.

Bars, operands and features are stored tables (see ``ridgeline.sources.testdata``): the first query of a session that
needs one builds it, the others read it. ``features_full`` and ``store_*`` are the builds themselves.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import formula as X
from ridgeline.functions.guards import correlation, rounded
from ridgeline.operators import backtest as B
from ridgeline.operators import combine as C
from ridgeline.operators import features as P
from ridgeline.operators import folds as V
from ridgeline.operators import ic as I
from ridgeline.operators import models as M
from ridgeline.operators import monitor as D
from ridgeline.operators import orderbook as O
from ridgeline.operators import screen as S
from ridgeline.operators import selection as L
from ridgeline.operators import significance as G
from ridgeline.operators.fitness import register_fitness
from ridgeline.plans import mining as N
from ridgeline.plans import serving as R
from ridgeline.plans import validation as W
from ridgeline.plans.increments import FeatureStore
from ridgeline.schema import FEATURE_COLS
from ridgeline.sources import testdata as T
from ridgeline.sources.store import forget, sampled, shared_dir
from ridgeline.streaming import drift as DS
from ridgeline.streaming.log import EVENTS, PredictionLog

#: Sharpe ratios per period of the configurations that the deflated ratio counts as tried.
TRIALS = [0.01, 0.03, -0.02, 0.04]
#: What the registered searches may spend. The defaults of ``Settings`` (500 formulas, 25 generations, 8 seeds) are
#: 100,000 evaluations of the table, hours of work; the searches below read the same rows for a few minutes at most.
SEARCH = {"population": 40, "generations": 3, "tournament": 8}
#: The formulas that the scoring queries evaluate, and their weights; one is a constant, one has no weight.
FORMULAS = ["mean_close_10 - vwap", "sqrt(sum_volume_20 + 0.6)", "log(sum_volume_20 + 1.63)", "-delta_close_5 * 0.5", "0.9372159"]
WEIGHTS = [0.02, 0.01, 0.0, 0.03, 0.00135]
PREFIX = ["div(vwap, ret_1d)", "log(sub(mean_close_5, vwap))", "sqrt(neg(abs(mom_60)))", "inv(delta_close_5)", "max(vwap, min(mom_60, 0.25))"]
EXPLAINED = "sqrt(abs(sum_volume_20 - delta_close_5)) / 2"
#: Predictions from this date on have no outcome yet.
RESOLVED_BEFORE = date(2000, 1, 1)


def _round(df: DataFrame) -> DataFrame:
    return df.select(*(rounded(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _short_decimals(df: DataFrame, names: list[str]) -> DataFrame:
    """Means of prices, which have few digits and often lie halfway between two values of six: rounded from their first
    nine decimals, half up, which both engines see alike whatever order they add in."""
    return df.withColumns({c: F.round(F.col(c).cast("decimal(38,9)"), 6).cast("double") for c in names})


def _panel(spark, d, *names, target=False):
    return P.with_operands(T.bars(spark, d), list(names) or ["vwap"], target).select("date", "ticker", *names, *(["fwd_ret"] if target else []))


def _features(spark, d):
    return T.features(spark, d)


def _alpha(spark, d):
    return _features(spark, d).select("date", "ticker", "sector", "fwd_ret", F.round(F.col("mean_close_10") - F.col("vwap"), 9).alias("alpha"))


def _folds(rows, embargo=0):
    return V.make_folds(V.distinct_dates(rows), 5, 0.4, embargo)


def _screened(spark, d):
    rows = _features(spark, d)
    return S.fold_ics(rows, FEATURE_COLS, _folds(rows))


def _oos(spark, d):
    rows = _alpha(spark, d)
    return V.test_rows(rows, _folds(rows))


def _log(spark, d):
    """A prediction log of every fifth date; the outcomes of the last dates are still open."""
    rows = B.rebalance_rows(_alpha(spark, d))
    done = F.col("date") < F.lit(RESOLVED_BEFORE)
    return rows.select(F.col("date").alias("predict_date"), "ticker", "alpha", F.when(done, F.col("fwd_ret")).alias("realized_fwd_ret"), done.alias("resolved"))


def _search(spark, d):
    rows = _features(spark, d).select("date", "ticker", "sector", "fwd_ret", *FEATURE_COLS)
    return rows, _folds(rows)


def typical_price(spark, d):
    return _short_decimals(_panel(spark, d, "vwap"), ["vwap"])


def ret_1d(spark, d):
    return _round(_panel(spark, d, "ret_1d"))


def rolling_mean(spark, d):
    names = ["mean_close_5", "mean_close_10", "mean_close_20"]
    return _short_decimals(_panel(spark, d, *names), names)


def rolling_std(spark, d):
    return _round(_panel(spark, d, "std_close_5", "std_close_10", "std_close_20"))


def rolling_sum(spark, d):
    return _round(_panel(spark, d, "sum_volume_5", "sum_volume_10", "sum_volume_20"))


def delta(spark, d):
    return _panel(spark, d, "delta_close_5", "delta_close_10", "delta_close_20")


def ewma(spark, d):
    return _round(_panel(spark, d, "ewma_close_5", "ewma_close_10", "ewma_close_20"))


def momentum(spark, d):
    return _panel(spark, d, "mom_60")


def rolling_corr(spark, d):
    return _round(_panel(spark, d, "corr_close_volume_10"))


def fwd_return(spark, d):
    return _round(_panel(spark, d, target=True))


def sector_attach(spark, d):
    return P.attach_sector(T.bars(spark, d), T.universe(spark, d)).select("date", "ticker", "sector")


def sector_neutral_target(spark, d):
    rows = P.attach_sector(P.with_operands(T.bars(spark, d), ["vwap"], True), T.universe(spark, d)).where("fwd_ret is not null")
    return _round(P.sector_neutral(rows).select("date", "ticker", "sector", "fwd_ret_neutral"))


def zscore(spark, d):
    return _round(P.zscored(T.bars(spark, d), ["close", "volume"]).select("date", "ticker", "close", "volume"))


def features_full(spark, d):
    rows = P.build_features(T.bars(spark, d), T.universe(spark, d))
    return _round(rows.select("date", "ticker", "sector", *FEATURE_COLS, "fwd_ret", "fwd_ret_neutral"))


def store_bars(spark, d):
    """The bars, aggregated anew."""
    forget(spark, d)
    return T.bars(spark, d).select("date", "ticker", "open", "high", "low", "close", "volume")


def store_operands(spark, d):
    return T.operands(spark, d).select("date", "ticker", "sector", "mom_60", rounded("fwd_ret").alias("fwd_ret"))


def live_latest(spark, d):
    return _round(P.live_latest(T.operands(spark, d)).select("date", "ticker", "sector", *FEATURE_COLS))


def daily_ic(spark, d):
    return _round(I.daily_ic(_alpha(spark, d), "alpha", "fwd_ret"))


def daily_rank_ic(spark, d):
    return _round(I.daily_ic(_alpha(spark, d), "alpha", "fwd_ret", method="spearman"))


def ic_series_skip(spark, d):
    rows = _alpha(spark, d).withColumn("alpha", F.when(F.month("date") % 2 == 0, F.lit(1.0)).otherwise(F.col("alpha")))
    return _round(I.ic_series(rows, "alpha", "fwd_ret"))


def global_ic(spark, d):
    return _round(I.global_corr(_alpha(spark, d), "alpha", "fwd_ret"))


def global_rank_ic(spark, d):
    return _round(I.global_corr(_alpha(spark, d), "alpha", "fwd_ret", "spearman"))


def distinct_counts(spark, d):
    return _alpha(spark, d).agg(*(F.count_distinct(c).alias(c) for c in ("date", "ticker", "sector")))


def feature_screen(spark, d):
    return _round(S.screen(_screened(spark, d)))


def variance_flags(spark, d):
    return S.flags(S.screen(_screened(spark, d)), 0.1, 1.5).select("feature", "low_ir", "variance_flag")


def consensus_rank(spark, d):
    ics = _screened(spark, d)
    return _round(S.consensus(ics.select("feature", F.abs("ic").alias("importance")), S.screen(ics)))


def select_features(spark, d):
    chosen = S.select_features(S.screen(_screened(spark, d)), 6, -0.5, 4.0)
    return _round(chosen.select("feature", "information_ratio", "variance_ratio"))


def mean_importance(spark, d):
    return _round(S.mean_importance(_screened(spark, d).select("feature", F.col("ic").alias("importance"))))


def go_rule(spark, d):
    return _round(S.go_rule(_screened(spark, d).where("feature = 'delta_close_5'")))


def folds(spark, d):
    return V.fold_frame(spark, _folds(_alpha(spark, d)))


def embargo_split(spark, d):
    return V.fold_frame(spark, _folds(_alpha(spark, d), 5))


def time_split(spark, d):
    train, test = V.split(_alpha(spark, d), 0.2)
    sides = train.select("date", F.lit("train").alias("side")).unionByName(test.select("date", F.lit("test").alias("side")))
    return sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def decile_backtest(spark, d):
    return _round(B.decile_periods(_alpha(spark, d)))


def decile_sector_neutral(spark, d):
    return _round(B.decile_periods(_alpha(spark, d), 5, neutral=True))


def ic_weighted(spark, d):
    return _round(B.weighted_periods(_alpha(spark, d)))


def ic_weighted_sector_neutral(spark, d):
    return _round(B.weighted_periods(_alpha(spark, d), neutral=True))


def _mild(spark, d):
    """Decile periods at a hundredth of their size: the synthetic prices jump by more than equity could bear."""
    return B.decile_periods(_alpha(spark, d)).select("date", (F.col("ret") / 100).alias("ret"), (F.col("long_only") / 100).alias("long_only"))


def period_metrics(spark, d):
    return _round(B.metrics(_mild(spark, d)).drop("period_returns"))


def equity_curve(spark, d):
    return _round(B.equity_curve(_mild(spark, d)))


def psr_moments(spark, d):
    return _round(G.moments(_mild(spark, d)))


def deflated_sharpe(spark, d):
    rows = _mild(spark, d)
    if rows.count() < 2:
        return spark.createDataFrame([], "n_trials int, sharpe double, expected_best double, deflated double")
    r = G.deflated_sharpe(rows, TRIALS)
    return _round(spark.createDataFrame([tuple(r)], "n_trials int, sharpe double, expected_best double, deflated double"))


def formula_eval(spark, d):
    return _round(X.evaluate(_features(spark, d), FORMULAS).select("date", "ticker", *(f"f{k}" for k in range(len(FORMULAS)))))


def formula_eval_protected(spark, d):
    return _round(X.evaluate(_features(spark, d), PREFIX, "protected").select("date", "ticker", *(f"f{k}" for k in range(len(PREFIX)))))


def formula_dedup(spark, d):
    texts = T.table(spark, d, "part").select((F.col("p_partkey") - 1).alias("idx"), F.concat(F.lit("add(vwap, "), F.col("p_size").cast("string"), F.lit(")")).alias("formula"))
    return X.first_occurrences(texts)


def explain_nodes(spark, d):
    return _round(X.explain_nodes(P.live_latest(T.operands(spark, d)), EXPLAINED))


def explain_ticker(spark, d):
    """The weighted formulas of one name, explained: a point lookup on the last date."""
    model = R.StoredModel([EXPLAINED, "vwap"], [0.5, 0.0], FEATURE_COLS)
    return _round(R.explain_ticker(T.operands(spark, d), model, "7"))


def pool_report(spark, d):
    rows = _features(spark, d)
    train, test = V.split(rows, 0.2)
    return _round(N.pool_report(train, test, N.Pool(["delta_close_5", FORMULAS[1]], [0.0, 0.0], "plain")))


def pool_values(spark, d):
    return _round(N.pool_values(_features(spark, d), N.Pool(["mom_60", FORMULAS[1]], [0.0, 0.0], "plain")))


def gram_matrix(spark, d):
    rows = _features(spark, d)
    return _round(rows.agg(*C.gram_aggregates(FEATURE_COLS, "fwd_ret")))


def lasso_combine(spark, d):
    rows = X.evaluate(_features(spark, d), FORMULAS)
    names = [f"f{k}" for k in range(len(FORMULAS))]
    w = C.combine(rows, names, "fwd_ret", 1e-5)
    return _round(spark.createDataFrame(list(zip(FORMULAS, map(float, w), strict=True)), "formula string, weight double").where(F.abs("weight") >= 1e-10))


def least_squares(spark, d):
    """The combination without a penalty, for two formulas: coordinate descent on the Gram matrix."""
    rows = X.evaluate(_features(spark, d), FORMULAS[:1] + FORMULAS[3:4])
    a, b = C.combine(rows, ["f0", "f1"], "fwd_ret", 0.0)
    return _round(spark.createDataFrame([(float(a), float(b))], "w0 double, w1 double"))


def lasso_one(spark, d):
    """The combination of one formula, whose weight is the soft-thresholded ratio of two sums."""
    rows = X.evaluate(_features(spark, d), FORMULAS[:1])
    return _round(spark.createDataFrame([(float(C.combine(rows, ["f0"], "fwd_ret", 1e-5)[0]),)], "weight double"))


def walk_forward_combine(spark, d):
    names = [f"f{k}" for k in range(len(FORMULAS))]
    rows = X.evaluate(_features(spark, d), FORMULAS)
    dates = V.distinct_dates(rows)
    scored, _ = C.walk_forward(rows, names, "fwd_ret", dates[len(dates) // 2], 1e-5)
    return I.daily_ic(scored, "alpha", "fwd_ret")


def composite_score(spark, d):
    return _round(X.score(_features(spark, d), FORMULAS, WEIGHTS).select("date", "ticker", "alpha"))


def _scored_latest(spark, d):
    return R.score_live(T.operands(spark, d), R.StoredModel(FORMULAS, WEIGHTS, FEATURE_COLS)).select("ticker", "sector", "alpha")


def top_n(spark, d):
    return _round(L.top(_scored_latest(spark, d), 15))


def top_n_sector_capped(spark, d):
    return _round(L.both_sides(_scored_latest(spark, d), 8, 2))


def serve_stored_model(spark, d):
    """Save a model, load it, and list both ends of the last date's names."""
    path = f"{shared_dir(spark)}/ridgeline-model-{uuid.uuid4().hex}"
    R.save_model(spark, path, R.StoredModel(FORMULAS, WEIGHTS, FEATURE_COLS))
    return _round(R.candidates(T.operands(spark, d), R.load_model(spark, path), 10))


def sector_counts(spark, d):
    return L.sector_counts(L.top(_scored_latest(spark, d), 15))


def resolve_predictions(spark, d):
    realized = _alpha(spark, d).select("date", "ticker", (F.col("fwd_ret") + 1).alias("fwd_ret"))
    return _round(D.resolve(_log(spark, d), realized))


def record_prediction(spark, d):
    return _round(D.record(_scored_latest(spark, d), F.lit(date(2001, 11, 5))))


def weekly_ic(spark, d):
    return _round(D.weekly_ic(_log(spark, d)))


def baseline_stats(spark, d):
    return _round(D.baseline(D.period_ic(_alpha(spark, d))))


def drift_timeline(spark, d):
    return _round(D.replay(_alpha(spark, d)))


def remine_decision(spark, d):
    days = F.datediff(F.lit(date(2001, 11, 5)), F.col("date"))
    return D.replay(_alpha(spark, d)).select("date", "status", days.cast("int").alias("days"), D.remine_column(days, F.col("status")).alias("should_remine"))


def book_best(spark, d):
    return _round(O.book_features(T.books(spark, d)).select("bucket", "best_bid", "best_ask", "mid_price", "spread", "spread_bps", "microprice", "microprice_minus_mid_bps"))


def book_depth_imbalance(spark, d):
    return _round(O.book_features(T.books(spark, d)).select("bucket", *(f"{k}_top{n}" for n in O.TIERS for k in ("bid_depth", "ask_depth", "imbalance"))))


def book_features(spark, d):
    return _round(O.book_features(T.books(spark, d)))


def fold_summary(spark, d):
    return _round(S.summary(_screened(spark, d).where("feature = 'vwap'"), "ic"))


def overfit_rule(spark, d):
    rows = _screened(spark, d).groupBy("feature").agg(F.avg(F.when(F.col("fold") <= 3, F.col("ic"))).alias("train"), F.avg(F.when(F.col("fold") > 3, F.col("ic"))).alias("test"))
    retained, alarm = S.overfit(F.col("train"), F.col("test"))
    return _round(rows.select("feature", retained.alias("retained"), alarm.alias("alarm")))


def union_oos(spark, d):
    return _round(_oos(spark, d).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("alpha").alias("mean_alpha"), correlation("alpha", "fwd_ret").alias("corr")))


def oos_sample(spark, d):
    """At most 5,000 out-of-sample rows, for a plot of predictions against outcomes."""
    rows = _oos(spark, d).select("date", "ticker", "alpha", "fwd_ret", F.concat_ws("|", "ticker", F.col("date").cast("string")).alias("key"))
    return _round(sampled(rows, 5000, "key").drop("key"))


def windowed_events(spark, d):
    from ridgeline.streaming.flows import windowed_counts

    return _round(windowed_counts(T.table(spark, d, "events")))


def genetic_search(spark, d):
    rows, (*_, fold) = _search(spark, d)
    train = N.held(rows.where(F.col("date") <= F.lit(fold.train_cutoff)))
    pool = N.mine_seeds(N.Genetic(N.Settings(**SEARCH)), train, FEATURE_COLS, "fwd_ret", [7, 8])
    train.unpersist()
    return spark.createDataFrame(list(zip(pool.formulas, pool.scores, strict=True)), "formula string, train_ic double")


def pareto_search(spark, d):
    rows, (*_, fold) = _search(spark, d)
    train = rows.where(F.col("date") <= F.lit(fold.train_cutoff))
    pool = N.Pareto(N.Settings(**SEARCH | {"population": 12}, ops=N.PLAIN_OPS, dialect="plain", metric="pearson", batch_days=60, islands=3, tuned=2)).mine(train, FEATURE_COLS, "fwd_ret", 7)
    return spark.createDataFrame(list(zip(pool.formulas, pool.scores, strict=True)), "formula string, train_ic double")


def custom_fitness(spark, d):
    """Formulas by a metric of one's own: on what share of a date's names value and label agree in sign, less the others."""
    register_fitness("sign_agreement", lambda x, y: (np.sign(x) * np.sign(y)).mean())
    nodes = [X.parse(t) for t in FORMULAS]
    scores = N.population_ic(_features(spark, d), nodes, "fwd_ret", "plain", "sign_agreement")
    return _round(spark.createDataFrame(list(zip(FORMULAS, scores, strict=True)), "formula string, fitness double"))


def second_stage_search(spark, d):
    rows, _ = _search(spark, d)
    pool, uses = N.second_stage(rows, FEATURE_COLS, ["mean_close_5 - vwap", "square(ret_1d)"], "fwd_ret", N.Genetic(N.Settings(**SEARCH)), 3)
    return spark.createDataFrame([(f, v, uses) for f, v in zip(pool.formulas, pool.scores, strict=True)], "formula string, train_ic double, with_meta int")


def walk_forward(spark, d):
    """The reference's walk-forward with its own settings: 5 folds, 4 seeds, 300 formulas, 15 generations."""
    rows, folds = _search(spark, d)
    settings = N.Settings(population=300, generations=15, components=4, hall_of_fame=30)
    return W.walk_forward(rows, FEATURE_COLS, folds, seeds=4, settings=settings, alpha=1e-5)[0]


def complexity_sweep(spark, d):
    """The sizes and the budget of the reference's sweep: 5 folds, 3 seeds, 8 populations of 33 over 20 rounds."""
    rows, folds = _search(spark, d)
    settings = N.Settings(population=33, generations=20, islands=8, tournament=8)
    return W.complexity_sweep(rows, FEATURE_COLS, folds, [10, 20, 30], settings, seeds=3, alpha=1e-5)


def elasticnet_baseline(spark, d):
    rows, folds = _search(spark, d)
    return W.baseline(rows, FEATURE_COLS, folds)[0]


def boosted_trees_importance(spark, d):
    rows, (*_, fold) = _search(spark, d)
    train = rows.where(F.col("date") <= F.lit(fold.train_cutoff))
    return M.boosted_trees_fit_predict(train, rows.where(F.col("date") > F.lit(fold.train_cutoff)), FEATURE_COLS, trees=10)[1]


def preflight(spark, d):
    """One row: both baselines, the go rule and the consensus ranking, from the linear model and boosting with all its 200 trees."""
    rows, folds = _search(spark, d)
    found = W.preflight(rows, FEATURE_COLS, folds, 5)
    row = (found["elasticnet"]["mean_ic"], found["elasticnet"]["mean_sharpe"], found["boosted_trees"]["mean_ic"], found["go"], found["reasoning"], found["recommended_top_n"])
    return spark.createDataFrame([row], "linear_ic double, linear_sharpe double, trees_ic double, go boolean, reasoning array<string>, recommended_top_n array<string>")


def remine_policy(spark, d):
    """What the policy says as of each state of the monitor, about a model that was mined at the first of them."""
    states = D.replay(_alpha(spark, d)).select("date", "status")
    first = states.agg(F.min("date").alias("mined"))
    days = F.datediff("date", "mined")
    rows = states.join(F.broadcast(first)).select("date", days.alias("staleness_days"), D.remine_column(days, F.col("status")).alias("should_remine"), D.remine_reasons(days, F.col("status")).alias("why"))
    return rows.select("date", "staleness_days", "should_remine", F.array_join("why", "; ").alias("reasons"))


def log_stream(spark, d):
    """The prediction log as a stream makes it: predictions and outcomes of all dates mixed in eight files, a batch each."""
    rows = _log(spark, d)
    said = rows.select("predict_date", "ticker", "alpha", F.lit(None).cast("double").alias("fwd_ret"))
    came = rows.where("resolved").select("predict_date", "ticker", F.lit(None).cast("double").alias("alpha"), F.col("realized_fwd_ret").alias("fwd_ret"))
    place = f"{shared_dir(spark)}/ridgeline-log-{uuid.uuid4().hex}"
    said.unionByName(came).repartition(8, F.xxhash64("ticker", F.col("alpha").isNull())).write.parquet(f"{place}/events")
    log = PredictionLog(spark, f"{place}/log", "parquet")
    log.follow(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{place}/events"), "log_stream", f"{place}/at").awaitTermination()
    return _round(log.read())


def drift_stream(spark, d):
    """The states of ``drift_timeline`` as streams make them, against the history's own baseline: predictions and outcomes in
    four files a side, two to a batch; the first dates are complete only when a last event moves the watermark."""
    rows = B.rebalance_rows(_alpha(spark, d))
    place = f"{shared_dir(spark)}/ridgeline-drift-{uuid.uuid4().hex}"
    said = rows.select(F.col("date").alias("predict_date"), "ticker", "alpha")
    came = rows.select(F.col("date").alias("predict_date"), "ticker", "fwd_ret", (F.col("date").cast("timestamp") + F.expr("interval 7 days")).alias("known_at"))
    last = spark.range(1).select(F.lit(date(2100, 1, 1)).alias("predict_date"), F.lit("").alias("ticker"))
    for name, part, end in (("said", said, {"alpha": F.lit(0.0)}), ("came", came, {"fwd_ret": F.lit(0.0), "known_at": F.lit(datetime(2100, 1, 1))})):
        part.repartition(4, "ticker").write.parquet(f"{place}/{name}")
        last.withColumns(end).write.mode("append").parquet(f"{place}/{name}")
    base = D.baseline(D.period_ic(_alpha(spark, d))).first()
    said, came = (spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 2).parquet(f"{place}/{name}") for name, part in (("said", said), ("came", came)))
    DS.write_stream(DS.period_ics(said, came, late="20000 days"), f"{place}/ics", f"{place}/at1").awaitTermination()
    ics = spark.readStream.schema(DS.ICS).parquet(f"{place}/ics")
    DS.write_stream(DS.drift_states(ics, base["mean"], base["std"]), f"{place}/states", f"{place}/at2").awaitTermination()
    return _round(spark.read.parquet(f"{place}/states").where("as_of >= 8"))


def features_appended(spark, d):
    """``features_full`` by increments: all bars but those of the last five weeks, then four weeks, then the last."""
    bars, universe = T.bars(spark, d), T.universe(spark, d)
    last = bars.agg(F.max("date")).first()[0]
    store = FeatureStore(spark, f"{shared_dir(spark)}/ridgeline-features-{uuid.uuid4().hex}")
    if last is not None:
        for k, (newest, oldest) in enumerate(((10**6, 35), (35, 7), (7, 0))):
            age = F.datediff(F.lit(last), F.col("date"))
            store.append(bars.where((age < newest) & (age >= oldest)), universe, "features_appended", k)
    return _round(store.read().select("date", "ticker", "sector", *FEATURE_COLS, "fwd_ret", "fwd_ret_neutral"))


_ORDER = [
    typical_price, ret_1d, rolling_mean, rolling_std, rolling_sum, delta, ewma, momentum, rolling_corr, fwd_return, sector_attach, sector_neutral_target, zscore, store_bars, store_operands, features_full, live_latest,
    daily_ic, daily_rank_ic, ic_series_skip, global_ic, global_rank_ic, distinct_counts, feature_screen, variance_flags, consensus_rank, select_features, mean_importance, go_rule, folds, time_split, embargo_split, decile_backtest, decile_sector_neutral, ic_weighted,
    ic_weighted_sector_neutral, period_metrics, equity_curve, psr_moments, deflated_sharpe, formula_eval, formula_eval_protected, formula_dedup, explain_nodes, explain_ticker, pool_report, pool_values, gram_matrix, lasso_combine, least_squares, lasso_one,
    walk_forward_combine, composite_score, top_n, top_n_sector_capped, serve_stored_model, sector_counts, record_prediction, resolve_predictions, weekly_ic, baseline_stats, drift_timeline, remine_decision, remine_policy,
    book_best, book_depth_imbalance, book_features, fold_summary, overfit_rule, union_oos, oos_sample, windowed_events, genetic_search, pareto_search, custom_fitness, second_stage_search, walk_forward, complexity_sweep,
    elasticnet_baseline, boosted_trees_importance, preflight, log_stream, drift_stream, features_appended,
]


def queries():
    return {f.__name__: f for f in _ORDER}
