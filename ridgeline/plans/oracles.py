"""The registered queries in SQL, written from the operators' definitions and run by another engine."""

from __future__ import annotations

from ridgeline.plans.queries import FORMULAS, RESOLVED_BEFORE, TRIALS
from ridgeline.schema import FEATURE_COLS

PANEL = """
l AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS ticker, l_extendedprice / l_quantity AS px,
             row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k, l_quantity FROM lineitem),
p AS (SELECT date, ticker, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(l_quantity) AS volume FROM l GROUP BY ALL),
u AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _operands() -> str:
    cols = ["(high + low + close) / 3 AS vwap", "close / lag(close) OVER t - 1 AS ret_1d"]
    for w in (5, 10, 20):
        f = f"(PARTITION BY ticker ORDER BY date ROWS {w - 1} PRECEDING)"
        cols += [f"CASE WHEN count(close) OVER {f} = {w} THEN {a} OVER {f} END AS {n}_{w}" for n, a in (("mean_close", "avg(close)"), ("std_close", "stddev_samp(close)"), ("sum_volume", "sum(volume)"))]
        cols += [f"close - lag(close, {w}) OVER t AS delta_close_{w}", f"sum(close * pow(2.0, i / {w}.0)) OVER t / sum(pow(2.0, i / {w}.0)) OVER t AS ewma_close_{w}"]
    f = "(PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING)"
    cols += ["close - lag(close, 60) OVER t AS mom_60", f"CASE WHEN count(close) OVER {f} = 10 THEN covar_pop(close, volume) OVER {f} / nullif(stddev_pop(close) OVER {f} * stddev_pop(volume) OVER {f}, 0) END AS corr_close_volume_10"]
    return f"""
o AS (SELECT q.date, q.ticker, q.close, coalesce(u.sector, 'Unknown') AS sector, {', '.join(cols)}, lead(close, 5) OVER t / close - 1 AS fwd_ret
      FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM p) q LEFT JOIN u USING (ticker) WINDOW t AS (PARTITION BY q.ticker ORDER BY q.date))"""


def _z(c: str, by: str = "date") -> str:
    return f"coalesce(({c} - avg({c}) OVER (PARTITION BY {by})) / nullif(stddev_samp({c}) OVER (PARTITION BY {by}), 0), 0.0)"


OPERANDS = PANEL + "," + _operands()
_FULL = " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_COLS)
FEATURES = OPERANDS + f""",
f0 AS (SELECT * FROM o WHERE {_FULL} AND fwd_ret IS NOT NULL),
f AS (SELECT date, ticker, sector, fwd_ret, fwd_ret - avg(fwd_ret) OVER (PARTITION BY date, sector) AS fwd_ret_neutral, {', '.join(f'{_z(c)} AS {c}' for c in FEATURE_COLS)} FROM f0)"""
LIVE = OPERANDS + f""",
g AS (SELECT date, ticker, sector, {', '.join(f'{_z(c)} AS {c}' for c in FEATURE_COLS)} FROM o WHERE {_FULL}),
n AS (SELECT * FROM g WHERE date = (SELECT max(date) FROM g))"""
ALPHA = FEATURES + ", a AS (SELECT date, ticker, sector, fwd_ret, round(mean_close_10 - vwap, 9) AS alpha FROM f)"
_FLAT = "stddev_pop({x}) < 1e-12 OR stddev_pop({y}) < 1e-12"


def _corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def _ic(x: str = "alpha", y: str = "fwd_ret") -> str:
    return f"CASE WHEN stddev_pop({x}) < 1e-12 OR stddev_pop({y}) < 1e-12 THEN NULL ELSE {_corr(x, y)} END"


FOLDS = """,
fd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM f)),
fn AS (SELECT count(*) AS n, CAST(floor(count(*) * CAST(0.4 AS DOUBLE)) AS BIGINT) AS m FROM fd),
fb AS (SELECT k, CASE WHEN k = 5 THEN n ELSE CAST(floor(m + k * (CAST(n - m AS DOUBLE) / 5)) AS BIGINT) END AS b FROM fn, range(6) t(k)),
folds AS (SELECT CAST(x.k + 1 AS INT) AS fold, c.date AS train_cutoff, s.date AS test_start, e.date AS test_end
          FROM fb x JOIN fb y ON y.k = x.k + 1 JOIN fd c ON c.i = x.b - 1 - {embargo} JOIN fd s ON s.i = x.b JOIN fd e ON e.i = y.b - 1)"""
ICS = FEATURES + FOLDS.format(embargo=0) + f""",
long AS (UNPIVOT (SELECT date, fwd_ret, {', '.join(FEATURE_COLS)} FROM f) ON {', '.join(FEATURE_COLS)} INTO NAME feature VALUE v),
day AS (SELECT feature, fold, date, coalesce({_ic('v')}, 0.0) AS ic FROM long JOIN folds ON date BETWEEN test_start AND test_end GROUP BY ALL),
ics AS (SELECT feature, fold, avg(ic) AS ic FROM day GROUP BY ALL),
s0 AS (SELECT feature, avg(ic) AS mean_ic, stddev_pop(ic) AS std_ic, CASE WHEN stddev_pop(ic) > 1e-9 THEN avg(ic) / stddev_pop(ic) ELSE 0.0 END AS information_ratio,
              avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, min(ic) AS min_ic, max(ic) AS max_ic FROM ics GROUP BY feature),
s AS (SELECT *, CASE WHEN (SELECT quantile_cont(std_ic, 0.5) FROM s0) > 1e-9 THEN std_ic / (SELECT quantile_cont(std_ic, 0.5) FROM s0) ELSE 0.0 END AS variance_ratio FROM s0)"""
REBALANCE = """,
rd AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM a)) WHERE k % 5 = 0),
r AS (SELECT a.* FROM a JOIN rd USING (date))"""


def _edges(n: int) -> str:
    return "[" + ", ".join(f"CAST('{k * (1 / n) if k < n else 1.0!r}' AS DOUBLE)" for k in range(n + 1)) + "]"


def _decile(n: int, by: str) -> str:
    on = " AND ".join(f"r.{c} = e.{c}" for c in by.split(", "))
    return f"""{ALPHA}{REBALANCE},
e AS (SELECT {by}, list_sort(list_distinct(quantile_cont(alpha, {_edges(n)}))) AS e FROM r GROUP BY {by} HAVING count(*) >= {2 * n}),
m AS (SELECT r.date, fwd_ret, len(e) >= 2 AND alpha > e[len(e) - 1] AS top, len(e) >= 2 AND alpha <= e[2] AS low FROM r JOIN e ON {on}),
per AS (SELECT date, avg(fwd_ret) FILTER (top) - avg(fwd_ret) FILTER (low) - 0.002 AS ret, avg(fwd_ret) FILTER (top) - 0.001 AS long_only FROM m GROUP BY date)"""


def _weighted(z: str) -> str:
    return f"""{ALPHA}{REBALANCE},
n AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY date) AS c FROM r) WHERE c >= 20),
z AS (SELECT date, fwd_ret, {z} AS z FROM n),
per AS (SELECT date, 2 * sum(z * fwd_ret) / sum(abs(z)) - 0.002 AS ret,
               CASE WHEN sum(z) FILTER (z > 0) > 0 THEN sum(z * fwd_ret) FILTER (z > 0) / sum(z) FILTER (z > 0) - 0.001 ELSE 0.0 END AS long_only FROM z GROUP BY date HAVING sum(abs(z)) > 0)"""


def _q(ctes: str, cols: str, tail: str) -> str:
    """A query whose items ``~expr AS name`` are rounded."""
    items = []
    for c in cols.split(";"):
        c = c.strip()
        if c.startswith("~"):
            expr, _, name = c[1:].rpartition(" AS ")
            expr, name = (expr, name) if expr else (name, name)
            c = f"round({expr}, 6) + 0.0 AS {name}"
        items.append(c)
    return f"WITH {ctes.strip()}\nSELECT {', '.join(items)} FROM {tail}"


def _short_decimals(*names: str) -> str:
    return _q(OPERANDS, "date; ticker; " + "; ".join(f"CAST(round(CAST({n} AS DECIMAL(38, 9)), 6) AS DOUBLE) AS {n}" for n in names), "o")


def _operand(*names: str) -> str:
    return _q(OPERANDS, "date; ticker; " + "; ".join(f"~{n}" for n in names), "o")


_RANK = "rank() OVER (PARTITION BY date ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0"
_DECILE = _decile(10, "date")
_MILD = _DECILE + ", ml AS (SELECT date, ret / 100 AS ret, long_only / 100 AS long_only FROM per)"
_METRIC = "CASE WHEN count(*) >= 2 AND count(ret) = count(*) THEN {} END"
_ANN = "product(1 + ret) ** ({p} / count(*)) - 1".format(p="50.4")
_VOL = "stddev_pop(ret) * sqrt(50.4)"
_PLAIN = {
    "f0": "mean_close_10 - vwap", "f1": "CASE WHEN sum_volume_20 + 0.6 >= 0 THEN sqrt(sum_volume_20 + 0.6) END", "f2": "CASE WHEN sum_volume_20 + 1.63 > 0 THEN ln(sum_volume_20 + 1.63) END", "f3": "-delta_close_5 * 0.5", "f4": "CAST(0.9372159 AS DOUBLE)",
}
_SCORE = f"0.02 * ({_PLAIN['f0']}) + 0.01 * ({_PLAIN['f1']}) + 0.03 * ({_PLAIN['f3']}) + 0.00135 * 0.9372159"
SCORED = LIVE + f", sc AS (SELECT ticker, sector, {_SCORE} AS alpha FROM n)"
_BOOKS = """
lv AS (SELECT CAST(epoch(ts) - epoch(ts) % 21600 AS BIGINT) AS bucket, event_id % 2 = 0 AS bid, CASE WHEN event_id % 2 = 0 THEN 500 - value ELSE 500 + value END AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size, event_id FROM events),
lr AS (SELECT *, row_number() OVER (PARTITION BY bucket, bid ORDER BY CASE WHEN bid THEN -price ELSE price END, event_id) AS n FROM lv),
b0 AS (SELECT bucket, max(price) FILTER (bid AND n = 1) AS bp, max(size) FILTER (bid AND n = 1) AS bs, max(price) FILTER (NOT bid AND n = 1) AS ap, max(size) FILTER (NOT bid AND n = 1) AS az,
       """ + ", ".join(f"coalesce(sum(size) FILTER ({s} AND n <= {t}), 0) AS {k}{t}" for t in (5, 10, 25) for k, s in (("b", "bid"), ("a", "NOT bid"))) + """ FROM lr GROUP BY bucket),
b AS (SELECT *, (bp + ap) / 2 AS mid, (bp * az + ap * bs) / nullif(bs + az, 0) AS micro FROM b0)"""
_BEST = "~bp AS best_bid; ~ap AS best_ask; ~mid AS mid_price; ~ap - bp AS spread; ~(ap - bp) / nullif(mid, 0) * 10000 AS spread_bps; ~micro AS microprice; ~(micro - mid) / nullif(mid, 0) * 10000 AS microprice_minus_mid_bps"
_DEPTH = "; ".join(f"~b{t} AS bid_depth_top{t}; ~a{t} AS ask_depth_top{t}; ~CASE WHEN b{t} + a{t} > 0 THEN (b{t} - a{t}) / (b{t} + a{t}) ELSE 0.0 END AS imbalance_top{t}" for t in (5, 10, 25))
LOG = ALPHA + REBALANCE + f""",
lg AS (SELECT date AS predict_date, ticker, alpha, CASE WHEN date < DATE '{RESOLVED_BEFORE}' THEN fwd_ret END AS realized_fwd_ret, date < DATE '{RESOLVED_BEFORE}' AS resolved FROM r)"""


def _cdf(z: str = "z") -> str:
    """The normal distribution function by the series of its odd powers over double factorials, from gamma functions."""
    terms = f"list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(abs({z})) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())))"
    half = f"exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum({terms})"
    return f"CASE WHEN {z} = 0 THEN 0.5 WHEN abs({z}) > 9 THEN CAST(({z}) > 0 AS INT) + 0.0 ELSE 0.5 + sign({z}) * {half} END"


def _quantile(p: str) -> str:
    """Where that function reaches ``p`` (over one half), step by halved step."""
    steps = ", ".join(str(8 * 0.5**k) for k in range(56))
    return f"list_reduce([0.0, {steps}], lambda a, s: CASE WHEN {_cdf('(a + s)')} <= {p} THEN a + s ELSE a END)"


DRIFT = ALPHA + REBALANCE + f""",
pi AS (SELECT date, {_ic()} AS ic FROM r GROUP BY date), pk AS (SELECT * FROM pi WHERE ic IS NOT NULL),
bs AS (SELECT avg(ic) AS mean, stddev_pop(ic) AS std FROM pk),
dt AS (SELECT CAST(row_number() OVER (ORDER BY date) AS INT) AS as_of, date, count(ic) OVER w AS n_weeks, avg(ic) OVER w AS recent_mean_ic, mean AS baseline_mean_ic, (avg(ic) OVER w - mean) / (std / sqrt(count(ic) OVER w)) AS z
       FROM pk, bs WINDOW w AS (ORDER BY date ROWS 7 PRECEDING)),
dr AS (SELECT *, {_cdf()} AS p FROM dt WHERE as_of >= 8)"""
_STATUS = "CASE WHEN p < 0.10 THEN 'drift_flagged' ELSE 'normal' END AS status"


_TRIED = f"[{', '.join(map(repr, TRIALS))}]"
#: The best of skill-less trials, with Euler's constant.
_BAR = f"(SELECT stddev_samp(x) FROM (SELECT unnest({_TRIED}) AS x)) * ((1 - 0.5772156649015329) * {_quantile(f'(1 - 1.0 / {len(TRIALS)})')} + 0.5772156649015329 * {_quantile(f'(1 - 1 / ({len(TRIALS)} * exp(1)))')})"


def _lasso(penalty: float, sweeps: int) -> str:
    """The combination of all formulas by cyclic coordinate descent, one coordinate a step of a recursion."""
    k = len(_PLAIN)
    values = ", ".join(f"{v} AS x{i}" for i, v in enumerate(_PLAIN.values()))
    known = " AND ".join([*(f"x{i} IS NOT NULL" for i in range(k)), "y IS NOT NULL"])
    sums = ", ".join([*(f"[{', '.join(f'avg(x{i} * x{j})' for j in range(k))}] AS g{i}" for i in range(k)), f"[{', '.join(f'avg(x{i} * y)' for i in range(k))}] AS xy"])
    g = f"[{', '.join(f'g{i}' for i in range(k))}]"
    r = "(xy[j] - list_dot_product(m[j], w) + m[j][j] * w[j])"
    new = f"sign{r} * greatest(abs{r} - {penalty}, 0) / m[j][j]"
    texts = ", ".join(f"'{x}'" for x in FORMULAS)
    return f"""WITH RECURSIVE {FEATURES.strip()},
z AS (SELECT {values}, fwd_ret AS y FROM f), gr AS MATERIALIZED (SELECT {g} AS m, xy FROM (SELECT {sums} FROM z WHERE {known})),
cd AS (SELECT 0 AS i, 1 AS j, CAST({[0.0] * k} AS DOUBLE[]) AS w UNION ALL
       SELECT i + 1, j % {k} + 1, list_transform(w, lambda v, c: CASE WHEN c = j THEN {new} ELSE v END) FROM cd, gr WHERE i < {k * sweeps}),
done AS (SELECT w FROM cd WHERE i = {k * sweeps})
SELECT formula, round(weight, 6) + 0.0 AS weight FROM (SELECT unnest([{texts}]) AS formula, unnest(w) AS weight FROM done) WHERE abs(weight) >= 1e-10"""


def _guard(x: str, value: str, other: str) -> str:
    return f"CASE WHEN abs({x}) > 0.001 THEN {value} ELSE {other} END"


def oracle_sql() -> dict[str, str]:
    d = "date; ticker; "
    screened = "feature; ~mean_ic; ~std_ic; ~information_ratio; ~hit_rate; ~min_ic; ~max_ic; ~variance_ratio"
    explained = [("NULL", 0, "div(sqrt(abs(sub(sum_volume_20, delta_close_5))), 2.0)", "sqrt(abs(sum_volume_20 - delta_close_5)) / 2"), ("0", 1, "sqrt(abs(sub(sum_volume_20, delta_close_5)))", "sqrt(abs(sum_volume_20 - delta_close_5))"), ("1", 2, "abs(sub(sum_volume_20, delta_close_5))", "abs(sum_volume_20 - delta_close_5)"), ("2", 3, "sub(sum_volume_20, delta_close_5)", "sum_volume_20 - delta_close_5"), ("3", 4, "sum_volume_20", "sum_volume_20"), ("3", 4, "delta_close_5", "delta_close_5"), ("0", 1, "2", "CAST(2 AS DOUBLE)")]
    nodes = " UNION ALL ".join(f"SELECT ticker, CAST({i} AS INT) AS node_id, CAST({p} AS INT) AS parent_id, CAST({k} AS INT) AS depth, '{label}' AS label, round({v}, 6) + 0.0 AS value FROM n" for i, (p, k, label, v) in enumerate(explained))
    report = []
    for i, text in ((0, "delta_close_5"), (1, "sqrt(sum_volume_20 + 0.6)")):
        cells = [f"(SELECT round(coalesce(avg(coalesce(ic, 0.0)), 0.0), 6) + 0.0 FROM (SELECT {_ic('x', 'y')} AS ic FROM (SELECT date, {x} AS x, {y} AS y FROM pr WHERE side = '{s}' AND f{i} IS NOT NULL) GROUP BY date)) AS {s}{n}_ic" for n, x, y in (("", f"f{i}", "fwd_ret"), ("_rank", _RANK.format(c=f"f{i}"), _RANK.format(c="fwd_ret"))) for s in ("train", "test")]
        report.append(f"SELECT CAST({i} AS INT) AS idx, '{text}' AS formula, {', '.join(cells)}")
    split = FEATURES + ", sd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM f)), cut AS (SELECT date AS c FROM sd WHERE i = CAST(floor(n * (1 - CAST(0.2 AS DOUBLE))) AS BIGINT))"
    names = [*FEATURE_COLS, "fwd_ret"]
    return {
        "typical_price": _short_decimals("vwap"), "ret_1d": _operand("ret_1d"), "rolling_mean": _short_decimals(*(f"mean_close_{w}" for w in (5, 10, 20))), "momentum": _q(OPERANDS, "date; ticker; mom_60", "o"), "delta": _q(OPERANDS, "date; ticker; delta_close_5; delta_close_10; delta_close_20", "o"), "rolling_corr": _operand("corr_close_volume_10"), "fwd_return": _operand("fwd_ret"),
        **{q: _operand(*(f"{n}_{w}" for w in (5, 10, 20))) for q, n in (("rolling_std", "std_close"), ("rolling_sum", "sum_volume"), ("ewma", "ewma_close"))},
        "sector_attach": _q(PANEL, "date; p.ticker; coalesce(v.sector, 'Unknown') AS sector", "p LEFT JOIN u v ON p.ticker = v.ticker"),
        "sector_neutral_target": _q(OPERANDS, d + "sector; ~fwd_ret - avg(fwd_ret) OVER (PARTITION BY date, sector) AS fwd_ret_neutral", "o WHERE fwd_ret IS NOT NULL"),
        "zscore": _q(PANEL, d + f"~{_z('close')} AS close; ~{_z('volume')} AS volume", "p"),
        "features_full": _q(FEATURES, d + "sector; " + "; ".join(f"~{c}" for c in [*FEATURE_COLS, "fwd_ret", "fwd_ret_neutral"]), "f"),
        "store_bars": _q(PANEL, "date; ticker; open; high; low; close; volume", "p"), "store_operands": _q(OPERANDS, d + "sector; mom_60; ~fwd_ret", f"o WHERE {_FULL}"),
        "live_latest": _q(LIVE, d + "sector; " + "; ".join(f"~{c}" for c in FEATURE_COLS), "n"),
        "daily_ic": _q(ALPHA, f"date; ~coalesce({_ic()}, 0.0) AS ic", "a GROUP BY date"),
        "daily_rank_ic": _q(ALPHA + f", k AS (SELECT date, {_RANK.format(c='alpha')} AS x, {_RANK.format(c='fwd_ret')} AS y FROM a)", f"date; ~coalesce({_ic('x', 'y')}, 0.0) AS ic", "k GROUP BY date"),
        "ic_series_skip": _q(ALPHA + f", k AS (SELECT date, {_ic('x')} AS ic FROM (SELECT date, fwd_ret, CASE WHEN month(date) % 2 = 0 THEN 1.0 ELSE alpha END AS x FROM a) GROUP BY date)", "date; ~ic", "k WHERE ic IS NOT NULL"),
        "global_ic": _q(ALPHA, f"~coalesce({_ic()}, 0.0) AS ic", "a"),
        "global_rank_ic": _q(ALPHA + f", k AS (SELECT {_RANK.format(c='alpha').replace('PARTITION BY date ORDER', 'ORDER').replace('date, ', '')} AS x, {_RANK.format(c='fwd_ret').replace('PARTITION BY date ORDER', 'ORDER').replace('date, ', '')} AS y FROM a)", f"~coalesce({_ic('x', 'y')}, 0.0) AS ic", "k"),
        "distinct_counts": _q(ALPHA, "count(DISTINCT date) AS date; count(DISTINCT ticker) AS ticker; count(DISTINCT sector) AS sector", "a"),
        "feature_screen": _q(ICS, screened, "s"),
        "select_features": _q(ICS, "feature; ~information_ratio; ~variance_ratio", "(SELECT * FROM s WHERE information_ratio >= -0.5 AND variance_ratio <= 4.0 ORDER BY information_ratio DESC, feature LIMIT 6)"),
        "mean_importance": _q(ICS, "feature; ~avg(ic) AS importance", "ics GROUP BY feature"),
        "variance_flags": _q(ICS, "feature; information_ratio < 0.1 AS low_ir; variance_ratio > 1.5 AS variance_flag", "s"),
        "consensus_rank": _q(ICS + ", c AS (SELECT feature, avg(abs(ic)) AS i, abs(any_value(information_ratio)) AS r FROM ics JOIN s USING (feature) GROUP BY feature)", "feature; ~((rank() OVER (ORDER BY i) + (count(*) OVER (PARTITION BY i) - 1) / 2.0) / count(*) OVER () + (rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0) / count(*) OVER ()) / 2 AS consensus", "c"),
        "go_rule": _q(ICS, "~avg(ic) AS mean_ic; ~avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate; avg(ic) > 0.005 AND avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) >= 0.6 AS go", "ics WHERE feature = 'delta_close_5'"),
        "folds": _q(FEATURES + FOLDS.format(embargo=0), "*", "folds"), "embargo_split": _q(FEATURES + FOLDS.format(embargo=5), "*", "folds"),
        "time_split": _q(split, "CASE WHEN date < c THEN 'train' ELSE 'test' END AS side; count(*) AS n; min(date) AS first; max(date) AS last", "f, cut GROUP BY 1"),
        "decile_backtest": _q(_DECILE, "date; ~ret; ~long_only", "per"), "decile_sector_neutral": _q(_decile(5, "date, sector"), "date; ~ret; ~long_only", "per"),
        "ic_weighted": _q(_weighted("coalesce((alpha - avg(alpha) OVER (PARTITION BY date)) / nullif(stddev_pop(alpha) OVER (PARTITION BY date), 0), 0.0)"), "date; ~ret; ~long_only", "per"),
        "ic_weighted_sector_neutral": _q(_weighted(_z("alpha", "date, sector")), "date; ~ret; ~long_only", "per"),
        "period_metrics": _q(_MILD, f"count(*) AS n_periods; ~{_METRIC.format(_ANN)} AS ann_return; ~{_METRIC.format(_VOL)} AS ann_vol; ~{_METRIC.format(f'({_ANN}) / nullif({_VOL}, 0)')} AS sharpe; ~{_METRIC.format(_ANN.replace('1 + ret', '1 + long_only'))} AS long_only_ann_return; ~{_METRIC.format('product(1 + ret)')} AS equity_multiple", "ml"),
        "equity_curve": _q(_MILD, "date; ~exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS equity", "ml"),
        "psr_moments": _q(_MILD + ", c AS (SELECT ret - avg(ret) OVER () AS e, ret FROM ml WHERE ret IS NOT NULL)", "count(*) AS n; ~avg(ret) AS mean; ~stddev_samp(ret) AS sd; ~avg(ret) / stddev_samp(ret) AS sharpe; ~avg(e ** 3) / pow(avg(e * e), 1.5) AS skew; ~avg(e ** 4) / pow(avg(e * e), 2) AS kurtosis", "c"),
        "deflated_sharpe": _q(_MILD + f", c AS (SELECT ret - avg(ret) OVER () AS e, ret FROM ml WHERE ret IS NOT NULL), mo AS (SELECT count(*) AS n, avg(ret) / stddev_samp(ret) AS sr, avg(e ** 3) / pow(avg(e * e), 1.5) AS sk, avg(e ** 4) / pow(avg(e * e), 2) AS ku FROM c HAVING count(*) >= 2), bar AS (SELECT {_BAR} AS best), zz AS (SELECT *, (sr - best) * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) AS z FROM mo, bar)", f"CAST({len(TRIALS)} AS INT) AS n_trials; ~sr AS sharpe; ~best AS expected_best; ~{_cdf()} AS deflated", "zz"),
        "formula_eval": _q(FEATURES, d + "; ".join(f"~{v} AS {k}" for k, v in _PLAIN.items()), "f"),
        "formula_eval_protected": _q(FEATURES, d + "; ".join(f"~{v} AS f{k}" for k, v in enumerate((_guard("ret_1d", "vwap / ret_1d", "1.0"), _guard("mean_close_5 - vwap", "ln(abs(mean_close_5 - vwap))", "0.0"), "sqrt(abs(mom_60))", _guard("delta_close_5", "1 / delta_close_5", "0.0"), "greatest(vwap, least(mom_60, 0.25))"))), "f"),
        "formula_dedup": "SELECT 'add(vwap, ' || CAST(p_size AS VARCHAR) || ')' AS formula, min(p_partkey - 1) AS idx FROM part GROUP BY 1",
        "explain_nodes": f"WITH {LIVE.strip()}\n{nodes}",
        "explain_ticker": f"WITH {LIVE.strip()}\nSELECT 'sqrt(abs(sum_volume_20 - delta_close_5)) / 2' AS formula, CAST(0.5 AS DOUBLE) AS weight, * FROM ({nodes}) WHERE ticker = '7'",
        "pool_report": f"WITH {split.strip()}, pr AS (SELECT *, delta_close_5 AS f0, {_PLAIN['f1']} AS f1, CASE WHEN date < c THEN 'train' ELSE 'test' END AS side FROM f, cut)\n" + " UNION ALL ".join(report),
        "pool_values": _q(FEATURES + f", pv AS (SELECT 0 AS i, date, ticker, mom_60 AS v FROM f UNION ALL SELECT 1, date, ticker, {_PLAIN['f1']} FROM f)", "CAST(i AS INT) AS formula_id; date; ticker; ~v AS value", "pv WHERE v IS NOT NULL"),
        "gram_matrix": _q(FEATURES, "count(*) AS n; " + "; ".join(f"~sum({a} * {b}) AS g_{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names) if i <= j), "f"),
        "lasso_combine": _lasso(1e-5, 20_000),
        "least_squares": _q(FEATURES + f", e AS (SELECT {_PLAIN['f0']} AS a, {_PLAIN['f3']} AS b, fwd_ret AS y FROM f), t AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS bb_y FROM e)", "~(ay * bb - bb_y * ab) / (aa * bb - ab * ab) AS w0; ~(bb_y * aa - ay * ab) / (aa * bb - ab * ab) AS w1", "t"),
        "lasso_one": _q(FEATURES + f", t AS (SELECT avg(({_PLAIN['f0']}) * fwd_ret) AS r, avg(({_PLAIN['f0']}) ** 2) AS s FROM f)", "~sign(r) * greatest(abs(r) - 1e-5, 0) / s AS weight", "t"),
        "composite_score": _q(FEATURES, d + f"~{_SCORE} AS alpha", "f"),
        "top_n": _q(SCORED, "ticker; sector; ~alpha", "(SELECT * FROM sc ORDER BY alpha DESC NULLS LAST, ticker LIMIT 15)"),
        "top_n_sector_capped": _q(SCORED + "".join(f", {n} AS (SELECT *, '{n}' AS side FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY alpha {o} NULLS LAST, ticker) AS k FROM sc) WHERE k <= 2 ORDER BY alpha {o} NULLS LAST, ticker LIMIT 8)" for n, o in (("long", "DESC"), ("short", "ASC"))), "ticker; sector; ~alpha; side", '(SELECT * FROM "long" UNION ALL SELECT * FROM short)').replace(", long AS (", ', "long" AS ('),
        "serve_stored_model": _q(SCORED, "ticker; sector; ~alpha; side", "(SELECT * FROM (SELECT *, 'long' AS side FROM sc ORDER BY alpha DESC NULLS LAST, ticker LIMIT 10) UNION ALL SELECT * FROM (SELECT *, 'short' AS side FROM sc ORDER BY alpha ASC NULLS LAST, ticker LIMIT 10))"),
        "sector_counts": _q(SCORED, "sector; count(*) AS n", "(SELECT * FROM sc ORDER BY alpha DESC NULLS LAST, ticker LIMIT 15) GROUP BY sector"),
        "record_prediction": _q(SCORED, "DATE '2001-11-05' AS predict_date; ticker; ~alpha; CAST(NULL AS DOUBLE) AS realized_fwd_ret; false AS resolved", "sc"),
        "resolve_predictions": _q(LOG, "predict_date; lg.ticker; ~lg.alpha AS alpha; ~CASE WHEN NOT resolved AND a.fwd_ret IS NOT NULL THEN a.fwd_ret + 1 ELSE realized_fwd_ret END AS realized_fwd_ret; resolved OR a.fwd_ret IS NOT NULL AS resolved", "lg LEFT JOIN a ON a.date = predict_date AND a.ticker = lg.ticker"),
        "weekly_ic": _q(LOG + f", k AS (SELECT predict_date, {_ic('alpha', 'realized_fwd_ret')} AS ic FROM lg WHERE resolved GROUP BY predict_date)", "predict_date; ~ic", "k WHERE ic IS NOT NULL"),
        "baseline_stats": _q(DRIFT, "~mean; ~std", "bs"),
        "drift_timeline": _q(DRIFT, f"as_of; date; {_STATUS}; n_weeks; ~recent_mean_ic; ~baseline_mean_ic; ~z AS z_score; ~p AS p_value", "dr"),
        "remine_policy": _q(DRIFT + f", st AS (SELECT date, {_STATUS}, CAST(date - min(date) OVER () AS INT) AS days FROM dr)", "date; days AS staleness_days; days >= 90 OR status = 'drift_flagged' AS should_remine; concat_ws('; ', CASE WHEN days >= 90 THEN 'stale: ' || CAST(days AS VARCHAR) || ' days, at most 90' END, CASE WHEN status = 'drift_flagged' THEN 'drift flagged' END) AS reasons".replace("'; '", "chr(59) || ' '"), "st"),
        "remine_decision": _q(DRIFT, f"date; {_STATUS}; CAST(DATE '2001-11-05' - date AS INT) AS days; DATE '2001-11-05' - date >= 90 OR p < 0.10 AS should_remine", "dr"),
        "book_best": _q(_BOOKS, "bucket; " + _BEST, "b"), "book_depth_imbalance": _q(_BOOKS, "bucket; " + _DEPTH, "b"), "book_features": _q(_BOOKS, "'EVT' AS symbol; bucket; " + _BEST + "; " + _DEPTH, "b"),
        "fold_summary": _q(ICS, "~avg(ic) AS mean; ~stddev_pop(ic) AS std; ~min(ic) AS min; ~max(ic) AS max; ~avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate", "ics WHERE feature = 'vwap'"),
        "overfit_rule": _q(ICS + ", w AS (SELECT feature, avg(ic) FILTER (fold <= 3) AS a, avg(ic) FILTER (fold > 3) AS b FROM ics GROUP BY feature)", "feature; ~CASE WHEN a > 0 THEN b / a END AS retained; coalesce(a > 0.005 AND (b / a < 0.3 OR b < 0), false) AS alarm", "w"),
        "union_oos": _q(ALPHA + FOLDS.format(embargo=0), f"fold; count(*) AS n; ~avg(alpha) AS mean_alpha; ~{_corr('alpha', 'fwd_ret')} AS corr", "a JOIN folds ON date BETWEEN test_start AND test_end GROUP BY fold"),
        "oos_sample": _q(ALPHA + FOLDS.format(embargo=0), "date; ticker; ~alpha; ~fwd_ret", "(SELECT a.* FROM a JOIN folds ON date BETWEEN test_start AND test_end ORDER BY md5(ticker || '|' || CAST(date AS VARCHAR) || '|0'), ticker || '|' || CAST(date AS VARCHAR) LIMIT 5000)"),
        "drift_stream": _q(DRIFT, f"as_of; date; {_STATUS}; n_weeks; ~recent_mean_ic; ~baseline_mean_ic; ~z AS z_score; ~p AS p_value", "dr"), "features_appended": _q(FEATURES, d + "sector; " + "; ".join(f"~{c}" for c in [*FEATURE_COLS, "fwd_ret", "fwd_ret_neutral"]), "f"),
        "log_stream": _q(LOG, "predict_date; ticker; ~alpha; ~realized_fwd_ret; resolved", "lg"),
        "custom_fitness": "WITH " + FEATURES.strip() + " " + " UNION ALL ".join(f"SELECT '{text}' AS formula, round(coalesce(avg(coalesce(s, 0.0)), 0.0), 6) + 0.0 AS fitness FROM (SELECT date, avg(sign(v) * sign(fwd_ret)) AS s FROM (SELECT date, fwd_ret, {_PLAIN[f'f{k}']} AS v FROM f) GROUP BY date)" for k, text in enumerate(FORMULAS)),
        "windowed_events": "SELECT to_timestamp(epoch(ts) - epoch(ts) % 21600) AT TIME ZONE 'UTC' AS start, event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM events GROUP BY ALL",
    }
