"""Walk-forward and sweep: the whole search budget, folds and sizes that take turns together, pools evaluated as arrays."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import formula as X
from ridgeline.operators import combine as C
from ridgeline.operators.days import formula_columns
from ridgeline.operators.folds import make_folds
from ridgeline.plans import mining as N
from ridgeline.plans import queries as Q
from ridgeline.plans import validation as W


@pytest.fixture(scope="module")
def rows(spark):
    rng, made = random.Random(2), []
    for k in range(60):
        for t in range(24):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            made.append((dt.date(2024, 1, 1) + dt.timedelta(days=k), f"t{t:02}", "s", a, b, 0.02 * a - 0.01 * b + rng.gauss(0, 0.01)))
    return spark.createDataFrame(made, "date date, ticker string, sector string, a double, b double, fwd_ret double").persist()


def _folds(rows):
    return make_folds(sorted(r.date for r in rows.select("date").distinct().collect()), 3, 0.5)


def _asked(monkeypatch, query, name):
    seen = {}
    monkeypatch.setattr(Q, "_search", lambda spark, d: (None, []))
    monkeypatch.setattr(Q.W, name, lambda rows, features, folds, *a, **b: seen.update(b, given=a) or [None])
    query(None, None)
    return seen


def test_walk_forward_has_the_budget_of_the_reference(monkeypatch):
    seen = _asked(monkeypatch, Q.walk_forward, "walk_forward")
    s = seen["settings"]
    assert (seen["seeds"], s.population, s.generations, s.components, s.hall_of_fame, s.tournament, s.batch_days) == (4, 300, 15, 4, 30, 20, None)


def test_complexity_sweep_has_the_budget_of_the_reference(monkeypatch):
    seen = _asked(monkeypatch, Q.complexity_sweep, "complexity_sweep")
    sizes, s = seen["given"]
    assert sizes == [10, 20, 30] and (seen["seeds"], s.islands, s.population, s.generations) == (3, 8, 33, 20)


def test_folds_and_sizes_take_turns_together(rows, monkeypatch):
    turns, plain = [], N.population_ic
    monkeypatch.setattr(N, "population_ic", lambda rows, nodes, *a, **k: turns.append(len(nodes)) or plain(rows, nodes, *a, **k))
    settings = N.Settings(population=8, generations=3, tournament=3)
    folds = _folds(rows)
    got = W.complexity_sweep(rows, ["a", "b"], folds, [3, 7], settings, seeds=2).orderBy("most_size").collect()
    assert len(turns) <= 3  # not one for each size, fold and seed
    apart = [W.complexity_sweep(rows, ["a", "b"], folds, [size], settings, seeds=2).first() for size in (3, 7)]
    for one, two in zip(got, apart, strict=True):
        assert one.asDict() == pytest.approx(two.asDict())
    fold = folds[1]
    results, oos = W.walk_forward(rows, ["a", "b"], folds, seeds=2, settings=settings)
    own = N.mine_seeds(N.Genetic(settings), rows.where(F.col("date") <= F.lit(fold.train_cutoff)), ["a", "b"], "fwd_ret", [0, 1])
    two = results.where("fold = 2").first()
    assert two.formulas == own.formulas and two.train_rows == 24 * 40 and two.test_rows == oos.where("fold = 2").count() == 240


def test_a_pool_as_arrays_is_the_pool_as_columns(rows):
    texts = ["div(a, b)", "log(mul(a, 0.001))", "inv(sub(a, a))", "max(a, neg(sqrt(b)))", "0.25"]
    gaps = rows.withColumn("b", F.when(F.col("ticker") != "t03", F.col("b"))).withColumn("a", F.when(F.col("ticker") == "t04", 1e308).otherwise(F.col("a")))
    for dialect in ("protected", "plain"):
        names = [f"f{k}" for k in range(len(texts) + 1)]
        both = [*texts, "mul(a, mul(a, 10.0))"]
        want = X.evaluate(gaps, both, dialect).select("date", "ticker", *names).orderBy("date", "ticker").collect()
        got = formula_columns(gaps, [X.parse(t) for t in both], names, dialect, ["date", "ticker"]).orderBy("date", "ticker").collect()
        for x, y in zip(got, want, strict=True):
            assert [v is None for v in x] == [v is None for v in y] and list(x)[:2] == list(y)[:2]
            assert [v for v in x[2:] if v is not None] == pytest.approx([v for v in y[2:] if v is not None], rel=1e-14)


def test_a_wide_pool_has_the_same_gram(rows):
    wide = rows.withColumns({f"c{k}": F.sin(F.col("a") * (k + 1)) for k in range(C.NARROW + 1)})
    names = [f"c{k}" for k in range(C.NARROW + 1)]
    some = C.gram(wide, names[:-1], "fwd_ret")
    every = C.gram(wide, names, "fwd_ret")
    assert every.n == some.n and every.xx[:-1, :-1] == pytest.approx(some.xx) and every.yy == pytest.approx(some.yy)
    assert C.gram(wide.limit(0), names, "fwd_ret").n == 0
