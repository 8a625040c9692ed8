"""Boosted trees against a plain version that grows the best leaf first, one at a time."""

import heapq
import math
import random

import numpy as np
import pytest

from ridgeline.operators.boosting import boost, predicted
from ridgeline.operators.models import boosted_trees_fit_predict


def plain(x, y, trees, depth, leaves, rate, share, least, seed=0):
    """Exact greedy growth on the distinct values themselves (fewer of them than bins)."""
    base = sum(y) / len(y)
    unit = 2.0 ** (math.ceil(math.log2(max(y) - min(y))) - 30)
    score, out = [base] * len(y), []
    width = len(x[0])

    def cut(rows, g, columns):
        best = None
        for f in columns:
            for v in sorted({x[r][f] for r in rows})[:-1]:
                left = [r for r in rows if x[r][f] <= v]
                right = [r for r in rows if x[r][f] > v]
                if len(left) < least or len(right) < least:
                    continue
                gl, gr = sum(g[r] for r in left), sum(g[r] for r in right)
                gain = gl * gl / len(left) + gr**2 / len(right) - (gl + gr) * (gl + gr) / len(rows)
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, f, v, left, right)
        return best

    for k in range(trees):
        columns = sorted(random.Random(f"{seed} {k}").sample(range(width), max(1, round(share * width))))
        g = [round((a - b) / unit) for a, b in zip(y, score, strict=True)]
        ends, n, tick = [], 1, 0
        first = list(range(len(y)))
        heap = [(-c[0], 0, 0, first, c)] if (c := cut(first, g, columns)) else ends.append(first) or []
        splits = []
        while heap:
            _, _, deep, rows, c = heapq.heappop(heap)
            if n >= leaves:
                ends.append(rows)
                continue
            n += 1
            splits.append((c[1], c[2]))
            for part in c[3:]:
                tick += 1
                more = cut(part, g, columns) if deep + 1 < depth else None
                heapq.heappush(heap, (-more[0], tick, deep + 1, part, more)) if more else ends.append(part)
        for rows in ends:
            step = rate * unit * sum(g[r] for r in rows) / len(rows)
            for r in rows:
                score[r] += step
        out.append(sorted(splits))
    return base, score, out


@pytest.mark.parametrize(("leaves", "depth"), [(31, 3), (4, 4)])
def test_trees_equal_the_plain_version(spark, leaves, depth):
    rng = random.Random(2)
    x = [[float(rng.randrange(12)), rng.randrange(9) / 4, float(rng.randrange(3)), round(rng.gauss(0, 1), 1)] for _ in range(300)]
    y = [a * 0.3 - (b > 1) * 2 + c * a * 0.1 + rng.gauss(0, 0.3) for a, b, c, _ in x]
    frame = spark.createDataFrame([(*a, b) for a, b in zip(x, y, strict=True)], "a double, b double, c double, d double, y double").repartition(5)
    model = boost(frame, list("abcd"), "y", trees=13, depth=depth, leaves=leaves, rate=0.3, column_share=0.75, least=8)
    base, score, splits = plain(x, y, 13, depth, leaves, 0.3, 0.75, 8)
    assert model.base == pytest.approx(base, abs=1e-12)
    got = [sorted((f, v) for f, v in zip(t.feature, t.threshold, strict=True) if f >= 0) for t in model.trees]
    assert got == splits and all(t.feature.count(-1) <= leaves for t in model.trees)
    assert predicted(model.trees, model.base, np.array(x)) == pytest.approx(score, abs=1e-7)
    assert model.importance() == [sum(s[0] == f for t in splits for s in t) for f in range(4)]
    assert sum(model.importance("gain")) > 0
    again = boost(frame.repartition(2), list("abcd"), "y", trees=13, depth=depth, leaves=leaves, rate=0.3, column_share=0.75, least=8)
    assert again.trees == model.trees


def test_fit_predict_and_edge_cases(spark):
    rng = random.Random(4)
    rows = [(a := rng.gauss(0, 1), rng.gauss(0, 1), 2.0 * (a > 0.2) + rng.gauss(0, 0.1)) for _ in range(600)] + [(None, 0.0, 1.0), (float("nan"), 0.1, 1.0), (0.3, 0.1, None)]
    frame = spark.createDataFrame(rows, "a double, b double, fwd_ret double")
    scored, importance = boosted_trees_fit_predict(frame, frame, ["a", "b"], trees=60)
    known = [(r.alpha, r.fwd_ret) for r in scored.collect() if r.fwd_ret is not None]
    assert np.corrcoef(*zip(*known, strict=True))[0, 1] > 0.95
    ranked = {r.feature: r.importance for r in importance.collect()}
    assert ranked["a"] > 0
    gains = {r.feature: r.importance for r in boosted_trees_fit_predict(frame, frame, ["a", "b"], 5, "gain")[1].collect()}
    assert gains["a"] > 20 * gains["b"]
    for none in (frame.where("false"), frame.where("fwd_ret = 1.0")):
        assert boost(none, ["a", "b"]).trees == []
    with_gaps = boost(frame, ["a", "b"], trees=2)
    assert frame.select(with_gaps.alpha().alias("p")).where("p is null").count() == 0


def test_one_task_boosts_as_jobs_do(spark, monkeypatch):
    """A small table is boosted by one task, in a few jobs for any number of trees; the trees are those of a job a level."""
    from ridgeline.operators import boosting as B

    rng = random.Random(6)
    data = [(a := rng.gauss(0, 1), b := float(rng.randrange(7)), rng.gauss(0, 1) if rng.random() < 0.9 else None, a * b + rng.gauss(0, 0.5)) for _ in range(900)]
    frame = spark.createDataFrame(data, "a double, b double, c double, y double").repartition(3)
    spark.sparkContext.setJobGroup("one task", "")
    model = boost(frame, list("abc"), "y", trees=24, rate=0.2)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("one task")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 10 and len(model.trees) == 24 and sum(model.importance()) > 100
    monkeypatch.setattr(B, "ALONE", 0)
    assert boost(frame, list("abc"), "y", trees=24, rate=0.2) == model


def test_best_cut_is_that_of_exact_sums():
    from ridgeline.operators.boosting import best_cut

    rng = np.random.default_rng(5)
    for case in range(60):
        n = rng.integers(0, 30, (4, 9))
        n[:, -1] += n.sum(axis=1).max() - n.sum(axis=1)
        g = rng.integers(-(2**36), 2**36, (4, 9)) * (n > 0)
        g[:, 0] += g.sum(axis=1).max() - g.sum(axis=1)
        if case % 3 == 0:
            g[2], n[2] = g[1], n[1]  # a tie goes to the first feature
        want = None
        for f in (1, 2, 3):
            for b in range(9):
                gl, nl, total, rows = int(g[f, : b + 1].sum()), int(n[f, : b + 1].sum()), int(g[f].sum()), int(n[f].sum())
                if nl >= 5 and rows - nl >= 5:
                    gain = gl * gl / nl + (total - gl) ** 2 / (rows - nl) - total * total / rows
                    if gain > 0 and (want is None or gain > want[0]):
                        want = (gain, f, b, (gl, nl), (total - gl, rows - nl))
        assert best_cut(g, n, [1, 2, 3], 5) == want


def test_preflight_has_all_trees(monkeypatch):
    from ridgeline.operators import models as M
    from ridgeline.plans import queries as Q

    seen = {}
    monkeypatch.setattr(Q, "_search", lambda spark, d: (None, []))
    monkeypatch.setattr(Q.W, "preflight", lambda rows, features, folds, top_n=None, trees="boosted_trees": seen.update(trees=trees) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        Q.preflight(None, None)
    assert M.FIT_PREDICT[seen["trees"]] is M.boosted_trees_fit_predict and M.boosted_trees_fit_predict.__defaults__[0] == 200
