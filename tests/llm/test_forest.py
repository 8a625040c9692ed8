import math

import numpy as np
from pyspark.sql import functions as F

from ridgeline.llm import forest
from ridgeline.llm.forest import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, q long, v string, score double"


def brute(rows, k=20, every=20):
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in usable:
        if i % every == 0:
            scored = sorted(((-float((v * w).sum()), j) for j, w in usable if j != i))[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def run(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, 0, 1, "x", 0.5) for i, v in rows], SCHEMA)
    got = {}
    for r in nearest(frame, F.col("id") % 20 == 0, **more).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def recall(got, want):
    return np.mean([len({j for j, _ in got.get(i, [])} & {j for j, _ in w}) / len(w) for i, w in want.items() if w])


def test_odd_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(120)]
    rows += [(500, None), (520, [0.0] * 6), (540, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (560, [float("nan")] * 6), (580, [float("inf")] + [0.0] * 5), (600, []), (620, [1.0])]
    rows = [r for r in rows if r[1] is None or len(r[1]) != 6 or any(x != 0 for x in map(lambda y: y or 0, r[1])) or r[0] >= 500]
    got, want = run(spark, rows, search=1e9), brute([r for r in rows if r[1] is None or len(r[1]) == 6])
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i] == w
    assert run(spark, []) == {}
    assert run(spark, [(20, [1.0, 0.0])]) == {}
    assert run(spark, [(20, [1.0, 0.0]), (21, [0.5, 0.0])]) == {20: [(21, 0.5)]}


def test_recall_on_driver_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want, got = brute(rows), run(spark, rows)
    assert recall(got, want) >= 0.9
    scores = {i: dict(w) for i, w in want.items()}
    assert all(abs(s - scores[i][j]) < 1e-12 for i, g in got.items() for j, s in g if j in scores[i])


def test_small_groups_and_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(900)] + [(900 + i, [1.0] * 8) for i in range(400)]
    want = run(spark, rows, search=0.6)
    monkeypatch.setattr(forest, "GROUP_BYTES", 4000)
    monkeypatch.setattr(forest, "QUERY_BLOCK", 3)
    assert run(spark, rows, search=0.6) == want


def clustered(rng, n, clusters, dim=16):
    centres = rng.normal(size=(clusters, dim))
    return [(i, (centres[i % clusters] + rng.normal(size=dim) * 0.05).tolist()) for i in range(n)]


def test_clustered_vectors_need_a_small_share(spark):
    rows = clustered(np.random.default_rng(8), 3000, 60)
    assert recall(run(spark, rows, search=0.15, leaf_rows=60), brute(rows)) >= 0.9


def test_the_depth_of_the_search_is_measured(spark, monkeypatch):
    found = []
    plain = forest.needed
    monkeypatch.setattr(forest, "needed", lambda *a: found.append(plain(*a)) or found[-1])
    rng = np.random.default_rng(8)
    rows = clustered(rng, 6000, 100)
    assert recall(run(spark, rows, leaf_rows=60), brute(rows)) >= 0.9 and found[0] < 0.15 * len(rows)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(1500)]
    assert recall(run(spark, rows), brute(rows)) >= 0.9 and found[1] > found[0]


def test_probe_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (500, 5)).astype(float)
    entries = spark.createDataFrame([(r.tolist(),) for r in np.unique(x, axis=0)], "v array<double>").repartition(4)
    for q, got in zip(x[:9], forest.probe(entries, x[:9], 7, 5), strict=True):
        others = np.unique(x, axis=0)
        others = others[~(others == q).all(axis=1)]
        assert sorted((got @ q).tolist()) == sorted(np.sort(others @ q)[-7:].tolist()) and not (got == q).all(axis=1).any()
