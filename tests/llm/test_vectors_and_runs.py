"""Codes by parts, exact top-k search and periodic runs against plain Python, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm.impact_search import Block, post, top_products
from ridgeline.llm.periodic_runs import looped, periodic_runs, strongest, word_runs
from ridgeline.llm.queries import op12_periodic_runs
from ridgeline.llm.vector_codes import cuts, label_errors, lloyd_codes

VECTORS = "vec_id long, embedding array<float>, label int, x int, code string"


def _usable(rows, scale):
    out = []
    for r in rows:
        v = r[1]
        if v and all(c is not None and math.isfinite(c) for c in v):
            out.append((r[0], [math.floor(scale * float(np.float32(c))) for c in v], r[2]))
    most = defaultdict(int)
    for _, v, _ in out:
        most[len(v)] += 1
    dim = min(most, key=lambda d: (-most[d], d), default=0)
    return [r for r in out if len(r[1]) == dim]


def _table(n, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(c) for c in rng.normal(0, spread, dim)], int(rng.integers(0, 3)) if i % 7 else None, i, "c") for i in range(n)]
    rows += [(n + 1, None, 1, 1, "c"), (n + 2, [0.1] * (dim - 1) + [None], 1, 1, "c"), (n + 3, [float("nan")] * dim, 1, 1, "c"), (n + 4, [], 1, 1, "c"), (n + 5, [0.5] * (dim + 3), 1, 1, "c")]
    return rows + [(n + 6, [0.0] * dim, 2, 1, "c"), (n + 6, [0.0] * dim, 2, 1, "c")] + [(n + 50 + k, rows[k][1], 0, 1, "c") for k in range(40)]


def _plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    dim = len(rows[0][1])
    b = cuts(dim, parts)
    books = [[r[1][b[k] : b[k + 1]] for r in rows[:entries]] for k in range(parts)]

    def nearest(v, k):
        part = v[b[k] : b[k + 1]]
        return min((sum((p - c) ** 2 for p, c in zip(part, e, strict=True)), i) for i, e in enumerate(books[k]))

    for _ in range(rounds):
        met = defaultdict(list)
        for _, v, _ in rows:
            for k in range(parts):
                met[k, nearest(v, k)[1]].append(v[b[k] : b[k + 1]])
        for (k, i), own in met.items():
            books[k][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return {r[0]: ([nearest(r[1], k)[1] for k in range(parts)], sum(nearest(r[1], k)[0] for k in range(parts))) for r in rows}, books


@pytest.mark.parametrize(("dim", "parts"), [(16, 8), (11, 4)])
def test_codes_match_plain_lloyd(spark, dim, parts):
    rows = _table(150, dim, 3)
    codes, books = lloyd_codes(spark.createDataFrame(rows, VECTORS).repartition(5), parts)
    want, want_books = _plain_codes(_usable(rows, 4096), parts)
    assert [b.tolist() for b in books] == want_books
    got = label_errors(codes).collect()
    assert len(got) == len(_usable(rows, 4096))
    by = defaultdict(int)
    for r in got:
        assert (list(r.code), r.error) == want[r.vec_id]
        by[r.label] += r.error
    assert all(r.label_error == by[r.label] for r in got)


def test_codes_of_few_and_no_rows(spark):
    rows = [(3, [1.0, -2.0, 0.5, 4.0], None, 1, "c"), (1, [1.0, -2.0, 0.5, 4.0], None, 1, "c"), (None, [0.0, 0.0, 0.0, 1.0], 2, 1, "c")]
    codes, books = lloyd_codes(spark.createDataFrame(rows, VECTORS), 2)
    assert [len(b) for b in books] == [3, 3]
    assert sorted((r.vec_id or 0, r.error) for r in label_errors(codes).collect()) == [(0, 0), (1, 0), (3, 0)]
    codes, books = lloyd_codes(spark.createDataFrame([(1, None, 1, 1, "c")], VECTORS))
    assert books == [] and label_errors(codes).columns == ["vec_id", "label", "code", "error", "label_error"] and not label_errors(codes).count()
    with pytest.raises(ValueError, match="largest"):
        lloyd_codes(spark.createDataFrame([(1, [1e30, 0.0], 1, 1, "c")], VECTORS))


def test_only_changed_parts_are_shuffled(spark):
    """Rows that keep their assignment bring nothing to the sums of later rounds."""
    from ridgeline.llm import vector_codes as V

    seen, plain = [], V._moved

    def counted(state, bounds):
        seen.append((state.where("changed").count(), state.count()))
        return plain(state, bounds)

    V._moved = counted
    try:
        rows = [(i, [float(i % 4), 1.0, 0.0, float(i % 4)], 1, 1, "c") for i in range(200)]
        lloyd_codes(spark.createDataFrame(rows, VECTORS), 2)
    finally:
        V._moved = plain
    assert seen[0] == (200, 200) and all(changed == 0 for changed, _ in seen[2:])


def _plain_top(rows, k, is_query):
    out = []
    for i, (qid, q, _) in enumerate(rows):
        if qid is not None and is_query(qid):
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), vid) for j, (vid, v, _) in enumerate(rows) if j != i and vid is not None)
            out += [(qid, n, vid, -s) for n, (s, vid) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.3, 0.004])
def test_top_products_match_brute_force(spark, spread):
    """Spread-out vectors, and coarse ones with many equal products; repeated rows and ids, a zero vector, null ids."""
    rows = [*_table(400, 12, 9, spread), (None, [9.0] * 12, 1, 1, "c")]
    got = top_products(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("id") % 10 == 0, block_rows=64)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == _plain_top(_usable(rows, 256), 5, lambda q: q % 10 == 0)


def test_top_products_of_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0], 1, 1, "c"), (50, [0.0, 0.0], 1, 1, "c"), (7, [-1.0, 0.5], 1, 1, "c")]
    got = top_products(spark.createDataFrame(rows, VECTORS), F.col("id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == _plain_top(_usable(rows, 256), 5, lambda q: q % 50 == 0)
    assert not top_products(spark.createDataFrame([], VECTORS), F.col("id") % 50 == 0).count()
    assert not top_products(spark.createDataFrame(rows[:1], VECTORS), F.col("id") % 50 == 0).count()


def test_a_block_is_left_on_proof():
    """On clustered rows the search of a block ends early; what it returns still holds all that reach the bar."""
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 60, (40, 32))
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 4, (4000, 32))).astype(np.int64)
    block = Block(np.arange(4000), x, *post(x))
    for q in range(20):
        truth = x @ x[q]
        truth[q] = np.iinfo(np.int64).min
        can, score, taken = block.search(x[q], 5, None, q, 100, int(np.abs(x).max()))
        assert np.array_equal(np.sort(score)[-5:], np.sort(truth)[-5:])
        assert set(np.flatnonzero(truth >= np.sort(truth)[-5])) <= set(can.tolist())
        assert taken < x.size * 0.7


def _plain_runs(w, least=24, times=3):
    found = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            run = w[s : i + p]
            if len(run) >= max(least, times * p) and not any(run[q:] == run[:-q] for q in range(1, p)):
                found.append((s, len(run), p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_word_runs_match_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        n, kinds = rng.randint(0, 200), rng.choice([1, 2, 3, 5, 50])
        w = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 9 else 0):
            a, p, long = rng.randrange(n), rng.randint(1, 30), rng.randint(1, 120)
            for i in range(a + p, min(n, a + long)):
                w[i] = w[i - p]
        least = rng.choice([24, 8, 3])
        s, e, q = word_runs(np.array(w, np.int64), n, least)
        assert list(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True)) == _plain_runs(w, least)


def test_word_runs_of_long_repetitive_texts_stay_fast():
    same = word_runs(np.zeros(300_000, np.int64), 300_000)
    assert [v.tolist() for v in same] == [[0], [300_000], [1]]
    block = np.random.default_rng(1).integers(0, 3, 997)
    s, e, q = word_runs(np.tile(block, 300), 997 * 300)
    assert (0, 997 * 300, 997) in set(zip(s.tolist(), e.tolist(), q.tolist(), strict=True))


def _words(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\v\f\r":
            out, word = (out + [word] if word else out), ""
        else:
            word += c
    return out + [word] if word else out


def _plain_row(doc_id, text):
    w = _words(text)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = _plain_runs(w)
    gone = {i for s, long, p in runs for i in range(s + p, s + long)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = best[1] * 1000 // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs_query_matches_plain_python(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \t\n ", "one", "a b " * 40, "é " * 30, "x " * 23, "x " * 24, "\x0b".join(["p", "q"] * 12) + "\r\n"]
    texts += [" ".join(rng.choices(["the", "of", "naïve", "cat", "日本", "dog"], k=rng.randint(1, 120))) for _ in range(120)]
    texts += [" ".join(["lead"] * rng.randint(0, 4) + list("abcdefg"[: rng.randint(1, 7)]) * rng.randint(4, 30) + ["tail"]) for _ in range(40)]
    rows = [(k, t, k, 1, "n") for k, t in enumerate(texts)] + [(None, "a b " * 20, 1, 1, "n"), (5, "é " * 30, 1, 1, "n"), (-3, "z " * 50, 1, 1, "n")]
    spark.createDataFrame(rows, "doc_id long, text string, start long, runs int, collapsed string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    got = sorted(map(tuple, op12_periodic_runs(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted((_plain_row(d, t) for d, t, *_ in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 30


def test_long_texts_and_empty_tables(spark):
    rng = random.Random(2)
    long = [rng.choice("abcdefghijklmnop") + str(rng.randrange(500)) for _ in range(300_000)]
    long[100_000:200_000] = [long[100_000 + i % 777] for i in range(100_000)]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, "w " * 400_000), (3, "q")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs(docs).withColumn("best", strongest(F.col("runs"))).collect()}
    assert [(r.start <= 100_000, r.length >= 100_000, r.period) for r in got[1].runs] == [(True, True, 777)] and got[1].n_words == 300_000
    assert (got[2].best.length, got[2].best.period, got[2].collapsed) == (400_000, 1, "w")
    assert got[3].best is None and got[3].collapsed == "q" and not got[3].runs
    assert not periodic_runs(docs.where("false")).count()
    assert docs.where("doc_id = 3").select(looped(F.col("doc_id"), F.col("text")).alias("t")).first().t == "q"
