import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ridgeline.llm import language_id as N
from ridgeline.llm import quality as Q
from ridgeline.llm.shared import held_out

SF = "/root/testdata/sf0.001"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9001, None, "en", "s", 0), (9002, "123 !? 456", "en", "s", 0), (9003, "", None, "s", 0), (None, "The and of that with this", None, None, 0), (9004, "Die und der mit das ist nicht", "de", "s", 0), (9004, "Die und der mit das ist nicht", "de", "s", 0)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("score", F.lit("clash"))
    got = N.identify(both, held_out(F.col("doc_id"), 3)).collect()
    assert len(got) == docs.count() + len(odd)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    test = [r for r in got if r.held_out and r.doc_id in lang]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in test]) >= 0.97
    by = {r.doc_id: r for r in got if r.doc_id in (9001, 9002, 9003)}
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in by.values())
    assert all(0 <= r.score <= 1 for r in got)


def test_language_without_training_rows_and_empty(spark):
    frame = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    (row,) = N.identify(frame, F.lit(False)).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)
    assert N.identify(frame.limit(0), F.lit(False)).count() == 0


def test_sample_of_a_language_is_bounded(spark):
    rows = [(i % 40, f"the text number {i}" if i % 2 else f"der satz nummer {i}", "en" if i % 2 else "de") for i in range(4000)] + [(7, "the", "en")] * 3000
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    a, b = N.fit(frame, 20), N.fit(frame.repartition(3), 20)
    assert a.languages == ["de", "en"] and (a.weights == b.weights).all() and (a.idf == b.idf).all()


def test_predictions_against_plain_sums(spark):
    """Scores of the whole query from its model: n-grams counted one by one, in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    model = N.fit(spark.read.parquet(f"{SF}/documents.parquet"), 200)
    got = {r.doc_id: (r.lang_pred, r.score) for r in N.predict(docs, model).collect()}
    for r in docs.collect():
        points, first = N.letters(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())]))
        folded = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in r.text]
        assert points.tolist() == folded
        weight, total = np.zeros(len(model.languages)), 0.0
        for bucket, ok in N.grams(points, first):
            for cell in bucket[ok]:
                weight += model.weights[cell] * model.idf[cell]
                total += model.idf[cell]
        z = (weight * N.SCALE / total + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[r.doc_id][0] == model.languages[int(p.argmax())] and abs(got[r.doc_id][1] - p.max()) < 1e-6


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    rows, y = [], np.repeat([0, 1], 100)
    for c in y:
        cells = np.unique(rng.integers(0, 50, 12) + 100 * c)
        rows.append((cells, np.full(len(cells), 1.0)))
    w, bias = N.ftrl(rows, y, 2)
    assert (w == 0).mean() > 0.99
    assert all((v @ w[c] + bias).argmax() == k for (c, v), k in zip(rows, y, strict=True))


def test_quality_of_labelled_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(got[i].kept for i, q in want.items() if q) and np.mean([not got[i].kept for i, q in want.items() if not q]) >= 0.9


def plain_strength(sites, mu):
    n, k = sum(len(v) for v in sites.values()), len(sites)
    if k < 2:
        return 10.0
    spread = sum(len(v) * (np.mean(v) - mu) ** 2 for v in sites.values()) / n - mu * (1 - mu) * k / n
    return float(np.clip(mu * (1 - mu) / max(spread, 1e-9) - 1, 1, 1e4))


def test_combined_quality_against_plain_sums(spark):
    """The whole output from p_doc on: site sums with labels, strengths by moments, rates, odds and verdicts."""
    rng = random.Random(1)
    docs = [(i, "plain words of a text " * rng.randrange(1, 9) + ("!!! $$$ 12345 " * 9 if i % 4 == 0 else ""), f"h{i % 3 if i % 7 else 9}" if i % 11 else None, f"p{i % 5}", i) for i in range(200)]
    docs += [(5, "again another text", "h1", "p1", 0), (5, "again another text", "h1", "p1", 0)]
    labels = [(i, 0 if i % 4 == 0 else 1) for i in range(0, 200, 3)] + [(0, 1), (12, None), (None, 1), (999, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, said int").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = sorted((r.doc_id, r.p_doc, r.host_rate, r.path_rate, r.quality, r.kept) for r in Q.classify(frame, known).collect())
    model = Q.fit(frame, known)
    label = {}
    for i, q in labels:
        if i is not None and q is not None:
            label[i] = min(label.get(i, 1.0), float(q > 0))
    rows = []
    for i, text, host, lang, _ in docs:
        raw = np.frombuffer(text.encode(), np.uint8)
        p = float(model.judge(raw, np.array([0, len(raw)]))[0])
        rows.append((i, p, label.get(i, p), host or "", f"{host}/{lang}" if host else lang))
    hosts, paths = {}, {}
    for _, _, said, h, path in rows:
        hosts.setdefault(h, []).append(said)
        paths.setdefault((h, path), []).append(said)
    mu = (sum(r[2] for r in rows) + 1) / (len(rows) + 2)
    a, b = plain_strength(hosts, mu), plain_strength(paths, mu)
    want = []
    for i, p, said, h, path in rows:
        host = (sum(hosts[h]) - said + a * mu) / (len(hosts[h]) - 1 + a)
        rate = (sum(paths[h, path]) - said + b * host) / (len(paths[h, path]) - 1 + b)
        safe = min(max(rate, 1e-6), 1 - 1e-6)
        odds = p / (1 - p) * safe / (1 - safe) / (mu / (1 - mu))
        want.append((i, p, host, rate, odds / (1 + odds), odds / (1 + odds) >= 0.5))
    for g, w in zip(got, sorted(want), strict=True):
        assert g[0] == w[0] and np.allclose(g[1:5], w[1:5], atol=1e-9) and g[5] == w[5]
    kept = sorted((r.doc_id, r.text) for r in Q.keep_good(frame, known).collect())
    assert len(kept) == sum(g[5] for g in got) and Q.keep_good(frame, known).columns == frame.columns


def test_sites_of_addresses(spark):
    urls = ["https://User@Blog.Example.com:80/en/a/b.html?q=/x#y", "http://example.org", "http://example.org/page", "no address", None]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [tuple(r) for r in rows.select(*Q.url_sites(F.col("url"), 4)).collect()]
    assert got == [("blog.example.com", "blog.example.com/en", "blog.example.com/en/a", "blog.example.com/en/a"), *[("example.org",) * 4] * 2, *[("",) * 4] * 2]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), "url")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    out = Q.classify(pages, labels, Q.url_sites(F.col("url")))
    assert out.columns == ["doc_id", "p_doc", "host_rate", "path_rate", "path2_rate", "quality", "kept"] and out.count() == pages.count()


def test_words_tell_good_from_bad(spark):
    """Texts alike in layout, of which only the words differ."""
    rng = random.Random(2)
    good, bad = [[f"{c}{k:03}" for k in range(60)] for c in "ab"]
    rows = [(i, " ".join(rng.choice(bad if i % 2 else good) for _ in range(40)), "s", "en") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(150)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in Q.classify(frame, labels).collect()}
    assert np.mean([got[i] == (i % 2 == 0) for i in range(150, 300)]) > 0.95


def test_quality_edges(spark):
    schema = "doc_id long, text string, lang string, source string, p_doc double, quality int"
    frame = spark.createDataFrame([(1, None, None, None, 0.1, 1), (1, "", None, "s", 0.1, 1), (None, "x " * 5000, "en", "s", 0.1, 1)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept for r in Q.classify(frame, none).collect()) and Q.classify(frame, none).count() == 3
    assert Q.classify(frame.limit(0), none).count() == 0
