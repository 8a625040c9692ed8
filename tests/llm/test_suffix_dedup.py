import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ridgeline.llm import suffix_dedup
from ridgeline.llm.suffix_dedup import remove_repeats, suffix_order

W = 200


def brute(rows):
    seen = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raws:
        seen.update(b[p : p + W] for p in range(len(b) - W + 1))
    out = []
    for i, b in raws:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - W + 1):
            if seen[b[p : p + W]] > 1:
                gone[p : p + W] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_with_repeats():
    rng = random.Random(4)

    def prose(n):
        return "".join(rng.choice("abcdefgh éß世") for _ in range(n))

    shared = [prose(n) for n in (199, 200, 201, 350, 1500)]
    rows = [(0, None), (1, ""), (2, prose(150)), (3, "ab" * 400), (4, "z" * 5000), (5, prose(900)), (5, prose(900))]
    for k in range(40):
        parts = [prose(rng.randrange(20, 400))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(0, 40) if len(s) > 300 else 0
            parts += [s[a : len(s) - rng.randrange(0, 40)] if len(s) > 300 else s, prose(rng.randrange(0, 300))]
        rows.append((10 + k, "".join(parts)))
    rows += [(90, rows[12][1]), (91, rows[12][1]), (91, rows[12][1])]
    return rows


def test_suffix_order_against_sorting():
    rng = np.random.default_rng(1)
    for kinds, n in ((2, 700), (1, 500), (4, 900), (256, 400), (3, 1), (3, 2)):
        data = rng.integers(0, kinds, n).astype(np.uint8)
        data[n // 2 :] = data[: n - n // 2]
        raw = data.tobytes()
        order, same = suffix_order(data)
        cut = [raw[i : i + W] for i in order]
        assert sorted(order) == list(range(n)) and cut == sorted(cut)
        assert [x == y for x, y in zip(cut, cut[1:], strict=False)] == list(same[1:])


def test_against_every_window(spark):
    rows = rows_with_repeats()
    frame = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in rows], "doc_id long, text string, start int, raw string, n int").repartition(4)
    got = [tuple(r)[:5] for r in remove_repeats(frame).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_large_anchors_are_counted_by_window(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGE_ANCHOR", 600)
    rows = rows_with_repeats()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r)[:5] for r in remove_repeats(frame).collect()), key=str) == brute(rows)


def test_text_of_several_segments(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4_500_000))
    at = suffix_dedup.SEGMENT - 450  # over the border of two segments
    long = long[:at] + passage + long[at + 900 :]
    rows = [(1, long), (2, "before " + passage + " after")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == len(long) and 900 <= got[1][1] <= 905 and got[1][2] == 1 and 900 <= got[2][1] <= 905 and got[2][2] == 1


def test_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r)[:5] for r in remove_repeats(docs).collect()), key=str) == brute(rows)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_equal_rows_of_one_id_count_once(spark):
    """Rows that repeat an id and text, in names that the operator might use itself: each loses what both have, and the
    work doesn't grow with the square of their number."""
    import time

    text = " ".join(f"w{(k * 37) % 211}" for k in range(500))
    took = {}
    for name, rows in (("warm", [(k, text, k) for k in range(50)]), ("many ids", [(k, text, k) for k in range(1500)]), ("one id", [(7, text, k) for k in range(1500)])):
        docs = spark.createDataFrame(rows, "doc_id long, text string, _hash int").withColumn("_LO", F.lit("x"))
        began = time.time()
        got = {tuple(r) for r in remove_repeats(docs, carry=["_hash", "_LO"]).select("n_removed", "n_spans", "_LO").collect()}
        took[name] = time.time() - began
        assert got == {(len(text), 1, "x")}
    assert took["one id"] < 2 * took["many ids"] + 2
