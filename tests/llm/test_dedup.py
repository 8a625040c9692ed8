import hashlib
import random
import re
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ridgeline.llm.exact_dedup import DigestIndex, exact_dedup
from ridgeline.llm import minhash
from ridgeline.llm.minhash import near_dedup
from ridgeline.llm.shared import fresh_path, scratch

ROOT = str(Path(__file__).resolve().parents[2])
SPACE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, n_shingles int, key string, component string, digest string"


def frame(spark, rows):
    """Documents with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, None, None, "k", "c", None) for i, t in rows], DOCS)


def shingles(text):
    words = [w for w in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def sample(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO"), (5, "ONE two three four five"), (6, "é É ß 世界 é")]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 40, 90, 3000]))]
        for share in (0, 0, 0.004, 0.01, 0.02, 0.05, 0.3):
            rows.append((len(rows), " ".join(rng.choice(vocab) if rng.random() < share else w for w in base)))
    return rows


def test_near_dedup_against_all_pairs(spark):
    rows = sample()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(frame(spark, rows).repartition(5)).collect()}
    assert got == brute(rows)


def test_near_dedup_of_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(docs).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("block", [4, 1024])
def test_near_dedup_chain_through_other_centres(spark, monkeypatch, block):
    """A bucket whose smallest node links with nobody must not hide the links among its other members, nor must the
    blocks that it is looked through in."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(3)
    base = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(40):
        words = list(base)
        at = rng.randrange(0, 260)
        words[at : at + 25] = [f"x{i}_{j}" for j in range(25)]
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_members_that_share_a_bucket_by_chance_go(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(100_000)}" for _ in range(60))) for i in range(40)]
    rows += [(40 + i, rows[3][1] + f" tail{i} of the text") for i in range(5)]
    sketched = frame(spark, rows).select("doc_id", "text").mapInArrow(minhash._sketch, ", ".join(["doc_id long, n_shingles long, node long, bands array<long>", *minhash._SIGNED])).cache()
    nodes = sketched.select("node", "doc_id", *minhash._SIG)
    one_bucket = nodes.select(F.lit(1).cast("long").alias("key"), "node", F.col("node").alias("component"), F.lit(45).alias("members"))
    kept = minhash._alike(one_bucket, nodes, minhash.least_estimate(0.75)).join(nodes, "node")
    assert sorted(r.doc_id for r in kept.collect()) == [3, 40, 41, 42, 43, 44]
    sketched.unpersist()


def test_near_dedup_id_repeated_with_other_text(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (2, b + " tail"), (9, a + " tail")]
    got = sorted((r.doc_id, r.component_id) for r in near_dedup(frame(spark, rows)).collect())
    assert got == [(2, 2), (5, 2), (5, 5), (9, 5)]


def test_near_dedup_empty_and_repeated_rows(spark):
    assert near_dedup(frame(spark, [])).count() == 0
    assert {r.doc_id: r.component_id for r in near_dedup(frame(spark, [(2, "only three words"), (1, "Only three WORDS")]).coalesce(1)).collect()} == {1: 1, 2: 1}
    assert [r.n_shingles for r in near_dedup(frame(spark, [(2, "word")])).collect()] == [1]
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F"), (3, None), (3, "")]
    got = sorted(tuple(r) for r in near_dedup(frame(spark, rows)).select(F.coalesce("doc_id", F.lit(-1)), "n_shingles", F.coalesce("component_id", F.lit(-1)), "kept").collect())
    assert got == [(-1, 2, -1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (3, 0, 3, True)]


def test_exact_dedup(spark):
    rows = [(5, "a b"), (2, "a \n\t b"), (9, "A b"), (7, None), (6, ""), (8, " "), (3, "  "), (2, "a b"), (4, "x" * 200_000), (1, "x" * 200_000)]
    got = exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(SPACE.sub(" ", t or "").encode()).hexdigest()].append(i)
    for r in got:
        assert (r.keep_id, r.group_size) == (min(groups[r.text_sha256]), len(groups[r.text_sha256])) and r.doc_id in groups[r.text_sha256]
        assert not r.kept or r.doc_id == r.keep_id
    assert sorted(r.doc_id for r in got if r.kept) == sorted(min(g) for g in groups.values())
    assert exact_dedup(frame(spark, [])).count() == 0


def test_digest_index_grows_and_remembers(spark):
    path = fresh_path(spark, "test-index")
    first = DigestIndex(spark, path, 4).dedup(frame(spark, [(10, "a"), (11, "b")])).collect()
    assert all(r.kept for r in first)
    second = {r.doc_id: (r.keep_id, r.kept) for r in DigestIndex(spark, path, 4).dedup(frame(spark, [(1, "a"), (12, "c"), (13, "c")])).collect()}
    assert second == {1: (10, False), 12: (12, True), 13: (12, False)}
    assert DigestIndex(spark, path, 4).read().count() == 3


def test_digest_index_is_read_without_a_shuffle_or_sort(spark):
    index = DigestIndex(spark, buckets=4)
    for k in range(2):
        index.dedup(frame(spark, [(k, f"a{k}"), (9, "same")]))
    index = index.compacted()
    assert index.read().count() == 3
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    try:
        plan = index.read().join(index.read().hint("merge").withColumnRenamed("keep_id", "k"), "digest")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
    assert "Exchange" not in plan and "Sort " not in plan and "SortMergeJoin" in plan
    assert [r.kept for r in index.dedup(frame(spark, [(20, "a1"), (21, "new")])).orderBy("doc_id").collect()] == [False, True]


def verdicts(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.kept, r.group_size) for r in df.collect()), key=str)


def test_digest_index_gives_a_batch_its_verdicts_again(spark, monkeypatch):
    path = fresh_path(spark, "test-index")
    rows = [(1, "a"), (1, "a"), (None, "b"), (None, "b"), (3, "c")]
    first = verdicts(DigestIndex(spark, path, 4).dedup(frame(spark, rows), batch="first"))
    assert [r[2] for r in first].count(True) == 3
    assert verdicts(DigestIndex(spark, path, 4).dedup(frame(spark, rows).repartition(3), batch="first")) == first
    # other batches, one with a name, of which none stays
    assert not any(r[2] for r in verdicts(DigestIndex(spark, path, 4).dedup(frame(spark, rows[:2]))))
    assert not any(r[2] for r in verdicts(DigestIndex(spark, path, 4).dedup(frame(spark, rows), batch="next")))
    assert DigestIndex(spark, path, 4).read().count() == 3

    more = [(10, "d"), (11, "c"), (12, "d")]
    with monkeypatch.context() as m:
        m.setattr("ridgeline.llm.exact_dedup.join_hot", lambda *a: 1 / 0)  # the driver is lost after the append
        with pytest.raises(ZeroDivisionError):
            DigestIndex(spark, path, 4).dedup(frame(spark, more), batch="more")
    assert verdicts(DigestIndex(spark, path, 4).dedup(frame(spark, more), batch="more")) == [(10, 10, True, 2), (11, 3, False, 1), (12, 10, False, 2)]


def test_documents_delivered_again_are_duplicates(spark):
    index = DigestIndex(spark, buckets=4)
    rows = [(1, "a"), (2, "b")]
    assert all(r[2] for r in verdicts(index.dedup(frame(spark, rows))))
    assert not any(r[2] for r in verdicts(index.dedup(frame(spark, rows))))
    assert [r[2] for r in verdicts(index.dedup(frame(spark, [*rows, (3, "c")])))] == [False, False, True]


def test_digest_index_opened_by_another_process(spark, tmp_path):
    import subprocess
    import sys

    path = str(tmp_path / "index")
    DigestIndex(spark, path, 4).dedup(frame(spark, [(1, "a"), (2, "b")]))
    code = f"""
from pyspark.sql import SparkSession
from ridgeline.llm.exact_dedup import DigestIndex
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {str(tmp_path / 'w')!r}).config("spark.checkpoint.dir", {str(tmp_path / 'c')!r}).getOrCreate()
docs = spark.createDataFrame([(5, "b"), (6, "c")], "doc_id long, text string")
print("GOT", sorted((r.doc_id, r.keep_id, r.kept) for r in DigestIndex(spark, {path!r}, 4).dedup(docs).collect()))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(tmp_path), env={**__import__("os").environ, "PYTHONPATH": ROOT}, timeout=300)
    assert "GOT [(5, 2, False), (6, 6, True)]" in out.stdout, out.stderr[-2000:]
    spark.catalog.refreshTable(DigestIndex(spark, path, 4).table)
    assert DigestIndex(spark, path, 4).read().count() == 3


def test_hot_digests_are_joined_by_broadcast(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(900)]
    got = exact_dedup(frame(spark, rows))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got.collect()} == {i: (0, 300) if i % 3 == 0 else (i, 1) for i, _ in rows}


def test_scratch_folders_go(spark):
    import os

    with scratch(spark):
        path = fresh_path(spark, "gone")
        spark.range(3).write.parquet(path)
        assert os.path.exists(path)
    assert not os.path.exists(path)


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op6_suffix_array_dedup", "op8_minhash_near_dedup"])
def test_queries_against_sql(spark, name):
    import duckdb

    from ridgeline.llm import oracle_sql, queries

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall())
