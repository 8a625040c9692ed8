import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    from test_dedup import brute as near_brute
    from test_packing import PATH, check_layout, expected
    from test_suffix_dedup import brute as passage_brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs.orderBy("doc_id").collect()
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    final = docs.collect()

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r.doc_id for r in seen["exact_dedup"]}
    known = [r.doc_id for r in seen["quality"] if r.doc_id in labels]
    assert all(i in good for i in known if labels[i]) and sum(i in good for i in known if not labels[i]) <= 1
    texts = {}
    for r in seen["exact_dedup"]:
        texts.setdefault(" ".join(r.text.split()), r.doc_id)
    assert sorted(texts.values()) == [r.doc_id for r in seen["near_dedup"]]
    want = near_brute([(r.doc_id, r.text) for r in seen["near_dedup"]])
    assert sorted(i for i, (_, _, kept) in want.items() if kept) == [r.doc_id for r in seen["suffix_dedup"]]
    left = {i: n - gone for i, n, gone, *_ in passage_brute([(r.doc_id, r.text) for r in seen["suffix_dedup"]])}
    for r in seen["packing"]:
        assert abs(len(r.text.encode()) - left[r.doc_id]) <= 6 and r.n_chars == len(r.text)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in final) == expected([(r.doc_id, r.text) for r in seen["packing"]])
    check_layout(final)
    assert set(steps) == set(seen)


def test_run_equals_its_stages_and_cleans_up(spark, tmp_path):
    """Two runs at once, one over documents that run through a lazy input, keep off each other; what is left are the
    folders that the result itself still reads."""
    from pathlib import Path

    from ridgeline.llm.shared import recorded

    with recorded() as outer:
        one = corpus_pipeline.run(spark, SF)
        two = corpus_pipeline.run(spark, SF)
        rows = [tuple(r) for r in one.orderBy("doc_id", "piece").collect()]
        assert rows == [tuple(r) for r in two.orderBy("doc_id", "piece").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    stages = dict(corpus_pipeline.STAGES)["packing"](spark, docs, SF)
    assert [r[:5] for r in rows] == [tuple(r)[:5] for r in stages.orderBy("doc_id", "piece").collect()]
    left = [p for p in outer if Path(p.removeprefix("file:")).exists()]
    assert len(left) < len(outer) / 2


def test_a_stage_keeps_lazy_outputs_of_others_whole(spark):
    """The output of a stage can still be read after the next stages have run on it, unwritten."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    steps = dict(corpus_pipeline.STAGES)
    first = steps["exact_dedup"](spark, docs, SF)
    second = steps["near_dedup"](spark, first, SF)
    n = second.count()
    assert steps["suffix_dedup"](spark, second, SF).count() == n == second.count() < first.count()


def test_row_keys_tell_rows_of_files_apart(spark, tmp_path):
    from ridgeline.llm.shared import with_row_key

    rows = spark.range(1000).selectExpr("id % 7 as _row", "'x' as _FILE").repartition(5)
    rows.write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    for docs in (read, read.where("_row < 3").select("_row"), rows, read.unionByName(read)):
        keyed, key = with_row_key(docs)
        assert key not in docs.columns and keyed.columns == [*docs.columns, key]
        found = [(r[key], r["_row"]) for r in keyed.collect()]
        assert len({k for k, _ in found}) == len(found) == docs.count()
        assert sorted(found) == sorted((r[key], r["_row"]) for r in keyed.repartition(3).collect())


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_null_texts_and_columns_pass(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "src1", 0), (3, "Plain words that say little but say it well.", None, "src1", 44)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF)
    assert docs.where(F.col("doc_id") == 3).count() == 1


def test_rows_that_repeat_an_id_or_have_none(spark):
    a, b, c, d = (" ".join(f"{name}{(7 * k + len(name)) % 101}" for k in range(80)) for name in ("oak", "birch", "maple", "willow"))
    near = c + " and one more"
    rows = [(7, a), (7, b), (3, b), (None, c), (None, c), (None, near), (5, d), (5, d), (5, d + " again"), (9, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "src1", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    steps = dict(corpus_pipeline.STAGES)

    def seen(frame):
        return sorted(((r.doc_id or 0, r.text or "") for r in frame.collect()))

    docs = steps["exact_dedup"](spark, docs, SF)
    assert seen(docs) == sorted([(7, a), (3, b), (0, c), (0, near), (5, d), (5, d + " again"), (0, "")])
    docs = steps["near_dedup"](spark, docs, SF)
    got = seen(docs)
    assert len(got) == 5 and {(7, a), (3, b), (0, "")} < set(got)
    assert sorted((i, t[:3]) for i, t in got) == [(0, ""), (0, "map"), (3, "bir"), (5, "wil"), (7, "oak")]
    assert seen(steps["suffix_dedup"](spark, docs, SF)) == got
