"""Texts longer than any slice, segment or sequence that the operators cut their work into."""

import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridgeline.llm import language_id, packing, piece_bpe, ppm, quality, token_counts
from ridgeline.llm.exact_dedup import exact_dedup
from ridgeline.llm.minhash import near_dedup

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def long():
    rng = random.Random(11)
    vocab = ["the", "of", "and", "wörter", "größe", "don't", "12.5", "世界", *(f"w{k}" for k in range(4000))]
    return " ".join(rng.choice(vocab) for _ in range(800_000))  # 4.6 MB


@pytest.fixture(scope="module")
def frame(spark, long):
    rows = [(1, long, "en", "s"), (2, long + " and one more", "en", "s"), (3, "kurz und gut", "de", "s"), (4, long, "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2).cache()


def test_copies_of_long_texts(frame):
    assert {r.doc_id: r.keep_id for r in exact_dedup(frame).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    assert {r.doc_id: r.component_id for r in near_dedup(frame).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_tokens_of_long_texts(spark, frame, long):
    n = len(Tokenizer.from_file(WORDS).encode(long, add_special_tokens=False).ids)
    pieces = packing.pack(frame.where("doc_id = 1"), WORDS).collect()
    assert sum(r.length for r in pieces) == n + 1 and len(pieces) == -(-(n + 1) // 4096)
    trees = token_counts.TokenTrees.build(frame.where("doc_id = 1"), WORDS)
    (row,) = trees.edit(F.array(F.struct(F.lit(2_000_000).alias("place"), F.lit(0).alias("cut"), F.lit(" x ").alias("put")))).collect()
    assert row.n_before == n and 0 < row.n_after - n < 5 and row.n_encoded < 200 and row.text_crc32 == zlib.crc32((long[:2_000_000] + " x " + long[2_000_000:]).encode())
    coded = piece_bpe.encode(frame.where("doc_id = 1"), public_tokenizers.path("piece_bpe_32k.model"), 0.1, 3, digest=True).first()
    assert coded.lossless and coded.n_bytes == len(long.encode())


def test_models_read_long_texts(spark, frame, long):
    got = {r.doc_id: r for r in ppm.score_corpus(frame, F.col("doc_id") == 2).collect()}
    assert got[1].score == pytest.approx(got[4].score) and got[1].n_tokens == 800_001 and got[2].n_tokens == 800_004
    assert {r.doc_id: r.lang_pred for r in language_id.identify(frame, F.lit(False)).collect()} == {1: "en", 2: "en", 3: "de", 4: "en"}
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert {r.doc_id for r in quality.classify(frame, labels).collect()} == {1, 2, 3, 4}
