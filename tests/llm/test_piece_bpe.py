import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from ridgeline.llm import kernels as K
from ridgeline.llm import piece_bpe as B

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b \n", "▁ x▁y", "ﬁ ² \t世界 梦 😀x", "a" * 3000, " ".join("ab" * 40 for _ in range(9)), "The quick, brown fox's 12.5%!!", "    indented\n\n\tcode()"]


@pytest.fixture(scope="module")
def pieces():
    return B.pieces_from(PATH)


@pytest.fixture(scope="module")
def texts():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:120] + ODD


def encoded(pieces, texts, dropout, seed, keys=None):
    data, off = K.text_bytes(pa.array(texts))
    ids, first = B.encode_slice(pieces, data, off, np.arange(len(texts)) if keys is None else keys, dropout, seed)
    back, place = B.decode_slice(pieces, ids, first)
    assert (place == off).all() and (back == data).all()
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


def test_without_dropout_as_the_library(pieces, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text, ids in zip(texts, encoded(pieces, texts, 0.0, 0), strict=True):
        if B.BLANK not in text:
            assert ids == model.encode(text)


def test_dropout_varies_and_stays_lossless(pieces, texts):
    plain, a, b = (encoded(pieces, texts, d, s) for d, s in ((0.0, 1), (0.2, 1), (0.2, 2)))
    assert encoded(pieces, texts, 0.2, 1) == a
    n = [sum(map(len, x)) for x in (plain, a, b)]
    assert a != b and n[0] < n[1] < 2 * n[0] and n[0] < n[2]
    every = encoded(pieces, ["hello world"], 1.0, 3)[0]
    assert len(every) == 12
    one = encoded(pieces, [" ".join(["international"] * 200)], 0.2, 5)[0]
    assert len(set(np.diff(np.flatnonzero(np.isin(one, [i for t, i in pieces.of.items() if t.startswith(B.BLANK)]))))) > 1


def test_rounds_and_heap_agree(pieces):
    rng = random.Random(6)
    words = [" " + "".join(rng.choice("thereiongads") for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    symbols = [pieces.symbol(np.array([ord(c) for c in w])) for w in words]
    keys = np.arange(1, 401, dtype=np.uint64) * np.uint64(7919)
    for rate in (0.0, 0.3):
        most = int(rate * 2**53)
        flat, n = B.encode_words(pieces, np.concatenate(symbols), np.array([len(s) for s in symbols]), keys, most)
        assert flat.tolist() == [i for s, k in zip(symbols, keys, strict=True) for i in B.encode_alone(pieces, s, int(k), most)]


def test_operator_round_trip(spark):
    rows = [(i, t, 1) for i, t in enumerate([None, *ODD])] + [(None, "x y", 1), (3, "x y", 2), (3, "x y", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    back = B.decode(B.encode(frame, PATH, 0.3, 9), PATH).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((i or -1, t or "") for i, t, _ in rows)
    assert all(r.lossless for r in B.encode(frame, PATH, 0.3, 9, digest=True).collect())
    assert B.encode(frame.limit(0), PATH, 0.1, 1).count() == 0


def test_every_occurrence_has_its_own_segmentation(pieces):
    """Short words may share keys, but not fewer than they have segmentations."""

    def kinds(word, variants):
        data, off = K.text_bytes(pa.array([" ".join([word] * 900)]))
        ids, _ = B.encode_slice(pieces, data, off, np.array([5]), 0.3, 1, variants)
        text = {k: t for t, k in pieces.of.items()}
        return len(set("|".join(text[i] for i in ids.tolist()).split(B.BLANK)))

    assert kinds("internationalization", 64) > 64 and kinds("internationalization", None) > 64
    assert 8 <= kinds("there", 64) <= 65 and kinds("there", 64) <= kinds("there", None)
