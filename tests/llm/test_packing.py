import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ridgeline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  ", "don't STOP it's 12a3 <|endoftext|>x <|ENDOFTEXT|> ée \u0001\u0002 a\u001cb İstanbul ß ﬁ ½ x² ' <b>'re", "A" * 300 + " " + "ab " * 9000, "世界 123,456.78!!  x"]


def expected(rows):
    tok = Tokenizer.from_file(PATH)
    out = []
    for i, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(i, p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    return sorted(out)


def check_layout(rows, capacity=4096):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for seats in by.values():
        at = 0
        for offset, length in sorted(seats):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_driver_documents_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + k, t) for k, t in enumerate(ODD)] + [(10_001, "")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, bucket int")
    got = packing.pack(frame, PATH).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected(rows)
    used = check_layout(got)
    assert used == -(-sum(r.length for r in got) // 4096)
    assert packing.pack(frame.limit(0), PATH).count() == 0


def test_sequences_hold_the_ids(spark):
    frame = spark.createDataFrame([(1, "a b c"), (2, "d " * 5000), (3, None)], "doc_id long, text string")
    got = packing.sequences(frame, PATH).collect()
    tok = Tokenizer.from_file(PATH)
    want = [*tok.encode("a b c", add_special_tokens=False).ids, 1, *tok.encode("d " * 5000, add_special_tokens=False).ids, 1, 1]
    assert sorted(i for r in got for i in r.ids) == sorted(want) and all(len(r.ids) <= 4096 for r in got)


def best(items, capacity):
    """Fewest bins by full search, for a few items."""
    items = sorted(items, reverse=True)
    low = [len(items)]

    def walk(k, bins):
        if len(bins) >= low[0]:
            return
        if k == len(items):
            low[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[k] <= capacity and bins[b] not in bins[:b]:
                bins[b] += items[k]
                walk(k + 1, bins)
                bins[b] -= items[k]
        walk(k + 1, [*bins, items[k]])

    walk(0, [])
    return low[0]


def packed(items, capacity):
    counts = np.bincount(np.array(items, int), minlength=capacity + 1)
    patterns = packing.bin_completion(counts)
    placed = np.zeros(capacity + 1, int)
    for take, m in patterns:
        assert sum(take) <= capacity
        for x in take:
            placed[x] += m
    assert (placed == counts).all()
    return sum(m for _, m in patterns)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([20, 40, 60]).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=0, max_size=11))))
def test_bin_completion_against_full_search(case):
    capacity, items = case
    assert packing.lower_bound(np.bincount(np.array(items, int), minlength=capacity + 1)) <= best(items, capacity) == packed(items, capacity)


def test_branches_found_again(monkeypatch):
    monkeypatch.setattr(packing, "OPEN_NODES", 1)
    rng = np.random.default_rng(6)
    for _ in range(60):
        capacity = int(rng.choice([20, 40, 60]))
        items = rng.integers(1, capacity // 2 + 5, 11).tolist()
        assert packed(items, capacity) == best(items, capacity)


def test_bin_completion_where_best_fit_fails():
    assert packed([13, 27, 14, 16, 19, 20, 27, 27, 23, 19, 15, 15], 60) == 4
    assert packed([20, 19, 7, 7, 7, 5, 5, 5, 5], 40) == 2
    assert packed([20, 19, 7, 7, 7, 5, 5, 5, 5] * 50, 40) == 100  # by multiplicities


def test_fillings_are_those_that_no_swap_improves():
    left = np.bincount([9, 7, 5, 5, 3, 2, 1], minlength=13)
    got = {tuple(sorted(f)) for f in packing.fillings(left, 12, 12) if f is not None}
    pieces = [9, 7, 5, 5, 3, 2, 1]
    every = {tuple(sorted(c)) for n in range(8) for c in combinations(pieces, n) if sum(c) <= 12}

    def improved(f):
        out = list((Counter(pieces) - Counter(f)).elements())
        return any(0 <= x - sum(part) <= 12 - sum(f) and part != (x,) for n in range(len(f) + 1) for part in combinations(f, n) for x in out)

    assert got == {f for f in every if not improved(f)}


@pytest.mark.parametrize("seed", range(3))
def test_bin_completion_on_many_lengths(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(np.minimum(4096, np.exp(rng.normal(6.3, 1, 20_000)).astype(int) + 1), minlength=4097)
    used = sum(m for _, m in packing.bin_completion(counts, 8000))
    assert used <= packing.lower_bound(counts) * 1.0005 + 1
