import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import ppm
from ridgeline.llm.shared import held_out


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]


def flow_of(text):
    return bytes(ppm.ORDER) + " ".join(words_of(text)).replace("\0", "\1").encode() + b"\0"


def plain_ppm(train, text):
    """The model straight from its definition, over dictionaries."""
    seen = defaultdict(Counter)
    for t in train:
        f = flow_of(t)
        for i in range(ppm.ORDER, len(f)):
            for j in range(ppm.ORDER + 1):
                seen[f[i - j : i]][f[i]] += 1
    f, total = flow_of(text), 0.0
    for i in range(ppm.ORDER, len(f)):
        barred = set()
        for j in range(ppm.ORDER, -1, -1):
            after = {s: n for s, n in seen.get(f[i - j : i], {}).items() if s not in barred}
            if not after:
                continue
            mass = sum(after.values()) + len(after)
            if f[i] in after:
                total += math.log10(after[f[i]] / mass)
                break
            total += math.log10(len(after) / mass)
            barred |= set(after)
        else:
            total -= math.log10(max(1, 256 - len(barred)))
    return total


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    return [(r.doc_id, r.text[:900]) for r in docs] + [(1001, None), (1002, ""), (1003, "A\0b \t C"), (1004, "zzzzqqqq 世界"), (1004, "The the THE")]


def test_scores_against_definition(spark, rows):
    frame = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, score double, n int").repartition(3)
    got = ppm.score_corpus(frame, held_out(F.col("doc_id"), 5), hot=64).collect()
    assert len(got) == len(rows)
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(w for t in train for w in [*words_of(t), None])
    n, v = sum(count.values()), len(count)
    text = defaultdict(list)
    for i, t in rows:
        tokens = [*words_of(t), None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        text[i].append((len(tokens), sum(count[w] > 0 for w in tokens), base, plain_ppm(train, t)))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and r.train_tokens == n
        assert any((r.n_tokens, r.n_known) == w[:2] and r.base_score == pytest.approx(w[2]) and r.score == pytest.approx(w[3]) for w in text[r.doc_id])


def test_trie_costs_are_probabilities():
    rng = np.random.default_rng(4)
    flow = rng.choice(np.frombuffer(b"abcab ", np.uint8), 3000)
    code, _ = ppm.codes(np.concatenate((np.zeros(ppm.ORDER, np.uint8), flow)), np.array([0, len(flow) + ppm.ORDER]))
    levels = [np.unique(code & np.uint64((1 << 8 * (j + 1)) - 1), return_counts=True) for j in range(ppm.ORDER + 1)]
    for pruned in (1, 4):
        trie = ppm.Trie([(k[n >= pruned], n[n >= pruned]) for k, n in levels])
        for context in (0, int(code[500]) << 8, 0x7A7A7A7A00, 0x61627A7A00, 0x7A61626300):
            each = (np.uint64(context & 0xFFFFFFFF00) | np.arange(256, dtype=np.uint64)).astype(np.uint64)
            assert 10 ** trie.cost(each) @ np.ones(256) == pytest.approx(1.0)


def test_no_training_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    (row,) = ppm.score_corpus(frame, F.lit(True)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (2, 0, 0)
    assert row.score == pytest.approx(-3 * math.log10(256)) and row.base_score == pytest.approx(0.0)
    assert ppm.score_corpus(frame.limit(0), F.lit(False)).count() == 0


def test_adaptive_form_learns_while_it_reads():
    once, twice = ppm.adaptive_code_length("abracadabra alakazam"), ppm.adaptive_code_length("abracadabra alakazam " * 2)
    assert once < 0 and twice - once > once * 0.5


def test_scores_do_not_depend_on_what_is_broadcast(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(plain_ppm(train, t))
    for nodes in (0, 300):  # far fewer than there are contexts
        got = ppm.score_corpus(frame, held_out(F.col("doc_id"), 5), nodes=nodes).collect()
        assert len(got) == len(rows)
        assert all(any(r.score == pytest.approx(w) for w in text[r.doc_id]) for r in got)
