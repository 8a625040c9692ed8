import random
import zlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridgeline.llm import kernels as K
from ridgeline.llm import token_counts as T
from ridgeline.llm.word_tokens import tokens_from

PATH = public_tokenizers.path("word_bpe_49k.json")


def edited(text, edits):
    for place, cut, put in edits:
        place = min(max(0, place), len(text))
        text = text[:place] + put + text[place + cut :]
    return text


def cases():
    rng = random.Random(9)
    words = ["the", "don't", "École", "12.5", "<|endoftext|>", "世界", "x", "internationalization", "!!", "été\n"]
    out = [("", [(0, 0, "new text"), (3, 1, "")]), ("one", [(1, 1, " ")]), ("  ", [(1, 9, "a"), (99, 3, "b")]), ("a " * 500, [(100, 300, ""), (0, 10_000, "z")])]
    for n in (3, 64, 65, 200, 2000):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", ""]) for _ in range(n))
        for _ in range(6):
            out.append((text, [(rng.randrange(len(text) + 5), rng.choice([0, 1, 3, 50, 900]), rng.choice(["", " ", "ab", "two words", "'s"])) for _ in range(8)]))
    return out


def test_edits_against_counting_anew():
    tok, whole = tokens_from(PATH), Tokenizer.from_file(PATH)
    texts, edits = zip(*cases(), strict=True)
    data, off = K.text_bytes(pa.array(texts))
    trees = T.build(tok, data, off)
    for tree, text in zip(trees, texts, strict=True):
        assert tree.text() == text and tree.total == len(whole.encode(text, add_special_tokens=False).ids)
    encoded = T.follow(tok, trees, [list(e) for e in edits])
    for tree, text, e in zip(trees, texts, edits, strict=True):
        want = edited(text, e)
        assert tree.text() == want and tree.total == len(whole.encode(want, add_special_tokens=False).ids)
        assert tree.chars[1] == len(want) and [tree.tokens[i] for i in range(1, tree.leaves)] == [tree.tokens[2 * i] + tree.tokens[2 * i + 1] for i in range(1, tree.leaves)]
    assert encoded[-1] < len(texts[-1])


def state(trees):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in trees.counts().collect())


def test_trees_over_rounds_of_edits(spark, monkeypatch):
    whole = Tokenizer.from_file(PATH)
    rows = [(k, t, e) for k, (t, e) in enumerate(cases())] + [(None, None, [(0, 0, "x")]), (3, "twice", None), (3, "twice", None)]
    frame = spark.createDataFrame([(i, t, 5) for i, t, _ in rows], "doc_id long, text string, tokens int").repartition(3)

    def n(t):
        return len(whole.encode(t, add_special_tokens=False).ids)

    trees = T.TokenTrees.build(frame, PATH)
    now = [(i, t or "") for i, t, _ in rows]
    assert state(trees) == sorted((-1 if i is None else i, n(t)) for i, t in now)
    rng = random.Random(4)
    for turn in range(3):
        # every text but the last few, and edits of no document; the second round goes by shuffle, the third comes in a column
        monkeypatch.setattr(T, "BROADCAST_BYTES", 0 if turn == 1 else 1 << 20)
        asked = {i: (e if turn == 0 else [(rng.randrange(len(t) + 3), rng.choice([0, 2, 40]), rng.choice([None, "z", " new words"])) for _ in range(3)]) for i, t, e in rows if i is not None and t and i % 5 != turn}
        asked.pop(3, None) if turn == 0 else asked.update({3: [(0, 2, "T")]})
        asked = {i: e for i, e in asked.items() if e}
        if turn < 2:
            table = [(i, k, *x) for i, e in asked.items() for k, x in enumerate(e)]
            rng.shuffle(table)
            edits = spark.createDataFrame([*table, (None, 0, 0, 0, "lost"), (999, 0, 0, 0, "lost")], "doc_id long, seq int, place long, cut long, put string")
        else:
            asked = {i: [(1, 1, "q ")] for i, _ in now}
            edits = F.array(F.struct(F.lit(1).alias("place"), F.lit(1).alias("cut"), F.lit("q ").alias("put")), F.lit(None))
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_before, r.n_after, r.n_edits, r.text_crc32) for r in trees.edit(edits).collect())
        want, after = [], []
        for i, t in now:
            e = asked.get(i)
            u = edited(t, [(p, c, s or "") for p, c, s in e]) if e else t
            after.append((i, u))
            if e:
                want.append((-1 if i is None else i, n(t), n(u), len(e), zlib.crc32(u.encode())))
        assert got == sorted(want)
        now = after
        assert state(trees) == sorted((-1 if i is None else i, n(t)) for i, t in now)
        trees = T.TokenTrees(spark, PATH, trees.path, trees.rounds)  # opened again
    assert state(trees.compact()) == state(trees)
    trees.drop()
    empty = T.TokenTrees.build(frame.limit(0), PATH)
    assert empty.edit(F.array()).count() == 0 and empty.counts().count() == 0


def test_only_touched_leaves_are_encoded_and_written(spark):
    text = "some words that fill the leaves " * 4000
    trees = T.TokenTrees.build(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), PATH)
    edits = spark.createDataFrame([(1, 1, 50_000, 3, "in the midst"), (1, 2, 9, 0, "x")], "doc_id long, seq int, place long, cut long, put string")
    (row,) = trees.edit(edits).collect()
    assert row.doc_id == 1 and row.n_encoded < 200
    (change,) = spark.read.parquet(f"{trees.path}/round-1").collect()
    assert len(change.leaves) == 2 and not change.whole


def test_a_leaf_that_grows_is_cut_and_empty_ones_go():
    tok, whole = tokens_from(PATH), Tokenizer.from_file(PATH)
    data, off = K.text_bytes(pa.array(["a few words " * 600]))
    (tree,) = T.build(tok, data, off)
    leaves = len(tree.texts)
    T.follow(tok, [tree], [[(30, 0, "more and more words " * 200)]])
    assert tree.renewed and len(tree.texts) > leaves and max(len(t.split()) for t in tree.texts) <= 4 * T.LEAF_WORDS
    assert tree.total == len(whole.encode(tree.text(), add_special_tokens=False).ids)
    T.follow(tok, [tree], [[(10, 10_000, "")]])
    assert len(tree.texts) < leaves and tree.total == len(whole.encode(tree.text(), add_special_tokens=False).ids)
