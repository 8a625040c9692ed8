"""Token counts that follow edits without counting a document anew.

A document is a segment tree: its leaves are runs of 64 pre-tokens (white-space words with the white space around
them), its inner nodes hold the sums of their children's token and character counts. Trees are kept: one row per
document in a base table, and one table of changes per round of edits, which holds the leaves that the round touched.

An edit finds its leaves by descending the character sums, widens the touched span to white space on both sides (the
boundary context: a pre-token is the same wherever it stands), encodes only that region, and adds the difference along
the paths to the root. All texts of a slice take their n-th edits together, so the tokenizer sees large batches. A leaf
that outgrows four times its size is cut again, and a tree that is mostly empty leaves is set up anew from its leaves;
only the leaves cut are encoded for it.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import kernels as K
from ridgeline.llm.shared import delete, fresh_path, let_workers_import, materialize
from ridgeline.llm.word_tokens import WordTokens, tokens_from

LEAF_WORDS = 64
#: Changes of up to this many bytes of text are broadcast to the trees; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20
TREE = "row long, doc_id long, texts array<string>, tokens array<long>, chars array<long>"
CHANGE = "row long, whole boolean, leaves array<struct<leaf:int,text:string,tokens:bigint,chars:bigint>>"
EDITS = "array<struct<place:bigint,cut:bigint,put:string>>"
_SPACE = frozenset(" \t\n\v\f\r")


class Touched(NamedTuple):
    first: int  # leaves first..last become leaf first
    last: int
    before: str  # their text
    left: int  # the region in it, white space or the text's ends on both sides
    right: int
    after: str  # what the region becomes


class Segments:
    """The segment tree of one document. ``tokens`` and ``chars`` are heap-ordered sums; leaves keep their text."""

    def __init__(self, texts: list[str], tokens, chars):
        self.texts = texts
        self.leaves = 1 << max(0, (len(texts) - 1).bit_length())
        self.tokens, self.chars = self._sums(tokens), self._sums(chars)
        self.changed: set[int] = set()  # leaves touched since the tree was read
        self.renewed = False  # set up anew, so that all its leaves are others

    @classmethod
    def stored(cls, texts: list[str], tokens: list[int], chars: list[int]) -> Segments:
        """A tree as the base table holds it: leaf texts and both heaps of sums."""
        tree = cls.__new__(cls)
        tree.texts, tree.tokens, tree.chars = texts, tokens, chars
        tree.leaves, tree.changed, tree.renewed = len(tokens) // 2, set(), False
        return tree

    def put(self, leaf: int, text: str, tokens: int, chars: int) -> None:
        """Set a leaf, and the sums above it."""
        at = leaf + self.leaves
        self.add(leaf, tokens - self.tokens[at], chars - self.chars[at])
        self.texts[leaf] = text
        self.changed.add(leaf)

    def _sums(self, leaf) -> list[int]:
        level = np.zeros(self.leaves, np.int64)
        level[: len(leaf)] = leaf
        levels = [level]
        while len(level) > 1:
            level = level.reshape(-1, 2).sum(axis=1)
            levels.append(level)
        return [0, *np.concatenate(levels[::-1]).tolist()]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.texts)

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (the last leaf with text, past the end), and its place there."""
        i = 1
        place = min(place, self.chars[1])
        while i < self.leaves:
            i *= 2
            if place >= self.chars[i] and self.chars[i + 1]:
                place -= self.chars[i]
                i += 1
        return i - self.leaves, place

    def add(self, leaf: int, tokens: int, chars: int) -> None:
        i = leaf + self.leaves
        while i:
            self.tokens[i] += tokens
            self.chars[i] += chars
            i //= 2

    def touch(self, place: int, cut: int, put: str) -> Touched:
        """What replacing ``cut`` characters from ``place`` by ``put`` touches; places past the end mean the end."""
        place = min(max(0, place), self.chars[1])
        cut = min(max(0, cut), self.chars[1] - place)
        first, left = self.find(place)
        last, _ = self.find(place + cut)
        first, last = min(first, len(self.texts) - 1), min(last, len(self.texts) - 1)
        parts = self.texts[first : last + 1]
        while first and not _SPACE & set(parts[0][: left if len(parts) == 1 or left < len(parts[0]) else None]):
            first -= 1
            parts.insert(0, self.texts[first])
            left += len(parts[0])
        before = "".join(parts)
        right = left + cut
        while last + 1 < len(self.texts) and not _SPACE & set(before[right:]):
            last += 1
            before += self.texts[last]
        a, b = left, right
        while a and before[a - 1] not in _SPACE:
            a -= 1
        while b < len(before) and before[b] not in _SPACE:
            b += 1
        return Touched(first, last, before, a, b, before[a:left] + put + before[right:b])

    def apply(self, t: Touched, difference: int) -> None:
        text = t.before[: t.left] + t.after + t.before[t.right :]
        tokens = sum(self.tokens[self.leaves + k] for k in range(t.first, t.last + 1)) + difference
        for k in range(t.first, t.last + 1):
            if k == t.first:
                self.put(k, text, tokens, len(text))
            else:
                self.put(k, "", 0, 0)

    def crowded(self) -> list[int]:
        """Touched leaves of more than four times as many words as a new one may have."""
        return [k for k in sorted(self.changed) if len(self.texts[k]) > 8 * LEAF_WORDS and len(self.texts[k].split()) > 4 * LEAF_WORDS]

    def renew(self, cut: dict[int, tuple[list[str], list[int]]]) -> None:
        """Set up from the leaves that hold text, some of them replaced by their parts and those parts' tokens."""
        texts, tokens = [], []
        for k, text in enumerate(self.texts):
            parts, n = cut.get(k, ([text] if text else [], [self.tokens[self.leaves + k]] if text else []))
            texts += parts
            tokens += n
        texts, tokens = texts or [""], tokens or [0]
        self.__init__(texts, tokens, [len(t) for t in texts])
        self.renewed = True


def build(tok: WordTokens, data: np.ndarray, offsets: np.ndarray) -> list[Segments]:
    """The trees of texts laid end to end."""
    starts, _, counts, first = tok.word_counts(data, offsets)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    sums = np.concatenate(([0], np.cumsum(counts)))
    raw = data.tobytes()
    out = []
    for k in range(len(offsets) - 1):
        words = np.arange(first[k], max(first[k] + 1, first[k + 1]), LEAF_WORDS)
        cut = np.concatenate(([offsets[k]], starts[words[1:]], [offsets[k + 1]]))
        ends = np.append(words[1:], first[k + 1])
        texts = [raw[a:b].decode() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        out.append(Segments(texts, sums[ends] - sums[words] if first[k + 1] > first[k] else np.zeros(1, np.int64), np.diff(lead[cut])))
    return out


def _tokens_in(tok: WordTokens, texts: list[str]) -> np.ndarray:
    data, offsets = K.text_bytes(pa.array(texts, pa.string()))
    _, at = tok.flat_ids(data, offsets)
    return np.diff(at)


def follow(tok: WordTokens, trees: list[Segments], edits: list[list[tuple[int, int, str]]]) -> np.ndarray:
    """Apply each text's edits in order; returns the characters encoded for it, old and new."""
    encoded = np.zeros(len(trees), np.int64)
    for turn in range(max(map(len, edits), default=0)):
        who = [k for k, e in enumerate(edits) if len(e) > turn]
        touched = [trees[k].touch(*edits[k][turn]) for k in who]
        both = _tokens_in(tok, [t.before[t.left : t.right] for t in touched] + [t.after for t in touched])
        old, new = both[: len(who)], both[len(who) :]
        for k, t, difference in zip(who, touched, (new - old).tolist(), strict=True):
            trees[k].apply(t, difference)
            encoded[k] += t.right - t.left + len(t.after)
    for k, tree in enumerate(trees):
        crowded = tree.crowded()
        if not crowded and (len(tree.texts) < 8 or 2 * sum(map(bool, tree.texts)) >= len(tree.texts)):
            continue
        cut = {}
        if crowded:
            data, offsets = K.text_bytes(pa.array([tree.texts[c] for c in crowded], pa.string()))
            cut = {c: (part.texts, part.tokens[part.leaves : part.leaves + len(part.texts)]) for c, part in zip(crowded, build(tok, data, offsets), strict=True)}
            encoded[k] += sum(len(tree.texts[c]) for c in crowded)
        tree.renew(cut)
    return encoded


def _lists(values: list[list], kind) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array([x for v in values for x in v], kind))


def _current(batch) -> list[Segments]:
    """The trees of a batch of base rows, with the rounds of changes they have seen since."""
    out = []
    for texts, tokens, chars, rounds in zip(*(batch.column(c).to_pylist() for c in ("texts", "tokens", "chars", "changes")), strict=True):
        tree = Segments.stored(texts, tokens, chars)
        for r in rounds or []:
            if r["whole"]:
                tree = Segments(*([x[c] for x in r["leaves"]] for c in ("text", "tokens", "chars")))
            else:
                for x in r["leaves"]:
                    tree.put(x["leaf"], x["text"], x["tokens"], x["chars"])
        tree.changed.clear()
        out.append(tree)
    return out


class TokenTrees:
    """Kept segment trees under ``path``: ``base`` (one row per document) and ``round-1``, ``round-2``, ... (one row per
    document and round that edited it, with the leaves that became others).

    ``rounds`` says how many rounds are complete. A round that was cut short is run again under the same number and
    replaces what it left behind, so a lost driver costs a round at most.
    """

    def __init__(self, spark: SparkSession, tokenizer_path: str, path: str, rounds: int = 0):
        self.spark, self.tokenizer_path, self.path, self.rounds = spark, tokenizer_path, path, rounds
        let_workers_import(spark)

    @classmethod
    def build(cls, docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenTrees:
        """Encode every text of ``docs`` once and keep its tree. Null text counts as empty; rows that repeat an id, or
        have none, get trees of their own; other columns are not read."""
        trees = cls(docs.sparkSession, tokenizer_path, path or fresh_path(docs.sparkSession, "trees"))

        def emit(batches):
            tok = tokens_from(tokenizer_path)
            for batch in batches:
                data, offsets = K.text_bytes(batch.column("text"))
                for i, j, part, off in K.slices(data, offsets):
                    made = build(tok, part, off)
                    lists = [_lists([t.texts for t in made], pa.string()), _lists([t.tokens for t in made], pa.int64()), _lists([t.chars for t in made], pa.int64())]
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), batch.column("doc_id").slice(i, j - i), *lists], ["row", "doc_id", "texts", "tokens", "chars"])

        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        rows.mapInArrow(emit, TREE).write.mode("overwrite").option("compression", "zstd").parquet(f"{trees.path}/base")
        return trees

    def _changes(self) -> DataFrame | None:
        """``row, changes``: all complete rounds' changes of a tree, in order."""
        every = None
        for k in range(1, self.rounds + 1):
            one = self.spark.read.schema(CHANGE).parquet(f"{self.path}/round-{k}").withColumn("round", F.lit(k))
            every = one if every is None else every.unionByName(one)
        if every is None:
            return None
        return every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("round", "whole", "leaves"))).alias("changes"))

    def _base(self) -> DataFrame:
        return self.spark.read.schema(TREE).parquet(f"{self.path}/base")

    def counts(self) -> DataFrame:
        """``row, doc_id, n_tokens`` of every tree as it is now, from sums alone: no text is read."""
        base = self._base().select("row", "doc_id", F.col("tokens")[1].alias("n"), F.size("tokens").alias("_s"), "tokens")
        changes = self._changes()
        if changes is None:
            return base.select("row", "doc_id", F.col("n").alias("n_tokens"))
        # the last word on each leaf: a change after the last renewal, else what the base has
        last = F.aggregate("changes", F.lit(0), lambda a, c: F.when(c["whole"], c["round"]).otherwise(a))
        numbers = changes.select("row", F.transform("changes", lambda c: F.struct(c["round"].alias("round"), c["whole"].alias("whole"), F.transform(c["leaves"], lambda x: F.struct(x["leaf"].alias("leaf"), x["tokens"].alias("tokens"))).alias("leaves"))).alias("changes"))
        each = numbers.select("row", last.alias("last"), F.explode("changes").alias("c")).where("c.round >= last").select("row", "last", F.col("c.round").alias("round"), F.explode("c.leaves").alias("x"))
        newest = each.groupBy("row", "last", F.col("x.leaf").alias("leaf")).agg(F.max_by("x.tokens", "round").alias("tokens"))
        sums = newest.groupBy("row", "last").agg(F.sum("tokens").alias("new"), F.collect_list("leaf").alias("leaves"))
        old = F.aggregate("leaves", F.lit(0).cast("long"), lambda a, x: a + F.col("tokens")[x + (F.col("_s") / 2).cast("int")])
        met = base.join(sums, "row", "left")
        return met.select("row", "doc_id", F.when(F.col("new").isNull(), F.col("n")).when(F.col("last") > 0, F.col("new")).otherwise(F.col("n") - old + F.col("new")).alias("n_tokens"))

    def edit(self, edits: Column | DataFrame) -> DataFrame:
        """Apply a round of edits; returns ``row, doc_id, n_before, n_after, n_edits, n_encoded, text_crc32`` of the
        documents edited.

        ``edits`` is a table ``doc_id, seq, place, cut, put`` or a column of arrays of ``place, cut, put`` over the
        columns of the base table: replace ``cut`` characters from character ``place`` of the text as the edits before
        left it by ``put``, in the order of ``seq``. Places and lengths past the end mean the end; a null ``put`` puts
        nothing, an edit without a known document does nothing, and rows that repeat an id are all edited.
        ``n_encoded``: characters that following the edits encoded, against the whole text that counting anew would.
        ``text_crc32`` is of the edited text in UTF-8.
        """
        changes, tokenizer_path = self._changes(), self.tokenizer_path
        trees = self._base()
        if isinstance(edits, DataFrame):
            rows = F.array_sort(F.collect_list(F.struct("seq", "place", "cut", "put")))
            each = edits.groupBy("doc_id").agg(F.transform(rows, lambda e: F.struct(e["place"].cast("long").alias("place"), e["cut"].cast("long").alias("cut"), e["put"].alias("put"))).cast(EDITS).alias("edits"))
            each = materialize(each.where("doc_id is not null"), "edits")
            size = each.agg(F.sum(F.aggregate("edits", F.lit(64), lambda a, e: a + 32 + F.coalesce(F.length(e["put"]), F.lit(0))))).first()[0] or 0
            trees = trees.join(F.broadcast(each) if size <= BROADCAST_BYTES else each, "doc_id")
        else:
            trees = trees.withColumn("edits", edits.cast(EDITS))
        if changes is None:
            trees = trees.withColumn("changes", F.lit(None).cast("array<struct<round:int,whole:boolean,leaves:array<struct<leaf:int,text:string,tokens:bigint,chars:bigint>>>>"))
        else:
            changes = materialize(changes, "changes")
            size = changes.agg(F.sum(F.aggregate("changes", F.lit(64), lambda a, c: a + F.aggregate(c["leaves"], F.lit(0), lambda b, x: b + 48 + F.length(x["text"]))))).first()[0] or 0
            trees = trees.join(F.broadcast(changes) if size <= BROADCAST_BYTES else changes, "row", "left")

        def emit(batches):
            tok = tokens_from(tokenizer_path)
            for batch in batches:
                for s in range(0, batch.num_rows, 256):
                    part = batch.slice(s, 256)
                    asked = part.column("edits").to_pylist()
                    made = _current(part)
                    before = [t.total for t in made]
                    todo = [[(e["place"] or 0, e["cut"] or 0, e["put"] or "") for e in row or [] if e] for row in asked]
                    encoded = follow(tok, made, todo)
                    crc = [zlib.crc32(t.text().encode()) for t in made]
                    out = [[{"leaf": k, "text": t.texts[k], "tokens": t.tokens[t.leaves + k], "chars": t.chars[t.leaves + k]} for k in (range(len(t.texts)) if t.renewed else sorted(t.changed))] for t in made]
                    leaf = pa.struct([("leaf", pa.int32()), ("text", pa.string()), ("tokens", pa.int64()), ("chars", pa.int64())])
                    cols = [np.array(before, np.int64), np.array([t.total for t in made], np.int64), np.array([len(e) for e in todo], np.int64), encoded, np.array(crc, np.int64)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row"), part.column("doc_id"), *map(pa.array, cols), pa.array([t.renewed for t in made]), _lists(out, leaf)],
                        ["row", "doc_id", "n_before", "n_after", "n_edits", "n_encoded", "text_crc32", "whole", "leaves"],
                    )

        kinds = "row long, doc_id long, n_before long, n_after long, n_edits long, n_encoded long, text_crc32 long, whole boolean, leaves array<struct<leaf:int,text:string,tokens:bigint,chars:bigint>>"
        done = trees.select("row", "doc_id", "texts", "tokens", "chars", "edits", "changes").mapInArrow(emit, kinds)
        path = f"{self.path}/round-{self.rounds + 1}"
        done.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.rounds += 1
        return self.spark.read.schema(kinds).parquet(path).drop("whole", "leaves")

    def compact(self, path: str | None = None) -> TokenTrees:
        """The trees as they are now as the base of new ones; these stay as they are until their owner drops them."""
        new = TokenTrees(self.spark, self.tokenizer_path, path or fresh_path(self.spark, "trees"))
        trees, changes = self._base(), self._changes()
        if changes is None:
            trees.write.mode("overwrite").option("compression", "zstd").parquet(f"{new.path}/base")
            return new

        def emit(batches):
            for batch in batches:
                made = _current(batch)
                lists = [_lists([t.texts for t in made], pa.string()), _lists([t.tokens for t in made], pa.int64()), _lists([t.chars for t in made], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *lists], ["row", "doc_id", "texts", "tokens", "chars"])

        trees.join(changes, "row", "left").mapInArrow(emit, TREE).write.mode("overwrite").option("compression", "zstd").parquet(f"{new.path}/base")
        return new

    def drop(self) -> None:
        delete(self.spark, self.path)


def sample_edits(doc_id: Column, chars: Column) -> Column:
    """Three edits a text of ``chars`` characters, drawn by hash of the id: a phrase put in, a span cut out, a span replaced."""
    size = F.coalesce(chars, F.lit(0)).cast("long") + 1

    def one(k: int, cut: int, put: str) -> Column:
        return F.struct(F.pmod(F.xxhash64(doc_id, F.lit(k)), size).alias("place"), F.lit(cut).cast("long").alias("cut"), F.lit(put).alias("put"))

    return F.array(one(1, 0, " an inserted phrase, with marks! "), one(2, 40, ""), one(3, 12, "re-placed"))
