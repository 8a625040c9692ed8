"""Language-model scoring by prediction with partial matching (PPM).

The model reads a text as its words (ASCII-lower-cased) with one blank between them and an end sign, and predicts each
byte from up to four bytes before it. The context trie is pretrained: every (context, byte) pair of the training rows is
counted over all of them, order by order. A byte seen after the longest known context costs its share there; else an
escape (method C: distinct / (total + distinct)) leads to the next shorter context, where bytes that longer contexts
have seen are excluded. Since what follows a context also follows its suffix, the excluded mass of each suffix depends
on the longer context alone, so each trie node carries two numbers that make a score a plain sum.

No level is cut, whatever its size. The costs of the most frequent full-order pairs (at most ``nodes`` of them) are
broadcast; the pairs of a text that are not among these are met by shuffle, each distinct one with its own count or, if
training never saw it, with the nodes and pairs of its shorter contexts.

The unigram base needs the count of every word of every document. Words above a count threshold chosen so that at most
``hot`` of them pass are broadcast; all other words are joined by shuffle, exactly.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import kernels as K
from ridgeline.llm.shared import let_workers_import, materialize

ORDER, NODES, HOT = 4, 1 << 20, 1 << 18
_U = np.uint64
#: What stands for the end of a text among word hashes.
END = int(np.uint64(0xA5A5F00DD00F5A5A).view(np.int64))
#: Distinct entries that a task holds before it hands them on.
HELD = 1 << 20


def stream(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as the model reads them and each text's place: ORDER zeros, the words with a blank after each, the last
    blank a zero (the end sign; a text without words is that alone). A zero byte in a text counts as byte 1."""
    texts = len(first) - 1
    words = np.diff(first)
    low = K.LOWER[data]
    low = np.maximum(low, 1)
    length = ends - starts
    text_of = np.repeat(np.arange(texts), words)
    body = np.bincount(text_of, length + 1, texts).astype(np.int64) if len(starts) else np.zeros(texts, np.int64)
    body = np.maximum(body, 1)
    place = np.concatenate(([0], np.cumsum(body + ORDER)))
    out = np.zeros(place[-1], np.uint8)
    if len(starts):
        before = np.cumsum(length + 1) - (length + 1)
        lead = before[np.minimum(first[:-1], len(before) - 1)]
        to = place[text_of] + ORDER + before - lead[text_of]
        source = np.repeat(starts - np.cumsum(length) + length, length) + np.arange(length.sum())
        target = np.repeat(to - np.cumsum(length) + length, length) + np.arange(length.sum())
        out[target] = low[source]
        out[to + length] = 32
    out[place[1:] - 1] = 0
    return out, place


def codes(flow: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each predicted byte the code of itself and the ORDER bytes before it (itself lowest), and each text's first."""
    wide = flow.astype(np.uint64)
    code = wide.copy()
    for k in range(1, ORDER + 1):
        code[k:] |= wide[:-k] << _U(8 * k)
    pad = np.zeros(len(flow), bool)
    for k in range(ORDER):
        pad[place[:-1] + k] = True
    return code[~pad], place - ORDER * np.arange(len(place))


class _Counter:
    """Counts of 64-bit keys, held as sorted arrays; ``full`` tells when to hand them on."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > HELD and len(self.parts) > 1:
            self._merge()

    def _merge(self) -> None:
        keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        keys, back = np.unique(keys, return_inverse=True)
        self.parts = [(keys, np.bincount(back, n).astype(np.int64))]
        self.held = len(keys)

    @property
    def full(self) -> bool:
        return self.held > HELD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._merge()
        (out,) = self.parts
        self.parts, self.held = [], 0
        return out


def counts(train: DataFrame) -> DataFrame:
    """``kind, key, n``: kind 0 the words of all training texts (and END), kind 1 their byte codes of the full order."""

    def emit(batches):
        words, grams = _Counter(), _Counter()
        texts = 0

        def out(kind, counter):
            keys, n = counter.take()
            for s in range(0, len(keys), 1 << 17):
                part = keys[s : s + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(n[s : s + (1 << 17)])], ["kind", "key", "n"])

        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            for _, _, part, off in K.slices(data, offsets):
                starts, ends, first = K.spans(part, off)
                words.add(K.span_hashes(part, starts, ends))
                grams.add(codes(*stream(part, starts, ends, first))[0])
                texts += len(off) - 1
                for kind, counter in ((0, words), (1, grams)):
                    if counter.full:
                        yield from out(kind, counter)
        yield from out(0, words)
        yield from out(1, grams)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([END]), pa.array([texts])], ["kind", "key", "n"])

    rows = train.select(F.col("text").cast("string").alias("text")).mapInArrow(emit, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def least_count(table: DataFrame, most: int) -> int:
    """The smallest power of two such that at most ``most`` rows of ``table(n)`` have a count of at least that."""
    sizes = {r.b: r["count"] for r in table.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()}  # at most 63 rows
    total, t = sum(sizes.values()), 0
    while total > most:
        total -= sizes.get(t, 0)
        t += 1
    return 1 << t


class Hashed:
    """A fixed table from 64-bit keys to row numbers, looked up in bulk."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.mask = _U((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)
        left, self.rounds = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], self.rounds)
            free = self.rows[slot] < 0
            at, which = np.unique(slot[free], return_index=True)
            won = left[free][which]
            self.rows[at], self.keys[at] = won, keys[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            self.rounds += 1

    def _slot(self, keys, k):
        return (((keys * _U(0x9E3779B97F4A7C15)) >> _U(20)) + _U(k) & self.mask).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where the key is not there."""
        out = np.full(len(keys), -1, np.int64)
        left = None
        for k in range(self.rounds):
            some = keys if left is None else keys[left]
            slot = self._slot(some, k)
            rows = self.rows[slot]
            hit = (self.keys[slot] == some) & (rows >= 0)
            if left is None:
                out[hit] = rows[hit]
                left = np.flatnonzero(~hit & (rows >= 0))
            else:
                out[left[hit]] = rows[hit]
                left = left[~hit & (rows >= 0)]
            if not len(left):
                break
        return out


class Trie:
    """Log10 costs from per-level (code, count) arrays; level j holds codes of j context bytes and the byte itself."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.grams, self.nodes = [], []
        below = None
        for j, (keys, n) in enumerate(levels):
            order = np.argsort(keys)
            keys, n = keys[order], n[order].astype(float)
            node, first, back = np.unique(keys >> _U(8), return_index=True, return_inverse=True)
            total, kinds = np.bincount(back, n, len(node)), np.bincount(back, minlength=len(node)).astype(float)
            with np.errstate(divide="ignore"):
                top = np.log10(kinds / (total + kinds))
                direct = np.log10(n) - np.log10((total + kinds)[back])
                share = np.log10(n)
            passing, under = np.zeros(len(node)), np.zeros(len(node))
            if j:
                # the mass that this node's bytes have in its suffix, one level down
                up, up_n, up_node, up_total, up_kinds = below
                same = np.searchsorted(up, keys & _U((1 << (8 * j)) - 1))
                gone = np.bincount(back, up_n[same], len(node))
                parent = np.searchsorted(up_node, node & _U((1 << (8 * (j - 1))) - 1) if j > 1 else np.zeros(len(node), np.uint64))
                fresh = up_kinds[parent] - kinds
                rest = up_total[parent] - gone + fresh
                with np.errstate(divide="ignore", invalid="ignore"):
                    under = np.log10(rest)
                    passing = np.where(fresh > 0, np.log10(fresh / rest), 0.0)
            self.grams.append((Hashed(keys), direct, share))
            self.nodes.append((Hashed(node), top, passing, under, kinds))
            below = (keys, n, node, total, kinds)

    def cost(self, code: np.ndarray) -> np.ndarray:
        """Log10 probability of each byte after its context."""
        out = np.zeros(len(code))
        open_, child = np.arange(len(code)), np.full(len(code), -1)  # child: the node one level up, -1 while none is known
        for j in range(len(self.grams) - 1, -1, -1):
            table, direct, share = self.grams[j]
            key = code[open_] & _U((1 << (8 * (j + 1))) - 1)
            row = table.find(key)
            hit = row >= 0
            first = child < 0
            above = self.nodes[j + 1] if j + 1 < len(self.nodes) else None
            a = hit & first
            out[open_[a]] += direct[row[a]]
            b = hit & ~first
            if b.any():
                out[open_[b]] += share[row[b]] - above[3][child[b]]
            open_, child, key = open_[~hit], child[~hit], key[~hit]
            if not len(open_):
                return out
            node, top, *_ = self.nodes[j]
            at = node.find(key >> _U(8))
            known, first = at >= 0, child < 0
            a = known & first
            out[open_[a]] += top[at[a]]
            b = ~first
            if b.any():
                out[open_[b]] += above[2][child[b]]
            child = np.where(known, at, -1)
        kinds = self.nodes[0][4] if self.nodes else np.zeros(0)
        never = 256 - (kinds[0] if len(kinds) else 0)
        return _spread(out, open_, never)


def _spread(out: np.ndarray, open_: np.ndarray, never: float) -> np.ndarray:
    """Bytes that no context has seen share what is left evenly."""
    out[open_] -= np.log10(max(1.0, never))
    return out


class Trained(NamedTuple):
    vocabulary: DataFrame  # key, n
    grams: list[DataFrame]  # level by level: key, n; the full order has its cost too
    nodes: list[DataFrame]  # level by level: node, total, kinds, rest, fresh
    common: tuple[np.ndarray, np.ndarray]  # the most frequent full-order pairs and their costs
    hot: tuple[np.ndarray, np.ndarray]
    tokens: int
    distinct: int


def _low(key: Column, size: int) -> Column:
    """The lowest ``size`` bytes of a code."""
    return key.bitwiseAND(F.lit((1 << (8 * size)) - 1).cast("long"))


def _nodes(grams: list[DataFrame]) -> list[DataFrame]:
    """``node, total, kinds, rest, fresh`` of every context, level by level: what it was followed by, the mass that its
    suffix has besides these bytes, and how many bytes only its suffix has."""
    out: list[DataFrame] = []
    for j, table in enumerate(grams):
        node = F.shiftright("key", 8).alias("node")
        if not j:
            out.append(table.groupBy(node).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).withColumns({c: F.lit(None).cast("long") for c in ("rest", "fresh")}))
            continue
        up = grams[j - 1].select(F.col("key").alias("up"), F.col("n").alias("up_n"))
        own = table.select("key", "n", _low(F.col("key"), j).alias("up")).join(up, "up").groupBy(node).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("up_n").alias("gone"))
        parent = out[-1].select(F.col("node").alias("up"), F.col("total").alias("up_total"), F.col("kinds").alias("up_kinds"))
        fresh = F.col("up_kinds") - F.col("kinds")
        own = own.withColumn("up", _low(F.col("node"), j - 1)).join(parent, "up").select("node", "total", "kinds", (F.col("up_total") - F.col("gone") + fresh).alias("rest"), fresh.alias("fresh"))
        out.append(materialize(own, "lm-nodes"))
    return out


def train(docs: DataFrame, nodes: int = NODES, hot: int = HOT) -> Trained:
    """Count all texts of ``docs(text)`` and keep what the workers need."""
    let_workers_import(docs.sparkSession)
    counted = materialize(counts(docs), "lm-counts")
    words = counted.where("kind = 0").select("key", "n")
    sums = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    level = counted.where("kind = 1").select("key", "n")
    grams = [level]
    for j in range(ORDER - 1, -1, -1):
        level = materialize(level.groupBy(_low(F.col("key"), j + 1).alias("key")).agg(F.sum("n").alias("n")), "lm-level")
        grams.insert(0, level)
    contexts = _nodes(grams)
    after = contexts[-1].select(F.col("node").alias("at"), (F.col("total") + F.col("kinds")).alias("mass"))
    grams[-1] = materialize(grams[-1].withColumn("at", F.shiftright("key", 8)).join(after, "at").select("key", "n", (F.log10("n") - F.log10("mass")).alias("cost")), "lm-costs")
    common = grams[-1].where(F.col("n") >= least_count(grams[-1], nodes)).select("key", "cost").toArrow()
    top = words.where(F.col("n") >= least_count(words, hot)).toArrow()
    return Trained(
        words, grams, contexts, (common.column("key").to_numpy().view(np.uint64), common.column("cost").to_numpy()),
        (top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()), int(sums.n or 0), int(sums.v or 0),
    )


def costs(wanted: DataFrame, trained: Trained) -> DataFrame:
    """``key, cost`` for the distinct codes ``wanted(key)``: what ``Trie.cost`` gives, by joins over all levels."""
    met = materialize(wanted.join(trained.grams[-1].select("key", "cost"), "key", "left"), "lm-met")
    rows = met.where("cost is null").select("key", F.lit(0.0).alias("cost"), F.lit(False).alias("done"), F.lit(None).cast("long").alias("rest"), F.lit(None).cast("long").alias("fresh"))
    for j in range(ORDER, -1, -1):
        here = trained.nodes[j].select(F.col("node").alias("at"), "total", "kinds", F.col("rest").alias("own_rest"), F.col("fresh").alias("own_fresh"))
        pairs = trained.grams[j].select(F.col("key").alias("pair"), "n")
        if j < 2:  # at most 65,536 pairs
            here, pairs = F.broadcast(here), F.broadcast(pairs)
        rows = rows.withColumns({"pair": _low(F.col("key"), j + 1), "at": F.shiftright(_low(F.col("key"), j + 1), 8)}).join(here, "at", "left")
        # codes of the full order have been met
        rows = rows.join(pairs, "pair", "left") if j < ORDER else rows.withColumn("n", F.lit(None).cast("long"))
        hit, below = F.col("n").isNotNull(), F.col("rest").isNotNull()
        step = (
            F.when(hit & below, F.log10("n") - F.log10("rest"))
            .when(hit, F.log10("n") - F.log10(F.col("total") + F.col("kinds")))
            .when(below, F.when(F.col("fresh") > 0, F.log10("fresh") - F.log10("rest")).otherwise(0.0))
            .when(F.col("total").isNotNull(), F.log10("kinds") - F.log10(F.col("total") + F.col("kinds")))
            .otherwise(0.0)
        )
        rows = rows.select(
            "key", F.when(F.col("done"), F.col("cost")).otherwise(F.col("cost") + step).alias("cost"), (F.col("done") | hit).alias("done"), F.col("own_rest").alias("rest"), F.col("own_fresh").alias("fresh"), *(["kinds"] if not j else [])
        )
    never = F.log10(F.greatest(F.lit(1), 256 - F.coalesce("kinds", F.lit(0))))
    rows = rows.select("key", F.when(F.col("done"), F.col("cost")).otherwise(F.col("cost") - never).alias("cost"))
    return met.where("cost is not null").unionByName(rows)


_built: dict[str, tuple] = {}


def score(docs: DataFrame, trained: Trained, carry: list[str]) -> DataFrame:
    """The ``carry`` columns of ``docs`` and ``n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    spark = docs.sparkSession
    let_workers_import(spark)
    shared = spark.sparkContext.broadcast((trained.common, trained.hot))  # bounded by ``nodes`` and ``hot``
    fields = [docs.schema[c] for c in carry]
    mark = uuid.uuid4().hex

    def emit(batches):
        if mark not in _built:
            (common_keys, common_cost), (hot_keys, hot_n) = shared.value
            _built.clear()
            _built[mark] = (Hashed(common_keys), np.append(common_cost, 0.0), Hashed(hot_keys), np.log10(hot_n + 0.5))
        common, cost, hot, hot_log = _built[mark]
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            for i, j, part, off in K.slices(data, offsets):
                starts, ends, first = K.spans(part, off)
                code, place = codes(*stream(part, starts, ends, first))
                row = common.find(code)
                total = np.add.reduceat(cost[row], place[:-1])  # the rest, row -1, costs nothing yet
                left = np.flatnonzero(row < 0)
                text_of = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(place))[left]
                pairs, pairs_n = np.unique((text_of << _U(8 * (ORDER + 1))) | code[left], return_counts=True)
                pairs_at = pa.array(np.searchsorted(pairs >> _U(8 * (ORDER + 1)), np.arange(len(off), dtype=np.uint64)).astype(np.int32))
                pairs = (pairs & _U((1 << (8 * (ORDER + 1))) - 1)).view(np.int64)
                h = K.span_hashes(part, starts, ends)
                row = hot.find(h)
                logs = np.concatenate(([0.0], np.cumsum(np.where(row >= 0, hot_log[row] if len(hot_log) else 0.0, 0.0))))
                known = np.concatenate(([0], np.cumsum(row >= 0)))
                rare, rare_n = [], []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    k, c = np.unique(h[a:b][row[a:b] < 0], return_counts=True)
                    rare.append(k)
                    rare_n.append(c)
                at = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in rare]))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x).astype(np.int64) if x is rare_n else np.concatenate(x).view(np.int64))) for x in (rare, rare_n)]
                lists += [pa.ListArray.from_arrays(pairs_at, pa.array(x.astype(np.int64))) for x in (pairs, pairs_n)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(f.name).slice(i, j - i) for f in fields), batch.column("_row").slice(i, j - i), pa.array(np.diff(first).astype(np.int64) + 1), pa.array(known[first[1:]] - known[first[:-1]]), pa.array(logs[first[1:]] - logs[first[:-1]]), pa.array(total), *lists],
                    [*(f.name for f in fields), "_row", "_tokens", "_known", "_logs", "_score", "_rare", "_times", "_pairs", "_pairs_n"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    rows = docs.select(F.col("text").cast("string").alias("text"), *(c for c in carry if c != "text"), F.monotonically_increasing_id().alias("_row"))
    seen = materialize(rows.mapInArrow(emit, f"{schema}, _row long, _tokens long, _known long, _logs double, _score double, _rare array<long>, _times array<long>, _pairs array<long>, _pairs_n array<long>"), "lm-rows")
    each = seen.select("_row", F.explode(F.arrays_zip("_rare", "_times")).alias("w")).select("_row", F.col("w._rare").alias("key"), F.col("w._times").alias("times"))
    count = F.coalesce(F.col("n"), F.lit(0))
    met = each.join(trained.vocabulary, "key", "left").groupBy("_row").agg(
        F.sum(F.col("times") * F.log10(count + 0.5)).alias("_more"), F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("_more_known")
    )
    coded = seen.select("_row", F.explode(F.arrays_zip("_pairs", "_pairs_n")).alias("w")).select("_row", F.col("w._pairs").alias("key"), F.col("w._pairs_n").alias("times"))
    priced = materialize(costs(coded.select("key").distinct(), trained), "lm-priced")
    paid = coded.join(priced, "key").groupBy("_row").agg(F.sum(F.col("times") * F.col("cost")).alias("_paid"))
    # the end sign is a token of every text
    ends = trained.vocabulary.where(F.col("key") == END).first()
    end_n = int(ends.n) if ends else 0
    shift = float(np.log10(trained.tokens + 0.5 * (trained.distinct + 1)))
    zero = F.lit(0)
    return seen.join(met, "_row", "left").join(paid, "_row", "left").select(
        *carry,
        F.col("_tokens").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_more_known", zero) + F.lit(int(end_n > 0))).cast("long").alias("n_known"),
        F.lit(trained.tokens).cast("long").alias("train_tokens"),
        (F.col("_logs") + F.coalesce("_more", zero.cast("double")) + F.lit(float(np.log10(end_n + 0.5))) - F.col("_tokens") * F.lit(shift)).alias("base_score"),
        (F.col("_score") + F.coalesce("_paid", zero.cast("double"))).alias("score"),
    )


def score_corpus(docs: DataFrame, held: Column, nodes: int = NODES, hot: int = HOT) -> DataFrame:
    """Learn from the rows of ``docs(doc_id, text)`` outside ``held``; score all: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score``.

    A null or empty text is its end sign. Rows that repeat an id are scored one by one. Without training rows counts are
    zero and every byte has probability 1/256. An empty table gives an empty result.
    """
    return score(docs.select("doc_id", "text", held.alias("held_out")), train(docs.where(~held), nodes, hot), ["doc_id", "held_out"])


def adaptive_code_length(text: bytes | str, levels: int = ORDER) -> float:
    """Log10 probability of one text under a trie that starts empty and learns as it reads: the adaptive form.

    Escapes and exclusion are as in the pretrained form. One text at a time, in memory that grows with that text.
    """
    raw = text.encode() if isinstance(text, str) else text
    data = np.frombuffer(raw, np.uint8)
    starts, ends, first = K.spans(data, np.array([0, len(data)]))
    flow, _ = stream(data, starts, ends, first)
    seen: list[dict[bytes, dict[int, int]]] = [{} for _ in range(levels + 1)]
    total, flat = 0.0, flow.tobytes()
    for i in range(ORDER, len(flat)):
        barred: set[int] = set()
        for j in range(levels, -1, -1):
            after = {s: n for s, n in seen[j].get(flat[i - j : i], {}).items() if s not in barred}
            if not after:
                continue
            mass = sum(after.values()) + len(after)
            if flat[i] in after:
                total += float(np.log10(after[flat[i]] / mass))
                break
            total += float(np.log10(len(after) / mass))
            barred |= set(after)
        else:
            total -= float(np.log10(max(1, 256 - len(barred))))
        for j in range(levels + 1):
            row = seen[j].setdefault(flat[i - j : i], {})
            row[flat[i]] = row.get(flat[i], 0) + 1
    return total
