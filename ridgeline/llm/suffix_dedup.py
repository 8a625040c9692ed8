"""Removal of passages that repeat: every byte covered by a 200-byte string that also starts anywhere else goes.

Suffixes are sorted by a difference cover: positions 1 and 2 modulo 3 are the sample; their names are sorted triple by
triple (6 bytes, then triples of names over 18, 54, 162 and at last 201 bytes), the remaining suffixes follow from
their first byte and the rank after it, both are merged by the difference-cover rule, and neighbours in the merged
order are compared on their first 200 bytes.

A sort of every suffix of the corpus would write each position out several times, many times the input. So suffixes
that cannot repeat are left out first, exactly: each 200-byte window names its anchor, the 32-byte string of smallest
hash in it. Equal windows have equal anchors at equal places, so a window whose anchor occurs once is unique, and equal
windows always meet where one anchor's windows meet. Runs of windows with one anchor (chunks) are compared by content
hash; a chunk whose whole content occurs twice repeats as a whole, and the distinct contents of an anchor with several
of them are sorted together. Buckets of anchors make one sort of about a megabyte each, so the sort is distributed by
anchor. An anchor with more than four megabytes of distinct contents is not sorted in one task: its windows are counted
by their 64-bit hashes, which Spark spreads over all tasks. Equality of contents, and of the windows of such an anchor,
is that of the anchor's hash and of one more 64-bit hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import bloom
from ridgeline.llm import kernels as K
from ridgeline.llm.shared import free_name, join_hot, materialize

WINDOW, GRAM = 200, 32
SEGMENT = 1 << 22
BUCKET_BYTES = 1 << 20
#: Bytes of distinct contents beyond which an anchor's windows are counted by hash instead of sorted.
LARGE_ANCHOR = 1 << 22
_U = np.uint64
_STEPS = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h, step = K._TABLE[data], 1
    for m in _STEPS:
        h = h[:-step] * m + h[step:]
        h ^= h >> _U(29)
        step *= 2
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if span < width else h


def chunks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each run of windows of one text that share their anchor."""
    out = []
    for at in range(0, max(1, len(data) - WINDOW + 1), SEGMENT):
        part = data[at : at + SEGMENT + WINDOW - 1]
        if len(part) < WINDOW:
            break
        h = _gram_hashes(part)
        least = _least((h & _U(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64), WINDOW - GRAM + 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        out.append((first + at, np.diff(np.append(first, len(least))), h[(least[first] & _U(0xFFFFFF)).astype(np.int64)]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _texts(batches):
    for batch in batches:
        data, offsets = K.text_bytes(batch.column("text"))
        yield batch, [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def anchors(docs: DataFrame) -> DataFrame:
    """``anchor, n`` over all texts, pre-summed in each task."""

    def emit(batches):
        held: list[np.ndarray] = []
        size = 0

        def out():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for s in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(keys[s : s + (1 << 17)].view(np.int64)), pa.array(n[s : s + (1 << 17)])], ["anchor", "n"])

        for _, texts in _texts(batches):
            for text in texts:
                held.append(chunks(text)[2])
                size += len(held[-1])
                if size > 1 << 20:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    return docs.select("text").mapInArrow(emit, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``doc_id, th, start, n, anchor, content, raw`` of the chunks whose anchor repeats."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom.packed(repeated.select("anchor")))  # at most 8 MB

    def emit(batches):
        for batch, texts in _texts(batches):
            ids, th = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
            cols: list[list] = [[], [], [], [], [], [], []]
            held = 0
            for k, text in enumerate(texts):
                start, n, anchor = chunks(text)
                if not len(start):
                    continue
                ok = bloom.passes(bits.value, anchor)
                if not ok.any():
                    continue
                start, n, anchor = start[ok], n[ok], anchor[ok]
                content = K.span_hashes(text, start, start + n + WINDOW - 1, lower=False)
                raw = text.tobytes()
                m = len(start)
                for col, v in zip(cols, ([ids[k]] * m, [th[k]] * m, start.tolist(), n.tolist(), anchor.view(np.int64).tolist(), content.view(np.int64).tolist(), [raw[a : a + w + WINDOW - 1] for a, w in zip(start.tolist(), n.tolist(), strict=True)]), strict=True):
                    col.extend(v)
                held += m
                if held > 20_000:
                    yield _chunk_batch(cols)
                    cols, held = [[], [], [], [], [], [], []], 0
            if held:
                yield _chunk_batch(cols)

    rows = docs.mapInArrow(emit, "doc_id long, th long, start long, n long, anchor long, content long, raw binary")
    return rows.join(repeated.select("anchor"), "anchor")


def _chunk_batch(cols):
    names = ["doc_id", "th", "start", "n", "anchor", "content", "raw"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if name == "raw" else pa.int64()) for name, c in zip(names, cols, strict=True)], names)


def _named(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 (0 is kept for what lies past the end) of tuples of ranks, equal tuples alike."""
    bits = max(1, max(int(k.max()) if len(k) else 0 for k in keys).bit_length())
    key = keys[0].astype(np.uint64)
    used = bits
    for k in keys[1:]:
        if used + bits > 64:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            used = max(1, int(key.max()).bit_length())
        key = (key << _U(bits)) | k.astype(np.uint64)
        used += bits
    return np.unique(key, return_inverse=True)[1].astype(np.int64) + 1


def suffix_order(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes of ``data`` by their first 200 bytes at least, and a mask over that order: equal to the
    one before in the first 200. Past the end stands a sign smaller than any byte."""
    n = len(data)
    s = np.zeros(n + 2 * WINDOW, np.int64)
    s[:n] = data.astype(np.int64) + 1
    size = n + 2 * WINDOW
    sample = np.flatnonzero(np.arange(n) % 3 != 0)
    six = np.zeros(len(sample), np.uint64)
    for k in range(6):
        six = (six << _U(9)) | s[sample + k].astype(np.uint64)
    rank = np.zeros(size, np.int64)
    rank[sample] = np.unique(six, return_inverse=True)[1] + 1
    for step in (6, 18, 54):  # names of 3 times as many bytes, from names that lie a multiple of 3 apart
        rank[sample] = _named(rank[sample], rank[sample + step], rank[sample + 2 * step])
    mid = rank.copy()  # names of 162 bytes
    rank[sample] = _named(mid[sample], mid[sample + 39])
    top = int(rank.max()) + 1

    def key(at, bytes_):
        out = s[at]
        for k in range(1, bytes_):
            out = out * 257 + s[at + k]
        return out * top + rank[at + bytes_]

    one, two, rest = (np.arange(k, n, 3) for k in (1, 2, 0))
    one, two, rest = one[np.argsort(key(one, 1), kind="stable")], two[np.argsort(key(two, 2), kind="stable")], rest[np.argsort(key(rest, 2), kind="stable")]
    by_rank = np.concatenate((one, two))
    by_rank = by_rank[np.argsort(rank[by_rank], kind="stable")]
    # the difference-cover rule: a remaining suffix meets class 1 one byte on, class 2 two bytes on
    before_one = np.searchsorted(key(one, 1), key(rest, 1), "right")
    before_two = np.searchsorted(key(two, 2), key(rest, 2), "right")
    order = np.empty(n, np.int64)
    place_rest = np.arange(len(rest)) + before_one + before_two
    taken = np.zeros(n, bool)
    taken[place_rest] = True
    order[place_rest] = rest
    order[~taken] = by_rank
    same = np.zeros(n, bool)
    a, b = order[:-1], order[1:]
    # both sampled after this many bytes: by class of a and b modulo 3
    shift = np.array([[1, 1, 2], [1, 0, 0], [2, 0, 0]])[a % 3, b % 3]
    equal = (mid[a + shift] == mid[b + shift]) & (mid[a + shift + 36] == mid[b + shift + 36])
    for k in (0, 1):
        equal &= (shift <= k) | (s[a + k] == s[b + k])
    for k in (198, 199):
        equal &= (shift > k - 198) | (s[a + k] == s[b + k])
    same[1:] = equal
    return order, same


def repeated_windows(raws: list[bytes], n: np.ndarray) -> list[np.ndarray]:
    """For each content the mask of its first ``n`` windows that also start elsewhere in the contents."""
    data = np.frombuffer(b"".join(raws), np.uint8)
    lengths = np.array([len(r) for r in raws], np.int64)
    at = np.cumsum(lengths) - lengths
    order, same = suffix_order(data)
    valid = np.arange(len(data)) - np.repeat(at, lengths) < np.repeat(n, lengths)
    group = np.cumsum(~same) - 1
    members = np.bincount(group, valid[order], group[-1] + 1) if len(group) else np.zeros(0)
    hit = np.zeros(len(data), bool)
    hit[order] = members[group] > 1
    hit &= valid
    return [hit[a : a + m] for a, m in zip(at, n, strict=True)]


def covered(found: DataFrame) -> DataFrame:
    """``anchor, content, lo, hi``: ranges of windows of each content that repeat, from ``candidates``."""
    contents = materialize(found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("raw").alias("raw")), "contents")
    whole = contents.where("c > 1").select("anchor", "content", F.array(F.lit(0).cast("long")).alias("lo"), F.array("n").alias("hi"))
    several = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("single"), F.sum(F.length("raw")).alias("bytes")).where("k > 1 and single > 0").select("anchor", "k", "bytes")
    both = materialize(join_hot(contents, several, "anchor", "k", contents.count()).select("anchor", "content", "c", "n", "raw", "bytes"), "mixed")
    mixed, large = both.where(F.col("bytes") <= LARGE_ANCHOR), both.where(F.col("bytes") > LARGE_ANCHOR)
    total = mixed.agg(F.sum(F.length("raw"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))

    def sort(key, table):
        n = table.column("n").to_numpy()
        masks = repeated_windows(table.column("raw").to_pylist(), n)
        single = table.column("c").to_numpy() == 1
        rows, lo, hi = [], [], []
        for k in np.flatnonzero(single):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], masks[k].astype(np.int8), [0]))))
            if len(edge):
                rows.append(k)
                lo.append(edge[::2])
                hi.append(edge[1::2])
        kind = pa.list_(pa.int64())
        take = pa.array(np.array(rows, np.int64))
        return pa.table({"anchor": table.column("anchor").take(take), "content": table.column("content").take(take), "lo": pa.array(lo, kind), "hi": pa.array(hi, kind)})

    part = mixed.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket").applyInArrow(sort, "anchor long, content long, lo array<long>, hi array<long>")
    out = whole.unionByName(part)
    return out if large.isEmpty() else out.unionByName(_by_window(large))


def _by_window(large: DataFrame) -> DataFrame:
    """``anchor, content, lo, hi`` of contents that occur once, with every window counted by its hash."""

    def windows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                data = np.frombuffer(batch.column("raw")[k].as_py(), np.uint8)
                n = batch.column("n")[k].as_py()
                h = K.span_hashes(data, np.arange(n), np.arange(n) + WINDOW, lower=False)
                cols = [np.full(n, batch.column(c)[k].as_py()) for c in ("anchor", "content", "c")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.arange(n)), pa.array(h.view(np.int64))], ["anchor", "content", "c", "w", "h"])

    def runs(batches):
        for batch in batches:
            lo, hi = [], []
            for w in batch.column("w").to_pylist():
                w = np.sort(w)
                edge = np.flatnonzero(np.diff(w) > 1)
                lo.append(w[np.concatenate(([0], edge + 1))])
                hi.append(w[np.concatenate((edge, [len(w) - 1]))] + 1)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("content"), pa.array(lo, kind), pa.array(hi, kind)], ["anchor", "content", "lo", "hi"])

    each = materialize(large.select("anchor", "content", "c", "n", "raw").mapInArrow(windows, "anchor long, content long, c long, w long, h long").withColumn("key", F.xxhash64("anchor", "h")), "windows")
    seen = each.groupBy("key").agg(F.sum("c").alias("times"), F.count(F.lit(1)).alias("rows")).where("times > 1")
    met = join_hot(each.where("c = 1"), seen, "key", "rows", each.count())
    return met.groupBy("anchor", "content").agg(F.collect_list("w").alias("w")).mapInArrow(runs, "anchor long, content long, lo array<long>, hi array<long>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """For every row of ``docs`` its ``carry`` columns (the id by default) and ``n_bytes, n_removed, n_spans, kept_sha256,
    kept_text``.

    Bytes are judged on the input as it is; matches never cross rows. ``kept_text`` is what remains, without characters
    of which only a part remains. Null counts as empty; texts under 200 bytes stay whole; rows that repeat an id and
    text repeat each other. An empty table gives an empty result. Other columns are only carried.
    """
    carry = carry or [id_col]
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = keyed.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    repeated = materialize(anchors(keyed).where("n > 1"), "anchors")
    found = materialize(candidates(keyed, repeated), "chunks")
    ranges = materialize(covered(found), "ranges")
    # Rows that repeat an id and text have the same chunks, each of which counts once.
    spans = found.select("anchor", "content", "doc_id", "th", "start").distinct().join(ranges, ["anchor", "content"])
    moved = [F.transform(c, lambda x: x + F.col("start")).alias(c) for c in ("lo", "hi")]
    spans = spans.select("doc_id", "th", *moved).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("lo")).alias("_lo"), F.flatten(F.collect_list("hi")).alias("_hi"))
    text, low, high, key, hashed, to, on = (free_name(docs.columns, c) for c in ("_text", "_lo", "_hi", "_key", "_hash", "_id", "_th"))
    spans = spans.select(F.col("doc_id").alias(to), F.col("th").alias(on), F.col("_lo").alias(low), F.col("_hi").alias(high))
    whole = F.col(text_col).cast("string")
    left = docs.select(*carry, F.col(id_col).cast("long").alias(key), whole.alias(text), F.xxhash64(F.coalesce(whole, F.lit(""))).alias(hashed))
    met = left.join(spans, F.col(key).eqNullSafe(F.col(to)) & (F.col(hashed) == F.col(on)), "left").select(*carry, text, low, high)
    fields = [met.schema[c] for c in carry]

    def cut(batches):
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(text))
            lo, hi = batch.column(low), batch.column(high)
            out: list[list] = [[], [], [], [], []]
            for k in range(len(offsets) - 1):
                own = data[offsets[k] : offsets[k + 1]]
                removed = spans_ = 0
                raw = own.tobytes()
                if lo[k].is_valid and len(lo[k]):
                    turn = np.zeros(len(own) + 1, np.int64)
                    np.add.at(turn, lo[k].values.to_numpy(), 1)
                    np.subtract.at(turn, hi[k].values.to_numpy() - 1 + WINDOW, 1)
                    gone = np.cumsum(turn[:-1]) > 0
                    removed = int(gone.sum())
                    spans_ = int((np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1).sum())
                    raw = own[~gone].tobytes()
                for col, v in zip(out, (len(own), removed, spans_, hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "ignore")), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], [*carry, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return met.mapInArrow(cut, f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
