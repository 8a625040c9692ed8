"""MinHash near-dedup with b-bit signatures.

Plan, none of whose steps pairs up a whole group:

1. One Arrow pass per document makes the set of word 5-shingles, 128 minima, 32 band keys of 4 full minima each, and
   the b-bit signature: the low 4 bits of each mixed minimum, packed in 8 longs. Equal sets collapse to one node, so
   exact copies never meet each other again.
2. Each band bucket names its smallest node; members pair with it (at most 32 pairs a node). A pair goes on if its
   collision-corrected estimate from bit counts is within five standard deviations of the threshold.
3. What goes on is confirmed on the full sets: ``100 * |A and B| >= 75 * |A or B|``.
4. Components of the confirmed links. Buckets that still span several components are looked through to the end, first
   on signatures alone, bucket by bucket in square blocks of bounded size: a member stays if some member of another
   component passes the estimate. Nodes that share a bucket by chance go here, so what stays are groups of documents that
   are alike. These form families (nodes that share such buckets, directly or through others), which meet in blocks once
   more, with their full sets. Pairs of different components whose estimate passes are confirmed as in 3 right there,
   best estimate first and only while their components are apart, so a block hands on at most one link per node, and
   never a pair that only looks alike. So no link that shares a bucket is lost, however large the bucket. A pair at
   similarity 0.75 shares no bucket with probability (1 - 0.75**4)**32, about 5e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import bloom
from ridgeline.llm import kernels as K
from ridgeline.llm.components import components
from ridgeline.llm.shared import join_hot, materialize

PERMUTATIONS, ROWS, BITS = 128, 4, 4
BANDS, LANES = PERMUTATIONS // ROWS, PERMUTATIONS * BITS // 64
#: Members a side that meet in one task when a family is looked through.
BLOCK = 1024

_rng = np.random.default_rng(88001)
_A = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2)
_SIGNED = [f"s{k} long" for k in range(LANES)]
_SIG = [f"s{k}" for k in range(LANES)]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The 128 minima of a non-empty set of shingle hashes."""
    best = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        part = shingles[None, i : i + 1024] * _A[:, None]
        part += _B[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit key of a non-empty set: what stands for all documents that have it."""
    return int(K.mix(np.array([K.mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))])).view(np.int64)[0])


def pack(low: np.ndarray) -> np.ndarray:
    """Signatures of ``BITS``-bit values (rows x 128) in rows x 8 longs."""
    each = 64 // BITS
    shifts = (np.arange(each, dtype=np.uint64) * np.uint64(BITS))[None, None, :]
    return (low.reshape(len(low), LANES, each) << shifts).sum(axis=2, dtype=np.uint64).view(np.int64)


def _sketch(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64())), *((s, pa.int64()) for s in _SIG)])
    for batch in batches:
        data, offsets = K.text_bytes(batch.column("text"))
        ids = batch.column("doc_id")
        for i, j, part, off in K.slices(data, offsets):
            sets = K.shingle_sets(part, off)
            full = np.flatnonzero([len(s) for s in sets])
            low = np.array([minima(sets[x]) for x in full], np.uint64).reshape(-1, PERMUTATIONS)
            sizes = np.array([len(s) for s in sets], np.int64)
            node, sig, bands = np.zeros(len(sets), np.int64), np.zeros((len(sets), LANES), np.int64), np.zeros((len(sets), BANDS), np.int64)
            if len(full):
                node[full] = [set_key(sets[x]) for x in full]
                mixed = K.mix(low)
                sig[full] = pack(mixed & np.uint64((1 << BITS) - 1))
                grouped = mixed.reshape(len(full), BANDS, ROWS)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], grouped.shape[:2]).copy()
                for r in range(ROWS):
                    key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
                bands[full] = key.view(np.int64)
            mask = sizes == 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(sizes), pa.array(node, mask=mask), lists, *(pa.array(sig[:, k]) for k in range(LANES))], schema=schema)


def estimate(a: list[Column], b: list[Column]) -> Column:
    """Similarity estimated from packed signatures: the share of equal 4-bit lanes, corrected for chance equality."""
    ones = F.lit(0x1111111111111111).cast("long")
    differ = F.lit(0)
    for x, y in zip(a, b, strict=True):
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(ones)
        differ = differ + F.bit_count(z)
    chance = 1 / 2**BITS
    return ((1 - differ / F.lit(float(PERMUTATIONS))) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """Five standard deviations below the threshold."""
    chance = 1 / 2**BITS
    p = threshold + (1 - threshold) * chance
    return threshold - 5 * (p * (1 - p) / PERMUTATIONS) ** 0.5 / (1 - chance)


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, set_node, shingles) of at least the ids in ``wanted(node)``, filtered at the scan by the Bloom filter.
    The node goes along, since rows may repeat an id with another text."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom.packed(wanted))  # at most 8 MB

    def emit(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            hit = pa.array(bloom.passes(bits.value, ids)) if len(ids) else None
            if hit is None or not hit.true_count:
                continue
            batch = batch.filter(hit)
            data, offsets = K.text_bytes(batch.column("text"))
            for i, j, part, off in K.slices(data, offsets):
                sets = K.shingle_sets(part, off)
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))
                keys = pa.array([set_key(x) if len(x) else None for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), keys, lists], ["doc_id", "set_node", "shingles"])

    return docs.where("doc_id is not null").mapInArrow(emit, "doc_id long, set_node long, shingles array<long>")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets have ``100 * shared >= percent * union``."""
    named = pairs.join(nodes.select(F.col("node").alias("a"), F.col("row").alias("ra"), F.col("n").alias("na")), "a").join(
        nodes.select(F.col("node").alias("b"), F.col("row").alias("rb"), F.col("n").alias("nb")), "b"
    )
    named = materialize(named.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")), "pairs")
    left = _sets_of(docs, named.select(F.col("ra").alias("node"))).select(F.col("doc_id").alias("ra"), F.col("set_node").alias("a"), F.col("shingles").alias("sa"))
    right = _sets_of(docs, named.select(F.col("rb").alias("node"))).select(F.col("doc_id").alias("rb"), F.col("set_node").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    met = named.join(left.hint("merge"), ["ra", "a"]).join(right.hint("merge"), ["rb", "b"]).select("a", "b", (F.col("na") + F.col("nb")).alias("both"), shared.alias("shared"))
    return met.where(100 * F.col("shared") >= percent * (F.col("both") - F.col("shared"))).select("a", "b")


def _shared_with(one: np.ndarray, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many members of the sorted set ``one`` each of the sets ``flat[start[k]:start[k+1]]`` (none empty) has."""
    if not len(one):
        return np.zeros(len(start) - 1, np.int64)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[at] == flat).astype(np.int64), start[:-1])


def _differing(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """In how many of the 128 places the packed signatures ``rows`` and ``cols`` differ, all against all."""
    z = rows[:, None, :] ^ cols[None, :, :]
    z |= z >> np.uint64(1)
    z = (z | (z >> np.uint64(2))) & np.uint64(0x1111111111111111)
    return np.bitwise_count(z).sum(axis=2, dtype=np.int64)


def most_differing(least: float) -> int:
    return int((1 - 1 / 2**BITS) * (1 - least) * PERMUTATIONS)


def _alike(rest: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The members of ``rest(key, node, component, members)`` (how many the bucket has) that have a member of another component in their bucket whose
    signature passes the estimate. Only signatures are shuffled; every bucket pair of blocks is one run of sorted rows."""
    dealt = rest.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.join(nodes.select("node", *_SIG), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "component", *_SIG)
    most, names = most_differing(least), ["key", "lo", "hi", "block", "node", "component", *_SIG]

    def near(batches):
        held: list[np.ndarray] | None = None

        def settle(cols, edges):
            key, _, _, block, node, comp = cols[:6]
            sig = np.stack(cols[6:], axis=1).view(np.uint64)
            stays = np.zeros(len(key), bool)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                lo, hi = cols[1][a], cols[2][a]
                left = a + np.flatnonzero(block[a:b] == lo)
                right = a + np.flatnonzero(block[a:b] == hi)
                for s in range(0, len(left), 128):
                    part = left[s : s + 128]
                    ok = (_differing(sig[part], sig[right]) <= most) & (comp[part][:, None] != comp[right][None, :])
                    stays[part[ok.any(axis=1)]] = True
                    stays[right[ok.any(axis=0)]] = True
            return pa.RecordBatch.from_arrays([pa.array(c[stays]) for c in (key, node, comp)], ["key", "node", "component"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            edges = np.concatenate(([0], np.flatnonzero(new) + 1))
            if len(edges) > 1:
                yield settle([c[: edges[-1]] for c in cols], edges)
            held = [c[edges[-1] :] for c in cols]
        if held is not None:
            yield settle(held, np.array([0, len(held[0])]))

    runs = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return runs.mapInArrow(near, "key long, node long, component long").distinct()


def links_between(rows, cols, node, comp, sig, sets, least: float, percent: int) -> tuple[list[int], list[int]]:
    """Confirmed links between members ``rows`` and ``cols`` that join different components, at most one per join."""
    label = np.unique(comp, return_inverse=True)[1]  # of each member's component, as links join them
    most = most_differing(least)
    near: list[tuple[np.ndarray, ...]] = []
    for r in rows:
        differ = _differing(sig[r][None], sig[cols])[0]
        k = np.flatnonzero((differ <= most) & (comp[cols] != comp[r]) & (node[cols] != node[r]))
        near.append((np.full(len(k), r), cols[k], differ[k]))
    if not near or not sum(len(x[0]) for x in near):
        return [], []
    a, b, differ = (np.concatenate(x) for x in zip(*near, strict=True))
    out: tuple[list[int], list[int]] = ([], [])
    order = np.lexsort((a, differ))  # likeliest links first
    a, b, differ = a[order], b[order], differ[order]
    edge = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (differ[1:] != differ[:-1]), [True])))
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        r, todo = a[lo], b[lo:hi]
        todo = todo[label[todo] != label[r]]
        if not len(todo):
            continue
        start = np.concatenate(([0], np.cumsum([len(sets[c]) for c in todo])))
        got = _shared_with(sets[r], np.concatenate([sets[c] for c in todo]), start)
        union = len(sets[r]) + np.diff(start) - got
        for c in todo[100 * got >= percent * union]:
            if label[c] != label[r]:
                label[label == label[c]] = label[r]
                out[0].append(int(node[r]))
                out[1].append(int(node[c]))
    return out


def _family_links(rest: DataFrame, nodes: DataFrame, docs: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (a, b) that join components within the buckets of ``rest(key, node, component)``."""
    heads = rest.groupBy("key").agg(F.min("node").alias("b"))
    family = components(rest.join(heads, "key").select(F.col("node").alias("a"), "b")).select("node", F.col("component").alias("family"))
    members = rest.select("node", "component").distinct().join(family, "node").join(nodes.select("node", "row", *_SIG), "node")
    members = materialize(members, "families")
    sizes = members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sets = _sets_of(docs, members.select(F.col("row").alias("node"))).select(F.col("doc_id").alias("row"), F.col("set_node").alias("node"), "shingles")
    dealt = members.join(sizes, "family").join(sets.hint("merge"), ["row", "node"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "component", "shingles", *_SIG)

    def meet(key, table):
        table = table.combine_chunks()
        node, comp, block = (table.column(c).to_numpy() for c in ("node", "component", "block"))
        sig = np.stack([table.column(s).to_numpy().view(np.uint64) for s in _SIG], axis=1)
        lists = table.column("shingles").combine_chunks() if isinstance(table.column("shingles"), pa.ChunkedArray) else table.column("shingles")
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
        sets = [flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        a, b = links_between(np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py()), node, comp, sig, sets, least, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("family", "lo", "hi").applyInArrow(meet, "a long, b long")


def near_dedup(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents link when ``100 * |A and B| >= percent * |A or B|`` over their sets of word 5-shingles (ASCII-lower-cased;
    a text of fewer words is one shingle). ``component_id`` is the smallest id reachable; ``kept`` marks that row.
    A null, empty or wordless text has no shingles, links with nothing and is kept. Rows that repeat an id are handled
    as documents of their own that share it; a row with a null id gets a null component and is kept. Columns other than
    the two named are not read. Long texts are taken whole.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = materialize(docs.mapInArrow(_sketch, ", ".join(["doc_id long, n_shingles long, node long, bands array<long>", *_SIGNED])), "sketches")
    least = least_estimate(percent / 100)
    nodes = materialize(
        sketched.where("node is not null and doc_id is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("row"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), *(F.first(s).alias(s) for s in _SIG)),
        "nodes",
    )
    slots = nodes.select("node", F.explode("bands").alias("key"))
    heads = slots.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = materialize(join_hot(slots, materialize(heads, "heads"), "key", "members", BANDS * nodes.count(), listed=True), "buckets")
    pairs = shared.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    sig_a = nodes.select(F.col("node").alias("a"), *(F.col(s).alias(f"a_{s}") for s in _SIG))
    sig_b = nodes.select(F.col("node").alias("b"), *(F.col(s).alias(f"b_{s}") for s in _SIG))
    pairs = pairs.join(sig_a, "a").join(sig_b, "b").where(estimate([F.col(f"a_{s}") for s in _SIG], [F.col(f"b_{s}") for s in _SIG]) >= least).select("a", "b")
    links = materialize(_confirmed(pairs, nodes, docs, percent), "confirmed")
    found = components(links)

    placed = shared.join(found.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(placed.select("key", "node", "component"), "placed")
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi")
    rest = materialize(join_hot(placed, materialize(split.select("key", "members"), "split"), "key", "members", placed.count(), listed=True), "split-buckets")
    rest = rest if rest.isEmpty() else materialize(_alike(rest, nodes, least), "alike")
    if not rest.isEmpty():
        more = materialize(_family_links(rest, nodes, docs, least, percent), "confirmed-more")
        if not more.isEmpty():
            found = components(links.union(more))

    labelled = nodes.select("node", "row", "copies").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = labelled.groupBy("component").agg(F.min("row").alias("component_id"))
    labelled = materialize(labelled.join(lowest, "component").select("node", "copies", "component_id"), "labels")
    rows = sketched.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    out = join_hot(rows.where("node is not null"), labelled, "node", "copies", sketched.count(), listed=True).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
