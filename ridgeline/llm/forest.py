"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Largest inner product becomes smallest angle by one more component, sqrt(M^2 - |x|^2) with M the largest norm (0 for
queries). Each tree splits a bounded sample at medians of projections on differences of two sample points; every row is
then routed to its leaf in every tree. A query walks all trees through one priority queue: the node whose smallest
margin on its path is best is opened next, and leaves are taken until they hold a given number of candidates. Candidates
are scored exactly, in double precision on the original vectors.

How many candidates that must be hangs on the data, so it is measured: a bounded number of queries is scored against every
vector, and the search goes as deep as nine in ten and a half of their true neighbours need (``target``). On clustered
vectors that is a small share of the table. Vectors without structure (independent directions in 64 dimensions) have no
near neighbours to speak of: there any partition tree must look at most of the table to find the 20 largest of many
near-equal products, and the measurement says so.

Equal vectors are one entry with its ``k + 1`` smallest ids: no other id of that vector can be among anyone's k
nearest. Leaves lie in groups of bounded size, of which a task sees one with a bounded block of the queries that visit
it, and hands on at most k + 1 entries a query (more only at exact ties). Vectors that many rows or many queries share
are joined by broadcast, so none of them meets all its rows in one task.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.shared import join_hot, let_workers_import, materialize

TREES, LEAF_ROWS, SAMPLE, QUERY_BLOCK = 8, 400, 16_000, 8192
#: Share of the true neighbours of the ``PROBES`` measured queries that the search must reach.
TARGET, PROBES = 0.95, 128
#: Bytes of vectors that a task holds; every group of leaves hands on its own k + 1 entries a query, so few large ones.
GROUP_BYTES = 32 << 20
_SAMPLE_PER_LEAF = 16


class Forest(NamedTuple):
    """Complete binary trees in heap order; node i has children 2i+1 and 2i+2."""

    normals: np.ndarray  # trees x (2**depth - 1) x (dim + 1)
    splits: np.ndarray  # trees x (2**depth - 1)
    depth: int
    norm: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0.0))
        return np.concatenate((x, rest[:, None]), axis=1)

    def leaves(self, lifted: np.ndarray, tree: int) -> np.ndarray:
        at = np.zeros(len(lifted), np.int64)
        for _ in range(self.depth):
            side = np.einsum("ij,ij->i", lifted, self.normals[tree, at]) > self.splits[tree, at]
            at = 2 * at + 1 + side
        return at - (2**self.depth - 1)

    def visit(self, query: np.ndarray, sizes: np.ndarray, want: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue until the leaves hold ``want`` entries, empty leaves left out."""
        lifted = np.append(query, 0.0)
        margins = self.normals @ lifted - self.splits
        inner = 2**self.depth - 1
        heap = [(-np.inf, t, 0) for t in range(len(self.normals))]
        out: list[tuple[int, int]] = []
        got = 0
        while heap and got < want:
            bad, t, i = heapq.heappop(heap)
            if i >= inner:
                if sizes[t, i - inner]:
                    out.append((t, i - inner))
                    got += int(sizes[t, i - inner])
                continue
            m = float(margins[t, i])
            heapq.heappush(heap, (max(bad, m), t, 2 * i + 1))
            heapq.heappush(heap, (max(bad, -m), t, 2 * i + 2))
        return out


def grow(sample: np.ndarray, norm: float, rows: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 11) -> Forest:
    """A forest on a sample, deep enough for ``rows`` entries at ``leaf_rows`` each as far as the sample bears it."""
    leaf_rows = min(leaf_rows, max(16, rows // 64))
    depth = max(0, int(np.ceil(np.log2(max(1.0, rows / leaf_rows)))))
    depth = min(depth, max(0, int(np.floor(np.log2(max(1.0, len(sample) / _SAMPLE_PER_LEAF))))))
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    forest = Forest(np.zeros((trees, 2**depth - 1, dim + 1)), np.zeros((trees, 2**depth - 1)), depth, norm)
    lifted = forest.lift(sample)
    for t in range(trees):
        parts = {0: np.arange(len(sample))}
        for i in range(2**depth - 1):
            own = parts.pop(i)
            w = rng.normal(size=dim + 1)
            if len(own) > 1:
                a, b = rng.choice(own, 2, replace=False)
                if np.linalg.norm(lifted[a] - lifted[b]) > 1e-9:
                    w = lifted[a] - lifted[b]
            w /= np.linalg.norm(w)
            p = lifted[own] @ w
            cut = float(np.median(p)) if len(own) else 0.0
            forest.normals[t, i], forest.splits[t, i] = w, cut
            parts[2 * i + 1], parts[2 * i + 2] = own[p <= cut], own[p > cut]
    return forest


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` (doubles) of vectors that are not null or zero and hold no null or non-finite component, of the
    dimension that most of them have (of two as common, the smaller)."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes.d if sizes else 1))


def needed(forest: Forest, sizes: np.ndarray, queries: np.ndarray, found: list[np.ndarray], target: float) -> float:
    """How many entries the leaves visited must hold so that a share ``target`` of the neighbours ``found`` (a matrix for
    each query) is among them."""
    costs = []
    for query, near in zip(queries, found, strict=True):
        if not len(near):
            continue
        order = forest.visit(query, sizes, np.inf)
        total = np.cumsum([sizes[t, leaf] for t, leaf in order])
        at = np.full(sizes.shape, np.inf)
        for (t, leaf), n in zip(order, total, strict=True):
            at[t, leaf] = n
        lifted = forest.lift(near)
        costs.append(np.min([at[t, forest.leaves(lifted, t)] for t in range(len(sizes))], axis=0))
    return float(np.quantile(np.concatenate(costs), target, method="higher")) if costs else 0.0


def probe(entries: DataFrame, queries: np.ndarray, k: int, dim: int) -> list[np.ndarray]:
    """The true k nearest entries of each of a few query vectors, themselves left out: a scan in which every task keeps
    its best and Spark merges those."""
    shared = entries.sparkSession.sparkContext.broadcast(queries)

    def best(batches):
        q = shared.value
        top, held = np.full((len(q), k), -np.inf), np.zeros((len(q), k, dim))
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            for s in range(0, len(x), 4096):
                part = x[s : s + 4096]
                score = q @ part.T
                i, j = np.nonzero(q[:, None, 0] == part[None, :, 0])
                own = (q[i] == part[j]).all(axis=1)
                score[i[own], j[own]] = -np.inf
                both = np.concatenate((top, score), axis=1)
                pick = np.argsort(-both, axis=1, kind="stable")[:, :k]
                held = np.stack([np.concatenate((held[i], part[np.maximum(p - k, 0)]))[np.where(p < k, p, k + np.arange(k))] for i, p in enumerate(pick)])
                top = np.take_along_axis(both, pick, axis=1)
        i, j = np.nonzero(top > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(top[i, j]), pa.array(list(held[i, j]), pa.list_(pa.float64()))], ["q", "score", "v"])

    each = entries.select("v").mapInArrow(best, "q int, score double, v array<double>")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "v"))
    rows = each.withColumn("n", place).where(F.col("n") <= k).select("q", "v").collect()  # k rows for each of a few queries
    out: list[list] = [[] for _ in queries]
    for r in rows:
        out[r.q].append(r.v)
    return [np.array(v, np.float64).reshape(-1, dim) for v in out]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaf_rows: int = LEAF_ROWS, search: float | None = None, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """``query_id, rank, <id_col>, score``: the k nearest found for each row where ``is_query``, among all other rows.

    Nearest first by inner product, ties to the smaller id; fewer than k only if there are fewer candidates found.
    ``sample`` bounds the rows that the trees are fitted on; every row is indexed. ``search``: how many candidates a query
    looks at, as a share of the distinct vectors (each is in every tree, so shares above 1 make sense); without it the
    share is measured for ``target``, on ``PROBES`` queries chosen by hash. Rows that repeat an id count once per
    distinct vector. Unusable vectors (see ``usable``) take no part; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    let_workers_import(spark)
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    rows = usable(vectors, id_col, vector_col)
    smallest = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = rows.select("id", "v", smallest.alias("n")).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    entries = materialize(entries, "vectors")
    about = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"), F.max(F.size("v")).alias("d")).first()
    if not about.n:
        return empty
    dim, total = about.d, about.n
    picked = entries.orderBy(F.xxhash64("v")).limit(sample).select("v").toArrow()
    forest = grow(_matrix(picked.column("v"), dim), float(np.sqrt(about.m)), total, trees, leaf_rows)
    shared = spark.sparkContext.broadcast(tuple(forest))  # at most trees x sample / 16 nodes
    groups = max(1, -(-total * dim * 8 // GROUP_BYTES))

    def route(batches):
        f = Forest(*shared.value)
        for batch in batches:
            x = f.lift(_matrix(batch.column("v"), dim))
            salt = (x.view(np.uint64).sum(axis=1, dtype=np.uint64) >> np.uint64(33)).astype(np.int64)
            for t in range(len(f.normals)):
                leaf = f.leaves(x, t)
                group = (leaf * groups >> f.depth) if groups <= 2**f.depth else leaf * (-(-groups >> f.depth)) + salt % (-(-groups >> f.depth))
                cols = [np.full(len(x), t, np.int32), group.astype(np.int64), leaf.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), batch.column("ids"), batch.column("v")], ["tree", "grp", "leaf", "ids", "v"])

    routed = materialize(entries.mapInArrow(route, "tree int, grp long, leaf int, ids array<long>, v array<double>"), "routed")
    sizes = np.zeros((trees, 2**forest.depth), np.int64)
    where = np.full((trees, 2**forest.depth, 2), -1, np.int64)
    for r in routed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).collect():  # bounded as the forest is
        sizes[r.tree, r.leaf] = r.n
        where[r.tree, r.leaf] = r.lo, r.hi
    shared_sizes = spark.sparkContext.broadcast((sizes, where))
    asked = rows.where(is_query if isinstance(is_query, Column) else F.expr(is_query)).select("id", "v")
    asked = materialize(asked, "asked")
    distinct = materialize(asked.groupBy("v").agg(F.min("id").alias("q"), F.count(F.lit(1)).alias("askers")), "queries")
    asking = materialize(join_hot(asked, distinct, "v", "askers", asked.count()).select(F.col("id").alias("query_id"), "q").distinct(), "asking")
    if search is None:
        few = distinct.orderBy(F.xxhash64("v")).limit(PROBES).select("v").toArrow()
        probes = _matrix(few.column("v"), dim)
        want = needed(forest, sizes, probes, probe(entries, probes, k, dim), target) if len(probes) else 0.0
    else:
        want = search * total

    def walk(batches):
        f = Forest(*shared.value)
        leaf_sizes, places = shared_sizes.value
        for batch in batches:
            x, q = _matrix(batch.column("v"), dim), batch.column("q").to_pylist()
            out: dict[str, list] = {"tree": [], "grp": [], "q": [], "v": [], "leaves": []}
            for i in range(len(q)):
                seen: dict[tuple[int, int], list[int]] = {}
                for t, leaf in f.visit(x[i], leaf_sizes, want):
                    for g in range(places[t, leaf, 0], places[t, leaf, 1] + 1):
                        seen.setdefault((t, int(g)), []).append(leaf)
                for (t, g), leaves in seen.items():
                    for name, value in zip(out, (t, g, q[i], x[i], leaves), strict=True):
                        out[name].append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out.values(), kinds, strict=True)], list(out))

    visits = materialize(distinct.select("q", "v").mapInArrow(walk, "tree int, grp long, q long, v array<double>, leaves array<int>"), "visits")
    blocks = visits.groupBy("tree", "grp").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    left = routed.join(blocks, ["tree", "grp"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = visits.join(blocks, ["tree", "grp"]).withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).drop("blocks")

    def score(key, here, there):
        x, qx = _matrix(here.column("v"), dim), _matrix(there.column("v"), dim)
        q, leaf = there.column("q").to_numpy(), here.column("leaf").to_numpy()
        counts = there.column("leaves").combine_chunks() if isinstance(there.column("leaves"), pa.ChunkedArray) else there.column("leaves")
        pair_leaf = counts.flatten().to_numpy(zero_copy_only=False)
        pair_q = np.repeat(np.arange(len(q)), counts.value_lengths().to_numpy(zero_copy_only=False))
        found = [(np.zeros(0, np.int64),) * 2]
        floor = np.full(len(q), -np.inf)
        for one in np.unique(pair_leaf):
            c, who = np.flatnonzero(leaf == one), pair_q[pair_leaf == one]
            for s in range(0, len(who), 1024):
                part = who[s : s + 1024]
                for u in range(0, len(c), 4096):
                    own = c[u : u + 4096]
                    p = qx[part] @ x[own].T
                    if p.shape[1] > k + 1:
                        kth = np.partition(p, p.shape[1] - k - 1, axis=1)[:, p.shape[1] - k - 1]
                        floor[part] = np.maximum(floor[part], kth - 1e-9 * (1 + np.abs(kth)))
                    i, j = np.nonzero(p >= floor[part][:, None])
                    found.append((part[i], own[j]))
        i, j = (np.concatenate(a) for a in zip(*found, strict=True))
        exact = np.empty(len(i))
        for s in range(0, len(i), 1 << 15):  # one fixed order of summation, so that equal products come out equal
            exact[s : s + (1 << 15)] = (qx[i[s : s + (1 << 15)]] * x[j[s : s + (1 << 15)]]).sum(axis=1)
        ids = here.column("ids").combine_chunks() if isinstance(here.column("ids"), pa.ChunkedArray) else here.column("ids")
        least = ids.flatten().to_numpy(zero_copy_only=False)[np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)) - ids.value_lengths().to_numpy(zero_copy_only=False)]
        order = np.lexsort((least[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        start = np.searchsorted(i, np.arange(len(q)))
        best = np.arange(len(i)) - start[i] <= k
        return pa.table({"q": pa.array(q[i[best]]), "ids": ids.take(pa.array(j[best])), "score": pa.array(exact[best])})

    found = left.groupBy("tree", "grp", "block").cogroup(right.groupBy("tree", "grp", "block")).applyInArrow(score, "q long, ids array<long>, score double")
    met = found.groupBy("q", F.col("ids")[0].alias("head")).agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    each = met.select("q", "score", F.explode("ids").alias("hit"))
    by = Window.partitionBy("q").orderBy(F.desc("score"), "hit")
    best = materialize(each.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1).drop("n"), "nearest")
    sized = best.join(asking.groupBy("q").agg(F.count(F.lit(1)).alias("askers")), "q")
    answers = join_hot(asking, sized, "q", "askers", asking.count()).where("hit <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "hit"))
    return answers.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("hit").alias(id_col), "score")
