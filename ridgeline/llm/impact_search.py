"""Exact search for the largest inner products on an impact-ordered index, score at a time.

The index cuts the rows into blocks. For every dimension of a block its rows are posted, with their values, in segments of
about equal value (``LEVELS`` steps of the block's range). A query gives every segment an impact, the largest product that
its dimension can add for a row in it, and takes the segments of a block by descending impact: the rows of a segment get
their products added. Dimensions in which a row was not met yet add no more than the next segment's impact each, so after
every stretch of segments each row has an upper bound. The search of a block ends only on proof: when no more than a small
share of its rows can still reach the query's k-th best product so far, or when all segments are taken. Every row that can is
scored exactly, whatever their number, so no member of the result is lost.

A task carries a query's best from block to block, so later blocks have a high bar from the start. It hands on k rows for
each query. Queries go to all tasks in rounds of at most ``QUERY_BYTES``; a round reads the index once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.shared import let_workers_import, materialize
from ridgeline.llm.vectors import about, integer_vectors, matrix, products

BLOCK_ROWS, LEVELS, QUERY_BYTES = 16_384, 16, 16 << 20
#: A block's search looks whether it may end after each of so many stretches of about equally many postings, and ends when at
#: most one row in ``FEW`` can still be a member.
STRETCHES, FEW = 8, 32
_INDEX = "block long, ids array<long>, x binary, order binary, cut binary, low binary, high binary"


def post(x: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a block of integer rows: for every dimension the rows by ascending value (dim x n), bounds of the
    segments in that order (dim x levels + 1), and each segment's smallest and largest value (0 where it is empty)."""
    n, dim = x.shape
    order = np.argsort(x, axis=0, kind="stable").T
    low, high = x.min(axis=0), x.max(axis=0)
    step = np.maximum(1, -(-(high - low + 1) // levels))
    level = (x - low) // step
    cut, lo, hi = (np.zeros((dim, levels + more), np.int64) for more in (1, 0, 0))
    for d in range(dim):
        cut[d] = np.searchsorted(level[order[d], d], np.arange(levels + 1))
        some = np.flatnonzero(cut[d, 1:] > cut[d, :-1])
        lo[d, some], hi[d, some] = x[order[d, cut[d, some]], d], x[order[d, cut[d, some + 1] - 1], d]
    return order, cut, lo, hi


class Block:
    """A block of the index as a task holds it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, order: np.ndarray, cut: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.ids, self.x, self.n, self.dim = ids, x, len(ids), x.shape[1]
        self.rows = order.astype(np.intp).ravel()
        self.values = np.take_along_axis(x.T, order.astype(np.intp), axis=1).astype(np.float64)
        self.gains = np.empty_like(self.values)
        base = np.arange(self.dim)[:, None] * self.n
        keep = (cut[:, 1:] > cut[:, :-1]).ravel()
        self.first, self.last = (base + cut[:, :-1]).ravel()[keep], (base + cut[:, 1:]).ravel()[keep]
        self.of = np.repeat(np.arange(self.dim), cut.shape[1] - 1)[keep]
        self.low, self.high = low.ravel()[keep], high.ravel()[keep]
        #: Above the number of dimensions that a row was met in, which the low bits of its sum hold.
        self.unit = 1 << int(self.dim).bit_length()

    def search(self, query: np.ndarray, k: int, bar: int | None, own: int, few: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows that can be among the k best and reach ``bar`` (None: no bar yet), their exact products, and the number of
        postings taken. ``own``: a row to leave out, or -1."""
        weight = query[self.of]
        impact = np.where(weight > 0, weight * self.high, weight * self.low)
        live = np.flatnonzero(weight)
        turn = live[np.argsort(-impact[live], kind="stable")]
        first, last, of = self.first[turn], self.last[turn], self.of[turn]
        done = np.cumsum(last - first)
        exactly = most * most * self.dim * self.unit < 1 << 52  # then doubles hold the sums
        if exactly:
            np.multiply(self.values, (query * self.unit)[:, None], out=self.gains)
            self.gains += 1
            gains = self.gains.ravel()
        else:
            gains = (self.values.astype(np.int64) * (query * self.unit)[:, None] + 1).ravel()
        total = np.full(self.n, int((query == 0).sum()), np.int64)
        can, fresh, at, taken = np.arange(self.n), bar is None, 0, 0
        ends = np.unique(np.searchsorted(done, done[-1] * np.arange(1, STRETCHES + 1) / STRETCHES)) + 1 if len(turn) else []
        for end in ends:
            # The segments of a dimension in one stretch lie side by side.
            low, high = np.full(self.dim, len(gains)), np.zeros(self.dim, np.int64)
            np.minimum.at(low, of[at:end], first[at:end])
            np.maximum.at(high, of[at:end], last[at:end])
            parts = [p for p in zip(low.tolist(), high.tolist(), strict=True) if p[0] < p[1]]
            rows, gain = (np.concatenate([a[f:l] for f, l in parts]) for a in (self.rows, gains))
            if exactly:
                total += np.bincount(rows, gain, self.n).astype(np.int64)
            else:
                np.add.at(total, rows, gain)
            at, taken = end, taken + len(rows)
            rest = int(impact[turn[at]]) if at < len(turn) else 0
            bound = total // self.unit + (self.dim - total % self.unit) * rest
            if (fresh or at == len(turn)) and self.n > k + 1:
                # The k best so far by bound, scored exactly: the k-th best product is no less than the least of theirs.
                top = np.argpartition(-bound, k)[: k + 1]
                here = int(np.sort(products(self.x[top[top != own]], query[None, :], most)[:, 0])[-k])
                bar = here if bar is None else max(bar, here)
            if bar is not None:
                can = np.flatnonzero(bound >= bar)
                if len(can) <= max(few, k):
                    break
        can = can[can != own]
        exact = products(self.x[can], query[None, :], most)[:, 0] if len(can) else np.zeros(0, np.int64)
        if bar is not None:
            can, exact = can[exact >= bar], exact[exact >= bar]
        return can, exact, taken


def build_index(rows: DataFrame, n: int, dim: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The blocks of ``rows`` (``id, x``), dealt evenly; with fewer rows than the cores would have, smaller blocks."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    block_rows = min(block_rows, max(1024, -(-n // cores)))

    def run(batches):
        from pyspark import TaskContext

        ids, x = [], []
        for batch in batches:
            ids.append(batch.column("id").to_numpy(zero_copy_only=False))
            x.append(matrix(batch.column("x"), dim).astype(np.int64))
        if not ids:
            return
        ids, x = np.concatenate(ids), np.concatenate(x)
        part = TaskContext.get().partitionId()
        for b, s in enumerate(range(0, len(ids), block_rows)):
            own = x[s : s + block_rows]
            arrays = [own, *post(own)]
            arrays[1] = arrays[1].astype(np.int32)
            cells = [pa.array([a.tobytes()], pa.binary()) for a in arrays]
            yield pa.RecordBatch.from_arrays([pa.array([(part << 20) + b]), pa.array([ids[s : s + block_rows]], pa.list_(pa.int64())), *cells], ["block", "ids", "x", "order", "cut", "low", "high"])

    dealt = rows.select("id", "x").repartition(max(1, -(-n // block_rows)))
    return materialize(dealt.mapInArrow(run, _INDEX), "impacts")


def _block(row: dict, dim: int, levels: int) -> Block:
    ids = np.array(row["ids"], np.int64)
    ints = {c: np.frombuffer(row[c], np.int64) for c in ("x", "cut", "low", "high")}
    order = np.frombuffer(row["order"], np.int32).reshape(dim, -1)
    return Block(ids, ints["x"].reshape(-1, dim), order, ints["cut"].reshape(dim, levels + 1), ints["low"].reshape(dim, levels), ints["high"].reshape(dim, levels))


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, few: int = FEW) -> DataFrame:
    """``query_id, rank, <id_col>, score``: the k largest inner products of each row where ``is_query`` with all other rows.

    Components are floor(scale * x) and products exact integers; largest first, ties to the smaller id. ``is_query`` reads
    the column ``id``. Every row counts by itself: rows that repeat an id or a vector are candidates of their own, a query
    leaves out its own row only, and queries that repeat an id each get k rows. Rows with null ids take no part; nor do those
    ``integer_vectors`` leaves out. With fewer candidates than k all are returned; an empty table gives an empty result.
    Products beyond 2^48 are an error.
    """
    spark = vectors.sparkSession
    let_workers_import(spark)
    rows = materialize(integer_vectors(vectors, vector_col, scale, id=id_col).select(F.col("id").cast("long").alias("id"), "x").where("id is not null"), "integers")
    n = about(rows)
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    if not n.n:
        return empty
    if n.m**2 * n.d >= 1 << 48:
        raise ValueError(f"components reach {n.m} after scaling; products of {n.d} of them may leave 48 bits")
    dim, most = n.d, n.m
    index = build_index(rows, n.n, dim, block_rows)
    asked = index.select("block", F.posexplode("ids").alias("place", "id")).where(is_query if isinstance(is_query, Column) else F.expr(is_query))
    asked = materialize(asked, "asked")  # ids and places only
    count = asked.count()
    rounds = max(1, -(-count * dim * 8 // QUERY_BYTES))

    def vectors_of(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["x"], np.int64).reshape(-1, dim)
                at = np.array(row["places"], np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * dim + 1, dim, dtype=np.int32)), pa.array(x[at].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["block"])), pa.array(at.astype(np.int32)), pa.array(row["qids"], pa.int64()), flat], ["block", "place", "id", "x"])

    places = asked.groupBy("block").agg(F.collect_list("place").alias("places"), F.collect_list("id").alias("qids"))  # a block's rows at most
    queries = materialize(index.select("block", "x").join(places, "block").mapInArrow(vectors_of, "block long, place int, id long, x array<long>"), "queries")
    found = []
    for turn in range(rounds):
        mine = queries.where(F.pmod(F.xxhash64("block", "place"), F.lit(rounds)) == turn).toArrow()
        shared = spark.sparkContext.broadcast(
            (mine.column("block").to_numpy(), mine.column("place").to_numpy(), mine.column("id").to_numpy(), matrix(mine.column("x"), dim) if mine.num_rows else np.zeros((0, dim), np.int64))
        )

        def run(batches, shared=shared):
            of, place, qid, q = shared.value
            best_id = [np.zeros(0, np.int64) for _ in qid]
            best = [np.zeros(0, np.int64) for _ in qid]
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    block = _block(row, dim, LEVELS)
                    for j in range(len(qid)):
                        bar = int(best[j][-1]) if len(best[j]) >= k else None
                        own = int(place[j]) if of[j] == row["block"] else -1
                        can, score, _ = block.search(q[j], k, bar, own, block.n // few, most)
                        if len(can):
                            ids, scores = np.concatenate((best_id[j], block.ids[can])), np.concatenate((best[j], score))
                            first = np.lexsort((ids, -scores))[:k]
                            best_id[j], best[j] = ids[first], scores[first]
            sizes = np.array([len(b) for b in best], np.int64)
            if sizes.sum():
                cols = [np.repeat(of, sizes), np.repeat(place, sizes), np.repeat(qid, sizes), np.concatenate(best_id), np.concatenate(best)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["block", "place", "query_id", "hit", "score"])

        found.append(materialize(index.mapInArrow(run, "block long, place int, query_id long, hit long, score long"), "hits"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    turn = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), "hit"))
    return hits.withColumn("rank", turn).where(F.col("rank") <= k).select("query_id", "rank", F.col("hit").alias(id_col), "score")
