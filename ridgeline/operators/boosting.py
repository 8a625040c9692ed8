"""Gradient-boosted regression trees on histograms, grown leaf by leaf.

Features are cut into bins at quantiles once. A level of a tree is one job: every task adds up the gradients of its rows
by node, feature and bin, Spark sums those tables, and the driver, which sees nodes x features x bins figures whatever the
number of rows, takes the best cut of each node. A node's cut hangs on its own rows only, so growing the best leaf first
until there are ``leaves`` of them is a choice among the cuts of all levels, made without reading the rows again. Of two
nodes that a cut makes only the smaller is added up, the other is what it leaves of the sums above.

Tables of at most ``ALONE`` rows are boosted by one task from the first tree to the last, since a job takes longer to start than
such a level to add up; several tables are so at the same time. The trees are the same.

Gradients are whole numbers of a unit of 2^-30 of the label's range: their sums are exact, so the trees do not hang
on the number of tasks.
"""

from __future__ import annotations

import heapq
import json
import math
import random
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.guards import complete
from ridgeline.sources.store import shared_dir

#: After so many trees the rows are written anew with their predictions so far.
REST = 10
#: Rows that one task boosts alone: 19 features with label and prediction are 43 bytes a row, 86 MB.
ALONE = 2_000_000


class Tree(NamedTuple):
    """Node 0 is the root; a leaf has feature -1. Rows with at most ``threshold`` go to ``left``, unknown values too."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    gain: list[float]


class _Cut(NamedTuple):
    gain: float
    feature: int
    bin: int
    left: tuple[int, int]  # gradients and rows
    right: tuple[int, int]


def _leaf(tree: Tree, x: np.ndarray, node: int):
    f = tree.feature[node]
    if f < 0:
        return np.int32(node)
    left, right = _leaf(tree, x, tree.left[node]), _leaf(tree, x, tree.right[node])
    return right + (left - right) * (x[:, f] <= x.dtype.type(tree.threshold[node]))


def reach(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of every row of ``x`` (rows x features, best stored by columns; unknown values as minus infinity): one
    comparison a cut over whole columns."""
    return np.broadcast_to(_leaf(tree, x, 0), len(x))


def predicted(trees: list[Tree], base: float, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), base)
    for t in trees:
        out += np.array(t.value)[reach(t, x)]
    return out


def best_cut(sums: np.ndarray, counts: np.ndarray, columns: list[int], least: int) -> _Cut | None:
    """The cut of largest gain of one node from its sums and counts (features x bins), ties to the first feature and
    bin; None without a gain or with fewer than ``least`` rows on a side. Gains are compared as exact sums give them: in
    doubles first, and then those that rounding may have put behind."""
    g, n = np.cumsum(sums[columns], axis=1), np.cumsum(counts[columns], axis=1)
    total, rows = int(g[0, -1]), int(n[0, -1])
    at = np.nonzero((n >= least) & (rows - n >= least))
    if not len(at[0]):
        return None
    left, right, few = g[at].astype(float), (total - g[at]).astype(float), n[at].astype(float)
    parts = left * left / few, right * right / (rows - few), float(total) ** 2 / rows
    gains, off = parts[0] + parts[1] - parts[2], 16 * np.finfo(float).eps * (parts[0] + parts[1] + parts[2])
    best = None
    for k in np.flatnonzero(gains + off >= (gains - off).max()):
        c, b = int(at[0][k]), int(at[1][k])
        gl, nl = int(g[c, b]), int(n[c, b])
        gain = gl * gl / nl + (total - gl) ** 2 / (rows - nl) - total * total / rows
        if gain > 0 and (best is None or gain > best.gain):
            best = _Cut(gain, columns[c], b, (gl, nl), (total - gl, rows - nl))
    return best


def _added_up(blocks, partial: Tree, wanted: list[int], columns: list[int], width: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and counts, nodes x features x bins, of the ``wanted`` nodes of a tree in the making on ``columns``, over
    blocks of bins and gradients."""
    slot = np.full(len(partial.feature), -1)
    slot[wanted] = np.arange(len(wanted))
    g, n = np.zeros((2, len(wanted), width, wide), np.int64)
    for b, grad in blocks:
        node = slot[reach(partial, b)]
        inside = np.flatnonzero(node >= 0)
        first, grad = node[inside] * wide, grad[inside]
        for c in columns:
            cell = first + b[inside, c]
            for k in range(0, len(cell), 1 << 21):  # doubles add up so many whole numbers below 2^32 exactly
                part = cell[k : k + (1 << 21)]
                g[:, c] += np.bincount(part, grad[k : k + (1 << 21)], len(wanted) * wide).astype(np.int64).reshape(-1, wide)
                n[:, c] += np.bincount(part, minlength=len(wanted) * wide).reshape(-1, wide)
    return g, n


class _Growth(NamedTuple):
    """What trees are grown with."""

    depth: int
    leaves: int
    least: int
    rate: float
    unit: float
    edges: list[np.ndarray]


def _grown(how: _Growth, columns: list[int], sums_of) -> tuple[Tree, Tree]:
    """A tree on bins (as rows are held), and the same on values. ``sums_of`` a tree in the making and some of its nodes are their
    gradients and counts, nodes x features x bins."""
    full = Tree([-1], [0.0], [0], [0], [0.0], [0.0])
    own, found = {0: (0, 1)}, {}
    level = dict(zip([0], zip(*sums_of(full, [0]), strict=True), strict=True))
    own[0] = tuple(int(part[columns[0]].sum()) for part in level[0])
    for below in range(depth := how.depth):
        pairs = []
        for node, (g, n) in level.items():
            if (cut := best_cut(g, n, columns, how.least)) is None:
                continue
            found[node] = cut
            for side in (cut.left, cut.right):
                own[len(full.feature)] = side
                for column, v in zip(full, (-1, 0.0, 0, 0, 0.0, 0.0), strict=True):
                    column.append(v)
            left, right = len(full.feature) - 2, len(full.feature) - 1
            pairs.append((node, left, right) if cut.left[1] <= cut.right[1] else (node, right, left))
            full.feature[node], full.threshold[node], full.left[node], full.right[node] = cut.feature, float(cut.bin), left, right
        if not pairs or below + 1 == depth:
            break
        above, level = level, {}
        for (node, few, many), g, n in zip(pairs, *sums_of(full, [few for _, few, _ in pairs]), strict=True):
            level |= {few: (g, n), many: (above[node][0] - g, above[node][1] - n)}
        level = dict(sorted(level.items()))
    # The best leaf first: of all cuts, those that a tree of so many leaves takes.
    open_, taken = [(-found[0].gain, 0)] if 0 in found else [], set()
    while open_ and len(taken) + 1 < how.leaves:
        _, node = heapq.heappop(open_)
        taken.add(node)
        for child in (full.left[node], full.right[node]):
            if child in found:
                heapq.heappush(open_, (-found[child].gain, child))
    tree = Tree([], [], [], [], [], [])

    def add(node: int) -> int:
        me = len(tree.feature)
        inner = node in taken
        g, n = own[node]
        for column, v in zip(tree, (full.feature[node] if inner else -1, full.threshold[node], 0, 0, 0.0 if inner else how.rate * how.unit * g / n, found[node].gain * how.unit * how.unit if inner else 0.0), strict=True):
            column.append(v)
        if inner:
            tree.left[me], tree.right[me] = add(full.left[node]), add(full.right[node])
        return me

    add(0)
    values = [float(how.edges[f][int(b)]) if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.threshold, strict=True)]
    return tree, tree._replace(threshold=values)


def _values(columns: list[pa.Array]) -> np.ndarray:
    """Rows x features, stored by columns."""
    x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns]).astype(float)
    return np.where(np.isnan(x), -np.inf, x).T


#: Rows as tasks hold them: bins by columns, labels and predictions so far of some thousand rows at a time, since a row by
#: itself costs more on its way to Python than its sums do.
BLOCKS = "b binary, y binary, score binary"


def _packed(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(part).tobytes() for part in column], pa.binary()) for column in zip(*blocks, strict=True)], ["b", "y", "score"])


def _blocks(batch: pa.RecordBatch, width: int, kind: np.dtype):
    """Bins (rows x features, stored by columns), labels and predictions of each block."""
    for b, y, score in zip(*(batch.column(c) for c in ("b", "y", "score")), strict=True):
        yield np.frombuffer(b.as_buffer(), kind).reshape(width, -1).T, np.frombuffer(y.as_buffer()), np.frombuffer(score.as_buffer())


class Boosted(NamedTuple):
    features: list[str]
    base: float
    trees: list[Tree]

    def alpha(self) -> Column:
        """The prediction as a column over the features."""
        trees, base = self.trees, self.base

        def run(*x: pa.Array) -> pa.Array:
            return pa.array(predicted(trees, base, _values(x)))

        return F.arrow_udf(run, "double")(*(F.col(c).cast("double") for c in self.features))

    def importance(self, kind: str = "split") -> list[float]:
        """Of each feature: how many cuts are on it (``split``), or what they gain in squared error (``gain``)."""
        out = [0.0] * len(self.features)
        for t in self.trees:
            for f, gain in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    out[f] += 1.0 if kind == "split" else gain
        return out


def boost(rows: DataFrame, features: list[str], y: str = "fwd_ret", trees: int = 200, depth: int = 4, leaves: int = 31, rate: float = 0.05, column_share: float = 0.8, least: int = 20, bins: int = 255, seed: int = 0) -> Boosted:
    """Least-squares boosting on the rows with a known label, from the label's mean.

    A tree has at most ``depth`` levels of cuts and ``leaves`` leaves, of ``least`` rows each at least; it sees a draw of
    ``column_share`` of the features. All rows count for every tree. Unknown values go left. Without rows, or with labels all
    equal, there are no trees.
    """
    spark, width = rows.sparkSession, len(features)
    rows = complete(rows.select(*(F.col(c).cast("double").alias(c) for c in features), F.col(y).cast("double").alias("_y")), ["_y"])
    shares = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    about = rows.agg(F.count(F.lit(1)).alias("_rows"), F.avg("_y").alias("_mean"), F.max("_y").alias("_high"), F.min("_y").alias("_low"), *(F.percentile_approx(c, shares, 10_000).alias(c) for c in features)).first()
    if about._mean is None or about._high == about._low:
        return Boosted(features, about._mean or 0.0, [])
    unit = 2.0 ** (math.ceil(math.log2(about._high - about._low)) - 30)
    edges = [np.unique(np.array([v for v in about[c] or [] if not math.isnan(v)])) for c in features]
    wide = max(len(e) for e in edges) + 1
    kind = np.dtype(np.uint8 if wide <= 256 else np.uint16)
    base, made = float(about._mean), []
    folder = f"{shared_dir(spark)}/ridgeline-boosting-{uuid.uuid4().hex}"

    def binned(batches):
        for batch in batches:
            x = _values(batch.columns[:width])
            place = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1).astype(kind)
            yield _packed([(place.T, batch.column("_y").to_numpy(), np.full(len(place), base))])

    rows.select(*features, "_y").mapInArrow(binned, BLOCKS).write.parquet(f"{folder}/0")
    held, since = spark.read.schema(BLOCKS).parquet(f"{folder}/0"), []

    how = _Growth(depth, leaves, least, rate, unit, edges)
    draws = [sorted(random.Random(f"{seed} {k}").sample(range(width), max(1, round(column_share * width)))) for k in range(trees)]

    def alone(batches):
        parts = [(b, y, np.array(score), np.zeros(len(y))) for batch in batches for b, y, score in _blocks(batch, width, kind)]
        grown = []
        for k, columns in enumerate(draws):
            grads = [np.rint((y - (score + added)) / unit) for _, y, score, added in parts]
            on_bins, on_values = _grown(how, columns, lambda partial, wanted, grads=grads, columns=columns: _added_up(((p[0], grad) for p, grad in zip(parts, grads, strict=True)), partial, wanted, columns, width, wide))
            grown.append(on_values)
            leaf = np.array(on_bins.value)
            for b, _, score, added in parts:
                added += leaf[reach(on_bins, b)]
                if k % REST == REST - 1:
                    score += added
                    added[:] = 0.0
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(grown)])], ["trees"])

    def summed(columns: list[int], before: list[Tree]):
        """``sums_of`` for ``_grown``: a job adds up."""

        def sums_of(partial: Tree, wanted: list[int]) -> tuple[np.ndarray, np.ndarray]:
            def run(batches):
                blocks = (block for batch in batches for block in _blocks(batch, width, kind))
                g, n = _added_up(((b, np.rint((y - (score + predicted(before, 0.0, b))) / unit)) for b, y, score in blocks), partial, wanted, columns, width, wide)
                g, n = g.ravel(), n.ravel()
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(g[some]), pa.array(n[some])], ["cell", "g", "n"])

            total = held.mapInArrow(run, "cell long, g long, n long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
            got = total.toArrow()  # nodes x features x bins rows at most
            out = np.zeros((2, len(wanted) * width * wide), np.int64)
            out[0, got.column("cell").to_numpy()], out[1, got.column("cell").to_numpy()] = got.column("g").to_numpy(), got.column("n").to_numpy()
            return tuple(out.reshape(2, len(wanted), width, wide))

        return sums_of

    if about._rows <= ALONE:
        (found,) = held.coalesce(1).mapInArrow(alone, "trees string").collect()
        made, trees = [Tree(*t) for t in json.loads(found.trees)], 0
    for k in range(trees):
        on_bins, on_values = _grown(how, draws[k], summed(draws[k], since))
        made.append(on_values)
        since.append(on_bins)
        if len(since) == REST and k + 1 < trees:
            so_far = list(since)

            def moved(batches, so_far=so_far):
                for batch in batches:
                    for b, y, score in _blocks(batch, width, kind):
                        yield _packed([(b.T, y, score + predicted(so_far, 0.0, b))])

            held.mapInArrow(moved, BLOCKS).write.parquet(f"{folder}/{k + 1}")
            held = spark.read.schema(held.schema).parquet(f"{folder}/{k + 1}")
            since.clear()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return Boosted(features, base, made)
