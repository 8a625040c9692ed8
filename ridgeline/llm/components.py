"""Connected components of a link table by contraction: a task joins up the links it holds, and shuffles bring together
links that touch, first at their larger end, then at both (the small-star and large-star steps, for whole tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.shared import HOT_SHARE, let_workers_import, materialize

#: Links that a task contracts at once (4 MB of ids), however many it is given.
CHUNK = 1 << 18
#: Parts that the links of a node with a thousandth of all links are dealt to.
PARTS = 64


def lowest_in_reach(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges but for the smallest one of each component, and that smallest one."""
    names, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(names))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    child = np.flatnonzero(label != np.arange(len(names)))
    return names[child], names[label[child]]


def _contract(batches):
    """Links ``u, v`` to stars: every node but the smallest of its component, with that one. Links that don't ``stay``
    are only looked at: another task hands their ends on."""
    held, rows = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names])
        rows += batch.num_rows
        if rows >= CHUNK:
            yield _stars(held)
            held, rows = [], 0
    if rows:
        yield _stars(held)


def _stars(held):
    u, v, *stay = (np.concatenate(x) for x in zip(*held, strict=True))
    node, low = lowest_in_reach(u, v)
    if stay:
        own = np.isin(node, np.concatenate((u[stay[0]], v[stay[0]])))
        node, low = node[own], low[own]
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(low)], ["u", "v"])


def _meet_below(edges: DataFrame) -> DataFrame:
    """Links with the same larger end meet in a task. As many links as before at most."""
    return edges.repartition("u").mapInArrow(_contract, "u long, v long")


def _meet_around(edges: DataFrame, hot: list[int]) -> DataFrame:
    """All links of a node meet in a task, which hands on the node and its larger neighbours: as many links as before at
    most, and one for each node that has such. Of a ``hot`` node the links to larger ones are dealt to parts, and all
    parts see those to smaller ones."""
    above = edges.select("u", "v", F.lit(True).alias("stay"), F.col("v").alias("at"), (F.pmod(F.xxhash64("u"), F.lit(PARTS)) if hot else F.lit(0)).cast("int").alias("part"))
    below = edges.select("u", "v", F.lit(False).alias("stay"), F.col("u").alias("at"), F.lit(0).alias("part"))
    if hot:
        above = above.withColumn("part", F.when(F.col("at").isin(hot), F.col("part")).otherwise(0))
        parts = F.sequence(F.lit(0), F.when(F.col("at").isin(hot), PARTS - 1).otherwise(0))
        below = below.withColumn("part", F.explode(parts))
    return above.unionByName(below).repartition("at", "part").select("u", "v", "stay").mapInArrow(_contract, "u long, v long")


def _state(edges: DataFrame) -> tuple[int, list[int]]:
    """How many nodes hang below two others, or below one while others hang below them (none in a forest of stars), and
    the nodes with at least a thousandth of all links."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("up")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("up")))).alias("x"))
    seen = ends.groupBy("x.node").agg(F.min("x.up").alias("lo"), F.max("x.up").alias("hi"), F.bool_or(F.col("x.up").isNull()).alias("above"), F.count(F.lit(1)).alias("links"))
    least = max(100, edges.count() // HOT_SHARE)
    row = seen.agg(F.count_if(F.expr("lo is not null and (above or lo <> hi)")), F.collect_list(F.when(F.col("links") >= least, F.col("node")))).first()
    return row[0], row[1]  # at most some two thousand names


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; component is the smallest node reachable.

    A round's edges are written to the shared folder, which cuts lineage. The loop ends when every node hangs below one
    smallest node; the number of rounds grows with the logarithm of the size. Only counts and the names of nodes with
    very many links reach the driver. Links of a node with itself or with null count for nothing.
    """
    let_workers_import(links.sparkSession)
    edges = links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    edges = materialize(_meet_below(edges), "stars")
    for _ in range(most_rounds):
        unsettled, hot = _state(edges)
        if not unsettled:
            break
        edges = materialize(_meet_below(_meet_around(edges, hot)), "stars")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
