import random

import numpy as np
import pytest

from ridgeline.llm import components as C


def plain(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {x: find(x) for pair in links for x in pair}


def graphs():
    rng = random.Random(3)
    chain = list(range(400))
    rng.shuffle(chain)
    random_ones = [(rng.randrange(-500, 500), rng.randrange(-500, 500)) for _ in range(420)]
    return {"chain": list(zip(chain, chain[1:])), "star": [(700, k) for k in range(600)], "random": random_ones, "pair": [(5, 4)]}


@pytest.mark.parametrize("name", graphs())
def test_a_task_finds_the_components_of_its_links(name):
    links = graphs()[name]
    u, v = (np.array(x, np.int64) for x in zip(*links))
    node, low = C.lowest_in_reach(u, v)
    want = plain(links)
    assert dict(zip(node.tolist(), low.tolist())) == {x: c for x, c in want.items() if x != c}


@pytest.mark.parametrize("spread", ["4", "64"])
def test_components_over_tasks(spark, spread):
    """A chain over many tasks takes several rounds; a node with 600 links and one link below has its links dealt to parts."""
    links = [(a + shift, b + shift) for shift, part in zip((0, 10_000, 20_000, 30_000), graphs().values()) for a, b in part]
    links += [(50_000, 60_000 + k) for k in range(600)] + [(49_000, 50_000), (49_000, 48_000), (60_001, 47_000)]
    rows = [*links, *links[:50], *((b, a) for a, b in links[:50]), (77_777, 77_777), (None, 3), (3, None)]
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", spread)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in C.components(spark.createDataFrame(rows, "a long, b long")).collect()]
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert len(got) == len(dict(got)) and dict(got) == plain([(a, b) for a, b in links if a != b])


def test_hot_nodes_are_found_and_dealt(spark):
    edges = spark.createDataFrame([(k + 10, 5) for k in range(300)] + [(5, 1), (2000, 2)], "u long, v long")
    unsettled, hot = C._state(edges)
    assert unsettled == 1 and hot == [5]
    around = C._meet_around(edges, hot).distinct().collect()
    assert {tuple(r) for r in around} == {(k + 10, 1) for k in range(300)} | {(5, 1), (2000, 2)}


def test_no_links(spark):
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
