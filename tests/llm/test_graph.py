import random

import numpy as np
import pytest

from daycast.llm import graph


def brute(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("small", [0, graph.SMALL])
def test_components_of_random_chains_and_stars(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)]
    edges += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    edges += edges[:20]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges + [(None, 3), (7, 7)], "a long, b long").repartition(5)
    got = {r.id: r.component for r in graph.components(df).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert got == want


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_keeps_components():
    a, b = np.array([5, 9, 2, 7]), np.array([9, 2, 2, 8])
    u, v = graph.forest(a, b)
    assert dict(zip(u.tolist(), v.tolist())) == {5: 2, 9: 2, 8: 7}
