import math

import numpy as np
import pytest

from daycast.llm import negatives, queries
from daycast.plans.check import compare, duckdb_conn
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, dim int, number long, part int, score long, rank int"
ANCHOR = "vec_id % 3 = 0"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA)


def run(df, **kw):
    return sorted(tuple(r) for r in negatives.mine(df, F.expr(ANCHOR), **kw).collect())


def brute(rows, k=5, low=80, high=100):
    good = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None \
                and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for i, a, label in good:
        if i % 3:
            continue
        scores = [(-sum(p * q for p, q in zip(a, v)), j, same == label)
                  for j, v, same in good if j != i and len(v) == len(a)]
        for s, j, _ in sorted(x for x in scores if x[2])[:k]:
            fits = sorted(x for x in scores if not x[2] and low * -s <= 100 * -x[0] <= high * -s)[:k]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def random_rows(seed, n=150, d=7, labels=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(-4, 5, (n, d)) / 16 + rng.normal(0, 0.01, (n, d)) * rng.integers(0, 2, (n, 1))
    x[rng.integers(0, n, n // 3)] = x[0]                     # many equal vectors: ties
    return [(int(i), v.tolist(), int(l)) for i, v, l in zip(rng.permutation(n), x, rng.integers(0, labels, n))]


@pytest.mark.parametrize("tile,depth,anchors", [(8192, 64, 32_768), (40, 2, 7), (9, 1, 32_768)])
def test_matches_brute_force(spark, monkeypatch, tile, depth, anchors):
    monkeypatch.setattr(negatives, "DEPTH", depth)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives.tiles, "__defaults__", (tile,))
    rows = random_rows(tile)
    assert run(frame(spark, rows)) == brute(rows)


def test_other_windows(spark):
    rows = random_rows(4, n=90)
    assert run(frame(spark, rows), positives=3, negatives=3, low=50, high=150) == brute(rows, 3, 50, 150)


def test_odd_rows(spark):
    one = [1.0, 0.0]
    rows = [(0, one, 1), (1, [0.9, 0.1], 1), (2, [0.85, 0.5], 2), (3, None, 1), (4, [], 1), (6, [], 1), (5, [], 2),
            (9, [0.0, 0.0], 1), (7, [None, 1.0], 2), (8, [float("nan"), 1.0], 2), (10, [float("inf"), 1.0], 2),
            (11, one, None), (None, one, 2), (12, [0.8], 1), (15, [0.9], 1), (13, [0.7], 2), (14, [0.85, 0.5], 2),
            (14, [0.85, 0.5], 2), (16, [0.9, 0.1], 1), (18, [-1.0, 0.0], 2), (20, [-0.5, 0.0], 2), (21, [-0.9, 0.0], 1),
            (23, [1e300, float("nan")], 1), (22, [7e5, 0.0], 3), (24, [7e5, 1.0], 3), (25, [6e5, 0.0], 4), (2, [0.85, 0.5], 2)]
    assert run(frame(spark, rows)) == brute(rows)
    assert run(frame(spark, [])) == []
    assert run(frame(spark, [(1, one, 1), (2, one, 2)])) == []
    with pytest.raises(Exception, match="vec_id 7: scores would not fit 64 bits"):
        run(frame(spark, rows[:2] + [(7, [1e300, 1.0], 1)]))


def test_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(0, 0.1, (4000, 4))).astype(np.int64)
    labels = rng.integers(0, 2, 4000)
    tile = negatives.Tile({"n": 4000, "dim": 4, "wide": False, "ids": np.arange(4000).tobytes(),
                           "labels": labels.tobytes(), "vectors": x.astype("<i4").tobytes(),
                           "orders": np.argsort(x, axis=0, kind="stable").T.astype("<u2").tobytes()})
    block = {"id": np.array([0]), "label": labels[:1], "v": x[:1], "most": 256,
             "lo": np.full((1, 1), negatives._NO), "hi": np.full((1, 1), 1 << 60)}
    best = negatives.Best(1, 1, 5)
    assert negatives.search_tile(tile, block, False, best) < 1500
    order = sorted((-int(x[0] @ x[j]), j) for j in range(4000) if labels[j] != labels[0])[:5]
    assert [(-int(s), int(i)) for s, i in zip(best.score[0, 0], best.id[0, 0])] == order


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_whole_table_matches_sql(spark, folder):
    got = compare(queries.QUERIES["op13_negatives"](spark, folder), duckdb_conn(folder),
                  queries.SQL["op13_negatives"])
    assert got["ok"] and got["spark_rows"] > 0, got
