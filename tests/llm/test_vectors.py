import numpy as np
import pytest

from daycast.llm import queries, vectors
from daycast.llm.common import table

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, cls long, n long, unit string, dim int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "u", 3) for i, v in rows], SCHEMA)


def brute(rows, threshold=0.9):
    units = []
    for _, v in rows:
        ok = v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
        units.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    up, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) \
                    and units[a] @ units[b] >= threshold:
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, n[k], least.get(find(k)), i is not None and least.get(find(k)) == i)
                   for k, (i, _) in enumerate(rows)), key=str)


def run(df):
    return sorted((tuple(r) for r in vectors.near_duplicates(df).collect()), key=str)


def clustered(seed, n=260, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, d)) * np.linspace(3, 0.2, d)
    x = centres[rng.integers(0, 9, n)] + rng.normal(size=(n, d)) * rng.uniform(0.05, 0.6, (n, 1))
    x[rng.integers(0, n, 30)] = x[0]
    return [(int(k) * 3 + 1, v.tolist()) for k, v in zip(rng.permutation(n), x)]


@pytest.mark.parametrize("tile,block", [(8192, 1024), (20, 7)])
def test_matches_brute_force(spark, monkeypatch, tile, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = clustered(tile)
    got = vectors.links.__defaults__
    monkeypatch.setattr(vectors.links, "__defaults__", (got[0], tile))
    assert run(frame(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [float("nan"), 1.0, 1.0]),
            (6, [float("inf"), 1.0, 1.0]), (7, e), (8, [2.0, 0.0, 0.0]), (8, e), (None, e), (None, None),
            (9, [1.0, 0.0]), (10, [1e300, 1e300, 0.0]), (11, [1e-300, 1e-300, 0.0]), (12, [-1.0, -0.0, 0.0]),
            (13, [5.0])]
    got = run(frame(spark, rows))
    want = brute([(i, [x / 1e300 for x in v] if i == 10 else [x * 1e300 for x in v] if i == 11 else v)
                  for i, v in rows])
    assert got == want
    assert run(frame(spark, [])) == []


def test_pairs_close_to_the_threshold(spark):
    def at(c):
        return [c, float(np.sqrt(1 - c * c)), 0.0]
    rows = [(1, [1.0, 0.0, 0.0]), (2, at(0.9 + 1e-10)), (3, at(0.9 - 1e-10)), (4, [0.0, 0.0, 1.0])]
    got = {r[0]: r[1] for r in run(frame(spark, rows))}
    assert got == {1: 1, 2: 2, 3: 1, 4: 0}


def test_whole_small_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SMALL, "embeddings").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op9_pca"](spark, SMALL).collect()), key=str)
    assert got == brute(rows)


def test_pruning_loses_nothing():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 40)) * np.linspace(2, 0.1, 40)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = np.ones(300, int)
    n, m, _ = vectors.compare(x, x, t, t, 0.6, True)
    full = (x @ x.T >= 0.6).sum(axis=1) - 1
    assert np.array_equal(n + m, full)
    a, b, _ = vectors.compare(x[:100], x[100:], t[:100], t[100:], 0.6, False)
    assert np.array_equal(a, (x[:100] @ x[100:].T >= 0.6).sum(axis=1))
    assert np.array_equal(b, (x[:100] @ x[100:].T >= 0.6).sum(axis=0))


def test_planted_near_copies_in_a_whole_table(spark):
    """All links of sf0.1's vectors with 900 planted near copies, at small and production tiles."""
    held = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    rng = np.random.default_rng(12)
    rows = list(held)
    for k in range(900):
        v = np.array(held[rng.integers(0, 400)][1], float)
        rows.append((100_000 + k, (v + rng.normal(0, rng.uniform(0.02, 0.09), len(v)) * np.linalg.norm(v)).tolist()))
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    want = {i: int(n) - 1 for (i, _), n in zip(rows, links.sum(axis=1))}
    assert sum(want.values()) > 1000
    got = {r[0]: r for r in run(frame(spark, rows))}
    assert {i: r[1] for i, r in got.items()} == want
    for a, b in zip(*np.nonzero(links)):
        assert got[rows[a][0]][2] == got[rows[b][0]][2]


def test_small_cells_share_a_tile(spark, monkeypatch):
    """No more meetings than tiles of the asked size need, and every pair in one of them."""
    met = []
    plain = vectors.compare
    monkeypatch.setattr(vectors, "_meet", lambda rows, basis, t: met.append(
        rows.select("tile_a", "tile_b", "tile", "cls").collect()) or rows.select(
            "cls", "cls", "cls").toDF("cls", "n", "root").limit(0))
    rng = np.random.default_rng(3)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(400, 16)))]
    classes = vectors._units(frame(spark, rows)).where("dim > 0").select("cls", "dim", "unit").withColumn(
        "times", queries.F.lit(1).cast("long"))
    got = vectors.links.__defaults__
    monkeypatch.setattr(vectors.links, "__defaults__", (got[0], 1000))
    vectors.links(classes).collect()
    assert {(r.tile_a, r.tile_b) for r in met[0]} == {(met[0][0].tile, met[0][0].tile)} and len(met[0]) == 400
    assert plain is vectors.compare
