"""Embedding near-dedup: PCA-ordered tiled comparison.

Vectors are scaled to length 1 in double precision; equal ones become one class
with a count. The second-moment matrix of all classes, added up by Spark, gives
an orthogonal basis with the strongest directions first; turning into it changes
no cosine. Classes are dealt to cells of the leading coordinates (two vectors
with cosine >= t differ by at most sqrt(2 - 2t) in each, so only neighbouring
cells can link), large cells into tiles of about ``TILE`` classes, and small cells
share a tile. Tiles of
the same or neighbouring cells meet in one task: it takes both in blocks, adds up
the products of the leading coordinates first, bounds the rest of the product by
the product of the suffix norms, and stops where the cosine cannot reach the
threshold; the next coordinates are added for the pairs that are left. A task
returns counts of links per class and a spanning forest, never its pairs.

Cases: null or zero vectors, and those with null or non-finite components, link
with nothing; vectors of different lengths link with nothing of another length;
equal vectors link with each other; null vec_ids keep their row, count as links,
and are in the component of their vector, but name none; without links a vector
is its own component; repeated rows count like others; an empty table gives an
empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daycast.llm.common import arrow_map, cut, hash64, signed
from daycast.llm.graph import UnionFind, components

THRESHOLD = 0.9
TILE = 16384              # classes of a tile
BLOCK = 1024              # rows of a block of the comparison
STEP = 16                 # coordinates added at a time
CELL_AXES = 3             # leading coordinates that make the cells
_SLACK = 1e-9             # pairs this close to the threshold are decided on the vectors as given


def unit_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors scaled to length 1, None where a vector links with nothing."""
    out: list[np.ndarray | None] = []
    for v in column.to_pylist():
        got = None
        if v is not None and len(v) and None not in v:
            x = np.asarray(v, np.float64)
            most = np.abs(x).max()
            if np.isfinite(x).all() and most > 0:
                x = x / most
                got = x / np.sqrt(x @ x) + 0.0
        out.append(got)
    return out


def _units(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, cls, unit binary) of every row; dim 0 links with nothing."""
    def rows(batch: pa.RecordBatch) -> dict:
        got = unit_rows(batch.column("embedding"))
        raw = [None if x is None else x.tobytes() for x in got]
        return {"vec_id": batch.column("vec_id"), "dim": [0 if x is None else len(x) for x in got],
                "cls": signed(np.fromiter((0 if r is None else hash64(r) for r in raw),
                                          np.uint64, len(raw))), "unit": raw}
    return arrow_map(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), rows,
                     "vec_id long, dim int, cls long, unit binary")


def bases(classes: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length, the orthogonal basis (columns) by falling second moment."""
    def moments(batch: pa.RecordBatch) -> dict:
        dims = batch.column("dim").to_numpy()
        out: dict = {"dim": [], "at": [], "m": []}
        for d in np.unique(dims).tolist():
            raw = batch.column("unit").filter(pa.array(dims == d)).to_pylist()
            x = np.frombuffer(b"".join(raw)).reshape(-1, d)
            m = (x.T @ x).ravel()
            out["dim"].append(np.full(len(m), d))
            out["at"].append(np.arange(len(m)))
            out["m"].append(m)
        return {k: np.concatenate(v) for k, v in out.items()}

    got = (arrow_map(classes.select("dim", "unit"), moments, "dim int, at long, m double")
           .groupBy("dim", "at").agg(F.sum("m").alias("m")).toPandas())
    out = {}
    for d, part in got.groupby("dim"):
        m = np.zeros(d * d)
        m[part["at"].to_numpy()] = part["m"].to_numpy()
        values, vectors = np.linalg.eigh(m.reshape(d, d))
        out[int(d)] = np.ascontiguousarray(vectors[:, np.argsort(-values, kind="stable")])
    return out


def _cells(classes: DataFrame, basis: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Classes with their cell of the leading coordinates."""
    width = float(np.sqrt(2 - 2 * threshold)) * (1 + 1e-9)
    sent = classes.sparkSession.sparkContext.broadcast(
        {d: b[:, :CELL_AXES] for d, b in basis.items()})

    def rows(batch: pa.RecordBatch) -> dict:
        cell = np.zeros((batch.num_rows, CELL_AXES), np.int32)
        for k, (d, u) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("unit").to_pylist())):
            c = np.floor(np.frombuffer(u) @ sent.value[d] / width)
            cell[k, :len(c)] = c
        return {n: batch.column(n) for n in ("cls", "dim", "unit", "times")} | {
            f"c{k}": cell[:, k] for k in range(CELL_AXES)}
    return arrow_map(classes.select("cls", "dim", "unit", "times"), rows,
                     "cls long, dim int, unit binary, times long, c0 int, c1 int, c2 int")


def compare(x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray, threshold: float,
            same: bool, gx: np.ndarray | None = None, gy: np.ndarray | None = None):
    """Counts of links of the rows of x and of y, and a forest of these links.

    x and y are in the turned basis, gx and gy as given. ``tx`` and ``ty`` are
    what a link to a row counts. With ``same``, y is x and each pair counts once.
    """
    gx, gy = (x if gx is None else gx), (y if gy is None else gy)
    d = x.shape[1]
    stops = list(range(STEP, d, STEP)) + [d]
    suffix = [[np.sqrt(np.maximum((v[:, s:] ** 2).sum(axis=1), 0)) for s in stops] for v in (x, y)]
    nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    uf = UnionFind(len(x) + (0 if same else len(y)))
    shift = 0 if same else len(x)
    for a in range(0, len(x), BLOCK):
        for b in range(a if same else 0, len(y), BLOCK):
            xa, yb = x[a:a + BLOCK], y[b:b + BLOCK]
            dots = xa[:, :stops[0]] @ yb[:, :stops[0]].T
            i, j = np.nonzero(dots + np.outer(suffix[0][0][a:a + BLOCK], suffix[1][0][b:b + BLOCK])
                              >= threshold - _SLACK)
            if same and a == b:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            if len(i) * 8 > dots.size:                     # many are left: whole products
                part = (xa @ yb.T)[i, j]
            else:
                part = dots[i, j]
                for k in range(1, len(stops)):
                    s, e = stops[k - 1], stops[k]
                    part = part + np.einsum("ij,ij->i", xa[i, s:e], yb[j, s:e])
                    left = part + suffix[0][k][a + i] * suffix[1][k][b + j] >= threshold - _SLACK
                    i, j, part = i[left], j[left], part[left]
                    if not len(i):
                        break
            close = np.abs(part - threshold) <= _SLACK
            if close.any():
                part[close] = np.einsum("ij,ij->i", gx[a + i[close]], gy[b + j[close]])
            i, j = a + i[part >= threshold], b + j[part >= threshold]
            nx += np.bincount(i, ty[j], len(x)).astype(np.int64)
            ny += np.bincount(j, tx[i], len(y)).astype(np.int64)
            i, j = i, shift + j
            while len(i):                                   # join by stars until none is apart
                for u, v in ((i, j), (j, i)):
                    _, first = np.unique(u, return_index=True)
                    for p, q in zip(u[first].tolist(), v[first].tolist()):
                        uf.join(p, q)
                roots = uf.roots()
                apart = roots[i] != roots[j]
                i, j = i[apart], j[apart]
    return nx, ny, uf.roots()


def _meet(rows: DataFrame, basis: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(cls, n, root) of every linked class of each meeting of two tiles."""
    sent = rows.sparkSession.sparkContext.broadcast(basis)
    keys = ["dim", "tile_a", "tile_b"]

    def run(batches):
        held, got = None, []

        def done() -> pa.RecordBatch:
            side = np.array([g[0] for g in got])
            cls = np.array([g[1] for g in got], np.int64)
            times = np.array([g[2] for g in got], np.int64)
            given = np.frombuffer(b"".join(g[3] for g in got)).reshape(len(got), -1)
            turned = given @ sent.value[held[0]]
            order = np.lexsort((turned[:, 0], side))        # by the first coordinate
            side, cls, times, given, turned = (v[order] for v in (side, cls, times, given, turned))
            a, b = side == 0, side == 1
            same = held[1] == held[2]
            if same:
                n, m, roots = compare(turned, turned, times, times, threshold, True, given, given)
                n, names = n + m, cls
            else:
                n, m, roots = compare(turned[a], turned[b], times[a], times[b], threshold, False,
                                      given[a], given[b])
                n, names = np.concatenate([n, m]), np.concatenate([cls[a], cls[b]])
            on = n > 0
            return pa.RecordBatch.from_arrays(
                [pa.array(v[on]) for v in (names, n, names[roots])], names=["cls", "n", "root"])

        for batch in batches:
            where = zip(*(batch.column(k).to_pylist() for k in keys))
            for k, row in zip(where, zip(*(batch.column(c).to_pylist() for c in
                                           ("side", "cls", "times", "unit")))):
                if k != held and got:
                    yield done()
                    got = []
                held = k
                got.append(row)
        if got:
            yield done()
    return (rows.select(*keys, "side", "cls", "times", "unit").repartition(*keys)
            .sortWithinPartitions(*keys).mapInArrow(run, "cls long, n long, root long"))


def links(classes: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(cls, n, root): link counts and forest edges of classes (cls, dim, unit, times)."""
    basis = bases(classes)
    cells = cut(_cells(classes, basis, threshold))
    axes = [f"c{k}" for k in range(CELL_AXES)]
    sizes = cells.groupBy("dim", *axes).agg(F.count("*").alias("size"))
    # a large cell is dealt to tiles of its own, small ones share a tile with those that
    # follow (there are at most a few hundred cells of a length)
    small = F.col("size") <= tile
    before = F.sum(F.when(small, F.col("size")).otherwise(0)).over(
        Window.partitionBy("dim").orderBy(*axes).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("shared", F.when(small, F.floor(F.coalesce(before, F.lit(0)) / F.lit(tile))))
    deal = F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / tile))
    tiled = (cells.join(sizes, ["dim", *axes])
             .withColumn("tile", F.when(small, F.xxhash64(F.lit("shared"), "dim", "shared"))
                         .otherwise(F.xxhash64("dim", *axes, deal))))
    tiles = cut(tiled.select("dim", *axes, "tile").distinct())
    half = [o for o in itertools.product((-1, 0, 1), repeat=CELL_AXES) if o >= (0,) * CELL_AXES]
    step = F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in half])).alias("o")
    reach = tiles.select("dim", *axes, F.col("tile").alias("one"), step).select(
        "dim", "one", *[(F.col(c) + F.col("o")[k]).alias(c) for k, c in enumerate(axes)])
    pairs = cut(reach.join(tiles.withColumnRenamed("tile", "other"), ["dim", *axes])
                .select("dim", F.least("one", "other").alias("tile_a"), F.greatest("one", "other").alias("tile_b"))
                .distinct())
    sides = [pairs.select("dim", F.col(t).alias("tile"), "tile_a", "tile_b", F.lit(s).alias("side"))
             for s, t in enumerate(("tile_a", "tile_b"))]
    both = sides[0].unionByName(sides[1].where("tile_a <> tile_b"))
    return _meet(tiled.select("dim", "tile", "cls", "times", "unit").join(both, ["dim", "tile"]),
                 basis, threshold)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``."""
    rows = cut(_units(vectors))
    good = rows.where("dim > 0")
    classes = cut(good.groupBy("dim", "cls").agg(F.first("unit").alias("unit"),
                                                 F.count("*").alias("times")))
    met = cut(links(classes, threshold))
    number = met.groupBy("cls").agg(F.sum("n").alias("others"))
    part = components(met.where("cls <> root"), "cls", "root").withColumnRenamed("id", "cls")
    known = (classes.select("cls", "times").join(number, "cls", "left").join(part, "cls", "left")
             .select("cls", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "cls").alias("part")))
    named = good.select("vec_id", "cls").join(known, "cls")
    least = named.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    linked = named.join(least, "part").select("vec_id", "n_links", "component_id")
    alone = rows.where("dim = 0").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
