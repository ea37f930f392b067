"""Connected components of an edge table, by alternating star contractions.

First every batch of edges is reduced to a forest. A graph of at most ``SMALL``
edges (counted, so the task's memory is bounded) is finished by one union-find in
one task; beyond that, every round shrinks the graph in two grouped minima with
map-side combining (large star, then small star); a vertex with very many
neighbours is a plain equi-join key there, which adaptive execution splits. Rounds
are cut in the shared checkpoint folder. Nothing but counts reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daycast.llm.common import cut


SMALL = 1_000_000


class UnionFind:
    """Disjoint sets over 0..n-1; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        return np.fromiter(map(self.find, range(len(self.up))), np.int64, len(self.up))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component), for all vertices but the smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    uf = UnionFind(len(ids))
    for x, y in zip(at[:len(a)].tolist(), at[len(a):].tolist()):
        uf.join(x, y)
    roots = uf.roots()
    keep = roots != np.arange(len(ids))
    return ids[keep], ids[roots[keep]]


def _contract(edges: DataFrame, whole: bool = False) -> DataFrame:
    """Forests of the batches, or of a task's whole share: fewer edges, same components."""
    def run(batches):
        if whole:
            held = [b for b in batches if b.num_rows]
            batches = [pa.Table.from_batches(held).combine_chunks().to_batches()[0]] if held else []
        for b in batches:
            u, v = forest(b.column("u").to_numpy(), b.column("v").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
    return edges.mapInArrow(run, "u long, v long")


def _named(e: DataFrame) -> DataFrame:
    return (e.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest vertex reachable, for every vertex of an edge.

    Nulls and loops are ignored; repeated edges count once.
    """
    e = (edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
         .where("u is not null and v is not null and u <> v"))
    e = cut(_contract(e))
    if e.count() <= SMALL:
        return _named(cut(_contract(e.coalesce(1), whole=True)))
    e = cut(e.distinct())
    state = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state is not None and tuple(now) == state:
            break
        state = tuple(now)
    return _named(e)
