"""Hard negatives by Fagin's threshold algorithm.

Vectors become integers, floor(scale * x), so scores are exact inner products. Rows are
range-partitioned by (length, label, hash of the id) and cut into tiles of at most
``TILE`` rows; a tile holds its vectors and, for every dimension, the order of its rows
by that component. Tiles are built once and written to the checkpoint folder.

Anchors are taken in blocks of ``ANCHORS``, the only vectors that are broadcast. A task
takes its tiles one after the other. For an anchor it reads the tile's lists in step,
the largest components first where the anchor's is positive, the smallest first where
it is negative (lists of a zero component say nothing and are left out); rows met for
the first time are scored by their whole vectors; the sum of anchor component times
list value at the depth read bounds every row not met yet. The anchor is done with the
tile once that bound is strictly below the k-th best score of each of its windows (a
row with the same score and a smaller id could still come), or below a window's lower
end while it holds fewer. What a task found in earlier tiles counts. The best k of every
task are merged by Spark.

A first search, for rows of the anchor's label and one window without ends, gives the
positives; their scores set the windows of the second, for rows of other labels.

Cases: rows with a null id or label, a null vector, or a null or non-finite component
take no part; vectors of different lengths have no score with each other, and those
without components score 0; a row is no partner of a row with its own id; repeated
rows are rows each, as candidates and as anchors; ties go to the smaller id; a positive
below zero has an empty window; components whose scores might not fit 64 bits raise by
name; empty tables give empty results; other columns are neither read nor returned.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daycast.llm.common import arrow_map, claim, cut, stored
from daycast.session import checkpoint_dir

TILE = 8192                 # rows of a tile; below 65,536
ANCHORS = 32_768            # anchors of a block, the most that is broadcast at once
TASK_ROWS = 512             # a task is worth this many rows, while there are idle cores
DEPTH = 64                  # entries read of every list at first; then twice as many
SCALE = 256
POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100         # a negative's score in hundredths of the positive's
_NO = np.iinfo(np.int64).min
_TILE = "dim int, n int, wide boolean, ids binary, labels binary, vectors binary, orders binary"
FOUND = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
         "negative_score long")


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, dim, v binary of int64) of the rows that take part."""
    def convert(batch: pa.RecordBatch) -> dict | None:
        keep = np.ones(batch.num_rows, bool)
        for c in ("vec_id", "label", "embedding"):
            keep &= np.asarray(batch.column(c).is_valid())
        batch = batch.filter(pa.array(keep))
        if not batch.num_rows:
            return None
        col = batch.column("embedding")
        dim = col.value_lengths().to_numpy().astype(np.int64)
        x = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)     # null: not a number
        bad = np.bincount(np.repeat(np.arange(len(dim)), dim)[~np.isfinite(x)], minlength=len(dim))
        with np.errstate(over="ignore"):
            v = np.floor(np.where(np.isfinite(x), x, 0.0) * float(scale))
        # |score| <= dim * max ** 2, and a window's ends are 100 times a score
        limit = np.repeat(np.sqrt(2.0 ** 56 / np.maximum(dim, 1)), dim)
        large = np.flatnonzero(~(np.abs(v) <= limit) & np.repeat(bad == 0, dim))
        if len(large):
            at = np.repeat(np.arange(len(dim)), dim)[large[0]]
            raise ValueError(f"vec_id {batch.column('vec_id')[int(at)]}: scores would not fit 64 bits")
        raw = v.astype("<i8").tobytes()
        ends = np.cumsum(dim) * 8
        parts = [raw[a:b] for a, b in zip((ends - dim * 8).tolist(), ends.tolist())]
        good = pa.array(bad == 0)
        out = {"vec_id": batch.column("vec_id"), "label": batch.column("label"),
               "dim": pa.array(dim, pa.int32()), "v": pa.array(parts, pa.binary())}
        return {k: c.filter(good) for k, c in out.items()}
    return arrow_map(rows.select(F.col("vec_id").cast("long").alias("vec_id"),
                                 F.col("label").cast("long").alias("label"), "embedding"),
                     convert, "vec_id long, label long, dim int, v binary")


def tiles(rows: DataFrame, n: int, tile: int = TILE) -> DataFrame:
    """One row per tile of ``rows`` (of which there are ``n``), from ``integers``."""
    def build(batches):
        def packed(ids, labels, v, dim) -> pa.RecordBatch:
            x = np.frombuffer(b"".join(v), "<i8").reshape(len(ids), dim)
            wide = bool(len(ids) and dim and np.abs(x).max() >= 1 << 31)
            orders = np.argsort(x, axis=0, kind="stable").T.astype("<u2")
            row = [dim, len(ids), wide, np.array(ids, "<i8").tobytes(), np.array(labels, "<i8").tobytes(),
                   x.astype("<i8" if wide else "<i4").tobytes(), orders.tobytes()]
            kinds = (pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds)],
                                              names=["dim", "n", "wide", "ids", "labels", "vectors", "orders"])
        held, ids, labels, v = None, [], [], []
        for b in batches:
            for i, label, dim, raw in zip(*(b.column(c).to_pylist() for c in ("vec_id", "label", "dim", "v"))):
                if ids and (dim != held or len(ids) == tile):
                    yield packed(ids, labels, v, held)
                    ids, labels, v = [], [], []
                held = dim
                ids.append(i)
                labels.append(label)
                v.append(raw)
        if ids:
            yield packed(ids, labels, v, held)

    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // tile), min(cores, -(-n // TASK_ROWS)))
    order = ["dim", "label", "deal", "vec_id"]
    return stored(rows.withColumn("deal", F.xxhash64("vec_id", "v")).repartitionByRange(parts, *order)
               .sortWithinPartitions(*order).select("vec_id", "label", "dim", "v").mapInArrow(build, _TILE), "tiles")


class Tile:
    """Rows of a tile with their lists."""

    def __init__(self, row: dict):
        n, d = row["n"], row["dim"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.labels = np.frombuffer(row["labels"], "<i8")
        x = np.frombuffer(row["vectors"], "<i8" if row["wide"] else "<i4").reshape(n, d)
        # products and sums of doubles are exact below 2 ** 53; larger ones stay integers
        exact = not row["wide"]
        self.x = x.astype(np.float64 if exact else np.int64)
        self.most = int(np.abs(x).max()) if x.size else 0
        self.orders = np.frombuffer(row["orders"], "<u2").reshape(d, n)
        self.sorted = np.take_along_axis(self.x.T, self.orders.astype(np.int64), axis=1)
        self._others: dict[tuple, np.ndarray] = {}

    def eligible(self, label: int, same: bool) -> np.ndarray:
        key = (label, same)
        if key not in self._others:
            self._others[key] = (self.labels == label) == same
        return self._others[key]


class Best:
    """The k best (score, id) of every window of every anchor: higher scores, then smaller ids."""

    def __init__(self, anchors: int, windows: int, k: int):
        self.k = k
        self.score = np.full((anchors, windows, k), _NO, np.int64)
        self.id = np.zeros((anchors, windows, k), np.int64)
        self.held = np.zeros((anchors, windows), np.int64)

    def add(self, a: int, w: int, scores: np.ndarray, ids: np.ndarray) -> None:
        h = self.held[a, w]
        if h == self.k:
            on = scores >= self.score[a, w, -1]
            scores, ids = scores[on], ids[on]
        if not len(scores):
            return
        if len(scores) > 4 * self.k:                # all that tie with the k-th stay
            on = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[on], ids[on]
        s, i = np.concatenate([self.score[a, w, :h], scores]), np.concatenate([self.id[a, w, :h], ids])
        first = np.lexsort((i, -s))[:self.k]
        self.score[a, w, :len(first)], self.id[a, w, :len(first)] = s[first], i[first]
        self.held[a, w] = len(first)


def search_tile(tile: Tile, block: dict, same: bool, best: Best) -> int:
    """Bring ``best`` up to date with one tile for all anchors of a block; returns how
    many rows were scored."""
    x, n = tile.x, len(tile.ids)
    if n * x.shape[1] and block["most"] * tile.most * x.shape[1] >= 1 << 53:
        x = x.astype(np.int64)
    scored = 0
    for a, (vector, own, label) in enumerate(zip(block["v"], block["id"].tolist(), block["label"].tolist())):
        lo, hi = block["lo"][a], block["hi"][a]
        open_ = np.flatnonzero(lo <= hi)
        right = tile.eligible(label, same)
        if not len(open_) or not right.any():
            continue
        unseen = right & (tile.ids != own)
        vector = vector.astype(x.dtype)
        up, down = np.flatnonzero(vector > 0), np.flatnonzero(vector < 0)
        depth, step = 0, DEPTH
        while True:
            end = min(n, depth + step)
            if len(up) + len(down) == 0:
                end, new = n, np.flatnonzero(unseen)
            else:                                    # sorted access, by the anchor's signs
                met = np.zeros(n, bool)
                met[tile.orders[up, n - end:n - depth]] = True
                met[tile.orders[down, depth:end]] = True
                new = np.flatnonzero(met & unseen)
            if len(new):                             # random access
                unseen[new] = False
                scored += len(new)
                scores = ((x @ vector)[new] if 2 * len(new) > n else x[new] @ vector).astype(np.int64)
                for w in open_.tolist():
                    on = (scores >= lo[w]) & (scores <= hi[w])
                    if on.any():
                        best.add(a, w, scores[on], tile.ids[new[on]])
            if end == n:
                break
            bound = int(vector[up] @ tile.sorted[up, n - end].astype(x.dtype)
                        + vector[down] @ tile.sorted[down, end - 1].astype(x.dtype))
            kth = np.where(best.held[a, open_] == best.k, best.score[a, open_, -1], lo[open_])
            open_ = open_[bound >= kth]
            if not len(open_):
                break
            depth, step = end, 2 * step
    return scored


def _search(held: DataFrame, blocks: dict, windows: int, k: int, same: bool) -> DataFrame:
    """(dim, anchor, window, score, id): the best k of every task."""
    sent = held.sparkSession.sparkContext.broadcast(blocks)
    names = ["dim", "anchor", "win", "score", "id"]

    def run(batches):
        claim(__name__)
        best: dict[int, Best] = {}
        for b in batches:
            for row in b.to_pylist():
                block = sent.value.get(row["dim"])
                if block is None:
                    continue
                if row["dim"] not in best:
                    best[row["dim"]] = Best(len(block["id"]), windows, k)
                search_tile(Tile(row), block, same, best[row["dim"]])
        for dim, found in best.items():
            a, w, r = np.nonzero(np.arange(k) < found.held[..., None])
            cols = [np.full(len(a), dim), a, w, found.score[a, w, r], found.id[a, w, r]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=names)
    return held.mapInArrow(run, "dim long, anchor long, win long, score long, id long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best k of all tasks, with their rank."""
    from pyspark.sql import Window
    w = Window.partitionBy("dim", "anchor", "win").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block(pdf, positives=None, low: int = LOW, high: int = HIGH) -> dict:
    """Anchors of one length as arrays; windows from the positives, or one without ends."""
    out = {"id": pdf["vec_id"].to_numpy(np.int64), "label": pdf["label"].to_numpy(np.int64),
           "v": np.frombuffer(b"".join(pdf["v"]), "<i8").reshape(len(pdf), -1)}
    out["most"] = int(np.abs(out["v"]).max()) if out["v"].size else 0
    if positives is None:
        out["lo"] = np.full((len(pdf), 1), _NO)
        out["hi"] = np.full((len(pdf), 1), np.iinfo(np.int64).max)
        return out
    count = int(positives["rank"].max()) if len(positives) else 0
    a, r = positives["anchor"].to_numpy(), positives["rank"].to_numpy() - 1
    score = positives["score"].to_numpy(np.int64)
    out["lo"], out["hi"] = np.ones((len(pdf), count), np.int64), np.zeros((len(pdf), count), np.int64)
    out["lo"][a, r], out["hi"][a, r] = -((-low * score) // 100), (high * score) // 100
    out["positive"], out["score"] = np.zeros_like(out["lo"]), np.zeros_like(out["lo"])
    out["positive"][a, r], out["score"][a, r] = positives["id"], score
    return out


def _numbered(anchors: DataFrame) -> tuple[DataFrame, int]:
    """Anchors (written already) with a number from 0, and how many there are."""
    spark = anchors.sparkSession
    rows = anchors.withColumns({"part": F.spark_partition_id(), "at": F.expr(
        "monotonically_increasing_id() & 8589934591")})          # place within the partition
    sizes = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}
    starts, n = [], 0
    for part in sorted(sizes):
        starts.append((part, n))
        n += sizes[part]
    if not n:
        return rows.withColumn("number", F.col("at")), 0
    first = spark.createDataFrame(starts, "part int, first long")
    return rows.join(F.broadcast(first), "part").withColumn("number", F.col("first") + F.col("at")), n


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, label and embedding; ``is_anchor`` is a condition on vec_id and
    label. A block of anchors is one search of all tiles for positives and one for
    negatives; its result is written before the next one begins.
    """
    spark = rows.sparkSession
    folder = f"{checkpoint_dir(spark)}/negatives-{uuid.uuid4().hex}"
    numbers = stored(integers(rows, scale), "integers")
    anchors, n = _numbered(cut(numbers.where(is_anchor)))
    if not n:
        return spark.createDataFrame([], FOUND)
    held = tiles(numbers, numbers.count())
    for start in range(0, n, ANCHORS):
        mine_ = anchors.where(F.col("number").between(start, start + ANCHORS - 1)) \
            .select("dim", "number", "vec_id", "label", "v").toPandas().sort_values("number")
        parts = {int(d): p.reset_index(drop=True) for d, p in mine_.groupby("dim")}
        found = _first(_search(held, {d: _block(p) for d, p in parts.items()}, 1, positives, True),
                       positives).toPandas()
        blocks = {d: _block(p, found[found["dim"] == d], low, high) for d, p in parts.items()}
        got = _first(_search(held, blocks, positives, negatives, False), negatives)
        named = spark.sparkContext.broadcast({d: (b["id"], b["positive"], b["score"])
                                              for d, b in blocks.items()})

        def names(batch: pa.RecordBatch, named=named) -> dict:
            dim, a, w, rank, score, i = (batch.column(c).to_numpy() for c in
                                         ("dim", "anchor", "win", "rank", "score", "id"))
            out = {c: np.zeros(len(a), np.int64) for c in ("anchor_id", "positive_id", "positive_score")}
            for d in np.unique(dim).tolist():
                on = dim == d
                ids, positive, points = named.value[d]
                out["anchor_id"][on] = ids[a[on]]
                out["positive_id"][on], out["positive_score"][on] = positive[a[on], w[on]], points[a[on], w[on]]
            return out | {"rank": rank, "negative_id": i, "negative_score": score}
        arrow_map(got.select("dim", "anchor", "win", "rank", "score", "id"), names, FOUND) \
            .write.mode("append").parquet(folder)
    return spark.read.schema(FOUND).parquet(folder)


# The same over the whole table, for rows of finite components (DuckDB).
SQL = f"""WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
         CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM valid a JOIN valid r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id AND len(a.v) = len(r.v)),
positives AS (
  SELECT * FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}"""
