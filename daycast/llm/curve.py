"""Packing along a space-filling curve.

Every text is encoded once by the tokenizers library, and its distinct ids are hashed
into a signed vector of ``BUCKETS`` places, projected to ``DIMS`` coordinates by a
fixed random matrix and divided by the root of their number. Ids, counts and
coordinates are written. Means and deviations of the coordinates over all documents
(one small aggregate) spread them evenly over a grid of 2 ** ``BITS`` cells an axis,
and the cell's place on the Hilbert curve is the document's key: documents of alike
words lie near each other on it. Documents are range-partitioned and sorted by (key,
doc_id, hash of the ids), so that copies, which share a key, are split as well, and
written again with the ids before each in its partition. The sums of the partitions,
one number each, then give every document's place in the stream of all ids, which is
cut at every ``SIZE`` ids. The places, and so the sequences, depend on the order
alone, not on the partitions. What is left at the very end is cut into powers of two,
the largest first, so that no sequence needs padding.

Cases: null and empty texts are the end id alone, in the middle of the grid, as are
texts whose ids have no coordinates; rows of a null id come first in their cell; rows
of one id are documents each; a document may begin and end in any sequence, and a very
long one fills many; an empty table has no pieces; other columns are neither read nor
returned.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daycast.llm.common import arrow_map, mix, stored
from daycast.llm.tokenfile import END_ID, worker_encoder

SIZE = 4096               # ids of a sequence
DIMS = 4
BITS = 12                 # a key has DIMS * BITS bits
BUCKETS = 4096            # places of the hashed vector
SEED = 11
PART_IDS = 1 << 23        # ids of a partition of the sorted stream, about
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
_AXES = [f"x{k}" for k in range(DIMS)]


def directions(ids: np.ndarray) -> np.ndarray:
    """What each id adds to the projected vector: its bucket's row of the matrix, signed."""
    matrix = np.random.default_rng(SEED).normal(size=(BUCKETS, DIMS))
    h = mix(ids.astype(np.uint64) + np.uint64(SEED))
    sign = np.where((h >> np.uint64(63)).astype(bool), 1.0, -1.0)
    return matrix[(h % np.uint64(BUCKETS)).astype(np.int64)] * sign[:, None]


def coordinates(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Texts x DIMS from the ids of many texts in a row; not a number without ids."""
    text = np.repeat(np.arange(len(counts)), counts)
    pairs = np.unique((text.astype(np.int64) << 32) | ids)
    text, ids = pairs >> 32, pairs & 0xFFFFFFFF
    distinct, at = np.unique(ids, return_inverse=True)
    rows = directions(distinct)[at]
    n = np.bincount(text, minlength=len(counts))
    out = np.column_stack([np.bincount(text, rows[:, k], len(counts)) for k in range(DIMS)])
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.sqrt(n)[:, None]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of non-negative cell numbers below 2 ** bits
    (Skilling, "Programming the Hilbert curve", 2004)."""
    x = [c.astype(np.int64) for c in cells.T]
    for b in range(bits - 1, 0, -1):             # undo the turns of the finer cells
        low = (1 << b) - 1
        for i in range(len(x)):
            inside = (x[i] >> b) & 1 == 1
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(inside, low, swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):                   # Gray code
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ turn) >> b) & 1)
    return key


def grid(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Cells of coordinates: about as many documents in each slice of an axis."""
    z = np.where(spread > 0, (x - mean) / np.where(spread > 0, spread, 1.0), 0.0)
    z = np.nan_to_num(np.clip(z, -8, 8), nan=0.0)
    return np.minimum((1 / (1 + np.exp(-1.702 * z)) * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n, x0.., ids binary): ids of 16 bits if all of a batch's fit, else 32."""
    def rows(batch: pa.RecordBatch) -> dict:
        ids, counts = worker_encoder(path)(batch.column("text"))
        x = coordinates(ids, counts)
        last = np.cumsum(counts)
        ids = np.insert(ids, last, end_id)
        counts = counts + 1
        kind = "<u2" if int(ids.max()) < 1 << 16 else "<u4"
        raw, width = ids.astype(kind).tobytes(), int(kind[-1])
        ends = np.cumsum(counts) * width
        parts = [raw[a:b] for a, b in zip((ends - counts * width).tolist(), ends.tolist())]
        return {"doc_id": batch.column("doc_id"), "n": counts, "ids": pa.array(parts, pa.binary())} | {
            c: x[:, k] for k, c in enumerate(_AXES)}
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows,
                     "doc_id long, n long, " + "".join(f"{c} double, " for c in _AXES) + "ids binary")


def keyed(rows: DataFrame) -> tuple[DataFrame, int]:
    """``encoded`` rows with their place on the curve, and how many partitions their ids ask for."""
    fine = [F.when(~F.isnan(c), F.col(c)) for c in _AXES]
    got = rows.agg(*[F.avg(c) for c in fine], *[F.stddev_pop(c) for c in fine], F.sum("n")).first()
    mean, spread = (np.array([v or 0.0 for v in got[k:k + DIMS]]) for k in (0, DIMS))

    def place(batch: pa.RecordBatch) -> dict:
        x = np.column_stack([batch.column(c).to_numpy() for c in _AXES])
        return {c: batch.column(c) for c in ("doc_id", "n", "ids")} | {"key": hilbert(grid(x, mean, spread), BITS)}
    return arrow_map(rows, place, "doc_id long, n long, ids binary, key long"), max(1, -(-(got[-1] or 0) // PART_IDS))


def along_curve(rows: DataFrame, parts: int) -> DataFrame:
    """(part, at, doc_id, n, ids): documents in order, with the ids before each in its partition."""
    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n").to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), *(b.column(c) for c in ("doc_id", "n", "ids"))],
                names=["part", "at", "doc_id", "n", "ids"])
            at = int(ends[-1]) if len(ends) else at
    order = [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("tie")]
    return (rows.withColumn("tie", F.xxhash64("ids")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .select("doc_id", "n", "ids").mapInArrow(run, "part int, at long, doc_id long, n long, ids binary"))


def cuts(total: int, size: int) -> tuple[int, np.ndarray]:
    """(full sequences, first ids of the sequences after them): powers of two."""
    full, rest = divmod(total, size)
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return full, full * size + np.cumsum([0, *powers])[:len(powers)]


def pieces_of(start: int, n: int, size: int, full: int, tail: np.ndarray) -> list[tuple[int, int, int]]:
    """(place in the stream, sequence, offset) of the pieces of ``n`` ids from ``start``."""
    end, at, out = start + n, start, []
    while at < end:
        if at < full * size:
            out.append((at, at // size, at % size))
            at = (at // size + 1) * size
        else:
            k = int(np.searchsorted(tail, at, "right")) - 1
            out.append((at, full + k, at - int(tail[k])))
            at = int(tail[k + 1]) if k + 1 < len(tail) else end
    return out


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of
    every piece; ids are little-endian uint32."""
    spark: SparkSession = docs.sparkSession
    rows = stored(along_curve(*keyed(stored(encoded(docs, path, end_id), "encoded"))), "ordered")
    # one row per partition
    totals = rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    first, total = {}, 0
    for r in totals:
        first[r.part] = total
        total += r.n
    full, tail = cuts(total, size)
    sent = spark.sparkContext.broadcast(first)

    def cut_up(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        parts: list[bytes] = []
        for part, at, doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "doc_id", "n", "ids"))):
            data = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
            begin = sent.value[part] + at
            got = pieces_of(begin, n, size, full, tail)
            ends = [p[0] for p in got[1:]] + [begin + n]
            for (place, sequence, offset), end in zip(got, ends):
                ids = data[4 * (place - begin):4 * (end - begin)]
                for k, v in zip(out, (doc, place - begin, end - place, zlib.crc32(ids), n, sequence, offset)):
                    out[k].append(v)
                if with_ids:
                    parts.append(ids)
        return out | ({"ids": pa.array(parts, pa.binary())} if with_ids else {})

    return arrow_map(rows, cut_up, PIECES + (", ids binary" if with_ids else ""))
