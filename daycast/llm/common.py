"""Shared pieces of the text operators: session set-up, inputs, word hashes.

Words follow one rule everywhere: the text's UTF-8 bytes with A-Z lowered,
split on runs of the bytes 0x20 and 0x09-0x0D (``bytes.split``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daycast.session import checkpoint_dir, ship_package

# Size of one Arrow batch handed to a Python worker: rows, and bytes (long texts).
ARROW_ROWS, ARROW_BYTES = 65_536, 2 << 20
# Entries of a worker's word cache (about 40 MB); further words are recomputed.
CACHE_WORDS = 200_000


def prepare(spark: SparkSession) -> None:
    """Package on the workers, checkpoint folder set, small Arrow batches."""
    ship_package(spark)
    checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to a new folder of the shared checkpoint folder, and read back.

    Cuts the lineage like ``checkpoint()``; as Parquet, so that each later use reads only
    the columns it needs."""
    folder = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fold(col: str, mod: int):
    """crc32 of the id's text modulo ``mod`` (null ids: null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def most_frequent(counts: DataFrame, key: str, n: str, rows: int):
    """pandas frame (key, n), most frequent first: all keys whose count reaches a
    level (an eighth of a power of two) such that at most ``rows`` do.

    A histogram of levels (a few hundred rows) finds the level, so no more than
    ``rows`` keys reach the driver, however many partitions hold them.
    """
    counts = cut(counts.select(key, n))
    level = F.floor(F.log2(F.col(n)) * 8)
    sizes = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > rows:
            break
        least = r.level
    kept = counts.where(level >= least) if least is not None else counts.limit(0)
    return kept.toPandas().sort_values([n, key], ascending=[False, True], ignore_index=True)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def foldable(batch_texts: list[bytes]) -> np.ndarray:
    """Texts whose A-Z may be lowered without changing a lowering vocabulary's ids:
    no combining mark (U+0300-U+036F, lead bytes CC and CD) that could compose with
    the letter, no mark of a special token."""
    return np.array([not (b"\xcc" in t or b"\xcd" in t or b"<|" in t) for t in batch_texts], bool)


def hash64(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(data, seed)


_KEPT: list = []                   # what a worker keeps from task to task
_OWNER = [""]


def keep(store):
    """Register a dict that a worker keeps for one operator at a time."""
    _KEPT.append(store)
    return store


def claim(owner: str) -> None:
    """Workers serve one operator after the other: another one's caches are let go."""
    if _OWNER[0] != owner:
        for store in _KEPT:
            store.clear()
        _OWNER[0] = owner
        pa.default_memory_pool().release_unused()


class Cache(dict):
    """word -> f(word), remembering the first ``limit`` distinct words."""

    def __init__(self, f, limit: int = CACHE_WORDS):
        super().__init__()
        self.f, self.limit = f, limit
        keep(self)

    def __missing__(self, word):
        value = self.f(word)
        if len(self) < self.limit:
            self[word] = value
        return value


# Fixed tables of the word hash: a random value per byte, a random odd base.
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[44, 46]] = True
_LETTER[65:91] = _LETTER[97:123] = True
_POWERS: dict[int, np.ndarray] = {}
_SPAN = 1 << 15


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... (mod 2**64), at least n of them."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(1 << 16, 1 << max(0, n - 1).bit_length())
        held = np.ones(size, np.uint64)
        held[1:] = np.cumprod(np.full(size - 1, base, np.uint64))
        if size <= 1 << 23:
            _POWERS[base] = held
    return held


class Words:
    """Words of many texts at once: places and 64-bit hashes, text after text.

    ``lower``: True lowers A-Z; a boolean array says so per text. ``marks``: a full
    stop or comma that ends a word after an ASCII letter is a word of its own.
    """

    def __init__(self, column: pa.Array | list[bytes], lower=True, marks: bool = False):
        if isinstance(column, list):
            column = pa.array(column, pa.binary())
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) \
            if offsets is not None and len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None \
            else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        if lower is True:
            self.raw = _LOWER[raw]
        elif lower is False or not len(lower):
            self.raw = raw
        else:
            self.raw = np.where(np.repeat(lower, np.diff(self.offsets)), _LOWER[raw], raw)
        inside = ~_SPACE[self.raw]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        heads = self.offsets[:-1][np.diff(self.offsets) > 0]
        begin[heads] |= inside[heads]                    # a text's first byte begins a word
        last = inside.copy()
        last[:-1] &= ~inside[1:] | begin[1:]
        if marks:
            at = np.flatnonzero(last & ~begin)
            at = at[_MARK[self.raw[at]] & _LETTER[self.raw[at - 1]]]
            begin[at] = last[at - 1] = True
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.counts = np.diff(np.searchsorted(self.starts, self.offsets))
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Polynomial hashes from running sums, in spans that stay in the cache."""
        out = np.empty(len(self.starts), np.uint64)
        g = 0
        while g < len(out):
            lo = int(self.starts[g])
            end = max(g + 1, int(np.searchsorted(self.starts, lo + _SPAN)))
            hi = int(self.ends[end - 1])
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTES[self.raw[lo:hi]] * _powers(_BASE, hi - lo)[:hi - lo], out=total[1:])
            a, b = self.starts[g:end] - lo, self.ends[g:end] - lo
            out[g:end] = mix((total[b] - total[a]) * _powers(_INVERSE, hi - lo)[a]
                             + (b - a).astype(np.uint64) * _M1)
            g = end
        return out

    def bytes_of(self, which: np.ndarray) -> list[bytes]:
        data = self.raw.tobytes()
        return [data[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist())]

    def per_text(self, values: np.ndarray) -> list[np.ndarray]:
        """``values`` (one per word) cut into the texts' runs."""
        at = np.concatenate([[0], np.cumsum(self.counts)]).tolist()
        return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of every word of the A-Z-lowered text."""
    return Words([text]).hash


class Numbers:
    """Numbers 0, 1, ... for 64-bit hashes in order of arrival (open addressing)."""

    def __init__(self):
        self._size(1 << 16)
        self.count = 0

    def _size(self, size: int) -> None:
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int64)

    def _probe(self, h: np.ndarray, step: int) -> np.ndarray:
        return ((((h * _M1) >> self.shift).astype(np.int64)) + step) & (len(self.keys) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 if it has none."""
        out = np.full(len(h), -1, np.int64)
        open_, step = None, 0
        while open_ is None or len(open_):
            want = h if open_ is None else h[open_]
            slot = self._probe(want, step)
            value, same = self.values[slot], self.keys[slot] == want
            if open_ is None:
                out = np.where(same, value, -1)
                open_ = np.flatnonzero(~same & (value >= 0))
            else:
                out[open_[same]] = value[same]
                open_ = open_[~same & (value >= 0)]
            step += 1
        return out

    def add(self, h: np.ndarray) -> None:
        """Number new distinct hashes."""
        if 2 * (self.count + len(h)) > len(self.keys):
            held, values = self.keys[self.values >= 0], self.values[self.values >= 0]
            self._size(1 << (4 * (self.count + len(h))).bit_length())
            self._put(held, values)
        self._put(h, np.arange(self.count, self.count + len(h)))
        self.count += len(h)

    def _put(self, h: np.ndarray, values: np.ndarray) -> None:
        left, step = np.arange(len(h)), 0
        while len(left):
            slot = self._probe(h[left], step)
            free = np.flatnonzero(self.values[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = h[left[put]], values[left[put]]
            left = np.delete(left, put)
            step += 1


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def chain(parts: Iterable[np.ndarray]) -> np.ndarray:
    """Order-dependent hash of equally long arrays, position by position."""
    out = None
    for p in parts:
        out = mix(p + _M1) if out is None else mix(out * _M1 + p)
    return out


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width``-word windows; a shorter text is one window."""
    if len(h) == 0:
        return h
    w = min(width, len(h))
    return chain(h[i:len(h) - w + 1 + i] for i in range(w))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def arrow_map(df: DataFrame, rows, schema: str) -> DataFrame:
    """``mapInArrow`` of a function of one record batch to columns.

    ``rows(batch)`` returns a dict of columns in the order of ``schema``, or
    None for no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    out = to_arrow_schema(_parse_datatype_string(schema))

    owner = rows.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        for batch in batches:
            got = rows(batch) if batch.num_rows else None
            if got is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[f.name], f.type) if not isinstance(got[f.name], pa.Array)
                     else got[f.name].cast(f.type) for f in out], schema=out)
    return df.mapInArrow(run, schema)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of consecutive batches, cut so that no run of equal keys is parted.

    For rows sorted by the key whose runs are bounded."""
    held: dict[str, np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        got = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
        if held is not None:
            got = {n: np.concatenate([held[n], v]) for n, v in got.items()}
        k = got[key]
        other = np.flatnonzero(k != k[-1])
        cut_at = other[-1] + 1 if len(other) else 0
        if cut_at:
            yield {n: v[:cut_at] for n, v in got.items()}
        held = {n: v[cut_at:] for n, v in got.items()}
    if held is not None:
        yield held


def run_starts(k: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(k), bool)
    fresh[1:] = k[1:] != k[:-1]
    return np.flatnonzero(fresh)


def bitmap(rows: DataFrame, h, least_bits: int = 1 << 20, most_bits: int = 1 << 28):
    """Bitmap of 64-bit hashes, and a numpy test for it.

    About 64 bits per row within the bounds, so its size is bounded; beyond that
    the test lets more through, and a join behind it stays exact. Returns
    (array, test) with test(array, hashes).
    """
    n = rows.count()
    bits = min(most_bits, max(least_bits, 1 << max(1, 64 * n).bit_length()))
    shift = 64 - (bits.bit_length() - 1)
    place = F.shiftrightunsigned(h, shift)
    got = rows.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)

    def test(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(shift)
        return (held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out.view(np.uint64), test


def only_ids(docs: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) of the rows of ``docs`` with a wanted key, and of few others: a
    bitmap of bounded size keeps most other texts out of a later join's shuffle."""
    held, test = bitmap(wanted, F.xxhash64(key))
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            yield b.select([key, "text"]).filter(pa.array(test(sent.value, h)))
    return (docs.select(F.col(key).cast("long").alias(key), "text").where(f"{key} is not null")
            .withColumn("h", F.xxhash64(key)).mapInArrow(run, f"{key} long, text string"))


def lists(values: np.ndarray, lengths) -> pa.Array:
    """Arrow list column of consecutive runs of ``values``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
