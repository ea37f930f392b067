"""Benchmark decontamination by template canonicalisation.

A text's words become template tokens: numbers, names (capitalised words that do
not begin a sentence) and units (after a number) turn into typed placeholders
and keep their value as a slot; other words are lowered and lose the punctuation
around them. Windows of ``WINDOW`` tokens of documents and benchmark items are
joined by hash. A window with fewer than ``LEAST_LITERALS`` plain words says too
little as a template; such windows of items, and their first ones, whose first
word may be a name or not by what stands before it, are joined by the words
themselves. Per document and item the shared windows are walked in document
order: a window counts if its slots fit a one-to-one mapping of item values to
document values, so a question with other numbers and names is caught, while a
chance mix of values is not. A window that fits no mapping found so far begins
one of its own, and takes in what fits it of the windows before. Windows lying
within twice the item's length of each other form one passage. A document is
contaminated when a passage covers at least half of an item's words, and
``LEAST_WORDS`` of them (the whole item if it is shorter).

The windows of the benchmark are put into a bitmap of at most ``MOST_BITS`` bits,
which travels to the tasks and lets through all windows of documents that can
join and few others; so its size is bounded whatever the benchmark's.

Cases: null and empty texts hold no windows and are clean; an item of fewer than
``WINDOW`` words is one window of its own length, and documents are also read in
windows of every such length that the benchmark has; null doc_ids are
judged like others; an empty benchmark or table gives no contaminated rows;
repeated items are reported each; repeated rows are judged alike; other columns
pass through untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daycast.llm.common import Cache, arrow_map, bitmap, chain, hash64, signed, texts

WINDOW = 6
LEAST_WORDS = 10
COVER = 0.5
LEAST_LITERALS = 3         # words of a window that are no placeholders
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28

# Unit words that may follow a number.
UNITS = frozenset(
    b"mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram "
    b"kilograms ounce ounces oz pound pounds lb lbs ton tons ml l liter liters litre litres "
    b"gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks "
    b"month months year years usd eur dollar dollars euro euros cent cents percent % degree "
    b"degrees kmh mph km/h m/s hz khz mhz ghz w kw kwh v a j kj cal kcal byte bytes kb mb gb tb".split())

_NUMBER = re.compile(rb"[+-]?[$]?[0-9][0-9.,:/]*%?$")
_EDGE = b".,;:!?\"'()[]{}<>|*#$&-"
VERBATIM = np.uint64(hash64(b"verbatim", 23))
NUM, NAME, UNIT = (np.uint64(hash64(x, 21) >> 4 << 4) for x in (b"num", b"name", b"unit"))
# flags in a token's lowest four bits
F_NUMBER, F_UNIT, F_CAPITAL, F_STOP = 1, 2, 4, 8


def _token(word: bytes) -> int:
    core = word.strip(_EDGE) or word
    low = core.lower()
    flags = F_STOP * (word.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b":"))
    if _NUMBER.match(core):
        flags |= F_NUMBER
    elif low in UNITS:
        flags |= F_UNIT
    head = core[:2].decode("utf-8", "ignore")[:1]
    rest = core[len(head.encode()):]
    if head.isupper() and not rest.isupper():
        flags |= F_CAPITAL
    return (hash64(low, 22) >> 4 << 4) | flags


_TOKENS = Cache(_token)
_FLAGS = np.uint64(15)


def template(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template token hashes, slot kind of each: 0 none, 1 number, 2 name, 3 unit, value hashes)."""
    t = np.fromiter(map(_TOKENS.__getitem__, words), np.uint64, len(words))
    flags, value = (t & _FLAGS).astype(np.int64), t & ~_FLAGS
    number = (flags & F_NUMBER) > 0
    begins = np.ones(len(t), bool)
    begins[1:] = (flags[:-1] & F_STOP) > 0
    after_number = np.zeros(len(t), bool)
    after_number[1:] = number[:-1]
    unit = ((flags & F_UNIT) > 0) & after_number
    name = ((flags & F_CAPITAL) > 0) & ~begins & ~unit
    kind = np.where(number, 1, np.where(unit, 3, np.where(name, 2, 0)))
    token = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, value)))
    return token, kind, value


def windows(token: np.ndarray, kind: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window hashes, which of them hold enough plain words)."""
    if not len(token):
        return token, np.zeros(0, bool)
    w = min(width, len(token))
    h = chain(token[i:len(token) - w + 1 + i] for i in range(w)) + np.uint64(w)
    plain = np.concatenate([[0], np.cumsum(kind == 0)])
    return h, plain[w:] - plain[:-w] >= min(LEAST_LITERALS, w)


def _slots(kind: np.ndarray, value: np.ndarray, at: int, width: int = WINDOW) -> list[int]:
    """Per token of a window: 0 for a plain word, else the value's hash marked with its kind."""
    k = kind[at:at + width]
    return np.where(k > 0, signed(value[at:at + width] | k.astype(np.uint64)), 0).tolist()


def _verbatim(value: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Window hashes of the words themselves, apart from those of templates."""
    return windows(value ^ VERBATIM, np.zeros(len(value), np.int64), width)[0]


def item_windows(benchmark: DataFrame) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("item_id", "at", "h", "slots", "length")}
        for i, t in zip(batch.column("item_id").to_pylist(), texts(batch.column("text"))):
            words = t.split()
            token, kind, value = template(words)
            h, ok = windows(token, kind)
            same = ~ok
            same[:1] = True
            for hashes, chosen in ((h, ok), (_verbatim(value), same)):
                for at in np.flatnonzero(chosen).tolist():
                    for c, v in zip(out, (i, at, signed(hashes[at:at + 1])[0],
                                          _slots(kind, value, at), len(words))):
                        out[c].append(v)
        return out
    return arrow_map(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), rows,
                     "item_id long, at int, h long, slots array<long>, length int")


def document_windows(docs: DataFrame, widths: list[int], allowed) -> DataFrame:
    """(row, at, h, slots) of the allowed windows of ``widths`` tokens; no slots for
    windows of the words themselves, whose values are the item's."""
    def rows(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("row", "at", "h", "slots")}
        for row, t in zip(batch.column("__row").to_pylist(), texts(batch.column("text"))):
            token, kind, value = template(t.split())
            for w in widths:
                if w > len(token):
                    continue
                h, ok = windows(token, kind, w)
                n = len(h)
                both = np.concatenate([h, _verbatim(value, w)])
                hit = allowed(both)
                hit[:n] &= ok
                for k in np.flatnonzero(hit).tolist():
                    at = k if k < n else k - n
                    for c, v in zip(out, (row, at, signed(both[k:k + 1])[0],
                                          _slots(kind, value, at, w) if k < n else None)):
                        out[c].append(v)
        return out
    return arrow_map(docs.select("__row", "text"), rows, "row long, at int, h long, slots array<long>")


class _Passage:
    """Item words covered by windows whose slots fit one mapping of values."""

    def __init__(self):
        self.covered: set[int] = set()
        self.there: dict[int, int] = {}
        self.back: dict[int, int] = {}
        self.last = self.slotted = None      # places of the last window, and the last with slots

    def takes(self, at: int, words: range, pairs: list[tuple[int, int]]) -> bool:
        """Adds a window if its slots fit."""
        there, back = self.there, self.back
        if not all(there.get(a, b) == b and back.get(b, a) == a for a, b in pairs):
            return False
        there.update(pairs)
        back.update((b, a) for a, b in pairs)
        self.covered.update(words)
        self.last = at
        if pairs:
            self.slotted = at
        return True


def passages(hits: list[tuple[int, int, list[int] | None, list[int]]], length: int) -> int:
    """Most item words that one passage of a document covers with consistent slots.

    ``hits``: (place in document, place in item, document slots or None if they are
    the item's, item slots). The oldest mapping lives as long as windows fit it; a
    later one also ends when no window with slots has fit it for the same distance,
    so there are never more than the windows of that distance.
    """
    best = 0
    reach = 2 * length
    seen = []                                 # (at, item words, pairs) of the hits
    first = 0                                 # the first of them within reach
    old: _Passage | None = None
    others: list[_Passage] = []
    for at, item_at, mine, its in sorted(hits, key=lambda x: x[:2]):
        pairs = [(a, b) for a, b in zip(its, its if mine is None else mine) if a or b]
        words = range(item_at, min(item_at + WINDOW, length))
        if old is not None and at - old.last > reach:
            old = None
        others = [p for p in others if at - p.last <= reach and at - p.slotted <= reach]
        if old is None:
            old = _Passage()
        seen.append((at, words, pairs))
        while seen[first][0] < at - reach:
            first += 1
        fits = [p for p in (old, *others) if p.takes(at, words, pairs)]
        if not fits:
            fresh = _Passage()
            for k in range(len(seen) - 1, first - 1, -1):      # the nearest first
                fresh.takes(*seen[k])
            fresh.last = fresh.slotted = at
            others.append(fresh)
            fits = [fresh]
        best = max(best, *(len(p.covered) for p in fits))
        if best >= length:
            break
    return best


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, item_id, words, length): contaminated rows of ``docs`` (a ``__row``
    column names them) with each item found in them."""
    spark = docs.sparkSession
    items = item_windows(benchmark)
    held, test = bitmap(items, F.col("h"), LEAST_BITS, MOST_BITS)
    short = items.where(F.col("length") < WINDOW).select("length").distinct().collect()
    widths = [WINDOW, *sorted(r.length for r in short)]
    sent = spark.sparkContext.broadcast(held)

    def allowed(h: np.ndarray) -> np.ndarray:
        return test(sent.value, h)

    found = document_windows(docs, widths, allowed)
    joined = found.select("row", F.col("at").alias("doc_at"), "h", F.col("slots").alias("mine")).join(items, "h")
    hits = joined.groupBy("row", "item_id", "length").agg(
        F.collect_list(F.struct("doc_at", "at", "mine", F.col("slots").alias("its"))).alias("hits"))

    def judge(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("row", "item_id", "words", "length")}
        for row, item, length, hits in zip(*(batch.column(c).to_pylist() for c in
                                             ("row", "item_id", "length", "hits"))):
            words = passages([(x["doc_at"], x["at"], x["mine"], x["its"]) for x in hits], length)
            if words >= max(min(LEAST_WORDS, length), COVER * length):
                for c, v in zip(out, (row, item, words, length)):
                    out[c].append(v)
        return out
    return arrow_map(hits, judge, "row long, item_id long, words int, length int")


def _rows(docs: DataFrame) -> DataFrame:
    """Rows named by a hash of id and text: equal rows share a name and a fate."""
    return docs.withColumn("__row", F.xxhash64("doc_id", "text"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, item_ids, words) of every row of ``docs``."""
    rows = _rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = contaminations(rows, benchmark).groupBy("row").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("words").alias("words"))
    return (rows.select("doc_id", "__row").join(found, F.col("__row") == F.col("row"), "left")
            .select("doc_id", F.col("words").isNotNull().alias("contaminated"),
                    F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
                    F.coalesce("words", F.lit(0)).alias("words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark passage."""
    rows = _rows(docs)
    bad = contaminations(rows, benchmark).select(F.col("row").alias("__row")).distinct()
    return rows.join(bad, "__row", "left_anti").drop("__row")
