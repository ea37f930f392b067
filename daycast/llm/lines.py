"""Line dedup: deletion-neighbourhood join over the words, or code points, of lines.

A line counts as its words (A-Z lowered). Equal lines, of any number of words, keep
their earliest occurrence by (doc_id, line number); blank lines stay. Lines near an
earlier line go too: lines within one word edit (inserted, deleted or replaced), the
longer of at least ``NEAR_WORDS`` words; and lines of fewer words both, within one
edit of a code point, the longer of at least ``NEAR_CHARS`` code points (words joined
by one space), so that short lines, and paragraphs of scripts that put no spaces
between words, are compared as well.

1. Every line sends four half keys of its units (words or code points): an edit leaves
   the first or the second half as it is, counted from either length, so lines within
   one edit share a key. Only lines sharing one with a different line go on.
2. These emit all variants within the edit bound, the line itself and the line
   without each of its units, as hashed keys. Equal variants meet in a sorted
   stream: equal variants with the same unit left out differ by a replacement,
   a variant equal to a whole line by a deletion. Each meets the earliest of its
   kind only, so a group of any size costs its own size.
3. The edit distance of every such pair is verified on the units themselves.

Cases: null and empty texts have no lines to drop; a line's copies within a text
count as repeats; null ids come last; rows of equal id are one document, whose
equal lines at the same place stay or go together; a very long line is one line;
an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daycast.llm.common import (_BASE, _INVERSE, Words, _powers, arrow_map, claim, cut, lists, mix,
                                only_ids, run_starts, signed, texts)

NEAR_WORDS = 8            # words from which words are edited, below it code points
NEAR_CHARS = 24
LAST_ID = np.iinfo(np.int64).max
_LENGTH, _SIDE = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x632BE59BD9B4E019)


class Sums:
    """Polynomial hashes of runs of units of lines (first unit, number of units)."""

    def __init__(self, h: np.ndarray, first: np.ndarray, n: np.ndarray, salt: int = 0):
        self.first, self.n, self.salt = first, n, np.uint64(salt)
        most = int(n.max(initial=0)) + 2
        self.power, self.inverse = _powers(_BASE, most), _powers(_INVERSE, most)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        terms = np.zeros(len(h), np.uint64)
        at = place + np.repeat(first, n)
        terms[at] = mix(h[at]) * self.power[place]
        self.total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(terms, out=self.total[1:])

    def run(self, line: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words begin..end-1 of each line, as if the run began the line."""
        a = self.first[line]
        return (self.total[a + end] - self.total[a + begin]) * self.inverse[begin]

    def keys(self) -> np.ndarray:
        """Hash of each line."""
        line = np.arange(len(self.n))
        return mix(self.run(line, np.zeros_like(line), self.n) + self.n.astype(np.uint64) * _LENGTH)

    def half_keys(self, line: np.ndarray) -> np.ndarray:
        """Four keys of each line, of which lines within one edit share at least one.

        For the longer length m of a pair: the words before m // 2, and those from
        there on (one place earlier in the shorter line).
        """
        n, zero = self.n[line], np.zeros_like(line)
        out = []
        for shorter in (0, 1):
            m = n + shorter
            for side, (begin, end) in enumerate(((zero, m // 2), (m // 2 - shorter, n))):
                out.append(mix(self.run(line, begin, end) + m.astype(np.uint64) * _LENGTH
                               + np.uint64(side) * _SIDE + self.salt))
        return np.column_stack(out)

    def variants(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, gaps) of each whole line (gap -1) and of it without word 0, 1, ..."""
        n = self.n[line]
        each = np.repeat(line, n + 1)
        gap = np.arange(len(each)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1) - 1
        whole = gap < 0
        left = np.maximum(gap, 0)
        size = self.n[each]
        head = self.run(each, np.zeros_like(each), np.where(whole, size, left))
        # the words after the gap move one place to the front
        after = np.minimum(left + 1, size)
        tail = self.run(each, after, size) * self.power[left]
        value = head + np.where(whole, np.uint64(0), tail)
        return mix(value + (size - ~whole).astype(np.uint64) * _LENGTH + self.salt), gap


_CHARS = 0x5BF03635D5A5F0C3           # salt of the keys of code points


def code_points(words: Words, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every code point, code points per line) of lines of words, one space
    between words."""
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    size = words.ends[word] - words.starts[word] + 1                      # a place for the space
    end = np.cumsum(size)
    at = np.repeat(words.starts[word] - (end - size), size) + np.arange(int(end[-1]))
    raw = words.raw[np.minimum(at, len(words.raw) - 1)]
    raw[end - 1] = 32
    begins = (raw & 0xC0) != 0x80
    begins[end[np.cumsum(n) - 1] - 1] = False                            # no space after the last word
    place = np.flatnonzero(begins)
    value = raw[place].astype(np.uint64)
    more = np.ones(len(place), bool)
    for k in range(1, 4):
        here = np.minimum(place + k, len(raw) - 1)
        more &= (place + k < len(raw)) & ((raw[here] & 0xC0) == 0x80)
        value |= np.where(more, raw[here].astype(np.uint64) << np.uint64(8 * k), np.uint64(0))
    line_end = end[np.cumsum(n) - 1]
    counts = np.diff(np.searchsorted(place, line_end), prepend=0)
    return mix(value + np.uint64(0x3C6EF372)), counts


class Lines:
    """Lines with words of a column of texts: document, number, first word, words.

    ``near`` holds, for words and for code points, the lines that may be within one edit
    of another and the hashes of their units."""

    def __init__(self, column):
        words = Words(column)
        self.words = words
        doc = np.repeat(np.arange(len(words.counts)), words.counts)
        breaks = np.flatnonzero(words.raw == 10)
        before = np.searchsorted(breaks, words.offsets)       # line breaks before each text
        line = np.searchsorted(breaks, words.starts) - before[doc]
        self.breaks = np.diff(before)
        self.first = run_starts(doc * (int(line.max(initial=0)) + 1) + line)
        self.n = np.diff(np.append(self.first, len(doc)))
        self.doc, self.line = doc[self.first], line[self.first]
        self.key = Sums(words.hash, self.first, self.n).keys()

    def near(self) -> list[tuple[np.ndarray, Sums]]:
        # the shorter line of a pair has one unit less
        wordy = np.flatnonzero(self.n >= NEAR_WORDS - 1)
        few = np.flatnonzero(self.n < NEAR_WORDS)
        h, n = code_points(self.words, self.first[few], self.n[few])
        long_ = n >= NEAR_CHARS - 1
        return [(wordy, Sums(self.words.hash, self.first[wordy], self.n[wordy])),
                (few[long_], Sums(h, (np.cumsum(n) - n)[long_], n[long_], _CHARS))]


def _one(h: np.ndarray) -> Sums:
    return Sums(h, np.zeros(1, np.int64), np.array([len(h)]))


def half_keys(h: np.ndarray) -> np.ndarray:
    """The half keys of one line of word hashes."""
    return _one(h).half_keys(np.zeros(1, np.int64))[0]


def variants(h: np.ndarray) -> np.ndarray:
    """The variants of one line of word hashes: whole, without word 0, 1, ..."""
    return _one(h).variants(np.zeros(1, np.int64))[0]


def within_one_edit(a, b) -> bool:
    """Two sequences (words, or a text's code points) differ by one unit at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1:] or (len(a) == len(b) and a[i + 1:] == b[i + 1:])


def near_lines(a: bytes, b: bytes) -> bool:
    """Two lines (lowered, one space between words) are within the edit bound."""
    v, w = a.split(), b.split()
    if max(len(v), len(w)) >= NEAR_WORDS:
        return within_one_edit(v, w)
    s, t = (x.decode("utf-8", "surrogateescape") for x in (a, b))
    return max(len(s), len(t)) >= NEAR_CHARS and within_one_edit(s, t)


def occurrences(docs: DataFrame) -> DataFrame:
    """(h, doc_id, line, keys) of every line that may be dropped."""
    def rows(batch: pa.RecordBatch) -> dict:
        got = Lines(batch.column("text"))
        ids = batch.column("doc_id").fill_null(LAST_ID).to_numpy()
        kinds = got.near()
        which = np.concatenate([np.repeat(line, 4) for line, _ in kinds])
        keys = np.concatenate([s.half_keys(np.arange(len(line))).ravel() for line, s in kinds])
        order = np.argsort(which, kind="stable")
        return {"h": signed(got.key), "doc_id": ids[got.doc], "line": got.line.astype(np.int32),
                "keys": lists(signed(keys[order]), np.bincount(which, minlength=len(got.n)))}
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows,
                     "h long, doc_id long, line int, keys array<long>")


def _sharing(keys: DataFrame) -> DataFrame:
    """(h) of lines that share a key with a different line; (key, h) streamed in order."""
    def run(batches):
        key = first = None
        for b in batches:
            if not b.num_rows:
                continue
            k, h = b.column("key").to_numpy(), b.column("h").to_numpy()
            fresh = np.ones(len(k), bool)
            fresh[1:] = k[1:] != k[:-1]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0))
            low = h[begin]
            if key is not None and k[0] == key:
                low[begin == 0] = first
            key, first = k[-1], low[-1]
            other = h != low
            if other.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.unique(np.concatenate([h[other], low[other]])))], names=["h"])
    return (keys.repartition("key").sortWithinPartitions("key", "h")
            .mapInArrow(run, "h long").distinct())


def _meetings(rows: DataFrame) -> DataFrame:
    """(loser, winner): lines of equal variants, the later and the earliest of its kind.

    ``rows`` is (variant, gap, doc_id, line, h), gap -1 for the whole line; in
    order, a variant's whole line comes first, then each gap with its earliest.
    """
    def run(batches):
        whole = None                       # (variant, doc_id, line, h) of the last whole line
        head = None                        # (variant, gap, h) of the last run of a gap
        for b in batches:
            if not b.num_rows:
                continue
            v, g, d, k, h = (b.column(c).to_numpy() for c in ("variant", "gap", "doc_id", "line", "h"))
            n, at = len(v), np.arange(len(v))
            # the whole line of each row's variant, if there is one
            w = np.maximum.accumulate(np.where(g < 0, at, -1))
            same = (w >= 0) & (v[w] == v)
            wd, wk, wh = (np.where(same, x[w], 0) for x in (d, k, h))
            if whole is not None:
                carried = ~same & (v == whole[0])
                wd, wk, wh = (np.where(carried, x, y) for x, y in zip(whole[1:], (wd, wk, wh)))
                same |= carried
            other = same & (g >= 0) & (h != wh)
            later = (wd < d) | ((wd == d) & (wk < k))
            # the earliest of each gap of a variant
            fresh = np.ones(n, bool)
            fresh[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
            first = np.maximum.accumulate(np.where(fresh, at, 0))
            hh = h[first]
            if head is not None and (v[0], g[0]) == head[:2]:
                hh[first == 0] = head[2]
            behind = (g >= 0) & (h != hh)
            beats = np.flatnonzero(other & ~later)
            losers = np.concatenate([h[other & later], h[behind], wh[beats]])
            winners = np.concatenate([wh[other & later], hh[behind], h[beats]])
            if w[-1] >= 0:
                whole = (v[w[-1]], d[w[-1]], k[w[-1]], h[w[-1]])
            head = (v[-1], g[-1], hh[-1])
            if len(losers):
                pair = np.unique(np.column_stack([losers, winners]), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["loser", "winner"])
    return (rows.repartition("variant").sortWithinPartitions("variant", "gap", "doc_id", "line")
            .mapInArrow(run, "loser long, winner long").distinct())


def _emit(near: DataFrame) -> DataFrame:
    """All variants of (h, doc_id, line, words)."""
    def rows(batch: pa.RecordBatch) -> dict:
        got = Lines(batch.column("words"))
        parts: dict[str, list] = {c: [] for c in ("doc_id", "line", "h", "variant", "gap")}
        for line, sums in got.near():
            hashes, gap = sums.variants(np.arange(len(line)))
            each = np.repeat(got.doc[line], sums.n + 1)
            for c in ("doc_id", "line", "h"):
                parts[c].append(batch.column(c).to_numpy()[each])
            parts["variant"].append(signed(hashes))
            parts["gap"].append(gap.astype(np.int32))
        return {c: np.concatenate(v) for c, v in parts.items()}
    return arrow_map(near, rows, "variant long, gap int, doc_id long, line int, h long")


def _line_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(h, doc_id, line, words) of wanted first occurrences (h, doc_id, line)."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), "text")
    places = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line", "h")).alias("places"))
    held = places.join(only_ids(keyed, wanted), "doc_id")

    def rows(batch: pa.RecordBatch) -> dict:
        got = Lines(batch.column("text"))
        at = found(got, batch.column("places"))
        data = got.words.raw.tobytes()
        begin = got.words.starts[got.first[at]]
        end = got.words.ends[got.first[at] + got.n[at] - 1]
        return {"h": signed(got.key[at]), "doc_id": batch.column("doc_id").to_numpy()[got.doc[at]],
                "line": got.line[at].astype(np.int32),
                "words": pa.array([b" ".join(data[a:b].split()) for a, b in
                                   zip(begin.tolist(), end.tolist())], pa.binary())}
    return arrow_map(held, rows, "h long, doc_id long, line int, words string")


def found(got: Lines, places: pa.Array) -> np.ndarray:
    """Places in ``got`` of the listed lines (line, h) of each text that are there."""
    if isinstance(places, pa.ChunkedArray):
        places = places.combine_chunks()
    flat = places.flatten()
    n = np.array([0 if x is None else x for x in pa.compute.list_value_length(places).to_pylist()], np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    line, h = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("line", "h"))
    code = got.doc * (1 << 32) + got.line
    want = doc * (1 << 32) + line
    if not len(code) or not len(want):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(code, want), len(code) - 1)
    ok = (code[at] == want) & (signed(got.key[at]) == h)
    return np.unique(at[ok])


def _verified(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """(h) of losers whose edit distance to their winner is at most one unit."""
    words = near.select("h", "words").dropDuplicates(["h"])
    both = (pairs.join(words.select(F.col("h").alias("loser"), F.col("words").alias("a")), "loser")
            .join(words.select(F.col("h").alias("winner"), F.col("words").alias("b")), "winner"))

    def rows(batch: pa.RecordBatch) -> dict:
        ok = [near_lines(a, b) for a, b in zip(texts(batch.column("a")), texts(batch.column("b")))]
        return {"h": batch.column("loser").filter(pa.array(ok, pa.bool_()))}
    return arrow_map(both, rows, "h long").distinct()


def dropped(docs: DataFrame) -> DataFrame:
    """(doc_id, places): of every document with lines to drop, (line, h) of these lines."""
    seen = cut(occurrences(docs))
    first = seen.groupBy("h").agg(F.min(F.struct("doc_id", "line")).alias("at"),
                                  F.first("keys").alias("keys"))
    kinds = cut(first.select("h", F.col("at.doc_id").alias("doc_id"), F.col("at.line").alias("line"),
                             "keys"))
    sharing = _sharing(kinds.select("h", F.explode("keys").alias("key")))
    near = cut(_line_texts(cut(kinds.drop("keys").join(sharing, "h")), docs))
    losers = _verified(_meetings(_emit(near)), near).withColumn("loses", F.lit(True))
    fate = (kinds.select("h", F.col("doc_id").alias("d0"), F.col("line").alias("l0"))
            .join(losers, "h", "left"))
    gone = (seen.select("h", "doc_id", "line").join(fate, "h")
            .where("loses is not null or doc_id <> d0 or line <> l0"))
    return gone.groupBy("doc_id").agg(F.collect_list(F.struct("line", "h")).alias("places"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``, and the columns
    ``__lines``, ``__dropped`` and ``__left`` (words left)."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    gone = dropped(docs).select(F.col("doc_id").alias("__key"), F.col("places").alias("__places"))
    joined = docs.withColumn("__key", key).join(gone, "__key", "left").drop("__key")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.IntegerType())
                                                  for c in ("__lines", "__dropped", "__left"))])
    names = docs.columns
    at = names.index("text")

    def run(batches):
        claim(__name__)
        for b in batches:
            got = Lines(b.column("text"))
            gone = found(got, b.column("__places"))
            out: dict[int, set] = {}
            for d, k in zip(got.doc[gone].tolist(), got.line[gone].tolist()):
                out.setdefault(d, set()).add(k)
            body = b.column("text")
            if out:
                raw = body.cast(pa.binary()).to_pylist()
                for d, lines_gone in out.items():
                    raw[d] = b"\n".join([x for i, x in enumerate(raw[d].split(b"\n")) if i not in lines_gone])
                body = pa.array(raw, pa.binary()).cast(body.type)
            length = len(got.words.counts)
            filled = np.diff(got.words.offsets) > 0
            left = got.words.counts - np.bincount(got.doc[gone], got.n[gone], length).astype(np.int64)
            columns = [b.column(c) for c in names]
            columns[at] = body
            counts = ((got.breaks + 1) * filled, np.bincount(got.doc[gone], minlength=length), left)
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(x.astype(np.int32)) for x in counts],
                names=[*names, "__lines", "__dropped", "__left"])
    return joined.select(*names, "__places").mapInArrow(run, schema)
