"""N-gram Jaccard join with signature trees.

Two texts link when 100 * |A n B| >= 80 * |A u B| for their sets of distinct
5-word shingles (64-bit hashes; a shorter text is one shingle). Steps:

1. Equal sets form a class. Every class posts its shingles with a hash below
   ``SHARE`` of all (and further ones in order, up to its prefix length, if these
   are fewer). In a stream sorted by shingle, each learns in how many classes it
   occurs. Ordered by this count (the rest after them by hash), the first n -
   ceil(0.8 n) + 1 shingles of a class are its prefix: linked classes share a
   shingle of both prefixes (prefix filter). Shingles of one class only cannot be
   shared, so a class with enough of them is done; passages that many texts
   share come last and rarely count.
2. Classes sharing a prefix shingle fall into one block (a star per shingle,
   streamed from a sorted shuffle, then connected components).
3. Blocks are dealt into chunks of bounded weight by size class and hash. In a
   chunk, a signature tree over the classes (leaves ordered by size, nodes
   holding OR-combined bitmaps of their shingles and ranges of sizes) is
   traversed against itself: a pair of nodes is dropped when the most its
   members can overlap is too little. Surviving leaf pairs are verified on
   whole sets. Pairs already joined by links are skipped, as only the
   components are asked for. For blocks of several chunks, the smallest class
   of every chunk's component meets the others first, then all pairs of chunks
   of neighbouring size classes that are not yet one component are traversed
   tree against tree.
4. Links are joined to components; the smallest doc_id names each.

Cases: null, empty or word-less texts have an empty set, link with nothing and
are their own component; a null id keeps its row, and its text is linked only if
its set occurs under another id too; repeated rows give repeated rows; a very long text
is one set; empty tables give an empty result; other columns are neither read
nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daycast.llm.common import (Words, arrow_map, cut, only_ids, run_starts, shingles, signed,
                                whole_runs)
from daycast.llm.graph import UnionFind, components

WIDTH = 5                 # words of a shingle
PERCENT = 80              # least similarity
SHARE = 0.28              # of all hash values: shingles whose classes are counted
MOST_COUNT = 500          # counts beyond are alike, so a stream holds no more rows
CHUNK_WEIGHT = 1_500_000  # shingles of one chunk (a class weighs 500 at least)
LEAST_WEIGHT = 500
FAN_OUT = 8


def sets(batch_texts: list[bytes] | pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (bytes, or an Arrow column)."""
    words = Words(batch_texts)
    return [np.unique(shingles(h, width)) for h in words.per_text(words.hash)]


def need(n, percent: int = PERCENT):
    """Least overlap of a set of n shingles with any set it links to."""
    return -(-n * percent // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Tree:
    """Signature tree over shingle sets; ``order`` maps leaves to the given sets."""

    def __init__(self, members: list[np.ndarray], labels: np.ndarray, bits: int):
        n = np.fromiter(map(len, members), np.int64, len(members))
        low = np.fromiter((int(m[0]) if len(m) else 0 for m in members), np.uint64, len(members))
        self.order = np.lexsort((low, n))
        self.sets = [members[i] for i in self.order]
        self.n, self.labels = n[self.order], labels[self.order]
        flags = np.zeros((len(members), bits), bool)
        shift = np.uint64(64 - bits.bit_length() + 1)
        for i, m in enumerate(self.sets):
            flags[i, (m >> shift).astype(np.int64)] = True
        maps = np.packbits(flags, axis=1).view(np.uint64)
        slack = self.n - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, self.n, self.n, slack, self.labels)]
        while len(self.levels[-1][0]) > 1:
            maps, small, large, slack, lab = self.levels[-1]
            at = np.arange(0, len(maps), FAN_OUT)
            same = np.where(np.minimum.reduceat(lab, at) == np.maximum.reduceat(lab, at),
                            np.minimum.reduceat(lab, at), -1)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0),
                                np.minimum.reduceat(small, at), np.maximum.reduceat(large, at),
                                np.maximum.reduceat(slack, at), same))


def bits_for(members: list[np.ndarray]) -> int:
    """Bitmap width: about four bits per shingle of the largest set, within limits."""
    most = max(map(len, members), default=1)
    return 1 << min(13, max(8, (4 * most - 1).bit_length()))


def _possible(x: Tree, y: Tree, level: int, i: np.ndarray, j: np.ndarray,
              percent: int) -> np.ndarray:
    """Which node pairs may hold a linked pair not yet in one component."""
    bx, nx, mx, sx, lx = x.levels[min(level, len(x.levels) - 1)]
    by, ny, my, sy, ly = y.levels[min(level, len(y.levels) - 1)]
    out = ~((lx[i] == ly[j]) & (lx[i] >= 0))
    out &= (100 * mx[i] >= percent * ny[j]) & (100 * my[j] >= percent * nx[i])
    i, j, at = i[out], j[out], np.flatnonzero(out)
    for s in range(0, len(i), 20_000):
        a, b = i[s:s + 20_000], j[s:s + 20_000]
        common = np.bitwise_count(bx[a] & by[b]).sum(axis=1).astype(np.int64)
        most = np.minimum(np.minimum(sx[a], sy[b]) + common, np.minimum(mx[a], my[b]))
        # J >= t needs an overlap of t / (1 + t) of the sum, and of t of the larger set
        fits = (most * (100 + percent) >= percent * (nx[a] + ny[b])) \
            & (100 * most >= percent * np.maximum(nx[a], ny[b]))
        out[at[s:s + 20_000][~fits]] = False
    return out


def traverse(x: Tree, y: Tree, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs that survive the dual traversal (each once if x is y)."""
    level = max(len(x.levels), len(y.levels)) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        ok = _possible(x, y, level, i, j, percent)
        i, j = i[ok], j[ok]
        if level == 0 or not len(i):
            break
        level -= 1
        step = [len(t.levels) - 1 > level for t in (x, y)]
        parts = []
        for s in range(0, len(i), 50_000):
            a, b = i[s:s + 50_000], j[s:s + 50_000]
            ka = np.arange(FAN_OUT) if step[0] else np.zeros(1, np.int64)
            kb = np.arange(FAN_OUT) if step[1] else np.zeros(1, np.int64)
            ca = (a * (FAN_OUT if step[0] else 1))[:, None, None] + ka[None, :, None]
            cb = (b * (FAN_OUT if step[1] else 1))[:, None, None] + kb[None, None, :]
            ca, cb = (np.broadcast_to(v, (len(a), len(ka), len(kb))).ravel() for v in (ca, cb))
            inside = (ca < len(x.levels[min(level, len(x.levels) - 1)][0])) \
                & (cb < len(y.levels[min(level, len(y.levels) - 1)][0]))
            if x is y:
                inside &= ca <= cb
            ca, cb = ca[inside], cb[inside]
            good = _possible(x, y, level, ca, cb, percent)
            parts.append((ca[good], cb[good]))
        i, j = (np.concatenate(v) for v in zip(*parts))
    if x is y:
        i, j = i[i < j], j[i < j]
    return i, j


def resolve(pairs_a: np.ndarray, pairs_b: np.ndarray, get_a, get_b, uf: UnionFind,
            la: np.ndarray, lb: np.ndarray, percent: int = PERCENT) -> None:
    """Verify leaf pairs whose labels are still apart, joining those that link."""
    while len(pairs_a):
        roots = uf.roots()
        apart = roots[la[pairs_a]] != roots[lb[pairs_b]]
        pairs_a, pairs_b = pairs_a[apart], pairs_b[apart]
        if not len(pairs_a):
            return
        _, first = np.unique(pairs_a, return_index=True)      # one partner of each, then look again
        for a, b in zip(pairs_a[first].tolist(), pairs_b[first].tolist()):
            if uf.find(la[a]) != uf.find(lb[b]) and linked(get_a[a], get_b[b], percent):
                uf.join(int(la[a]), int(lb[b]))
        rest = np.ones(len(pairs_a), bool)
        rest[first] = False
        pairs_a, pairs_b = pairs_a[rest], pairs_b[rest]


def link_group(members: list[np.ndarray], side: np.ndarray, labels: np.ndarray,
               percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges between labels that links of a group's sets join.

    ``side`` is 0 for all (every pair is looked at) or 0/1 (pairs across only).
    """
    names, lab = np.unique(labels, return_inverse=True)
    uf = UnionFind(len(names))
    if side.any():
        bits = bits_for(members)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(a) and len(b):
            x, y = (Tree([members[k] for k in part], lab[part], bits) for part in (a, b))
            i, j = traverse(x, y, percent)
            resolve(i, j, x.sets, y.sets, uf, x.labels, y.labels, percent)
    elif len(members) == 2:
        if len(names) == 2 and linked(members[0], members[1], percent):
            uf.join(0, 1)
    elif len(members) > 2:
        n = np.fromiter(map(len, members), np.int64, len(members))
        low = np.fromiter((int(m[0]) for m in members), np.uint64, len(members))
        for key in (np.lexsort((low, n)), np.lexsort((n, low))):   # neighbours first: cheap joins
            for a, b in zip(key[:-1].tolist(), key[1:].tolist()):
                if uf.find(lab[a]) != uf.find(lab[b]) and linked(members[a], members[b], percent):
                    uf.join(int(lab[a]), int(lab[b]))
        tree = Tree(members, uf.roots()[lab], bits_for(members))
        i, j = traverse(tree, tree, percent)
        resolve(i, j, tree.sets, tree.sets, uf, tree.labels, tree.labels, percent)
    roots = uf.roots()
    return [(int(names[k]), int(names[r])) for k, r in enumerate(roots) if k != r]


def posted(s: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """(shingles to post, how many of the counted ones may be of this class alone
    for it to link at all, less one)."""
    length = len(s) - need(len(s), percent) + 1 if len(s) else 0
    counted = int(np.searchsorted(s, np.uint64(int(SHARE * 2 ** 64))))
    return s[:max(counted, length)] if len(s) else s, length - counted


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, cls) of every row."""
    def rows(batch: pa.RecordBatch) -> dict:
        got = sets(batch.column("text"))
        return {"doc_id": batch.column("doc_id"), "n": [len(s) for s in got],
                "cls": signed(np.fromiter(map(class_key, got), np.uint64, len(got)))}
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows,
                     "doc_id long, n long, cls long")


def _postings(docs: DataFrame, percent: int) -> DataFrame:
    """(token, cls, spare) of every posted shingle; ids may be null."""
    def rows(batch: pa.RecordBatch) -> dict:
        got = sets(batch.column("text"))
        post = [posted(s, percent) for s in got]
        n = [len(p) for p, _ in post]
        return {"token": signed(np.concatenate([p for p, _ in post])),
                "cls": np.repeat(signed(np.fromiter(map(class_key, got), np.uint64, len(got))), n),
                "spare": np.repeat([s for _, s in post], n).astype(np.int32)}
    return arrow_map(docs.where("doc_id is not null").select("text"), rows,
                     "token long, cls long, spare int")


def _shared(postings: DataFrame) -> DataFrame:
    """(cls, spare, token, n) of shingles posted by several classes, n of them."""
    def run(batches):
        names = ("token", "cls", "spare")
        held, flushed = None, False          # rows of the last shingle; whether some left already

        def rows(t, c, s, n):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (c, s, t, n.astype(np.int32))],
                                              names=["cls", "spare", "token", "n"])
        for b in batches:
            if not b.num_rows:
                continue
            t, c, s = (b.column(k).to_numpy() for k in names)
            if held is not None:
                t, c, s = (np.concatenate([h, x]) for h, x in zip(held, (t, c, s)))
            once = np.ones(len(t), bool)
            once[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            t, c, s = t[once], c[once], s[once]
            start = run_starts(t)
            n = np.diff(np.append(start, len(t)))
            if flushed:                      # its first row is only there to tell repeats
                n[0] += MOST_COUNT
            out = np.repeat(np.minimum(n, MOST_COUNT), np.diff(np.append(start, len(t))))
            good = out > 1
            if flushed:
                good[0] = False
            last = start[-1]
            if len(t) - last >= MOST_COUNT or (flushed and last == 0):
                held, flushed = (t[-1:], c[-1:], s[-1:]), True
            else:
                good[last:] = False
                held, flushed = (t[last:], c[last:], s[last:]), False
            if good.any():
                yield rows(t[good], c[good], s[good], out[good])
        if held is not None and not flushed and len(held[0]) > 1:
            yield rows(*held, np.full(len(held[0]), len(held[0])))
    return (postings.repartition("token").sortWithinPartitions("token", "cls")
            .mapInArrow(run, "cls long, spare int, token long, n int"))


def _prefixes(shared: DataFrame) -> DataFrame:
    """(token, cls) of the prefix shingles that other classes posted too."""
    edge = int(SHARE * 2 ** 64)

    def run(batches):
        for got in whole_runs(batches, "cls"):
            start = run_starts(got["cls"])
            size = np.diff(np.append(start, len(got["cls"])))
            late = got["token"].view(np.uint64) >= np.uint64(edge)
            counted = np.add.reduceat(~late, start, dtype=np.int64)
            # prefix length, less the counted shingles of this class alone
            left = np.repeat(got["spare"][start] + counted, size)
            keep = (np.arange(len(late)) - np.repeat(start, size) < left) | late & (left > 0)
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[k][keep]) for k in ("token", "cls")], names=["token", "cls"])
    late = F.expr(f"case when token >= 0 and token < {edge} then 0 else 1 end") if edge < 2 ** 63 \
        else F.expr(f"case when token >= 0 or token < {edge - 2 ** 64} then 0 else 1 end")
    return (shared.withColumn("late", late).repartition("cls")
            .sortWithinPartitions("cls", "late", "n", "token").drop("late")
            .mapInArrow(run, "token long, cls long"))


def _stars(postings: DataFrame) -> DataFrame:
    """(a, b): each class sharing a shingle with a smaller one, and the smallest such.

    ``postings`` is (token, cls); equal tokens are neighbours after the sort, and
    only the current token's smallest class is held.
    """
    def run(batches):
        token, least = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, c = (batch.column(k).to_numpy() for k in ("token", "cls"))
            fresh = np.ones(len(t), bool)
            fresh[1:] = t[1:] != t[:-1]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(t)), 0))
            first = c[begin]
            if token is not None and t[0] == token:
                first[begin == 0] = least
            token, least = t[-1], first[-1]
            keep = c != first
            if keep.any():
                pair = np.unique(np.column_stack([c[keep], first[keep]]), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])
    return (postings.repartition("token").sortWithinPartitions("token", "cls")
            .mapInArrow(run, "a long, b long").distinct())


def _grouped(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) of labels within each group of (keys, side, label, text)."""
    def run(batches):
        held, members, side, labels = None, [], [], []

        def done() -> pa.RecordBatch:
            got = link_group(members, np.array(side), np.array(labels, np.int64), percent)
            return pa.RecordBatch.from_arrays(
                [pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            where = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            for k, s, lab, m in zip(where, batch.column("side").to_pylist(),
                                    batch.column("label").to_pylist(),
                                    sets(batch.column("text"))):
                if k != held and members:
                    yield done()
                    members, side, labels = [], [], []
                held = k
                members.append(m)
                side.append(s)
                labels.append(lab)
        if members:
            yield done()
    return (rows.select(*keys, "side", "label", "text").repartition(*keys)
            .sortWithinPartitions(*keys, "label").mapInArrow(run, "a long, b long"))


def class_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def _own_text(rows: DataFrame) -> DataFrame:
    """Rows whose text is of their class (ids may repeat with other texts)."""
    def run(batches):
        for b in batches:
            got = sets(b.column("text"))
            own = signed(np.fromiter(map(class_key, got), np.uint64, len(got)))
            yield b.filter(pa.array(own == b.column("cls").to_numpy()))
    return rows.mapInArrow(run, rows.schema)


def link_classes(docs: DataFrame, found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, component) of every class that links with another class; ``found`` are
    the digests of ``docs``."""
    blocks = components(_stars(_prefixes(_shared(_postings(docs, percent)))))   # id = class
    first = (found.where("n > 0 and doc_id is not null").groupBy("cls")
             .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")))
    size = F.floor(F.log("n") / float(np.log(100 / percent))).alias("size")
    member = blocks.select(F.col("id").alias("cls"), F.col("component").alias("block")) \
        .join(first, "cls").withColumn("weight", F.greatest("n", F.lit(LEAST_WEIGHT)))
    total = member.groupBy("block").agg(F.sum("weight").alias("total"))
    member = member.join(total, "block").withColumn("size", size)
    by_size = member.groupBy("block", "size").agg(F.sum("weight").alias("part"))
    member = member.join(by_size, ["block", "size"]).withColumn(
        "chunk", F.when(F.col("total") <= CHUNK_WEIGHT, F.lit(0)).otherwise(
            F.col("size") * 1_000_000 + F.pmod(F.xxhash64("cls"), F.ceil(F.col("part") / CHUNK_WEIGHT))))
    many = F.col("total") > CHUNK_WEIGHT
    member = cut(member.select("doc_id", "cls", "block", "chunk", "size", "weight", many.alias("many")))
    held = cut(_own_text(member.join(only_ids(docs, member), "doc_id")))
    side = F.lit(0).alias("side")
    links = cut(_grouped(held.select("block", "chunk", side, F.col("cls").alias("label"), "text"),
                         ["block", "chunk"], percent))
    wide = held.where("many")
    if wide.isEmpty():
        return components(links)

    def labelled(rows: DataFrame) -> DataFrame:
        return (rows.join(components(links).withColumnRenamed("id", "cls"), "cls", "left")
                .withColumn("label", F.coalesce("component", "cls")).drop("component"))

    # the smallest class of every chunk's components, dealt anew: counted and dealt without
    # the texts, which are joined when the deal is known
    tops = labelled(wide.select("cls", "block", "weight")).where("label = cls")
    total = tops.groupBy("block").agg(F.sum("weight").alias("sum"))
    dealt = cut(tops.join(total, "block").select("cls", "block", "label", F.pmod(
        F.xxhash64("cls", F.lit(7)), F.ceil(F.col("sum") / CHUNK_WEIGHT)).alias("deal")))
    tops = dealt.join(wide.select("cls", "text"), "cls")
    links = cut(links.unionByName(_grouped(tops.select("block", "deal", side, "label", "text"),
                                           ["block", "deal"], percent)))
    now = cut(labelled(wide).drop("many", "weight", "doc_id"))
    chunks = now.groupBy("block", "chunk", "size").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    x, y = chunks.alias("x"), chunks.alias("y")
    pairs = x.join(y, F.expr("x.block = y.block and x.chunk < y.chunk and abs(x.size - y.size) <= 1 "
                             "and not (x.lo = x.hi and y.lo = y.hi and x.lo = y.lo)")) \
        .select("x.block", F.col("x.chunk").alias("i"), F.col("y.chunk").alias("j"))
    sides = [pairs.select("block", F.col(c).alias("chunk"), "i", "j", F.lit(s).alias("side"))
             for s, c in enumerate(("i", "j"))]
    across = now.join(sides[0].unionByName(sides[1]), ["block", "chunk"])
    return components(links.unionByName(_grouped(across, ["block", "i", "j"], percent)))


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    found = cut(digests(docs))
    linked_classes = link_classes(docs, found, percent)
    rows = found.select("doc_id", F.col("n").alias("n_shingles"), "cls")
    some = (rows.where("n_shingles > 0")
            .join(linked_classes.withColumnRenamed("id", "cls"), "cls", "left")
            .withColumn("part", F.coalesce("component", "cls")))
    least = some.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    out = ("doc_id", "n_shingles", "component_id")
    none = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return some.join(least, "part").select(*out).unionByName(none.select(*out))
