"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The most frequent pieces of the corpus are merged once and compiled into a
minimal acyclic automaton (shared prefixes and suffixes). Its arcs carry
numbers whose sum along a path is the piece's place in a table of id lists. The
automaton is one block of bytes which every worker maps into memory and walks
for many pieces at a time; pieces outside it are merged exactly.

Rules of the vocabulary file: special tokens are cut out of the raw text; the
rest is NFC-normalised, white space becomes a space, every code point is
lowered (so A-Z may be lowered first); the split pattern gives the pieces; a piece is a row of byte letters
whose last one has the end-of-word mark. White space never joins two pieces, so
a text's ids are those of its words (runs without ASCII white space), one after
the other, and are remembered per word. Decoding joins token strings by spaces
(the file names no decoder).

Cases: null and empty texts have no ids and decode to the empty string; ties in
word frequency are broken by the word; repeated rows are encoded alike; empty
tables give empty results; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import tempfile
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daycast.llm.common import CACHE_WORDS, arrow_map, foldable, hash64, keep, most_frequent, texts

# Most frequent words compiled into the lexicon (their pieces; bounds what is sent).
LEXICON_WORDS = 131_072

# The split pattern of the vocabulary file, its white space, its word end.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^ \p{L}\p{N}]+")
SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
WORD_END = "</w>"
PLAIN_ENDS = (b".", b",")        # after letters, a piece of their own


def byte_letters() -> list[str]:
    """The letter standing for each byte: printable Latin-1 stands for itself,
    the others follow in order from U+0100."""
    plain = {b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


NO_RANK = np.int64(1 << 40)


class PairTable:
    """Hash table of the merges: pair of ids -> rank, for arrays of pairs."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.merged = np.array([m[2] for m in merges], np.int64)
        keys = np.array([(a << 32) | b for a, b, _ in merges], np.int64)
        self.shift = np.uint64(64 - max(4, (len(keys) * 8).bit_length()))
        size = 1 << int(64 - int(self.shift))
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NO_RANK)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):                      # one round places what falls on free slots
            slot = self._slot(keys[left], self.probes)
            free = self.keys[slot] == -1
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[left[put]], left[put]
            left = np.delete(left, put)
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = (keys.astype(np.uint64) + np.uint64(probe)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NO_RANK`` where it is no merge (or an id is negative)."""
        key = (a << 32) | (b & 0xFFFFFFFF)
        out = np.full(key.shape, NO_RANK)
        open_ = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        flat, keys = out.ravel(), key.ravel()
        for probe in range(self.probes):
            slot = self._slot(keys[open_], probe)
            held = self.keys[slot]
            hit = held == keys[open_]
            flat[open_[hit]] = self.ranks[slot[hit]]
            open_ = open_[~hit & (held != -1)]
            if not len(open_):
                break
        return flat.reshape(key.shape)


class Vocabulary:
    """Ids, merges and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.ids: dict[str, int] = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b])
                       for rank, (a, b) in enumerate(merges)}
        self.pairs = PairTable([(*p, new) for p, (_, new) in self.merges.items()])
        letters = byte_letters()
        self.inner = [self.ids[c] for c in letters]
        self.last = [self.ids[c + WORD_END] for c in letters]
        names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.strings = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") \
            if self.special else None

    def merge_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """``merge`` of many pieces in step: each step merges the lowest-ranked,
        leftmost pair of every piece that still has one."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(pieces)
        by_length = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        inner, last = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        at = 0
        while at < len(by_length):
            part = by_length[at:at + 8192]
            longest = len(pieces[part[-1]])
            if longest > 48:                 # long pieces one by one
                part = [i for i in part if len(pieces[i]) <= 48] or part[:1]
                if len(pieces[part[0]]) > 48:
                    out[part[0]] = np.array(self.merge(pieces[part[0]]), np.uint32)
                    at += 1
                    continue
                longest = len(pieces[part[-1]])
            n = np.fromiter((len(pieces[i]) for i in part), np.int64, len(part))
            raw = np.frombuffer(b"".join(pieces[i].ljust(longest, b"\0") for i in part),
                                np.uint8).reshape(len(part), longest)
            ids = inner[raw]
            rows = np.arange(len(part))
            ids[rows, n - 1] = last[raw[rows, n - 1]]
            ids[np.arange(longest) >= n[:, None]] = -1
            rank = np.full(ids.shape, NO_RANK)          # of the pair beginning there
            rank[:, :-1] = self.pairs.rank(ids[:, :-1], ids[:, 1:])
            where = np.array(part)
            while len(ids):
                best = rank.argmin(axis=1)
                rows = np.arange(len(ids))
                done = rank[rows, best] == NO_RANK
                for i, row in zip(where[done].tolist(), ids[done]):
                    out[i] = row[row >= 0].astype(np.uint32)
                ids, rank, where, best = ids[~done], rank[~done], where[~done], best[~done]
                rows = rows[:len(ids)]
                if not len(ids):
                    break
                ids[rows, best] = self.pairs.merged[rank[rows, best]]
                shift = np.arange(ids.shape[1] - 1) + (np.arange(ids.shape[1] - 1) > best[:, None])
                ids = np.take_along_axis(ids, shift, axis=1)
                rank = np.take_along_axis(rank, shift, axis=1)
                ids = np.concatenate([ids, np.full((len(ids), 1), -1)], axis=1)
                rank = np.concatenate([rank, np.full((len(ids), 1), NO_RANK)], axis=1)
                rank[rows, best] = self.pairs.rank(ids[rows, best], ids[rows, best + 1])
                left = np.maximum(best - 1, 0)
                again = self.pairs.rank(ids[rows, left], ids[rows, left + 1])
                rank[rows, left] = np.where(best > 0, again, rank[rows, left])
            at += len(part)
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: always the lowest-ranked, then leftmost pair is merged."""
        ids = [self.inner[b] for b in piece[:-1]] + [self.last[piece[-1]]]
        merges = self.merges
        if len(ids) < 40:
            while len(ids) > 1:
                best = min(((merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:]))
                            if p in merges), default=None)
                if best is None:
                    break
                i = best[1]
                ids[i:i + 2] = [merges[ids[i], ids[i + 1]][1]]
            return ids
        after = list(range(1, len(ids))) + [-1]
        before = list(range(-1, len(ids) - 1))
        heap = [(merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (ids[x], ids[y]) in merges:
                    heapq.heappush(heap, (merges[ids[x], ids[y]][0], x, (ids[x], ids[y])))
        return [x for x in ids if x >= 0]

    def pieces(self, word: bytes) -> list[bytes | int]:
        """Normalised pieces (and ids of special tokens) of one word, in order."""
        if word.isalpha():                       # ASCII letters are one piece
            return [word.lower()]
        if word[-1:] in PLAIN_ENDS and word[:-1].isalpha():
            return [word[:-1].lower(), word[-1:]]
        text = word.decode("utf-8", "replace")
        if self.cut is None or not self.cut.search(text):
            return _normal_pieces(text)
        out: list[bytes | int] = []
        for part in self.cut.split(text):
            out += [self.special[part]] if part in self.special else _normal_pieces(part)
        return out


def _normal_pieces(text: str) -> list[bytes]:
    if not text.isascii():
        text = SPACES.sub(" ", unicodedata.normalize("NFC", text))
        text = "".join([c.lower() for c in text])
    else:
        text = text.lower()
    return [p.encode() for p in PIECES.findall(text)]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Minimal acyclic transducer of the entries, as one block of bytes.

    Words are added in byte order; states that later words cannot change any
    more are merged with an equal registered state (same finality and arcs).
    """
    words = sorted(w for w in entries if w)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]                       # states along the last word
    previous = b""

    def settle(down_to: int) -> None:
        for depth in range(len(path) - 1, down_to, -1):
            s = path[depth]
            key = (final[s], tuple(arcs[s].items()))
            arcs[path[depth - 1]][previous[depth - 1]] = register.setdefault(key, s)
        del path[down_to + 1:]

    for w in words:
        common = 0
        while common < min(len(w), len(previous)) and w[common] == previous[common]:
            common += 1
        settle(common)
        for byte in w[common:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        previous = w
    settle(0)

    count: dict[int, int] = {}       # words accepted from a state

    order, stack = [], [(0, False)]
    while stack:                     # children before parents
        s, done = stack.pop()
        if done:
            order.append(s)
        elif s not in count:
            count[s] = 0
            stack.append((s, True))
            stack += [(t, False) for t in arcs[s].values() if t not in count]
    place = {s: i for i, s in enumerate(reversed(order))}
    for s in order:
        count[s] = final[s] + sum(count[t] for t in arcs[s].values())
    keys, targets, outs, ends = [], [], [], np.zeros(len(place), np.uint8)
    for s in reversed(order):
        before = int(final[s])
        ends[place[s]] = final[s]
        for byte in sorted(arcs[s]):
            keys.append(place[s] * 256 + byte)
            targets.append(place[arcs[s][byte]])
            outs.append(before)
            before += count[arcs[s][byte]]
    ids = [entries[w] for w in words]
    offsets = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    blocks = [np.array(keys, np.int64), np.array(targets, np.int64), np.array(outs, np.int64),
              offsets, np.array([i for x in ids for i in x], np.uint32), ends]
    return np.array([len(b) for b in blocks], np.int64).tobytes() + b"".join(
        b.tobytes() for b in blocks)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, block: bytes):
        file = tempfile.TemporaryFile()        # unlinked at once; lives as long as the map
        file.write(block)
        file.flush()
        self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        file.close()
        sizes = np.frombuffer(self.map, np.int64, 6)
        at, out = 48, []
        for n, kind in zip(sizes, (np.int64, np.int64, np.int64, np.int64, np.uint32, np.uint8)):
            out.append(np.frombuffer(self.map, kind, int(n), at))
            at += int(n) * np.dtype(kind).itemsize
        self.keys, self.targets, self.outs, self.offsets, self.ids, self.ends = out

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word in the lexicon, -1 if absent; all walk in step."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        state = np.zeros(len(words), np.int64)
        number = np.zeros(len(words), np.int64)
        if not len(self.keys):
            return np.full(len(words), -1)
        buf = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(length) - length
        alive = np.flatnonzero(length > 0)
        state[length == 0] = -1
        depth = 0
        while len(alive):
            key = state[alive] * 256 + buf[start[alive] + depth]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            state[alive[~hit]] = -1
            alive, i = alive[hit], i[hit]
            state[alive] = self.targets[i]
            number[alive] += self.outs[i]
            depth += 1
            alive = alive[length[alive] > depth]
        ok = state >= 0
        ok[ok] = self.ends[state[ok]] == 1
        return np.where(ok, number, -1)

    def entry(self, number: int) -> bytes:
        return self.ids[self.offsets[number]:self.offsets[number + 1]].tobytes()


class Encoder:
    """Ids of texts as little-endian uint32 bytes, remembered per word."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.words: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        parts = [self.vocabulary.pieces(w) for w in words]
        distinct = list({p for ps in parts for p in ps if isinstance(p, bytes)})
        number = self.lexicon.find(distinct)
        known: dict[bytes | int, bytes] = {
            p: self.lexicon.entry(n) for p, n in zip(distinct, number.tolist()) if n >= 0}
        unseen = [p for p, n in zip(distinct, number.tolist()) if n < 0]
        for p, ids in zip(unseen, self.vocabulary.merge_many(unseen)):
            known[p] = ids.tobytes()
        for ps in parts:
            for p in ps:
                if isinstance(p, int):
                    known[p] = np.array([p], "<u4").tobytes()
        return {w: b"".join([known[p] for p in ps]) for w, ps in zip(words, parts)}

    def __call__(self, batch: list[bytes]) -> list[bytes]:
        split = [(t.lower() if low else t).split() for t, low in zip(batch, foldable(batch))]
        wanted = set().union(*split)
        if len(self.words) > CACHE_WORDS:
            self.words = {w: self.words[w] for w in wanted if w in self.words}
        self.words.update(self.learn(list(wanted.difference(self.words))))
        got = self.words.__getitem__
        return [b"".join(map(got, ws)) for ws in split]


def decode(ids: np.ndarray, strings: list[bytes]) -> bytes:
    return b" ".join(map(strings.__getitem__, ids.tolist()))


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words of all texts, at most ``words`` (counts cover the whole corpus)."""
    def count(batch: pa.RecordBatch) -> dict:
        from collections import Counter
        c: Counter = Counter()
        body = texts(batch.column("text"))
        for t, low in zip(body, foldable(body)):
            c.update((t.lower() if low else t).split())
        return {"word": pa.array(list(c.keys()), pa.binary()), "n": list(c.values())}

    counted = (arrow_map(docs.select("text"), count, "word binary, n long")
               .groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"))
    return [bytes(w) for w in most_frequent(counted, "word", "n", words)["word"]]


def build(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> bytes:
    """Lexicon block of the corpus' frequent words, merged exactly."""
    vocabulary = Vocabulary(path)
    pieces = {p for w in frequent_words(docs, words) for p in vocabulary.pieces(w)
              if isinstance(p, bytes)}
    pieces = sorted(pieces)
    return compile_lexicon({p: ids.tolist() for p, ids in zip(pieces, vocabulary.merge_many(pieces))})


def encode(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids binary of little-endian uint32, decoded string) of every row."""
    return _encoded(docs, path, words, "doc_id long, ids binary, decoded string",
                    lambda ids, text: {"ids": ids, "decoded": [t.decode() for t in text]})


def digest(docs: DataFrame, path: str, words: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]): encode, decode, hash in one pass."""
    def columns(ids: list[bytes], text: list[bytes]) -> dict:
        out = {"n_tokens": [len(x) // 4 for x in ids],
               "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
               "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in text]}
        return out | ({"ids": ids} if with_ids else {})
    return _encoded(docs, path, words, "doc_id long, n_tokens long, ids_sha256 string, "
                    "decoded_sha256 string" + (", ids binary" if with_ids else ""), columns)


def _encoded(docs: DataFrame, path: str, words: int, schema: str, columns) -> DataFrame:
    lexicon = build(docs, path, words)
    key = (path, hash64(lexicon))
    block = docs.sparkSession.sparkContext.broadcast(lexicon)

    def rows(batch: pa.RecordBatch) -> dict:
        encoder = worker_encoder(key, block.value)
        ids = encoder(texts(batch.column("text")))
        text = [decode(np.frombuffer(x, "<u4"), encoder.vocabulary.strings) for x in ids]
        return {"doc_id": batch.column("doc_id")} | columns(ids, text)
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, schema)


_WORKER: dict = keep({})


def worker_encoder(key: tuple[str, int], lexicon: bytes) -> Encoder:
    """The encoder of this worker process, kept from task to task."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(Vocabulary(key[0]), Lexicon(lexicon))
    return _WORKER[key]
