"""Token-id files compressed by a Re-Pair grammar, readable document by document.

Documents are range-partitioned and sorted by (doc_id, text hash); each task
encodes its texts with the tokenizers library (remembering ids per word, as
white space never joins words), appends the end id, and packs them into blocks
of about ``BLOCK_IDS`` ids. Within a block the frequent pairs of neighbouring
symbols are replaced by nonterminals, round after round; pairs never cross a
document's end. A block's payload holds the rules, the expansion length of each
rule, and every document's symbol and id counts, so any document can be decoded
on its own. Payloads are rows of a Parquet dataset (shard, block, start within
the shard, ids, payload), which Spark's committed writes keep whole when a task
is run again.

Payload, all little-endian: uint32 magic, terminals, rules, documents, symbols,
symbol width; uint32 rule pairs; uint32 rule expansion lengths; int64 doc_ids
(null: the smallest int64); uint32 symbols and ids per document; symbols.

Cases: null and empty texts hold the end id alone; null ids come first; rows of
equal id are ordered by text hash; empty tables make a dataset without rows;
other columns are neither read nor returned.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daycast.llm.common import Numbers, Words, arrow_map, claim, foldable, keep, texts
from daycast.session import checkpoint_dir

BLOCK_IDS = 1 << 20
END_ID = 2
# Words a worker remembers, about 60 bytes each; then it begins anew.
KNOWN_WORDS = 2_000_000
MAGIC = 0x52503031
ROUNDS = 16               # replacement rounds of a block, at most; fewer when
LEAST_GAIN = 0.005        # a round replaces a smaller share of its symbols
RULES_PER_ROUND = 1024    # pairs replaced in one round
RULE_LIMIT = 16_000       # keeps symbols of a 49k vocabulary in 16 bits
MIN_PAIRS = 24            # a rule must save more than it costs
_TOP = 1024               # symbols whose pairs are counted in a round
_NONE = 1 << 20           # more than any pair of them; times _TOP still 32 bits
NULL_ID = np.iinfo(np.int64).min
BLOCK_SCHEMA = ("shard int, block int, start_in_shard long, n_docs int, n_ids long, "
                "payload binary")


class LibraryEncoder:
    """Ids of texts by the tokenizers library, remembered per word.

    New words go to the library many at a time. Letters alone are one piece, whose
    last token is marked as a word's end, so words of letters are joined by spaces
    and told apart by these marks. All other words are parted by a special token
    none of them holds. With a vocabulary that lowers its input, words are
    remembered with A-Z lowered (unless a special token or a combining mark may be
    near), and where it splits them off, full stops and commas are words of their own.
    """

    def __init__(self, path: str, limit: int = KNOWN_WORDS):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.gap = next(((i, t.content) for i, t in added.items()
                         if t.special and not t.normalized and not t.lstrip and not t.rstrip), None)
        self.limit = limit
        self.reset()
        same = lambda a, *b: np.array_equal(self.ids(a), np.concatenate([self.ids(x) for x in b]))
        self.lowers = same("AZ", "az")
        ending = self.tokenizer.model.end_of_word_suffix or ""
        self.marks = bool(ending) and same("az.", "az", ".") and same("az,", "az", ",")
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        if ending:
            self.ends[[i for t, i in names.items() if t.endswith(ending)]] = True

    def reset(self) -> None:
        """Forget all words; then ``flat`` holds the ids of words 0, 1, ... of ``numbers``."""
        self.numbers = Numbers()
        self.flat = np.zeros(0, np.uint32)
        self.begin = self.size = np.zeros(0, np.int64)

    def ids(self, text: str) -> np.ndarray:
        got = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(got.ids, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Number new distinct words and keep their ids."""
        named = [w.decode("utf-8", "replace") for w in words]
        alone = np.array([self.gap is None or "<" in n and any(s in n for s in self.special)
                          for n in named], bool)
        # U+0130 is the one letter that lowers to more than letters
        plain = np.array([n.isalpha() and "\u0130" not in n for n in named], bool) \
            & self.ends.any() & ~alone
        parts, sizes = [], np.zeros(len(named), np.int64)
        order = [np.zeros(0, np.int64)]
        for k, kind in enumerate((plain, ~plain & ~alone, alone)):
            at = np.flatnonzero(kind)
            for s in range(0, len(at), 20_000 if k < 2 else 1):
                part = at[s:s + (20_000 if k < 2 else 1)]
                got = self.ids((" ", (self.gap or (0, ""))[1], "")[k].join([named[i] for i in part]))
                if k == 0:
                    last = np.flatnonzero(self.ends[got]) + 1
                    n = np.diff(last, prepend=0)
                elif k == 1:
                    cuts = np.flatnonzero(got == self.gap[0])
                    n = np.diff(np.append(cuts, len(got)), prepend=-1) - 1
                    got = np.delete(got, cuts)
                else:
                    n = np.array([len(got)])
                if len(n) != len(part) or n.sum() != len(got):
                    raise ValueError("the vocabulary does not keep words apart")
                parts.append(got)
                sizes[part] = n
                order.append(part)
        order = np.concatenate(order)
        begin = np.zeros(len(named), np.int64)
        begin[order] = len(self.flat) + np.cumsum(sizes[order]) - sizes[order]
        self.flat = np.concatenate([self.flat, *parts])
        self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, sizes])
        self.numbers.add(hashes)

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text) of an Arrow column."""
        words = Words(column, foldable(texts(column)) if self.lowers else False, self.marks)
        if self.numbers.count > self.limit:
            self.reset()
        at = self.numbers.find(words.hash)
        new = np.flatnonzero(at < 0)
        if len(new):
            h, first = np.unique(words.hash[new], return_index=True)
            self.learn(h, words.bytes_of(new[first]))
            at[new] = self.numbers.find(words.hash[new])
        n = self.size[at]
        total = np.concatenate([[0], np.cumsum(n)])
        ends = total[np.cumsum(words.counts)] if len(words.counts) else total[:0]
        shift = np.repeat(self.begin[at] - total[:-1], n)
        return self.flat[shift + np.arange(len(shift))], np.diff(ends, prepend=0)


_WORKER: dict[str, LibraryEncoder] = keep({})


def worker_encoder(path: str) -> LibraryEncoder:
    """The encoder of this worker process, kept from task to task."""
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = LibraryEncoder(path)
    return _WORKER[path]


def compress(ids: np.ndarray, doc_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(symbols, symbols per document, rule pairs, number of terminals).

    Each round counts the pairs of the ``_TOP`` most frequent symbols and turns
    the frequent ones into rules; of overlapping occurrences in a run, every
    second one is replaced.
    """
    terminals = int(ids.max(initial=0)) + 1
    seq = ids.astype(np.int32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(doc_lengths) - 1] = True
    rules: list[np.ndarray] = []
    n_rules = 0
    for _ in range(ROUNDS):
        if len(seq) < 2:
            break
        used = np.bincount(seq, minlength=terminals + n_rules)
        top = np.argsort(-used, kind="stable")[:_TOP].astype(np.int32)
        rank = np.full(len(used), _NONE, np.int32)      # a pair with a rarer symbol is no pair
        rank[top] = np.arange(len(top), dtype=np.int32)
        r = rank[seq]
        pair = r[:-1] * _TOP
        pair += r[1:]
        pair[last[:-1]] = _NONE
        np.minimum(pair, _TOP * _TOP, out=pair)
        seen = np.bincount(pair, minlength=_TOP * _TOP + 1)[:-1]
        chosen = np.flatnonzero(seen >= MIN_PAIRS)
        most = min(RULES_PER_ROUND, RULE_LIMIT - n_rules)
        if len(chosen) > most:
            chosen = chosen[np.argsort(-seen[chosen], kind="stable")[:most]]
        if not len(chosen):
            break
        name = np.zeros(_TOP * _TOP + 1, np.int32)
        name[chosen] = terminals + n_rules + np.arange(len(chosen), dtype=np.int32)
        new = name[pair]
        at = np.flatnonzero(new)
        fresh = np.ones(len(at), bool)
        fresh[1:] = at[1:] != at[:-1] + 1
        if not fresh.all():                             # of a run of pairs, every second one
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
        rules.append(np.column_stack([top[chosen // _TOP], top[chosen % _TOP]]))
        n_rules += len(chosen)
        seq[at] = new[at]
        last[at] |= last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last = seq[stay], last[stay]
        if len(at) < LEAST_GAIN * len(seq):
            break
    counts = np.diff(np.flatnonzero(last), prepend=-1)
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.int32)
    return seq, counts, pairs.astype(np.uint32), terminals


def rule_lengths(pairs: np.ndarray, terminals: int) -> np.ndarray:
    out = np.ones(terminals + len(pairs), np.int64)
    for k, (a, b) in enumerate(pairs.tolist()):
        out[terminals + k] = out[a] + out[b]
    return out


def pack(doc_ids: np.ndarray, ids: np.ndarray, doc_lengths: np.ndarray) -> bytes:
    """Payload of one block of whole documents."""
    seq, counts, pairs, terminals = compress(ids, doc_lengths)
    wide = 2 if terminals + len(pairs) <= 1 << 16 else 4
    head = np.array([MAGIC, terminals, len(pairs), len(doc_ids), len(seq), wide], "<u4")
    return b"".join([head.tobytes(), pairs.astype("<u4").tobytes(),
                     rule_lengths(pairs, terminals)[terminals:].astype("<u4").tobytes(),
                     doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(),
                     doc_lengths.astype("<u4").tobytes(), seq.astype(f"<u{wide}").tobytes()])


class Block:
    """A payload opened for decoding."""

    def __init__(self, payload: bytes):
        magic, t, r, d, s, wide = np.frombuffer(payload, "<u4", 6).tolist()
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, kind, n, at)
            at += got.nbytes
            return got
        pairs = take("<u4", 2 * r).reshape(r, 2)
        self.length = np.concatenate([np.ones(t, np.int64), take("<u4", r).astype(np.int64)])
        self.doc_ids = take("<i8", d)
        self.symbols_of, self.ids_of = take("<u4", d).astype(np.int64), take("<u4", d).astype(np.int64)
        self.symbols = take(f"<u{wide}", s)
        self.first = np.concatenate([[0], np.cumsum(self.symbols_of)])
        # expansions of all symbols, one after the other
        self.offset = np.cumsum(self.length) - self.length
        self.flat = np.empty(int(self.length.sum()), np.uint32)
        self.flat[:t] = np.arange(t)
        flat, off, ln = self.flat, self.offset.tolist(), self.length.tolist()
        for k, (a, b) in enumerate(pairs.tolist(), t):
            o = off[k]
            flat[o:o + ln[a]] = flat[off[a]:off[a] + ln[a]]
            flat[o + ln[a]:o + ln[k]] = flat[off[b]:off[b] + ln[b]]

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of documents ``first`` to before ``last`` of the block."""
        s = self.symbols[self.first[first]:self.first[len(self.doc_ids) if last is None else last]]
        n = self.length[s]
        begin = np.cumsum(n) - n
        return self.flat[np.repeat(self.offset[s] - begin, n) + np.arange(int(n.sum()))]


def write(docs: DataFrame, path: str, folder: str, end_id: int = END_ID,
          block_ids: int = BLOCK_IDS) -> None:
    """Encode every text and write the blocks, in ascending doc_id order, to ``folder``."""
    def run(batches):
        claim(__name__)
        encoder = worker_encoder(path)
        shard = TaskContext.get().partitionId()
        names, parts, size, block, start = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal names, parts, size, block, start
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            row = [shard, block, start, len(parts), size,
                   pack(np.array(names, np.int64), np.concatenate(parts), lengths)]
            names, parts, size, block, start = [], [], 0, block + 1, start + size
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds)],
                names=["shard", "block", "start_in_shard", "n_docs", "n_ids", "payload"])

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            ids, counts = encoder(batch.column("text"))
            last = np.cumsum(counts)
            ids = np.insert(ids, last, end_id)            # after each document
            last = last + np.arange(1, len(last) + 1)
            for key, a, b in zip(keys, [0, *last[:-1].tolist()], last.tolist()):
                names.append(NULL_ID if key is None else key)
                parts.append(ids[a:b])
                size += b - a
                if size >= block_ids:
                    yield flush()
        if parts:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
     .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(run, BLOCK_SCHEMA).write.mode("error").parquet(folder))


def shard_starts(blocks: DataFrame) -> dict[int, int]:
    """Ids before each shard. One row per shard (a task's share of the table) is read."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    out, at = {}, 0
    for row in totals:
        out[row.shard] = at
        at += row.n
    return out


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(folder)
    starts = spark.sparkContext.broadcast(shard_starts(blocks))

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32")}
        raw = []
        for shard, start, payload in zip(*(batch.column(c).to_pylist() for c in
                                           ("shard", "start_in_shard", "payload"))):
            b = Block(payload)
            data = b.ids().astype("<u4", copy=False).tobytes()
            last = np.cumsum(b.ids_of)
            first = last - b.ids_of
            out["doc_id"] += [None if i == NULL_ID else i for i in b.doc_ids.tolist()]
            out["start"] += (first + starts.value[shard] + start).tolist()
            out["n_tokens"] += b.ids_of.tolist()
            view = memoryview(data)
            spans = zip((4 * first).tolist(), (4 * last).tolist())
            if with_ids:
                raw += [data[x:y] for x, y in spans]
                out["ids_crc32"] += [zlib.crc32(x) for x in raw[len(out["ids_crc32"]):]]
            else:
                out["ids_crc32"] += [zlib.crc32(view[x:y]) for x, y in spans]
        return out | ({"ids": raw} if with_ids else {})
    return arrow_map(blocks.select("shard", "start_in_shard", "payload"), rows,
                     "doc_id long, start long, n_tokens long, ids_crc32 long"
                     + (", ids binary" if with_ids else ""))


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
