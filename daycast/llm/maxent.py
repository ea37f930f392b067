"""LM scoring: a hashed maximum-entropy model with class-factored softmax.

Tokens are the words of the A-Z-lowered text and one end. The probability of a
token is p(class | history) * p(token | class):

* Classes: each of the ``OWN`` most frequent words, the end, suffix classes (a
  hash of a word's last two bytes; words ending in punctuation apart), and
  "repeat" for a word equal to the one before it.
* p(class | history) is a maximum-entropy model. Its features are the classes of
  the last word (n-gram), of the word before (skip), a coarse class of the third
  last (skip), the pairs (last, before) and (last, third last), and a bias, all
  hashed into ``2**BITS`` weight rows. With ``word_rounds``, features of the words
  themselves join them: the last word (2-gram), the last two (3-gram) and the word
  before the last (skip), each hashed into a weight row.
* p(token | class, history) is a softmax over the words of the class, a word of
  count c scoring log(c + 1) and the weights of the same hashed word features at
  the word's place (4 bits of its hash); each place has room for one unknown word.
  Without ``word_rounds`` it is (c + 1) / (N + V + 1) from the counts of the class'
  words, whose unknown words share one place. Single-word classes have p = 1.

All counts cover all training rows. Histories of classes reduce the corpus to a
table of (history, class) counts of bounded size; training runs rounds of gradient
updates over it, one feature family a round: every Spark task adds up what its
histories hold and what the model expects of them, the driver adds the tasks' sums
and takes the step gradient / (logarithmic mean of held and expected), which never
lowers the likelihood. Histories of words do not reduce: a round over them reads all
training texts, tasks add up held and expected counts of every weight, Spark adds up
the tasks' blocks of rows, and all families step at once by a share each, which never
lowers the likelihood either. Their rows a family follow the number of distinct words
up to ``2**WORD_BITS``, so a worker can hold them. Scoring looks up histories in numpy
batches. Counts of the ``FREQUENT`` most frequent
words travel to the tasks; those of all other words are joined by Spark.

Cases: null and empty texts are one end; held-out rows are scored, never learned
from; a null id is not held out; repeated rows count and are scored each; a text
without known words is scored by the unknown places; an empty table gives an
empty result, no training rows give uniform classes and base score 0 per token;
other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daycast.llm.common import (Numbers, Words, arrow_map, chain, claim, cut, lists, mix,
                                most_frequent, signed)

OWN = 31
END_CLASS, SUFFIX, PUNCTUATED = OWN, 24, 8
REPEAT = OWN + 1 + SUFFIX + PUNCTUATED
CLASSES = REPEAT + 1
START = CLASSES                    # class of what stands before a text
WIDE, COARSE = CLASSES + 1, 17     # history symbols; coarse classes and the start
CONTEXTS = WIDE * WIDE * COARSE
BITS = 12
SWEEPS = 2                         # rounds over all feature families
PRIOR = 0.5                        # added to held and expected counts
TASKS = 8                          # tasks of a gradient round
FREQUENT = 1 << 18                 # words whose counts are sent to the tasks
PLACE_BITS = 4                     # places of a class' words: the top bits of their hashes
PLACES = 1 << PLACE_BITS
WORD_FAMILIES, WORD_BITS = 3, 14
WORDS_A_ROW = 32                   # distinct words for a row of each family
WORD_TASKS, WORD_BLOCK = 16, 256   # least tasks of a round over words; rows whose sums travel together
# Keys of the feature families (bias, last, before, third last, two pairs), their rows.
_KEYS = (1, WIDE, WIDE, COARSE, WIDE * WIDE, WIDE * COARSE)
_ROWS = tuple(min(k, 1 << BITS) for k in _KEYS)
_FIRST = tuple(sum(_ROWS[:k]) for k in range(len(_ROWS)))


_ALNUM, _TRAIL = np.ones(256, bool), np.zeros(256, bool)
_ALNUM[:128] = [chr(b).isalnum() for b in range(128)]
_TRAIL[list(b".,;:!?\"')]")] = True


def _two_bytes(words: Words, ends: np.ndarray) -> np.ndarray:
    """The last two bytes before each end (one if the word has one), scrambled."""
    last = words.raw[ends - 1].astype(np.uint64)
    before = np.where(ends - words.starts > 1, words.raw[np.maximum(ends - 2, 0)], 0)
    return mix(mix((last << np.uint64(8) | before.astype(np.uint64)) + np.uint64(77)))


def suffix_classes(words: Words) -> np.ndarray:
    key = _two_bytes(words, words.ends)
    plain = _ALNUM[words.raw[words.ends - 1]]
    return np.where(plain, OWN + 1 + key % np.uint64(SUFFIX),
                    OWN + 1 + SUFFIX + key % np.uint64(PUNCTUATED)).astype(np.int64)


def coarse_classes(words: Words) -> np.ndarray:
    ends = words.ends.copy()
    at = np.flatnonzero(_TRAIL[words.raw[ends - 1]])
    while len(at):                                     # strip punctuation, not the whole word
        at = at[ends[at] - words.starts[at] > 1]
        ends[at] -= 1
        at = at[_TRAIL[words.raw[ends[at] - 1]]]
    return (_two_bytes(words, ends) >> np.uint64(8)).astype(np.int64) % (COARSE - 1)


class Lexis:
    """Classes and counts of words: those of their own, and the frequent ones."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.numbers, self.counts = Numbers(), np.append(counts, -1)
        self.numbers.add(keys)                          # the most frequent first

    def __call__(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(class, count) of every word; count -1: not among the frequent words."""
        at = self.numbers.find(words.hash)
        own = (at >= 0) & (at < OWN)
        return np.where(own, at, suffix_classes(words)), self.counts[at]


def token_hashes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every token, ends (0) included, text after text; which are words; place in the text."""
    total = len(words.hash) + len(words.counts)
    ends = np.cumsum(words.counts + 1) - 1
    is_word = np.ones(total, bool)
    is_word[ends] = False
    h = np.zeros(total, np.uint64)
    h[is_word] = words.hash
    return h, is_word, np.arange(total) - np.repeat(ends - words.counts, words.counts + 1)


def histories(words: Words, cls_of: np.ndarray):
    """(history code, class) of every token, ends included, text after text, and
    which tokens are words."""
    h, is_word, place = token_hashes(words)
    total = len(h)
    cls = np.full(total, END_CLASS, np.int64)
    cls[is_word] = cls_of
    again = np.zeros(total, bool)
    again[1:] = (h[1:] == h[:-1]) & is_word[1:] & is_word[:-1]
    cls[again] = REPEAT
    coarse = np.full(total, COARSE - 1, np.int64)
    coarse[is_word] = coarse_classes(words)
    past = []
    for k, (values, start) in enumerate(((cls, START), (cls, START), (coarse, COARSE - 1)), 1):
        p = np.full(total, start, np.int64)
        p[k:] = values[:-k]
        p[place < k] = start
        past.append(p)
    return (past[0] * WIDE + past[1]) * COARSE + past[2], cls, is_word


def word_histories(words: Words, rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Weight rows of the hashed words before every token, an array per family of
    ``rows`` rows, and the token's place among the words of its class."""
    h, _, place = token_hashes(words)
    past = []
    for k in (1, 2):
        p = np.zeros(len(h), np.uint64)
        p[k:] = h[:-k]
        p[place < k] = 0
        past.append(p)
    one, two = past
    shift = np.uint64(65 - rows.bit_length())
    keys = chain([one]), chain([one, two]), chain([two])
    return ([(k >> shift).astype(np.int64) + f * rows for f, k in enumerate(keys)],
            (h >> np.uint64(64 - PLACE_BITS)).astype(np.int64))


def feature_rows(codes: np.ndarray) -> np.ndarray:
    """Weight rows of the features of each history, a column per family."""
    one, rest = codes // (WIDE * COARSE), codes % (WIDE * COARSE)
    two, three = rest // COARSE, rest % COARSE
    kinds = [np.zeros_like(one), one, two, three, one * WIDE + two, one * COARSE + three]
    return np.column_stack([
        first + (k if rows == keys else
                 (mix(mix(k.astype(np.uint64))) % np.uint64(rows)).astype(np.int64))
        for k, keys, rows, first in zip(kinds, _KEYS, _ROWS, _FIRST)])


def class_log_probabilities(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Natural log of p(class | history), one row per history."""
    z = weights[feature_rows(codes)].sum(axis=1)
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


class ClassTable:
    """Natural log of p(class | history of classes), filled as histories are met."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.done = weights, np.zeros(CONTEXTS, bool)
        self.values = np.zeros((CONTEXTS, CLASSES), np.float32)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        fresh = np.flatnonzero(np.bincount(code, minlength=CONTEXTS).astype(bool) & ~self.done)
        for s in range(0, len(fresh), 8192):
            part = fresh[s:s + 8192]
            self.values[part] = class_log_probabilities(part, self.weights)
        self.done[fresh] = True
        return self.values


def in_classes(cls: np.ndarray) -> np.ndarray:
    """Tokens whose class holds many words."""
    return (cls > END_CLASS) & (cls < REPEAT)


def word_scores(code, cls, rows, table, places, weights) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all classes and of all places of the token's class, one row per token.

    ``places``: the words' counts, each + 1, and one unknown word, of every class and
    place; ``rows``: the families' weight rows in ``weights`` (of classes, of places)."""
    by_class = np.take(table, code, axis=0)
    by_place = np.take(np.log(places / places.sum(axis=1, keepdims=True)).astype(np.float32), cls, axis=0)
    for r in rows:
        by_class += np.take(weights[0], r, axis=0)
        by_place += np.take(weights[1], r, axis=0)
    return by_class, by_place


def word_log_probabilities(code, cls, rows, place, table, places, weights) -> np.ndarray:
    """Natural log of p(class | history) and, for a word of a class of many, of what
    its probability in the class has beside the factor (c + 1)."""
    out, many, mass = np.empty(len(code)), in_classes(cls), np.log(places)
    for s in range(0, len(code), 4096):
        c, p, at = cls[s:s + 4096], place[s:s + 4096], np.arange(min(4096, len(code) - s))
        z, u = word_scores(code[s:s + 4096], c, [r[s:s + 4096] for r in rows], table, places, weights)
        got = z[at, c].astype(float) - np.log(np.exp(z) @ np.ones(CLASSES, np.float32))
        inner = u[at, p].astype(float) - np.log(np.exp(u) @ np.ones(PLACES, np.float32)) - mass[c, p]
        out[s:s + 4096] = got + np.where(many[s:s + 4096], inner, 0)
    return out


def add_word_gradient(held, expected, code, cls, rows, place, table, places, weights) -> None:
    """Adds the tokens' counts to ``held`` and the model's to ``expected``, (of classes, of
    places) per weight row; their difference is the gradient of the log-likelihood.

    Expected counts lie in pairs in complex numbers (a last column may be empty), which
    numpy adds up in half as many steps."""
    used = rows if weights[0].any() or weights[1].any() else []
    for s in range(0, len(code), 4096):
        c, at = cls[s:s + 4096], slice(s, s + 4096)
        scores = word_scores(code[at], c, [r[at] for r in used], table, places, weights)
        many = np.flatnonzero(in_classes(c))
        for z, h, e, which, outcome in zip(scores, held, expected, (slice(None), many), (c, place[at])):
            z, width = z[which], z.shape[1]
            p = np.zeros((len(z), 2 * e.shape[1]), np.float32)
            np.exp(z, out=p[:, :width])
            if used:                                        # the tables' own rows sum to one
                p /= (p @ np.ones(p.shape[1], np.float32))[:, None]
            p = p.view(np.complex64)
            for r in rows:
                r = r[at][which]
                np.add.at(h.reshape(-1), r * width + outcome[which], np.int32(1))
                np.add.at(e.reshape(-1), (r[:, None] * e.shape[1] + np.arange(e.shape[1])).reshape(-1),
                          p.reshape(-1))


def few(rows: DataFrame) -> DataFrame:
    """Fewer partitions: what a task adds up has a bounded size, but travels once a task."""
    return rows.coalesce(max(WORD_TASKS, rows.rdd.getNumPartitions() // 8))


def fit_words(rows: DataFrame, m: dict, rounds: int) -> list[np.ndarray]:
    """Weights of the word features (of classes, of places) by rounds of distributed
    updates over all texts."""
    n, spark = WORD_FAMILIES * m["word_rows"], rows.sparkSession
    weights = [np.zeros((n, k), np.float32) for k in (CLASSES, PLACES)]
    texts = few(rows)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast({
            "weights": m["weights"], "keys": m["keys"][:OWN], "counts": m["counts"][:OWN],
            "places": m["places"], "word_weights": weights})

        def add(batches):
            claim(__name__)
            m = sent.value
            lexis, table = Lexis(m["keys"], m["counts"]), ClassTable(m["weights"])
            held = [np.zeros((n, k), np.int32) for k in (CLASSES, PLACES)]
            expected = [np.zeros((n, (k + 1) // 2), np.complex64) for k in (CLASSES, PLACES)]
            for batch in batches:
                words = Words(batch.column("text"))
                code, cls, _ = histories(words, lexis(words)[0])
                features, place = word_histories(words, n // WORD_FAMILIES)
                add_word_gradient(held, expected, code, cls, features, place, table(code), m["places"],
                                  m["word_weights"])
            for s in range(0, n, WORD_BLOCK):
                part = slice(s, s + WORD_BLOCK)
                if held[0][part].any():
                    sums = [h[part] for h in held]
                    sums += [e[part].view(np.float32)[:, :h.shape[1]] for e, h in zip(expected, held)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in sums],
                        names=["first", "held", "held_in", "expected", "expected_in"])

        def steps(group: pa.Table) -> pa.Table:
            def total(name, kind):
                return sum(np.frombuffer(x, kind).astype(float) for x in group[name].to_pylist())
            change = [step(total(f"held{k}", np.int32), total(f"expected{k}", np.float32)) / WORD_FAMILIES
                      for k in ("", "_in")]
            return pa.table([group["first"][:1]] + [pa.array([x.astype(np.float32).tobytes()], pa.binary())
                                                    for x in change], names=["first", "step", "step_in"])
        got = (texts.mapInArrow(add, "first int, held binary, held_in binary, expected binary, expected_in binary")
               .groupBy("first").applyInArrow(steps, "first int, step binary, step_in binary").toArrow())
        for name, w in zip(("step", "step_in"), weights):
            for first, change in zip(got["first"].to_pylist(), got[name]):
                change = np.frombuffer(change.as_buffer(), np.float32).reshape(-1, w.shape[1])
                w[first:first + len(change)] += change
            np.clip(w, -20, 20, out=w)          # the families' sums have exponentials in float32
        sent.unpersist()
    return weights


def held_and_expected(codes: np.ndarray, cls: np.ndarray, n: np.ndarray, weights: np.ndarray,
                      family: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (feature, class) in (history, class, count) rows, and by the model;
    their difference is the gradient of the log-likelihood."""
    own, at = np.unique(codes, return_inverse=True)
    row = feature_rows(own)[:, family] - _FIRST[family]
    shape = (_ROWS[family], CLASSES)
    held = np.bincount(row[at] * CLASSES + cls, n, shape[0] * CLASSES).reshape(shape)
    total = np.bincount(at, n, len(own))
    expected = np.zeros(shape)
    order = np.argsort(row, kind="stable")
    first = np.flatnonzero(np.diff(row[order], prepend=-1))
    for s in range(0, len(first), 256):        # a few features' histories at a time
        part = first[s:s + 256]
        end = first[s + 256] if s + 256 < len(first) else len(order)
        sub = order[part[0]:end]
        p = np.exp(class_log_probabilities(own[sub], weights)) * total[sub, None]
        expected[row[order[part]]] = np.add.reduceat(p, part - part[0], axis=0)
    return held, expected


def step(held: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Gradient over the logarithmic mean of held and expected counts."""
    return np.log((held + PRIOR) / (expected + PRIOR))


def fit(cells: DataFrame, sweeps: int = SWEEPS) -> np.ndarray:
    """Weights from a (code, cls, n) table by rounds of distributed updates.

    Spark adds up the tasks' sums per feature and class of one family, so what the
    driver collects is bounded by the model's size, whatever the corpus. Histories
    of the same last two classes are dealt to one task.
    """
    cells = cut(cells.repartition(TASKS, F.expr(f"code div {COARSE}")))
    spark = cells.sparkSession
    weights = np.zeros((sum(_ROWS), CLASSES))
    for k in range(sweeps * len(_ROWS)):
        family = k % len(_ROWS)
        sent = spark.sparkContext.broadcast(weights)

        def add(batches):
            got = [b for b in batches if b.num_rows]
            if got:
                code, cls, n = (np.concatenate([b.column(c).to_numpy() for b in got])
                                for c in ("code", "cls", "n"))
                held, expected = (x.ravel() for x in
                                  held_and_expected(code, cls, n, sent.value, family))
                at = np.flatnonzero((held > 0) | (expected > 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (at, held[at], expected[at])],
                    names=["at", "held", "expected"])
        sums = (cells.mapInArrow(add, "at long, held double, expected double").groupBy("at")
                .agg(F.sum("held").alias("held"), F.sum("expected").alias("expected")).toPandas())
        held, expected = np.zeros((2, _ROWS[family] * CLASSES))
        held[sums["at"]], expected[sums["at"]] = sums["held"], sums["expected"]
        weights[_FIRST[family]:_FIRST[family] + _ROWS[family]] += step(held, expected).reshape(-1, CLASSES)
        sent.unpersist()
    return weights


def train(docs: DataFrame, learn, word_rounds: int = 0) -> dict:
    """Counts and model from the rows where the boolean column ``learn`` is true;
    ``word_rounds``: rounds over the features of words (0: histories of classes only)."""
    rows = docs.where(learn).select("text")

    def count(batch: pa.RecordBatch) -> dict:
        words = Words(batch.column("text"))
        h, first, n = np.unique(words.hash, return_index=True, return_counts=True)
        return {"h": signed(h), "n": n, "sfx": suffix_classes(words)[first]}

    counts = cut(arrow_map(rows, count, "h long, n long, sfx int").groupBy("h")
                 .agg(F.sum("n").alias("n"), F.max("sfx").alias("sfx")))
    n_docs = rows.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, "h", "n", FREQUENT)
    keys, n_of = top.h.to_numpy(np.int64).view(np.uint64), top.n.to_numpy(np.int64)
    # words and types of every suffix class, without the words that are classes themselves
    size, places = np.zeros((CLASSES, 2)), np.ones((CLASSES, PLACES))
    for r in counts.where(~F.col("h").isin([int(x) for x in signed(keys[:OWN])])) \
            .groupBy("sfx", F.shiftrightunsigned("h", 64 - PLACE_BITS).alias("place")) \
            .agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        size[r.sfx] += r.n, r.v
        places[r.sfx, r.place] += r.n + r.v
    own_keys, own_counts = keys[:OWN], n_of[:OWN]

    def cells(batches):
        claim(__name__)
        lexis, n = Lexis(own_keys, own_counts), np.zeros(CONTEXTS * CLASSES, np.int64)
        for batch in batches:
            words = Words(batch.column("text"))
            code, cls, _ = histories(words, lexis(words)[0])
            np.add.at(n, code * CLASSES + cls, 1)
        met = np.flatnonzero(n)
        for s in range(0, len(met), 1 << 16):
            cell = met[s:s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n[cell])], names=["cell", "n"])

    table = (few(rows).mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
             .select(F.expr(f"cell div {CLASSES}").alias("code"),
                     F.expr(f"cell % {CLASSES}").alias("cls"), "n"))
    m = {"weights": fit(table), "keys": keys, "counts": n_of, "size": size, "table": counts,
         "tokens": int(total[0]) + n_docs, "types": int(total[1]) + (n_docs > 0), "ends": n_docs}
    if word_rounds:
        m |= {"places": places, "word_rows":
              1 << min(WORD_BITS, max(6, (m["types"] // WORDS_A_ROW).bit_length()))}
        m["word_weights"] = fit_words(rows, m, word_rounds)
    return m


def score(docs: DataFrame, learn, m: dict) -> DataFrame:
    """One row per text: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probabilities of the smoothed unigram and the model)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast({k: v for k, v in m.items() if k != "table"})
    state: dict = {}
    places = np.log10(m["size"].sum(axis=1) + 1)        # of p(token | class)
    places[:OWN + 1] = places[REPEAT] = 0

    def rows(batch: pa.RecordBatch) -> dict:
        m = sent.value
        if not state:
            state["lexis"] = Lexis(m["keys"], m["counts"])
            state["table"] = ClassTable(m["weights"])
        words = Words(batch.column("text"))
        cls_of, count_of = state["lexis"](words)
        code, cls, is_word = histories(words, cls_of)
        table = state["table"](code)
        if "word_weights" in m:
            features, place = word_histories(words, m["word_rows"])
            model = word_log_probabilities(code, cls, features, place, table, m["places"],
                                           m["word_weights"]) / np.log(10)
        else:
            model = table[code, cls].astype(float) / np.log(10) - places[cls]
        known = np.ones(len(code), bool) if m["ends"] else is_word.copy()
        n = np.full(len(code), m["ends"], np.int64)
        n[is_word] = count_of
        rare = n < 0
        known &= ~rare
        logs = np.log10(np.where(rare, 0, n) + 1.0)
        in_class = in_classes(cls)
        length = words.counts + 1
        start = np.cumsum(length) - length
        # a rare word's occurrences in its text, and those scored through its class
        doc, h = np.repeat(np.arange(len(length)), length)[rare], words.hash[count_of < 0]
        order = np.lexsort((h, doc))
        doc, h, through = doc[order], h[order], in_class[rare][order].astype(np.int64)
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))[:len(doc)]
        per_doc = np.bincount(doc[first], minlength=len(length))
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "n_tokens": length, "n_known": np.add.reduceat(known, start, dtype=np.int64),
                "base": np.add.reduceat(logs, start),
                "model": np.add.reduceat(model + logs * in_class, start),
                "rare": lists(signed(h[first]), per_doc),
                "times": lists(np.diff(np.append(first, len(doc))), per_doc),
                "scored": lists(np.add.reduceat(through, first) if len(first) else through, per_doc)}

    first = cut(arrow_map(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~learn).alias("held_out")),
        rows, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
              "model double, rare array<long>, times array<long>, scored array<long>")
        .withColumn("row", F.monotonically_increasing_id()))
    rest = first.select("row", F.explode(F.arrays_zip("rare", "times", "scored")).alias("r")) \
        .select("row", F.col("r.rare").alias("h"), F.col("r.times").alias("times"),
                F.col("r.scored").alias("scored"))
    found = (rest.join(m["table"].select("h", F.log10(F.col("n") + 1).alias("log")), "h")
             .groupBy("row").agg(F.sum("times").alias("known"),
                                 F.sum(F.col("times") * F.col("log")).alias("b"),
                                 F.sum(F.col("scored") * F.col("log")).alias("s")))
    space = float(np.log10(m["tokens"] + m["types"] + 1))
    zero = [F.coalesce(c, F.lit(0)) for c in ("known", "b", "s")]
    return (first.drop("rare", "times", "scored").join(found, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero[0]).alias("n_known"),
                    F.lit(m["tokens"]).cast("long").alias("train_tokens"),
                    (F.col("base") + zero[1] - F.col("n_tokens") * space).alias("base_score"),
                    (F.col("model") + zero[2]).alias("score")))
