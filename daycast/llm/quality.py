"""Quality classifier: hashed word n-grams, logistic regression by FTRL.

A text's features are hashed into ``2**BITS`` slots: its words and word pairs
(A-Z lowered), and runs of one to three word shapes (letter runs reduced to one
letter, other bytes kept, with a mark where a word repeats the one before).
Every family's values sum to 1, so a score is a sparse dot product of relative
frequencies and does not depend on length. Training: the labelled rows are
dealt over ``SHARDS`` tasks, each runs follow-the-regularised-leader over its
share, and the weights are averaged per slot (parameter mixing).

Cases: a null or empty text has no features, its score is the bias alone; rows
without a label or with a null id are scored, not learned from; repeated label
rows count once (largest label); ties in the sample's order are broken by id;
empty tables give an empty result, no labels a score of 0.5 everywhere; other
columns are neither read nor returned.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daycast.llm.common import Cache, arrow_map, claim, fold, hash64, mix, texts

BITS = 18
SHARDS = 8
EPOCHS = 6
# Labelled rows learned from, at most: those of the smallest id hashes.
SAMPLE_ROWS = 24_000
ALPHA, BETA, L1, L2 = 0.6, 1.0, 0.002, 0.02

_LOWER = re.compile(rb"[a-z\x80-\xff]+")
_UPPER = re.compile(rb"[A-Z]+")
_DIGIT = re.compile(rb"[0-9]+")


def _shape(word: bytes) -> bytes:
    return _DIGIT.sub(b"0", _UPPER.sub(b"A", _LOWER.sub(b"a", word)))


def _word_key(word: bytes) -> int:
    """Word hash in the high 40 bits, shape hash in the low 24."""
    return (hash64(word.lower()) >> 24 << 24) | (hash64(_shape(word), 1) & 0xFFFFFF)


_KEYS = Cache(_word_key)


def features(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of one text, slots repeated per occurrence."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.float64)
    k = np.fromiter(map(_KEYS.__getitem__, words), np.uint64, n)
    w, s = k >> np.uint64(24), k & np.uint64(0xFFFFFF)
    same = np.zeros(n, np.uint64)
    same[1:] = w[1:] == w[:-1]
    s = s * np.uint64(2) + same
    five, nine = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
    runs = [w + np.uint64(11), w[:-1] * five + w[1:] + np.uint64(23),
            s + np.uint64(37 << 40), s[:-1] * five + s[1:] + np.uint64(41 << 40),
            s[:-2] * nine + s[1:-1] * five + s[2:] + np.uint64(43 << 40)]
    slots = np.concatenate([mix(mix(r)) >> np.uint64(64 - bits) for r in runs]).astype(np.int64)
    values = np.concatenate([np.full(len(r), 1.0 / max(1, len(r))) for r in runs])
    return slots, values


def _sparse(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    slots, values = features(text)
    if not len(slots):
        return slots, values
    u, inv = np.unique(slots, return_inverse=True)
    return u, np.bincount(inv, values)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int = BITS,
         epochs: int = EPOCHS) -> np.ndarray:
    """Weights (last entry: bias) of sequential FTRL-proximal updates."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    rows = [(np.append(i, 1 << bits), np.append(v, 1.0), y) for i, v, y in rows]

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0,
                        -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for i, v, y in rows:
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y) * v
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[i] = zi + g - sigma * w
            n[i] = ni + g * g
    return weights(z, n)


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int = 3, held: int = 1,
             rows: int = SAMPLE_ROWS, per_class: bool = False) -> DataFrame:
    """(doc_id, text, y): the bounded sample of labelled rows outside the held-out fold.

    At most ``rows`` rows (of each class with ``per_class``), those with the
    smallest id hashes; the sample is bounded, so it may be broadcast.
    """
    y = F.col(label).cast("int").alias("y")
    ids = (labels.select("doc_id", y).where(F.col("y").isin(0, 1) & (fold("doc_id", mod) != held))
           .groupBy("doc_id").agg(F.max("y").alias("y")))
    sizes = {r.y: r["count"] for r in ids.groupBy("y").count().collect()}
    h = F.xxhash64("doc_id")

    def smallest(part: DataFrame, n: int) -> DataFrame:
        """The ``rows`` smallest hashes; of many more, a bound on the hash first keeps
        the candidates few (half as many again as wanted), in all partitions together."""
        if n > 2 * rows:
            part = part.where(h < int(-2 ** 63 + 1.5 * rows / n * 2 ** 64))
        return part.orderBy(h, "doc_id").limit(rows)

    picked = smallest(ids, sum(sizes.values())) if not per_class else smallest(
        ids.where("y = 0"), sizes.get(0, 0)).unionByName(smallest(ids.where("y = 1"), sizes.get(1, 0)))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality",
          sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Averaged FTRL weights; the model has ``2**BITS + 1`` numbers at any size."""
    def sparse_rows(batch: pa.RecordBatch) -> dict:
        got = [_sparse(t) for t in texts(batch.column("text"))]
        ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
        return {"shard": (mix(ids.astype(np.uint64)) % np.uint64(SHARDS)).astype(np.int32),
                "doc_id": batch.column("doc_id"),
                "y": batch.column("y"),
                "slots": [g[0] for g in got], "vals": [g[1] for g in got]}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(o=mix(pdf.doc_id.to_numpy().astype(np.uint64) + np.uint64(7)))
        pdf = pdf.sort_values(["o", "doc_id"])
        w = ftrl([(np.asarray(r.slots), np.asarray(r.vals), float(r.y))
                  for r in pdf.itertuples()])
        slot = np.flatnonzero(w)
        return pd.DataFrame({"slot": slot, "w": w[slot], "shard": int(pdf.shard.iloc[0])})

    rows = arrow_map(labelled(docs, labels, label, rows=sample_rows), sparse_rows,
                     "shard int, doc_id long, y int, slots array<long>, vals array<double>")
    fitted = rows.groupBy("shard").applyInPandas(fit, "slot long, w double, shard int")
    got = fitted.groupBy("slot").agg(
        F.sum("w").alias("w"), F.collect_set("shard").alias("shards")).toPandas()
    out = np.zeros((1 << BITS) + 1)
    if len(got):
        shards = len(set().union(*map(set, got["shards"])))
        out[got.slot.to_numpy()] = got.w.to_numpy() / shards
    return out


def scores(batch_texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    bias = weights[-1]
    out = np.empty(len(batch_texts))
    for j, t in enumerate(batch_texts):
        slots, values = features(t)
        out[j] = bias + weights[slots] @ values if len(slots) else bias
    return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def rows(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"),
                "score": scores(texts(batch.column("text")), model.value)}
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows,
                     "doc_id long, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches):
        claim(__name__)
        for b in batches:
            yield b.filter(pa.array(scores(texts(b.column(at)), model.value) >= threshold))
    return docs.mapInArrow(run, docs.schema)
