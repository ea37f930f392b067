"""Toxicity: class-conditional Kneser-Ney models of word spellings.

Two models, toxic and ordinary, give the probability of each byte of a word after
the bytes before it: all of them back to the word's start for its first ``ORDER - 1``
bytes, the last ``LATE - 1`` for later ones (word start and end are bytes of their
own). The highest order holds class counts (a document counts each word once), with
absolute discounting. All lower orders are one Kneser-Ney model of continuation
counts pooled over both classes. So an expression neither class has seen backs
off to the same value in both and is neutral.

The differences of the two log-likelihoods, added up from a word's start, are the
evidence of its beginnings: a stem is recognised under any ending, in any language.
A document is described by its strongest beginning, by the beginning whose evidence
times the number of different words that have it is largest (an expression in many
forms), by its length, which both are read against, and by the mean difference per
word over the whole text (length-normalised). A logistic map of these, fitted on
documents the counts have not seen (two-fold cross-fitting), gives the score.

Cases: null or empty text has zero evidence; rows without label, or with a null
id, are scored only; repeated label rows count once (largest label); without
both classes in the sample every score is 0; empty tables give empty results;
other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daycast.llm.common import CACHE_WORDS, arrow_map, mix, texts
from daycast.llm.quality import labelled

ORDER = 8                 # bytes of the longest gram; a gram is packed in one integer
LATE = 6                  # bytes of a gram that does not reach back to the word's start
DISCOUNT = 0.75
LEAST_STEM = 1.5          # evidence from which on a beginning of words is looked for
EVIDENCE = 4              # numbers that describe a document
# Labelled rows learned from, at most, of each class (smallest id hashes).
SAMPLE_PER_CLASS = 5_000
_START, _END = b"\x01", b"\x02"
_PAD = b"\x00" * (ORDER - 2) + _START


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(packed grams of all predicted bytes, number of grams of each word)."""
    buf = np.frombuffer(b"".join(_PAD + w + _END for w in words), np.uint8).astype(np.uint64)
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    starts = np.cumsum(lengths + len(_PAD)) - lengths          # of the predicted bytes
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.repeat(starts, lengths) + place
    code = np.zeros(len(at), np.uint64)
    for k in range(ORDER - 1, -1, -1):
        code = (code << np.uint64(8)) | buf[at - k]
    late = place >= ORDER - 1
    code[late] = _ends(code[late], LATE)
    return code, lengths


def _ends(values: np.ndarray, order: int) -> np.ndarray:
    return values & np.uint64((1 << (8 * order)) - 1)


def shared_backoff(codes: np.ndarray) -> np.ndarray:
    """Pooled Kneser-Ney probability of each gram's last byte after its last
    ``ORDER - 2`` bytes, from continuation counts alone."""
    p = np.full(len(codes), 1.0 / 256)
    level = {ORDER: np.unique(codes)}
    for k in range(ORDER - 1, 0, -1):
        level[k] = np.unique(_ends(level[k + 1], k))
    for k in range(1, ORDER):
        g, cont = np.unique(_ends(level[k + 1], k), return_counts=True)
        ctx, first = np.unique(g >> np.uint64(8), return_index=True)
        total = np.add.reduceat(cont, first)
        kinds = np.diff(np.append(first, len(g)))
        own = _ends(codes, k)
        i, j = np.searchsorted(g, own), np.searchsorted(ctx, own >> np.uint64(8))
        p = np.maximum(cont[i] - DISCOUNT, 0) / total[j] + DISCOUNT * kinds[j] / total[j] * p
    return p


def model(codes: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> dict[str, np.ndarray]:
    """Log-likelihood difference of every seen gram, and of its context alone."""
    keep = (toxic + ordinary) > 0
    codes, toxic, ordinary = codes[keep], toxic[keep].astype(float), ordinary[keep].astype(float)
    order = np.argsort(codes)
    codes, toxic, ordinary = codes[order], toxic[order], ordinary[order]
    if not len(codes):
        e = np.zeros(0)
        return {"gram": codes, "gram_llr": e, "ctx": codes, "ctx_llr": e, "stem": codes, "stem_llr": e}
    back = shared_backoff(codes)
    ctx, first, at = np.unique(codes >> np.uint64(8), return_index=True, return_inverse=True)
    logs, lam = [], []
    for n in (toxic, ordinary):
        total = np.add.reduceat(n, first)
        kinds = np.add.reduceat((n > 0).astype(float), first)
        seen = total > 0
        weight = np.where(seen, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        own = np.where(seen[at], np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[at], 0.0)
        logs.append(np.log(own + weight[at] * back))
        lam.append(np.log(weight))
    llr = logs[0] - logs[1]
    stem, stem_llr = stems(codes, llr)
    return {"gram": codes, "gram_llr": llr, "ctx": ctx, "ctx_llr": lam[0] - lam[1],
            "stem": stem, "stem_llr": stem_llr}


def stems(codes: np.ndarray, llr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings of words (grams that reach back to the start) with their evidence, the
    sum from the start on, of those that favour toxic."""
    found, known, value = [], np.array([_START[0]], np.uint64), np.zeros(1)
    while len(known):                            # a byte longer each time
        up = codes >> np.uint64(8)
        at = np.minimum(np.searchsorted(known, up), len(known) - 1)
        on = known[at] == up
        known, value = codes[on], llr[on] + value[at[on]]
        strong = value >= LEAST_STEM
        found.append((known[strong], value[strong]))
    stem, evidence = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(stem)
    return stem[order], evidence[order]


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray):
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[i] == wanted
    return np.where(hit, values[i], 0.0), hit


def word_llr(words: list[bytes], m: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[bytes, list[int]]]:
    """Toxic minus ordinary log-likelihood of each word, and of the words that begin in a
    telling way the places of these beginnings among the model's."""
    if not words:
        return np.zeros(0), {}
    code, lengths = grams(words)
    llr, hit = _find(m["gram"], m["gram_llr"], code)
    miss = ~hit
    llr[miss] = _find(m["ctx"], m["ctx_llr"], code[miss] >> np.uint64(8))[0]
    stem_of: dict[bytes, list[int]] = {}
    if len(m["stem"]):
        at = np.minimum(np.searchsorted(m["stem"], code), len(m["stem"]) - 1)
        on = np.flatnonzero(m["stem"][at] == code)
        owner = np.repeat(np.arange(len(words)), lengths)[on]
        for w, k in zip(owner.tolist(), at[on].tolist()):
            stem_of.setdefault(words[w], []).append(k)
    return np.add.reduceat(llr, np.cumsum(lengths) - lengths), stem_of


class Evidence:
    """Per-document evidence, remembering the words met in a task."""

    def __init__(self, m: dict[str, np.ndarray]):
        self.m, self.known, self.stems = m, {}, {}

    def __call__(self, batch: list[bytes]) -> np.ndarray:
        words = [t.lower().split() for t in batch]
        if len(self.known) > CACHE_WORDS:
            self.known, self.stems = {}, {}
        new = list(set().union(*words).difference(self.known))
        for at in range(0, len(new), 50_000):
            part = new[at:at + 50_000]
            llr, stem_of = word_llr(part, self.m)
            self.known.update(zip(part, llr.tolist()))
            self.stems.update(stem_of)
        out = np.zeros((len(batch), EVIDENCE))
        for j, ws in enumerate(words):
            if not ws:
                continue
            found = [k for w in self.stems.keys() & set(ws) for k in self.stems[w]]
            if found:
                stem, n = np.unique(found, return_counts=True)
                value = self.m["stem_llr"][stem]
                out[j, :2] = value.max(), (n * value).max()
            out[j, 2] = np.log1p(len(ws))
            out[j, 3] = sum(map(self.known.__getitem__, ws)) / len(ws)
        return out


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights (bias last), the two classes weighted alike, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    s = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        g = a.T @ (s * (p - y)) + ridge * len(y) * np.append(w[:-1], 0) * 0.01
        h = (a * (s * p * (1 - p))[:, None]).T @ a + np.eye(len(w)) * (ridge * len(y) * 0.01 + 1e-6)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _half(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64) + np.uint64(99)) >> np.uint64(63)).astype(int)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic",
          per_class: int = SAMPLE_PER_CLASS) -> dict[str, np.ndarray] | None:
    """Model and calibration from a bounded labelled sample; None without both classes."""
    sample = labelled(docs, labels, label, rows=per_class, per_class=True)

    def count(batch: pa.RecordBatch) -> dict:
        ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
        group = 2 * _half(ids) + (1 - batch.column("y").to_numpy(zero_copy_only=False))
        codes, groups = [np.zeros(0, np.uint64)], [np.zeros(0, int)]
        for t, g in zip(texts(batch.column("text")), group):
            words = list(set(t.lower().split()))
            if words:
                codes.append(grams(words)[0])
                groups.append(np.full(len(codes[-1]), g))
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        groups = np.concatenate(groups)
        return {"code": code.view(np.int64)} | {
            f"n{g}": np.bincount(at[groups == g], minlength=len(code)) for g in range(4)}

    counted = arrow_map(sample, count, "code long, n0 long, n1 long, n2 long, n3 long")
    got = counted.groupBy("code").agg(*[F.sum(f"n{g}").cast("int").alias(f"n{g}") for g in range(4)]).toArrow()
    n = [got[f"n{g}"].to_numpy() for g in range(4)]         # half 0 toxic, ordinary, half 1 ...
    codes = got["code"].to_numpy().view(np.uint64)
    del got
    if not (n[0] + n[2]).sum() or not (n[1] + n[3]).sum():
        return None
    # for half 0: counts of half 1; one model at a time on the driver
    other = [docs.sparkSession.sparkContext.broadcast(model(codes, *n[2 * h:2 * h + 2])) for h in (1, 0)]

    def evidence(batch: pa.RecordBatch) -> dict:
        half = _half(batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False))
        body = texts(batch.column("text"))
        x = np.zeros((len(body), EVIDENCE))
        for h in (0, 1):
            own = np.flatnonzero(half == h)
            x[own] = Evidence(other[h].value)([body[i] for i in own])
        return {"y": batch.column("y")} | {f"x{k}": x[:, k] for k in range(EVIDENCE)}

    names = [f"x{k}" for k in range(EVIDENCE)]
    seen = arrow_map(sample, evidence, ", ".join(["y int", *(f"{n} double" for n in names)])).toPandas()
    x = seen[names].to_numpy()
    scale = np.maximum(x.std(axis=0), 1e-9)
    w = calibrate(x / scale, seen.y.to_numpy(float))
    for half in other:
        half.unpersist()
    return model(codes, n[0] + n[2], n[1] + n[3]) | {"weights": np.append(w[:-1] / scale, w[-1])}


def score(docs: DataFrame, m: dict[str, np.ndarray] | None) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(m)
    state: dict = {}

    def rows(batch: pa.RecordBatch) -> dict:
        body = texts(batch.column("text"))
        if sent.value is None:
            return {"doc_id": batch.column("doc_id"), "score": np.zeros(len(body))}
        evidence = state.setdefault("evidence", Evidence(sent.value))
        z = evidence(body) @ sent.value["weights"][:-1] + sent.value["weights"][-1]
        return {"doc_id": batch.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(z, -35, 35)))}
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows,
                     "doc_id long, score double")
