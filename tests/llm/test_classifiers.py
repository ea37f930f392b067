import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import ODD
from daycast.llm import queries, quality, toxicity
from daycast.llm.common import table

MEDIUM = "/root/testdata/sf0.01"


def made(n=240, seed=1):
    """Documents with marks of poor quality (shouting) and insults with many endings."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}" for _ in range(60)]
        bad, rude = i % 4 == 0, i % 3 == 0
        if bad:
            w = [x.upper() + "!!" for x in w]
        if rude:
            for _ in range(3):
                w[rng.randrange(60)] = "vorx" + rng.choice(("en", "ist", "ung", "a", "o", "ier"))
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1, 1 if rude else 0))
    return rows, labels


@pytest.fixture(scope="module")
def labelled(spark, docs):
    rows, labels = made()
    return docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), \
        {i: (q, t) for i, q, t in labels}


def test_quality_learns(labelled):
    d, lab, truth = labelled
    got = {r.doc_id: r.score for r in quality.score(d, quality.train(d, lab)).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == truth[i][0] for i in held]) > 0.97


def test_toxicity_learns_and_knows_unseen_endings(labelled, docs):
    d, lab, truth = labelled
    model = toxicity.train(d, lab)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == truth[i][1] for i in held]) > 0.97
    new = docs([(1, "bal " * 20 + "vorxissimo"), (2, "bal " * 20 + "zzyzzx")])
    seen = {r.doc_id: r.score for r in toxicity.score(new, model).collect()}
    assert seen[1] > 0.7 > seen[2]


def test_labels_of_the_held_out_fold_are_not_learned(spark, labelled):
    d, lab, _ = labelled
    flipped = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1,
                                               1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score(d, quality.train(d, x)) for x in (lab, flipped))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("op", [quality, toxicity])
def test_odd_rows(spark, docs, labelled, op):
    d, lab, _ = labelled
    model = op.train(d, lab)
    got = op.score(docs(ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    empty = {round(r.score, 12) for r in got if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1
    assert op.score(docs([]), model).count() == 0


@pytest.mark.parametrize("op", [quality, toxicity])
def test_without_labels(spark, docs, op):
    none = spark.createDataFrame([(None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    got = op.score(docs(ODD), op.train(docs(ODD), none)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)


def test_repeated_label_rows_count_once(spark, labelled):
    d, lab, _ = labelled
    a, b = (quality.train(d, x) for x in (lab, lab.unionByName(lab)))
    assert np.array_equal(a, b)


def test_keep_good_keeps_all_columns(labelled):
    d, lab, truth = labelled
    out = quality.keep_good(d, quality.train(d, lab))
    assert out.columns == d.columns
    assert {r.doc_id for r in out.collect()} == {i for i, (q, _) in truth.items() if q}


def test_ftrl_separates_two_features():
    rows = [(np.array([1]), np.array([1.0]), 1.0), (np.array([2]), np.array([1.0]), 0.0)] * 30
    w = quality.ftrl(rows, bits=4)
    assert w[1] > 0 > w[2]


def test_shared_backoff_is_a_distribution():
    code, _ = toxicity.grams([b"abcabd", b"abx", b"bcd", b"xyz"])
    codes = np.unique(code)
    p = toxicity.shared_backoff(codes)
    ctx = toxicity._ends(codes >> np.uint64(8), toxicity.ORDER - 2)
    for c in np.unique(ctx):
        last = {int(x & np.uint64(0xFF)): v for x, v in zip(codes[ctx == c], p[ctx == c])}
        assert 0 < sum(last.values()) <= 1 + 1e-9


def test_unseen_spelling_is_neutral():
    code, _ = toxicity.grams([b"rude", b"kind"])
    m = toxicity.model(np.unique(code), np.ones(len(np.unique(code))), np.ones(len(np.unique(code))))
    llr, stem_of = toxicity.word_llr([b"rude", b"qqqqqqqq"], m)
    assert np.allclose(llr, 0) and not stem_of


def test_a_stem_is_known_under_any_ending():
    """Evidence of a beginning is the sum of its bytes' differences from the start on."""
    toxic = [b"grumba", b"grumbo", b"grumbi", b"house"]
    plain = [b"garden", b"house", b"grass", b"umbrella"]
    codes = [toxicity.grams(w)[0] for w in (toxic, plain)]
    every = np.unique(np.concatenate(codes))
    n = [np.array([(c == g).sum() for g in every], float) * 50 for c in codes]
    m = toxicity.model(every, *n)
    _, stem_of = toxicity.word_llr([b"grumbxyz", b"house", b"agrumb"], m)
    assert list(stem_of) == [b"grumbxyz"]
    by = dict(zip(every.tolist(), m["gram_llr"].tolist()))
    code = toxicity.grams([b"grumb"])[0][:5].tolist()
    total = np.cumsum([by[c] for c in code])
    want = {c: v for c, v in zip(code, total) if v >= toxicity.LEAST_STEM}
    got = {int(m["stem"][k]): m["stem_llr"][k] for k in stem_of[b"grumbxyz"]}
    assert got == pytest.approx(want) and want
    x = toxicity.Evidence(m)([b"grumba grumbo grumbi grumba house", b"house", b""])
    assert x[0, 1] >= 3 * max(want.values()) - 1e-9 and x[1, 0] == 0 and not x[2].any()


def test_held_out_recall_and_precision_of_toxicity(spark):
    """In every language there is, though the language is not looked at."""
    folder = "/root/testdata/sf0.1"
    out = queries.QUERIES["op8_toxicity"](spark, folder)
    rows = (out.where("held_out").join(table(spark, folder, "labels"), "doc_id")
            .join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id").collect())
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits >= 0.9 * sum(r.toxic for r in rows) and hits >= 0.93 * sum(r.predicted for r in rows)
    for lang in {r.lang for r in rows}:
        own = [r for r in rows if r.lang == lang and r.toxic]
        assert sum(r.predicted for r in own) >= 0.75 * len(own), lang


@pytest.mark.parametrize("name,label,least", [("op1_quality", "quality", 0.95), ("op8_toxicity", "toxic", 0.95)])
def test_held_out_accuracy_of_the_query(spark, name, label, least):
    out = queries.QUERIES[name](spark, MEDIUM)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(table(spark, MEDIUM, "labels"), "doc_id").where("held_out").collect()
    assert out.count() == table(spark, MEDIUM, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == r[label] for r in rows]) >= least


def brute_ftrl(rows, epochs):
    """Sequential FTRL-proximal updates, a number at a time."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= quality.L1:
            return 0.0
        return -(zi - np.sign(zi) * quality.L1) / ((quality.BETA + np.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)
    for _ in range(epochs):
        for slots, values, y in rows:
            pairs = [*zip(slots.tolist(), values.tolist()), ("bias", 1.0)]
            w = {i: weight(i) for i, _ in pairs}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - y) * v
                old = n.get(i, 0.0)
                sigma = (np.sqrt(old + g * g) - np.sqrt(old)) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = old + g * g
    return {i: weight(i) for i in z}


def test_ftrl_against_brute_force():
    rng = np.random.default_rng(6)
    rows = []
    for k in range(60):
        slots, values = quality._sparse(" ".join(rng.choice(["a", "b", "c", "dd", "E1"], 12)).encode())
        rows.append((slots, values, float(k % 3 == 0)))
    got, want = quality.ftrl(rows), brute_ftrl(rows, quality.EPOCHS)
    assert got[-1] == pytest.approx(want.pop("bias"))
    assert np.flatnonzero(got[:-1]).tolist() == sorted(i for i, w in want.items() if w)
    for i, w in want.items():
        assert got[i] == pytest.approx(w)


def test_score_is_the_sum_of_its_features():
    text = b"One two two, 3rd LINE of words words"
    weights = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1)
    slots, values = quality.features(text)
    total = weights[-1] + sum(weights[i] * v for i, v in zip(slots.tolist(), values.tolist()))
    assert quality.scores([text, b""], weights) == pytest.approx([1 / (1 + np.exp(-total)), 1 / (1 + np.exp(-weights[-1]))])
    n = len(text.split())
    assert len(slots) == n + (n - 1) + n + (n - 1) + (n - 2) and values.sum() == pytest.approx(5)


def test_word_shapes_look_at_whole_words():
    long_ = b"a" * 80 + b"Z9"
    assert quality._shape(long_) == b"aA0" and quality._shape(b"-a" * 9) == b"-a" * 9


@pytest.mark.parametrize("op", [quality, toxicity])
def test_clashing_columns_of_the_labels(labelled, op):
    d, lab, _ = labelled
    wide = lab.withColumns({c: F.lit("x") for c in ("text", "y", "h", "score", "shard", "slots", "code", "held_out")})
    a, b = (sorted(map(tuple, op.score(d, op.train(d, x)).collect()), key=str) for x in (lab, wide))
    assert a == b
