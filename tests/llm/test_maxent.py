import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import ODD
from daycast.llm import maxent, queries
from daycast.llm.common import Words, table

SMALL = "/root/testdata/sf0.001"


def brute(rows):
    tok = [(t or "").encode().lower().split() + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter()
    for t, h in zip(tok, held):
        if not h:
            c.update(t)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
            for (i, _), t, h in zip(rows, tok, held)]


def check(got, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    want = sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


@pytest.mark.parametrize("frequent", [40, 1 << 18])
def test_whole_table(spark, monkeypatch, frequent):
    monkeypatch.setattr(maxent, "FREQUENT", frequent)
    got = queries.QUERIES["op7_maxent"](spark, SMALL).collect()
    check(got, [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def scored(docs):
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    return maxent.score(docs, learn, maxent.train(docs, learn)).collect()


def test_odd_rows(docs):
    got = scored(docs(ODD))
    check(got, ODD)
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)


def test_empty_table(docs):
    assert scored(docs([])) == []


def test_nothing_to_learn_from(docs):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = scored(docs([(i, "a b c") for i in ids]))
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)


def test_probabilities_sum_to_one(spark, docs):
    """Over the vocabulary, each class' unknown place and the end, after any history."""
    rows = [(k, "the cat sat on the mat. the dog ate, the cat ran") for k in range(20) if k % 2 == 0]
    d = docs(rows)
    m = maxent.train(d, F.lit(True))
    codes = np.arange(0, maxent.CONTEXTS, 997)
    p = np.exp(maxent.class_log_probabilities(codes, m["weights"]))
    assert np.allclose(p.sum(axis=1), 1)
    c = Counter(w for _, t in rows for w in t.split())
    names = list(c)
    w = Words([" ".join(names).encode()])
    cls, _ = maxent.Lexis(m["keys"], m["counts"])(w)
    mass = np.zeros(maxent.CLASSES)
    for word, k in zip(names, cls):
        n, v = m["size"][k]
        mass[k] += 1 if k < maxent.OWN else (c[word] + 1) / (n + v + 1)
    for k in range(maxent.END_CLASS + 1, maxent.REPEAT):
        mass[k] += 1 / (m["size"][k].sum() + 1)
    used = [k for k in range(maxent.CLASSES) if k not in (maxent.END_CLASS, maxent.REPEAT)
            and (k > maxent.OWN or k in cls)]
    assert np.allclose(mass[used], 1)


def test_updates_never_lower_the_likelihood():
    rng = np.random.default_rng(0)
    codes, cls = rng.integers(0, maxent.CONTEXTS, 3000), rng.integers(0, 12, 3000)
    cls = np.where(codes % 3 == 0, 5, cls)
    n = rng.integers(1, 9, 3000).astype(float)
    weights = np.zeros((sum(maxent._ROWS), maxent.CLASSES))
    best = -np.inf
    for k in range(12):
        f = k % 6
        weights[maxent._FIRST[f]:maxent._FIRST[f] + maxent._ROWS[f]] += maxent.step(
            *maxent.held_and_expected(codes, cls, n, weights, f))
        now = (maxent.class_log_probabilities(codes, weights)[np.arange(3000), cls] * n).sum()
        assert now > best - 1
        best = now


def brute_model(rows, held):
    """The model by loops over single tokens: classes, weights of every round, and the log10
    probability of each text."""
    def tokens(t):
        return (t or "").encode().lower().split()
    train = [tokens(t) for (_, t), h in zip(rows, held) if not h]
    counts = Counter(w for t in train for w in t)
    hashes = {w: int(Words([w]).hash[0]) for t in [tokens(t) for _, t in rows] for w in t}
    own = sorted(counts, key=lambda w: (-counts[w], np.uint64(hashes[w]).astype(np.int64)))[:maxent.OWN]
    suffix = {w: int(maxent.suffix_classes(Words([w]))[0]) for w in hashes}
    coarse = {w: int(maxent.coarse_classes(Words([w]))[0]) for w in hashes}
    base = {w: own.index(w) if w in own else suffix[w] for w in hashes}

    def steps(ws):
        """(history code, class, word) of every token of a text."""
        cls = [maxent.REPEAT if k and w == ws[k - 1] else base[w] for k, w in enumerate(ws)] + [maxent.END_CLASS]
        for k, c in enumerate(cls):
            one, two = (cls[k - j] if k >= j else maxent.START for j in (1, 2))
            three = coarse[ws[k - 3]] if k >= 3 else maxent.COARSE - 1
            yield (one * maxent.WIDE + two) * maxent.COARSE + three, c, ws[k] if k < len(ws) else None

    cells = Counter((h, c) for t in train for h, c, _ in steps(t))
    histories = Counter()
    for (h, _), n in cells.items():
        histories[h] += n
    features = {h: maxent.feature_rows(np.array([h]))[0] for h in histories}
    weights = np.zeros((sum(maxent._ROWS), maxent.CLASSES))

    def probabilities(h):
        z = [sum(weights[r, c] for r in features[h]) for c in range(maxent.CLASSES)]
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]
    for k in range(maxent.SWEEPS * len(maxent._ROWS)):
        family = k % len(maxent._ROWS)
        held_n, expected = Counter(), Counter()
        for (h, c), n in cells.items():
            held_n[features[h][family], c] += n
        for h, n in histories.items():
            for c, p in enumerate(probabilities(h)):
                expected[features[h][family], c] += n * p
        for r in {f[family] for f in features.values()}:
            for c in range(maxent.CLASSES):
                weights[r, c] += math.log((held_n[r, c] + maxent.PRIOR) / (expected[r, c] + maxent.PRIOR))
    words, types = Counter(), Counter()
    for w, n in counts.items():
        if w not in own:
            words[suffix[w]] += n
            types[suffix[w]] += 1
    out = []
    for _, t in rows:
        total = 0.0
        for h, c, w in steps(tokens(t)):
            if h not in features:
                features[h] = maxent.feature_rows(np.array([h]))[0]
            total += math.log10(probabilities(h)[c])
            if maxent.END_CLASS < c < maxent.REPEAT:
                total += math.log10((counts[w] + 1) / (words[c] + types[c] + 1))
        out.append(total)
    return out


def test_model_score_against_brute_force(docs):
    rng = np.random.default_rng(2)
    names = [f"{a}{b}{c}" for a in "bdgk" for b in ("an", "or", "el") for c in ("", "s", "ed", ".", ",")]
    share = rng.dirichlet(np.full(len(names), 0.4))
    rows = [(int(i), " ".join(rng.choice(names, int(rng.integers(0, 25)), p=share))) for i in range(40)]
    rows += [(50, "bans Bans bans kor, new"), (51, None)]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    got = {r.doc_id: r.score for r in scored(docs(rows))}
    want = {i: s for (i, _), s in zip(rows, brute_model(rows, held))}
    assert any(held) and got == pytest.approx(want, rel=1e-4)


def brute_words(rows, held, m, rounds):
    """The model with word features by loops over single tokens, from the model of classes."""
    def tokens(t):
        words = Words([(t or "").encode()])
        code, cls, _ = maxent.histories(words, maxent.Lexis(m["keys"], m["counts"])(words)[0])
        features, place = maxent.word_histories(words, m["word_rows"])
        base = np.exp(maxent.class_log_probabilities(code, m["weights"]))
        return list(zip(base, cls, zip(*features), place, (t or "").encode().lower().split() + [None]))
    many = range(maxent.END_CLASS + 1, maxent.REPEAT)
    docs = [tokens(t) for _, t in rows]
    counts = Counter()
    for t, h in zip(docs, held):
        for _, c, _, s, w in t:
            if not h and w:
                counts[w] += 1
    names = list(counts)
    w = Words([b" ".join(names)])
    own, places = maxent.Lexis(m["keys"][:maxent.OWN], m["counts"][:maxent.OWN])(w)[0], Counter()
    for name, c, h in zip(names, own, w.hash):
        if c >= maxent.OWN:
            places[c, int(h) >> 64 - maxent.PLACE_BITS] += counts[name] + 1
    u, v = Counter(), Counter()

    def probabilities(base, c, features):
        p = base * [math.exp(sum(u[f, k] for f in features)) for k in range(maxent.CLASSES)]
        q = np.array([(places[c, k] + 1) * math.exp(sum(v[f, k] for f in features)) for k in range(maxent.PLACES)])
        return p / p.sum(), q / q.sum()
    for _ in range(rounds):
        held_u, held_v, expected_u, expected_v = Counter(), Counter(), Counter(), Counter()
        for t, h in zip(docs, held):
            for base, c, features, s, _ in [] if h else t:
                p, q = probabilities(base, c, features)
                for f in features:
                    held_u[f, c] += 1
                    for k in range(maxent.CLASSES):
                        expected_u[f, k] += p[k]
                    if c in many:
                        held_v[f, s] += 1
                        for k in range(maxent.PLACES):
                            expected_v[f, k] += q[k]
        for weights, got, want in ((u, held_u, expected_u), (v, held_v, expected_v)):
            for k in want:
                weights[k] += math.log((got[k] + maxent.PRIOR) / (want[k] + maxent.PRIOR)) / maxent.WORD_FAMILIES
    out = []
    for t in docs:
        total = 0.0
        for base, c, features, s, name in t:
            p, q = probabilities(base, c, features)
            total += math.log10(p[c])
            if c in many:
                total += math.log10(q[s] * (counts[name] + 1) / (places[c, s] + 1))
        out.append(total)
    return out


@pytest.mark.parametrize("rounds, frequent", [(1, 1 << 18), (2, 40)])
def test_word_features_against_brute_force(docs, monkeypatch, rounds, frequent):
    monkeypatch.setattr(maxent, "FREQUENT", frequent)
    rng = np.random.default_rng(3)
    names = [f"{a}{b}{c}" for a in "bdgk" for b in ("an", "or", "el") for c in ("", "s", "ed", ".", ",")]
    share = rng.dirichlet(np.full(len(names), 0.4))
    rows = [(int(i), " ".join(rng.choice(names, int(rng.integers(0, 25)), p=share))) for i in range(40)]
    rows += [(50, "bans Bans bans kor, new"), (51, None), (52, "new newer")]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    d = docs(rows)
    learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    m = maxent.train(d, learn, rounds)
    got = {r.doc_id: r.score for r in maxent.score(d, learn, m).collect()}
    want = {i: s for (i, _), s in zip(rows, brute_words(rows, held, m, rounds))}
    assert any(held) and got == pytest.approx(want, rel=1e-4)


def test_words_of_any_history_sum_to_one(docs):
    rows = [(k, f"the cat sat on the mat. the dog ate, w{k} the cat ran w{k}x w{k % 7}y") for k in range(60)]
    m = maxent.train(docs(rows), F.lit(True), 2)
    table = maxent.ClassTable(m["weights"])
    c = Counter(w for _, t in rows for w in t.split())
    words = Words([" ".join(c).encode()])
    cls, _ = maxent.Lexis(m["keys"], m["counts"])(words)
    place = (words.hash >> np.uint64(64 - maxent.PLACE_BITS)).astype(int)
    outcomes = [(k, 0, 0) for k in (*range(maxent.END_CLASS + 1), maxent.REPEAT)]
    outcomes += [(k, s, n) for k, s, n in zip(cls, place, c.values()) if k >= maxent.OWN]
    outcomes += [(k, s, 0) for k in range(maxent.END_CLASS + 1, maxent.REPEAT) for s in range(maxent.PLACES)]
    cls, place, n = (np.array(x) for x in zip(*outcomes))
    rng = np.random.default_rng(1)
    assert all(w.any() for w in m["word_weights"])
    for _ in range(20):
        code = np.full(len(cls), rng.integers(0, maxent.CONTEXTS))
        features = [np.full(len(cls), f * m["word_rows"] + rng.integers(0, m["word_rows"]))
                    for f in range(maxent.WORD_FAMILIES)]
        p = np.exp(maxent.word_log_probabilities(code, cls, features, place, table(code), m["places"],
                                                 m["word_weights"]))
        assert (p * (n + 1)).sum() == pytest.approx(1, rel=1e-4)


def test_words_of_one_class_are_told_apart_by_the_words_before(spark, tmp_path):
    """Equal counts, suffixes and classes: only pairs and skip pairs of the words differ."""
    rng = np.random.default_rng(5)
    a, b = ([f"{x}{y}an" for y in "bcdfghjk"] for x in "kt")
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 7 == 2]
    common = [f"f{k:02d}" for k in range(maxent.OWN)]
    rows = []
    for i in ids:
        k, j = rng.integers(0, 8, 2)
        x, y, z = rng.choice(common, 3)
        rows.append((i, f"{x} {a[k]} {b[k]} {y} {a[j].upper()} {z} {b[j]} " + " ".join(common)))
    tests = [(seen, skip, k, (k + (not seen) * (1 + k % 3)) % 8) for seen in (True, False)
             for skip in (True, False) for k in range(8)]
    rows += [(i, f"f00 {a[k]} {'f01 ' if skip else ''}{b[j]} f02") for i, (_, skip, k, j) in zip(held, tests)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score - r.base_score for r in queries.QUERIES["op7_maxent"](spark, str(tmp_path)).collect()}
    for skip in (True, False):
        seen, unseen = ([got[i] for i, (s, p, _, _) in zip(held, tests) if (s, p) == (x, skip)] for x in (True, False))
        assert np.mean(seen) > np.mean(unseen) + 0.1


@pytest.mark.parametrize("rows", [ODD, [], [(i, "a b c") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]])
def test_word_features_on_odd_tables(docs, rows):
    """Odd rows, no rows, and none to learn from."""
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    d = docs(rows)
    got = maxent.score(d, learn, maxent.train(d, learn, 2)).collect()
    check(got, rows)
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)
