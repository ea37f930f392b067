import random

import numpy as np
import pytest

from conftest import ODD, words
from daycast.llm import jaccard
from daycast.llm.common import table

SMALL = "/root/testdata/sf0.001"


def brute(rows):
    """Shingle sets of words, all pairs, components named by their smallest id."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i)
                   for k, (i, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        out.append(" ".join(w))
    return out


def mixed_rows(seed=3):
    rng = random.Random(seed)
    rows, i = [], 10
    shared = [f"pass{k}" for k in range(40)]
    for g in range(8):
        base = [f"g{g}w{k}" for k in range(rng.choice((6, 30, 120, 200)))]
        for t in near_copies(rng, base, rng.choice((1, 4, 25)), 4):
            rows.append((i, t))
            i += 1
    for k in range(12):       # texts that share a passage only
        rows.append((i, " ".join([f"own{k}q{j}" for j in range(30)] + shared)))
        i += 1
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(docs):
    rows = mixed_rows()
    assert got(jaccard.groups(docs(rows))) == brute(rows)


def test_matches_brute_force_in_many_chunks(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_WEIGHT", 3000)
    rows = mixed_rows(11)
    assert got(jaccard.groups(docs(rows))) == brute(rows)


def test_odd_rows(docs):
    assert got(jaccard.groups(docs(ODD))) == brute(ODD)


def test_same_id_with_other_texts(docs):
    rows = [(1, words(*range(30))), (1, words(*range(50, 90))), (2, words(*range(30), 31)),
            (3, words(*range(50, 91)))]
    assert {r[0]: None for r in got(jaccard.groups(docs(rows)))} == {1: None, 2: None, 3: None}


def test_empty_table(docs):
    out = jaccard.groups(docs([]))
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.count() == 0


def test_least_similarity_is_met_exactly(docs):
    # 9 shingles of which 8 are shared: 8 / 10 is linked, 7 / 9 is not
    a = words(*range(13))
    rows = [(1, a), (2, a.rsplit(" ", 1)[0] + " other"), (3, words(*range(100, 112))),
            (4, words(*range(100, 110), 200, 201))]
    assert got(jaccard.groups(docs(rows))) == brute(rows)


@pytest.mark.parametrize("side", [False, True])
def test_tree_traversal_loses_no_pair(side):
    rng = random.Random(8)
    texts = near_copies(rng, [f"w{k}" for k in range(90)], 60, 6) + [
        " ".join(f"z{rng.randrange(200)}" for _ in range(rng.randrange(5, 120))) for _ in range(60)]
    sets = jaccard.sets([t.encode() for t in texts])
    lab = np.arange(len(sets))
    half = len(sets) // 2
    bits = jaccard.bits_for(sets)
    if side:
        x, y = (jaccard.Tree(sets[s], lab[s], bits) for s in (slice(0, half), slice(half, None)))
    else:
        x = y = jaccard.Tree(sets, lab, bits)
    i, j = jaccard.traverse(x, y)
    found = {frozenset((int(x.labels[a]), int(y.labels[b]))) for a, b in zip(i, j)}
    for a in range(len(sets)):
        for b in range(a):
            if jaccard.linked(sets[a], sets[b]) and (not side or (b < half <= a)):
                assert frozenset((a, b)) in found


def test_whole_small_table(spark):
    d = table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    assert got(jaccard.groups(d)) == brute(rows)
