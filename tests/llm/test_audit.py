import itertools
import re

import numpy as np

from daycast.llm import audit, queries
from daycast.plans.check import compare, duckdb_conn

MEDIUM = "/root/testdata/sf0.01"

DOCS = "doc_id long, text string, source string, lang string, mask long, part string, same string, first int"
LABELS = "doc_id long, quality int, toxic int, part string, mask int, good int"


def words(n, stem="w"):
    return " ".join(f"{stem}{i}" for i in range(n))


ROWS = [(1, None, "a"), (2, "", None), (3, words(60), ""), (4, words(60), "a"), (4, words(60), "a"),
        (5, "x " * 80, "a"), (6, words(70) + " 100%", "b"), (7, "AB CD " * 30, "b"), (7, words(60), "b"),
        (None, words(60), "a"), (None, "", "c"), (8, words(40_000), "a"), (9, "É   x" * 3, "a"),
        (10, "A" + "\U0001f642" * 19, "b"), (11, "A" + "\U0001f642" * 20, "b"), (12, words(49) + "\x0bX\x0c", "a"),
        (13, words(49) + "\x1cX", "a"), (0, words(60), "b"), (14, "x " * 80, "c"), (15, "# | " + words(55), None)]
MARKS = [(3, 1, 0), (3, 0, 1), (4, None, 1), (5, 1, None), (7, 1, 1), (None, 1, 1), (99, 1, 1), (8, 1, 0), (14, 1, 1)]


def brute(rows, marks):
    """Applies all orders document by document."""
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t in marks if t == 1 and i is not None}
    docs = []
    for i, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        docs.append((source or "", fails, i in good, i in toxic))
    out = {}
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for o in orders:
            left = list(mine)
            for s, f in enumerate(o, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                failing = sum(d[1][f] for d in mine)
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in mine)
                out[part, o, s] = [f, len(left), len(gone), failing - len(gone), alone,
                                   sum(d[2] for d in gone), sum(d[3] for d in gone)]
                share[f] += len(gone)
        for (p, o, s), v in out.items():
            if p == part:
                v.append(share[v[0]])
    return sorted((*k, *v) for k, v in out.items())


def frames(spark, rows, marks):
    return (spark.createDataFrame([(*r, "en", 9, "p", "s", 1) for r in rows], DOCS),
            spark.createDataFrame([(*m, "p", 3, 4) for m in marks], LABELS))


def test_matches_brute_force_on_odd_rows(spark):
    got = sorted(tuple(r) for r in audit.audit(*frames(spark, ROWS, MARKS)).collect())
    assert got == brute(ROWS, MARKS)
    assert len(got) == 4 * 120 * 5


def test_random_rows(spark):
    rng = np.random.default_rng(5)
    texts = [words(int(n), s) + end for n in (10, 49, 50, 80) for s in ("w", "W", "LONG") for end in ("", " a a", " $")]
    rows = [(int(i), texts[int(t)], f"s{s}") for i, t, s in
            zip(rng.integers(0, 200, 250), rng.integers(0, len(texts), 250), rng.integers(0, 5, 250))]
    marks = [(int(i), int(q), int(t)) for i, q, t in
             zip(rng.integers(0, 200, 80), rng.integers(0, 2, 80), rng.integers(0, 2, 80))]
    got = sorted(tuple(r) for r in audit.audit(*frames(spark, rows, marks)).collect())
    assert got == brute(rows, marks)


def test_empty_tables(spark):
    docs, marks = frames(spark, ROWS, MARKS)
    assert audit.audit(docs.limit(0), marks).collect() == []
    got = sorted(tuple(r) for r in audit.audit(docs, marks.limit(0)).collect())
    assert got == brute(ROWS, [])


def test_removal_steps_are_the_first_failing_filter():
    orders, fails, steps = audit.removal_steps(4)
    for m, o in itertools.product(range(16), range(24)):
        at = [s for s, f in enumerate(orders[o]) if fails[m, f]]
        assert steps[m, o] == (at[0] if at else 4)


def test_whole_table_matches_sql(spark):
    got = compare(queries.QUERIES["op12_audit"](spark, MEDIUM), duckdb_conn(MEDIUM), queries.SQL["op12_audit"])
    assert got["ok"], got
