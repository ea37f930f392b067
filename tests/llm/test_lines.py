import random
from os.path import commonprefix

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import ODD, words
from daycast.llm import lines, queries
from daycast.llm.common import table, word_hashes

SMALL = "/root/testdata/sf0.001"


def one_edit(a, b):
    """Word edit distance at most 1, by the full table."""
    d = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    return d[-1] <= 1


def near(a, b):
    if max(len(a), len(b)) >= 8:
        return abs(len(a) - len(b)) < 2 and one_edit(a, b)
    s, t = (b" ".join(w).decode() for w in (a, b))
    same = len(commonprefix([s, t])) + len(commonprefix([s[::-1], t[::-1]]))
    return max(len(s), len(t)) >= 24 and abs(len(s) - len(t)) < 2 and same >= max(len(s), len(t)) - 1


def brute(rows):
    """Kept text per row: every line against all earlier lines."""
    at = {}
    for i, t in rows:
        for k, raw in enumerate((t or "").encode().split(b"\n")):
            w = tuple(raw.lower().split())
            if w:
                place = (lines.LAST_ID if i is None else i, k)
                at[w] = min(at.get(w, place), place)
    order = sorted(at.items(), key=lambda x: x[1])
    loses = {w for n, (w, _) in enumerate(order) if any(near(v, w) for v, _ in order[:n])}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        left = []
        for k, raw in enumerate(t.split("\n")):
            w = tuple(raw.encode().lower().split())
            if not w or (w not in loses and at[w] == (lines.LAST_ID if i is None else i, k)):
                left.append(raw)
        out.append((i, "\n".join(left)))
    return out


def run(df):
    return sorted(((r.doc_id, r.text) for r in lines.dedup(df).collect()), key=str)


def test_random_edits(docs):
    rng = random.Random(6)
    base = [[f"l{b}w{k}" for k in range(rng.choice((1, 2, 4, 6, 7, 8, 9, 15, 30)))] for b in range(14)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(base)[:]
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                k = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[k:k + 1] = [[], [w[k], f"n{rng.randrange(3)}"], [f"r{rng.randrange(3)}"]][kind]
            text.append(" ".join(w).upper() if rng.random() < .2 else " ".join(w))
        rows.append((100 - i, "\n".join(text)))
    assert run(docs(rows)) == sorted(brute(rows), key=str)


CHINESE = "我们在河边走了很久，然后回家吃饭，晚上又出去看月亮。"
THAI = "เราเดินไปตามแม่น้ำแล้วกลับบ้าน"


def test_short_lines_and_scripts_without_spaces(docs):
    """Lines of 1 to 12 words, and of code points, with an edit of one unit or two."""
    rng = random.Random(3)
    base = [" ".join(f"word{b}{k}" for k in range(n)) for b, n in enumerate(range(1, 13))]
    base += [CHINESE, THAI, CHINESE + "　" + THAI, "🙂" * 30, "x" * 5000, "Read more", "Home"]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 4)):
            line = rng.choice(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                k = rng.randrange(len(line) + 1)
                line = rng.choice((line[:k] + rng.choice("q水 ก") + line[k:], line[:k] + line[k + 1:],
                                   line[:k] + rng.choice("q月😀") + line[k + 1:]))
            text.append(line)
        rows.append((200 - i, "\n".join(text)))
    got = run(docs(rows))
    assert got == sorted(brute(rows), key=str)
    assert sum(t == "" for _, t in got) > 10


def test_code_points_of_lines():
    texts = [f"{CHINESE}\n{THAI} a\n\n  Été  🙂🙂 B ", "", "x"]
    got = lines.Lines([t.encode() for t in texts])
    h, n = lines.code_points(got.words, got.first, got.n)
    want = [" ".join(x.split()) for t in texts for x in t.replace("B", "b").split("\n") if x.split()]
    assert n.tolist() == [len(w) for w in want]
    names = {}
    for c, v in zip("".join(want), h.tolist()):
        assert names.setdefault(c, v) == v
    assert len(set(names.values())) == len(names)


def test_odd_rows(docs):
    rows = ODD + [(20, "All rights reserved.\n\nall  RIGHTS reserved.\nx"), (21, "All rights reserved.")]
    assert run(docs(rows)) == sorted(brute(rows), key=str)
    assert lines.dedup(docs([])).count() == 0


def test_other_columns_pass(docs):
    d = docs([(1, "a b c\na b c"), (2, "a b c")])
    out = lines.dedup(d)
    assert out.columns == [*d.columns, "__lines", "__dropped", "__left"]
    got = {r.doc_id: r for r in out.collect()}
    assert (got[1].text, got[1]["__dropped"], got[2].text, got[2]["__left"]) == ("a b c", 1, "", 0)
    assert got[2].score == 0.5 and got[2].places == "p"


def test_whole_small_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: r.text for r in queries.QUERIES["op3_lines"](spark, SMALL).collect()}
    assert got == dict(brute(rows))


def test_keys_and_variants_of_one_edit():
    rng = random.Random(1)
    for _ in range(300):
        a = [f"w{rng.randrange(20)}" for _ in range(rng.randrange(8, 25))]
        b = a[:]
        k = rng.randrange(len(b))
        kind = rng.randrange(3)
        b[k:k + 1] = [[], [b[k], "new"], ["other"]][kind]
        ha, hb = (word_hashes(" ".join(x).encode()) for x in (a, b))
        assert set(lines.half_keys(ha).tolist()) & set(lines.half_keys(hb).tolist())
        va, vb = lines.variants(ha), lines.variants(hb)
        if kind == 2:
            assert va[k + 1] == vb[k + 1]
        else:
            longer, shorter, gap = (va, vb, k) if kind == 0 else (vb, va, k + 1)
            assert longer[gap + 1] == shorter[0]
        assert lines.within_one_edit(a, b)
    assert not lines.within_one_edit(["a", "b", "c"], ["b", "c", "d"])


def test_one_very_common_line(docs):
    """A line in most documents, with a variant per document, keeps its earliest."""
    common = words(*range(12))
    rows = [(i, common + f" end{i}") for i in range(60)] + [(100, common)]
    got = dict(run(docs(rows)))
    assert got[0] and not any(got[i] for i in range(1, 60)) and not got[100]
