import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import ODD, words

from daycast.llm import curve, queries
from daycast.llm.common import table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary_path()


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary)
    t.no_truncation()
    t.no_padding()
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check(pieces, rows, library, size):
    """Every id lies in one piece; sequences are gapless, full or a power of two."""
    wanted = Counter((i, tuple(library(t))) for i, t in rows)
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    total = 0
    for k, part in sequences.items():
        at = 0
        for p in sorted(part, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        total += at
        assert at == size or at & (at - 1) == 0 and at < size
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(1 for v in sequences.values() if sum(p.length for p in v) < size) == bin(total % size).count("1")
    for i, part in docs.items():
        flow = {(p.sequence_id, p.offset): p for p in part}
        whole, ids, n = Counter(), [], 0
        for key in sorted(flow):                     # pieces of one document follow each other
            p = flow[key]
            assert p.start == len(ids)
            ids += np.frombuffer(p.ids, "<u4").tolist()
            if len(ids) == p.doc_tokens:
                whole[i, tuple(ids)] += 1
                ids = []
        assert not ids
        assert whole == Counter({k: v for k, v in wanted.items() if k[0] == i})
    assert total == sum(len(k[1]) * v for k, v in wanted.items())


@pytest.mark.parametrize("size", [64, 4096])
def test_odd_rows(spark, docs, vocabulary, library, size):
    rows = ODD + [(i, words(*range(i % 40), stem="token")) for i in range(20, 70)]
    got = curve.pack(docs(rows), vocabulary, size, with_ids=True).collect()
    check(got, rows, library, size)
    assert curve.pack(docs([]), vocabulary).collect() == []


def test_whole_table(spark, vocabulary, library):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    check(curve.pack(table(spark, SMALL, "documents"), vocabulary, with_ids=True).collect(), rows, library, 4096)
    got = queries.QUERIES["op11_hilbert"](spark, SMALL)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(map(tuple, got.collect())) == sorted(
        tuple(r) for r in curve.pack(table(spark, SMALL, "documents"), vocabulary).collect())


def test_result_does_not_depend_on_partitions(spark, docs, vocabulary, monkeypatch):
    rows = [(i, words(*range(i % 23), stem=f"part{i % 3}x")) for i in range(120)] + [(i, "same") for i in range(200, 300)]
    seen = []
    for n in (1, 5, 16):
        monkeypatch.setattr(curve, "PART_IDS", 3000 // n)
        assert curve.keyed(curve.encoded(docs(rows), vocabulary))[1] >= n
        seen.append(sorted(tuple(r) for r in curve.pack(docs(rows).repartition(n), vocabulary, 128).collect()))
    assert seen[0] == seen[1] == seen[2]


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 5), (3, 3), (4, 2)])
def test_curve_visits_every_cell_and_steps_by_one(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = curve.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_alike_documents_are_near_each_other(spark, docs, vocabulary):
    rng = np.random.default_rng(0)
    topics = [[f"{a}{b}" for b in ("ring", "stone", "light", "water", "field", "house", "wind", "land")]
              for a in ("sun", "moon", "fire", "snow", "gold", "iron")]
    rows = [(int(i), " ".join(rng.choice(topics[i % 6], 200))) for i in rng.permutation(600)]
    got = curve.pack(docs(rows), vocabulary, 512).collect()
    first = {p.doc_id: (p.sequence_id, p.offset) for p in got if p.start == 0}
    order = [i % 6 for i, _ in sorted(first.items(), key=lambda kv: kv[1])]
    same = np.mean([a == b for a, b in zip(order, order[1:])])
    assert same > 0.8                                   # 0.17 by chance


def test_cuts():
    for total in (0, 1, 63, 64, 65, 127, 1000):
        full, tail = curve.cuts(total, 64)
        ends = [*tail.tolist(), total][1:] if len(tail) else []
        sizes = [b - a for a, b in zip(tail.tolist(), ends)]
        assert full * 64 + sum(sizes) == total and all(s & (s - 1) == 0 and 0 < s < 64 for s in sizes)
