import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import ODD
from daycast.llm import queries, tokenfile
from daycast.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


def brute(rows):
    library = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_small_table(spark):
    got = sorted(map(tuple, queries.QUERIES["op10_repair"](spark, SMALL).collect()))
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").orderBy("doc_id").collect()]
    assert got == brute(rows)


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_odd_rows(spark, docs, block):
    rows = ODD + [(50, "<|endoftext|> a<|startoftext|>b"), (51, "J̌ A<|"), (52, None), (53, "a a a a a a a")]
    folder = tokenfile.new_folder(spark)
    tokenfile.write(docs(rows).repartition(4), PATH, folder, block_ids=block)
    got = tokenfile.read(spark, folder, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i))
    starts = np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    assert [r[1] for r in got] == starts
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in brute(rows))


def test_empty_table(spark, docs):
    folder = tokenfile.new_folder(spark)
    tokenfile.write(docs([]), PATH, folder)
    assert tokenfile.read(spark, folder).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    phrases = [rng.integers(0, 60_000 if seed == 3 else 400, 6) for _ in range(30)]
    docs = [np.concatenate([phrases[k] for k in rng.integers(0, 30, rng.integers(0, 60))] + [[2]])
            for _ in range(200)]
    ids, lengths = np.concatenate(docs).astype(np.uint32), np.array([len(d) for d in docs])
    block = tokenfile.Block(tokenfile.pack(np.arange(200), ids, lengths))
    assert np.array_equal(block.ids(), ids)
    assert len(block.symbols) < 0.5 * len(ids)
    for k in (0, 7, 199):
        assert np.array_equal(block.ids(k, k + 1), docs[k])
    assert np.array_equal(block.length[len(block.length) - 1:],
                          [len(tokenfile.Block.ids(block)) and block.length[-1]])


def test_runs_of_one_symbol():
    ids, lengths = np.full(1000, 9, np.uint32), np.array([333, 1, 666])
    block = tokenfile.Block(tokenfile.pack(np.arange(3), ids, lengths))
    assert np.array_equal(block.ids(), ids) and len(block.symbols) < 60
    assert [len(block.ids(k, k + 1)) for k in range(3)] == [333, 1, 666]
