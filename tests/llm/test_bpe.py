import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import ODD
from daycast.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TRICKY = [
    "It's we'll THEY'RE 'S 've'd", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "İ Σας ΟΔΟΣ ǰ J̌ ẖ Àb",
    "x y z　w\u0085v", "\x1cfoo\x1f bar\x00", "!!!???...,,, a.b,c", "0123 4५6 ٣", "漢字かな 🙂👍🏽 ﻿",
    "a" * 300 + "!" * 90, "ﬁ ﬀ Ⅷ ½", "é é É"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    text = library.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest())


def test_rows_equal_the_library(docs, library):
    rng = random.Random(2)
    pool = [chr(c) for c in [*range(32, 127), *range(0xa0, 0x180), *range(0x300, 0x330),
                             *range(0x3b1, 0x3d0), *range(0x2000, 0x2030), 9, 10, 0x1f600]]
    rows = ODD + [(100 + k, t) for k, t in enumerate(TRICKY)] + [
        (200 + k, "".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for k in range(300)]
    for words in (0, 50, 10_000):       # no lexicon, a small one, all
        got = bpe.digest(docs(rows), PATH, words).collect()
        assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == \
            sorted((i or -1, *want(library, t)) for i, t in rows)


def test_encode_returns_ids_and_text(docs, library):
    row = bpe.encode(docs([(1, "Hello World, it's 2024!")]), PATH).first()
    ids = library.encode("Hello World, it's 2024!", add_special_tokens=False).ids
    assert np.frombuffer(row.ids, "<u4").tolist() == ids
    assert row.decoded == library.decode(ids, skip_special_tokens=False)


def test_empty_table(docs):
    assert bpe.digest(docs([]), PATH).count() == 0


def test_merges_in_step_equal_single_merges(vocabulary):
    rng = random.Random(4)
    pieces = [bytes(rng.randrange(97, 123) for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    pieces += [b"the", b"a", "é".encode(), b"!" * 70, bytes(range(128, 256))]
    assert [x.tolist() for x in vocabulary.merge_many(pieces)] == [vocabulary.merge(p) for p in pieces]


def test_lexicon_is_minimal_and_exact(vocabulary):
    words = [b"station", b"nation", b"ration", b"stations", b"rations", b"on", b"s"]
    entries = {w: [k, k + 1] for k, w in enumerate(words)}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries))
    number = lexicon.find(words)
    assert sorted(number.tolist()) == list(range(len(words)))
    for w, n in zip(words, number):
        assert np.frombuffer(lexicon.entry(n), "<u4").tolist() == entries[w]
    assert lexicon.find([b"", b"stat", b"nations", b"zzz", b"station\xff"]).tolist() == [-1] * 5
    assert len(lexicon.ends) < sum(map(len, words)) * 0.7          # suffixes are shared
    assert len({(bool(lexicon.ends[s]), tuple((k % 256, t) for k, t in zip(lexicon.keys, lexicon.targets)
                                              if k // 256 == s)) for s in range(len(lexicon.ends))}) \
        == len(lexicon.ends)                                      # no two states are equal


def test_empty_lexicon():
    assert bpe.Lexicon(bpe.compile_lexicon({})).find([b"a", b""]).tolist() == [-1, -1]
