import hashlib
import random
from itertools import chain

import public_tokenizers
import pytest
from llm_fixtures import documents, edge_rows
from tokenizers import Tokenizer

from aislecast.llm import bpe

PARTS = ["a", " ", "  ", "\n", "\t", "the", " and", "ing", "é", "ß", "日本", "😀", "'s", "'", "'re", "1", "23", "-", "--", "=", "...", "<|endoftext|>", "<|", "ation", "\xa0", "\r\n", "​"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary()


@pytest.mark.parametrize("chunk,buffer", [(1 << 16, 512), (16, 8), (1, 1)])
def test_encodes_like_the_library(library, vocabulary, chunk, buffer):
    t = bpe.Transducer(vocabulary, chunk=chunk, buffer=buffer)
    rng = random.Random(chunk)
    for i in range(400):
        parts = PARTS if i % 3 else ["a", "-", "=", "th", "e", "in", "g", "er"]
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60) if i % 3 else rng.randint(300, 900)))
        assert list(chain.from_iterable(t.encode(text))) == library.encode(text, add_special_tokens=False).ids


def test_lookahead_is_small(vocabulary):
    assert 0 < bpe.Transducer(vocabulary).lookahead < 1000


def test_decodes_byte_by_byte(library, vocabulary):
    t = bpe.Transducer(vocabulary)
    rng = random.Random(4)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(30)]
        assert "".join(t.decode([[i] for i in ids])) == library.decode(ids, skip_special_tokens=False)


def test_rows(spark, library):
    rows = [*edge_rows(), (20, "x<|endoftext|>y"), (21, "é" * 5000), (22, " " * 5000 + "x")]
    docs = documents(spark, rows)
    got = sorted((map(tuple, bpe.digests(docs).collect())), key=repr)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    encoded = bpe.encode(docs)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in encoded.collect()) == sorted((w[0] or 0, w[1]) for w in want)
    back = bpe.decode(encoded, piece=3).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in rows)


def test_empty_table(spark):
    assert bpe.digests(documents(spark, [])).count() == 0
    assert bpe.round_trip(documents(spark, [(1, None)])).first().ids == []
