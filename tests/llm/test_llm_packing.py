"""Packing: every token once, ids as the library gives them, windows full but the last one."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_fixtures import LONG, documents, edge_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aislecast.llm import packing
from aislecast.llm.packing import VOCABULARY, Encoder, pack, place, read_vocabulary

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_the_library(library):
    rng = random.Random(3)
    letters = [chr(c) for c in range(1, 0x250)] + list("'sStTmM ABCabc0129.,!?-_<|>İΣσ́ ​中ก\U0001f600ﬁÅ½")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [f"a{chr(c)}B 's{chr(c)} {chr(c)}don't" for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    texts += ["<|endoftext|> x<|startoftext|>y <|EndOfText|>", "", " \t\n", LONG, "Don'T 'RE it's I'LL", "x" * 5000]
    ids, at = Encoder(read_vocabulary()).batch(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of(library, text), repr(text)


def check(rows, texts, library, contexts=packing.CONTEXTS):
    """``rows`` of pieces over documents without ids in common; returns the padded tokens beyond the tokens."""
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert by.keys() == texts.keys()
    for i, text in texts.items():
        want, at = ids_of(library, text), 0
        for r in sorted(by[i], key=lambda r: r.start):
            part = want[r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(want) and r.length > 0
            assert bytes(r.ids) == np.array(part, "<u4").tobytes()
            at += r.length
        assert at == len(want)
    assert set(sequences) == set(range(len(sequences)))
    padding, partial, steps = 0, 0, {}
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        (context,) = {r.context for r in rows}
        (step,) = {r.step for r in rows}
        assert at == context or context == contexts[0]
        partial += at != context
        padding += context - at
        steps[step] = steps.get(step, 0) + context
    assert partial <= 1 and max(steps.values()) - min(steps.values()) <= 2 * sum(contexts)
    return padding


def text_of(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "Paris", "12", "x-y", "it's"]) for _ in range(n))


@pytest.mark.parametrize("seed,sizes", [(1, [1, 5, 60, 300, 900, 1500, 5000]), (2, [1700]), (3, [2]), (4, [0, 0, 1400, 3000])])
def test_all_tokens_in_full_windows(spark, library, seed, sizes):
    rng = random.Random(seed)
    texts = {i: text_of(rng, rng.choice(sizes)) for i in range(60)}
    docs = documents(spark, list(texts.items()))
    assert check(pack(docs, step_tokens=8192).collect(), texts, library) < 2048


def test_other_contexts_and_a_hot_length(spark, library):
    rng = random.Random(5)
    texts = {i: "one of the same" if i % 3 else text_of(rng, rng.randint(1, 90)) for i in range(300)}
    rows = pack(documents(spark, list(texts.items())), (64, 32, 8), step_tokens=512).collect()
    assert check(rows, texts, library, (64, 32, 8)) < 64


def test_edges(spark, library):
    rows = [r[:2] for r in edge_rows()]
    out = pack(documents(spark, rows)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.start, r.length, r.doc_tokens) for r in out)
    want = sorted((i is None, i or 0, len(ids_of(library, t))) for i, t in rows)
    assert sum(g[3] for g in got) == sum(w[2] for w in want)
    assert sorted(g[:2] + (g[4],) for g in got if g[2] == 0) == want
    assert pack(documents(spark, [])).count() == 0
    assert [(r.length, bytes(r.ids)) for r in pack(documents(spark, [(1, None)])).collect()] == [(1, b"\x01\0\0\0")]


def test_query_has_the_checksums_of_its_pieces(spark, library, tmp_path):
    texts = {1: "A first text.", 2: None, 3: LONG}
    documents(spark, list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    for r in packing.op13_packing(spark, str(tmp_path)).collect():
        part = ids_of(library, texts[r.doc_id])[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())


def test_gaps_take_the_shortest_tiers_first(spark):
    pieces = [(0, i, 0, n) for i, n in enumerate([1500] * 20 + [700] * 10 + [300] * 10 + [100] * 40)]
    rows = spark.createDataFrame(pieces, "part long, nth long, start long, length long")
    rows = rows.withColumns({"place": F.md5(F.col("nth").cast("string").cast("binary")), "digest": F.lit(0).cast("long"), "one": F.lit(1).cast("long")})
    rows = rows.withColumn("b", F.substring("place", 1, 4))
    out, windows, padded = place(rows, packing.CONTEXTS, 5)
    got = out.collect()
    assert {r.sequence_id for r in got} == set(range(5, 5 + windows))
    assert sum(r.length for r in got) == sum(p[3] for p in pieces) and padded - sum(p[3] for p in pieces) < 2048
    in_long = {r.nth for r in got if r.context == 2048}
    assert set(range(20)) <= in_long and set(range(40, 80)) <= in_long
