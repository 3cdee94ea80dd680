"""Phrase mining against counting all phrases in Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import LONG, documents, edge_rows
from pyspark.sql import functions as F

from aislecast.llm import collocations
from aislecast.llm.collocations import tile_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=5, share=100, top=2000):
    """rows of (lang, text)."""
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        known = {p for p in f if f[p] >= least and len(p) > 1}
        rows = []
        for p in known:
            if any(100 * f[q] >= share * f[p] for q in known if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((1000 * f[p] * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def found(spark, rows, **options):
    docs = documents(spark, [(i, text) for i, (_, text) in enumerate(rows)])
    named = spark.createDataFrame([(i, lang) for i, (lang, _) in enumerate(rows)], "doc_id long, of string")
    docs = docs.join(named, "doc_id").withColumn("lang", F.col("of"))
    return sorted(tuple(r) for r in collocations.collocations(docs, **options).collect())


def texts(seed, n=80):
    rng = random.Random(seed)
    words = ["Ab", "b", "c", "É", "dd", "e f", "g-h", "z"]
    phrase = ["one two three four five six", "one two three", "b b b b"]
    out = []
    for _ in range(n):
        parts = [rng.choice(words + phrase) if rng.random() < 0.8 else rng.choice([".", "; ", "!", "\n", "\t", " , "]) for _ in range(rng.randint(0, 40))]
        out.append((rng.choice(["en", "fr", None]), " ".join(parts)))
    return out


@pytest.mark.parametrize("seed,size,dense", [(1, 1 << 24, 1 << 16), (2, 300, 1), (3, 1000, 4)])
def test_phrases_equal_counting(spark, monkeypatch, seed, size, dense):
    monkeypatch.setattr(collocations.chunks, "__defaults__", (size,))
    monkeypatch.setattr(collocations.tile_counts, "__defaults__", (dense,))
    rows = texts(seed)
    for least, share in ((3, 100),) if seed > 1 else ((3, 100), (8, 60)):
        assert found(spark, rows, least=least, share=share) == brute(rows, least, share=share)


def test_edges_ties_and_the_report_limit(spark):
    rows = [(lang, text) for _, text, *_ in edge_rows() for lang in ("en", None)] + [("en", LONG), ("en", "a b. " * 5), ("en", "c d! " * 5), ("xx", "a b"), (None, "...")]
    want = brute(rows, 4, top=4)
    assert found(spark, rows, least=4, top=4) == want and len(brute(rows, 4)) > len(want) > 4
    assert found(spark, [("en", None), (None, "")], least=1) == []
    assert found(spark, [], least=1) == []


def test_products_beyond_64_bits(spark):
    score = spark.range(1).select(
        F.lit(9_000_000_000_000).alias("a"), F.lit(8_999_999_999_999).alias("n"), F.lit(9_000_000_000_001).alias("l"), F.lit(8_000_000_000_007).alias("r")
    )
    c = score.withColumns({"above": 1000 * collocations._product(F.col("a"), F.col("n"), digits=16), "below": collocations._product(F.col("l"), F.col("r"))})
    assert c.select(F.expr("above div below")).first()[0] == 1000 * 9_000_000_000_000 * 8_999_999_999_999 // (9_000_000_000_001 * 8_000_000_000_007)


@pytest.mark.parametrize("dense", [1, 50, 1 << 30])
def test_tiles_by_address_and_by_coordinates(dense):
    rng = np.random.default_rng(dense % 97)
    left, right = rng.zipf(1.3, 5000) % 5000 + 1, rng.zipf(1.2, 5000) % 3000 + 1
    got = Counter()
    for codes, counts in tile_counts(left.astype(np.int64), right.astype(np.int64), dense):
        for c, n in zip(codes.tolist(), counts.tolist()):
            assert (c >> 32, c & ((1 << 32) - 1)) not in got
            got[c >> 32, c & ((1 << 32) - 1)] += n
    assert got == Counter(zip(left.tolist(), right.tolist()))
