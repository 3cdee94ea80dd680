import random

import pytest
import xxhash
from llm_fixtures import documents, edge_rows, words
from pyspark.sql import functions as F

from aislecast.llm import simhash
from aislecast.llm.common import components


def brute_fp(text, k=3):
    w = words(text)
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[top(a)] = top(b)
    return {n: top(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    base = [rng.choice(["alpha", "beta", "Gamma", "delta", "of", "it"]) for _ in range(300)]
    rows = [*edge_rows(), *[(100 + i, " ".join(base[: 300 - i])) for i in range(12)], (400, "ONE"), (401, "one two"), (402, "Two\x0bone")]
    got = simhash.near_duplicates(documents(spark, rows)).select("doc_id", "fp", "component_id").collect()
    fps = [brute_fp(t) for _, t in rows]
    assert sorted((r.doc_id or -1, r.fp) for r in got) == sorted((i or -1, signed(f)) for (i, _), f in zip(rows, fps))
    near = [(a, b) for a in set(fps) for b in set(fps) if bin(a ^ b).count("1") <= 2]
    top = groups(near, set(fps))
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[top[f]] = min(i, least.get(top[f], i))
    assert sorted((r.fp, r.component_id or -1) for r in got) == sorted((signed(f), least.get(top[f], -1)) for f in fps)


@pytest.mark.parametrize("crowd", [1, 5, 32, 10_000])
def test_links_by_brute_force(spark, crowd):
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = set(centre)
    for c in centre:
        for _ in range(60):
            x = c
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {0, 1, 1 << 63, (1 << 64) - 1}
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = [(r.a, r.b) for r in simhash.links(frame, crowd=crowd).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in links)
    true = groups([(signed(a), signed(b)) for a in fps for b in fps if bin(a ^ b).count("1") <= 2], {signed(f) for f in fps})
    found = groups(links, {signed(f) for f in fps})
    parts = lambda g: sorted(sorted(n for n in g if g[n] == r) for r in set(g.values()))
    assert parts(true) == parts(found)


def test_verification_rejects_candidates(spark):
    rng = random.Random(6)
    fps = [rng.getrandbits(32) << 32 | 77 for _ in range(20)] + [rng.getrandbits(64) for _ in range(20)]
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    pairs = simhash.candidates(frame).where("fp is not null").selectExpr("probe as a", "fp as b")
    assert pairs.count() >= 190 and simhash.verified(pairs).count() == 0


def test_a_family_is_not_listed_in_pairs(spark):
    fps = spark.range(3000).select(F.col("id").alias("fp"))
    met = simhash.candidates(fps)
    # all share the upper segment, which is crowded; in the lower one a value has at most 12 others one bit away
    assert met.where("fp is null").count() == 3000 and met.where("fp is not null").count() <= 12 * 3000 / 2
    assert simhash.links(fps).count() <= 65 * 3000


def test_probes_are_not_sent_whole_to_all_tasks(spark, capsys):
    met = simhash.candidates(spark.range(500).select(F.xxhash64("id").alias("fp")))
    met.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin [segment" in plan and "BroadcastExchange" not in plan
    assert met.where("fp is null").count() == 0


def test_one_of_each(spark):
    docs = documents(spark, [(3, "a b c d"), (1, "A b C d"), (1, "a b c d"), (2, None), (5, ""), (7, "quite another text here"), (None, "alone in the dark night")])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 7]
    copies = documents(spark, [(None, "no id at all"), (None, "no id at all"), (None, "no id, other text")])
    assert sorted(r.text for r in simhash.one_of_each(copies).collect()) == ["no id at all", "no id, other text"]


@pytest.mark.parametrize("words_in_shingle", [3, 5])
def test_empty_table(spark, words_in_shingle):
    assert simhash.near_duplicates(documents(spark, []), words_in_shingle).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    out = components(spark.createDataFrame(chain + star, "a long, b long"))
    assert {r.node: r.root for r in out.collect()} == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_one_of_each_keeps_the_least_of_each_group_of_a_large_family(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for family, size in ((0, 150), (1000, 30), (2000, 1)):
        base = [rng.choice(vocabulary) for _ in range(500)]
        for i in range(size):
            copy = list(base)
            copy[rng.randrange(500)] = f"changed{i % 40}"
            rows.append((family + i, " ".join(copy)))
    fp = {i: brute_fp(text) for i, text in rows}
    near = [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2]
    top = groups(near, fp)
    least = {min(i for i in fp if top[i] == t) for t in set(top.values())}
    kept = {r.doc_id for r in simhash.one_of_each(documents(spark, rows)).collect()}
    assert kept == least and len(least) < 60
