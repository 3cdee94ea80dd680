import re

import pytest
from llm_fixtures import documents, edge_rows
from pyspark.sql import functions as F

from aislecast.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(size, passes=3):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(passes * size[s] for s in capped)
        free = [s for s in size if s not in capped]
        if not free:
            return {s: float(passes * size[s]) for s in size}
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > passes * size[s]}
        if not over:
            return {s: float(passes * size[s]) if s in capped else weight[s] * level for s in size}
        capped |= over


def rows_of(n):
    return [(i, "w " * (i * 37 % 91), f"s{i * i % 11}" if i % 13 else None) for i in range(n)]


@pytest.mark.parametrize("rows", [rows_of(200), rows_of(30), edge_rows(), [(1, "a b c", "x"), (2, None, "y"), (3, "", None)]])
def test_targets_and_shares(spark, rows):
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    count = lambda t: len(WORD.findall(t or ""))
    size = {}
    for r in rows:
        size[r[2] if len(r) > 2 else "s"] = size.get(r[2] if len(r) > 2 else "s", 0) + count(r[1])
    target = brute_targets(size)
    taken = dict.fromkeys(size, 0)
    for r in got:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert sorted(r["size"] for r in got) == sorted(count(r[1]) for r in rows)
    assert all(abs(taken[s] - target[s]) <= len(size) for s in size)
    assert sum(taken.values()) == sum(size.values())


def test_reruns_agree(spark):
    docs = documents(spark, rows_of(120))
    key = lambda df: sorted(map(tuple, df.select("doc_id", "source", "size", "taken").collect()), key=repr)
    assert key(mixing.mix(docs)) == key(mixing.mix(docs.repartition(7)))


def test_mixed_rows_hold_what_is_taken(spark):
    rows = [*rows_of(60), (5, "w " * 3, "s3"), (5, "w " * 3, "s3"), (900, " lead  and\ttwo \n words ", "s1")]
    docs = documents(spark, rows)
    plan = {}
    for r in mixing.mix(docs).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.taken
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert got == {i: n for i, n in plan.items() if n}


def test_empty_table(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mixed(documents(spark, [])).count() == 0


def test_long_cut(spark):
    docs = documents(spark, [(1, "x " * 50_000, "a"), (2, "y", "b")])
    by = {r.doc_id: r for r in mixing.mixed(docs).groupBy("doc_id").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert by[1].n + by[2].n == 50_001
