import hashlib

import pytest
from llm_fixtures import documents, edge_rows, random_rows
from pyspark.sql import functions as F

from aislecast.llm import linededup

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    rank = lambda i: (i is None, i or 0)
    key = lambda line: line.translate(LOWER).strip(BLANK)
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= 10 and (k not in owner or rank(i) < rank(owner[k])):
                owner[k] = i
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or rank(owner[key(x)]) == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (5, 3)])
@pytest.mark.parametrize("rows", [edge_rows(), random_rows(1), random_rows(2)])
def test_against_brute_force(spark, rows, batches, fanout):
    out = linededup.dedup(documents(spark, rows), batches=batches, fanout=fanout)
    got = out.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_other_columns_pass(spark):
    docs = documents(spark, edge_rows())
    assert linededup.dedup(docs).select("row.*").columns == docs.columns


def test_empty_table(spark):
    assert linededup.dedup(documents(spark, [])).count() == 0


def test_runs_are_compacted(spark):
    index = linededup.LineRuns(fanout=2)
    for i in range(5):
        index.add(spark.createDataFrame([(i, i)], "h1 long, h2 long"))
    assert [len(level) for level in index.levels] == [1, 0, 1]
    keys = spark.createDataFrame([(3, 3, 0), (9, 9, 0)], "h1 long, h2 long, first int")
    assert {r.h1: r.seen for r in index.seen(keys).collect()} == {3: True, 9: False}


def test_query_digest(spark):
    docs = documents(spark, [(1, None)])
    row = linededup.dedup(docs).select(F.sha2("kept", 256).alias("h")).first()
    assert row.h == hashlib.sha256(b"").hexdigest()
