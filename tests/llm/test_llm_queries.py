"""Registered queries against their SQL, and the pipeline against brute force, on the smallest tables."""

import hashlib

import public_tokenizers
import pytest
from checker import compare, duck
from pyspark.sql import functions as F
from test_llm_linededup import brute as brute_lines
from test_llm_simhash import brute_fp, groups
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from aislecast.llm import bpe, mixing, toxicity
from aislecast.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(DATA), DATA, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"op13_packing"}))  # a row per piece
def test_query_has_a_row_per_input_row(spark, name):
    assert QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, sorted(docs.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "mixing", "bpe"]
    stage = dict(corpus_pipeline.STAGES)

    def step(name, rows):
        out = stage[name](spark, spark.createDataFrame(rows, docs.schema), DATA)
        assert name == "bpe" or out.columns == columns
        return sorted(out.collect(), key=repr)

    clean = step("toxicity", before)
    model = toxicity.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet")).prepare()
    assert clean == sorted((r for r in before if model.score(r.text) < toxicity.THRESHOLD), key=repr)

    lines = step("line_dedup", clean)
    want = {i: text for i, _, _, text in brute_lines([(r.doc_id, r.text) for r in clean])}
    assert {r.doc_id: r.text for r in lines} == want
    assert all(r.n_chars == len(r.text) for r in lines if r.text != dict((c.doc_id, c.text) for c in clean)[r.doc_id])

    single = step("simhash_dedup", lines)
    fp = {r.doc_id: brute_fp(r.text) for r in lines}
    top = groups([(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2], fp)
    least = {}
    for i in sorted(fp):
        least.setdefault(top[i], i)
    assert single == sorted((r for r in lines if r.doc_id in least.values()), key=repr)

    mix = step("mixing", single)
    plan = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(single, docs.schema)).where("taken > 0").collect()}
    got = {}
    for r in mix:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
    assert got == plan

    last = step("bpe", mix)
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    ids = [(r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in mix]
    assert sorted((r.doc_id, r.ids) for r in last) == sorted(ids)
    digest = {(i, len(x)): hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for i, x in ids}
    assert all(digest[r.doc_id, r.n_tokens] == r.ids_sha256 for r in last)

    run = corpus_pipeline.run(spark, DATA)
    assert run.agg(F.count("*"), F.sum("n_tokens")).first() == (len(last), sum(r.n_tokens for r in last))
