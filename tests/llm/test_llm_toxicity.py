import random
import zlib

import pytest
from llm_fixtures import documents, edge_rows

from aislecast.llm import toxicity as t


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_automaton_against_distances(edits):
    rng = random.Random(edits)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
    lexicon = {word(): float(i + 1) for i in range(12)}
    a = t.Automaton(lexicon, edits)
    for _ in range(1500):
        w = word()
        assert a.match(w) == max((x for l, x in lexicon.items() if distance(w, l) <= edits), default=0.0)


def test_automaton_starts_anew(monkeypatch):
    monkeypatch.setattr(t.Automaton, "MOST", 5)
    a = t.Automaton({"stupid": 2.0})
    assert [a.match(w) for w in ("stupid", "stpid", "stuupid", "st0pid", "stopped", "stu")] == [2, 2, 2, 2, 0, 0]


def test_misspellings_and_quotation():
    m = t.Model({"moron": 5.0, "stupid": 5.0}).prepare()
    clean, abuse = m.score("the river is wide"), m.score("you are a moron and stupid")
    assert clean < 0.1 < t.THRESHOLD < abuse
    assert m.score("you are a m0ron and stuppid") > clean
    quoted = m.score('they said "you are a moron" and left')
    assert quoted < m.score("they think you are a moron and left")
    assert m.score("") == m.score(None) == pytest.approx(m.score("nothing here"))


def training(spark, n=240):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["river", "stone", "market", "window", "of", "the"]) for _ in range(25))
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        rows.append((i, text() + (f" zorg{rng.choice('abcdef')}x blarkish you" if toxic else "") + " " + text()))
        labels.append((i, 1, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_terms_and_stems(spark):
    docs, labels = training(spark)
    model = t.learn(docs, labels)
    assert "blarkish" in model.words and "zorg" in model.stems
    got = {r.doc_id: r.score for r in t.score(docs, model).select("row.doc_id", "score").collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 40
    assert all((got[i] >= t.THRESHOLD) == (i % 4 == 0) for i in held)


def test_labels_of_held_out_rows_are_unused(spark):
    docs, labels = training(spark)
    flipped = labels.selectExpr("doc_id", "quality", "case when pmod(crc32(cast(doc_id as string)), 3) = 1 then 1 - toxic else toxic end as toxic")
    one, two = t.learn(docs, labels), t.learn(docs, flipped)
    assert (one.words, one.stems, one.known, list(one.coefficients)) == (two.words, two.stems, two.known, list(two.coefficients))


def test_edge_rows(spark):
    docs = documents(spark, edge_rows())
    labels = spark.createDataFrame([(None, 1, 1), (1, 1, None), (77, 0, 1)], "doc_id long, quality int, toxic int")
    model = t.learn(docs, labels)
    out = t.score(docs, model)
    assert out.count() == len(edge_rows())
    assert out.select("row.*").columns == docs.columns
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert t.score(documents(spark, []), model).count() == 0


def test_sample_is_bounded(spark):
    docs, labels = training(spark)
    assert t._sample(docs, labels, 20).count() <= 20


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = t.op5_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.toxic and r.predicted for r in got)
    assert hit >= 0.85 * sum(r.toxic for r in got)
    assert sum(r.predicted and not r.toxic for r in got) <= 0.01 * len(got)


def test_lexicon_is_of_the_sample_alone(spark):
    docs, labels = training(spark)
    seen = {w for r in docs.collect() for w in r.text.split()}
    assert set(t.learn(docs, labels).words) <= seen
    assert t.learn(docs, labels.where("toxic = 0")).words == {}
