import random
import re

import pytest
from llm_fixtures import documents, edge_rows
from pyspark.sql import functions as F

from aislecast.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))]
    return sum(twice) % 10 == 0


def brute(text):
    rules = {
        "email": lambda v, d: True,
        "ip": lambda v, d: all(int(x) <= 255 for x in v.split(".")),
        "card": lambda v, d: 14 <= len(d) <= 19 and luhn(d),
        "phone": lambda v, d: 10 <= len(d) <= 15,
    }
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            if rules[kind](m.group(), re.sub("[^0-9]", "", m.group())):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def noisy_rows():
    rng = random.Random(6)
    parts = ["a.b@c.de", "x@y", "@", ".", "a@b.c+d@e.f.g", "1.2.3.4", "300.1.1.1", "001.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1111", "5467", " ", "-",
             "+1 (858) 555-7280", "+", "+49 30 1234567", "é", "😀 ", "word ", "\n", "12", "%+", "4348649190265535"]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(250)]


@pytest.mark.parametrize("rows", [edge_rows(), noisy_rows(), [(1, "1" * 50_000 + " a" * 30_000 + "@" + "b." * 20_000), (2, "+1 " * 20_000), (3, "1 2-" * 20_000)]])
def test_base_spans(spark, rows):
    got = pii.find(documents(spark, rows)).select("doc_id", "base").collect()
    want = [(i, brute(t)) for i, t in rows]
    assert sorted(((r.doc_id, [tuple(s) for s in r.base]) for r in got), key=repr) == sorted(want, key=repr)


def corpus():
    filler = ["quiet", "river", "stone", "market", "window"]
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(filler) for _ in range(30))
    rows = [(i, text()) for i in range(200)]
    rows += [(300, f"{text()} Rosencrantz writes from ann@corp.org today {text()}"), (301, f"{text()} ann@corp.org belongs to rosencrantz {text()}")]
    return rows + [(302, "lonely mentions bob@corp.org once"), (303, "lonely mentions bob@corp.org once")]


def test_disclosing_terms(spark):
    docs = documents(spark, corpus())
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    text = dict(corpus())
    named = {i: [(text[i][s.start : s.end], pii.KINDS[s.kind]) for s in rows[i].added] for i in rows}
    assert named[300] == [("Rosencrantz", "term")]
    assert named[301] == [("rosencrantz", "term")]
    assert not named[302] and not named[303]  # one window, copied, is no evidence
    assert all(not named[i] for i in range(200))


def test_sanitise(spark):
    docs = documents(spark, [*corpus(), (9, "call +1 (858) 555-7280 or 1.2.3.4."), (10, None)])
    out = {r.doc_id: r.sanitised for r in pii.sanitise(docs).select("row.doc_id", "sanitised").collect()}
    assert out[9] == "call [PHONE] or [IP]."
    assert out[10] == ""
    assert " writes from [EMAIL] today" in out[300] and "Rosencrantz" not in out[300]
    assert out[5] == dict(corpus())[5]


def test_empty_table(spark):
    assert pii.find(documents(spark, [])).count() == 0
    assert pii.sanitise(documents(spark, [])).count() == 0


def test_term_places(spark):
    row = spark.range(1).select(pii._terms(F.lit("é one,two  three"), "right").alias("t")).first()
    assert [(t.term, t["at"]) for t in row.t] == [("one", 2), ("two", 6), ("three", 11)]


def test_query_equals_sql_where_terms_disclose(spark, tmp_path):
    import duckdb
    import pandas as pd

    rows = [*corpus(), *noisy_rows(), (0, f"{'quiet river ' * 20}nobody but ROSENCRANTZ"), (0, f"ann@corp.org {'stone ' * 30} Rosencrantz")]
    frame = pd.DataFrame({"doc_id": range(len(rows)), "text": [t for _, t in rows]})
    frame.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    cursor = con.execute(pii.SQL)
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(sorted(zip(names, r))) for r in cursor.fetchall())
    got = sorted(tuple(sorted(r.asDict().items())) for r in pii.op2_pii(spark, str(tmp_path)).collect())
    assert got == want
    spans = {dict(r)["doc_id"]: dict(r)["spans"] for r in got}
    # more texts hold the term than its entity, so it is generalised, far from the entity and without it too
    assert spans[len(rows) - 2] == "general:251:262" and spans[len(rows) - 1].endswith(",general:194:205")


def test_sanitise_removes_a_term_wherever_it_is(spark):
    far = f"ann@corp.org {'quiet river ' * 20}and ROSENCRANTZ again"
    docs = documents(spark, [*corpus()[:200], (300, f"{'quiet ' * 20}Rosencrantz writes from ann@corp.org today"), (301, f"ann@corp.org belongs to rosencrantz é Rosencrantz, {far}"), (304, "é nobody but Rosencrantz here"), (None, "rosencrantz")])
    out = {r.doc_id: r.sanitised for r in pii.sanitise(docs).select("row.doc_id", "sanitised").collect()}
    assert not any("rosencrantz" in t.lower() for t in out.values())
    assert out[304] in ("é nobody but  here", "é nobody but [NAME] here")
    assert out[301].startswith("[EMAIL] belongs to ") and out[301].endswith(" again")
    assert out[5] == dict(corpus())[5]


def test_sanitise_gathers_terms_across_other_matches(spark):
    card = "Guildenstern, order 4411, card 4111 1111 1111 1111"
    docs = documents(spark, [*corpus()[:200], (300, f"pay {card} now"), (301, f"for {card}, 17 then")])
    out = {r.doc_id: r.sanitised for r in pii.sanitise(docs).select("row.doc_id", "sanitised").collect()}
    assert "Guildenstern" not in out[300] + out[301]
    assert "[CARD]" in out[300] and "[CARD]" in out[301]


def test_only_texts_with_matches_are_moved(spark):
    texts = ["", "plain words", "mail a@b.cd", "4 digits: 1.2.3.4", "12 34", "+4 567", "a @ b . + 7", "x" * 500, "@b.c", None]
    rows = pii._rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    hits = F.concat(*[pii._hits(F.col("body"), k) for k in pii.PATTERNS])
    want = [r.doc for r in rows.where(F.size(hits) > 0).orderBy("doc").collect()]
    got = [r.doc for r in pii.with_matches(rows).orderBy("doc").collect()]
    assert got == want and 0 < len(want) < len(texts)
    placed = pii.in_whole_texts(pii.base_spans(rows.select("doc", "digest", hits.alias("hits")).where(F.size("hits") > 0)), rows)
    assert "RLIKE" in placed._jdf.queryExecution().optimizedPlan().toString()
