import hashlib
import random

import pytest
from llm_fixtures import documents, edge_rows

from aislecast.llm import winnowing as w


def brute(text, k, window):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if "\t" <= c <= "\r" else c for c in text)
    if not t:
        return []
    k = min(k, len(t))

    def mix(gram):
        x = 0
        for c in gram:
            x = (x * w.BASE + ord(c) + 1) & w.MASK
        x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & w.MASK
        return x ^ x >> 29

    h = [mix(t[i : i + k]) for i in range(len(t) - k + 1)]
    spans = [range(i, i + window) for i in range(len(h) - window + 1)] or [range(len(h))]
    return [(h[i], i) for i in sorted({max(i for i in s if h[i] == min(h[j] for j in s)) for s in spans})]


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_chosen_hashes(monkeypatch, chunk):
    monkeypatch.setattr(w, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(300):
        text = "".join(rng.choice("abAB é\n😀") for _ in range(rng.randint(0, 150)))
        k, window = rng.choice([(1, 1), (3, 4), (16, 16), (5, 7), (8, 3)])
        hashes, places = w.winnow(text, k, window)
        assert list(zip(hashes.tolist(), places.tolist())) == brute(text, k, window)


def test_match_guarantee():
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(w.K + w.WINDOW - 1))
    for _ in range(50):
        a, b = ("".join(rng.choice("ijklmnop ") for _ in range(90)) for _ in range(2))
        one, two = w.winnow(a[:40] + shared + a[40:]), w.winnow(b[:70] + shared + b[70:])
        assert set(one[0].tolist()) & set(two[0].tolist())


@pytest.mark.parametrize("ranges", [1, 2, 5, 40])
def test_neighbours(spark, ranges):
    rng = random.Random(2)
    rows = [(i * 7 % 101, "".join(rng.choice("ab cd\n") for _ in range(rng.randint(0, 200)))) for i in range(60)]
    rows += [(1000, None), (1001, "A" * 5000)]
    got = {r.doc_id: r for r in w.edits(documents(spark, rows), ranges).collect()}
    rows.sort()
    assert len(got) == len(rows)
    fp = {i: w.winnow(t or "") for i, t in rows}
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for (i, t), (j, n) in zip(rows, rows[1:] + rows[:1]):
        t, n = t or "", n or ""
        cut = len(t) // 2
        edited = t[: len(t) - cut] + n[:cut]
        e, r = w.winnow(edited), got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (w.digest(*fp[i]), w.digest(*e))
        assert r.near_edited == pytest.approx(like(set(fp[i][0].tolist()), set(e[0].tolist())))
        assert r.near_next == pytest.approx(like(set(fp[i][0].tolist()), set(fp[j][0].tolist())))


def test_edge_rows(spark):
    rows = edge_rows()
    got = w.edits(documents(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)
    alone = w.edits(documents(spark, [(3, "abcdef")])).first()
    assert alone.near_next == 1.0
    assert alone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert w.edits(documents(spark, [])).count() == 0


def test_fingerprints_frame(spark):
    row = w.fingerprints(documents(spark, [(1, "some text that is long enough to have hashes")])).first()
    assert len(row.hashes) == len(row.places) > 0
