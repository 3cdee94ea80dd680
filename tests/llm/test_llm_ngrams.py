import math
import zlib
from collections import Counter, defaultdict

import pytest
from llm_fixtures import documents, edge_rows, random_rows, words

from aislecast.llm import ngrams


def discounts(values):
    n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    if not n[0] + 2 * n[1]:
        return [0.75] * 3
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.75 for k in (1, 2, 3)]
    return [x if 0 < x <= k else 0.75 for k, x in zip((1, 2, 3), d)]


class Brute:
    def __init__(self, texts):
        self.count, self.pair = Counter(), Counter()
        for t in texts:
            w = [*words(t), "</s>"]
            self.count.update(w)
            self.pair.update(zip(["<s>", *w], w))
        self.d, self.ahead = discounts(self.pair.values()), Counter(w for _, w in self.pair)
        self.e = discounts(self.ahead.values())
        self.context, self.kinds = Counter(), defaultdict(lambda: [0, 0, 0])
        for (u, _), c in self.pair.items():
            self.context[u] += c
            self.kinds[u][min(c, 3) - 1] += 1
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.left = sum(self.e[min(a, 3) - 1] for a in self.ahead.values())

    def low(self, w):
        if not self.pair:
            return 1 / (self.v + 1)
        a = self.ahead.get(w, 0)
        return (max(a - (self.e[min(a, 3) - 1] if a else 0), 0) + self.left / (self.v + 1)) / len(self.pair)

    def p(self, u, w):
        if u not in self.context:
            return self.low(w)
        c = self.pair.get((u, w), 0)
        spare = sum(x * k for x, k in zip(self.d, self.kinds[u]))
        return (max(c - (self.d[min(c, 3) - 1] if c else 0), 0) + spare * self.low(w)) / self.context[u]

    def row(self, t):
        w = [*words(t), "</s>"]
        base = sum(math.log10((self.count.get(x, 0) + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in w)
        return len(w), sum(x in self.count for x in w), base, sum(math.log10(self.p(u, x)) for u, x in zip(["<s>", *w], w))


@pytest.mark.parametrize("flush,buckets", [(1 << 21, 64), (50, 3)])
@pytest.mark.parametrize("rows", [edge_rows(), random_rows(3, 150)])
def test_against_brute_force(spark, monkeypatch, rows, flush, buckets):
    monkeypatch.setattr(ngrams, "FLUSH", flush)
    docs = documents(spark, rows)
    trained = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    model = ngrams.train(docs.where(~ngrams.held_out(docs.doc_id)), buckets)
    brute = Brute(trained)
    assert (model.tokens, model.types) == (brute.n, brute.v)
    got = sorted(map(tuple, ngrams.score(docs, model).collect()), key=repr)
    for g, w in zip(got, sorted(((i, *brute.row(t)) for i, t in rows), key=repr)):
        assert g[:3] == w[:3]
        assert g[3:] == pytest.approx(w[3:], rel=1e-9)


def test_probabilities_sum_to_one():
    b = Brute([t for _, t in random_rows(3, 150)])
    for u in ("<s>", b"a", b"unseen"):
        assert sum(b.p(u, w) for w in b.count) + b.p(u, b"unknown") == pytest.approx(1)


def test_without_training_rows(spark):
    model = ngrams.train(documents(spark, []))
    row = ngrams.score(documents(spark, [(1, "a b")]), model).first()
    assert tuple(row) == (1, 3, 0, 0.0, 0.0)
    assert ngrams.score(documents(spark, []), model).count() == 0


def test_packing():
    import numpy as np

    keys = np.array([0, 1, 5, 1 << 40, (1 << 64) - 1], np.uint64)
    assert np.array_equal(ngrams._unpack_sorted(ngrams._pack_sorted(keys)), keys)
