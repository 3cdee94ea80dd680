"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows that tell quotation from abuse.

The lexicon is learned from labelled training rows alone: words, and stems
that open a word, weighted by how much likelier they are in toxic documents. Its trie is intersected with the automaton
of all strings within one edit; the product is made deterministic as words ask for it, so a word costs one table
step per letter and ends at the first letter that no lexicon word can follow. Words seen in clean documents are no
misspellings. Each hit is weighed by the window around it: quote marks and words of reporting make it a quotation,
a second person makes it abuse. A logistic model over these sums gives the score.

Training reads at most ``sample`` labelled rows, half of each class, chosen by a hash of the id: it is the only bounded
part and does not depend on the order of rows. Everything else reads all rows and whole texts.

Defined results: null and empty texts get the score of a text without hits; without labelled rows of both classes there
is no lexicon and every text gets the score of a text without hits; a row may carry any other columns; labels of ids that are null or absent are unused, of
several labels of an id the largest counts; rows of one id are scored alike if their texts are; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cache, held, in_workers, stored, table

SAMPLE, MAX_TERMS, THRESHOLD = 20_000, 4_000, 0.7
REPORTING = frozenset("said says called calls quote quoted quotes word words term insult sagte nannte dit appelé dijo llamó".split())
SECOND_PERSON = frozenset("you your you're youre yourself du dich dir dein euch tu te toi ton vous votre tú ti eres usted".split())
QUOTES = "\"“”„«»‘’‹›"
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + QUOTES + "¿¡…–—"
STEMS = (4, 5, 6)
FUZZY_FROM, FUZZY_WEIGHT, CAP, WINDOW = 5, 3.0, 5.0, 4
FLUSH = 50_000  # terms a task counts before it hands them on


class Automaton:
    """Trie of lexicon words intersected with the Levenshtein automaton of up to one edit, made deterministic on demand."""

    MOST = 200_000  # transitions kept; the table starts anew beyond

    def __init__(self, words: dict[str, float], edits: int = 1):
        self.edits, self.children, self.weight = edits, [{}], [0.0]
        for word, w in words.items():
            node = 0
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.weight.append(0.0)
                node = self.children[node][c]
            self.weight[node] = max(self.weight[node], w)
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.value: list[float] = []
        self.made = 0
        self.start = self._state({0: 0})

    def _state(self, at: dict[int, int]) -> int:
        """Number of the state with these trie nodes at these edits; left-out letters are followed first."""
        todo = list(at.items())
        for node, e in todo:
            if e < self.edits:
                for child in self.children[node].values():
                    if at.get(child, 9) > e + 1:
                        at[child] = e + 1
                        todo.append((child, e + 1))
        key = frozenset(at.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.value.append(max((self.weight[n] for n, _ in key), default=0.0))
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        at: dict[int, int] = {}

        def put(node, e):
            if e <= self.edits and at.get(node, 9) > e:
                at[node] = e

        for node, e in self.sets[state]:
            child = self.children[node].get(letter)
            if child is not None:
                put(child, e)
            if e < self.edits:
                put(node, e + 1)
                for other in self.children[node].values():
                    put(other, e + 1)
        return self._state(at) if at else -1

    def match(self, word: str) -> float:
        """Largest weight of a lexicon word within the allowed edits, 0 if there is none."""
        if self.made > self.MOST:
            self._reset()
        state = self.start
        for c in word:
            follow = self.steps[state].get(c)
            if follow is None:
                follow = self.steps[state][c] = self._step(state, c)
                self.made += 1
            if follow < 0:
                return 0.0
            state = follow
        return self.value[state]


def _inside_quotes(tokens: Sequence[str], i: int) -> bool:
    """An odd number of quote marks on either side within the window: one that opens and one that closes."""
    letters = tokens[i].strip(EDGES)
    at = tokens[i].find(letters)
    left = [*tokens[max(0, i - WINDOW) : i], tokens[i][:at]]
    right = [tokens[i][at + len(letters) :], *tokens[i + 1 : i + WINDOW + 1]]
    return all(sum(c in QUOTES for t in side for c in t) % 2 for side in (left, right))


@dataclass
class Model:
    """Learned words and stems with their weights, words that are no misspellings, and the logistic coefficients."""

    words: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    known: frozenset = frozenset()
    key: str = field(default_factory=lambda: uuid.uuid4().hex)  # names the model in the workers
    coefficients: Sequence[float] = (-4.0, 1.2, 0.8, 0.5, 0.6, -0.3, 0.4, 0.2)  # constant first; the starting model

    def prepare(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A model with its automaton and its cache of tokens."""

    def __init__(self, model: Model):
        self.words, self.stems, self.known, self.coefficients = model.words, model.stems, model.known, model.coefficients
        self.fuzzy = Automaton({w: x for w, x in self.words.items() if len(w) >= FUZZY_FROM and x >= FUZZY_WEIGHT})
        self.cache = Cache(self._look, 100_000, 64)

    def _look(self, token: str) -> tuple[float, float] | None:
        """(weight as written, weight as a misspelling) of a token, None if it means nothing."""
        word = token.strip(EDGES)
        if not word:
            return None
        exact = max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n)])
        if exact > 0:
            return exact, 0.0
        if len(word) < FUZZY_FROM - 1 or word in self.known:
            return None
        near = self.fuzzy.match(word)
        return (0.0, near) if near > 0 else None

    def features(self, text: str | None) -> list[float]:
        tokens = (text or "").lower().split()
        found = list(map(self.cache.__getitem__, tokens))
        best = total = near = quoted = 0.0
        hits = aimed = 0
        for i in [i for i, v in enumerate(found) if v]:
            exact, fuzzy = found[i]
            around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            bare = {t.strip(EDGES) for t in around}
            if _inside_quotes(tokens, i) or not REPORTING.isdisjoint(bare):
                quoted = max(quoted, exact, fuzzy)
                continue
            hits += 1
            aimed += not SECOND_PERSON.isdisjoint(bare)
            best, total, near = max(best, exact), total + exact, max(near, fuzzy)
        return [best, math.log1p(total), math.log1p(hits), near, quoted, math.log1p(aimed), 10 * hits / (10 + len(tokens))]

    def score(self, text: str | None) -> float:
        z = self.coefficients[0] + sum(c * f for c, f in zip(self.coefficients[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic, half): at most ``sample`` labelled training rows, half of each class, stored."""
    train = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    train = train.where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    by_hash = [F.xxhash64("id"), F.col("id")]
    chosen = [train.where(F.col("toxic") == c).orderBy(*by_hash).limit(sample // 2) for c in (0, 1)]
    few = stored(chosen[0].union(chosen[1]), "train")  # at most `sample` rows of 12 bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(few), "id")
    return stored(joined.select("text", "toxic", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int").alias("half")), "sample")


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, stem, t0, t1, c0, c1): documents of each half with a word or stem, toxic and clean; one row per term."""

    names, kinds = ["term", "stem", "t0", "t1", "c0", "c1"], [pa.string(), pa.bool_(), *[pa.int64()] * 4]

    def rows(counts):
        out = [(w, s, *c) for (w, s), c in counts.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    def run(batches):
        counts: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            for text, toxic, half in zip(*batch.columns):
                words = {t.strip(EDGES) for t in (text.as_py() or "").lower().split()}
                terms = {(w, False) for w in words if 3 <= len(w) <= 40}
                terms |= {(w[:n], True) for w in words for n in STEMS if len(w) > n}
                slot = half.as_py() if toxic.as_py() else 2 + half.as_py()
                for t in terms:
                    counts.setdefault(t, [0, 0, 0, 0])[slot] += 1
                if len(counts) >= FLUSH:
                    yield rows(counts)
                    counts = {}
        if counts:
            yield rows(counts)

    out = in_workers(sample, run, "term string, stem boolean, t0 long, t1 long, c0 long, c1 long")
    return out.groupBy("term", "stem").agg(*[F.sum(c).alias(c) for c in ("t0", "t1", "c0", "c1")])


def _lexicon(counts: DataFrame, n: Sequence[int], halves: Sequence[int], most: int) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and stems that are clearly likelier in toxic documents (log-likelihood ratio over 12)."""
    t, c = sum((F.col(f"t{h}") for h in halves), F.lit(0)), sum((F.col(f"c{h}") for h in halves), F.lit(0))
    nt, nc = sum(n[h] for h in halves), sum(n[2 + h] for h in halves)
    if not nt or not nc:
        return {}, {}
    share = nt / (nt + nc)
    expect_t, expect_c = (t + c) * share, (t + c) * (1 - share)
    ratio = 2 * (t * F.log(F.greatest(t, F.lit(0.5)) / expect_t) + c * F.log(F.greatest(c, F.lit(0.5)) / expect_c))
    weight = F.log(((t + 0.5) / (nt + 1)) / ((c + 0.5) / (nc + 1)))
    picked = counts.where(t >= 2).select("term", "stem", weight.alias("w"), ratio.alias("g")).where("g > 12 and w > 1.5")
    rows = picked.orderBy(F.desc("g"), "term", "stem").limit(most).collect()  # at most `most` rows
    words = {r.term: min(CAP, r.w) for r in rows if not r.stem}
    return words, {r.term: min(CAP, r.w) for r in rows if r.stem}


def _known(counts: DataFrame, model: Model) -> frozenset:
    """Words of clean sampled documents within an edit of the lexicon: a part of the bounded sample's vocabulary."""

    def run(batches):
        m = Model(model.words, model.stems).prepare()
        for batch in batches:
            near = [w for w in batch.column(0).to_pylist() if (v := m._look(w)) and v[1] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], ["term"])

    words = counts.where("not stem and c0 + c1 > 0").select("term")
    return frozenset(r.term for r in in_workers(words, run, "term string").collect())


def _logistic(x: np.ndarray, y: np.ndarray, start: Sequence[float], ridge: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Newton steps on the log likelihood, penalised by the distance from ``start``."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.full(x.shape[1], ridge)
    w = start = np.array(start)

    def loss(w):
        z = x @ w
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(penalty * (w - start) ** 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty * (w - start)
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step, now = np.linalg.solve(bend, slope), loss(w)
        while np.abs(step).max() > 1e-9 and loss(w + step) > now:
            step = step / 2
        w = w + step
        if np.abs(step).max() <= 1e-9:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MAX_TERMS) -> Model:
    """Lexicon of one half of the sample, coefficients on the other half, then the lexicon of both."""
    rows = _sample(docs, labels, sample)
    n = [0, 0, 0, 0]
    for r in rows.groupBy("toxic", "half").count().collect():
        n[r.half if r.toxic else 2 + r.half] = r["count"]
    if not (n[0] + n[1]) or not (n[2] + n[3]):
        return Model({})
    counts = stored(_term_counts(rows), "terms")

    def lexicon(halves):
        words, stems = _lexicon(counts, n, halves, most)
        model = Model(words, stems)
        model.known = _known(counts, model)
        return model

    first, final = lexicon([0]), lexicon([0, 1])

    def run(batches):
        m = first.prepare()
        for batch in batches:
            f = [m.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), batch.column(1)], ["f", "toxic"])

    got = in_workers(rows.where("half = 1").select("text", "toxic"), run, "f array<double>, toxic int").collect()  # at most `sample` rows
    y = np.array([r.toxic for r in got], float)
    if len(got) and 0 < y.sum() < len(y):
        order = sorted(range(len(got)), key=lambda i: (got[i].toxic, got[i].f))
        final.coefficients = _logistic(np.array([got[i].f for i in order]), y[order], final.coefficients).tolist()
    return final


def score(docs: DataFrame, model: Model, keep: Sequence[str] | None = None) -> DataFrame:
    """(row, score): the columns ``keep`` of each row (all of them by default) as a struct, and its score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col("text").cast("string")
    if keep is None:  # the text goes to the workers once, within the row
        picked = docs.withColumn("text", text).select(F.struct("*").alias("row"))
    else:
        picked = docs.select(F.struct(*keep).alias("row"), text.alias("text"))

    def run(batches):
        m = held(("toxicity", sent.value.key), sent.value.prepare)
        for batch in batches:
            texts = batch.column(0).field("text") if keep is None else batch.column(1)
            scores = [m.score(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "score"])

    schema = T.StructType([picked.schema["row"], T.StructField("score", T.DoubleType())])
    return in_workers(picked, run, schema)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = score(docs, learn(docs, table(spark, folder, "labels")), ["doc_id"]).select("row.doc_id", "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
