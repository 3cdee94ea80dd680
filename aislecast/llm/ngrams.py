"""Perplexity of texts under an interpolated modified Kneser-Ney bigram model.

Counting is a Spark job: tasks turn their texts into 64-bit word hashes, count them in sorted arrays (a flush at a time) and
send packed pieces of these arrays to hash buckets, which merge them. A bucket therefore gets each word or pair at most once
per flush, however frequent it is, and no bucket follows one word. The merged counts are stored as sorted arrays in the
shared folder, one file per bucket, and scoring tasks map the files into memory and search them; nothing goes
through the driver but one line per bucket.

Words are A-Z lower-cased runs of non-blanks, each text ends with one end token; words are told apart by their hash.
The order of the model is two: almost every longer n-gram of a corpus is new, so its arrays would outgrow the input.

Defined results: a null or empty text is one end token; a null id is a training row; without training rows every token
gets the probability of an unknown word; discounts that the counts of counts leave undefined are 0.75; rows of
one id each count; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, in_workers, scratch, table

START, END = b"\t", b"\n"  # no word holds a blank
FLUSH = 1 << 21
PIECES = "bucket int, keys binary, counts binary"


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _packed(values: np.ndarray) -> bytes:
    """Bytes of an integer array, like bytes together, compressed."""
    width = values.dtype.itemsize
    planes = values.view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(bytes([width]) + planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1).T.copy().view(f"<u{raw[0]}").reshape(-1)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _mixed(keys: np.ndarray) -> np.ndarray:
    x = keys * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the upper 32 bits: ascending hashes have ascending buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _split(bucket: np.ndarray, buckets: int, *arrays: np.ndarray) -> Iterator[tuple]:
    """(bucket, its part of each array) in bucket order; order within a bucket is kept."""
    if buckets <= 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorted by counting
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order].astype(np.uint64), np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(edges)):
        at = order[edges[b] : edges[b + 1]]
        yield (int(b), *(a[at] for a in arrays))


def _write(path: str, values: np.ndarray) -> None:
    """A whole file or none, also if the task is run twice."""
    part = f"{path}.{os.getpid()}.part"
    values.tofile(part)
    os.replace(part, path)


def _mapped(path: str, kind) -> np.ndarray:
    return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)


class _Tokens:
    """Hashes of a text's words and the end token."""

    def __init__(self):
        self.seen = Cache(_hash, 200_000, 64)
        self.end = _hash(END)

    def hashes(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))
        out[-1] = self.end
        return out


def _flushes(batches, column: int = 0) -> Iterator[list[np.ndarray]]:
    """Hash arrays of texts, about FLUSH tokens at a time."""
    tokens, held, size = _Tokens(), [], 0
    for batch in batches:
        for text in batch.column(column):
            held.append(tokens.hashes(text.as_py()))
            size += len(held[-1])
            if size >= FLUSH:
                yield held
                held, size = [], 0
    if held:
        yield held


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


@dataclass
class Model:
    folder: str
    buckets: int
    offsets: list[int] = field(default_factory=list)  # first word number of each bucket
    types: int = 0  # V
    tokens: int = 0  # N
    pairs: int = 0  # distinct pairs
    discounts: tuple = (0.75, 0.75, 0.75)  # of pairs
    lower: tuple = (0.75, 0.75, 0.75)  # of continuation counts
    lower_types: tuple = (0, 0, 0)  # words with 1, 2, 3 or more distinct predecessors

    def open(self) -> Model:
        b = range(self.buckets)
        self.words = [_mapped(f"{self.folder}/word-{i}", "<u8") for i in b]
        self.counts = [_mapped(f"{self.folder}/count-{i}", "<u8") for i in b]
        return self

    def open_pairs(self) -> Model:
        b = range(self.buckets)
        self.keys = [_mapped(f"{self.folder}/pair-{i}", "<u8") for i in b]
        width = [os.path.getsize(f"{self.folder}/times-{i}") // max(1, len(self.keys[i])) for i in b]
        self.times = [_mapped(f"{self.folder}/times-{i}", f"<u{width[i] or 1}") for i in b]
        self.stats = [_mapped(f"{self.folder}/stats-{i}", "<u4").reshape(-1, 4) for i in b]
        return self

    def numbers(self, distinct: np.ndarray) -> np.ndarray:
        """Word numbers of ascending hashes, so ascending too; -1 for words not seen in training."""
        out = np.full(len(distinct), -1, np.int64)
        bucket = _bucket(distinct, self.buckets)
        edges = np.searchsorted(bucket, np.arange(self.buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(edges)):
            words, part = self.words[b], distinct[edges[b] : edges[b + 1]]
            if len(words):
                at = np.minimum(np.searchsorted(words, part), len(words) - 1)
                out[edges[b] : edges[b + 1]] = np.where(words[at] == part, at + self.offsets[b], -1)
        return out

    def _of_word(self, arrays: list[np.ndarray], numbers: np.ndarray) -> np.ndarray:
        """Entries of per-word arrays; ``numbers`` ascending and known."""
        edges = np.searchsorted(numbers, [*self.offsets, self.types])
        parts = [arrays[b][numbers[edges[b] : edges[b + 1]] - self.offsets[b]] for b in range(self.buckets) if edges[b] < edges[b + 1]]
        return np.concatenate(parts) if parts else arrays[0][:0]

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Training counts of distinct pairs."""
        out = np.zeros(len(keys), np.float64)
        for b, part, at in _split(_bucket(_mixed(keys), self.buckets), self.buckets, keys, np.arange(len(keys))):
            if len(self.keys[b]):
                place = np.minimum(np.searchsorted(self.keys[b], part), len(self.keys[b]) - 1)
                out[at] = np.where(self.keys[b][place] == part, self.times[b][place], 0)
        return out

    def scores(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, log10 of the add-a-half probability, log10 of the model's) of each token of texts that start at ``first``.

        Words are looked up once each; the start of a text is one more word, number ``types``.
        """
        distinct, of = np.unique(hashes, return_inverse=True)
        numbers = self.numbers(distinct)
        seen = numbers >= 0
        count, stats = np.zeros(len(distinct) + 1), np.zeros((len(distinct) + 1, 4))
        count[:-1][seen], stats[:-1][seen] = self._of_word(self.counts, numbers[seen]), self._of_word(self.stats, numbers[seen])
        base = np.log10((count[:-1] + 0.5) / (self.tokens + 0.5 * (self.types + 1)))
        stats[-1], count[-1] = self.start[:4], self.start[4]
        d, e = np.array([0.0, *self.discounts]), np.array([0.0, *self.lower])
        left, ahead = float(np.dot(self.lower, self.lower_types)), stats[:-1, 0]
        if self.pairs:
            low = (np.maximum(ahead - e[np.minimum(ahead, 3).astype(int)], 0) + left / (self.types + 1)) / self.pairs
        else:
            low = np.full(len(distinct), 1 / (self.types + 1))
        spare = np.divide(stats[:, 1:] @ d[1:], count, out=np.ones(len(count)), where=count > 0)
        before = np.empty_like(of)
        before[1:] = of[:-1]
        before[first] = len(distinct)
        pairs, back = np.unique(before * np.int64(len(distinct) + 1) + of, return_inverse=True)
        u, w = np.divmod(pairs, len(distinct) + 1)
        number = np.append(numbers, self.types)
        c, both = np.zeros(len(pairs)), (number[u] >= 0) & seen[w]
        c[both] = self.pair_counts((number[u[both]].astype(np.uint64) << np.uint64(32)) | numbers[w[both]].astype(np.uint64))
        high = np.divide(np.maximum(c - d[np.minimum(c, 3).astype(int)], 0), count[u], out=np.zeros(len(c)), where=count[u] > 0)
        return seen[of], base[of], np.log10(high + spare[u] * low[w])[back]


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of entries seen 1, 2, 3 and 4 times."""
    if not n[0] + 2 * n[1]:
        return (0.75, 0.75, 0.75)
    y = n[0] / (n[0] + 2 * n[1])
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.75
        out.append(d if 0 < d <= k else 0.75)
    return tuple(out)


def _count_words(texts: DataFrame, model: Model) -> None:
    buckets, folder = model.buckets, model.folder

    def count(batches):
        for held in _flushes(batches):
            words, n = np.unique(np.concatenate(held), return_counts=True)
            yield _rows([(b, _pack_sorted(w), _packed(c.astype("<u4"))) for b, w, c in _split(_bucket(words, buckets), buckets, words, n)])

    def merge(key, group):
        b = key[0].as_py()
        parts = [(_unpack_sorted(k.as_py()), _unpacked(c.as_py()).astype("<u8")) for k, c in zip(group.column("keys"), group.column("counts"))]
        words, n = _sum_by(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        _write(f"{folder}/word-{b}", words)
        _write(f"{folder}/count-{b}", n)
        return pa.table({"bucket": pa.array([b], pa.int32()), "types": pa.array([len(words)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    merged = in_workers(texts, count, PIECES).groupBy("bucket").applyInArrow(merge, "bucket int, types long, tokens long")
    found = {r.bucket: r for r in merged.collect()}  # one line per bucket
    for b in range(buckets):
        if b not in found:
            _write(f"{folder}/word-{b}", np.zeros(0, "<u8"))
            _write(f"{folder}/count-{b}", np.zeros(0, "<u8"))
        model.offsets.append(model.types)
        model.types += found[b].types if b in found else 0
        model.tokens += found[b].tokens if b in found else 0


def _count_pairs(texts: DataFrame, model: Model) -> None:
    buckets, folder = model.buckets, model.folder
    offsets = np.array([*model.offsets, model.types])
    types = model.types

    def count(batches):
        m = model.open()
        for held in _flushes(batches):
            distinct, of = np.unique(np.concatenate(held), return_inverse=True)
            numbers = m.numbers(distinct)[of]
            before = np.empty_like(numbers)
            before[1:] = numbers[:-1]
            before[np.cumsum([0, *(len(h) for h in held[:-1])])] = types
            keys, n = np.unique((before.astype(np.uint64) << np.uint64(32)) | numbers.astype(np.uint64), return_counts=True)
            yield _rows([(b, _pack_sorted(k), _packed(c.astype("<u4"))) for b, k, c in _split(_bucket(_mixed(keys), buckets), buckets, keys, n)])

    def merge(key, group):
        """Stores a bucket's pairs; sends each word's numbers of successors (by their counts) and predecessors on."""
        b = key[0].as_py()
        parts = [(_unpack_sorted(k.as_py()), _unpacked(c.as_py()).astype("<u8")) for k, c in zip(group.column("keys"), group.column("counts"))]
        keys, n = _sum_by(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        _write(f"{folder}/pair-{b}", keys)
        _write(f"{folder}/times-{b}", n.astype(np.min_scalar_type(n.max())))
        # a word's four numbers share a key: 4 * word + (0 predecessors, 1..3 successors seen once, twice, more often)
        after = (keys >> np.uint64(32)) * np.uint64(4) + np.minimum(n, 3).astype(np.uint64)
        ahead = (keys & np.uint64(0xFFFFFFFF)) * np.uint64(4)
        slots, times = np.unique(np.concatenate((ahead, after)), return_counts=True)
        home = np.minimum(np.searchsorted(offsets, (slots >> np.uint64(2)).astype(np.int64), side="right") - 1, buckets).astype(np.uint64)
        out = [(h, _pack_sorted(s), _packed(t.astype("<u4"))) for h, s, t in _split(home, buckets + 1, slots, times)]
        seen = np.array([np.count_nonzero(n == k) for k in (1, 2, 3, 4)] + [len(n)], "<u8")
        out.append((-1, _packed(seen), b""))
        return pa.Table.from_batches([_rows(out)])

    def gather(key, group):
        """Per-word numbers of one range of words, as a table of four columns; sums of what all pairs have."""
        b = key[0].as_py()
        blank = [0] * 5
        if b < 0:
            seen = np.sum([_unpacked(k.as_py()) for k in group.column("keys")], axis=0).tolist()
            return _line(b, seen, blank)
        first = int(offsets[b]) if b < buckets else types
        size = (int(offsets[b + 1]) - first) if b < buckets else 1
        total = np.zeros(size * 4, np.int64)
        for k, c in zip(group.column("keys"), group.column("counts")):
            total[_unpack_sorted(k.as_py()).astype(np.int64) - 4 * first] += _unpacked(c.as_py())
        if b == buckets:
            return _line(b, [*total.tolist(), 0], blank)
        _write(f"{folder}/stats-{b}", total.astype("<u4"))
        ahead = total[::4]
        return _line(b, [np.count_nonzero(ahead == k) for k in (1, 2, 3, 4)] + [np.count_nonzero(ahead >= 3)], blank)

    def _line(b, values, blank):
        return pa.table({"bucket": pa.array([b], pa.int32()), "n": pa.array([[int(v) for v in values] or blank], pa.list_(pa.int64()))})

    pairs = in_workers(texts, count, PIECES).groupBy("bucket").applyInArrow(merge, PIECES)
    lines = {r.bucket: r.n for r in pairs.groupBy("bucket").applyInArrow(gather, "bucket int, n array<long>").collect()}  # one line per bucket
    for b in range(buckets):
        for name in ("pair", "times", "stats"):
            if not os.path.exists(f"{folder}/{name}-{b}"):
                _write(f"{folder}/{name}-{b}", np.zeros(0, "<u4"))
    seen = lines.get(-1, [0] * 5)
    words = np.sum([lines[b] for b in range(buckets) if b in lines] or [[0] * 5], axis=0).tolist()
    model.pairs, model.discounts, model.lower = seen[4], _discounts(seen), _discounts(words)
    model.lower_types = (words[0], words[1], words[4])
    start = lines.get(buckets, [0] * 5)
    model.start = np.array([0, *start[1:4], 0], float)


def _shared(spark: SparkSession) -> str:
    """A fresh folder that workers can map files from: the shared folder must be mounted."""
    where = urlparse(scratch(spark, "ngrams"))
    if where.scheme not in ("", "file"):
        raise ValueError("memory mapping needs spark.checkpoint.dir on a mounted file system")
    os.makedirs(where.path)
    return where.path


def train(docs: DataFrame, buckets: int | None = None) -> Model:
    """Counts the texts of ``docs`` (a column ``text``) into a model stored in the shared folder."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    model = Model(_shared(docs.sparkSession), buckets or max(64, size[0] >> 24))  # about 16 MB of text per bucket
    _count_words(texts, model)
    _count_pairs(texts, model)
    model.start[4] = size[1]
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row."""
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        m, tokens = model.open().open_pairs(), _Tokens()

        def some(ids, held):
            sizes = np.array([len(h) for h in held])
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            known, base, full = m.scores(np.concatenate(held), first)
            columns = [pa.array(ids, pa.int64()), *(pa.array(x) for x in (sizes, np.add.reduceat(known.astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(full, first)))]
            return pa.RecordBatch.from_arrays(columns, names)

        ids, held, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                held.append(tokens.hashes(text.as_py()))
                size += len(held[-1])
                if size >= FLUSH // 2:
                    yield some(ids, held)
                    ids, held, size = [], [], 0
        if held:
            yield some(ids, held)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_workers(picked, run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = score(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
