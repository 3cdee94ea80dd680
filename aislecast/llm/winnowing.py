"""Document fingerprints by winnowing, and how much of them survives an edit.

A text's characters (A-Z lower-cased, blanks alike) give rolling hashes of every k-gram; of every window of ``window``
consecutive hashes the smallest is chosen, of equal ones the rightmost, and kept with its position. Two texts that share
``k + window - 1`` characters share a fingerprint; positions say where.

Neighbours in id order are found without a global sort into one task: ids are cut into ranges at approximate quantiles,
each range is sorted within a task and read as a stream that keeps one row; the first row of each range is also sent to
the end of the range before (of the first range: to the end of the last).

Defined results: a null text is empty; an empty text has no hash, it is like another empty text (1.0) and unlike any
other (0.0); a text shorter than ``k`` has the hash of all of it; texts with fewer hashes than a window give their
smallest; a null id comes last; rows of one id follow in the order of their texts' hashes; one row is its own next;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_workers, table

LAST = 9223372036854775807
K, WINDOW = 12, 12
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
CHUNK = 1 << 20


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Rolling polynomial hash of every k-gram, mixed; built from the bits of k, so each step is one pass over the text."""
    n = len(codes) - k + 1
    total, length = None, 0
    power, width = codes.astype(np.uint64) + np.uint64(1), 1
    step, k_left = BASE, k
    while k_left:  # `power` holds the hash of `width` characters from each place
        if k_left & 1:
            piece = power[length : length + n]
            total = piece.copy() if total is None else total * np.uint64(step) + piece
            length += width
        k_left >>= 1
        if k_left:
            power = power[:-width] * np.uint64(step) + power[width:]
            step, width = step * step & MASK, width * 2
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def _choose(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of every window, rightmost of equal ones, each place once."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    low, at, width = h, np.arange(len(h)), 1
    while width < window:  # smallest of `width` hashes from each place
        shift = min(width, window - width)
        right = low[shift:] <= low[:-shift]
        low, at = np.where(right, low[shift:], low[:-shift]), np.where(right, at[shift:], at[:-shift])
        width += shift
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the chosen k-grams, places ascending; long texts are worked through in overlapping pieces."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    codes = np.where((codes >= 9) & (codes <= 13), 32, codes)
    k = min(k, len(codes))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, max(1, len(codes) - k - window + 2), CHUNK):
        h = _hashes(codes[start : start + CHUNK + k + window - 2], k)
        at = _choose(h, window)
        if found and len(at) and at[0] + start == found[-1][1][-1]:
            at = at[1:]
        found.append((h[at], at + start))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sets of hashes (each ascending, distinct)."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(hashes: np.ndarray, places: np.ndarray) -> str:
    return hashlib.sha256(hashes.astype("<u8").tobytes() + places.astype("<i8").tobytes()).hexdigest()


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, hashes, places): the whole fingerprint of every row; hashes as signed longs."""

    def run(batches):
        for batch in batches:
            out = [winnow(t.as_py() or "", k, window) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.view(np.int64) for h, _ in out], pa.list_(pa.int64())),
                 pa.array([p for _, p in out], pa.list_(pa.int64()))], ["doc_id", "hashes", "places"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_workers(picked, run, "doc_id long, hashes array<long>, places array<long>")


def _longs(values) -> F.Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(value: F.Column, bounds: list[int]) -> F.Column:
    """Number of bounds below ``value``, found in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda array: F.size(F.filter(array, lambda b: b < value))
    head = below(_longs([c[-1] for c in chunks]))
    rows = F.transform(F.split(F.lit(";".join(",".join(map(str, c)) for c in chunks)), ";"), lambda c: F.split(c, ",").cast("array<bigint>"))
    return head * step + F.coalesce(below(F.get(rows, head)), F.lit(0))


def in_order(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(part, echo, id, doc_id, text): sorted within ranges of ids; echo rows follow a range and only serve as next.

    ``ranges`` is four times the shuffle partitions by default, so it grows with the cluster's setting for the input.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / ranges for i in range(1, ranges)]
    ids = rows.select("id")
    bounds = sorted(set((ids.agg(F.percentile_approx("id", at, 20 * ranges)).first()[0] or []) if at else []))
    part = _range_of(F.col("id"), bounds)
    firsts = [tuple(r) for r in sorted(ids.select("id", part.alias("part")).groupBy("part").agg(F.min("id")).collect())]
    echoes = [(first, before) for (_, first), (before, _) in zip(firsts, firsts[-1:] + firsts[:-1])]
    marks = F.broadcast(spark.createDataFrame(echoes, "first long, before int"))  # one row per range
    both = rows.withColumn("part", part).join(marks, F.col("id") == F.col("first"), "left")
    once = F.struct(F.col("part").alias("part"), F.lit(0).alias("echo"))
    again = F.struct(F.col("before").alias("part"), F.lit(1).alias("echo"))
    copies = F.when(F.col("before").isNull(), F.array(once)).otherwise(F.array(once, again))
    spread = both.select("id", "doc_id", "text", F.explode(copies).alias("at")).select("at.part", "at.echo", "id", "doc_id", "text")
    return spread.repartition("part").sortWithinPartitions("part", "echo", "id", F.xxhash64("text"))


def edits(docs: DataFrame, ranges: int | None = None, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last half replaced by the first as many characters of the next row's text.
    """

    def row(now, after):
        doc_id, text, h, p, own = now
        cut = len(text) // 2
        edited = text[: len(text) - cut] + after[1][:cut]
        eh, ep = winnow(edited, k, window)
        return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(h, p),
                digest(eh, ep), likeness(own, np.unique(eh)), likeness(own, after[4]))

    def run(batches):
        part, now = None, None
        for batch in batches:
            out = []
            for at, echo, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), map(pa.StringScalar.as_py, batch.column(4))):
                if at != part:
                    part, now = at, None
                if echo and now is None:
                    continue
                h, p = winnow(text, k, window)
                after = (doc_id, text, h, p, np.unique(h))
                if now is not None:
                    out.append(row(now, after))
                now = None if echo else after
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=ARROW)

    return in_workers(in_order(docs, ranges), run, SCHEMA)


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")),
     ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def op9_winnowing(spark, folder):
    return edits(table(spark, folder, "documents"))
