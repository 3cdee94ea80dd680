"""SimHash fingerprints and groups of near duplicates by multi-index hashing.

A fingerprint is cut into two 32-bit segments; each segment has a table of the fingerprints by the segment's value. Two fingerprints within
two bits differ in at most one bit of one segment, so that segment's Hamming ball of radius one around either holds the
other: every fingerprint fetches the table entries of the 33 members of both balls, and complete distances decide. A value that many
fingerprints share (``CROWD``: families of near copies) is looked up by the other segment too: there the balls of radius one around the
whole fingerprint meet, in which two within two bits always have a member in common, and whose members point at the smallest
fingerprint of theirs. So no task gathers a family, no pairs of a family are listed, and no link is lost; connected components of the
links are the groups. Nothing is sampled or capped.

Defined results: a null or empty text (or blanks only) has fingerprint zero and is linked like any other; fewer words than
a shingle has make one shingle of all words; equal fingerprints are one node; a null id counts for no component id
(a component of null ids only has none); rows of one id stay rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, in_workers, stored, table

BITS, SEED, CHUNK = 64, 42, 1 << 16
SEGMENT, DISTANCE = 32, 2
CROWD = 32  # a segment's value with more fingerprints is looked up by the other segment too


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included, as a signed integer; shingles are hashed chunk by chunk."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    shingles = iter([b" ".join(tokens)]) if len(tokens) < words else map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    ones, n = np.zeros(BITS, np.int64), 0
    digest = xxhash.xxh64_intdigest
    while chunk := [digest(s, SEED) for s in islice(shingles, CHUNK)]:
        h = np.array(chunk, "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(chunk)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, digest, fp) of every row; ``fp`` is the fingerprint as a signed long, ``digest`` a hash of the text."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), words) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "digest", "fp"])

    return in_workers(_keyed(docs).select("id", "digest", "body"), run, "doc_id long, digest long, fp long")


def _keyed(docs: DataFrame) -> DataFrame:
    body = F.col("text").cast("string")
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(body).alias("digest"), body.alias("body"))


def _flips(bits) -> list[int]:
    """0 and each single bit, as signed 64-bit masks."""
    return [0, *(1 << b if b < BITS - 1 else -(1 << b) for b in bits)]


def table_entries(fps: DataFrame) -> DataFrame:
    """(segment, value, fp): each distinct fingerprint under the value of each of its segments."""
    low, high = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1)), F.shiftrightunsigned("fp", SEGMENT)
    both = F.array(*[F.struct(F.lit(i).alias("segment"), v.alias("value")) for i, v in enumerate((low, high))])
    return fps.select("fp", F.explode(both).alias("e")).select("e.segment", "e.value", "fp")


def probes(entries: DataFrame) -> DataFrame:
    """(segment, value, probe): the members of the ball of radius one around each segment of each fingerprint."""
    flips = F.array(*[F.lit(m).cast("long") for m in _flips(range(SEGMENT))])
    return entries.select("segment", F.explode(F.transform(flips, lambda m: F.col("value").bitwiseXOR(m))).alias("value"), F.col("fp").alias("probe"))


def candidates(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(probe, fp) of fingerprints of which one fetched the other, and (fp, null) of those that hold or fetched a crowded value."""
    entries = stored(table_entries(fps), "entries")
    crowded = entries.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("segment", "value")
    held = stored(entries.join(crowded.withColumn("crowded", F.lit(True)), ["segment", "value"], "left"), "held")
    once = held.where("crowded").select("segment", "value", F.lit(None).cast("long").alias("fp")).distinct()
    table_ = held.where("crowded is null").select("segment", "value", "fp").union(once)
    # Spark sizes the probes as their entries, 33 times too low, and would broadcast them
    met = table_.join(probes(entries).hint("merge"), ["segment", "value"]).where("fp is null or probe < fp").select("probe", "fp")
    return met.union(held.where("crowded").select("fp", F.lit(None).cast("long"))).distinct()


def verified(pairs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def links(fps: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """(a, b): fingerprints that are verified to differ in at most ``distance`` (up to 2) bits, and link all that do."""
    met = stored(candidates(fps, crowd), "candidates")
    pairs = met.where("fp is not null").select(F.col("probe").alias("a"), F.col("fp").alias("b"))
    flips = F.array(*[F.lit(m).cast("long") for m in _flips(range(BITS))])
    many = met.where("fp is null").select(F.col("probe").alias("fp")).distinct()
    balls = many.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("member"))  # a member has at most 65 of them
    least = balls.withColumn("least", F.min("fp").over(Window.partitionBy("member"))).where("fp <> least")
    return verified(pairs.union(least.select(F.col("least").alias("a"), F.col("fp").alias("b"))), distance)


def groups(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, digest, fp, root, component_id) of every row: ``root`` names its group, ``component_id`` is the group's smallest id."""
    marked = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"))).withColumnsRenamed({"node": "fp"})
    rooted = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(least, "root").select("fp", "root", "component_id"), "groups")
    return marked.join(named, "fp")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links, for every row."""
    return groups(docs, words).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group: that of the smallest id, without ids that of the smallest hash."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("f")
    least = groups(docs, words).groupBy("root").agg(first)
    chosen = least.select(F.col("f.doc_id").alias("keep"), F.col("f.digest").alias("of"))
    rows = _keyed(docs)
    hit = rows.join(chosen, rows.id.eqNullSafe(chosen.keep) & (rows.digest.eqNullSafe(chosen["of"])), "left_semi")
    same = Window.partitionBy("id", "digest").orderBy("id")
    return hit.select("row", F.row_number().over(same).alias("n")).where("n = 1").select("row.*")


def op10_simhash(spark, folder):
    out = near_duplicates(table(spark, folder, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
