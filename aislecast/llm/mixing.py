"""Mixing sources to target weights: weighted fair queueing of shuffled documents.

Every document is a packet of its source's queue, in the order of a hash of its id. Its virtual finish time is the
source's tokens up to its end, earlier passes over the source included, divided by the source's target. Packets are
sorted globally by finish time and served until the total budget is used up; a packet that is in service then is cut.
All running totals are taken in two levels of buckets (hash ranges of a source, ranges of finish time), so neither
a source with a third of all documents nor the global order passes through one task.

Targets: weights 5, 2, 1, repeating over the sources by code point (null last), share all tokens; none exceeds ``passes``
times its source, what is above is shared again by weight, which ends at min(passes * size, weight * level).

Defined results: a null text has size 0; a source without tokens has target 0; rows of one id are packets of their own and
equal rows are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_BLANK, running_total, stored, table

WEIGHTS = (5, 2, 1)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, digest, b1, b2, place): the packets' sizes and their places in the shuffled order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(NOT_BLANK)).cast("long").alias("size"),
        F.xxhash64(text).alias("digest"),
        F.substring(place, 1, 2).alias("b1"),
        F.substring(place, 3, 2).alias("b2"),
        place.alias("place"),
    )


def targets(packets: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = 3) -> DataFrame:
    """(source, rank, source_size, target): one row per source."""
    per = packets.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("rank", nth).withColumn("weight", weight)
    per = per.withColumn("full_at", (passes * F.col("source_size")).cast("double") / F.col("weight"))
    up, down = Window.orderBy("full_at", "rank"), Window.orderBy(F.desc("full_at"), F.desc("rank"))
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("source_size").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * passes
    per = per.withColumn("level", (total - before).cast("double") / F.sum("weight").over(down))
    holds = F.when(F.col("full_at") >= F.col("level"), F.col("full_at"))
    level = F.min_by("level", F.when(holds.isNotNull(), F.struct("full_at", "rank"))).over(Window.partitionBy())
    cap = (passes * F.col("source_size")).cast("double")
    target = F.least(cap, F.coalesce(F.col("weight") * level, cap))
    return per.select("source", "rank", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = 3) -> DataFrame:
    """(doc_id, source, digest, size, source_size, target, taken): ``taken`` tokens of each document, repeats counted."""
    packets = stored(sizes(docs), "packets")
    goals = stored(targets(packets, weights, passes), "targets")
    budget = F.lit(packets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    named = packets.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    served = named.where("size > 0")
    queued = stored(running_total(served, ["rank"], ["b1", "b2"], [F.col("place"), F.col("digest")], "size", "ahead"), "queued")
    goal = F.ceil("target").cast("long")
    start = F.col("pass") * F.col("source_size") + F.col("ahead")
    packet = (
        queued.select("*", F.explode(F.array(*[F.lit(p) for p in range(passes)])).alias("pass"))
        .withColumn("length", F.least(F.col("size"), goal - start))
        .where("length > 0")
        .withColumn("finish", F.try_divide(start + F.col("length"), F.col("target")))
        .withColumn("f1", F.least(F.lit(255), F.floor(F.col("finish") * 256)).cast("int"))
        .withColumn("f2", F.least(F.lit(65535), F.floor(F.col("finish") * 65536)).cast("int"))
    )
    order = [F.col("finish"), F.col("rank"), F.col("ahead"), F.col("pass")]
    line = running_total(packet, [], ["f1", "f2"], order, "length", "position")
    cut = F.greatest(F.lit(0), F.least(F.col("length"), budget - F.col("position")))
    out, nothing = ["doc_id", "source", "digest", "size", "source_size", "target"], F.lit(0).cast("long").alias("taken")
    taken = line.groupBy(*out, "rank", "ahead").agg(F.sum(cut).alias("taken")).select(*out, "taken")
    late = queued.where(F.col("ahead") >= goal).select(*out, nothing)
    return taken.union(late).union(named.where("size = 0").select(*out, nothing))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = 3) -> DataFrame:
    """The rows of ``docs`` in the mix: each as often as it is taken whole, and cut to its first words where a part is taken.

    ``n_chars`` follows a cut text. Equal rows are told apart by a number, so each gets its own share.
    """
    same = Window.partitionBy("id", "digest", "of").orderBy("id")
    shares = mix(docs, weights, passes).where("taken > 0")
    shares = shares.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), "digest", "size", "taken")
    shares = shares.withColumn("copy", F.row_number().over(same.orderBy(F.desc("taken"))))
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("of"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"),
    ).withColumn("copy", F.row_number().over(same))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("id", "of", "digest", "copy")]
    taken = rows.alias("r").join(shares.alias("s"), on).select("r.row", "s.size", "s.taken")
    whole, rest = F.floor(F.col("taken") / F.col("size")), F.pmod("taken", "size")
    words = F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>"))
    served = taken.withColumn("words", F.explode(F.concat(F.array_repeat("size", whole.cast("int")), words)))
    blank = r"[\x20\x09-\x0D]"
    pattern = F.concat(F.lit(f"^(?:{blank}*+{NOT_BLANK}+){{"), F.col("words"), F.lit("}+"))
    text = F.when(F.col("words") < F.col("size"), F.regexp_substr("row.text", pattern)).otherwise(F.col("row.text"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("words") < F.col("size"), F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return served.select(row.alias("row")).select("row.*")


def op3_mixing(spark, folder):
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, 'null')) AS place,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM p),
r AS (SELECT *, (3 * source_size)::DOUBLE / weight AS full_at FROM w),
v AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY full_at DESC, rank DESC))::DOUBLE AS level FROM r),
x AS (SELECT level AS top FROM v WHERE full_at >= level ORDER BY full_at, rank LIMIT 1),
t AS (SELECT source, rank, source_size, least((3 * source_size)::DOUBLE, coalesce(weight * (SELECT top FROM x), (3 * source_size)::DOUBLE)) AS target FROM v),
q AS (SELECT d.doc_id, d.size, t.rank, t.source_size, t.target,
    (sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.place ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(0, least(size, ceil(target)::BIGINT - (pass * source_size + ahead))) AS length FROM q, range(3) g(pass)),
f AS (SELECT *, CASE WHEN target > 0 THEN (pass * source_size + ahead + length)::DOUBLE / target END AS finish FROM k),
s AS (SELECT *, sum(length) OVER (ORDER BY finish, rank, ahead, pass ROWS UNBOUNDED PRECEDING) - length AS position FROM f WHERE length > 0)
SELECT q.doc_id, q.size, q.source_size, q.target,
  coalesce((SELECT sum(greatest(0, least(s.length, (SELECT sum(size) FROM d) - s.position))) FROM s WHERE s.doc_id = q.doc_id), 0)::BIGINT AS taken
FROM q
"""
