"""Multi-party chat formatting by perspective rotation.

For every participant of a dialogue the dialogue is rendered once with that speaker as ``assistant`` and the others as
``user`` with their names; the mask covers what the assistant says. A rendering is cut into parts of at most
``turns`` turns, so a dialogue of any length is whole yet never in one row or task: parts joined in order are the dialogue.
Offsets of a part come from running totals over parts, not from a gathered dialogue.

A turn is ``<|im_start|>ROLE[ name=NAME]\\n`` + text + ``<|im_end|>\\n``. Turns of role ``system`` open no perspective and stay
``system`` in all of them. In names, blanks and ``<|>=`` become ``_``.

Defined results: a null text is empty; a null or empty role is the participant ``unknown``; turns are in the order of
(turn, null last; role; text), repeated rows are repeated turns; rows of a null conversation id are one dialogue;
a dialogue of system turns only gives no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running_total, stored, table

TURNS = 64
OPEN, CLOSE, SYSTEM = "<|im_start|>", "<|im_end|>\n", "system"


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, nth, name, text): turns in order, numbered from 0 within the dialogue.

    Turns are ordered within coarse ranges of the turn number and of a hash first, so a very long dialogue is spread.
    """
    name = F.coalesce(F.nullif(F.col("role").cast("string"), F.lit("")), F.lit("unknown"))
    t = F.coalesce(F.col("turn").cast("long"), F.lit(9223372036854775807))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(-9223372036854775808)).alias("conv"),
        t.alias("turn"),
        F.shiftright(t, 10).alias("range"),
        name.alias("name"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.lit(1).cast("long").alias("one"),
    )
    order = [F.col("turn"), F.col("name"), F.col("text")]
    return running_total(rows, ["conv"], ["range"], order, "one", "nth").drop("range", "one", "turn")


def rotate(turns: DataFrame, per_part: int = TURNS) -> DataFrame:
    """(conv_id, speaker, part, n_parts, start, text, mask): one row per dialogue, participant and part.

    ``start`` is the part's offset in the dialogue's rendering; ``mask`` holds [start, end) pairs of the part's code points
    that the assistant says.
    """
    rows = stored(numbered(turns), "turns")
    speakers = rows.where(F.col("name") != SYSTEM).select("conv", F.col("name").alias("speaker")).distinct()
    plain = F.regexp_replace("name", r"[\s<|>=]", "_")
    own = F.col("name") == F.col("speaker")
    head = F.when(F.col("name") == SYSTEM, F.lit(f"{OPEN}{SYSTEM}\n")).when(own, F.lit(f"{OPEN}assistant\n"))
    head = head.otherwise(F.concat(F.lit(f"{OPEN}user name="), plain, F.lit("\n")))
    seen = rows.join(speakers, "conv").select(
        "conv", "conv_id", "speaker", "nth", F.floor(F.col("nth") / per_part).cast("long").alias("part"),
        F.concat(head, "text", F.lit(CLOSE)).alias("piece"), F.char_length(head).alias("skip"), F.char_length("text").alias("say"),
        (own & (F.col("name") != SYSTEM)).alias("own"),
    )
    so_far = Window.partitionBy("conv", "speaker", "part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("at", F.coalesce(F.sum(F.char_length("piece")).over(so_far), F.lit(0)) + F.col("skip"))
    span = F.when(F.col("own"), F.struct(F.col("nth"), F.col("at").cast("long").alias("b"), (F.col("at") + F.col("say")).cast("long").alias("e")))
    parts = seen.groupBy("conv", "conv_id", "speaker", "part").agg(
        F.sort_array(F.collect_list(F.struct("nth", "piece"))).alias("pieces"),  # at most `per_part` turns
        F.sort_array(F.collect_list(span)).alias("spans"),
        F.sum(F.char_length("piece")).alias("chars"),
    )
    parts = parts.select(
        "conv", "conv_id", "speaker", "part", "chars",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"),
        F.transform("spans", lambda s: F.array(s["b"], s["e"])).alias("mask"),
    )
    sizes = parts.select("conv", "speaker", "part", "chars").withColumn("range", F.shiftright("part", 10))
    placed = running_total(sizes, ["conv", "speaker"], ["range"], [F.col("part")], "chars", "start").drop("chars", "range")
    count = parts.groupBy("conv", "speaker").agg(F.count(F.lit(1)).alias("n_parts"))
    out = parts.join(placed, ["conv", "speaker", "part"]).join(count, ["conv", "speaker"])
    return out.select("conv_id", "speaker", "part", "n_parts", "start", "text", "mask")


def op8_chat_rotation(spark: SparkSession, folder: str) -> DataFrame:
    out = rotate(table(spark, folder, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m.cast("array<string>"))), ",")
    return out.select("conv_id", "speaker", "part", "n_parts", "start", F.sha2("text", 256).alias("text_sha256"), mask.alias("mask"))


SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(nullif(role, ''), 'unknown') AS name, coalesce(text, '') AS text, turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(nullif(role, ''), 'unknown'), coalesce(text, '')) - 1 AS nth
  FROM conversations),
s AS (SELECT DISTINCT conv_id, name AS speaker FROM t WHERE name <> 'system'),
h AS (SELECT t.*, s.speaker, nth // 64 AS part, CASE WHEN name = 'system' THEN '<|im_start|>system' WHEN name = speaker THEN '<|im_start|>assistant'
    ELSE '<|im_start|>user name=' || regexp_replace(name, '[\s<|>=]', '_', 'g') END || chr(10) AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS piece FROM h),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, speaker, part ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos FROM p),
g AS (SELECT conv_id, speaker, part, string_agg(piece, '' ORDER BY nth) AS body, sum(length(piece)) AS chars,
    coalesce(string_agg(pos::BIGINT || ':' || (pos + length(text))::BIGINT, ',' ORDER BY nth) FILTER (WHERE name = speaker AND name <> 'system'), '') AS mask
  FROM o GROUP BY conv_id, speaker, part)
SELECT conv_id, speaker, part::BIGINT AS part, count(*) OVER (PARTITION BY conv_id, speaker) AS n_parts,
  coalesce(sum(chars) OVER (PARTITION BY conv_id, speaker ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  sha256(body) AS text_sha256, mask
FROM g
"""
