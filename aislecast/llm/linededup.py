"""Removal of lines that other documents hold already: levelled sorted runs of line hashes.

Documents come in batches of ascending id. A batch's distinct line keys are anti-joined with every run of keys seen
before and its new keys become a run of their own, sorted by hash. Runs of one level are merged into a run of the next
level when ``fanout`` of them have gathered, so a batch meets few runs however many batches went before.

Defined results: a null or empty text is one empty line; a null id counts as larger than every id; rows of one id are one
document for the question which document holds a key, each keeps its own row; keys are compared by 128 hash bits;
an empty table gives an empty result; other columns pass through whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, stored, table

LAST = 9223372036854775807


class LineRuns:
    """The index: sorted runs of (h1, h2) by level, each a Parquet folder in the shared folder."""

    def __init__(self, fanout: int = 3):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def seen(self, keys: DataFrame) -> DataFrame:
        """``keys`` with a flag ``seen``: merge join with each run in turn; the keys stay partitioned by hash."""
        out = keys.withColumn("seen", F.lit(False))
        for run in self.runs():
            hit = run.select("h1", "h2", F.lit(True).alias("hit"))
            out = out.join(hit, ["h1", "h2"], "left").withColumn("seen", F.col("seen") | F.col("hit").isNotNull()).drop("hit")
        return out

    def add(self, run: DataFrame) -> None:
        """Adds a stored run, then compacts every level that is full."""
        level, new = 0, run
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            merged = self.levels[level][0].select("h1", "h2")
            for r in self.levels[level][1:]:
                merged = merged.union(r.select("h1", "h2"))
            new = stored(merged.repartitionByRange("h1").sortWithinPartitions("h1", "h2"), f"run{level + 1}")
            self.levels[level] = []
            level += 1


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        text.alias("body"),
        F.xxhash64(text).alias("digest"),
    )


def repeated_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(doc, digest, pos) of every line to drop; ``digest`` tells apart rows of one id."""
    rows = _rows(docs).select("doc", "digest", "body")
    at = [i / batches for i in range(1, batches)]
    bounds = (rows.agg(F.percentile_approx("doc", at, 10000)).first()[0] or []) if at else []
    batch = sum((F.when(F.col("doc") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    key = F.btrim(F.col("line"), F.lit(BLANKS))
    lines = stored(
        rows.select("doc", "digest", batch.alias("batch"), F.posexplode(F.split(ascii_lower(F.col("body")), "\n")).alias("pos", "line"))
        .where(F.char_length(key) >= min_chars)
        .select("doc", "digest", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), "batch"),
        "lines",
        ["batch"],
    )
    index, found = LineRuns(fanout), []
    for b in range(len(bounds) + 1):
        keys = lines.where(F.col("batch") == b).groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        run = stored(index.seen(keys).repartitionByRange("h1").sortWithinPartitions("h1", "h2"), "run0")
        index.add(run.where(~F.col("seen")))
        found.append(
            run.where(F.col("seen") | (F.col("first") < F.col("last"))).select(
                "h1", "h2", F.lit(b).alias("batch"), F.when(~F.col("seen"), F.col("first")).alias("owner")
            )
        )
    shared = found[0]
    for f in found[1:]:
        shared = shared.union(f)
    hit = lines.join(shared, ["batch", "h1", "h2"])
    return hit.where(F.col("owner").isNull() | (F.col("doc") != F.col("owner"))).select("doc", "digest", "pos")


def dedup(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(row, kept, n_lines, n_dropped): each input row as a struct with its text less the repeated lines."""
    drops = repeated_lines(docs, min_chars, batches, fanout).groupBy("doc", "digest").agg(F.collect_set("pos").alias("drop"))
    joined = _rows(docs).join(drops, ["doc", "digest"], "left")
    parts = F.split("body", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("drop"))
    kept = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    return joined.select(
        "row",
        F.when(F.col("drop").isNull(), F.col("body")).otherwise(kept).alias("kept"),
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op1_line_dedup(spark, folder):
    out = dedup(table(spark, folder, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, n, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k),
f AS (SELECT l.doc_id, l.n, l.line, o.owner IS NULL OR o.owner = l.doc_id AS keep FROM l LEFT JOIN o ON l.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE keep), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
