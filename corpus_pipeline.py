"""The corpus pipeline: documents that are not toxic, without lines and documents that others hold, mixed and encoded.

A stage takes (spark, docs, folder of tables) and returns the next documents; each is written before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislecast.llm import bpe, linededup, mixing, simhash, toxicity
from aislecast.llm.common import stored, table


def clean(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document, less the lines that a smaller id holds; n_chars follows."""
    length = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    row = F.when(F.col("n_dropped") > 0, F.col("row").withField("text", F.col("kept")).withField("n_chars", length)).otherwise(F.col("row"))
    return linededup.dedup(docs).select(row.alias("row")).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id."""
    return simhash.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", clean),
    ("line_dedup", without_repeated_lines),
    ("simhash_dedup", one_of_each_group),
    ("mixing", mixture),
    ("bpe", encoded),
]
# Toxicity, SimHash and BPE have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
