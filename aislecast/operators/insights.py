"""Insight rows from the outputs of other operators, health score, executive summary, rule advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import ladder, ratio

PRIORITY_WEIGHT = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def insight(df: DataFrame, kind: str, category: str, subject: Column, priority: Column, confidence: Column, impact: Column) -> DataFrame:
    """Rows of one source in the common insight layout."""
    return df.select(
        F.lit(kind).alias("insight_type"),
        F.lit(category).alias("category"),
        subject.cast("string").alias("subject"),
        priority.alias("priority"),
        confidence.cast("double").alias("confidence"),
        impact.cast("double").alias("impact"),
    )


def fuse(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def from_alerts(alerts: DataFrame) -> DataFrame:
    subject = F.concat_ws(":", F.col("store_id").cast("string"), "item")
    return insight(alerts, "alert", "operations", subject, F.col("severity"), F.lit(85.0), F.col("revenue_impact"))


def from_transfers(transfers: DataFrame) -> DataFrame:
    p = F.when(F.col("priority") == "immediate", "critical").otherwise(F.col("priority"))
    subject = F.concat_ws(">", F.col("source_store_id").cast("string"), F.col("target_store_id").cast("string"), F.col("product_id").cast("string"))
    return insight(transfers, "transfer", "inventory", subject, p, F.col("optimization_score"), F.col("revenue_impact"))


def from_bundles(bundles: DataFrame) -> DataFrame:
    subject = F.concat_ws("+", F.col("item_a").cast("string"), F.col("item_b").cast("string"))
    p = F.when(F.col("r") >= 0.7, "high").otherwise("medium")
    return insight(bundles, "bundle", "portfolio", subject, p, F.col("success_probability") * 100, F.col("revenue_potential"))


def from_segments(segments: DataFrame) -> DataFrame:
    p = ladder("churn_share", [(0.5, "high"), (0.25, "medium")], "low")
    return insight(segments, "segment", "customers", F.col("name"), p, F.lit(75.0), F.col("lifetime_value").cast("double") * 0.1)


def from_threats(threats: DataFrame) -> DataFrame:
    return insight(threats, "threat", "competition", F.col("first_category"), F.col("severity"), F.lit(70.0), F.col("impact"))


def health_score(insights: DataFrame, kinds: Sequence[str] = ("alert", "transfer", "bundle", "segment", "threat"), default: float = 70.0) -> DataFrame:
    """Mean confidence per kind (70 where a kind has no insight), overall mean, status and counts of pressing ones."""
    per = insights.groupBy("insight_type").agg(F.avg("confidence").alias("c"))
    pressing = insights.agg(
        F.struct(F.count_if(F.col("priority") == "critical").alias("critical"), F.count_if(F.col("priority") == "high").alias("high"))
    ).scalar()
    means = per.groupBy().agg(
        *[F.coalesce(F.max(F.when(F.col("insight_type") == k, F.col("c"))), F.lit(default)).alias(f"{k}_score") for k in kinds]
    )
    total = sum((F.col(f"{k}_score") for k in kinds), F.lit(0.0)) / len(kinds)
    out = means.withColumn("overall_score", total).withColumn("_p", pressing)
    return out.withColumns(
        {
            "status": ladder("overall_score", [(80, "excellent"), (70, "good"), (60, "fair")], "poor"),
            "critical_count": F.col("_p.critical"),
            "high_count": F.col("_p.high"),
        }
    ).drop("_p")


def executive_summary(insights: DataFrame) -> DataFrame:
    """Per category: insights, pressing ones, mean confidence, impact and priority-weighted score."""
    table = F.create_map(*[F.lit(x) for kv in PRIORITY_WEIGHT.items() for x in kv])
    weight = F.coalesce(F.try_element_at(table, F.col("priority")), F.lit(1))
    return insights.withColumn("_w", weight).groupBy("category").agg(
        F.count(F.lit(1)).alias("insights"),
        F.count_if(F.col("priority").isin("critical", "high")).alias("pressing"),
        F.avg("confidence").alias("avg_confidence"),
        F.sum("impact").alias("total_impact"),
        ratio(F.sum(F.col("confidence") * F.col("_w")), F.sum("_w")).alias("weighted_score"),
    )


def stored_summary(stored: DataFrame) -> DataFrame:
    """Stored insights with JSON impact: counts, completed, mean confidence, summed revenue impact."""
    revenue = F.get_json_object("potential_impact", "$.revenue_impact").cast("decimal(18,2)")
    return stored.groupBy("category", "insight_type", "priority").agg(
        F.count(F.lit(1)).alias("total_insights"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.avg("confidence").alias("avg_confidence"),
        F.sum(revenue).alias("total_revenue"),
    )


def custom_report(insights: DataFrame, categories: Sequence[str] | None = None, priorities: Sequence[str] | None = None, min_impact: float = 0.0) -> DataFrame:
    out = insights.filter(F.col("impact") >= min_impact)
    if categories is not None:
        out = out.filter(F.col("category").isin(list(categories)))
    if priorities is not None:
        out = out.filter(F.col("priority").isin(list(priorities)))
    return out.groupBy("category", "insight_type", "priority").agg(F.count(F.lit(1)).alias("insights"), F.sum("impact").alias("impact"))


def advice(metrics: DataFrame, key: str, rules: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    """One row per entity and triggered rule; ``rules`` holds (rule id, priority, condition, value)."""
    hits = [
        F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(p).alias("priority"), value.cast("double").alias("value")))
        for rule, p, cond, value in rules
    ]
    return metrics.select(key, F.explode(F.array_compact(F.array(*hits))).alias("r")).select(key, "r.*")
