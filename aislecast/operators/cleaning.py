"""Conforming, imputation, outliers, scaling, and the preprocessing chain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import daily_pattern, peak_hour, zero_share
from ..functions.calendar import calendar_columns
from ..functions.climate import quartile_label, temperature_label, weather_label
from .ranking import column_quantiles, exact_quantiles

WEATHER = ("avg_temperature", "avg_humidity", "precpt", "avg_wind_level")


def conform(df: DataFrame, schema: str | T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Select the columns of ``schema``; a missing one gets its default (flags false, numbers 0, else NULL)."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    defaults = dict(defaults or {})
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name)
        elif f.name in defaults:
            c = F.lit(defaults[f.name])
        elif isinstance(f.dataType, T.BooleanType):
            c = F.lit(False)
        elif isinstance(f.dataType, T.NumericType):
            c = F.lit(0)
        else:
            c = F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def impute(df: DataFrame, group: str = "city_id", columns: Sequence[str] = WEATHER) -> DataFrame:
    """Weather gaps get the mean of their city, discount and stock hours 0, arrays become empty.

    The city means are aggregated and joined, so one large city is never one window group.
    """
    means = df.groupBy(group).agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    out = df.join(means, group, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns})
    fixed = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("discount", "stock_hour6_22_cnt") if c in df.columns}
    for c, kind in (("hours_sale", "array<double>"), ("hours_stock_status", "array<int>")):
        if c in df.columns:
            fixed[c] = F.coalesce(F.col(c), F.array().cast(kind))
    return out.withColumns(fixed).drop(*[f"_{c}" for c in columns])


def impute_overall(df: DataFrame, columns: Sequence[str], how: str = "mean") -> DataFrame:
    """Gaps get the mean or the exact median of the whole column."""
    if how == "mean":
        fills = {c: df.agg(F.avg(c)).scalar() for c in columns}
    else:
        fills = {c: exact_quantiles(df, c, {"m": 0.5}).select("m").scalar() for c in columns}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), fill) for c, fill in fills.items()})


def outlier_bounds(df: DataFrame, value: str) -> DataFrame:
    """One row: the fences 1.5 quartile ranges outside the quartiles."""
    qs = exact_quantiles(df, value, {"q1": 0.25, "q3": 0.75})
    spread = (F.col("q3") - F.col("q1")) * 1.5
    return qs.select((F.col("q1") - spread).alias("lower"), (F.col("q3") + spread).alias("upper"))


def flag_outliers(df: DataFrame, value: str, bounds: DataFrame | None = None) -> DataFrame:
    """Outlier flag and capped copy; ``bounds`` may come from an earlier run."""
    bounds = outlier_bounds(df, value) if bounds is None else bounds
    x = F.col(value).cast("double")
    return df.withColumn("_f", bounds.select(F.struct("lower", "upper")).scalar()).withColumns(
        {
            "is_outlier": ((x < F.col("_f.lower")) | (x > F.col("_f.upper"))).cast("int"),
            f"{value}_capped": F.greatest(F.col("_f.lower"), F.least(F.col("_f.upper"), x)),
        }
    ).drop("_f")


def scaling_state(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of means and population deviations, to be saved beside the data."""
    aggs = []
    for c in columns:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}_mean"), F.stddev_pop(F.col(c).cast("double")).alias(f"{c}_std")]
    return df.agg(*aggs)


def zscale(df: DataFrame, columns: Sequence[str], state: DataFrame | None = None) -> DataFrame:
    """Standardised copies ``<column>_scaled`` (population deviation); NULL for a constant column."""
    state = scaling_state(df, columns) if state is None else state
    packed = state.select(F.struct(*state.columns)).scalar()
    out = df.withColumn("_s", packed)
    return out.withColumns(
        {
            f"{c}_scaled": F.try_divide(F.col(c).cast("double") - F.col(f"_s.{c}_mean"), F.col(f"_s.{c}_std"))
            for c in columns
        }
    ).drop("_s")


def add_labels(df: DataFrame) -> DataFrame:
    """Temperature, humidity quartile, rain and wind flags, composed weather label, discount level, day part, stock-out share."""
    three = (("a", 0.25), ("b", 0.5), ("c", 0.75))
    cuts = column_quantiles(
        df,
        {
            "avg_humidity": {f"h{n}": p for n, p in three},
            "discount": {f"d{n}": p for n, p in three},
            "avg_wind_level": {"wind": 0.5},
        },
    )
    out = df.withColumn("_q", cuts.select(F.struct(*cuts.columns)).scalar())
    quart = lambda c, s, labels: quartile_label(
        F.col(c).cast("double"), F.col(f"_q.{s}a"), F.col(f"_q.{s}b"), F.col(f"_q.{s}c"), labels
    )
    out = out.withColumns(
        {
            "temperature_level": temperature_label(F.col("avg_temperature")),
            "humidity_level": quart("avg_humidity", "h", ("Low", "Medium", "High", "Very High")),
            "is_rainy": (F.col("precpt") > 0).cast("int"),
            "is_windy": (F.col("avg_wind_level") > F.col("_q.wind")).cast("int"),
            "has_discount": (F.col("discount") > 0).cast("int"),
            "discount_level": quart("discount", "d", ("No Discount", "Low", "Medium", "High")),
            "daily_sales_pattern": daily_pattern(peak_hour(F.col("hours_sale"))),
            "stockout_risk": zero_share(F.col("hours_stock_status")),
        }
    )
    label = weather_label(
        F.col("is_rainy") == 1, F.col("is_windy") == 1, F.col("temperature_level"), F.col("humidity_level")
    )
    return out.withColumn("weather_condition", label).drop("_q")


def preprocess(df: DataFrame, bounds: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """Imputation, calendar, labels, outliers and scaling in order; saved bounds and state may be passed in."""
    out = add_labels(calendar_columns(impute(df)))
    out = flag_outliers(out, "sale_amount", bounds)
    return zscale(out, ["sale_amount", "sale_amount_capped", *WEATHER], state)
