"""Forecasts: naive, seasonal regression, ensemble, model based, with roll-ups and accuracy."""

from __future__ import annotations

import math
from collections.abc import Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import calendar_columns, is_weekend
from ..functions.core import ladder, mean_if, mean_of, ratio, safe_corr, std_of
from ..session import written
from . import trees
from .features import forecast_features, future_frame
from .linearfolds import cross_validated, fold_moments
from .series import tail_rank
from .trees import with_tree_spread

SEED = 42
Z95 = 1.96


def tail_stats(daily: DataFrame, keys: Sequence[str], value: str, tail: int) -> DataFrame:
    """Mean, deviation, rows and last day of the newest ``tail`` rows of each series."""
    ranked = tail_rank(daily, keys).filter(F.col("from_end") <= tail)
    return ranked.groupBy(*keys).agg(
        mean_of(value).alias("mean"),
        F.coalesce(std_of(value), F.lit(0.0)).alias("std"),
        F.count(F.lit(1)).alias("rows"),
        F.max("sale_date").alias("last_date"),
    )


def naive_forecast(
    daily: DataFrame, keys: Sequence[str], horizon: int, value: str = "sale_amount", tail: int = 30, weekend: float = 0.8
) -> DataFrame:
    """Mean of the last ``tail`` rows, lower at weekends, with a 95 % band floored at 0."""
    s = tail_stats(daily, keys, value, tail)
    days = s.select("*", F.explode(F.sequence(F.date_add("last_date", 1), F.date_add("last_date", horizon))).alias("date"))
    p = F.col("mean") * F.when(is_weekend(F.col("date")), weekend).otherwise(1.0)
    band = F.col("std") * Z95
    return days.select(
        *keys, "date", p.alias("forecast"), F.greatest(F.lit(0.0), p - band).alias("lower"), (p + band).alias("upper")
    )


def interval_table(stats: DataFrame, z: Sequence[tuple[str, float]] = (("80", 1.28), ("95", 1.96), ("99", 2.58))) -> DataFrame:
    """Bounds at several confidence levels around a mean, lower bounds floored at 0."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(v).alias("z")) for n, v in z]))
    j = stats.select("*", rows.alias("_z")).select("*", "_z.level", "_z.z")
    return j.withColumns(
        {"lower": F.greatest(F.lit(0.0), F.col("mean") - F.col("z") * F.col("std")), "upper": F.col("mean") + F.col("z") * F.col("std")}
    ).drop("_z", "z")


def ensemble(parts: dict[str, tuple[DataFrame, float]], keys: Sequence[str]) -> DataFrame:
    """Weighted mean of forecasts and of their bounds; the weights must sum to 1."""
    total = sum(w for _, w in parts.values())
    if abs(total - 1.0) > 1e-9:
        raise ValueError(f"ensemble weights sum to {total}, not 1")
    cols, on = ("forecast", "lower", "upper"), [*keys, "date"]
    out = None
    for name, (df, _) in parts.items():
        part = df.select(*on, *[F.col(c).alias(f"{c}_{name}") for c in cols])
        out = part if out is None else out.join(part, on)
    mix = lambda c: sum((F.col(f"{c}_{n}") * w for n, (_, w) in parts.items()), F.lit(0.0))
    return out.select(*on, *[mix(c).alias(c) for c in cols])


def with_future_regressors(forecast: DataFrame, weather: DataFrame, promotions: DataFrame) -> DataFrame:
    """Forecast days with the weather and promotion rows of the same key and day; no promotion means 0."""
    w = forecast.join(weather, ["city_id", "date"], "left")
    return w.join(promotions, ["city_id", "date"], "left").withColumns(
        {"promo_count": F.coalesce("promo_count", F.lit(0)), "promo_discount": F.coalesce("promo_discount", F.lit(0.0))}
    )


def rollup(forecast: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Forecast totals per day by each level and overall, in one pass of grouping sets."""
    sets = [[F.col("date"), F.col(x)] for x in levels] + [[F.col("date")]]
    out = forecast.groupingSets(sets, F.col("date"), *[F.col(x) for x in levels]).agg(
        F.sum("forecast").alias("forecast"), F.count(F.lit(1)).alias("series")
    )
    return out


def growth_insights(forecast: DataFrame, daily: DataFrame, keys: Sequence[str], value: str = "sale_amount") -> DataFrame:
    """Predicted total and growth against the historical mean with the advice class it gives."""
    f = forecast.groupBy(*keys).agg(F.sum("forecast").alias("total_predicted"), F.avg("forecast").alias("avg_predicted"))
    h = daily.groupBy(*keys).agg(mean_of(value).alias("avg_history"), std_of(value).alias("volatility"), F.count(F.lit(1)).alias("data_points"))
    j = f.join(h, list(keys)).withColumn(
        "growth_pct", F.coalesce(ratio(F.col("avg_predicted") - F.col("avg_history"), "avg_history") * 100, F.lit(0.0))
    )
    return j.withColumn("advice", ladder("growth_pct", [(10, "expand"), (0, "maintain"), (-10, "watch")], "reduce", op=">"))


def backtest(daily: DataFrame, keys: Sequence[str], value: str = "sale_amount", window: int = 7, tail: int = 30) -> DataFrame:
    """One-step forecasts by the mean of the ``window`` rows before, for the newest ``tail`` rows."""
    w = W.partitionBy(*keys).orderBy("sale_date")
    frame = w.rowsBetween(-window, -1)
    x = F.col(value)
    pred = F.when(F.count(x).over(frame) == window, ratio(F.sum(x).over(frame), F.count(x).over(frame)))
    return tail_rank(daily.withColumn("forecast", pred), keys).filter((F.col("from_end") <= tail) & F.col("forecast").isNotNull())


def accuracy(pairs: DataFrame, keys: Sequence[str], actual: str = "sale_amount", predicted: str = "forecast") -> DataFrame:
    """MAPE, RMSE, MAE, bias and tracking signal of forecasts against actuals."""
    e = F.col(actual).cast("double") - F.col(predicted)
    mad = F.avg(F.abs(e))
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        (F.avg(ratio(F.abs(e), F.col(actual))) * 100).alias("mape"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        mad.alias("mae"),
        F.avg(e).alias("bias"),
        F.try_divide(F.sum(e), mad).alias("tracking_signal"),
    )


def series_dashboard(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One line per series: accuracy, confidence, growth, best weekdays, weather link, promotion uplift, cover, risk.

    ``daily`` carries the amount, stock, promotion flag and temperature of each day.
    """
    a, r, promo = F.col("sale_amount"), F.col("from_end"), F.col("activity_flag")
    ranked = tail_rank(daily, keys)
    g = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        mean_of(a).alias("avg_daily_sales"),
        F.least(F.lit(95.0), F.greatest(F.lit(70.0), 95 - ratio(std_of(a), mean_of(a)) * 100)).alias("confidence"),
        mean_if(r <= 30, a).alias("_new"),
        mean_if(r.between(31, 60), a).alias("_old"),
        F.coalesce(F.abs(safe_corr("sale_amount", "avg_temperature")), F.lit(0.0)).alias("weather_factor"),
        F.coalesce(ratio(mean_if(promo, a) - mean_if(~promo, a), mean_if(~promo, a)) * 100, F.lit(0.0)).alias("promotion_uplift"),
        ratio(F.max(F.when(r == 1, F.col("stock_level"))), mean_of("units_sold")).alias("stock_days"),
        ratio(F.count_if(F.col("stock_hours") > 0), F.count(F.lit(1))).alias("stockout_risk"),
    )
    week = daily.groupBy(*keys, F.weekday("sale_date").alias("_d")).agg(mean_of(a).alias("_m"))
    peak = week.groupBy(*keys).agg(F.max_by("_d", F.struct("_m", -F.col("_d"))).alias("peak_day"))
    acc = accuracy(backtest(daily, keys), keys).select(
        *keys, F.least(F.lit(95.0), F.greatest(F.lit(60.0), 100 - F.col("mape"))).alias("forecast_accuracy")
    )
    growth = F.coalesce(ratio(F.col("_new") - F.col("_old"), "_old") * 100, F.lit(0.0))
    return g.join(peak, list(keys)).join(acc, list(keys), "left").withColumn("growth_pct", growth).drop("_new", "_old")


# ---- seasonal regression per series -----------------------------------------------------------


def _design(day: np.ndarray, origin: float, span: float, regressors: np.ndarray) -> np.ndarray:
    t = (day - origin) / max(span, 1.0)
    cols = [np.ones_like(t), t]
    for period, order in ((7.0, 3), (365.25, 5)):
        for k in range(1, order + 1):
            cols += [np.sin(2 * math.pi * k * day / period), np.cos(2 * math.pi * k * day / period)]
    return np.column_stack([*cols, regressors]) if regressors.size else np.column_stack(cols)


def seasonal_forecast(
    daily: DataFrame,
    keys: Sequence[str],
    horizon: int,
    value: str = "sale_amount",
    regressors: Sequence[str] = (),
    min_rows: int = 30,
    ridge: float = 1.0,
) -> DataFrame:
    """Trend, weekly and yearly terms and regressors by ridge regression, one small fit per series.

    A series is bounded by the calendar.  Future regressors keep their mean of the last 30 rows; results
    lie between 0 and 1.5 times the highest value seen.
    """
    regs = list(regressors)
    kinds = [daily.schema[k] for k in keys]
    out = T.StructType(kinds + [T.StructField("date", T.DateType())] + [T.StructField(c, T.DoubleType()) for c in ("forecast", "lower", "upper")])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [f.name for f in out.fields]
        if len(pdf) < min_rows:
            empty = {k: pdf[k].iloc[:0] for k in keys}
            empty["date"] = pd.Series([], dtype="datetime64[ns]")
            return pd.DataFrame({**empty, **{c: pd.Series([], dtype=float) for c in ("forecast", "lower", "upper")}})[names]
        pdf = pdf.sort_values("_day")
        day, y = pdf["_day"].to_numpy(dtype=float), pdf["_y"].to_numpy(dtype=float)
        r = pdf[regs].to_numpy(dtype=float) if regs else np.empty((len(pdf), 0))
        centre = r.mean(axis=0) if regs else np.empty(0)
        origin, span = day[0], day[-1] - day[0]
        x = _design(day, origin, span, r - centre)
        penalty = ridge * np.eye(x.shape[1])
        penalty[0, 0] = penalty[1, 1] = 0.0
        beta = np.linalg.solve(x.T @ x + penalty + 1e-9 * np.eye(x.shape[1]), x.T @ y)
        sd = float(np.std(y - x @ beta, ddof=1))
        ahead = day[-1] + np.arange(1, horizon + 1)
        future = np.tile((r[-30:].mean(axis=0) - centre) if regs else np.empty(0), (horizon, 1))
        p = np.clip(_design(ahead, origin, span, future) @ beta, 0.0, 1.5 * y.max())
        res = {k: [pdf[k].iloc[0]] * horizon for k in keys}
        res["date"] = pd.to_datetime(ahead, unit="D").date
        res.update(forecast=p, lower=np.maximum(0.0, p - Z95 * sd), upper=p + Z95 * sd)
        return pd.DataFrame(res)[names]

    rows = daily.select(
        *keys,
        F.unix_date("sale_date").alias("_day"),
        F.col(value).cast("double").alias("_y"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in regs],
    )
    return rows.groupBy(*keys).applyInPandas(fit, out)


# ---- models over all series ---------------------------------------------------------------------


def split_by_time(df: DataFrame, day: str = "sale_date", share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Older part and newer part at ``share`` of the calendar between the first and the last day (two dates read back)."""
    first, last = df.agg(F.min(F.unix_date(day)), F.max(F.unix_date(day))).first()
    old = F.unix_date(day) <= F.lit(None if first is None else first + int((last - first) * share))
    return df.filter(old), df.filter(~old)


ROWS_HELD, ROWS_MOST = 50_000, 500_000  # of a partition: that are worth one, and that one holds


def model_parts(rows: int, cores: int) -> int:
    """Partitions of model rows: each costs a forest a table of all open nodes a level, so no more than a task for each core and
    whole rounds of these where a task would hold too many rows."""
    return min(max(-(-rows // ROWS_HELD), 1), cores * max(-(-rows // (cores * ROWS_MOST)), 1))


def dealt(rows: DataFrame) -> DataFrame:
    """Model rows written once and read by all passes of a model, dealt anew where they lie in too many parts or far too few."""
    held = written(rows)
    parts, few = held.rdd.getNumPartitions(), model_parts(held.count(), rows.sparkSession.sparkContext.defaultParallelism)
    return held if few <= 2 * parts <= 2 * few else held.repartition(few)


def held_parts(rows: int, cores: int) -> int:
    """Two partitions a core, or more where these would hold more than ``ROWS_HELD`` rows."""
    return max(2 * cores, -(-rows // ROWS_HELD))


@contextmanager
def cached(df: DataFrame, parts=held_parts):
    """The frame held in memory and on disk while models are fitted on it; lost blocks are recomputed.

    Models run hundreds of jobs on it, each with a task for every partition, so few rows do not stay in many partitions: where there are
    more than two a core, the rows are dealt to ``parts`` (``model_parts`` where forests are most of the work).
    """
    held = df.persist()
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        few = parts(held.count(), cores)
        if held.rdd.getNumPartitions() > max(2 * cores, few):
            wide, held = held, held.repartition(few).persist()
            held.count()
            wide.unpersist()
        yield held
    finally:
        held.unpersist()


def regression_scores(predicted: DataFrame, label: str) -> dict[str, float]:
    ev = lambda m: RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=m).evaluate(predicted)
    return {m: ev(m) for m in ("mae", "mse", "r2")}


LINEAR = {"linear": (0.01, 0.0), "elastic_net": (0.1, 0.5)}  # strength of the penalty and its absolute part
DEPTHS = {"random_forest": 10, "gradient_boost": 4}
ROUNDS, STEP = 20, 0.3  # of boosting: a round is a job for each level of its one tree, whatever the cluster


ROW_TREES, TREES_LEAST = 200_000_000, 10  # rows times trees that grow together, and the least trees that do
APART = 1_000_003  # between the seeds of two batches of trees, more than there are partitions


def trees_at_once(rows: int, trees: int) -> int:
    """Trees that grow together: each keeps a count and a node for every row, and a table of its open nodes in every task."""
    return max(min(trees, TREES_LEAST), min(trees, ROW_TREES // max(rows, 1)))


class Forest(RandomForestRegressor):
    """Spark's forest, its trees grown in batches where the rows are many: all trees of one model, each on its own draw of all rows."""

    def _fit_java(self, dataset: DataFrame):
        trees, spark = self.getNumTrees(), dataset.sparkSession
        batches = -(-trees // trees_at_once(dataset.count(), trees))
        if batches == 1:
            return super()._fit_java(dataset)
        sizes = [(i + 1) * trees // batches - i * trees // batches for i in range(batches)]
        grown = []
        for i, n in enumerate(sizes):
            grower = RandomForestRegressor()
            self._copyValues(grower, {self.numTrees: n, self.seed: self.getSeed() + i * APART})
            part = grower._fit_java(dataset)
            grown += list(part.trees())
        ml = spark._jvm.org.apache.spark.ml.regression
        array = spark.sparkContext._gateway.new_array(ml.DecisionTreeRegressionModel, len(grown))
        for i, tree in enumerate(grown):
            array[i] = tree
        model = ml.RandomForestRegressionModel(self.uid, array, part.numFeatures())
        model.set(model.getParam("numTrees").w(trees))
        return model


def make_regressor(kind: str, label: str, features: str = "features", trees: int = 100, depth: int | None = None):
    """A forest of ``trees`` trees, up to ``ROUNDS`` boosted ones, or a linear model with its penalty; depths as in ``DEPTHS``.

    A forest's rows keep the node that they have reached in each tree, so no level goes down from the roots again.
    """
    if kind == "random_forest":
        inputs = {"labelCol": label, "featuresCol": features, "cacheNodeIds": True, "checkpointInterval": -1}
        return Forest(**inputs, numTrees=trees, maxDepth=depth or DEPTHS[kind], maxMemoryInMB=1024, seed=SEED)
    if kind == "gradient_boost":
        return GBTRegressor(labelCol=label, featuresCol=features, maxIter=min(trees, ROUNDS), maxDepth=depth or DEPTHS[kind], stepSize=STEP, seed=SEED)
    reg, elastic = LINEAR[kind]
    return LinearRegression(labelCol=label, featuresCol=features, regParam=reg, elasticNetParam=elastic)


def assembled(columns: Sequence[str], model) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep"), model])


FOREST_INPUTS = [
    "day_of_week", "month", "quarter", "is_weekend", "days_since_start", "avg_temperature", "avg_humidity", "precpt", "discount", "holiday_flag",
    "lag_1", "lag_7", "lag_30", "roll_mean_7", "roll_mean_30", "trend",
]
_KNOWN = ("avg_temperature", "avg_humidity", "precpt", "discount", "holiday_flag")
SERIES_FEATURES = [
    "day_of_week", "month", "quarter", "is_weekend", "days_since_start", "lag_1", "lag_7", "lag_30", "roll_mean_7", "series_mean",
]


def _rolled(df: DataFrame, keys: Sequence[str], value: str, upto: int) -> DataFrame:
    """Lags, full rolling means of the rows up to ``upto`` rows from the current one, and their trend (7 less 14)."""
    w = W.partitionBy(*keys).orderBy("sale_date")
    v = F.col(value).cast("double")

    def mean(n):
        frame = w.rowsBetween(upto - n + 1, upto)
        return F.when(F.count(v).over(frame) == n, F.avg(v).over(frame))

    lag = lambda n: F.lag(v, n - 1 - upto).over(w) if n - 1 - upto else v
    cols = {"lag_1": lag(1), "lag_7": lag(7), "lag_30": lag(30), "roll_mean_7": mean(7), "roll_mean_30": mean(30), "trend": mean(7) - mean(14)}
    return df.withColumns(cols)


def forest_rows(daily: DataFrame, keys: Sequence[str], value: str = "sale_amount") -> DataFrame:
    """Training rows of the forest: 16 inputs known before the day is over, and the label.

    ``daily`` has weather, discount and holiday flag beside the value. Lags and means end the day before, so the label is
    in none of them; rows without 30 predecessors are left out, so a short history gives no rows.
    """
    start = daily.agg(F.min("sale_date")).scalar()
    rows = calendar_columns(_rolled(daily, keys, value, -1)).withColumn("days_since_start", F.date_diff("sale_date", start))
    out = rows.select(*keys, "sale_date", *[F.col(c).cast("double").alias(c) for c in FOREST_INPUTS], F.col(value).cast("double").alias("label"))
    return out.dropna(subset=[*FOREST_INPUTS, "label"])


def forest_ahead(daily: DataFrame, keys: Sequence[str], horizon: int, value: str = "sale_amount") -> DataFrame:
    """Inputs of the next ``horizon`` days: calendar, and the last known values of everything else."""
    start = daily.agg(F.min("sale_date")).scalar()
    kept = ["lag_1", "lag_7", "lag_30", "roll_mean_7", "roll_mean_30", "trend", *_KNOWN]
    last = _rolled(daily, keys, value, 0).groupBy(*keys).agg(F.max("sale_date").alias("_last"), F.max_by(F.struct(*kept), "sale_date").alias("_k"))
    days = F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon))).alias("sale_date")
    out = calendar_columns(last.select(*keys, "_k", days)).withColumn("days_since_start", F.date_diff("sale_date", start))
    out = out.select("*", "_k.*").drop("_k")
    return out.select(*keys, "sale_date", *[F.col(c).cast("double").alias(c) for c in FOREST_INPUTS]).dropna(subset=FOREST_INPUTS)


def baseline_error(rows: DataFrame, label: str = "label") -> DataFrame:
    """Error on the newest fifth of the calendar of the mean of what came before."""
    old, new = split_by_time(rows)
    mean = old.agg(F.avg(label)).scalar()
    e = F.col(label) - F.col("_m")
    return new.withColumn("_m", mean).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))


def forest_scores(rows: DataFrame, trees: int = 100, depth: int = 10) -> DataFrame:
    """Error of a forest of the older rows on the newest fifth of the calendar."""
    with cached(rows.select("sale_date", "label", *FOREST_INPUTS)) as held:
        old, _ = split_by_time(held)
        model = assembled(FOREST_INPUTS, make_regressor("random_forest", "label", trees=trees, depth=depth)).fit(old)
    _, new = split_by_time(rows)
    e = F.col("label") - F.col("prediction")
    return model.transform(new).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))


def forest_forecast(daily: DataFrame, keys: Sequence[str], horizon: int, value: str = "sale_amount", trees: int = 100, depth: int = 10) -> DataFrame:
    """One random forest over all rows of all series; the 95 % band comes from the spread of its trees.

    ``forest_scores`` tells its error on days it has not seen.
    """
    keys = list(keys)
    with cached(forest_rows(daily, keys, value).select("label", *FOREST_INPUTS)) as held:
        model = assembled(FOREST_INPUTS, make_regressor("random_forest", "label", trees=trees, depth=depth)).fit(held)
    ahead = model.stages[0].transform(forest_ahead(daily, keys, horizon, value))
    p = with_tree_spread(model.stages[-1], ahead, "_f", "_sd").withColumnRenamed("sale_date", "date")
    f, band = F.greatest(F.lit(0.0), F.col("_f")), F.col("_sd") * Z95
    return p.select(*keys, "date", f.alias("forecast"), F.greatest(F.lit(0.0), f - band).alias("lower"), (f + band).alias("upper"))


def cross_validate(df: DataFrame, columns: Sequence[str], label: str, kinds: Sequence[str], folds: int = 3) -> dict[str, float]:
    """Mean r2 of each model kind over expanding windows in time.

    The linear kinds of all windows come from one pass over the rows; a tree model is fitted for each window.
    """
    shares = [(i + 1) / (folds + 1) for i in range(folds)] + [1.0]
    cuts = df.agg(F.percentile_approx(F.unix_date("sale_date"), shares, 10000)).first()[0]
    d = F.unix_date("sale_date")
    scores: dict[str, list[float]] = {}
    if linear := [k for k in kinds if k in LINEAR]:
        fold = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < d))
        found = cross_validated(fold_moments(df, fold, columns, label), [LINEAR[k] for k in linear], expanding=True)
        scores |= {k: [r2] for k, (_, r2) in zip(linear, found)}
    for k in (k for k in kinds if k not in LINEAR):
        scores[k] = []
        for lo, hi in zip(cuts, cuts[1:]):
            model = assembled(columns, make_regressor(k, label)).fit(df.filter(d <= lo))
            scores[k].append(regression_scores(model.transform(df.filter((d > lo) & (d <= hi))), label)["r2"])
    return {k: sum(v) / len(v) for k, v in scores.items()}


def category_forecast(daily: DataFrame, horizon: int, kinds: Sequence[str] = ("gradient_boost", "random_forest", "linear")) -> DataFrame:
    """Category sales by the model with the best expanding-window score, which is reported as confidence."""
    keys = ["first_category"]
    rows = forecast_features(daily, keys).withColumn("label", F.col("sale_amount").cast("double"))
    indexer = StringIndexer(inputCol="first_category", outputCol="category_index", handleInvalid="keep").fit(rows)
    columns = ["category_index", *[c for c in SERIES_FEATURES if c != "series_mean"]]
    with cached(indexer.transform(rows).select("sale_date", "label", *columns), model_parts) as held:
        scores = cross_validate(held, columns, "label", kinds)
        best = max(scores, key=lambda k: (scores[k], k))
        model = assembled(columns, make_regressor(best, "label")).fit(held)
    start = daily.agg(F.min("sale_date")).scalar()
    ahead = future_frame(daily, keys, horizon, "sale_amount")
    ahead = ahead.withColumns({"days_since_start": F.date_diff("sale_date", start), "roll_mean_7": F.col("mean_7")})
    ahead = ahead.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("lag_1", "lag_7", "lag_30", "roll_mean_7")})
    p = model.transform(indexer.transform(ahead))
    return p.select(
        "first_category",
        F.col("sale_date").alias("date"),
        F.greatest(F.lit(0.0), F.col("prediction")).alias("forecast"),
        F.lit(best).alias("model"),
        F.lit(max(0.0, min(1.0, scores[best]))).alias("confidence"),
    )


WEATHER_INPUTS = ["avg_temperature", "avg_humidity", "precpt", "avg_wind_level", "day_of_week", "month", "lag_1", "lag_7", "roll_mean_7", "temp_humidity", "temp_deviation"]
WEATHER_MODELS = ("gradient_boost", "random_forest", "elastic_net")


def weather_rows(features: DataFrame) -> DataFrame:
    """Model rows from the weather feature frame: complete lags, label as double."""
    return features.dropna(subset=["lag_1", "lag_7", "roll_mean_7"]).withColumn("label", F.col("units_sold").cast("double"))


def fit_weather_models(rows: DataFrame, kinds: Sequence[str] = WEATHER_MODELS) -> dict:
    with cached(rows.select("sale_date", "label", *WEATHER_INPUTS)) as held:
        old, _ = split_by_time(held)
        return {k: assembled(WEATHER_INPUTS, make_regressor(k, "label")).fit(old) for k in kinds}


def weather_ensemble(models: dict, rows: DataFrame) -> DataFrame:
    """Mean prediction of the fitted models as ``prediction`` beside the single ones."""
    out = rows
    for k, m in models.items():
        out = m.transform(out).withColumnRenamed("prediction", f"p_{k}").drop("features")
    mean = sum((F.col(f"p_{k}") for k in models), F.lit(0.0)) / len(models)
    return out.withColumn("prediction", mean)


def weather_model_scores(models: dict, rows: DataFrame) -> DataFrame:
    """MAE, MSE and r2 of every model and of their mean on the newest fifth."""
    _, new = split_by_time(rows)
    p = weather_ensemble(models, new)
    names = [f"p_{k}" for k in models] + ["prediction"]
    long = p.select("label", *names).unpivot(["label"], names, "model", "predicted")
    e = F.col("label") - F.col("predicted")
    g = long.groupBy("model").agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), (1 - F.try_divide(F.avg(e * e), F.var_pop("label"))).alias("r2"), F.count(F.lit(1)).alias("rows")
    )
    return g.withColumn("model", F.when(F.col("model") == "prediction", "ensemble").otherwise(F.regexp_replace("model", "^p_", "")))


def weather_importance(models: dict, spark) -> DataFrame:
    """Importance of each input in the tree models (a row per model and input)."""
    rows = []
    for k, m in models.items():
        last = m.stages[-1]
        if hasattr(last, "featureImportances"):
            rows += [(k, c, float(v)) for c, v in zip(WEATHER_INPUTS, last.featureImportances.toArray())]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def scenario_predictions(models: dict, rows: DataFrame, scenarios: dict[str, dict[str, Column]]) -> DataFrame:
    """Mean ensemble prediction when each scenario overwrites weather columns, with the change against the baseline.

    All scenarios are predicted beside one another in one pass over the rows.
    """
    out, names = rows, {"baseline": {}, **scenarios}
    for name, cols in names.items():
        changed = {c: cols.get(c, F.col(c)).cast("double") for c in WEATHER_INPUTS}
        if cols:
            changed["temp_humidity"] = changed["avg_temperature"] * changed["avg_humidity"] / 100
        out = out.withColumns({f"_{name}_{c}": v for c, v in changed.items()})
    for name in names:
        inputs = VectorAssembler(inputCols=[f"_{name}_{c}" for c in WEATHER_INPUTS], outputCol=f"_{name}", handleInvalid="keep")
        out = inputs.transform(out)
        for k, m in models.items():
            out = m.stages[-1].copy().setFeaturesCol(f"_{name}").setPredictionCol(f"_{name}_{k}").transform(out)
    mean = lambda name: F.avg(sum((F.col(f"_{name}_{k}") for k in models), F.lit(0.0)) / len(models))
    means = out.agg(*[mean(name).alias(name) for name in names])
    long = means.withColumn("_b", F.col("baseline")).unpivot(["_b"], list(names), "scenario", "mean_prediction")
    return long.select("mean_prediction", "scenario", (ratio(F.col("mean_prediction") - F.col("_b"), "_b") * 100).alias("change_pct"))


def partial_dependence(models: dict, rows: DataFrame, factor: str, points: int = 20) -> DataFrame:
    """Mean prediction of the ensemble at ``points`` equally spaced values of one factor, all else as observed."""
    low, high = rows.agg(F.min(factor), F.max(factor)).first()
    values = [float(low + (high - low) * i / (points - 1)) for i in range(points)]
    found = trees.partial_dependence({k: m.stages[-1] for k, m in models.items()}, rows, WEATHER_INPUTS, factor, values)
    mean = sum(found.values()) / len(found)
    data = [(v, float(p)) for v, p in zip(values, mean)]
    p = rows.sparkSession.createDataFrame(data, "value double, mean_prediction double")
    first, best = data[0][1], max(d[1] for d in data)
    return p.withColumns(
        {"change_pct": ratio(F.col("mean_prediction") - first, F.lit(first)) * 100, "is_maximum": F.col("mean_prediction") == best}
    )
