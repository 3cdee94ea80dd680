"""Correlations: zero-filled entity correlations in blocks, weather and factor correlations, significance.

Entities of a cell that holds few of them meet by an equi-join.  The other cells are laid out as a blocked matrix product:
entities fall into hash blocks of bounded size and cells into hash chunks, so a task multiplies two small matrices whatever
the share of a hot cell or a hot entity; pairs are filtered inside the task and never emitted per cell.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import ladder, mean_of, ratio, safe_corr
from ..session import ensure_checkpoint_dir
from . import pairsearch

BLOCK = 1500
CHUNK = 4096
LISTED = 1000
FEW = 64  # entities of a cell that meet by a join, at most so many pairs a row


def _block_pairs(cells: DataFrame, item: str, blocks: int) -> DataFrame:
    """Each row goes to every block pair its entity takes part in."""
    b = F.pmod(F.xxhash64(item), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return (
        cells.withColumn("_b", b)
        .withColumn("_o", other)
        .withColumns({"_lo": F.least("_b", "_o"), "_hi": F.greatest("_b", "_o")})
        .drop("_o")
    )


def _count_blocks(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


def grid_correlations(
    cells: DataFrame, item: str, cell: str, value: str, min_corr: float = 0.3, block: int = pairsearch.BLOCK
) -> DataFrame:
    """Pearson r of every pair of entities over a shared, bounded grid of cells (days), absent cells being 0.

    ``cells`` has one row per entity and cell.  Pairs with |r| below ``min_corr`` or without variance are left out.
    """
    return pairsearch.correlated_pairs(cells, item, cell, value, min_corr, block=block)


def cooccurrence_sums(
    cells: DataFrame, item: str, cell: Sequence[str], x: str, y: str, block: int = BLOCK, chunk: int = CHUNK, few: int = FEW
) -> DataFrame:
    """For every pair of entities that share a cell: the sums over the shared cells of x*x, x*y and y*x.

    A cell of at most ``few`` entities costs its own pairs alone, however many entities there are.  Fuller cells are cut into
    chunks and meet in blocks of the entities they hold, and only the chunk sums leave a task.  ``cells`` is read several times.
    """
    parts_of = [f"cell_{i}" for i in range(len(cell))]
    rows = cells.select(
        F.col(item).alias("item"),
        *[F.col(c).alias(name) for c, name in zip(cell, parts_of)],
        F.col(x).cast("double").alias("x"),
        F.col(y).cast("double").alias("y"),
    )
    full = rows.groupBy(*parts_of).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > few).select(*[F.col(c).alias(f"_{c}") for c in parts_of])
    in_full = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in parts_of])
    sums = _pairs_of_few(rows.join(full, in_full, "left_anti"), parts_of)
    crowd = rows.join(full, in_full, "left_semi")
    n_cells, n_items = crowd.agg(F.approx_count_distinct(F.xxhash64(*parts_of)), F.approx_count_distinct("item")).first()
    if n_cells:
        sums = sums.unionByName(_pairs_of_crowd(crowd, parts_of, _count_blocks(n_items, block), _count_blocks(n_cells, chunk)))
    return sums.groupBy("item_a", "item_b").agg(*[F.sum(c).alias(c) for c in ("xx", "xy", "yx")])


def _pairs_of_few(rows: DataFrame, parts_of: Sequence[str]) -> DataFrame:
    """(item_a, item_b, xx, xy, yx) of the pairs of each cell, by a join on the cell."""
    held = rows.filter(F.col("x") != 0)
    a = held.select(*parts_of, F.col("item").alias("item_a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = held.select(*[F.col(c).alias(f"_{c}") for c in parts_of], F.col("item").alias("item_b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in parts_of])
    met = a.join(b, same & (F.col("item_a") < F.col("item_b")))
    c = F.col
    return met.select("item_a", "item_b", (c("xa") * c("xb")).alias("xx"), (c("xa") * c("yb")).alias("xy"), (c("ya") * c("xb")).alias("yx"))


def _pairs_of_crowd(rows: DataFrame, parts_of: Sequence[str], blocks: int, chunks: int) -> DataFrame:
    """(item_a, item_b, xx, xy, yx) of the pairs that share a cell, a row for each chunk of cells, by products of blocks."""
    kind = rows.schema["item"].dataType
    fields = [T.StructField("item_a", kind), T.StructField("item_b", kind)]
    out = T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in ("xx", "xy", "yx")])

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, row = np.unique(pdf["item"].to_numpy(), return_inverse=True)
        col = pdf.groupby(list(parts_of), sort=False, dropna=False).ngroup().to_numpy()
        mats = []
        for name in ("x", "y"):
            m = np.zeros((len(ids), col.max() + 1))
            np.add.at(m, (row, col), pdf[name].to_numpy(dtype=float))
            mats.append(m)
        mx, my = mats
        home = np.zeros(len(ids), dtype=int)
        home[row] = pdf["_b"].to_numpy()
        lo, hi = int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0])
        left, right = np.flatnonzero(home == lo), np.flatnonzero(home == hi)
        together = (mx[left] != 0).astype(float) @ (mx[right] != 0).astype(float).T
        keep = together > 0
        if lo == hi:
            keep &= np.triu(np.ones_like(keep, dtype=bool), 1)
        i, j = np.nonzero(keep)
        xx, xy, yx = mx[left] @ mx[right].T, mx[left] @ my[right].T, my[left] @ mx[right].T
        a, b = ids[left[i]], ids[right[j]]
        swap = a > b
        return pd.DataFrame(
            {
                "item_a": np.where(swap, b, a),
                "item_b": np.where(swap, a, b),
                "xx": xx[i, j],
                "xy": np.where(swap, yx[i, j], xy[i, j]),
                "yx": np.where(swap, xy[i, j], yx[i, j]),
            }
        )

    spread = _block_pairs(rows, "item", blocks).withColumn("_c", F.pmod(F.xxhash64(*parts_of), F.lit(chunks)))
    return spread.groupBy("_lo", "_hi", "_c").applyInPandas(multiply, out)


def product_correlations(sales: DataFrame, item: str = "product_id", value: str = "sale_amount", min_corr: float = 0.3) -> DataFrame:
    """All pairs of products with |r| >= ``min_corr`` over the sale days (mean per day, absent days 0) with their kind."""
    cells = sales.groupBy(item, "sale_date").agg(mean_of(value).alias("_x"))
    r = grid_correlations(cells, item, "sale_date", "_x", min_corr)
    return r.withColumn(
        "correlation_type", F.when(F.col("r") > 0.7, "complementary").when(F.col("r") < -0.5, "substitute").otherwise("neutral")
    )


def _never_together(per: DataFrame, item: str, n: Column, min_corr: float, block: int) -> DataFrame | None:
    """Pairs whose r would be at most -``min_corr`` if they shared no cell, None without any: r is then -ua * ub, u = s / sqrt(n ss - s s).

    Only entities that fill a large part of the grid can take part, so few are left before they meet in blocks.
    """
    u = per.select(F.col(item).alias("item"), F.try_divide(F.col("s"), F.sqrt(n * F.col("ss") - F.col("s") * F.col("s"))).alias("u"))
    most = u.agg(F.max(F.abs("u"))).scalar()
    dense = u.filter(F.abs("u") * most >= min_corr)
    kind = per.schema[item].dataType
    out = T.StructType([T.StructField("item_a", kind), T.StructField("item_b", kind)])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x, home = pdf["item"].to_numpy(), pdf["u"].to_numpy(dtype=float), pdf["_b"].to_numpy()
        left, right = (np.flatnonzero(home == int(pdf[c].iloc[0])) for c in ("_lo", "_hi"))
        i, j = np.nonzero((np.outer(x[left], x[right]) >= min_corr) & (ids[left][:, None] != ids[right][None, :]))
        a, b = ids[left[i]], ids[right[j]]
        return pd.DataFrame({"item_a": np.where(a < b, a, b), "item_b": np.where(a < b, b, a)}).drop_duplicates()

    found = dense.count()
    if not found:
        return None
    return _block_pairs(dense, "item", _count_blocks(found, block)).groupBy("_lo", "_hi").applyInPandas(meet, out)


def cell_correlations(
    sales: DataFrame, item: str, cell: Sequence[str], value: str, min_corr: float, block: int = BLOCK, chunk: int = CHUNK
) -> DataFrame:
    """Pairs with |r| >= ``min_corr`` > 0 over a grid of many cells, absent cells 0.

    Candidates are the pairs that share a cell, and those that fill so much of the grid apart from each other
    that their r is negative enough.
    """
    assert min_corr > 0
    ensure_checkpoint_dir(sales.sparkSession)
    cells = sales.groupBy(item, *cell).agg(mean_of(value).alias("_x")).filter(F.col("_x") != 0).checkpoint()
    n = sales.select(*cell).distinct().agg(F.count(F.lit(1))).scalar()
    sums = cooccurrence_sums(cells, item, cell, "_x", "_x", block, chunk).select("item_a", "item_b", "xx")
    per = cells.groupBy(item).agg(F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("ss"))
    a = per.select(F.col(item).alias("item_a"), F.col("s").alias("sa"), F.col("ss").alias("ssa"))
    b = per.select(F.col(item).alias("item_b"), F.col("s").alias("sb"), F.col("ss").alias("ssb"))
    apart = _never_together(per, item, n, min_corr, block)
    if apart is not None:
        sums = sums.unionByName(apart.join(sums, ["item_a", "item_b"], "left_anti").withColumn("xx", F.lit(0.0)))
    joined = sums.join(a, "item_a").join(b, "item_b").withColumn("sample_size", n)
    c = F.col
    den = F.sqrt((c("sample_size") * c("ssa") - c("sa") * c("sa")) * (c("sample_size") * c("ssb") - c("sb") * c("sb")))
    r = F.try_divide(c("sample_size") * c("xx") - c("sa") * c("sb"), den)
    return joined.select("item_a", "item_b", r.alias("r"), "sample_size").filter(F.abs("r") >= min_corr)


def positive_correlations(
    sales: DataFrame, item: str, cell: Sequence[str], value: str, min_corr: float, block: int = BLOCK, chunk: int = CHUNK
) -> DataFrame:
    """The pairs of ``cell_correlations`` with a positive r."""
    return cell_correlations(sales, item, cell, value, min_corr, block, chunk).filter(F.col("r") > 0)


def correlations_with(sales: DataFrame, wanted: Sequence, item: str = "product_id", value: str = "sale_amount", min_corr: float = 0.3) -> DataFrame:
    """Pairs of the listed entities with all others over the sale days (mean per day, absent days 0), |r| >= ``min_corr``.

    A rectangular product: only the cells of the listed entities meet the others of their day. The list names at most ``LISTED``.
    """
    wanted = list(dict.fromkeys(wanted))
    if len(wanted) > LISTED:
        raise ValueError(f"more than {LISTED} entities: use grid_correlations")
    cells = sales.groupBy(item, "sale_date").agg(mean_of(value).alias("_x"))
    n = sales.agg(F.count_distinct("sale_date").cast("double")).scalar()
    per = cells.groupBy(item).agg(F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("ss"))
    few = cells.filter(F.col(item).isin(list(wanted))).select(F.col(item).alias("a"), "sale_date", F.col("_x").alias("xa"))
    sums = few.join(cells.withColumnRenamed(item, "b"), "sale_date").groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("_x")).alias("xy"))
    one = per.filter(F.col(item).isin(list(wanted))).select(F.col(item).alias("a"), F.col("s").alias("sa"), F.col("ss").alias("ssa"))
    listed = F.array(*[F.lit(w) for w in wanted]).cast(T.ArrayType(per.schema[item].dataType))
    rest = per.select(F.col(item).alias("b"), F.col("s").alias("sb"), F.col("ss").alias("ssb"), F.explode(listed).alias("a"))
    both = rest.join(one, "a").filter(F.col("a") != F.col("b")).join(sums, ["a", "b"], "left").withColumn("n", n)
    c = F.col
    den = F.sqrt((c("n") * c("ssa") - c("sa") * c("sa")) * (c("n") * c("ssb") - c("sb") * c("sb")))
    r = F.try_divide(c("n") * F.coalesce("xy", F.lit(0.0)) - c("sa") * c("sb"), den)
    pairs = both.select(F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b"), r.alias("r"))
    return pairs.filter(F.abs("r") >= min_corr).groupBy("item_a", "item_b").agg(F.max("r").alias("r"))


def pair_label(r: Column) -> Column:
    return F.when(r > 0.5, "positive").when(r < -0.3, "negative").otherwise("moderate")


def _betainc(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, elementwise."""
    flip = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(lg(aa + bb) - lg(aa) - lg(bb) + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
    tiny = 1e-300
    c = np.ones_like(xx)
    d = 1 / np.where(np.abs(1 - (aa + bb) * xx / (aa + 1)) < tiny, tiny, 1 - (aa + bb) * xx / (aa + 1))
    h = d.copy()
    for m in range(1, 300):
        for num in (
            m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)),
            -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    val = np.where(xx <= 0, 0.0, front * h)
    return np.where(flip, 1 - val, val)


@F.pandas_udf(T.DoubleType())
def _p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    df = (n - 2).to_numpy(dtype=float)
    rr = np.clip(r.to_numpy(dtype=float), -1, 1)
    ok = np.isfinite(rr) & (df > 0)
    p = np.full(len(rr), np.nan)
    if ok.any():
        p[ok] = _betainc(df[ok] / 2, 0.5, 1 - rr[ok] ** 2)
    return pd.Series(p).where(ok)


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a Pearson r over n pairs (t distribution with n - 2 degrees); NULL below 3 pairs."""
    p = _p_value(r.cast("double"), n.cast("double"))
    return F.when(F.isnan(p), F.lit(None)).otherwise(p)


def category_correlations(sales: DataFrame, category: str = "first_category") -> DataFrame:
    """Pairs of categories over the days (daily sums), with strength class."""
    cells = sales.groupBy(category, "sale_date").agg(F.sum("sale_amount").cast("double").alias("_x"))
    r = grid_correlations(cells, category, "sale_date", "_x", min_corr=0.0)
    return r.withColumn("strength", F.when(F.abs("r") > 0.5, "strong").when(F.abs("r") < 0.3, "weak").otherwise("moderate"))


def correlation_overview(pairs: DataFrame) -> DataFrame:
    """Pairs, mean strength in percent and the substitution risk."""
    top = F.max(F.abs("r"))
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        (F.avg(F.abs("r")) * 100).alias("cross_impact"),
        F.when(top > 0.7, "High").when(top > 0.5, "Medium").otherwise("Low").alias("substitution_risk"),
    )


WEATHER_FACTORS = ("avg_temperature", "avg_humidity", "precpt")


def weather_correlations(sales: DataFrame, keys: Sequence[str], value: str = "sale_amount", min_rows: int = 30) -> DataFrame:
    """Correlation of sales with each weather factor per key, strongest temperature link first."""
    g = sales.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        mean_of(value).alias("avg_value"),
        safe_corr(value, "avg_temperature").alias("temperature_corr"),
        safe_corr(value, "avg_humidity").alias("humidity_corr"),
        safe_corr(value, "precpt").alias("precipitation_corr"),
    )
    return g.filter(F.col("rows") >= min_rows).orderBy(F.abs("temperature_corr").desc_nulls_last(), *keys)


def product_weather_view(sales: DataFrame, product: DataFrame, min_rows: int = 30) -> DataFrame:
    """Product performance with weather links and stock-out rate."""
    g = sales.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("store_id").alias("stores_carrying"),
        F.sum("sale_amount").alias("total_revenue"),
        mean_of("sale_amount").alias("avg_daily_sales"),
        safe_corr("sale_amount", "avg_temperature").alias("temperature_corr"),
        safe_corr("sale_amount", "avg_humidity").alias("humidity_corr"),
        safe_corr("sale_amount", "precpt").alias("precipitation_corr"),
        ratio(F.count_if(F.col("stock_hour6_22_cnt") > 0), F.count(F.lit(1))).alias("stockout_rate"),
    )
    return g.filter(F.col("rows") >= min_rows).join(product.select("product_id", "product_name"), "product_id")


def factor_correlations(sales: DataFrame, key: str, value: str = "sale_amount") -> DataFrame:
    """Key x weather factor (raw, interaction, squared, comfort) with r, strength and direction, in long form.

    All factors are aggregated in one pass and then turned into rows.
    """
    t, h, p, w = (F.col(c) for c in ("avg_temperature", "avg_humidity", "precpt", "avg_wind_level"))
    factors = {
        "temperature": t,
        "humidity": h,
        "precipitation": p,
        "wind": w,
        "temp_humidity": t * h / 100,
        "temp_squared": t * t,
        "comfort": 1 - F.abs(t - 22.5) / 30,
    }
    g = sales.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), *[safe_corr(value, e).alias(n) for n, e in factors.items()])
    long = g.unpivot([key, "rows"], list(factors), "factor", "r").filter(F.col("r").isNotNull())
    return long.withColumns(
        {
            "strength": ladder(F.abs("r"), [(0.7, "strong"), (0.4, "moderate"), (0.2, "weak")], "very_weak"),
            "direction": F.when(F.col("r") > 0, "positive").otherwise("negative"),
            "significant": (F.abs("r") > 0.3) & (F.col("rows") > 30),
        }
    )


def primary_factor(long: DataFrame, key: str) -> DataFrame:
    """Strongest factor of each key and the sensitivity class it gives."""
    a = F.abs("r")
    return long.groupBy(key).agg(
        F.max_by("factor", F.struct(a, "factor")).alias("primary_factor"),
        F.max(a).alias("max_abs_r"),
        F.avg(a).alias("mean_abs_r"),
    ).withColumn("sensitivity", ladder("max_abs_r", [(0.6, "high"), (0.3, "medium")], "low"))


def feature_importance(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """|r| of each column with the target, largest first."""
    one = df.agg(*[F.abs(safe_corr(c, target)).alias(c) for c in columns])
    long = one.unpivot([], list(columns), "feature", "importance")
    return long.orderBy(F.desc_nulls_last("importance"), "feature")


def category_affinity(sales: DataFrame, min_count: int = 10, top: int | None = 10, unit_price: float = 25.0) -> DataFrame:
    """Category pairs sold in the same store on the same day, in both orders: count, mean and revenue of the pair sums.

    Rows are first counted per (store, day, category): a pair of rows is then n_a * n_b and its sum s_a * n_b + n_a * s_b.
    """
    cells = sales.groupBy("store_id", "sale_date", "first_category").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("units_sold").alias("_s")
    )
    ensure_checkpoint_dir(sales.sparkSession)
    cells = cells.checkpoint()
    p = cooccurrence_sums(cells, "first_category", ["store_id", "sale_date"], "_n", "_s")
    both = p.select(F.col("item_a").alias("category_a"), F.col("item_b").alias("category_b"), "xx", "xy", "yx").unionByName(
        p.select(F.col("item_b").alias("category_a"), F.col("item_a").alias("category_b"), "xx", "xy", "yx")
    )
    units = F.col("xy") + F.col("yx")
    out = both.select(
        "category_a",
        "category_b",
        F.col("xx").cast("bigint").alias("cooccurrences"),
        (units / F.col("xx")).alias("avg_combined_units"),
        (units * unit_price).alias("combined_revenue"),
    ).filter(F.col("cooccurrences") >= min_count)
    if top is None:
        return out
    return out.orderBy(F.desc("cooccurrences"), "category_a", "category_b").limit(top)
