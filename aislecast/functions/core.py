"""Small column builders used by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """Division as double; NULL when the denominator is 0 or NULL."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def mean_of(c: ColumnLike) -> Column:
    """Mean of an exact (integer or decimal) column: exact sum over non-null count."""
    c = _col(c)
    return ratio(F.sum(c), F.count(c))


def mean_if(cond: Column, c: ColumnLike) -> Column:
    """Mean of ``c`` over the rows where ``cond`` holds."""
    return mean_of(F.when(cond, _col(c)))


def sum_if(cond: Column, c: ColumnLike) -> Column:
    return F.sum(F.when(cond, _col(c)))


def share_if(cond: Column) -> Column:
    """Share of rows where ``cond`` holds."""
    return ratio(F.count_if(cond), F.count(F.lit(1)))


def std_of(c: ColumnLike) -> Column:
    """Sample standard deviation; NULL for fewer than two values."""
    return F.stddev_samp(_col(c).cast("double"))


def safe_corr(x: ColumnLike, y: ColumnLike) -> Column:
    """Pearson correlation over pairwise non-null rows; NULL for a constant column."""
    x, y = _col(x).cast("double"), _col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def slope_of(y: ColumnLike, x: ColumnLike) -> Column:
    """Least-squares slope of y on x; NULL when x is constant."""
    y, x = _col(y).cast("double"), _col(x).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(x, y), F.var_samp(x))


def ladder(c: ColumnLike, steps: Sequence[tuple[float, object]], default: object, op: str = ">=") -> Column:
    """First matching step of ``c op bound -> label``, else ``default``; NULL input gives the default."""
    c = _col(c)
    compare = {
        ">=": lambda b: c >= b,
        ">": lambda b: c > b,
        "<=": lambda b: c <= b,
        "<": lambda b: c < b,
    }[op]
    out = None
    for bound, label in steps:
        out = F.when(compare(bound), F.lit(label)) if out is None else out.when(compare(bound), F.lit(label))
    return out.otherwise(F.lit(default))


def clamp(c: ColumnLike, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), _col(c).cast("double")))


def all_of(preds: Iterable[Column | None]) -> Column:
    """AND of the given predicates, skipping the ones that are None (no predicate means TRUE)."""
    kept = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, kept) if kept else F.lit(True)


def any_of(preds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds)


def finite(c: ColumnLike) -> Column:
    """NULL instead of NaN or an infinity."""
    c = _col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def stable_bucket(*cols: ColumnLike, buckets: int = 100) -> Column:
    """Repeatable bucket number of an entity id."""
    digest = F.md5(F.concat_ws("_", *[_col(c).cast("string") for c in cols]).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint"), F.lit(buckets))


# Rounding offset of the report form: just above one half, so that exact decimal ties, where the last bit
# of a sum decides, are not on the boundary.
HALF = 0.500003


def settle(df: DataFrame, digits: int = 4) -> DataFrame:
    """Report form of a result: doubles rounded half up, decimals as doubles, dates as ISO text."""
    scale = float(10**digits)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            d = c.cast("double")
            d = F.when(F.abs(d) < 1e17 / scale, F.floor(d * scale + HALF) / F.lit(scale)).otherwise(d)
            out.append(d.alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            out.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)
