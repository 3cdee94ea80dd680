"""Weather scores, labels and classes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import ladder


def temperature_impact(t: Column) -> Column:
    return 1 / (1 + F.abs(t - 22.5) / 10)


def humidity_impact(h: Column) -> Column:
    return 1 / (1 + F.abs(h - 50) / 20)


def rain_impact(p: Column) -> Column:
    return (
        F.when((p > 0) & (p <= 5), F.lit(1.1)).when(p > 5, 1 - F.least(p / 50, F.lit(0.5))).otherwise(F.lit(1.0))
    )


def wind_impact(w: Column, max_wind: Column) -> Column:
    return 1 - F.try_divide(w, max_wind) * 0.2


def comfort_index(t: Column, h: Column, p: Column, w: Column) -> Column:
    """Weighted sum of the four impact scores."""
    return 0.4 * t + 0.3 * h + 0.2 * p + 0.1 * w


def simple_comfort(t: Column) -> Column:
    return 1 - F.abs(t - 22.5) / 30


def weather_seasonality(scaled_temp: Column, month: Column) -> Column:
    return scaled_temp * F.sin(month * (2 * math.pi / 12))


def temperature_label(t: Column) -> Column:
    return ladder(t, [(15, "Cold"), (22, "Mild"), (28, "Warm")], "Hot", op="<=")


def quartile_label(x: Column, q1: Column, q2: Column, q3: Column, labels=("Low", "Medium", "High", "Very High")) -> Column:
    """Label of the quartile a value falls in; an edge value belongs to the lower quartile."""
    return F.when(x <= q1, labels[0]).when(x <= q2, labels[1]).when(x <= q3, labels[2]).otherwise(labels[3])


def weather_label(rainy: Column, windy: Column, temp_label: Column, humidity_label: Column) -> Column:
    """Composed label such as ``Rainy_Windy_Hot_Humid``; ``Normal`` when nothing applies."""
    parts = F.concat_ws(
        "_",
        F.when(rainy, "Rainy"),
        F.when(windy, "Windy"),
        F.when(temp_label.isin("Cold", "Hot"), temp_label),
        F.when(humidity_label == "Very High", "Humid"),
    )
    return F.when(parts == "", "Normal").otherwise(parts)


def weather_category(t: Column, p: Column) -> Column:
    return F.when(p > 5, "rainy").when(p < 1, "dry").when(t < 18, "cold").when(t > 25, "warm").otherwise("mild")


def rain_class(p: Column) -> Column:
    return ladder(p, [(0, "none"), (5, "light"), (15, "moderate")], "heavy", op="<=")
