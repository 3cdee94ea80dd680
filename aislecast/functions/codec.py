"""Decoding and encoding of normalised sales amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base multiplier, multiplier per management group, price adjustment per city.
BASE_MULTIPLIER = 20.0
GROUP_MULTIPLIERS = {0: 25.0, 1: 15.0, 2: 45.0, 3: 20.0, 4: 10.0, 5: 30.0, 6: 35.0}
CITY_ADJUSTMENTS = {
    0: 1.2, 1: 1.15, 2: 1.15, 3: 1.2, 4: 1.0, 5: 1.1, 6: 1.1, 7: 1.05, 8: 0.9,
    9: 1.1, 10: 1.0, 11: 1.0, 12: 1.0, 13: 1.1, 14: 1.05, 15: 0.95, 16: 1.0, 17: 0.95,
}


def _lookup(key: Column, values: dict[int, float], default: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key.cast("int")), F.lit(default))


def price_factor(city: Column, group: Column) -> Column:
    """Factor from an encoded to a real amount; unknown cities count 1, unknown groups the base."""
    return (
        F.lit(BASE_MULTIPLIER)
        * _lookup(city, CITY_ADJUSTMENTS, 1.0)
        * (_lookup(group, GROUP_MULTIPLIERS, BASE_MULTIPLIER) / F.lit(BASE_MULTIPLIER))
    )


def decode_amount(encoded: Column, city: Column, group: Column) -> Column:
    return encoded * price_factor(city, group)


def encode_amount(real: Column, city: Column, group: Column) -> Column:
    return real / price_factor(city, group)


def decode_hours(hours: Column, city: Column, group: Column) -> Column:
    factor = price_factor(city, group)
    return F.transform(hours, lambda x: x * factor)


def encode_hours(hours: Column, city: Column, group: Column) -> Column:
    factor = price_factor(city, group)
    return F.transform(hours, lambda x: x / factor)
