"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = (
    "stores", "scans", "relational", "series", "features", "inventory", "holidays", "alerts", "correlation",
    "market", "promotions", "weather", "forecast", "clustering", "signals", "reports", "stored", "streaming",
)

for _m in MODULES:
    importlib.import_module(f"{__package__}.{_m}")

from .registry import REGISTRY, as_callable  # noqa: E402


def spark_queries():
    return {name: as_callable(item) for name, item in REGISTRY.items()}


def check_sql():
    return {name: item.sql for name, item in REGISTRY.items() if item.sql is not None}
