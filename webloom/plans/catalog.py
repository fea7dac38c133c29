"""Registry of the library's own queries and their oracles; each plans module adds its own."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("apis", "scripts", "urls", "pages", "store")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"webloom.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
