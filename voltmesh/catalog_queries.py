"""All registered queries of the weather-to-energy operators, by the survey's operator ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import conversions, derived, overlays, sources

_PARTS = (conversions, overlays, sources, derived)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for part in _PARTS for k, v in part.QUERIES.items() if v[1]}
