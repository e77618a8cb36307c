"""Temperatures, heat pumps, heating and cooling demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .basic import num, zero

KELVIN = 273.15
# Coefficients of the quadratic regressions for air- and ground-sourced heat pumps.
COP = {"air": (6.81, -0.121, 0.000630), "soil": (8.77, -0.150, 0.000734)}


def temperature(t: Column) -> Column:
    return t - num(KELVIN)


def soil_temperature(t: Column) -> Column:
    """Cells without soil (sea) count as 0 degrees."""
    return zero(t - num(KELVIN))


def dewpoint_temperature(t: Column) -> Column:
    return t - num(KELVIN)


def coefficient_of_performance(source: Column, kind: str = "air", sink: float = 55.0, c0: float | None = None, c1: float | None = None, c2: float | None = None) -> Column:
    if kind not in COP:
        raise ValueError("a heat pump draws from 'air' or 'soil'")
    own = [d if c is None else c for c, d in zip((c0, c1, c2), COP[kind], strict=True)]
    delta = num(sink) - source
    return num(own[0]) + num(own[1]) * delta + num(own[2]) * delta * delta


def daily_mean(weather: DataFrame, value: str, hour_shift: float = 0.0, by: str = "cell_id", cells: DataFrame | None = None, span: tuple[str, str] | None = None) -> DataFrame:
    """(by, time, value): means over calendar days of the shifted labels; days without rows between the first and the last are NULL.

    Where ``cells`` and the first and last day (``span``) are known, as a cutout knows them, the weather is read once; else also for these."""
    shifted = weather.select(by, F.date_trunc("day", F.col("time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), num(hour_shift * 3600).cast("decimal(18,6)"))).alias("time"), F.col(value).alias("v"))
    means = shifted.groupBy(by, "time").agg(F.avg("v").alias(value))
    ends = means.agg(F.min("time").alias("a"), F.max("time").alias("b")) if span is None else weather.sparkSession.range(1).select(*(F.to_timestamp(F.lit(x)).alias(n) for n, x in zip("ab", span, strict=True)))
    days = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("time"))
    calendar = (means if cells is None else cells).select(by).distinct().crossJoin(F.broadcast(days))
    return calendar.join(means, [by, "time"], "left")


def heat_demand(t: Column, threshold: float = 15.0, a: float = 1.0, constant: float = 0.0) -> Column:
    """Degree-day demand from a daily mean in Kelvin."""
    return F.when(t.isNotNull(), num(constant) + F.greatest(num(a) * (num(threshold + KELVIN) - t), num(0)))


def cooling_demand(t: Column, threshold: float = 23.0, a: float = 1.0, constant: float = 0.0) -> Column:
    return F.when(t.isNotNull(), num(constant) + F.greatest(num(a) * (t - num(threshold + KELVIN)), num(0)))
