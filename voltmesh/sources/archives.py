"""Readers of two further archives from landed Parquet: a global forecast archive and a regional climate model.

Both are tables of facts (which field is which variable, and how its values are to be taken) with one reader each, registered beside the other modules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import num
from . import datasets
from .cutout import Cutout
from .datasets import Module
from .readers import register


@dataclass(frozen=True)
class Field:
    """``names``: raw fields, of which several are the components of a vector. ``kept`` "mean" and "sum": since the beginning of the forecast, or of an interval that ends
    at the label (``hours`` long). Values up to ``low`` count as 0."""

    variable: str
    names: tuple[str, ...]
    kept: str = "value"
    low: float | None = None
    hours: float = 0.0
    static: bool = False


# Names of fields and variables, thresholds of noise around zero, lengths of intervals.
FORECAST = {
    "influx": Field("influx", ("DSWRF_P8_L1_GGA0",), "mean", low=0.1),
    "outflux": Field("outflux", ("USWRF_P8_L1_GGA0",), "mean", low=3.0),
    "temperature": Field("temperature", ("TMP_P0_L103_GGA0",)),
    "soil_temperature": Field("soil_temperature", ("TMP_P0_2L106_GGA0",)),
    "wnd10m": Field("wnd10m", ("UGRD_P0_L103_GGA0", "VGRD_P0_L103_GGA0")),
    "runoff": Field("runoff", ("WATR_P8_L1_GGA0",), "sum"),
    "roughness": Field("roughness", ("SFCR_P8_L1_GGA0",)),
    "height": Field("height", ("HGT_P0_L105_GGA0",), static=True),
}
REGIONAL = {
    "influx": Field("influx", ("rsds",), "mean", hours=3),
    "outflux": Field("outflux", ("rsus",), "mean", hours=3),
    "temperature": Field("temperature", ("tas",)),
    "humidity": Field("humidity", ("hurs",)),
    "wnd10m": Field("wnd10m", ("sfcWind",)),
    "runoff": Field("runoff", ("mrro",), "mean", hours=6),
    "roughness": Field("roughness", ("rlst",), static=True),
    "height": Field("height", ("orog",), static=True),
}


def _value(names: tuple[str, ...]) -> Column:
    if len(names) == 1:
        return F.col(names[0]).cast("double")
    return F.sqrt(sum((F.col(n) * F.col(n) for n in names[1:]), F.col(names[0]) * F.col(names[0])))


def _in_cells(cutout: Cutout, rows: DataFrame, lon: str, lat: str) -> DataFrame:
    """Rows whose place, at four digits, is the centre of a cell."""
    at = lambda c: F.round(F.col(c), 4)
    cells = cutout.cells.select("cell_id", at("x").alias("__x"), at("y").alias("__y"))
    return rows.drop("cell_id").join(cells, (at(lon) == F.col("__x")) & (at(lat) == F.col("__y"))).drop("__x", "__y", lon, lat)


def _within(cutout: Cutout, rows: DataFrame) -> DataFrame:
    if "time" not in cutout.meta:
        return rows
    first, last = (F.to_timestamp(F.lit(t)) for t in cutout.meta["time"])
    return rows.where(F.col("time").between(first, last))


def forecast(cutout: Cutout, feature: str, raw: DataFrame) -> DataFrame:
    """raw: initial_time, forecast_hours (1, 2, ... of each forecast), lon (0 to 360), lat and the fields.

    Means and sums since the beginning of a forecast become values of single steps; a missing runoff counts as 0; labels are moved to the beginning of their hour."""
    f = FORECAST[feature]
    rows = _in_cells(cutout, datasets.wrap_longitude(raw), "lon", "lat")
    if f.static:
        return rows.groupBy("cell_id").agg(F.max(_value(f.names)).alias(f.variable))
    rows = rows.select("cell_id", "initial_time", "forecast_hours", _value(f.names).alias(f.variable))
    run = ["cell_id", "initial_time"]
    if f.kept == "sum":
        rows = datasets.deaccumulate(rows.withColumn(f.variable, F.coalesce(f.variable, num(0))), f.variable, run, "forecast_hours")
    elif f.kept == "mean":
        rows = datasets.deaverage(rows, f.variable, run, "forecast_hours")
    rows = datasets.forecast_time(rows).withColumn("time", F.col("time") - F.expr("interval 1 hour"))
    rows = datasets.clip_lower(rows, f.variable, f.low, 0.0) if f.low is not None else rows
    return _within(cutout, rows.select("time", "cell_id", f.variable))


def regional(cutout: Cutout, feature: str, raw: DataFrame) -> DataFrame:
    """raw: time, rlon, rlat (the model's own plane, which the cutout is in as well) and the fields.

    Means of three hours are labelled by the middle of their interval and move to its beginning; means of six hours stand for both halves of it."""
    f = REGIONAL[feature]
    rows = _in_cells(cutout, raw, "rlon", "rlat")
    if f.static:
        return rows.groupBy("cell_id").agg(F.max(_value(f.names)).alias(f.variable))
    rows = rows.select("time", "cell_id", _value(f.names).alias(f.variable))
    if f.hours == 3:
        rows = datasets.bin_starts(rows, 90)
    elif f.hours == 6:
        rows = datasets.halved_bins(rows, f.variable, ["cell_id"])
    return _within(cutout, rows.select("time", "cell_id", f.variable))


for _name, _fields, _reader in (("ncep", FORECAST, forecast), ("cordex", REGIONAL, regional)):
    register(_name, Module(4326, {k: [f.variable] for k, f in _fields.items()}, {k for k, f in _fields.items() if f.static}, deprecated=True), _reader)
