"""Readers that fill a cutout from landed Parquet: reanalysis, satellite and terrain, and a registry for further modules.

A reader takes (cutout, feature, **options) and returns rows by (time, cell_id), or by cell_id for static features; ``get_data`` finds
it by the module's name, ``prepare`` runs all that a cutout lacks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import num
from ..operators.raster import regrid_average
from . import datasets
from .cutout import Cutout
from .datasets import MODULES, Module

Reader = Callable[..., DataFrame]
READERS: dict[str, Reader] = {}


def register(name: str, module: Module, reader: Reader) -> None:
    """Make a dataset module known: its features and how they are read. A name that is taken is replaced."""
    MODULES[name], READERS[name] = module, reader


def get_data(cutout: Cutout, module: str, feature: str, **options) -> DataFrame:
    if module not in READERS:
        raise KeyError(f"no reader for {module!r}; known: {sorted(READERS)}")
    if feature not in MODULES[module].features:
        raise KeyError(f"{module} has no feature {feature!r}; it has {sorted(MODULES[module].features)}")
    return READERS[module](cutout, feature, **options)


def prepare(cutout: Cutout, options: dict[str, dict], features: list[str] | None = None, overwrite: bool = False, path: str | None = None) -> Cutout:
    """The cutout with all features of its modules; options: those of each module's reader; ``path``: see ``Cutout.prepare``."""
    readers = {m: partial(lambda c, f, module: get_data(c, module, f, **options.get(module, {})), module=m) for m in cutout.meta["module"]}
    return cutout.prepare(readers, features, overwrite, path)


def padded(column: Column, low: float, high: float, pad: float = 0.01) -> Column:
    """Within the bounds, widened by ``pad`` so that rounded coordinates on the edge stay."""
    return column.between(num(low - pad), num(high + pad))


def _times(cutout: Cutout, df: DataFrame) -> DataFrame:
    if "time" not in cutout.meta:
        return df
    first, last = cutout.meta["time"]
    return df.where(F.col("time").between(F.to_timestamp(F.lit(first)), F.to_timestamp(F.lit(last))))


def reanalysis(cutout: Cutout, feature: str, raw: DataFrame, sanitize: bool = True) -> DataFrame:
    """raw: valid_time, longitude, latitude and the fields of the feature, on the grid of the cutout. Coordinates meet the cells at five digits."""
    rows = _times(cutout, datasets.clean_coordinates(raw))
    cells = cutout.cells.select("cell_id", F.round("x", 5).alias("cx"), F.round("y", 5).alias("cy"))
    rows = rows.join(cells, (F.col("x") == F.col("cx")) & (F.col("y") == F.col("cy"))).drop("cx", "cy", "x", "y")
    steps = {
        "wind": lambda: datasets.reanalysis_wind(rows, sanitize), "influx": lambda: datasets.reanalysis_influx(rows, sanitize), "temperature": lambda: datasets.reanalysis_temperature(rows),
        "runoff": lambda: datasets.reanalysis_runoff(rows, sanitize), "height": lambda: datasets.reanalysis_height(rows),
    }
    return steps[feature]()


def _regridded(cutout: Cutout, df: DataFrame, step: tuple[float, float], values: list[str], by: list[str]) -> DataFrame:
    """Means over the cells of a regular finer grid (lon, lat), weighted by overlap; both axes are scaled to pixels of size 1."""
    low = cutout.summary["extent"]
    at = lambda c, start, size: F.round((F.col(c) - num(start)) / num(size) - num(0.5)).cast("int")
    x, y = low[0] - 100 * step[0], low[2] - 100 * step[1]  # an origin below all rows that can meet the cutout
    ends = df.agg(F.min("lon"), F.min("lat")).first()
    if ends[0] is not None:  # pixels begin half a step before their centres
        x, y = ends[0] - step[0] / 2, ends[1] - step[1] / 2
    pixels = df.withColumns({"px": at("lon", x, step[0]), "py": at("lat", y, step[1])})
    scaled = lambda c, start, size: (F.col(c) - num(start)) / num(size)
    grid = cutout.grid().withColumns({"x0": scaled("x0", x, step[0]), "x1": scaled("x1", x, step[0]), "y0": scaled("y0", y, step[1]), "y1": scaled("y1", y, step[1])})
    out = None
    for v in values:
        one = regrid_average(pixels.where(F.col(v).isNotNull()), grid, 1.0, by, v).withColumnRenamed("value", v)
        out = one if out is None else out.join(one, [*by, "cell_id"], "full")
    return out


def satellite(cutout: Cutout, feature: str, raw: DataFrame, interpolate: bool = True, step: float = 0.05) -> DataFrame:
    """raw: time (half-hourly), lon, lat, SIS, SID in W/m2. Gaps at dawn and dusk are filled along time, or count as 0; half hours
    become hours unless the cutout has half hours; a grid other than the cutout's is averaged over its cells. The sun's place is that at the label."""
    x0, x1, y0, y1 = cutout.summary["extent"]
    rows = raw.where(padded(F.col("lon"), x0, x1) & padded(F.col("lat"), y0, y1)).withColumns({"lon": F.round("lon", 4), "lat": F.round("lat", 4)})
    rows = _times(cutout, rows.select("time", "lon", "lat", "SIS", "SID")) if cutout.meta.get("dt") == "30 minutes" else _until_half_past(cutout, rows.select("time", "lon", "lat", "SIS", "SID"))
    for v in ("SIS", "SID"):
        rows = datasets.fill_gaps(rows, v, ["lon", "lat"]) if interpolate else rows.withColumn(v, F.coalesce(v, num(0)))
    if cutout.meta.get("dt") != "30 minutes":
        rows = datasets.hourly_mean(rows, ["SIS", "SID"], ["lon", "lat"])
    s = cutout.summary
    if (s["dx"], s["dy"]) == (step, step):
        cells = cutout.cells.select("cell_id", F.round("x", 4).alias("lon"), F.round("y", 4).alias("lat"))
        rows = rows.join(cells, ["lon", "lat"]).drop("lon", "lat")
    else:
        rows = _regridded(cutout, rows, (step, step), ["SIS", "SID"], ["time"])
    return datasets.satellite_influx(rows.join(cutout.cells.select("cell_id", "lon", "lat"), "cell_id"), ["cell_id"])


def _until_half_past(cutout: Cutout, df: DataFrame) -> DataFrame:
    """As the cutout's hours, with the half hour after the last one."""
    if "time" not in cutout.meta:
        return df
    first, last = cutout.meta["time"]
    return df.where(F.col("time").between(F.to_timestamp(F.lit(first)), F.to_timestamp(F.lit(last)) + F.expr("interval 30 minutes")))


def terrain(cutout: Cutout, feature: str, raw: DataFrame, step: float) -> DataFrame:
    """raw: lon, lat (centres of pixels of ``step`` degrees), height. Means over the cells."""
    x0, x1, y0, y1 = cutout.summary["extent"]
    near = raw.where(padded(F.col("lon"), x0, x1, step) & padded(F.col("lat"), y0, y1, step))
    return _regridded(cutout, near, (step, step), ["height"], [])


READERS |= {"era5": reanalysis, "sarah": satellite, "gebco": terrain}
