"""Composed readers, their registry, and coordinates of cutouts."""

import pytest
from pyspark.sql import functions as F

from voltmesh.sources import readers
from voltmesh.sources.cutout import Cutout, grid_cells
from voltmesh.sources.datasets import Module


@pytest.fixture(scope="module")
def half_hours(spark):
    """SIS and SID on a grid of 0.05 degrees over four hours, with a gap."""
    steps = spark.range(8).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 1800).alias("time"), F.col("id").alias("k"))
    at = spark.range(400).select((F.lit(5.025) + 0.05 * (F.col("id") % 20)).alias("lon"), (F.lit(50.025) + 0.05 * F.floor(F.col("id") / 20)).alias("lat"))
    value = F.when(F.col("k") != 2, 100.0 + 10 * F.col("k"))
    return at.crossJoin(steps).select("time", "lon", "lat", value.alias("SIS"), (value / 2).alias("SID"))


def blank(spark, d, **meta):
    cells = grid_cells(spark, (5.0, 6.0), (50.0, 51.0), d, d).where("x > 5.1 and x < 5.9 and y > 50.1 and y < 50.9")
    return Cutout(None, cells.withColumns({"ix": F.col("ix") - 1, "iy": F.col("iy") - 1}), {"module": ["sarah"], "dx": d, "dy": d, "dt": "1 hour", "time": ["2024-01-01 00:00:00", "2024-01-01 03:00:00"], "prepared_features": []} | meta)


def test_satellite_reader(spark, half_hours):
    ready = readers.prepare(blank(spark, 0.25), {"sarah": {"raw": half_hours}})
    rows = ready.weather.groupBy("time").agg(F.min("influx_direct").alias("low"), F.max("influx_direct").alias("high"), F.avg("influx_diffuse").alias("diffuse"), F.count("*").alias("n")).orderBy("time").collect()
    assert ready.prepared and [r.n for r in rows] == [9] * 4
    assert [(r.low, r.high, r.diffuse) for r in rows] == [pytest.approx((x, x, x)) for x in (52.5, 62.5, 72.5, 82.5)]
    zeros = readers.get_data(blank(spark, 0.25), "sarah", "influx", raw=half_hours, interpolate=False)
    assert zeros.where("time = timestamp'2024-01-01 01:00:00'").agg(F.max("influx_direct")).first()[0] == pytest.approx(32.5)


def test_terrain_reader(spark):
    pixels = spark.range(10_000).select((F.lit(5.005) + 0.01 * (F.col("id") % 100)).alias("lon"), (F.lit(50.005) + 0.01 * F.floor(F.col("id") / 100)).alias("lat")).withColumn("height", F.col("lon"))
    got = {r.x: r.h for r in readers.terrain(blank(spark, 0.25), "height", pixels, 0.01).join(blank(spark, 0.25).cells, "cell_id").groupBy("x").agg(F.avg("height").alias("h")).collect()}
    assert got == {x: pytest.approx(x) for x in (5.25, 5.5, 5.75)}


def test_own_module(spark):
    readers.register("own", Module(4326, {"wind": ["wnd100m"]}), lambda c, feature: c.cells.select("cell_id", F.current_timestamp().alias("time"), F.lit(7.0).alias("wnd100m")))
    base = blank(spark, 0.25)
    ready = readers.prepare(Cutout(None, base.cells, {"module": ["own"], "prepared_features": []}), {})
    assert ready.prepared and ready.weather.agg(F.min("wnd100m")).first()[0] == 7.0
    for module, feature in (("nobody", "wind"), ("own", "height")):
        with pytest.raises(KeyError):
            readers.get_data(base, module, feature)


def test_transforms(spark):
    c = Cutout(None, grid_cells(spark, (-4.0, 1.5), (56.0, 61.0)), {})
    assert c.transform == (0.25, 0.0, -4.125, 0.0, 0.25, 55.875)
    assert c.transform_r == (0.25, 0.0, -4.125, 0.0, -0.25, 61.125)
    assert c.coords["x"].count() == 23 and c.coords["y"].first()[0] == 56.0


def test_archive_files_are_found_at_any_depth(spark, tmp_path):
    from voltmesh.sources import datasets

    for name in ("SISin202401010000.nc", "a/SISin202401020000.nc", "a/b/SISin202401040000.nc", "x/SIDin202401010000.nc", "SIDin202401040000.nc", "x/SIDin202401030000.nc", "x/notes.txt"):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"x" * 7)
    files = datasets.archive_files(spark, str(tmp_path), "*.nc")
    assert {r.bytes for r in files.collect()} == {7} and files.count() == 6
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan.split("ReadSchema")[-1]
    first, last = F.lit("2024-01-01"), F.lit("2024-01-05")
    found = datasets.satellite_files(files, first, last)
    assert [str(r.day) for r in found.orderBy("day").collect()] == ["2024-01-01", "2024-01-04"]
    assert [str(r.day) for r in datasets.uncovered_days(found, first, last).orderBy("day").collect()] == ["2024-01-02", "2024-01-03", "2024-01-05"]


def test_resampling(spark):
    from voltmesh.operators import raster

    grid = spark.createDataFrame([(0, 0, 0, 0.0, 2.0, 0.0, 2.0), (1, 1, 0, 2.0, 4.0, 0.0, 2.0)], "cell_id long, ix int, iy int, x0 double, x1 double, y0 double, y1 double")
    pixels = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (0, 1, 2), (1, 1, 7), (2, 0, 5), (2, 1, None)], "px int, py int, code int")
    value = lambda how: {r.cell_id: r.value for r in raster.regrid(pixels, grid, 1.0, how).collect()}
    assert value("sum") == {0: 12.0, 1: 5.0} and value("min") == {0: 1, 1: 5} and value("max") == {0: 7, 1: 5} and value("mode") == {0: 2, 1: 5}
    assert value("bilinear") == {0: 3.0, 1: 5.0}
    with pytest.raises(ValueError, match="lanczos"):
        raster.regrid(pixels, grid, 1.0, "lanczos")
