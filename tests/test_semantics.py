"""Published cases, null rules, argument rules and golden grids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltmesh.functions import basic, solar, wind
from voltmesh.functions.line import line_limit
from voltmesh.operators import geometry, hydro, raster
from voltmesh.operators.aggregate import aggregate_matrix, convert_and_aggregate
from voltmesh.sources import catalog
from voltmesh.sources.cutout import Cutout, grid_cells

IEEE = {"temperature": 313.0, "wnd100m": 0.61, "height": 0.0, "wnd_azimuth": 0.0, "influx_direct": 1027.0, "solar_altitude": math.pi / 2, "solar_azimuth": math.pi}


def limit(spark, row, psi, resistance, **params):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    return df.select(line_limit(F.lit(float(psi)), F.lit(resistance), **params)).first()[0]


def test_ieee_738_cases(spark):
    assert limit(spark, IEEE, 90, 9.39e-5, diameter=0.02814, surface=373.0, emissivity=0.8, absorptivity=0.8) == pytest.approx(1025, rel=0.005)
    still = IEEE | {"temperature": 303.0, "wnd100m": 0.0, "influx_direct": 0.0, "solar_altitude": 0.0}
    assert limit(spark, still, 90, 0.1188e-3, diameter=0.0218, surface=353.0, emissivity=0.8, absorptivity=0.8) == pytest.approx(645, rel=0.015)
    cable = IEEE | {"temperature": 293.0, "wnd100m": 0.0, "influx_direct": 0.0, "solar_altitude": 0.0}
    amp = limit(spark, cable, 0, 0.0136e-3, surface=363.0)
    assert amp == pytest.approx(2460, rel=0.02)
    assert math.sqrt(3) * amp * 380e3 / 1e6 == pytest.approx(1619, rel=0.02)


def test_line_limit_symmetry(spark):
    values = [limit(spark, IEEE, psi, 9.39e-5) for psi in range(0, 190, 30)]
    assert values[0] < values[1] < values[2] < values[3] > values[4] > values[5] > values[6]
    assert values[0] == pytest.approx(values[6], abs=1e-9)


def test_grid_golden(spark):
    c = Cutout(None, grid_cells(spark, (1.5, -4.0), (61.0, 56.0)), {})
    assert c.summary["shape"] == (21, 23)
    assert c.summary["extent"] == [-4.125, 1.625, 55.875, 61.125]
    assert c.summary["bounds"] == [-4.125, 55.875, 1.625, 61.125]


def mock(spark):
    cells = spark.range(12).select(F.col("id").alias("cell_id"), (F.col("id") % 4).cast("int").alias("ix"), F.floor(F.col("id") / 4).cast("int").alias("iy"))
    cells = cells.withColumns({"x": F.lit(5.0) + F.col("ix"), "y": F.lit(50.0) + F.col("iy")}).withColumns({"lon": F.col("x"), "lat": F.col("y")})
    rows = [(t, c, float((t * 7 + c * 3) % 10) / 10) for t in range(24) for c in range(12)]
    weather = spark.createDataFrame(rows, "h int, cell_id long, v double").select(F.timestamp_seconds(F.lit(1577836800) + F.col("h") * 3600).alias("time"), "cell_id", F.col("v").alias("var"))
    return Cutout(weather, cells, {"module": ["era5"], "dx": 1.0, "dy": 1.0}), np.array([r[2] for r in rows]).reshape(24, 12)


def test_gateway_modes(spark):
    c, v = mock(spark)
    layout = c.uniform_layout()
    convert = lambda w: F.col("var")
    assert [r.v for r in convert_and_aggregate(c, convert).orderBy("cell_id").collect()] == pytest.approx(v.sum(0).tolist())
    assert [r.v for r in convert_and_aggregate(c, convert, aggregate_time="mean").orderBy("cell_id").collect()] == pytest.approx(v.mean(0).tolist())
    assert convert_and_aggregate(c, convert, aggregate_time=None).count() == 288
    assert [r.v for r in convert_and_aggregate(c, convert, layout=layout).orderBy("time").collect()] == pytest.approx(v.sum(1).tolist())
    out, cap = convert_and_aggregate(c, convert, layout=layout, per_unit=True, return_capacity=True, aggregate_time="mean")
    assert out.first().v == pytest.approx(v.mean()) and cap.first().capacity == 12
    with pytest.warns(FutureWarning):
        convert_and_aggregate(c, convert, layout=layout, capacity_factor=True)
    for bad in (True, False, "max"):
        with pytest.raises(ValueError):
            convert_and_aggregate(c, convert, aggregate_time=bad)
    with pytest.raises(ValueError):
        convert_and_aggregate(c, convert, per_unit=True)
    with pytest.raises(ValueError):
        convert_and_aggregate(c, convert, aggregate_time="sum", capacity_factor=True)


def test_null_poisons_weighted_sums(spark):
    values = spark.createDataFrame([(0, 0, 1.0), (1, 0, None), (0, 1, 2.0), (1, 1, 3.0)], "cell_id long, time int, v double")
    weights = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0), ("b", 1, 0.0)], "bus string, cell_id long, w double")
    got = {(r.bus, r.time): r.v for r in aggregate_matrix(values, weights).collect()}
    assert got == {("a", 0): None, ("a", 1): 8.0, ("b", 0): 1.0, ("b", 1): 2.0}


def test_wind_rules():
    with pytest.raises(RuntimeError):
        wind.extrapolate(["wnd100m"], 80)
    with pytest.raises(AssertionError):
        wind.extrapolate(["roughness"], 80)
    with pytest.raises(ValueError):
        wind.extrapolate(["wnd100m", "roughness"], 80, method="cubic")


def test_turbine_rules():
    base = {"V": [0, 25], "POW": [0, 1], "hub_height": 1, "P": 1}
    assert catalog.windturbine(base)["POW"][-1] == 0.0
    assert catalog.windturbine(base, add_cutout_windspeed=False)["POW"][-1] == 1.0
    for bad in ({"V": [0]}, base | {"V": [0, 1, 2]}, base | {"V": [3, 1]}):
        with pytest.raises(ValueError):
            catalog.windturbine(bad)


def test_interpolation_at_doubled_knots(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 12.5, 24.999, 25.0, 25.1, None)], "x double")
    got = [r[0] for r in df.select(basic.interpolate(F.col("x"), [0.0, 12.0, 25.0, 25.0], [0.0, 3.0, 3.0, 0.0])).collect()]
    assert got == pytest.approx([0.0, 0.0, 3.0, 3.0, 0.0, 0.0, None])


def test_smooth_curve_is_a_fleet():
    t = wind.smooth(catalog.windturbine("Vestas_V112_3MW"))
    assert len(t["V"]) == 72 and t["P"] == max(t["POW"]) < 3.06


def test_own_cell_has_share_one(spark):
    c, _ = mock(spark)
    grid = c.grid()
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d), (a, b)]
    ring = [{"x": x, "y": y} for x, y in box(5.5, 50.5, 6.5, 51.5)]
    hole = [{"x": x, "y": y} for x, y in [(5.5, 49.5), (8.5, 49.5), (8.5, 50.0), (6.0, 50.0), (6.0, 51.0), (8.5, 51.0), (8.5, 51.5), (5.5, 51.5)]]
    shapes = spark.createDataFrame([("own", ring), ("c", hole)], "shape_id string, pts array<struct<x:double,y:double>>")
    got = {(r.shape_id, r.cell_id): r.share for r in geometry.indicator_matrix(grid, shapes).collect()}
    assert {k: v for k, v in got.items() if k[0] == "own"} == {("own", 5): pytest.approx(1.0)}
    assert sum(v for k, v in got.items() if k[0] == "c") == pytest.approx(3 * 2 - 2.5)


def test_regrid_blocks(spark):
    block = {(0, 0): 0.25, (1, 0): 0.5, (0, 1): 0.3, (1, 1): 0.1}
    pixels = spark.createDataFrame([(x, y, block[x // 4, y // 4]) for x in range(8) for y in range(8)], "px int, py int, code double")
    grid = spark.createDataFrame([(y * 2 + x, x, y, 4.0 * x, 4.0 * x + 4, 4.0 * y, 4.0 * y + 4) for x in range(2) for y in range(2)], "cell_id long, ix int, iy int, x0 double, x1 double, y0 double, y1 double")
    got = {r.cell_id: r.value for r in raster.regrid_average(pixels, grid, 1.0, []).collect()}
    assert got == {0: pytest.approx(0.25), 1: pytest.approx(0.5), 2: pytest.approx(0.3), 3: pytest.approx(0.1)}


def test_upstream_survives_cycles(spark):
    basins = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "hid long, next_down long")
    targets = spark.createDataFrame([(1,)], "hid long")
    assert sorted(r.hid for r in hydro.upstream(basins, targets).collect()) == [1, 2, 3, 4]


def test_upstream_has_no_depth_limit(spark):
    basins = spark.createDataFrame([(k, k - 1) for k in range(1, 9)], "hid long, next_down long")
    targets = spark.createDataFrame([(1,)], "hid long")
    basins.createOrReplaceTempView("long_river")
    targets.createOrReplaceTempView("mouth")
    assert hydro.upstream(basins, targets).count() == 8
    assert spark.sql(hydro.upstream_sql("long_river", "mouth", 8)).count() == 8
    with pytest.raises(Exception, match="raise depth"):
        spark.sql(hydro.upstream_sql("long_river", "mouth", 4)).collect()
    assert "depth" not in hydro.upstream.__code__.co_varnames


def test_recursive_upstream_passes_sparks_own_limits(spark):
    spark.range(1, 200).selectExpr("id as hid", "if(id < 9, id - 1, 0L) as next_down").createOrReplaceTempView("wide_river")
    spark.range(0, 1).selectExpr("id as hid").createOrReplaceTempView("wide_mouth")
    limits = {"spark.sql.cteRecursionRowLimit": "50", "spark.sql.cteRecursionLevelLimit": "4"}
    was = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        assert spark.sql(hydro.upstream_sql("wide_river", "wide_mouth", 9)).count() == 200
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_buffered_geometry_reaches_into_the_shape(spark):
    box = lambda x0, y0, x1, y1: [{"x": x, "y": y} for x, y in [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]
    kind = "shape_id string, pts array<struct<x:double,y:double>>"
    shape = spark.createDataFrame([("s", box(0.0, 0.0, 4.0, 4.0))], kind)
    beside = spark.createDataFrame([("p", box(-2.0, 0.0, 0.0, 4.0))], kind)
    for invert in (False, True):
        container = raster.ExclusionContainer(4326, 1.0).add_geometry(beside, buffer=1.0, invert=invert)
        free = {r.px for r in raster.shape_availability(shape, container).collect()}
        assert free == ({0} if invert else {1, 2, 3})


def test_unknown_panel_and_orientation():
    with pytest.raises(ValueError):
        solar.panel_power(F.lit(1.0), F.lit(1.0), {"model": "x"})
    with pytest.raises(ValueError):
        solar.orientation("upside_down")


def test_no_overlap_raises(spark):
    far = spark.createDataFrame([(10_000, 10_000, 1)], "px int, py int, code int")
    shape = spark.createDataFrame([("s", [{"x": x, "y": y} for x, y in [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)]])], "shape_id string, pts array<struct<x:double,y:double>>")
    with pytest.raises(ValueError):
        raster.shape_availability(shape, raster.ExclusionContainer(4326, 1.0).add_raster(far)).count()
    ok = raster.ExclusionContainer(4326, 1.0).add_raster(far, allow_no_overlap=True, codes=[1])
    assert raster.shape_availability(shape, ok).count() == 9


def test_stream_matches_batch(spark, tmp_path):
    from voltmesh.streaming import convert_stream

    c, v = mock(spark)
    c.weather.write.parquet(str(tmp_path / "in"))
    weights = spark.createDataFrame([("a", k, 1.0) for k in range(12)], "bus string, cell_id long, w double")
    rows = spark.readStream.schema(c.weather.schema).parquet(str(tmp_path / "in"))
    q = convert_stream(rows, lambda w: F.col("var"), weights).writeStream.format("memory").queryName("stream_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.v for r in spark.table("stream_out").orderBy("time").collect()] == pytest.approx(v.sum(1).tolist())
