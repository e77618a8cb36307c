"""Holes, parts, scanlines, planes, buffers at the edge, basins and long rivers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from voltmesh.operators import geometry, hydro, raster
from voltmesh.sources import catalog

KIND = "shape_id string, pts array<struct<x:double,y:double>>, is_hole boolean"


def points(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def box(x0, y0, x1, y1):
    return points((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def inside(x, y, rings):
    hits = 0
    for r in rings:
        for a, b in zip(r, r[1:] + r[:1]):
            if (a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                hits += 1
    return hits % 2 == 1


def away(x, y, rings):
    best = math.inf
    for r in rings:
        for a, b in zip(r, r[1:] + r[:1]):
            dx, dy = b["x"] - a["x"], b["y"] - a["y"]
            t = max(0, min(1, ((x - a["x"]) * dx + (y - a["y"]) * dy) / (dx * dx + dy * dy or 1)))
            best = min(best, math.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy))
    return best


@pytest.fixture(scope="module")
def star():
    """A ragged ring with a hole, and a second part."""
    rng = random.Random(3)
    ring = points(*((20 + far * math.cos(k / 20 * math.pi), 20 + far * math.sin(k / 20 * math.pi)) for k in range(40) for far in [8 + 9 * rng.random()]))
    return [ring, box(17.3, 18.1, 22.2, 21.7), box(40.2, 10.3, 44.4, 13.9)]


@pytest.mark.parametrize("buffer", [0.0, 2.3])
def test_scanlines_against_points(spark, star, buffer):
    shapes = spark.createDataFrame([("s", r, k == 1) for k, r in enumerate(star)], KIND)
    got = [(r.px, r.py) for r in raster.shape_pixels(shapes, 0.5, buffer).collect()]
    want = {(px, py) for px in range(-10, 110) for py in range(-10, 100) for x, y in [((px + 0.5) / 2, (py + 0.5) / 2)] if inside(x, y, star) or buffer and away(x, y, star) <= buffer}
    assert len(got) == len(set(got)) and set(got) == want


def test_holes_and_parts(spark, star):
    grid = spark.createDataFrame([(y * 10 + x, x, y, 5.0 * x, 5.0 * x + 5, 5.0 * y, 5.0 * y + 5) for x in range(10) for y in range(10)], "cell_id long, ix int, iy int, x0 double, x1 double, y0 double, y1 double")
    shapes = spark.createDataFrame([("s", r, k == 1) for k, r in enumerate(star)] + [("frame", box(0, 0, 10, 10), False), ("frame", box(3, 3, 7, 7), True)], KIND)
    area = {r.shape_id: r.area for r in geometry.shape_area(shapes).collect()}
    share = {r.shape_id: r.a for r in geometry.indicator_matrix(grid, shapes).groupBy("shape_id").agg((F.sum("share") * 25).alias("a")).collect()}
    assert area["frame"] == pytest.approx(84) and share == {k: pytest.approx(v) for k, v in area.items()}
    big = spark.createDataFrame([("ring", box(0.5, 0.5, 24.5, 24.5), False), ("ring", box(4, 4, 21, 21), True)], KIND)
    met = {r.cell_id for r in geometry.intersection_matrix(grid, big).collect()}
    assert met == {y * 10 + x for x in range(5) for y in range(5)} - {y * 10 + x for x in range(1, 4) for y in range(1, 4) if 5 * x > 4 and 5 * x + 5 < 21 and 5 * y > 4 and 5 * y + 5 < 21}


def test_wkt_and_geojson(spark):
    wkt = ["POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (3 3, 7 3, 7 7, 3 7, 3 3))", "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((5 5, 9 5, 9 9, 5 9, 5 5), (6 6, 7 6, 7 7, 6 7, 6 6)))", "POINT (1 2)"]
    df = spark.createDataFrame([(str(k), x) for k, x in enumerate(wkt)], "shape_id string, text string")
    want = {"0": 84.0, "1": 4.0 + 16 - 1}
    assert {r.shape_id: r.area for r in geometry.shape_area(geometry.with_rings(df, geometry.wkt_rings(F.col("text")))).collect()} == want
    assert [r[0] is None for r in df.select(geometry.wkt_ring(F.col("text"))).collect()] == [True] * 3
    ring = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    import json

    shapes = [{"type": "Polygon", "coordinates": [ring(0, 10), ring(3, 7)]}, {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring(0, 2)], [ring(5, 9), ring(6, 7)]]}}]
    df = spark.createDataFrame([(str(k), json.dumps(x)) for k, x in enumerate(shapes)], "shape_id string, text string")
    assert {r.shape_id: r.area for r in geometry.shape_area(geometry.with_rings(df, geometry.geojson_rings(F.col("text")))).collect()} == want


@pytest.mark.parametrize("crs", ["cea", 3035])
def test_planes_and_back(spark, crs):
    df = spark.createDataFrame([(x, y) for x in (-9.5, 3.25, 10.0, 30.0) for y in (35.0, 47.11, 52.0, 70.0)], "x double, y double")
    there = df.select("x", "y", *(c.alias(n) for c, n in zip(geometry.project(F.col("x"), F.col("y"), crs), "ab")))
    for r in there.select("x", "y", *(c.alias(n) for c, n in zip(geometry.unproject(F.col("a"), F.col("b"), crs), "uv"))).collect():
        assert (r.u, r.v) == (pytest.approx(r.x, abs=1e-7), pytest.approx(r.y, abs=1e-7))


def test_raster_in_another_plane(spark):
    """A raster in degrees over shapes in metres: the code under a pixel's centre counts."""
    codes = spark.range(100 * 100).select((F.col("id") % 100 + 900).cast("int").alias("px"), (F.floor(F.col("id") / 100) + 5150).cast("int").alias("py")).withColumn("code", (F.col("px") >= 950).cast("int"))
    corners = [(9.2, 51.7), (9.8, 51.7), (9.8, 52.3), (9.2, 52.3)]
    shape = spark.createDataFrame([("s", points(*corners))], "shape_id string, pts array<struct<x:double,y:double>>").withColumn("pts", geometry.reproject(F.col("pts"), 3035))
    container = raster.ExclusionContainer(3035, 500.0).add_raster(codes, crs=4326, res=0.01)
    free = raster.shape_availability(shape, container)
    lon = geometry.unproject((F.col("px") + 0.5) * 500, (F.col("py") + 0.5) * 500, 3035)[0]
    kept, whole = free.agg(F.count("*"), F.max(lon)).first(), raster.shape_pixels(shape, 500.0).count()
    assert kept[0] / whole == pytest.approx(0.5, abs=0.02) and kept[1] < 9.5
    with pytest.raises(ValueError):
        container.add_raster(codes, crs=4326)


def test_buffers_grow_in_from_the_edge_where_nodata_is_excluded(spark):
    shape = spark.createDataFrame([("s", box(0, 0, 10, 10))], "shape_id string, pts array<struct<x:double,y:double>>")
    zeros = spark.range(400).select((F.col("id") % 20 - 5).cast("int").alias("px"), (F.floor(F.col("id") / 20) - 5).cast("int").alias("py"), F.lit(0).alias("code"))
    free = lambda **o: raster.shape_availability(shape, raster.ExclusionContainer(4326, 1.0).add_raster(zeros, **o)).count()
    assert free() == 100
    # codes other than 0: beside the shape stands nodata (255), in the box that reaches one pixel on to the right and the top
    assert free(buffer=1.0) == 64
    assert free(buffer=1.0, codes=[7]) == 100
    assert free(buffer=1.0, nodata=0) == 100


def test_no_overlap_is_told_of_each_shape(spark):
    shapes = spark.createDataFrame([("a", box(0, 0, 3, 3)), ("b", box(50, 50, 53, 53))], "shape_id string, pts array<struct<x:double,y:double>>")
    pixels = spark.createDataFrame([(1, 1, 1)], "px int, py int, code int")
    with pytest.raises(ValueError):
        raster.shape_availability(shapes, raster.ExclusionContainer(4326, 1.0).add_raster(pixels))


def test_long_river(spark):
    n = 2000
    basins = spark.range(n).select(F.col("id").alias("hid"), (F.col("id") - 1).alias("next_down"))
    got = {r.root: r.n for r in hydro.upstream(basins, spark.createDataFrame([(0,), (700,), (1999,)], "hid long")).groupBy("root").agg(F.count("*").alias("n")).collect()}
    assert got == {0: n, 700: n - 700, 1999: 1}


def test_determine_basins(spark):
    rows = [(1, 0.0, 0, box(0, 0, 2, 2)), (2, 30.0, 1, box(2, 0, 4, 2)), (3, 75.0, 2, box(4, 0, 6, 2)), (4, 55.0, 1, box(0, 2, 2, 4)), (9, 5.0, 0, box(8, 8, 9, 9))]
    basins = spark.createDataFrame(rows, "HYBAS_ID long, DIST_MAIN double, NEXT_DOWN long, pts array<struct<x:double,y:double>>")
    plants = spark.createDataFrame([("mouth", 1.0, 1.0), ("mid", 3.0, 1.0), ("sea", 20.0, 20.0)], "plant string, lon double, lat double")
    got = {(r.plant, r.basin, r.hid, r.distance) for r in hydro.determine_basins(plants, basins).collect()}
    assert got == {("mouth", 1, 1, 0.0), ("mouth", 1, 2, 30.0), ("mouth", 1, 3, 75.0), ("mouth", 1, 4, 55.0), ("mid", 2, 2, 0.0), ("mid", 2, 3, 45.0)}
    with pytest.raises(ValueError, match="DIST_MAIN"):
        hydro.determine_basins(plants, basins.drop("DIST_MAIN"))


def test_quantile_of_many_values(spark):
    df = spark.range(150_000).select(F.lit("a").alias("bus"), (F.pmod(F.col("id") * 7919, F.lit(150_000)) / 7).alias("v"))
    edge = df.agg(F.percentile("v", F.lit(0.3))).first()[0]
    assert hydro.drop_low(df, 0.3).where("v > 0").agg(F.min("v"), F.count("*")).first() == df.where(F.col("v") >= edge).agg(F.min("v"), F.count("*")).first()


def test_exact_quantiles(spark):
    import random

    from voltmesh.operators.quantile import with_quantile

    random.seed(2)
    mixed = [random.choice([-1, 1]) * random.random() * 10 ** random.randint(-300, 300) for _ in range(500)] + [0.0, -0.0, 1e-320, -1e-320, float("inf"), float("-inf")] * 3 + [7.25] * 200
    for values in (mixed, [3.0], [2.0, 2.0, 2.0], [-1.5, -2.5, 4.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
        order = sorted(values)
        for q in (0.0, 0.005, 0.3, 0.5, 0.997, 1.0):
            place = q * (len(order) - 1)
            a, b = order[math.floor(place)], order[math.ceil(place)]
            got = with_quantile(df, q)[1]
            assert got == (a if a == b else a + (b - a) * (place - math.floor(place)))
    none = spark.createDataFrame([(None,)], "v double")
    assert with_quantile(none, 0.5)[1] is None and [r.v for r in hydro.drop_low(none).collect()] == [0.0]


def test_times_are_numbered_without_one_task(spark):
    rows = spark.sql("select explode(sequence(timestamp'2024-01-01 05:00:00', timestamp'2024-01-09 03:00:00', interval 5 hours)) time").unionByName(spark.sql("select timestamp'2024-02-01' time"))
    got = hydro.numbered_times(rows.unionByName(rows))
    order = sorted(r.time for r in rows.collect())
    assert sorted((r.time, r.k, r.n) for r in got.collect()) == [(t, k, len(order)) for k, t in enumerate(order)]
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "Window [" in text and not any("Window" in a and "SinglePartition" in b for a, b in zip(text.splitlines(), text.splitlines()[2:], strict=False))


def test_turbines_by_folder(spark, tmp_path):
    (tmp_path / "Own_2MW.yaml").write_text("name: own\nHUB_HEIGHT: 90\nV: [0, 5, 25]\nPOW: [0, 1, 2]\n")
    assert catalog.windturbine("Own_2MW", folder=tmp_path)["POW"] == [0.0, 1.0, 2.0, 0.0]
    assert catalog.windturbine("Vestas_V90_3MW")["P"] == 3.0
    assert all(catalog.windturbine(n)["V"] == sorted(catalog.windturbine(n)["V"]) for n in catalog.WINDTURBINES)
    with pytest.raises(KeyError):
        catalog.windturbine("Nobody_1MW", folder=tmp_path)
    (tmp_path / "mine.yaml").write_text("technology: solar tower\nr_irradiance: 900\nefficiency:\n  altitude: {0: 0, 1: 90, 2: 0, 3: 90}\n  azimuth: {0: 0, 1: 0, 2: 360, 3: 360}\n  value: {0: 10, 1: 50, 2: 20, 3: 60}\n")
    assert catalog.cspinstallation("mine", folder=tmp_path) == {"technology": "solar tower", "r_irradiance": 900.0, "altitude": [0.0, 90.0], "azimuth": [0.0, 360.0], "efficiency": [[0.1, 0.2], [0.5, 0.6]]}


def test_availability_over_a_grid_in_another_plane(spark):
    grid = spark.createDataFrame([(k, k, 0, 9.0 + 0.25 * k, 9.25 + 0.25 * k, 52.0, 52.25) for k in range(3)], "cell_id long, ix int, iy int, x0 double, x1 double, y0 double, y1 double")
    shapes = spark.createDataFrame([("mid", box(9.25, 52.0, 9.5, 52.25))], "shape_id string, pts array<struct<x:double,y:double>>").withColumn("pts", geometry.reproject(F.col("pts"), 3035))
    empty = raster.ExclusionContainer(3035, 250.0)
    share = {r.cell_id: r.share for r in raster.compute_shape_availability(shapes, empty, grid, 4326).collect()}
    assert share[1] == pytest.approx(1.0, abs=0.02) and sum(share.values()) == pytest.approx(1.0, abs=0.02)
    assert raster.compute_shape_availability(shapes, empty).count() == raster.shape_pixels(shapes, 250.0).count()
    for half in ({"grid": grid}, {"grid_crs": 4326}):
        with pytest.raises(ValueError):
            raster.compute_shape_availability(shapes, empty, **half)


def test_padded_bounds():
    assert raster.padded_bounds((0.0, 0.5, 10.0, 10.5), 1.0) == (0, 0, 11, 11)


def test_capacities_and_uniform_layouts(spark):
    assert catalog.rated_capacity(catalog.windturbine("Vestas_V112_3MW")) == 3.06
    assert catalog.rated_capacity(catalog.solarpanel("CSi")) == 0.1
    k = catalog.SOLARPANELS["KANENA"]
    assert catalog.rated_capacity(catalog.solarpanel("KANENA")) == pytest.approx((k["A"] + 1000 * k["B"] + k["C"] * math.log(1000)) * 1e3)


def test_turbine_of_a_library(spark):
    rows = [("E-82/2000", True, "[0, 3, 25]", "[0, 50, 2000]", "78; 85"), ("V90/3000", True, "[0, 4, 25]", "[0, 77, 3000]", None), ("V90/2000", True, "[0, 4, 25]", "[0, 60, 2000]", "80")]
    library = spark.createDataFrame(rows, "turbine_type string, has_power_curve boolean, power_curve_wind_speeds string, power_curve_values string, hub_height string")
    t = catalog.windturbine("oedb:e-82", library=library)
    assert (t["P"], t["hub_height"], t["POW"]) == (2.0, 81.0, [0.0, 0.05, 2.0, 0.0])
    for name in ("oedb:V90", "oedb:N100"):
        with pytest.raises(KeyError):
            catalog.windturbine(name, library=library)


def _clipped_area(ring, x0, x1, y0, y1):
    """Area of a ring in a box, by cutting it along the box's four sides."""
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            da, db = sign * (a[axis] - bound), sign * (b[axis] - bound)
            if (da >= 0) != (db >= 0):
                t = da / (da - db)
                out.append(tuple(p + t * (q - p) for p, q in zip(a, b, strict=True)))
            if db >= 0:
                out.append(b)
        ring = out
        if not ring:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def _segment_touches(a, b, x0, x1, y0, y1):
    low, high = 0.0, 1.0
    for p, d, m, n in ((a[0], b[0] - a[0], x0, x1), (a[1], b[1] - a[1], y0, y1)):
        if d == 0:
            if not m <= p <= n:
                return False
            continue
        t = sorted(((m - p) / d, (n - p) / d))
        low, high = max(low, t[0]), min(high, t[1])
    return low <= high


def _stars():
    import random

    random.seed(11)
    stars = {}
    for k in range(12):
        cx, cy, n, flip = random.uniform(-3, 13), random.uniform(-3, 9), random.randrange(3, 40), k % 2
        angles = [2 * math.pi * j / n for j in range(n)]
        far = [random.uniform(2, 6) for _ in range(n)]
        outer = [(cx + r * math.cos(t), cy + r * math.sin(t)) for r, t in zip(far, angles, strict=True)]
        inner = [(cx + 0.4 * r * math.cos(t), cy + 0.4 * r * math.sin(t)) for r, t in zip(far, angles, strict=True)]
        stars[f"s{k}"] = [(outer[::-1] if flip else outer, False), (inner, True)]
    stars["cell"] = [([(2.0, 3.0), (3.0, 3.0), (3.0, 4.0), (2.0, 4.0)], False)]
    stars["all"] = [([(-50.0, -50.0), (50.0, -50.0), (50.0, 50.0), (-50.0, 50.0)], False)]
    stars["left"] = [([(-9.0, 1.0), (-5.0, 1.0), (-5.0, 2.0)], False)]
    stars["right"] = [([(8.5, 1.5), (40.0, 1.5), (40.0, 2.5), (8.5, 2.5)], False)]
    stars["none"] = [([], False)]
    return stars


def _grid(spark, nx=10, ny=6, first=0):
    return spark.createDataFrame([(j * nx + i, i + first, j + first, float(i), i + 1.0, float(j), j + 1.0) for j in range(ny) for i in range(nx)], "cell_id long, ix int, iy int, x0 double, x1 double, y0 double, y1 double")


@pytest.mark.parametrize("first", [0, 7])
def test_shares_of_stars_with_holes(spark, first):
    stars = _stars()
    shapes = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in ring], hole) for k, rings in stars.items() for ring, hole in rings], KIND)
    got = {(r.shape_id, r.cell_id): r.share for r in geometry.indicator_matrix(_grid(spark, first=first), shapes).collect()}
    want = {(k, j * 10 + i): sum((-1 if hole else 1) * _clipped_area(ring, i, i + 1, j, j + 1) for ring, hole in rings if ring) for k, rings in stars.items() for i in range(10) for j in range(6)}
    assert {k for k, v in want.items() if v > 1e-9} <= set(got) and all(want[k] == pytest.approx(v, abs=1e-9) for k, v in got.items())
    assert got["cell", 32] == 1.0 and sum(v for k, v in got.items() if k[0] == "all") == 60


def test_cells_along_edges(spark):
    stars = _stars()
    shapes = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in ring], hole) for k, rings in stars.items() for ring, hole in rings], KIND)
    boxes = {j * 10 + i: (i, i + 1, j, j + 1) for j in range(6) for i in range(10)}
    area = lambda rings, b: sum((-1 if hole else 1) * _clipped_area(ring, *b) for ring, hole in rings if ring)
    edges = lambda ring, closed=True: list(zip(ring, ring[1:] + ring[:1], strict=True))[: len(ring) if closed else len(ring) - 1]
    want = {(k, c) for k, rings in stars.items() for c, b in boxes.items() if area(rings, b) > 1e-9 or any(_segment_touches(*e, *b) for ring, _ in rings for e in edges(ring))}
    assert {tuple(r) for r in geometry.intersection_matrix(_grid(spark), shapes).collect()} == want
    lines = {"flat": [(0.5, 2.0), (7.5, 2.0)], "up": [(3.0, -4.0), (3.0, 9.0)], "zigzag": [(-1.0, 0.3), (4.2, 5.9), (4.2, 0.1), (12.0, 3.3)], "corner": [(-1.0, 1.0), (1.0, -1.0)], "away": [(20.0, 20.0), (30.0, 20.0)], "point": [(1.5, 1.5), (1.5, 1.5)]}
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in v]) for k, v in lines.items()], "shape_id string, pts array<struct<x:double,y:double>>")
    want = {(k, c) for k, v in lines.items() for c, b in boxes.items() if any(_segment_touches(*e, *b) for e in edges(v, False))}
    assert {tuple(r) for r in geometry.intersection_matrix(_grid(spark), df, lines=True).collect()} == want
