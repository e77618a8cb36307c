"""Polygons, lines and cells: overlap shares, intersections, points in polygons, projections.

A shape is one or more rows (shape_id, pts): a closed ring each, as ARRAY<STRUCT<x, y>>. Rings of a shape must not cross; a column
``is_hole``, where there is one, tells rings that cut out of the others. Edges are followed through the cells of a regular grid, so overlays are
equi-joins on (ix, iy).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basic import num


def ring(points: Column) -> Column:
    """The ring without a repeated end point."""
    return F.when((F.size(points) > 1) & (points[0] == F.element_at(points, -1)), F.slice(points, 1, F.size(points) - 1)).otherwise(points)


def next_points(points: Column) -> Column:
    return F.concat(F.slice(points, 2, F.greatest(F.lit(0), F.size(points) - 1)), F.slice(points, 1, 1))


def ring_area(points: Column) -> Column:
    """Shoelace."""
    crossed = F.zip_with(points, next_points(points), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(crossed, num(0), lambda s, v: s + v)) / num(2)


def lattice(grid: DataFrame) -> dict[str, float]:
    """Lower corner (gx, gy), steps (dx, dy), first and last indices of a grid of equal boxes."""
    g = grid.agg(F.min("x0").alias("gx"), F.min("y0").alias("gy"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("ix").alias("ix0"), F.max("ix").alias("ix1"), F.min("iy").alias("iy0"), F.max("iy").alias("iy1")).first().asDict()
    if g["gx"] is None:  # no cells: a lattice that nothing meets
        g = g | {"gx": 0.0, "gy": 0.0, "x1": 1.0, "y1": 1.0, "ix0": 0, "ix1": 0, "iy0": 0, "iy1": 0}
    nx, ny = g["ix1"] - g["ix0"] + 1, g["iy1"] - g["iy0"] + 1
    return g | {"nx": nx, "ny": ny, "dx": (g["x1"] - g["gx"]) / nx, "dy": (g["y1"] - g["gy"]) / ny}


def _steps(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high))


def edge_rows(shapes: DataFrame, g: dict[str, float], lines: bool = False) -> DataFrame:
    """(shape_id, u0, v0, u1, v1, turn): edges in steps of the lattice; turn is 1 for a ring whose inside counts, -1 for a hole, with the sign of its sense of rotation."""
    points = F.col("pts") if lines else ring(F.col("pts"))
    starts = F.slice("pts", 1, F.greatest(F.lit(0), F.size("pts") - 1)) if lines else F.col("pts")
    ends = F.slice("pts", 2, F.greatest(F.lit(0), F.size("pts") - 1)) if lines else next_points(F.col("pts"))
    crossed = F.zip_with("pts", next_points(F.col("pts")), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    turn = num(1) if lines else F.signum(F.aggregate(crossed, num(0), lambda s, v: s + v)) * ring_sign(shapes)
    u = lambda p: (p["x"] - num(g["gx"])) / num(g["dx"])
    v = lambda p: (p["y"] - num(g["gy"])) / num(g["dy"])
    each = F.zip_with(starts, ends, lambda a, b: F.struct(u(a).alias("u0"), v(a).alias("v0"), u(b).alias("u1"), v(b).alias("v1")))
    ringed = shapes.withColumn("pts", points).where(F.size("pts") > (1 if lines else 2))
    # the sense of rotation is found before the edges part, so that no edge carries its outline on
    return ringed.select("shape_id", turn.alias("turn"), each.alias("es")).select("shape_id", "turn", F.explode("es").alias("e")).select("shape_id", "turn", "e.*")


def _slab(v: Column, j: Column) -> Column:
    """v held within row j."""
    return F.greatest(j.cast("double"), F.least(v, j + num(1)))


def _crossed_cells(edges: DataFrame, g: dict[str, float]) -> DataFrame:
    """(shape_id, iy, ix, area, cover) of each edge in each cell it crosses: ``cover`` is how far it climbs there, ``area`` the signed trapezoid between it and the
    cell's right side. Column -1 stands for all that lies left of the lattice; what lies right of it covers nothing."""
    v0, v1 = F.col("v0"), F.col("v1")
    low = F.greatest(F.lit(0), F.floor(F.least(v0, v1)).cast("int"))
    high = F.least(F.lit(g["ny"] - 1), F.ceil(F.greatest(v0, v1)).cast("int") - 1)
    rows = edges.where(v0 != v1).withColumn("j", F.explode(_steps(low, high)))
    at = lambda v: F.col("u0") + (v - v0) * (F.col("u1") - F.col("u0")) / (v1 - v0)
    va, vb = _slab(v0, F.col("j")), _slab(v1, F.col("j"))
    parts = rows.select("shape_id", "turn", "j", (vb - va).alias("climb"), at(va).alias("a"), at(vb).alias("b"))
    left = F.greatest(F.lit(-1), F.floor(F.least("a", "b")).cast("int"))
    right = F.least(F.lit(g["nx"] - 1), F.greatest(F.lit(-1), F.floor(F.greatest("a", "b")).cast("int")))
    cells = parts.withColumn("i", F.explode(_steps(left, right)))
    side = F.col("i") + num(1)
    inside = lambda c: F.least(F.when(F.col("i") >= 0, F.greatest(F.col(c), F.col("i").cast("double"))).otherwise(F.col(c)), side)
    a, b = inside("a"), inside("b")
    cover = F.when(F.col("a") == F.col("b"), F.col("climb")).otherwise(F.col("climb") * (b - a) / F.nullif(F.col("b") - F.col("a"), num(0)))
    # a ring that turns left climbs on its right side, so what is right of a climbing edge counts negative
    cells = cells.select("shape_id", F.col("j").alias("iy"), F.col("i").alias("ix"), (-F.col("turn") * cover).alias("cover"), (side - (a + b) / num(2)).alias("wide"))
    sums = cells.groupBy("shape_id", "iy", "ix").agg(F.sum(F.col("cover") * F.col("wide")).alias("area"), F.sum("cover").alias("cover"))
    return sums.withColumn("area", F.when(F.col("ix") >= 0, F.col("area")).otherwise(num(0)))


#: Shares and covers below this are rounding.
TINY = 1e-12


def _shares(shapes: DataFrame, g: dict[str, float]) -> DataFrame:
    """(shape_id, iy, ix, share) in the lattice's own numbering from 0: crossed cells have their trapezoids and what has been
    covered before them in their row; cells between two crossed ones are covered as a whole."""
    row = Window.partitionBy("shape_id", "iy").orderBy("ix")
    run = F.sum("cover").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    until = F.coalesce(F.lead("ix").over(row), F.lit(g["nx"])) - 1
    rows = _crossed_cells(edge_rows(shapes, g), g).select("shape_id", "iy", "ix", (F.col("area") + run - F.col("cover")).alias("share"), run.alias("run"), until.alias("until"))
    at = lambda ix, share: F.struct(ix.alias("ix"), share.alias("share"))
    own = F.when(F.col("ix") >= 0, F.array(at(F.col("ix"), F.col("share"))))
    between = F.when(F.abs("run") > TINY, F.transform(_steps(F.col("ix") + 1, F.col("until")), lambda k: at(k, F.col("run"))))
    none = F.array().cast("array<struct<ix:int,share:double>>")
    cells = rows.select("shape_id", "iy", F.explode(F.concat(F.coalesce(own, none), F.coalesce(between, none))).alias("c"))
    return cells.select("shape_id", "iy", "c.*")


def _cells_of(found: DataFrame, grid: DataFrame, g: dict[str, float]) -> DataFrame:
    """cell_id for (ix, iy) from 0."""
    named = found.withColumns({"ix": F.col("ix") + F.lit(g["ix0"]), "iy": F.col("iy") + F.lit(g["iy0"])})
    return named.join(grid.select("cell_id", "ix", "iy"), ["ix", "iy"])


def ring_sign(shapes: DataFrame) -> Column:
    """1 for a ring that adds to its shape, -1 for a hole."""
    return F.when(F.col("is_hole"), num(-1)).otherwise(num(1)) if "is_hole" in shapes.columns else num(1)


def shape_area(shapes: DataFrame) -> DataFrame:
    """(shape_id, area) in the plane of the points, holes taken out."""
    return shapes.groupBy("shape_id").agg(F.sum(ring_sign(shapes) * ring_area(ring(F.col("pts")))).alias("area"))


def indicator_matrix(grid: DataFrame, shapes: DataFrame) -> DataFrame:
    """(shape_id, cell_id, share): the share of each cell's area that lies in the shape.

    By exact accumulation: each edge adds its trapezoids to the cells it crosses, a running sum along a row of cells fills the inside. So rows are as many as
    crossings and covered cells, none carries an outline, and a shape of any size is spread over tasks by rows of cells. Shares up to TINY are rounding and left out.
    """
    g = lattice(grid)
    return _cells_of(_shares(shapes, g).where(F.col("share") > TINY), grid, g).select("shape_id", "cell_id", "share")


#: Touching counts: edges this near to a cell's side, in widths of a cell, touch it.
TOUCH = 1e-9


def touched_cells(edges: DataFrame, g: dict[str, float]) -> DataFrame:
    """(shape_id, iy, ix) of the cells that edges cross or touch, by stepping along each edge from row to row."""
    v0, v1 = F.col("v0"), F.col("v1")
    near = lambda low, high, n: _steps(F.greatest(F.lit(0), F.ceil(low - TOUCH).cast("int") - 1), F.least(F.lit(n - 1), F.floor(high + TOUCH).cast("int")))
    rows = edges.withColumn("iy", F.explode(near(F.least(v0, v1), F.greatest(v0, v1), g["ny"])))
    at = lambda v: F.col("u0") + F.coalesce(F.try_divide(v - v0, v1 - v0), num(0)) * (F.col("u1") - F.col("u0"))
    flat = v0 == v1
    a = F.when(flat, F.col("u0")).otherwise(at(_slab(v0, F.col("iy"))))
    b = F.when(flat, F.col("u1")).otherwise(at(_slab(v1, F.col("iy"))))
    cells = rows.select("shape_id", "iy", a.alias("a"), b.alias("b"))
    return cells.select("shape_id", "iy", F.explode(near(F.least("a", "b"), F.greatest("a", "b"), g["nx"])).alias("ix")).distinct()


def intersection_matrix(grid: DataFrame, shapes: DataFrame, lines: bool = False) -> DataFrame:
    """(shape_id, cell_id) of cells that a polygon (or line) meets; touching counts. A cell within a hole is not met. The work is the cells
    that are met: those along the edges, and those between them."""
    g = lattice(grid)
    found = touched_cells(edge_rows(shapes, g, lines), g)
    if not lines:
        inside = _shares(shapes, g).where(F.col("share") > TINY).select("shape_id", "iy", "ix")
        found = found.unionByName(inside).distinct()
    return _cells_of(found, grid, g).select("shape_id", "cell_id")


# WGS84 and the parameters of the European equal-area projection (EPSG:3035).
_A, _E2 = 6378137.0, 0.00669437999014
_E = math.sqrt(_E2)
_LAT0, _LON0, _FE, _FN = math.radians(52.0), math.radians(10.0), 4321000.0, 3210000.0


def _q(sin: float) -> float:
    return (1 - _E2) * (sin / (1 - _E2 * sin * sin) - math.log((1 - _E * sin) / (1 + _E * sin)) / (2 * _E))


_QP = _q(1.0)


def authalic(lat: Column) -> Column:
    """q of the authalic latitude; lat in radians."""
    s = F.sin(lat)
    return num(1 - _E2) * (s / (num(1) - num(_E2) * s * s) - F.ln((num(1) - num(_E) * s) / (num(1) + num(_E) * s)) / num(2 * _E))


def project(x: Column, y: Column, crs: int | str) -> tuple[Column, Column]:
    """Degrees to metres: "cea" (equal-area cylinder) or 3035 (Lambert azimuthal equal-area); 4326 as it is."""
    if crs in (4326, "4326"):
        return x, y
    q = authalic(F.radians(y))
    if crs == "cea":
        return num(_A) * F.radians(x), num(_A) * q / num(2)
    if crs in (3035, "3035"):
        beta, beta0 = F.asin(q / num(_QP)), math.asin(_q(math.sin(_LAT0)) / _QP)
        rq = _A * math.sqrt(_QP / 2)
        m0 = math.cos(_LAT0) / math.sqrt(1 - _E2 * math.sin(_LAT0) ** 2)
        d = _A * m0 / (rq * math.cos(beta0))
        lam = F.radians(x) - num(_LON0)
        b = num(rq) * F.sqrt(num(2) / (num(1) + num(math.sin(beta0)) * F.sin(beta) + num(math.cos(beta0)) * F.cos(beta) * F.cos(lam)))
        east = num(_FE) + b * num(d) * F.cos(beta) * F.sin(lam)
        north = num(_FN) + b / num(d) * (num(math.cos(beta0)) * F.sin(beta) - num(math.sin(beta0)) * F.cos(beta) * F.cos(lam))
        return east, north
    raise ValueError(f"no projection for {crs!r}: 4326, 'cea' or 3035")


def _latitude(beta: Column) -> Column:
    """Degrees of latitude from the authalic latitude in radians, by the published series in the eccentricity (to its sixth power)."""
    e2, e4, e6 = _E2, _E2**2, _E2**3
    terms = ((2, e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040), (4, 23 * e4 / 360 + 251 * e6 / 3780), (6, 761 * e6 / 45360))
    return F.degrees(beta + sum((num(c) * F.sin(num(k) * beta) for k, c in terms), num(0)))


def unproject(x: Column, y: Column, crs: int | str) -> tuple[Column, Column]:
    """Metres of a plane of ``project`` to degrees."""
    if crs in (4326, "4326"):
        return x, y
    if crs == "cea":
        return F.degrees(x / num(_A)), _latitude(F.asin(num(2) * y / num(_A * _QP)))
    if crs in (3035, "3035"):
        beta0 = math.asin(_q(math.sin(_LAT0)) / _QP)
        rq = _A * math.sqrt(_QP / 2)
        d = _A * math.cos(_LAT0) / math.sqrt(1 - _E2 * math.sin(_LAT0) ** 2) / (rq * math.cos(beta0))
        east, north = (x - num(_FE)) / num(d), (y - num(_FN)) * num(d)
        rho = F.hypot(east, north)
        c = num(2) * F.asin(rho / num(2 * rq))
        beta = F.asin(F.cos(c) * num(math.sin(beta0)) + F.coalesce(F.try_divide(north * F.sin(c) * num(math.cos(beta0)), rho), num(0)))
        lam = F.atan2(east * F.sin(c), rho * num(math.cos(beta0)) * F.cos(c) - north * num(math.sin(beta0)) * F.sin(c))
        return F.degrees(num(_LON0) + lam), _latitude(beta)
    raise ValueError(f"no projection for {crs!r}: 4326, 'cea' or 3035")


def moved(x: Column, y: Column, source: int | str, target: int | str) -> tuple[Column, Column]:
    """A point of one plane in another one."""
    return (x, y) if str(source) == str(target) else project(*unproject(x, y, source), target)


def reproject(points: Column, crs: int | str, source: int | str = 4326) -> Column:
    """Vertex by vertex, from ``source`` (degrees by default)."""

    def move(p: Column) -> Column:
        x, y = moved(p["x"], p["y"], source, crs)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(points, move)


def cell_area(grid: DataFrame, crs: int | str = 4326) -> DataFrame:
    """(cell_id, area) in the plane of the coordinate system."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    box = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    return grid.withColumn("pts", reproject(box, crs)).select("cell_id", ring_area(F.col("pts")).alias("area"))


def density_layout(grid: DataFrame, density: float, crs: int | str = 4326) -> DataFrame:
    return cell_area(grid, crs).select("cell_id", (F.col("area") * num(density)).alias("capacity"))


def _points(text: Column) -> Column:
    """Points of "x y, x y"; further coordinates are left out."""
    pairs = F.transform(F.split(F.trim(text), r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    return F.transform(pairs, lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y")))


def wkt_ring(text: Column) -> Column:
    """The line of LINESTRING(x y, ...), or the outer ring of a POLYGON without holes; null for any other text."""
    simple = text.rlike(r"(?i)^\s*(LINESTRING\s*\([^()]*\)|POLYGON\s*\(\s*\([^()]*\)\s*\))\s*$")
    return F.when(simple, _points(F.regexp_extract(text, r"\(+([^()]*)\)", 1)))


_RINGS = "array<struct<pts:array<struct<x:double,y:double>>,is_hole:boolean>>"


def wkt_rings(text: Column) -> Column:
    """All rings (pts, is_hole) of a POLYGON or MULTIPOLYGON: of each polygon the first is its outline, the others are holes."""
    polygons = F.regexp_extract_all(text, F.lit(r"\(\s*\([^()]*\)(?:\s*,\s*\([^()]*\))*\s*\)"), F.lit(0))

    def rings(polygon: Column) -> Column:
        each = F.regexp_extract_all(polygon, F.lit(r"\(([^()]*)\)"), F.lit(1))
        return F.transform(each, lambda r, i: F.struct(_points(r).alias("pts"), (i > 0).alias("is_hole")))

    return F.flatten(F.transform(polygons, rings)).cast(_RINGS)


def geojson_rings(text: Column) -> Column:
    """The same of a GeoJSON Polygon or MultiPolygon, bare or as the geometry of a feature."""
    bare = F.coalesce(F.get_json_object(text, "$.geometry"), text)
    one, several = (F.from_json(F.get_json_object(bare, "$.coordinates"), f"{'array<' * n}double{'>' * n}") for n in (3, 4))
    polygons = F.when(F.get_json_object(bare, "$.type") == "MultiPolygon", several).when(F.get_json_object(bare, "$.type") == "Polygon", F.array(one))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    return F.flatten(F.transform(polygons, lambda rings: F.transform(rings, lambda r, i: F.struct(F.transform(r, point).alias("pts"), (i > 0).alias("is_hole"))))).cast(_RINGS)


def with_rings(df: DataFrame, rings: Column) -> DataFrame:
    """One row for each ring, with pts and is_hole."""
    return df.withColumn("__ring", F.explode(rings)).select(*(c for c in df.columns if c not in ("pts", "is_hole")), "__ring.pts", "__ring.is_hole")
