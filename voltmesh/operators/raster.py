"""Rasters as (px, py, code) tables: exclusions, dilation, availability, regridding.

Shapes and what they lose are runs of pixels (``runs``) from scanlines up to shares of cells; single pixels are told apart only where codes
of a raster are read, where planes differ, and in results that list pixels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import num
from . import runs
from .geometry import moved, reproject, ring_area

SHAPE = ["shape_id"]


@dataclass(frozen=True)
class Spec:
    """One exclusion: a raster of pixels (px, py, code) or shapes (pts) in the container's plane."""

    data: DataFrame
    kind: str
    codes: object = None
    buffer: float = 0.0
    invert: bool = False
    nodata: int = 255
    allow_no_overlap: bool = False
    crs: int | str | None = None
    res: float | None = None


@dataclass(frozen=True)
class ExclusionContainer:
    """An immutable list of exclusions over square pixels of ``res`` in a plane."""

    crs: int | str = 3035
    res: float = 100.0
    specs: tuple[Spec, ...] = ()

    def add_raster(self, pixels: DataFrame, codes=None, buffer: float = 0.0, invert: bool = False, nodata: int = 255, allow_no_overlap: bool = False, crs: int | str | None = None, res: float | None = None) -> ExclusionContainer:
        """codes: a list or range of codes, or a function of the code column; None excludes codes other than 0. ``crs`` and ``res``
        are the plane and the pixel size of a raster that is not in the container's; its nearest pixel then counts."""
        if crs is not None and res is None and str(crs) != str(self.crs):
            raise ValueError("a raster in a plane of its own needs its pixel size (res)")
        return replace(self, specs=(*self.specs, Spec(pixels, "raster", codes, buffer, invert, nodata, allow_no_overlap, crs, res)))

    def add_geometry(self, shapes: DataFrame, buffer: float = 0.0, invert: bool = False, crs: int | str | None = None) -> ExclusionContainer:
        """``crs``: the plane of the shapes' points, where it is not the container's."""
        return replace(self, specs=(*self.specs, Spec(shapes, "geometry", None, buffer, invert, crs=crs)))


def masked(code: Column, codes) -> Column:
    if callable(codes):
        return codes(code)
    if codes is None:
        return code != 0
    return code.isin([int(c) for c in codes])


def dilate(pixels: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Distinct pixels within n steps (|dx| + |dy| <= n) of the given ones."""
    return runs.pixels(runs.dilate(runs.of_pixels(pixels, by), n, by), by)


def _edges(shapes: DataFrame) -> DataFrame:
    """(shape_id, ax, ay, bx, by): the edges of all rings; a pixel row that carries no corner list can be shuffled."""
    ends = F.concat(F.slice("pts", 2, F.greatest(F.size("pts") - 1, F.lit(0))), F.slice("pts", 1, 1))
    edge = F.explode(F.zip_with("pts", ends, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))).alias("e")
    return shapes.select("shape_id", edge).select("shape_id", "e.*")


def _ends(low: Column, high: Column, res: float, open_end: bool) -> tuple[Column, Column]:
    """First and last number of the pixels whose centres lie from ``low`` up to ``high`` (without ``high`` if ``open_end``)."""
    a = F.ceil(low / num(res) - num(0.5)).cast("int")
    b = F.ceil(high / num(res) - num(0.5)).cast("int") - 1 if open_end else F.floor(high / num(res) - num(0.5)).cast("int")
    return a, b


def _between(low: Column, high: Column, res: float, open_end: bool) -> Column:
    """The numbers themselves; null if there are none."""
    a, b = _ends(low, high, res, open_end)
    return F.when(a <= b, F.sequence(a, b))


def _span(df: DataFrame, low: Column, high: Column, res: float, open_end: bool) -> DataFrame:
    a, b = _ends(low, high, res, open_end)
    return df.select("shape_id", "py", a.alias("x0"), b.alias("x1")).where("x0 <= x1")


def _filled(edges: DataFrame, res: float) -> DataFrame:
    """Runs of pixels whose centres lie inside, by scanlines: each edge crosses rows of pixels, the crossings of a row are sorted, and what lies
    between the first and second, third and fourth and so on is inside. So holes and parts need no rule of their own, and the work is edges times rows."""
    rows = edges.withColumn("py", F.explode(_between(F.least("ay", "by"), F.greatest("ay", "by"), res, True)))
    y = (F.col("py") + num(0.5)) * num(res)
    crossed = rows.select("shape_id", "py", ((F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")).alias("x"))
    lines = crossed.groupBy("shape_id", "py").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = lines.select("shape_id", "py", "xs", F.explode(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1)).alias("k"))
    spans = pairs.select("shape_id", "py", F.get("xs", 2 * F.col("k")).alias("a"), F.get("xs", 2 * F.col("k") + 1).alias("b"))
    return _span(spans, F.col("a"), F.col("b"), res, True)


def _beside(edges: DataFrame, res: float, reach: float) -> DataFrame:
    """Runs of pixels whose centres are at most ``reach`` from an edge. Those form a capsule around it, which a row of pixels cuts in one span:
    from the discs around both ends and the box between them."""
    ys = (F.least("ay", "by") - num(reach), F.greatest("ay", "by") + num(reach))
    rows = edges.withColumn("py", F.explode(_between(*ys, res, False)))
    y = (F.col("py") + num(0.5)) * num(res)
    long = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    nx, ny = (F.coalesce(F.try_divide(d, long), num(0)) * num(reach) for d in (F.col("ay") - F.col("by"), F.col("bx") - F.col("ax")))
    lows, highs = [], []
    for x0, y0 in (("ax", "ay"), ("bx", "by")):
        half = F.when(F.abs(y - F.col(y0)) <= num(reach), F.sqrt(F.greatest(num(0), num(reach) * num(reach) - (y - F.col(y0)) * (y - F.col(y0)))))
        lows.append(F.col(x0) - half)
        highs.append(F.col(x0) + half)
    corners = [(F.col("ax") + nx, F.col("ay") + ny), (F.col("bx") + nx, F.col("by") + ny), (F.col("bx") - nx, F.col("by") - ny), (F.col("ax") - nx, F.col("ay") - ny)]
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1], strict=True):
        cut = F.when((F.least(y0, y1) <= y) & (y <= F.greatest(y0, y1)) & (long > 0), F.coalesce(F.try_divide((x1 - x0) * (y - y0), y1 - y0), num(0)) + x0)
        lows.append(cut)
        highs.append(cut)
    return _span(rows, F.least(*lows), F.greatest(*highs), res, False)


def shape_runs(shapes: DataFrame, res: float, buffer: float = 0.0) -> DataFrame:
    """(shape_id, py, x0, x1): runs of the pixels whose centre lies in the shape or at most ``buffer`` beside it; pixel p spans [p * res, (p + 1) * res)."""
    edges = _edges(shapes)
    inside = _filled(edges, res)
    return runs.union(inside.unionByName(_beside(edges, res, buffer)), SHAPE) if buffer else inside


def shape_pixels(shapes: DataFrame, res: float, buffer: float = 0.0) -> DataFrame:
    """(shape_id, px, py) of the same pixels."""
    return runs.pixels(shape_runs(shapes, res, buffer), SHAPE)


def _in_plane(spec: Spec, pixels: DataFrame, crs: int | str, res: float) -> DataFrame:
    """pixels with the code of the pixel of a raster in another plane that is under their centres, null where it has none."""
    x, y = moved((F.col("px") + num(0.5)) * num(res), (F.col("py") + num(0.5)) * num(res), crs, spec.crs)
    under = pixels.withColumns({"sx": F.floor(x / num(spec.res)).cast("int"), "sy": F.floor(y / num(spec.res)).cast("int")})
    return under.join(spec.data.select(F.col("px").alias("sx"), F.col("py").alias("sy"), "code"), ["sx", "sy"], "left").drop("sx", "sy")


def _boxes(shapes: DataFrame, res: float) -> DataFrame:
    """(shape_id, bx0, bx1, by0, by1): whole pixels around each shape, one more beyond its largest corners."""
    xs, ys = F.transform("pts", lambda p: p["x"]), F.transform("pts", lambda p: p["y"])
    at = lambda c: F.floor(c / num(res)).cast("int")
    return shapes.groupBy("shape_id").agg(F.min(at(F.array_min(xs))).alias("bx0"), F.max(at(F.array_max(xs))).alias("bx1"), F.min(at(F.array_min(ys))).alias("by0"), F.max(at(F.array_max(ys))).alias("by1"))


def _around(shapes: DataFrame, own: DataFrame, n: int, res: float) -> DataFrame:
    """Runs within n steps of a shape that are not its own but in the box around it."""
    near = runs.subtract(runs.dilate(own, n, SHAPE), own, SHAPE).join(_boxes(shapes, res), "shape_id").where("py between by0 and by1")
    return near.select("shape_id", "py", F.greatest("x0", "bx0").alias("x0"), F.least("x1", "bx1").alias("x1")).where("x0 <= x1")


def _raster_hits(spec: Spec, own: DataFrame, container: ExclusionContainer) -> tuple[DataFrame, DataFrame]:
    """(runs of the shapes that the raster covers, runs that it takes before its buffer)."""
    hit = lambda code: ~masked(code, spec.codes) if spec.invert else masked(code, spec.codes)
    if spec.crs is None or str(spec.crs) == str(container.crs) and spec.res in (None, container.res):
        # the raster's own runs are found once, whatever the number of shapes
        covered = runs.meet(own, runs.of_pixels(spec.data.select("px", "py"), []), SHAPE)
        taken = runs.meet(own, runs.of_pixels(spec.data.where(hit(F.col("code"))).select("px", "py"), []), SHAPE)
    else:
        coded = _in_plane(spec, runs.pixels(own, SHAPE), container.crs, container.res).where("code is not null")
        covered = runs.of_pixels(coded, SHAPE)
        taken = runs.of_pixels(coded.where(hit(F.col("code"))), SHAPE)
    # where the raster has no pixel stands nodata; a condition on a literal, which the optimizer settles
    return covered, taken.unionByName(runs.subtract(own, covered, SHAPE).where(hit(F.lit(spec.nodata))))


def excluded_runs(own: DataFrame, shapes: DataFrame, container: ExclusionContainer) -> DataFrame | None:
    """(shape_id, py, x0, x1) of the runs of shapes, ``own``, that any exclusion takes; they may overlap. None without an exclusion.

    A raster is cut out by each shape: what lies beside the shape counts as ``nodata``, and where that is excluded (by invert, by
    codes, or as a code other than 0) and the raster has a buffer, it grows into the shape. The buffer of a geometry grows in the whole plane by
    its distance, before it is inverted, so a geometry beside a shape can reach in.
    """
    out = None
    for spec in container.specs:
        if spec.kind == "raster":
            covered, taken = _raster_hits(spec, own, container)
            if not spec.allow_no_overlap and not own.select("shape_id").distinct().join(covered, "shape_id", "left_anti").isEmpty():
                raise ValueError("a shape and a raster have no pixel in common: check the plane, or allow_no_overlap=True")
            if spec.buffer:
                n = int(spec.buffer / container.res) + 1
                beside = ~masked(F.lit(spec.nodata), spec.codes) if spec.invert else masked(F.lit(spec.nodata), spec.codes)
                taken = runs.dilate(taken.unionByName(_around(shapes, own, n, container.res).where(beside)), n, SHAPE)
        else:
            given = spec.data if spec.crs is None else spec.data.withColumn("pts", reproject(F.col("pts"), container.crs, spec.crs))
            inside = runs.union(shape_runs(given, container.res, spec.buffer), [])
            taken = runs.meet(own, inside, SHAPE)
            taken = runs.subtract(own, taken, SHAPE) if spec.invert else taken
        out = taken if out is None else out.unionByName(taken)
    return out


def eligible_runs(shapes: DataFrame, container: ExclusionContainer) -> DataFrame:
    """(shape_id, py, x0, x1): runs of pixels that stay eligible."""
    own = shape_runs(shapes, container.res)
    taken = excluded_runs(own, shapes, container)
    return own if taken is None else runs.subtract(own, taken, SHAPE)


def excluded_pixels(shapes: DataFrame, container: ExclusionContainer) -> DataFrame:
    """(shape_id, px, py) of shape pixels that any exclusion takes."""
    own = shape_runs(shapes, container.res)
    taken = excluded_runs(own, shapes, container)
    return runs.pixels(own.limit(0) if taken is None else runs.intersect(own, taken, SHAPE), SHAPE)


def shape_availability(shapes: DataFrame, container: ExclusionContainer) -> DataFrame:
    """(shape_id, px, py) of pixels that stay eligible."""
    return runs.pixels(eligible_runs(shapes, container), SHAPE)


def eligible_share(shapes: DataFrame, container: ExclusionContainer) -> DataFrame:
    """(shape_id, share) of eligible area."""
    count = lambda df, name: df.groupBy("shape_id").agg(F.sum(runs.length()).alias(name))
    whole = count(shape_runs(shapes, container.res), "n")
    return whole.join(count(eligible_runs(shapes, container), "m"), "shape_id", "left").select("shape_id", (F.coalesce("m", F.lit(0)) / F.col("n")).alias("share"))


def availability_matrix(grid: DataFrame, shapes: DataFrame, container: ExclusionContainer, grid_crs: int | str | None = None) -> DataFrame:
    """(shape_id, cell_id, share): eligible share of each cell's area. One job for all shapes and pixels.

    grid: boxes in the container's plane, where each run counts by its overlap; or in ``grid_crs``, where it counts for the cell that holds its
    centre, against the cell's area in the container's plane.
    """
    free = eligible_runs(shapes, container)
    if grid_crs is None or str(grid_crs) == str(container.crs):
        met = _overlaps(free, grid, container.res)
        whole = F.first((F.col("cx1") - F.col("cx0")) * (F.col("cy1") - F.col("cy0")))
        return met.groupBy("shape_id", "cell_id").agg(F.try_divide(F.sum("o"), whole).alias("share"))
    free = runs.pixels(free, SHAPE)
    g = _lattice(grid)
    x, y = moved((F.col("px") + num(0.5)) * num(container.res), (F.col("py") + num(0.5)) * num(container.res), container.crs, grid_crs)
    at = lambda c, low, step: F.floor((c - num(low)) / num(step)).cast("int")
    counts = free.select("shape_id", at(x, g["x"], g["dx"]).alias("ix"), at(y, g["y"], g["dy"]).alias("iy")).groupBy("shape_id", "ix", "iy").agg(F.count("*").alias("n"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    box = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    areas = grid.select("cell_id", "ix", "iy", ring_area(reproject(box, container.crs, grid_crs)).alias("area"))
    return counts.join(areas, ["ix", "iy"]).select("shape_id", "cell_id", F.least(num(1), F.col("n") * num(container.res**2) / F.col("area")).alias("share"))


def compute_shape_availability(shapes: DataFrame, container: ExclusionContainer, grid: DataFrame | None = None, grid_crs: int | str | None = None) -> DataFrame:
    """The eligible pixels of the shapes, or their shares of the cells of a grid, for which its plane has to be named as well."""
    if (grid is None) != (grid_crs is None):
        raise ValueError("a target needs both, grid and grid_crs")
    return shape_availability(shapes, container) if grid is None else availability_matrix(grid, shapes, container, grid_crs)


def _lattice(grid: DataFrame) -> dict[str, float]:
    """Lower corner, steps and last indices of a grid that begins at index 0."""
    g = grid.agg(F.min("x0").alias("x"), F.min("y0").alias("y"), F.max("x1").alias("xx"), F.max("y1").alias("yy"), F.max("ix").alias("nx"), F.max("iy").alias("ny")).first().asDict()
    return g | {"dx": (g["xx"] - g["x"]) / (g["nx"] + 1), "dy": (g["yy"] - g["y"]) / (g["ny"] + 1)}


def _overlaps(spans: DataFrame, grid: DataFrame, res: float) -> DataFrame:
    """Runs (py, x0, x1) with the cells they overlap: cell_id, the cell's box cx0, cx1, cy0, cy1 and the area in common, o."""
    g = _lattice(grid)
    dx, dy = g["dx"], g["dy"]

    def cells(low_end: Column, high_end: Column, low: float, step: float, n: int) -> Column:
        a = F.floor((low_end * num(res) - num(low)) / num(step) + num(1e-9)).cast("int")
        b = F.ceil((high_end * num(res) - num(low)) / num(step) - num(1e-9)).cast("int") - 1
        a, b = F.greatest(a, F.lit(0)), F.least(b, F.lit(n))
        return F.when(a <= b, F.sequence(a, b))

    rows = spans.withColumn("ix", F.explode(cells(F.col("x0"), F.col("x1") + 1, g["x"], dx, g["nx"]))).withColumn("iy", F.explode(cells(F.col("py"), F.col("py") + 1, g["y"], dy, g["ny"])))
    met = rows.join(grid.select("cell_id", "ix", "iy", *(F.col(c).alias(f"c{c}") for c in ("x0", "x1", "y0", "y1"))), ["ix", "iy"])
    over = lambda p, q, a, b: F.greatest(num(0), F.least((q + 1) * num(res), F.col(b)) - F.greatest(p * num(res), F.col(a)))
    return met.withColumn("o", over(F.col("x0"), F.col("x1"), "cx0", "cx1") * over(F.col("py"), F.col("py"), "cy0", "cy1"))


def regrid_average(pixels: DataFrame, grid: DataFrame, res: float, by: list[str], value: str = "code", cover: bool = False) -> DataFrame:
    """(by, cell_id, value): means over target cells weighted by overlap; ``cover`` divides by the cell's area instead."""
    met = _overlaps(pixels.select(*by, "py", F.col("px").alias("x0"), F.col("px").alias("x1"), F.col(value).alias("__v")), grid, res)
    whole = F.first((F.col("cx1") - F.col("cx0")) * (F.col("cy1") - F.col("cy0"))) if cover else F.sum("o")
    return met.groupBy(*by, "cell_id").agg(F.try_divide(F.sum(F.col("o") * F.col("__v")), whole).alias("value"))


def regrid_nearest(pixels: DataFrame, grid: DataFrame, res: float, value: str = "code") -> DataFrame:
    """(cell_id, value) of the pixel under each target centre."""
    at = lambda a, b: F.floor((F.col(a) + F.col(b)) / num(2 * res)).cast("int")
    return grid.select("cell_id", at("x0", "x1").alias("px"), at("y0", "y1").alias("py")).join(pixels, ["px", "py"], "left").select("cell_id", F.col(value).alias("value"))


def padded_bounds(bounds: tuple[float, float, float, float], res: float) -> tuple[int, int, int, int]:
    """Pixel ranges (left, bottom, right, top) that cover the bounds; right and top reach on to the next pixel, also from its edge."""
    left, bottom, right, top = bounds
    return math.floor(left / res), math.floor(bottom / res), math.floor(right / res) + 1, math.floor(top / res) + 1


def regrid_bilinear(pixels: DataFrame, grid: DataFrame, res: float, value: str = "code", grid_crs: int | str = 4326, crs: int | str | None = None) -> DataFrame:
    """(cell_id, value) from the four pixels whose centres surround each target centre, weighted by nearness along both axes; pixels that are
    missing or null leave their weight to the others, and a cell without any gets null. ``crs``: the raster's plane, where it is not the grid's."""
    x, y = (F.col("x0") + F.col("x1")) / num(2), (F.col("y0") + F.col("y1")) / num(2)
    x, y = moved(x, y, grid_crs, grid_crs if crs is None else crs)
    placed = grid.select("cell_id", (x / num(res) - num(0.5)).alias("u"), (y / num(res) - num(0.5)).alias("v"))
    share = lambda c, k: (c - F.floor(c)) if k else num(1) - (c - F.floor(c))
    u, v = F.col("u"), F.col("v")
    corner = lambda i, j: F.struct((F.floor(u).cast("int") + i).alias("px"), (F.floor(v).cast("int") + j).alias("py"), (share(u, i) * share(v, j)).alias("w"))
    four = placed.select("cell_id", F.explode(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))).alias("n")).select("cell_id", "n.*")
    met = four.where("w > 0").join(pixels.select("px", "py", F.col(value).alias("__v")), ["px", "py"], "left")
    there = F.when(F.col("__v").isNotNull(), F.col("w"))
    return met.groupBy("cell_id").agg(F.try_divide(F.sum(there * F.col("__v")), F.sum(there)).alias("value"))


def regrid(pixels: DataFrame, grid: DataFrame, res: float, how: str = "average", value: str = "code", least: float = 1e-9) -> DataFrame:
    """(cell_id, value) of a raster on another grid. how: "average" (by overlap), "nearest", "bilinear", or over the pixels that overlap a cell by more
    than ``least``: "sum" (a pixel's value counts by the share of it in the cell), "min", "max", "mode" (by overlap; of equal ones the smallest)."""
    if how == "average":
        return regrid_average(pixels, grid, res, [], value)
    if how in ("nearest", "bilinear"):
        return (regrid_nearest if how == "nearest" else regrid_bilinear)(pixels, grid, res, value)
    met = _overlaps(pixels.select("py", F.col("px").alias("x0"), F.col("px").alias("x1"), F.col(value).alias("__v")), grid, res).where(F.col("o") > least)
    if how == "mode":
        sums = met.where("__v is not null").groupBy("cell_id", "__v").agg(F.round(F.sum("o"), 12).alias("o"))
        return sums.groupBy("cell_id").agg(F.max_by("__v", F.struct("o", -F.col("__v"))).alias("value"))
    ways = {"sum": F.sum(F.col("o") * F.col("__v")) / num(res * res), "min": F.min("__v"), "max": F.max("__v")}
    if how not in ways:
        raise ValueError(f"no resampling {how!r}: average, nearest, bilinear, {', '.join(sorted(ways))} or mode")
    return met.groupBy("cell_id").agg(ways[how].alias("value"))
