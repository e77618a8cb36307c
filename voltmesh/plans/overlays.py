"""Queries of overlays, snaps, rivers, lines and rasters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.basic import num
from ..functions.line import line_limit
from ..operators import geometry, hydro, raster, runs
from ..sources.shared import shared_folder
from .weather import cutout, r6, read, sql, weather


def _box(x0, y0, x1, y1):
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each nation, by arithmetic of its key."""
    k = F.col("n_nationkey")
    x0, y0 = num(4.8) + num(0.03) * k, num(49.8) + num(0.02) * (k % 13)
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("shape_id"), _box(x0, y0, x0 + num(0.3), y0 + num(0.35)).alias("pts"))


_BOXES = "boxes as (select n_name as shape_id, 4.8e0 + 0.03e0*n_nationkey as bx0, 49.8e0 + 0.02e0*(n_nationkey % 13) as by0, 4.8e0 + 0.03e0*n_nationkey + 0.3e0 as bx1, 49.8e0 + 0.02e0*(n_nationkey % 13) + 0.35e0 as by1 from nation)"
_SHARE = (
    _BOXES
    + """, g as (select *, x - 0.125e0 as x0, x + 0.125e0 as x1, y - 0.125e0 as y0, y + 0.125e0 as y1 from cells),
share as (select shape_id, cell_id, greatest(0, least(bx1, x1) - greatest(bx0, x0))*greatest(0, least(by1, y1) - greatest(by0, y0))/0.0625e0 as share from boxes, g)"""
)


def j04_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.indicator_matrix(cutout(spark, sf_dir).grid(), _boxes(spark, sf_dir)).where("share > 1e-7")
    return found.select("shape_id", "cell_id", r6("share").alias("share"))


def j04_triangle_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped triangles: shares times cell area sum to the triangle's own area inside the grid."""
    k = F.col("n_nationkey")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = num(5) + num(0.02) * k, num(50.0)
    shapes = read(spark, sf_dir, "nation").select(F.col("n_name").alias("shape_id"), F.array(at(x, y), at(x + num(0.25), y), at(x, y + num(0.4))).alias("pts"))
    found = geometry.indicator_matrix(cutout(spark, sf_dir).grid(), shapes)
    return found.groupBy("shape_id").agg(r6(F.sum("share") * num(0.0625)).alias("area"))


def j04_hole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with a hole: the share of a cell that is left."""
    k = F.col("n_nationkey")
    x0, y0 = num(4.8) + num(0.03) * k, num(49.8) + num(0.02) * (k % 13)
    rings = F.explode(F.array(*(F.struct(_box(x0 + num(d), y0 + num(d), x0 + num(0.3) - num(d), y0 + num(0.35) - num(d)).alias("pts"), F.lit(d > 0).alias("is_hole")) for d in (0.0, 0.1))))
    shapes = read(spark, sf_dir, "nation").select(F.col("n_name").alias("shape_id"), rings.alias("r")).select("shape_id", "r.*")
    return geometry.indicator_matrix(cutout(spark, sf_dir).grid(), shapes).where("share > 1e-7").select("shape_id", "cell_id", r6("share").alias("share"))


def j04_supplier_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame (a box with a hole) for each supplier, so that shapes, edges and covered cells grow with the data."""
    k = F.col("s_suppkey")
    x0, y0 = num(4.7) + num(0.0137) * (k % 71), num(49.7) + num(0.0119) * (k * 7 % 67)
    rings = F.explode(F.array(*(F.struct(_box(x0 + num(d), y0 + num(d), x0 + num(0.8) - num(d), y0 + num(0.7) - num(d)).alias("pts"), F.lit(d > 0).alias("is_hole")) for d in (0.0, 0.11))))
    shapes = read(spark, sf_dir, "supplier").select(k.alias("shape_id"), rings.alias("r")).select("shape_id", "r.*")
    return geometry.indicator_matrix(cutout(spark, sf_dir).grid(), shapes).where("share > 1e-7").select("shape_id", "cell_id", r6("share").alias("share"))


def _over(d: str) -> str:
    return f"greatest(0, least(bx0 + 0.8e0 - {d}, x + 0.125e0) - greatest(bx0 + {d}, x - 0.125e0))*greatest(0, least(by0 + 0.7e0 - {d}, y + 0.125e0) - greatest(by0 + {d}, y - 0.125e0))/0.0625e0"


_FRAMES = f"""fr as (select s_suppkey as shape_id, 4.7e0 + 0.0137e0*(s_suppkey % 71) as bx0, 49.7e0 + 0.0119e0*(s_suppkey*7 % 67) as by0 from supplier),
frame as (select shape_id, cell_id, {_over("0e0")} - {_over("0.11e0")} as share from fr, cells)"""


def j05_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.intersection_matrix(cutout(spark, sf_dir).grid(), _boxes(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    pts = F.array(at(num(4.9) + num(0.03) * k, num(49.9)), at(num(5.7) - num(0.01) * k, num(50.61)))
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("shape_id"), pts.alias("pts"), num(0.06e-3).alias("resistance"))


def j13_line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.intersection_matrix(cutout(spark, sf_dir).grid(), _lines(spark, sf_dir), lines=True)


# a segment meets a box if the part of it within the box's slab in x and in y is not empty
_LINES = """ln as (select n_name as shape_id, 4.9e0 + 0.03e0*n_nationkey as ax, 49.9e0 as ay, 5.7e0 - 0.01e0*n_nationkey as bx, 50.61e0 as by_ from nation),
lc as (select shape_id, cell_id, ax, ay, bx, by_ from ln, cells where
 greatest(0e0, (y - 0.125e0 - ay)/(by_ - ay), case when bx = ax then 0e0 when bx > ax then (x - 0.125e0 - ax)/(bx - ax) else (x + 0.125e0 - ax)/(bx - ax) end)
 <= least(1e0, (y + 0.125e0 - ay)/(by_ - ay), case when bx = ax then 1e0 when bx > ax then (x + 0.125e0 - ax)/(bx - ax) else (x - 0.125e0 - ax)/(bx - ax) end)
 and greatest(ax, bx) >= x - 0.125e0 and least(ax, bx) <= x + 0.125e0)"""


def c14_line_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cutout(spark, sf_dir)
    out = hydro.line_rating(c.weather.withColumn("temperature", num(283) + F.col("cell_id")), c.grid(), _lines(spark, sf_dir))
    return out.select("line", "time", F.round("v", 4).alias("value"))


def _limit_sql(psi: str, ta: str) -> str:
    """CTEs from lw (rows with psi in radians) to ll with the limit in ampere."""
    return f"""l1 as (select *, ({ta} + 373e0)/2e0 as tf, 373e0 - {ta} as delta, {psi} as ps from lw),
l2 as (select *, 1.458e-6*pow(tf, 1.5e0)/(tf - 273.15e0 + 383.4e0) as mu, (1.293e0 - 1.525e-4*height + 6.379e-9*height*height)/(1e0 + 0.00367e0*(tf - 273.15e0)) as rho,
 2.424e-2 + 7.477e-5*(tf - 273.15e0) - 4.407e-9*(tf - 273.15e0)*(tf - 273.15e0) as k, wnd_azimuth - ps + pi()/2e0 as wa from l1),
l3 as (select *, 0.028e0*wnd100m*rho/mu as re, abs(wa - floor(wa/pi())*pi() - pi()/2e0) as phi from l2),
l4 as (select *, 1.194e0 - cos(phi) + 0.194e0*cos(2e0*phi) + 0.368e0*sin(2e0*phi) as kk from l3),
l5 as (select *, greatest(kk*(1.01e0 + 1.347e0*pow(re, 0.52e0))*k*delta, kk*0.754e0*pow(re, 0.6e0)*k*delta, 3.645e0*sqrt(rho)*pow(0.028e0, 0.75e0)*pow(delta, 1.25e0)) as qc,
 17.8e0*0.028e0*0.6e0*(pow(3.73e0, 4e0) - pow(({ta})/100e0, 4e0)) as qr, 0.6e0*influx_direct*0.028e0*sin(acos(cos(solar_altitude)*cos(solar_azimuth - ps))) as qs from l4),
ll as (select *, case when qc + qr - qs >= 0 then sqrt((qc + qr - qs)/0.06e-3) end as amp from l5)"""


_PSI = "radians(case when atan2(ax - bx, ay - by_) < 0 then atan2(ax - bx, ay - by_) + pi() else atan2(ax - bx, ay - by_) end)"


def r13_line_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weather(spark, sf_dir).withColumn("temperature", num(283) + F.col("cell_id"))
    return w.select("time", "cell_id", F.round(line_limit(num(45), num(0.06e-3)), 4).alias("value"))


def j06_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell centres in both equal-area projections, in kilometres."""
    c = cutout(spark, sf_dir).cells
    cea, laea = geometry.project(F.col("x"), F.col("y"), "cea"), geometry.project(F.col("x"), F.col("y"), 3035)
    return c.select("cell_id", *(F.round(v / num(1000), 4).alias(n) for n, v in (("cea_x", cea[0]), ("cea_y", cea[1]), ("laea_x", laea[0]), ("laea_y", laea[1]))))


def _reproject_sql() -> str:
    e2 = geometry._E2
    e, qp = geometry._E, geometry._QP
    beta0 = math.asin(geometry._q(math.sin(geometry._LAT0)) / qp)
    rq = geometry._A * math.sqrt(qp / 2)
    d = geometry._A * math.cos(geometry._LAT0) / math.sqrt(1 - e2 * math.sin(geometry._LAT0) ** 2) / (rq * math.cos(beta0))
    q = f"{1 - e2!r}::double*(sin(radians(y))/(1e0 - {e2!r}::double*sin(radians(y))*sin(radians(y))) - ln((1e0 - {e!r}::double*sin(radians(y)))/(1e0 + {e!r}::double*sin(radians(y))))/{2 * e!r}::double)"
    return sql(
        "select cell_id, round(6378137e0*radians(x)/1000e0, 4) as cea_x, round(6378137e0*q/2e0/1000e0, 4) as cea_y, "
        f"round((4321000e0 + b*{d!r}::double*cos(beta)*sin(lam))/1000e0, 4) as laea_x, round((3210000e0 + b/{d!r}::double*({math.cos(beta0)!r}::double*sin(beta) - {math.sin(beta0)!r}::double*cos(beta)*cos(lam)))/1000e0, 4) as laea_y from pb",
        f"""pq as (select *, {q} as q, radians(x) - radians(10e0) as lam from cells), pa as (select *, asin(q/{qp!r}::double) as beta from pq),
pb as (select *, {rq!r}::double*sqrt(2e0/(1e0 + {math.sin(beta0)!r}::double*sin(beta) + {math.cos(beta0)!r}::double*cos(beta)*cos(lam))) as b from pa)""",
    )


def j08_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as plants, snapped to cells."""
    k = F.col("s_suppkey")
    plants = read(spark, sf_dir, "supplier").select((num(4.7) + num(0.0137) * (k % 97)).alias("x"), (num(49.8) + num(0.0119) * (k % 89)).alias("y"), F.abs("s_acctbal").alias("Capacity"))
    return cutout(spark, sf_dir).layout_from_capacity_list(plants).select("cell_id", F.round("capacity", 4).alias("capacity"))


def c16_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell areas in square degrees, and layouts of uniform density."""
    grid = cutout(spark, sf_dir).grid()
    dense = geometry.density_layout(grid, 3.0, "cea").withColumnRenamed("capacity", "dense")
    return geometry.cell_area(grid).join(dense, "cell_id").select("cell_id", r6("area").alias("area"), F.round(F.col("dense") / num(1e6), 4).alias("dense"))


def _area_sql() -> str:
    e2, e = geometry._E2, geometry._E
    q = lambda y: f"({1 - e2!r}::double*(sin(radians({y}))/(1e0 - {e2!r}::double*pow(sin(radians({y})), 2)) - ln((1e0 - {e!r}::double*sin(radians({y})))/(1e0 + {e!r}::double*sin(radians({y}))))/{2 * e!r}::double))"
    return sql(f"select cell_id, round(0.0625e0, 6) as area, round(3e0*6378137e0*radians(0.25e0)*6378137e0*({q('y + 0.125e0')} - {q('y - 0.125e0')})/2e0/1e6, 4) as dense from cells")


def _rivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(p.alias("hid"), F.when(p > 1, F.floor(p / 2)).alias("next_down"), F.col("p_size").cast("double").alias("size"))


def _plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("plant"), (F.col("n_nationkey") + 3).cast("long").alias("hid"))


def j10_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    found = hydro.upstream(_rivers(spark, sf_dir), _plants(spark, sf_dir))
    return found.groupBy("root").agg(F.count("*").alias("n"), F.max("hid").alias("last"))


_UP = "up(root, hid) as (select distinct n_nationkey + 3, (n_nationkey + 3)::bigint from nation union all select up.root, p_partkey from up join part on p_partkey // 2 = up.hid and p_partkey > 1)"


def j10_upstream_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one recursive statement."""
    _rivers(spark, sf_dir).createOrReplaceTempView("voltmesh_basins")
    _plants(spark, sf_dir).createOrReplaceTempView("voltmesh_targets")
    return spark.sql(hydro.upstream_sql("voltmesh_basins", "voltmesh_targets")).groupBy("root").agg(F.count("*").alias("n"))


def _basin_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    x0, y0 = num(0.7) * (k % 5), num(0.7) * F.floor(k / 5)
    return read(spark, sf_dir, "nation").select(k.cast("long").alias("hid"), _box(x0, y0, x0 + num(0.9), y0 + num(0.9)).alias("pts"))


def j09_find_basin(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    plants = read(spark, sf_dir, "supplier").select(k.alias("plant"), (num(0.0137) * (k % 251) + num(0.003)).alias("lon"), (num(0.0171) * (k % 211) + num(0.003)).alias("lat"))
    return hydro.find_basins(plants, _basin_boxes(spark, sf_dir))


def o01_basins_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basins in the order in which the suppliers, taken as plants, name them first."""
    return hydro.first_appearance(j09_find_basin(spark, sf_dir), "hid", "plant")


def _hydrobasins(spark: SparkSession, sf_dir: str, boxes) -> DataFrame:
    """Basins as published: ids from 1, a binary tree of rivers, distances by id."""
    k = F.col("n_nationkey") + 1
    return read(spark, sf_dir, "nation").select(k.cast("long").alias("HYBAS_ID"), (num(11.0) * k).alias("DIST_MAIN"), F.floor(k / 2).alias("NEXT_DOWN"), boxes.alias("pts"))


_TREE = """tree as (select n_nationkey::bigint as k, n_nationkey::bigint + 1 as hid, 11e0*(n_nationkey + 1) as dist, ((n_nationkey + 1) // 2)::bigint as down from nation),
river(basin, hid) as (select hid, hid from tree union all select river.basin, tree.hid from river join tree on tree.down = river.hid)"""


def j11_determine_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as plants; some lie in no basin, some in several."""
    shared_folder(spark)
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    plants = read(spark, sf_dir, "supplier").select(k.alias("plant"), (num(0.0137) * (k % 251) + num(0.003)).alias("lon"), (num(0.0191) * (k % 211) + num(0.003)).alias("lat"))
    x0, y0 = num(0.7) * (n % 5), num(0.7) * F.floor(n / 5)
    found = hydro.determine_basins(plants, _hydrobasins(spark, sf_dir, _box(x0, y0, x0 + num(0.9), y0 + num(0.9))))
    return found.select("plant", "basin", "hid", F.round("distance", 4).alias("distance"))


_DETERMINED = f"""with recursive {_TREE},
pl as (select s_suppkey as plant, 0.0137e0*(s_suppkey % 251) + 0.003e0 as lon, 0.0191e0*(s_suppkey % 211) + 0.003e0 as lat from supplier),
own as (select plant, min(hid) as basin from pl, tree where lon > 0.7e0*(k % 5) and lon < 0.7e0*(k % 5) + 0.9e0 and lat > 0.7e0*(k // 5) and lat < 0.7e0*(k // 5) + 0.9e0 group by 1)
select plant, basin, river.hid, round(u.dist - d.dist, 4) as distance from own join river using (basin) join tree u on u.hid = river.hid join tree d on d.hid = basin"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plants of three cells each, with distances up the river in km."""
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("plant"), "n_nationkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("step"))
    return n.select("plant", ((F.col("n_nationkey") + F.col("step") * 5) % 12).cast("long").alias("hid"), (num(7.3) * F.col("step") * (F.col("n_nationkey") + 1)).alias("distance"))


def j12_inflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weather(spark, sf_dir).select(F.col("cell_id").alias("hid"), "time", F.col("runoff").alias("v"))
    return hydro.shifted_inflow(_members(spark, sf_dir), rows).select("plant", "time", r6("v").alias("value"))


_INFLOW = """mem as (select n_name as plant, (n_nationkey + s*5) % 12 as hid, floor(7.3e0*s*(n_nationkey + 1)/3.6e0 + 0.5e0)::bigint as hrs from nation, range(3) t(s)),
ax as (select time, row_number() over (order by time) - 1 as k, count(*) over () as n from (select distinct time from w))"""


def c13_hydro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inflow of a plant in each nation's box, from the basin there and all upstream, in millions of cubic metres per unit of runoff."""
    shared_folder(spark)
    k = F.col("n_nationkey")
    x0, y0 = num(4.8) + num(0.03) * k, num(49.8) + num(0.02) * (k % 13)
    basins = _hydrobasins(spark, sf_dir, _box(x0, y0, x0 + num(0.3), y0 + num(0.35)))
    plants = read(spark, sf_dir, "nation").select(F.col("n_name").alias("plant"), (x0 + num(0.011)).alias("lon"), (y0 + num(0.017)).alias("lat"))
    out = hydro.hydro(cutout(spark, sf_dir), plants, basins)
    return out.select("plant", "time", F.round(F.col("v") / num(1e6), 3).alias("value"))  # areas of corners in metres keep 12 digits


def _cea_y(degrees: str) -> str:
    """Northing in the equal-area cylinder."""
    e2, e = geometry._E2, geometry._E
    q = f"{1 - e2!r}::double*(sin(radians({degrees}))/(1e0 - {e2!r}::double*sin(radians({degrees}))*sin(radians({degrees}))) - ln((1e0 - {e!r}::double*sin(radians({degrees})))/(1e0 + {e!r}::double*sin(radians({degrees}))))/{2 * e!r}::double)"
    return f"(6378137e0*({q})/2e0)"


_HYDRO = (
    _SHARE
    + f""", {_TREE},
shr as (select n_nationkey::bigint + 1 as hid, cell_id, share/sum(share) over (partition by shape_id) as bwt from share join nation on n_name = shape_id where share > 0),
area as (select n_nationkey::bigint + 1 as hid, 6378137e0*radians(0.3e0)*({_cea_y("(by0 + 0.35e0)")} - {_cea_y("by0")}) as a from boxes join nation on n_name = shape_id),
br as (select hid, time, sum(runoff*bwt) as v from w join shr using (cell_id) group by 1, 2),
pl as (select n_name as plant, n_nationkey as pk, 4.8e0 + 0.03e0*n_nationkey + 0.011e0 as lon, 49.8e0 + 0.02e0*(n_nationkey % 13) + 0.017e0 as lat from nation),
own as (select plant, min(n_nationkey::bigint + 1) as basin from pl, boxes join nation on n_name = shape_id where lon > bx0 and lon < bx1 and lat > by0 and lat < by1 group by 1),
mem as (select plant, river.hid, floor((u.dist - d.dist)/3.6e0 + 0.5e0)::bigint as hrs from own join river using (basin) join tree u on u.hid = river.hid join tree d on d.hid = basin),
ax as (select time, row_number() over (order by time) - 1 as k, count(*) over () as n from (select distinct time from br))"""
)


def _pixels(spark: SparkSession) -> DataFrame:
    """100 x 100 pixels of 0.01 degrees over (5, 50) to (6, 51), codes by arithmetic."""
    ids = spark.range(10_000)
    px, py = (F.lit(500) + F.col("id") % 100).cast("int"), (F.lit(5000) + F.floor(F.col("id") / 100)).cast("int")
    return ids.select(px.alias("px"), py.alias("py")).withColumn("code", ((F.col("px") * 31 + F.col("py") * 17) % 100).cast("int"))


_PIXELS = "pix as (select (500 + i % 100)::int as px, (5000 + i // 100)::int as py, ((500 + i % 100)*31 + (5000 + i // 100)*17) % 100 as code from range(10000) t(i))"


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of 20 x 30 pixels for each supplier, so that shapes and their pixels grow with the data."""
    k = F.col("s_suppkey")
    x0, y0 = num(5.002) + num(0.01) * (k % 71), num(50.002) + num(0.01) * (k * 7 % 67)
    return read(spark, sf_dir, "supplier").select(k.cast("long").alias("shape_id"), _box(x0, y0, x0 + num(0.2), y0 + num(0.3)).alias("pts"))


_SQUARES = "sq as (select s_suppkey::bigint as shape_id, 500 + s_suppkey % 71 as px0, 5000 + s_suppkey*7 % 67 as py0 from supplier)"
_OWN = "own as (select shape_id, px, py, code, px0, py0 from pix join sq on px between px0 and px0 + 19 and py between py0 and py0 + 29)"


def _eligible(**options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        container = raster.ExclusionContainer(4326, 0.01).add_raster(_pixels(spark), **options)
        return _counted(raster.eligible_runs(_squares(spark, sf_dir), container))

    return run


def _counted(free: DataFrame) -> DataFrame:
    """Number of pixels and sums of their coordinates, from runs."""
    n = runs.length().cast("long")
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    return free.groupBy("shape_id").agg(total(n, "n"), total(F.expr("(x0 + x1) * bigint(x1 - x0 + 1) div 2"), "sx"), total(n * F.col("py"), "sy"))


def _eligible_sql(hit: str, extra: str = "") -> str:
    return sql(f"select shape_id, count(*)::bigint as n, sum(px)::bigint as sx, sum(py)::bigint as sy from own where not ({hit}) group by 1", f"{_PIXELS}, {_SQUARES}, {_OWN}{extra}")


_NEAR = "exists (select 1 from pix q where q.code < 3 and q.px between px0 and px0 + 19 and q.py between py0 and py0 + 29 and abs(q.px - own.px) + abs(q.py - own.py) <= 2)"


_WIDE = _NEAR.replace("q.code < 3", "q.code = 5").replace("<= 2)", "<= 9)")


def g03_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = spark.range(1).select(F.lit("q").alias("shape_id"), _box(num(5.5), num(50.5), num(5.9), num(50.9)).alias("pts"))
    return raster.eligible_share(_squares(spark, sf_dir), raster.ExclusionContainer(4326, 0.01).add_geometry(quarter)).select("shape_id", r6("share").alias("share"))


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small box for each nation."""
    k = F.col("n_nationkey")
    x0, y0 = num(5.0) + num(0.037) * k, num(50.0) + num(0.01) * (k * 13 % 97)
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("shape_id"), _box(x0, y0, x0 + num(0.03), y0 + num(0.02)).alias("pts"))


def _buffered(invert: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Geometries with a buffer reach into the shapes beside them."""
        container = raster.ExclusionContainer(4326, 0.01).add_geometry(_spots(spark, sf_dir), buffer=0.02513, invert=invert)
        return _counted(raster.eligible_runs(_squares(spark, sf_dir), container))

    return run


def _buffered_sql(invert: bool) -> str:
    near = """exists (select 1 from sp where pow(greatest(0e0, sx0 - own.px*0.01e0 - 0.005e0, own.px*0.01e0 + 0.005e0 - sx0 - 0.03e0), 2)
 + pow(greatest(0e0, sy0 - own.py*0.01e0 - 0.005e0, own.py*0.01e0 + 0.005e0 - sy0 - 0.02e0), 2) <= 0.02513e0*0.02513e0)"""
    return _eligible_sql(f"not {near}" if invert else near, ", sp as (select 5e0 + 0.037e0*n_nationkey as sx0, 50e0 + 0.01e0*(n_nationkey*13 % 97) as sy0 from nation)")


def g06_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster in degrees over shapes and pixels of a kilometre in the equal-area cylinder."""
    shapes = _squares(spark, sf_dir).withColumn("pts", geometry.reproject(F.col("pts"), "cea"))
    container = raster.ExclusionContainer("cea", 1000.0).add_raster(_pixels(spark), codes=range(20), crs=4326, res=0.01)
    return _counted(raster.eligible_runs(shapes, container))


_REPROJECTED = f"""rows as (select j::bigint as ry, {_cea_y("j*0.01e0")} as ya, {_cea_y("(j + 1)*0.01e0")} as yb from range(5000, 5100) t(j)),
xs as (select i::bigint as px, floor(degrees((i + 0.5e0)*1000e0/6378137e0)/0.01e0)::bigint as rx from range(550, 680) t(i)),
ys as (select j::bigint as py, ry from range(4700, 5000) t(j) join rows on (j + 0.5e0)*1000e0 >= ya and (j + 0.5e0)*1000e0 < yb),
sqm as (select s_suppkey::bigint as shape_id, 6378137e0*radians(5.002e0 + 0.01e0*(s_suppkey % 71)) as mx0, 6378137e0*radians(5.002e0 + 0.01e0*(s_suppkey % 71) + 0.2e0) as mx1,
 {_cea_y("(50.002e0 + 0.01e0*(s_suppkey*7 % 67))")} as my0, {_cea_y("(50.002e0 + 0.01e0*(s_suppkey*7 % 67) + 0.3e0)")} as my1 from supplier)"""


def g11_regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the pixels over cells of a quarter degree."""
    return raster.regrid_average(_pixels(spark), cutout(spark, sf_dir).grid(), 0.01, [], "code").select("cell_id", r6("value").alias("value"))


def g11_regrid_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.regrid_nearest(_pixels(spark), cutout(spark, sf_dir).grid().withColumns({"x0": F.col("x0") + num(0.003), "x1": F.col("x1") + num(0.003), "y0": F.col("y0") + num(0.003), "y1": F.col("y1") + num(0.003)}), 0.01)


def g12_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    container = raster.ExclusionContainer(4326, 0.01).add_raster(_pixels(spark), codes=range(20))
    return raster.availability_matrix(cutout(spark, sf_dir).grid(), _squares(spark, sf_dir), container).select("shape_id", "cell_id", r6("share").alias("share"))


_OVER = """ov as (select cell_id, pix.px, pix.py, code, greatest(0, least((px + 1)*0.01e0, x + 0.125e0) - greatest(px*0.01e0, x - 0.125e0))*greatest(0, least((py + 1)*0.01e0, y + 0.125e0) - greatest(py*0.01e0, y - 0.125e0)) as o
 from pix join cells on px*0.01e0 < x + 0.125e0 and (px + 1)*0.01e0 > x - 0.125e0 and py*0.01e0 < y + 0.125e0 and (py + 1)*0.01e0 > y - 0.125e0)"""

_FOUND = "select s_suppkey as plant, min(n_nationkey)::bigint as hid from supplier, nation where 0.0137e0*(s_suppkey % 251) + 0.003e0 > 0.7e0*(n_nationkey % 5) and 0.0137e0*(s_suppkey % 251) + 0.003e0 < 0.7e0*(n_nationkey % 5) + 0.9e0 and 0.0171e0*(s_suppkey % 211) + 0.003e0 > 0.7e0*(n_nationkey // 5) and 0.0171e0*(s_suppkey % 211) + 0.003e0 < 0.7e0*(n_nationkey // 5) + 0.9e0 group by 1"

QUERIES: dict[str, tuple] = {
    "j04_indicator": (j04_indicator, sql("select shape_id, cell_id, round(share, 6) as share from share where share > 1e-7", _SHARE)),
    "j04_triangle_area": (
        j04_triangle_area,
        # the part of the triangle right of x = 5.875 or above y = 50.625 is off the grid; none reaches so far
        "select n_name as shape_id, round(0.05e0 - 0.5e0*greatest(0e0, 5e0 + 0.02e0*n_nationkey + 0.25e0 - 5.875e0)*greatest(0e0, 5e0 + 0.02e0*n_nationkey + 0.25e0 - 5.875e0)*0.4e0/0.25e0, 6) as area from nation",
    ),
    "j04_hole": (
        j04_hole,
        sql(
            """select shape_id, cell_id, round(share - hole, 6) as share from (select share.*, greatest(0, least(bx1 - 0.1e0, x1) - greatest(bx0 + 0.1e0, x0))*greatest(0, least(by1 - 0.1e0, y1) - greatest(by0 + 0.1e0, y0))/0.0625e0 as hole
 from share join boxes using (shape_id) join g using (cell_id)) where share - hole > 1e-7""",
            _SHARE,
        ),
    ),
    "j04_supplier_frames": (j04_supplier_frames, sql("select shape_id, cell_id, round(share, 6) as share from frame where share > 1e-7", _FRAMES)),
    "j05_intersection": (j05_intersection, sql("select shape_id, cell_id from boxes, cells where bx1 >= x - 0.125e0 and bx0 <= x + 0.125e0 and by1 >= y - 0.125e0 and by0 <= y + 0.125e0", _BOXES)),
    "j06_reproject": (j06_reproject, _reproject_sql()),
    "j08_snap": (
        j08_snap,
        sql(
            "select cell_id, round(coalesce(c, 0), 4) as capacity from cells left join sn using (ix, iy)",
            "sn as (select greatest(0, least(3, floor((4.7e0 + 0.0137e0*(s_suppkey % 97) - 5e0)/0.25e0 + 0.5e0)))::int as ix, greatest(0, least(2, floor((49.8e0 + 0.0119e0*(s_suppkey % 89) - 50e0)/0.25e0 + 0.5e0)))::int as iy, sum(abs(s_acctbal)) as c from supplier group by 1, 2)",
        ),
    ),
    "j09_find_basin": (
        j09_find_basin,
        _FOUND,
    ),
    "o01_basins_in_order": (o01_basins_in_order, f"select hid, min(plant)::bigint as first from ({_FOUND}) group by 1"),
    "j10_upstream": (j10_upstream, f"with recursive {_UP} select root::bigint as root, count(*)::bigint as n, max(hid)::bigint as last from (select distinct root, hid from up) group by 1"),
    "j10_upstream_recursive": (j10_upstream_recursive, f"with recursive {_UP} select root::bigint as root, count(*)::bigint as n from (select distinct root, hid from up) group by 1"),
    "j11_determine_basins": (j11_determine_basins, _DETERMINED),
    "j12_inflow": (j12_inflow, sql("select plant, t.time, round(v, 6) as value from (select plant, (k + hrs) % n as k, sum(runoff) as v from w join ax using (time) join mem on hid = cell_id group by 1, 2) s join ax t using (k)", _INFLOW)),
    "j13_line_cells": (j13_line_cells, sql("select shape_id, cell_id from lc", _LINES)),
    "r13_line_limit": (r13_line_limit, sql("select time, cell_id, round(amp, 4) as value from ll", "lw as (select * from w), " + _limit_sql("radians(45e0)", "(283e0 + cell_id)"))),
    "c13_hydro": (c13_hydro, sql("select plant, t.time, round(v/1e6, 3) as value from (select plant, (k + hrs) % n as k, sum(v*a) as v from br join area using (hid) join ax using (time) join mem using (hid) group by 1, 2) s join ax t using (k)", _HYDRO)),
    "c14_line_rating": (c14_line_rating, sql("select shape_id as line, time, round(min(amp), 4) as value from ll group by 1, 2", _LINES + ", lw as (select w.*, shape_id, ax, ay, bx, by_ from w join lc using (cell_id)), " + _limit_sql(_PSI, "(283e0 + cell_id)"))),
    "c16_area": (c16_area, _area_sql()),
    "g02_raster_codes": (_eligible(codes=range(20)), _eligible_sql("code < 20")),
    "g02_raster_truthy": (_eligible(), _eligible_sql("code <> 0")),
    "g02_raster_callable": (_eligible(codes=lambda c: c % 7 == 3, invert=True), _eligible_sql("not (code % 7 = 3)")),
    "g03_geometry": (g03_geometry, sql("select shape_id, round(count_if(not (px between 550 and 589 and py between 5050 and 5089))/count(*)::double, 6) as share from own group by 1", f"{_PIXELS}, {_SQUARES}, {_OWN}")),
    "g03_buffer": (_buffered(False), _buffered_sql(False)),
    "g03_invert": (_buffered(True), _buffered_sql(True)),
    "g06_reproject": (
        g06_reproject,
        sql("select shape_id, count(*)::bigint as n, sum(px)::bigint as sx, sum(py)::bigint as sy from sqm join xs on (px + 0.5e0)*1000e0 >= mx0 and (px + 0.5e0)*1000e0 < mx1 join ys on (py + 0.5e0)*1000e0 >= my0 and (py + 0.5e0)*1000e0 < my1 where (rx*31 + ry*17) % 100 >= 20 group by 1", _REPROJECTED),
    ),
    "g09_dilation": (_eligible(codes=range(3), buffer=0.015), _eligible_sql(_NEAR)),
    "g09_wide_dilation": (_eligible(codes=[5], buffer=0.085), _eligible_sql(_WIDE)),
    "g11_regrid": (g11_regrid, sql("select cell_id, round(sum(o*code)/sum(o), 6) as value from ov where o > 1e-9 group by 1", _PIXELS + ", " + _OVER)),
    "g11_regrid_nearest": (g11_regrid_nearest, sql("select cell_id, code::int as value from cells left join pix on px = floor((x + 0.003e0)/0.01e0) and py = floor((y + 0.003e0)/0.01e0)", _PIXELS)),
    "g12_availability": (g12_availability, sql("select shape_id, cell_id, round(sum(o)/0.0625e0, 6) as share from ov join own using (px, py) where ov.code >= 20 group by 1, 2 having sum(o) > 1e-9", f"{_PIXELS}, {_SQUARES}, {_OWN}, {_OVER}")),
}
