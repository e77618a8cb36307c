"""Queries of grids, axes, areas, rasters, files and catalogs that come from rows of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.basic import num
from ..operators import geometry, raster
from ..sources import archives, catalog, datasets, readers  # noqa: F401  (archives registers its modules)
from ..sources.archive_source import register
from ..sources.cutout import Cutout, grid_cells, time_steps
from ..sources.shared import shared_folder
from .overlays import _area_sql, _reproject_sql
from .weather import r6, read, sql, weather


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points, by arithmetic of their keys."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("site"), (num(4.7) + num(0.0137) * (k % 97)).alias("x"), (num(49.8) + num(0.0119) * (k % 89)).alias("y"))


_SITES = "sites as (select s_suppkey as site, 4.7e0 + 0.0137e0*(s_suppkey % 97) as x, 49.8e0 + 0.0119e0*(s_suppkey % 89) as y from supplier)"


def _row_cells(w: DataFrame) -> DataFrame:
    """The cells that weather rows stand in."""
    cells = w.groupBy("cell_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    at = lambda c, low: F.round((F.col(c) - num(low)) / num(0.25)).cast("int")
    return cells.withColumns({"ix": at("x", 5), "iy": at("y", 50), "lon": F.col("x"), "lat": F.col("y")})


def _row_cutout(spark: SparkSession, sf_dir: str) -> Cutout:
    w = weather(spark, sf_dir)
    return Cutout(w, _row_cells(w), {"module": ["era5"], "dx": 0.25, "dy": 0.25})


def s03_grid_of_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The global lattice within the bounds of all suppliers, and how many of them are nearest to each cell."""
    sites = _sites(spark, sf_dir)
    x0, x1, y0, y1 = sites.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    cells = grid_cells(spark, (x1, x0), (y0, y1))
    at = lambda c: F.floor(F.col(c) / num(0.25) + num(0.5))
    counts = sites.groupBy(at("x").alias("i"), at("y").alias("j")).agg(F.count("*").alias("n"))
    met = cells.join(counts, (F.round(F.col("x") / num(0.25)) == F.col("i")) & (F.round(F.col("y") / num(0.25)) == F.col("j")), "left")
    return met.select("cell_id", "ix", "iy", r6("x").alias("x"), r6("y").alias("y"), F.coalesce("n", F.lit(0)).alias("n"))


_GRID = f"""{_SITES}, ends as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from sites),
xs as (select i*0.25e0 as x, (row_number() over (order by i) - 1)::int as ix, count(*) over () as nx from range(-720, 720) t(i), ends where i*0.25e0 between x0 and x1),
ys as (select j*0.25e0 as y, (row_number() over (order by j) - 1)::int as iy from range(-360, 360) t(j), ends where j*0.25e0 between y0 and y1)
select iy*nx + ix as cell_id, ix, iy, round(x, 6) as x, round(y, 6) as y, (select count(*) from sites s where floor(s.x/0.25e0 + 0.5e0) = round(xs.x/0.25e0) and floor(s.y/0.25e0 + 0.5e0) = round(ys.y/0.25e0)) as n from xs, ys"""


def s04_axis_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third hour between the first and the last event, with the events of these three hours."""
    events = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    a, b = events.agg(F.date_format(F.date_trunc("day", F.min("ts")), "yyyy-MM-dd HH:mm:ss"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss")).first()
    part = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 10800) * 10800)
    counts = events.groupBy(part.alias("time")).agg(F.count("*").alias("n"))
    return time_steps(spark, a, b, "3 hours").join(counts, "time", "left").select("time", F.coalesce("n", F.lit(0)).alias("n"))


_AXIS = """select time, (select count(*) from events where epoch_us(ts)//10800000000 = epoch_us(time)//10800000000) as n
from (select unnest(generate_series(date_trunc('day', a)::timestamp, b::timestamp, interval 3 hour)) as time from (select min(ts) as a, max(ts) as b from events))"""


def s05i_area_of_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box that a request for all cells with a supplier names."""
    snap = lambda c: F.round(F.floor(F.col(c) / num(0.25) + num(0.5)) * num(0.25), 9).alias(c)
    return datasets.area(_sites(spark, sf_dir).select(snap("x"), snap("y")).distinct())


def s05_archive_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a landed archive by month, of which the data source reads half a year of a box."""
    landed = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("time"), (F.col("l_partkey") % 20).cast("double").alias("x"), (F.col("l_suppkey") % 10).cast("double").alias("y"), F.col("l_quantity").cast("double").alias("v"))
    path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    month = F.date_format("time", "yyyy-MM")
    landed.withColumn("month", month).repartition(month).write.partitionBy("month").parquet(path)
    register(spark)
    found = spark.read.format("voltmesh_archive").option("path", path).load().where("time between '1995-03-15' and '1995-09-10' and x between 3 and 11 and y <= 6")
    return found.groupBy("time").agg(F.count("*").alias("n"), r6(F.sum("v")).alias("v"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of one kind for each day with events, and of the other for most of them."""
    days = read(spark, sf_dir, "events").select(F.to_date("ts").alias("d")).distinct().select(F.date_format("d", "yyyyMMdd").alias("d"), F.dayofmonth("d").alias("k"))
    both = F.array(F.concat(F.lit("/a/SISin"), "d", F.lit("0000.nc")), F.when(F.col("k") % 7 != 3, F.concat(F.lit("/a/b/SIDin"), "d", F.lit("0000.nc"))))
    return days.select(F.explode(both).alias("path")).where("path is not null")


def s06a_event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.satellite_files(_paths(spark, sf_dir), F.lit("2024-01-05").cast("date"), F.lit("2024-01-31").cast("date"))


def s06a_uncovered_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the range for which a file of either kind is missing."""
    first, last = F.lit("2024-01-05").cast("date"), F.lit("2024-01-31").cast("date")
    return datasets.uncovered_days(datasets.satellite_files(_paths(spark, sf_dir), first, last), first, last)


_DAYS = "fd as (select distinct ts::date as d from events), cov as (select d from fd where day(d) % 7 <> 3 and d between date '2024-01-05' and date '2024-01-31')"


def s07_terrain_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pixels of terrain, averaged over the cells."""
    p = F.col("p_partkey")
    pixels = read(spark, sf_dir, "part").select((num(4.917) + num(0.011) * (p % 100)).alias("lon"), (num(49.913) + num(0.011) * (F.floor(p / 100) % 100)).alias("lat"), (p * 7 % 1000).cast("double").alias("height"))
    return readers.terrain(_row_cutout(spark, sf_dir), "height", pixels, 0.011).select("cell_id", F.round("height", 4).alias("height"))


_TERRAIN = """fine as (select 4.917e0 + 0.011e0*(p_partkey % 100) as lon, 49.913e0 + 0.011e0*((p_partkey // 100) % 100) as lat, (p_partkey*7 % 1000)::double as h from part),
ov as (select cell_id, h, greatest(0e0, least(lon + 0.0055e0, x + 0.125e0) - greatest(lon - 0.0055e0, x - 0.125e0))*greatest(0e0, least(lat + 0.0055e0, y + 0.125e0) - greatest(lat - 0.0055e0, y - 0.125e0)) as o from fine, cells)"""


def s08_forecast_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather rows as forecasts of six hours that keep running means and sums, read back into a cutout."""
    w = weather(spark, sf_dir)
    begin = F.timestamp_seconds(F.floor(F.unix_timestamp("time") / 21600) * 21600)
    rows = w.select(begin.alias("initial_time"), ((F.unix_timestamp("time") % 21600) / 3600 + 1).cast("int").alias("forecast_hours"), (F.col("x") + num(360)).alias("lon"), F.col("y").alias("lat"), "influx_toa", "runoff", "temperature", "wnd100m", "wnd_azimuth", "height")
    run = Window.partitionBy("lon", "lat", "initial_time").orderBy("forecast_hours").rowsBetween(Window.unboundedPreceding, 0)
    fields = {
        "DSWRF_P8_L1_GGA0": F.avg("influx_toa").over(run), "USWRF_P8_L1_GGA0": F.avg(F.col("influx_toa") / num(10)).over(run), "WATR_P8_L1_GGA0": F.sum("runoff").over(run), "TMP_P0_L103_GGA0": F.col("temperature"), "TMP_P0_2L106_GGA0": F.col("temperature"),
        "UGRD_P0_L103_GGA0": F.col("wnd100m") * F.sin("wnd_azimuth"), "VGRD_P0_L103_GGA0": F.col("wnd100m") * F.cos("wnd_azimuth"), "SFCR_P8_L1_GGA0": num(0.1), "HGT_P0_L105_GGA0": F.col("height"),
    }
    base = _row_cutout(spark, sf_dir)
    ready = readers.prepare(Cutout(None, base.cells, {"module": ["ncep"], "dx": 0.25, "dy": 0.25}), {"ncep": {"raw": rows.withColumns(fields)}})
    if not ready.prepared:
        raise AssertionError("variables are missing")
    out = ready.weather.join(ready.cells.select("cell_id", "height"), "cell_id")
    return out.select("time", "cell_id", *(F.round(c, 4).alias(c) for c in ("influx", "outflux", "temperature", "wnd10m", "runoff", "height")))


def s09_regional_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather rows as fields of a regional model: means of three hours about their middle, and of six hours."""
    w = weather(spark, sf_dir).withColumnsRenamed({"x": "rlon", "y": "rlat"})
    base = _row_cutout(spark, sf_dir)
    flux = w.select((F.col("time") + F.expr("interval 90 minutes")).alias("time"), "rlon", "rlat", F.col("influx_toa").alias("rsds"))
    runoff = w.where(F.hour("time") % 6 == 0).select("time", "rlon", "rlat", F.col("runoff").alias("mrro"))
    known = [readers.get_data(base, "cordex", f, raw=raw) for f, raw in (("influx", flux), ("runoff", runoff), ("temperature", w.withColumnRenamed("temperature", "tas")))]
    out = known[0]
    for k in known[1:]:
        out = out.join(k, ["time", "cell_id"], "full")
    return out.select("time", "cell_id", r6("influx").alias("influx"), r6("runoff").alias("runoff"), r6("temperature").alias("temperature"))


def s10_turbines_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier builds one kind of turbine: how many, their capacity and the mean height of a hub."""
    names = sorted(catalog.WINDTURBINES)
    built = read(spark, sf_dir, "supplier").select(F.element_at(F.array(*map(F.lit, names)), (F.col("s_suppkey") % len(names) + 1).cast("int")).alias("name"), (F.col("s_suppkey") % 5 + 1).alias("m"))
    known = catalog.turbine_table(spark).select("name", "P", "hub_height", F.array_max("POW").alias("top"))
    return built.join(known, "name").groupBy("name").agg(F.sum("m").alias("n"), r6(F.sum(F.col("m") * F.col("P"))).alias("capacity"), r6(F.avg("hub_height")).alias("hub_height"), r6(F.max("top")).alias("top"))


def _built_sql() -> str:
    names = sorted(catalog.WINDTURBINES)
    known = [(n, catalog.windturbine(n)) for n in names]
    rows = ", ".join(f"({k}, '{n}', {float(t['P'])!r}::double, {float(t['hub_height'])!r}::double, {float(max(t['POW']))!r}::double)" for k, (n, t) in enumerate(known))
    return f"select name, sum(s_suppkey % 5 + 1)::bigint as n, round(sum((s_suppkey % 5 + 1)*p), 6) as capacity, round(avg(h), 6) as hub_height, round(max(top), 6) as top from supplier join (values {rows}) t(k, name, p, h, top) on k = s_suppkey % {len(names)} group by name"


def _variables() -> list[str]:
    return sorted({v for m in datasets.MODULES.values() if not m.deprecated for vs in m.features.values() for v in vs})


def k04_features_of_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests for a variable: by module and feature how many there are."""
    known = datasets.available_features(spark)
    names = _variables()
    asked = read(spark, sf_dir, "orders").select(F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names) + 1).cast("int")).alias("variable"))
    return asked.join(known, "variable").groupBy("module", "feature").agg(F.count("*").alias("n"))


def _requests_sql() -> str:
    names = _variables()
    rows = ", ".join(f"('{m}', '{f}', {names.index(v)})" for m, d in datasets.MODULES.items() if not d.deprecated for f, vs in d.features.items() for v in vs)
    return f"select module, feature, count(*) as n from orders join (values {rows}) t(module, feature, k) on k = o_orderkey % {len(names)} group by all"


def p02_nearest_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among the cells that events stand in."""
    return _row_cutout(spark, sf_dir).nearest(5.37, 50.4)


def p05_properties_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of the cells that events stand in, and the time step, beside the rows of each cell."""
    c = _row_cutout(spark, sf_dir)
    s = c.summary
    known = {"ny": s["shape"][0], "nx": s["shape"][1], "dx": s["dx"], "dy": s["dy"], "x0": s["extent"][0], "y1": s["extent"][3], "a": c.transform[0], "f": c.transform_r[5], "step": c.dt}
    return c.weather.groupBy("cell_id").agg(F.count("*").alias("n")).select("cell_id", "n", *(F.lit(v).alias(k) for k, v in known.items()))


_PROPERTIES = """ce as (select min(x) as xa, max(x) as xb, min(y) as ya, max(y) as yb, count(distinct x)::int as nx, count(distinct y)::int as ny from w),
tt as (select list_sort(list(distinct time)) as t from w), st as (select epoch_us(t[2]) - epoch_us(t[1]) as us from tt)"""


def p06_grid_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_cutout(spark, sf_dir).grid().select("cell_id", r6("x0").alias("x0"), r6("x1").alias("x1"), r6("y0").alias("y0"), r6("y1").alias("y1"))


def p07_uniform_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind over a layout of one unit a cell."""
    c = _row_cutout(spark, sf_dir)
    return c.weather.join(c.uniform_layout(), "cell_id").groupBy("time").agg(r6(F.sum(F.col("wnd100m") * F.col("capacity"))).alias("v"))


def j06_reproject_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in both equal-area projections and back, in kilometres and degrees."""
    s = _sites(spark, sf_dir)
    out = {}
    for name, crs in (("cea", "cea"), ("laea", 3035)):
        x, y = geometry.project(F.col("x"), F.col("y"), crs)
        out |= {f"{name}_x": F.round(x / num(1000), 4), f"{name}_y": F.round(y / num(1000), 4), f"{name}_lon": r6(geometry.unproject(x, y, crs)[0])}
    return s.select(F.col("site").alias("cell_id"), *(v.alias(k) for k, v in out.items()))


def c16_area_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _row_cutout(spark, sf_dir).grid()
    dense = geometry.density_layout(grid, 3.0, "cea").withColumnRenamed("capacity", "dense")
    return geometry.cell_area(grid).join(dense, "cell_id").select("cell_id", r6("area").alias("area"), F.round(F.col("dense") / num(1e6), 4).alias("dense"))


def _part_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pixels of 0.01 degrees, the largest code of those on one pixel."""
    p = F.col("p_partkey")
    pixels = read(spark, sf_dir, "part").select((F.lit(500) + p % 100).cast("int").alias("px"), (F.lit(5000) + F.floor(p / 100) % 100).cast("int").alias("py"), (p * 31 % 101).cast("int").alias("code"))
    return pixels.groupBy("px", "py").agg(F.max("code").alias("code"))


_PIX = "pix as (select (500 + p_partkey % 100)::int as px, (5000 + (p_partkey // 100) % 100)::int as py, max(p_partkey*31 % 101)::int as code from part group by 1, 2)"
_MET = """ov as (select cell_id, pix.px, pix.py, code, greatest(0, least((px + 1)*0.01e0, x + 0.125e0) - greatest(px*0.01e0, x - 0.125e0))*greatest(0, least((py + 1)*0.01e0, y + 0.125e0) - greatest(py*0.01e0, y - 0.125e0)) as o from pix, cells)"""


def _regridded(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A raster of parts on the grid of the cells."""
        grid = _row_cutout(spark, sf_dir).grid()
        if how in ("nearest", "bilinear"):  # off the edges between pixels
            grid = grid.withColumns({c: F.col(c) + num(0.0037) for c in ("x0", "x1", "y0", "y1")})
        return raster.regrid(_part_pixels(spark, sf_dir), grid, 0.01, how).select("cell_id", r6(F.col("value").cast("double")).alias("value"))

    return run


def _regrid_sql(value: str) -> str:
    return sql(f"select cell_id, round(({value})::double, 6) as value from ov where o > 1e-9 group by 1", f"{_PIX}, {_MET}")


_BILINEAR = f"""{_PIX}, uv as (select cell_id, (x + 0.0037e0)/0.01e0 - 0.5e0 as u, (y + 0.0037e0)/0.01e0 - 0.5e0 as v from cells),
nb as (select cell_id, floor(u)::int + i as px, floor(v)::int + j as py, (case when i = 1 then u - floor(u) else 1e0 - (u - floor(u)) end)*(case when j = 1 then v - floor(v) else 1e0 - (v - floor(v)) end) as wt from uv, range(2) a(i), range(2) b(j))"""

QUERIES: dict[str, tuple] = {
    "s03_grid_of_sites": (s03_grid_of_sites, f"with {_GRID}"),
    "s04_axis_of_events": (s04_axis_of_events, _AXIS),
    "s05i_area_of_sites": (s05i_area_of_sites, f"with {_SITES} select max(round(floor(y/0.25e0 + 0.5e0)*0.25e0, 9)) as north, min(round(floor(x/0.25e0 + 0.5e0)*0.25e0, 9)) as west, min(round(floor(y/0.25e0 + 0.5e0)*0.25e0, 9)) as south, max(round(floor(x/0.25e0 + 0.5e0)*0.25e0, 9)) as east from sites"),
    "s05_archive_source": (s05_archive_source, "select l_shipdate::timestamp as time, count(*) as n, round(sum(l_quantity::double), 6) as v from lineitem where l_shipdate between date '1995-03-15' and date '1995-09-10' and l_partkey % 20 between 3 and 11 and l_suppkey % 10 <= 6 group by 1"),
    "s06a_event_days": (s06a_event_days, f"with {_DAYS} select d as day, '/a/SISin' || strftime(d, '%Y%m%d') || '0000.nc' as sis, '/a/b/SIDin' || strftime(d, '%Y%m%d') || '0000.nc' as sid from cov"),
    "s06a_uncovered_days": (s06a_uncovered_days, f"with {_DAYS} select d::date as day from generate_series(date '2024-01-05', date '2024-01-31', interval 1 day) t(d) where d::date not in (select d from cov)"),
    "s07_terrain_of_parts": (s07_terrain_of_parts, sql("select cell_id, round(sum(o*h)/sum(o), 4) as height from ov where o > 1e-12 group by 1", _TERRAIN)),
    "s08_forecast_archive": (
        s08_forecast_archive,
        sql("select time, cell_id, round(case when influx_toa > 0.1e0 then influx_toa else 0e0 end, 4) as influx, round(case when influx_toa/10e0 > 3e0 then influx_toa/10e0 else 0e0 end, 4) as outflux, round(temperature, 4) as temperature, round(wnd100m, 4) as wnd10m, round(runoff, 4) as runoff, round(height, 4) as height from w"),
    ),
    "s09_regional_archive": (
        s09_regional_archive,
        sql(
            "select coalesce(a.time, b.time) as time, coalesce(a.cell_id, b.cell_id) as cell_id, round(influx_toa, 6) as influx, round(b.runoff, 6) as runoff, round(temperature, 6) as temperature from w a full join half b on a.time = b.time and a.cell_id = b.cell_id",
            "half as (select time, cell_id, runoff from w where hour(time) % 6 = 0 union all select time - interval 3 hour, cell_id, runoff from w where hour(time) % 6 = 0)",
        ),
    ),
    "s10_turbines_of_suppliers": (s10_turbines_of_suppliers, _built_sql()),
    "k04_features_of_requests": (k04_features_of_requests, _requests_sql()),
    "p02_nearest_of_rows": (p02_nearest_of_rows, sql("select arg_min(cell_id, abs(x - 5.37e0) + abs(y - 50.4e0)) as cell_id from (select distinct cell_id, x, y from w)")),
    "p05_properties_of_rows": (
        p05_properties_of_rows,
        sql(
            "select cell_id, count(*) as n, any_value(ny) as ny, any_value(nx) as nx, 0.25e0 as dx, 0.25e0 as dy, any_value(xa) - 0.125e0 as x0, any_value(yb) + 0.125e0 as y1, 0.25e0 as a, any_value(yb) + 0.125e0 as f,"
            " 'INTERVAL ' || chr(39) || (any_value(us)//86400000000)::varchar || ' ' || strftime(make_timestamp((any_value(us) % 86400000000)::bigint), '%H:%M:%S') || chr(39) || ' DAY TO SECOND' as step from w, ce, st group by 1",
            _PROPERTIES,
        ),
    ),
    "p06_grid_of_rows": (p06_grid_of_rows, sql("select distinct cell_id, round(x - 0.125e0, 6) as x0, round(x + 0.125e0, 6) as x1, round(y - 0.125e0, 6) as y0, round(y + 0.125e0, 6) as y1 from w")),
    "p07_uniform_layout": (p07_uniform_layout, sql("select time, round(sum(wnd100m), 6) as v from w group by 1")),
    "j06_reproject_sites": (j06_reproject_sites, _reproject_sql().replace("select cell_id, ", "select cell_id, round(x, 6) as cea_lon, round(x, 6) as laea_lon, ", 1).replace("as lam from cells)", "as lam from (select site as cell_id, x, y from sites))", 1).replace("pq as (", f"{_SITES}, pq as (", 1)),
    "c16_area_of_rows": (c16_area_of_rows, _area_sql().replace("as dense from cells", "as dense from (select distinct cell_id, x, y from w)")),
    "g11_average_of_parts": (_regridded("average"), _regrid_sql("sum(o*code)/sum(o)")),
    "g11_sum_of_parts": (_regridded("sum"), _regrid_sql("sum(o*code)/(0.01e0*0.01e0)")),
    "g11_min_of_parts": (_regridded("min"), _regrid_sql("min(code)")),
    "g11_max_of_parts": (_regridded("max"), _regrid_sql("max(code)")),
    "g11_mode_of_parts": (_regridded("mode"), sql("select cell_id, round(code::double, 6) as value from (select *, row_number() over (partition by cell_id order by o desc, code) as rank from (select cell_id, code, round(sum(o), 12) as o from ov where o > 1e-9 group by 1, 2)) where rank = 1", f"{_PIX}, {_MET}")),
    "g11_nearest_of_parts": (_regridded("nearest"), sql("select cell_id, code::double as value from cells left join pix on px = floor((x + 0.0037e0)/0.01e0) and py = floor((y + 0.0037e0)/0.01e0)", _PIX)),
    "g11_bilinear_of_parts": (_regridded("bilinear"), sql("select cell_id, round(sum(wt*code)/sum(case when code is not null then wt end), 6) as value from nb left join pix using (px, py) where wt > 0 group by 1", _BILINEAR)),
}
