"""Queries of grids, dataset readers, catalogs, sinks and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.basic import num
from ..operators import geometry
from ..sources import catalog, datasets, readers
from ..sources.cutout import Cutout, grid_cells, time_steps
from ..sources.shared import shared_folder
from .weather import SUN_SQL, cutout, r6, read, sql, weather


def s03_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_cells(spark, (1.5, -4.0), (56.0, 61.0)).select("cell_id", "ix", "iy", "x", "y")


def s04_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_steps(spark, "2013-01-01 00:00:00", "2013-01-02 23:00:00", "3 hours")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reanalysis fields by arithmetic over the weather view."""
    w = weather(spark, sf_dir)
    m = F.col("cell_id")
    return w.select(
        "time", "cell_id", F.col("x").alias("lon"), F.col("y").alias("lat"),
        (F.col("wnd100m") * F.cos("wnd_azimuth")).alias("v100"), (F.col("wnd100m") * F.sin("wnd_azimuth")).alias("u100"), (F.col("wnd100m") * num(0.6)).alias("u10"), (F.col("wnd100m") * num(0.3)).alias("v10"),
        (num(0.05) - num(0.01) * m).alias("fsr"), (F.col("influx_toa") * num(3600 * 0.6)).alias("ssrd"), (F.col("influx_toa") * num(3600 * 0.5)).alias("ssr"), (F.col("influx_toa") * num(3600 * 0.4)).alias("fdir"), (F.col("influx_toa") * num(3600)).alias("tisr"),
        F.col("temperature").alias("t2m"), F.col("soil_temperature").alias("stl4"), F.col("dewpoint_temperature").alias("d2m"), (F.col("runoff") - num(0.2)).alias("ro"), (F.col("height") * num(9.80665) + num(0.1) * F.hour("time")).alias("z"),
    )


def s05a_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = datasets.reanalysis_wind(_raw(spark, sf_dir).select("time", "cell_id", "u10", "v10", "u100", "v100", "fsr"))
    return out.select("time", "cell_id", *(r6(c).alias(c) for c in ("wnd100m", "wnd_shear_exp", "roughness")), F.round(F.cos("wnd_azimuth"), 6).alias("cos_azimuth"))


def s05b_influx(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = datasets.reanalysis_influx(_raw(spark, sf_dir))
    return out.select("time", "cell_id", *(r6(c).alias(c) for c in ("albedo", "influx_toa", "influx_direct", "influx_diffuse", "solar_altitude")))


def s05c_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = datasets.reanalysis_temperature(_raw(spark, sf_dir))
    return out.select("time", "cell_id", *(r6(c).alias(c) for c in ("temperature", "soil_temperature", "dewpoint_temperature")))


def s05d_runoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.reanalysis_runoff(_raw(spark, sf_dir)).select("time", "cell_id", r6("runoff").alias("runoff"))


def s05e_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.reanalysis_height(_raw(spark, sf_dir)).select("cell_id", r6("height").alias("height"))


def s05g_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = weather(spark, sf_dir).select(F.col("time").alias("valid_time"), (F.col("x") + num(1e-7)).alias("longitude"), F.col("y").alias("latitude"), F.lit(1).alias("expver"), F.lit(0).alias("number"), "cell_id")
    return datasets.clean_coordinates(raw).select("time", "cell_id", "x", "y", "lon", "lat")


def s05_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank cutout filled from landed fields by the registered reader."""
    raw = _raw(spark, sf_dir).withColumnsRenamed({"lon": "longitude", "lat": "latitude", "time": "valid_time"}).drop("cell_id").withColumn("longitude", F.col("longitude") + num(1e-7))
    base = cutout(spark, sf_dir)
    blank = Cutout(None, base.cells, {"module": ["era5"], "dx": 0.25, "dy": 0.25, "prepared_features": []})
    ready = readers.prepare(blank, {"era5": {"raw": raw}})
    if not ready.prepared:
        raise AssertionError("variables are missing")
    return ready.weather.join(ready.cells.select("cell_id", "height"), "cell_id").select("time", "cell_id", *(r6(c).alias(c) for c in ("wnd100m", "roughness", "albedo", "influx_toa", "influx_direct", "influx_diffuse", "temperature", "runoff", "height")))


def s07_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of fine pixels, averaged over the cells; shifted so that pixels at the edges of cells count by their share."""
    ids = spark.range(10_000)
    pixels = ids.select((num(4.917) + num(0.011) * (F.col("id") % 100)).alias("lon"), (num(49.913) + num(0.011) * F.floor(F.col("id") / 100)).alias("lat"), (F.col("id") * 7 % 1000).cast("double").alias("height"))
    return readers.terrain(cutout(spark, sf_dir), "height", pixels, 0.011).select("cell_id", F.round("height", 4).alias("height"))


def s05h_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = datasets.request_plan(read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("time")), monthly=True)
    return plan.select("year", "month", F.size("days").alias("days"), F.array_join("hours", ",").alias("hours"))


def s05i_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.area(cutout(spark, sf_dir).cells)


def _half_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hourly rows for each region with gaps by arithmetic."""
    steps = spark.range(480).select(F.col("id").alias("k"), (F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 1800)).alias("time"))
    value = F.when((F.col("k") * 7 + F.col("r_regionkey")) % 5 >= 2, num(10) * (F.col("k") % 48) + F.col("r_regionkey"))
    return read(spark, sf_dir, "region").crossJoin(steps).select(F.col("r_name").alias("cell"), "time", "k", value.alias("v"))


_HALF = "hh as (select r_name as cell, k, make_timestamp((1704067200 + k*1800)*1000000) as time, case when (k*7 + r_regionkey) % 5 >= 2 then 10e0*(k % 48) + r_regionkey end as v from region, range(480) t(k))"


def s06b_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.fill_gaps(_half_hours(spark, sf_dir), "v", ["cell"]).select("cell", "time", r6("v").alias("v"))


def s06c_hourly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = datasets.fill_gaps(_half_hours(spark, sf_dir), "v", ["cell"])
    return datasets.hourly_mean(filled.where("k <> 7"), ["v"], ["cell"]).select("cell", "time", r6("v").alias("v"))


_FILLED = (
    _HALF
    + """, h1 as (select *, max(case when v is not null then k end) over (partition by cell order by k) as ka, min(case when v is not null then k end) over (partition by cell order by k desc) as kb from hh),
filled as (select h1.cell, h1.k, h1.time, case when h1.v is not null then h1.v when ka is null then b.v when kb is null then a.v else a.v + (b.v - a.v)*(h1.k - ka)/(kb - ka) end as v
 from h1 left join hh a on a.cell = h1.cell and a.k = h1.ka left join hh b on b.cell = h1.cell and b.k = h1.kb)"""
)


def s06a_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.range(40).select(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "yyyyMMdd").alias("d"), "id")
    files = days.select(F.explode(F.array(F.concat(F.lit("/a/SISin"), "d", F.lit("0000.nc")), F.when(F.col("id") % 7 != 3, F.concat(F.lit("/a/b/SIDin"), "d", F.lit("0000.nc"))))).alias("path")).where("path is not null")
    return datasets.satellite_files(files, F.lit("2024-01-05").cast("date"), F.lit("2024-01-31").cast("date"))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by line number within an order, as steps of a forecast."""
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("v"))


def s08_deaccumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.deaccumulate(_series(spark, sf_dir), "v", ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", r6("v").alias("v"))


def s08_deaverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.deaverage(_series(spark, sf_dir), "v", ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", r6("v").alias("v"))


def s08_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of forecasts with longitudes from 0 to 360 and fluxes that fall below 0."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select(
        k.alias("run"), (F.timestamp_seconds(F.lit(1704067200) + (k % 100) * 21600)).alias("initial_time"), n.alias("forecast_hours"), (num(2.5) * (k % 144)).alias("lon"), ((k * 7 + n * 13) % 40 - num(10)).alias("v"),
    ).distinct()
    out = datasets.clip_lower(datasets.wrap_longitude(datasets.forecast_time(rows)), "v", 0.5, 0.25)
    return out.select("run", "time", r6("lon").alias("lon"), r6("v").alias("v"))


def s09_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hourly means as three-hourly ones, labelled at the beginning of their intervals."""
    steps = spark.range(60).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 21600).alias("time"), "id")
    rows = read(spark, sf_dir, "region").crossJoin(steps).select(F.col("r_name").alias("cell"), "time", (num(1.5) * F.col("id") + F.col("r_regionkey")).alias("v"))
    return datasets.bin_starts(datasets.halved_bins(rows, "v", ["cell"]), 180).select("cell", "time", r6("v").alias("v"))


def s09_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.backfill(_half_hours(spark, sf_dir), "v", ["cell"], "time").select("cell", "time", r6("v").alias("v"))


_LI = "li as (select l_orderkey, l_linenumber, sum(l_quantity) as v from lineitem group by 1, 2)"


def s10_turbines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.turbine_table(spark).select("name", "hub_height", "P", F.posexplode(F.arrays_zip("V", "POW")).alias("k", "point")).select("name", "hub_height", "P", "k", F.col("point.V").alias("v"), F.col("point.POW").alias("pow"))


def _turbines_sql() -> str:
    rows = ", ".join(f"('{n}', {t['hub_height']!r}::double, {t['P']!r}::double, {k}, {v!r}::double, {p!r}::double)" for n in catalog.WINDTURBINES for t in [catalog.windturbine(n)] for k, (v, p) in enumerate(zip(t["V"], t["POW"], strict=True)))
    return f'select * from (values {rows}) t(name, hub_height, "P", k, v, pow)'


def s14_turbine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a turbine library: names, heights and curves by arithmetic."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    library = p.select(
        k.alias("id"), F.col("p_brand").alias("manufacturer"), F.col("p_type").alias("turbine_type"), (k % 3 != 0).alias("has_power_curve"),
        F.concat(F.lit("[0, "), (k % 10).cast("string"), F.lit(", 25]")).alias("power_curve_wind_speeds"), F.concat(F.lit("[0, "), (k % 1000).cast("string"), F.lit(", 3000]")).alias("power_curve_values"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, (k % 120).cast("string")).otherwise(F.concat((k % 120).cast("string"), F.lit("; "), (k % 90).cast("string"))).alias("hub_height"),
    )
    return catalog.filter_turbine_library(library, manufacturer="brand#1").select("id", "hub_height_m", "P", F.element_at("POW", 2).alias("mid"))


def s15_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("POLYGON (("), k, F.lit(" 0, "), k, F.lit(" 2.5, 30 2.5, 30 0, "), k, F.lit(" 0))"))
    return read(spark, sf_dir, "nation").select("n_name", r6(geometry.ring_area(geometry.ring(geometry.wkt_ring(text)))).alias("area"))


def k01_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cutout written by month and opened again."""
    import uuid

    path = f"{shared_folder(spark)}/cutout-{uuid.uuid4().hex}"
    cutout(spark, sf_dir).save(path)
    found = Cutout.open(spark, path)
    return found.sel(time=("2024-01-01 00:00:00", "2024-01-31 23:59:59")).weather.select("time", "cell_id", r6("temperature").alias("temperature"))


def k02_prepare_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features written, the others added to the same folder by a second run, which does not read the first ones again."""
    import uuid

    base = cutout(spark, sf_dir)

    def reader(offset: float):
        return {"era5": lambda c, f: base.weather.withColumn("runoff", F.col("runoff") + num(offset)).withColumn("wnd100m", F.col("wnd100m") + num(offset)) if f != "height" else base.weather.groupBy("cell_id").agg(F.max("height").alias("height"))}

    blank = Cutout(None, base.cells, {"module": ["era5"], "dx": 0.25, "dy": 0.25}, path=f"{shared_folder(spark)}/cutout-{uuid.uuid4().hex}")
    blank.prepare(reader(0.0), features=["height", "wind"])
    ready = Cutout.open(spark, blank.path).prepare(reader(1.0))
    return ready.weather.select("time", "cell_id", *(r6(c).alias(c) for c in ("wnd100m", "temperature", "runoff")))


def k03_merge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of two modules prepared into one cutout; the first module's direct irradiation stays."""
    base = cutout(spark, sf_dir)
    blank = Cutout(None, base.cells, {"module": ["era5", "sarah"], "prepared_features": []})

    def satellite(c: Cutout, feature: str) -> DataFrame:
        return base.weather.withColumn("influx_direct", num(-1))

    ready = blank.prepare({"era5": lambda c, f: base.weather if f != "height" else base.weather.groupBy("cell_id").agg(F.max("height").alias("height")), "sarah": satellite})
    if not ready.prepared:
        raise AssertionError("variables are missing")
    return ready.weather.select("time", "cell_id", r6("influx_direct").alias("influx_direct"), r6("runoff").alias("runoff"))


def p01_sel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cutout(spark, sf_dir).sel(bounds=(5.25, 50.0, 5.5, 50.25), buffer=0.01, time=("2024-01-03 00:00:00", "2024-01-10 12:00:00"))
    return c.weather.select("time", "cell_id", r6("wnd100m").alias("wnd100m"))


def p02_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutout(spark, sf_dir).nearest(5.37, 50.4)


def p03_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weather(spark, sf_dir)
    cells = cutout(spark, sf_dir).cells
    a = Cutout(w.where("cell_id < 8").select("time", "cell_id", "wnd100m"), cells, {"module": ["era5"], "prepared_features": []})
    b = Cutout(w.where("cell_id > 4").select("time", "cell_id", (F.col("wnd100m") + 100).alias("wnd100m"), "runoff"), cells, {"module": ["sarah"], "prepared_features": []})
    return a.merge(b).weather.select("time", "cell_id", r6("wnd100m").alias("wnd100m"), r6("runoff").alias("runoff"))


def p04_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = cutout(spark, sf_dir), cutout(spark, sf_dir)
    other = Cutout(b.weather.where("cell_id <> 3"), b.cells, {})
    return spark.createDataFrame([(a.equals(b), a.equals(other))], "same boolean, other boolean")


def p05_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Cutout(None, grid_cells(spark, (-4.0, 1.5), (56.0, 61.0)), {}).summary
    return spark.createDataFrame([(s["shape"][0], s["shape"][1], s["dx"], s["dy"], *s["extent"])], "ny int, nx int, dx double, dy double, x0 double, x1 double, y0 double, y1 double")


def p06_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutout(spark, sf_dir).grid().select("cell_id", "x0", "x1", "y0", "y1")


_ONCE = "(select min(time) as time, cell_id, any_value(height) as height from w group by cell_id)"

QUERIES: dict[str, tuple] = {
    "s03_grid": (s03_grid, "select iy*23 + ix as cell_id, ix::int as ix, iy::int as iy, -4e0 + 0.25e0*ix as x, 56e0 + 0.25e0*iy as y from range(23) a(ix), range(21) b(iy)"),
    "s04_times": (s04_times, "select unnest(generate_series(timestamp '2013-01-01 00:00:00', timestamp '2013-01-02 23:00:00', interval 3 hour)) as time"),
    "s05a_wind": (s05a_wind, sql("select time, cell_id, round(wnd100m, 6) as wnd100m, round(ln(sqrt(0.45e0)*wnd100m/nullif(wnd100m, 0))/ln(0.1e0), 6) as wnd_shear_exp, round(case when 0.05e0 - 0.01e0*cell_id >= 0 then 0.05e0 - 0.01e0*cell_id else 2e-4 end, 6) as roughness, round(case when wnd100m = 0 then 1e0 else cos(wnd_azimuth) end, 6) as cos_azimuth from w")),
    "s05_prepare": (
        s05_prepare,
        sql(
            f"""select time, w.cell_id, round(wnd100m, 6) as wnd100m, round(case when 0.05e0 - 0.01e0*w.cell_id >= 0 then 0.05e0 - 0.01e0*w.cell_id else 2e-4 end, 6) as roughness,
 round(coalesce((0.6e0*influx_toa - 0.5e0*influx_toa)/nullif(0.6e0*influx_toa, 0), 0), 6) as albedo, round(influx_toa, 6) as influx_toa, round(0.4e0*influx_toa, 6) as influx_direct, round(0.6e0*influx_toa - 0.4e0*influx_toa, 6) as influx_diffuse,
 round(temperature, 6) as temperature, round(greatest(runoff - 0.2e0, 0), 6) as runoff, round(z.height, 6) as height from w join (select cell_id, height + 0.1e0*hour(time)/9.80665e0 as height from {_ONCE}) z on z.cell_id = w.cell_id"""
        ),
    ),
    "s07_terrain": (
        s07_terrain,
        sql(
            "select cell_id, round(sum(o*h)/sum(o), 4) as height from ov where o > 1e-12 group by 1",
            """fine as (select 4.917e0 + 0.011e0*(i % 100) as lon, 49.913e0 + 0.011e0*(i // 100) as lat, (i*7 % 1000)::double as h from range(10000) t(i)),
ov as (select cell_id, h, greatest(0e0, least(lon + 0.0055e0, x + 0.125e0) - greatest(lon - 0.0055e0, x - 0.125e0))*greatest(0e0, least(lat + 0.0055e0, y + 0.125e0) - greatest(lat - 0.0055e0, y - 0.125e0)) as o from fine, cells)""",
        ),
    ),
    "s05b_influx": (
        s05b_influx,
        sql(
            "select s.time, s.cell_id, round(coalesce((0.6e0*t.influx_toa - 0.5e0*t.influx_toa)/nullif(0.6e0*t.influx_toa, 0), 0), 6) as albedo, round(t.influx_toa, 6) as influx_toa, round(0.4e0*t.influx_toa, 6) as influx_direct, round(0.6e0*t.influx_toa - 0.4e0*t.influx_toa, 6) as influx_diffuse, round(s.alt, 6) as solar_altitude from sh s join w t on t.time = s.time and t.cell_id = s.cell_id",
            "hx as (select time, time - interval 30 minute as t_half, cell_id, x, y from w)," + SUN_SQL.format(name="sh", src="hx", time="t_half"),
        ),
    ),
    "s05c_temperature": (s05c_temperature, sql("select time, cell_id, round(temperature, 6) as temperature, round(soil_temperature, 6) as soil_temperature, round(dewpoint_temperature, 6) as dewpoint_temperature from w")),
    "s05d_runoff": (s05d_runoff, sql("select time, cell_id, round(greatest(runoff - 0.2e0, 0), 6) as runoff from w")),
    "s05e_height": (s05e_height, sql(f"select cell_id, round(height + 0.1e0*hour(time)/9.80665e0, 6) as height from {_ONCE}")),
    "s05g_coordinates": (s05g_coordinates, sql("select time, cell_id, x, y, x as lon, y as lat from w")),
    "s05h_requests": (s05h_requests, "select year(l_shipdate)::int as year, month(l_shipdate)::int as month, count(distinct day(l_shipdate))::int as days, string_agg(distinct strftime(l_shipdate, '%H:%M'), ',' order by strftime(l_shipdate, '%H:%M')) as hours from lineitem group by 1, 2"),
    "s05i_area": (s05i_area, sql("select max(y) as north, min(x) as west, min(y) as south, max(x) as east from cells")),
    "s06a_files": (s06a_files, "select d::date as day, '/a/SISin' || strftime(d, '%Y%m%d') || '0000.nc' as sis, '/a/b/SIDin' || strftime(d, '%Y%m%d') || '0000.nc' as sid from (select i, date '2024-01-01' + i::int as d from range(40) t(i)) where i % 7 <> 3 and d between date '2024-01-05' and date '2024-01-31'"),
    "s06b_interpolate": (s06b_interpolate, sql("select cell, time, round(v, 6) as v from filled", _FILLED)),
    "s06c_hourly_mean": (s06c_hourly_mean, sql("select cell, date_trunc('hour', time) as time, round(avg(v), 6) as v from filled where k <> 7 group by 1, 2 having count(*) = 2", _FILLED)),
    "s08_deaccumulate": (s08_deaccumulate, sql("select l_orderkey, l_linenumber, round(v - coalesce(lag(v) over (partition by l_orderkey order by l_linenumber), 0), 6) as v from li", _LI)),
    "s08_deaverage": (s08_deaverage, sql("select l_orderkey, l_linenumber, round(row_number() over q * v - (row_number() over q - 1)*coalesce(lag(v) over q, 0), 6) as v from li window q as (partition by l_orderkey order by l_linenumber)", _LI)),
    "s09_backfill": (s09_backfill, sql("select h.cell, h.time, round(b.v, 6) as v from (select *, min(case when v is not null then k end) over (partition by cell order by k desc) as kb from hh) h left join hh b on b.cell = h.cell and b.k = h.kb", _HALF)),
    "s08_forecasts": (
        s08_forecasts,
        """select distinct l_orderkey as run, make_timestamp((1704067200 + (l_orderkey % 100)*21600 + l_linenumber*3600)*1000000::bigint) as time,
 round(case when 2.5e0*(l_orderkey % 144) > 180 then 2.5e0*(l_orderkey % 144) - 360e0 else 2.5e0*(l_orderkey % 144) end, 6) as lon,
 round(case when (l_orderkey*7 + l_linenumber*13) % 40 - 10e0 > 0.5e0 then (l_orderkey*7 + l_linenumber*13) % 40 - 10e0 else 0.25e0 end, 6) as v from lineitem""",
    ),
    "s09_bins": (
        s09_bins,
        """select r_name as cell, make_timestamp((1704067200 + k*21600 - late*10800 - 10800)*1000000) as time, round(1.5e0*k + r_regionkey, 6) as v from region, range(60) t(k), range(2) u(late)""",
    ),
    "s10_turbines": (s10_turbines, _turbines_sql()),
    "s14_turbine_search": (
        s14_turbine_search,
        "select p_partkey as id, case when k % 4 = 0 then 100e0 when k % 4 = 1 then (k % 120)::double else floor(((k % 120) + (k % 90))/2e0) end as hub_height_m, 3e0 as \"P\", (k % 1000)/1000e0 as mid from (select *, p_partkey as k from part) where k % 3 <> 0 and lower(p_brand) like '%brand#1%'",
    ),
    "s15_wkt": (s15_wkt, "select n_name, round(2.5e0*(30 - n_nationkey), 6) as area from nation"),
    "k01_round_trip": (k01_round_trip, sql("select time, cell_id, round(temperature, 6) as temperature from w")),
    "k02_prepare_twice": (k02_prepare_twice, sql("select time, cell_id, round(wnd100m, 6) as wnd100m, round(temperature, 6) as temperature, round(runoff + 1e0, 6) as runoff from w")),
    "k03_merge_features": (k03_merge_features, sql("select time, cell_id, round(influx_direct, 6) as influx_direct, round(runoff, 6) as runoff from w")),
    "k04_available_features": (lambda s, d: datasets.available_features(s).groupBy("module", "feature").agg(F.count("*").alias("n")), "select * from (values ('era5', 'height', 1), ('era5', 'wind', 4), ('era5', 'influx', 6), ('era5', 'temperature', 3), ('era5', 'runoff', 1), ('sarah', 'influx', 4), ('gebco', 'height', 1)) t(module, feature, n)"),
    "p01_sel": (p01_sel, sql("select time, cell_id, round(wnd100m, 6) as wnd100m from w where x between 5.24e0 and 5.51e0 and y between 49.99e0 and 50.26e0 and time between timestamp '2024-01-03 00:00:00' and timestamp '2024-01-10 12:00:00'")),
    "p02_nearest": (p02_nearest, sql("select arg_min(cell_id, abs(x - 5.37e0) + abs(y - 50.4e0)) as cell_id from cells")),
    "p03_merge": (p03_merge, sql("select time, cell_id, round(case when cell_id < 8 then wnd100m else wnd100m + 100 end, 6) as wnd100m, case when cell_id > 4 then round(runoff, 6) end as runoff from w")),
    "p04_equals": (p04_equals, "select true as same, false as other"),
    "p05_properties": (p05_properties, "select 21 as ny, 23 as nx, 0.25e0 as dx, 0.25e0 as dy, -4.125e0 as x0, 1.625e0 as x1, 55.875e0 as y0, 61.125e0 as y1"),
    "p06_grid": (p06_grid, sql("select cell_id, x - 0.125e0 as x0, x + 0.125e0 as x1, y - 0.125e0 as y0, y + 0.125e0 as y1 from cells")),
}
