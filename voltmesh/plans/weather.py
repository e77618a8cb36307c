"""A deterministic weather view over ``events`` (12 cells, hourly) and weights over ``supplier``, for both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.basic import PI, num
from ..functions.solar import sun_position
from ..sources.cutout import Cutout


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    rows = events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("time"), (F.col("user_id") % 12).alias("cell_id")).agg(F.min("event_id").alias("e"), F.avg("value").alias("a"))
    m, a = F.col("cell_id"), F.col("a")
    rows = rows.withColumns({"x": num(5) + num(0.25) * (m % 4), "y": num(50) + num(0.25) * F.floor(m / 4), "height": num(50) * m})
    sun = sun_position(F.col("time"), F.col("x"), F.col("y"))
    rows = rows.withColumns({"solar_altitude": sun.altitude, "solar_azimuth": sun.azimuth})
    rows = rows.withColumn("influx_toa", F.greatest(num(0), num(1361) * F.sin("solar_altitude")))
    return rows.withColumns(
        {
            "wnd100m": ((F.col("e") * 7919) % 2800) / num(100),
            "wnd_shear_exp": num(0.1) + num(0.01) * m,
            "wnd_azimuth": num(2 * PI) * (F.col("e") % 360) / num(360),
            "roughness": num(0.03) + num(0.01) * m,
            "albedo": num(0.1) + num(0.02) * (m % 5),
            "temperature": num(263.15) + a / num(12.345678),
            "soil_temperature": F.when(m != 11, num(273.15) + a / num(30.123457)),
            "dewpoint_temperature": num(260.15) + a / num(15.234567),
            "influx_direct": F.col("influx_toa") * num(0.7) * F.least(num(1), a / num(501.2345)),
            "influx_diffuse": F.col("influx_toa") * num(0.2),
            "runoff": a / num(1000.12345),
        }
    ).drop("e", "a")


def cells(spark: SparkSession) -> DataFrame:
    ids = spark.range(12).select(F.col("id").alias("cell_id"))
    m = F.col("cell_id")
    out = ids.withColumns({"ix": (m % 4).cast("int"), "iy": F.floor(m / 4).cast("int")})
    out = out.withColumns({"x": num(5) + num(0.25) * F.col("ix"), "y": num(50) + num(0.25) * F.col("iy")})
    return out.withColumns({"lon": F.col("x"), "lat": F.col("y")})


def cutout(spark: SparkSession, sf_dir: str) -> Cutout:
    return Cutout(weather(spark, sf_dir), cells(spark), {"module": ["era5"], "dx": 0.25, "dy": 0.25, "prepared_features": []})


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bus, cell_id, w): suppliers' balances by region and cell."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.groupBy(F.col("r_name").alias("bus"), (F.col("s_suppkey") % 12).alias("cell_id")).agg(F.sum(F.round(F.abs("s_acctbal"), 2)).alias("w"))


SUN_SQL = """
{name}1 as (select *, epoch_us({time})/86400e6 + 2440587.5e0 - 2451545e0 as n, hour({time}) + minute({time})/60e0 as hrs from {src}),
{name}2 as (select *, radians(357.528e0 + 0.9856003e0*n) as g, radians(23.439e0 - 4e-7*n) as ep from {name}1),
{name}3 as (select *, radians(280.460e0 + 0.9856474e0*n + 1.915e0*sin(g) + 0.020e0*sin(2e0*g)) as l from {name}2),
{name}4 as (select *, radians((6.697375e0 + hrs + 0.0657098242e0*n)*15e0 + x) - atan2(cos(ep)*sin(l), cos(l)) + pi() as hr, asin(sin(ep)*sin(l)) as dec, radians(y) as phi from {name}3),
{name}5 as (select *, hr - floor(hr/(2e0*pi()))*2e0*pi() - pi() as h from {name}4),
{name}6 as (select *, asin(least(1e0, greatest(-1e0, sin(dec)*sin(phi) + cos(dec)*cos(phi)*cos(h)))) as alt from {name}5),
{name}7 as (select *, acos(least(1e0, greatest(-1e0, (sin(dec)*cos(phi) - cos(dec)*sin(phi)*cos(h))/cos(alt)))) as az0 from {name}6),
{name} as (select * exclude (n, hrs, g, ep, l, hr, dec, phi, h, az0), case when h > 0 then 2e0*pi() - az0 else az0 end as az from {name}7)"""

#: CTEs: w (the weather view), cells, weights.
BASE = (
    """w0 as (select date_trunc('hour', ts) as time, user_id % 12 as cell_id, min(event_id) as e, avg(value) as a from events group by 1, 2),
wx as (select *, 5e0 + 0.25e0*(cell_id % 4) as x, 50e0 + 0.25e0*(cell_id // 4) as y, 50e0*cell_id as height from w0),"""
    + SUN_SQL.format(name="ws", src="wx", time="time")
    + """,
wt as (select *, greatest(0e0, 1361e0*sin(alt)) as influx_toa from ws),
w as (select time, cell_id, x, y, height, alt as solar_altitude, az as solar_azimuth, influx_toa,
 ((e*7919) % 2800)/100e0 as wnd100m, 0.1e0 + 0.01e0*cell_id as wnd_shear_exp, 2e0*pi()*(e % 360)/360e0 as wnd_azimuth,
 0.03e0 + 0.01e0*cell_id as roughness, 0.1e0 + 0.02e0*(cell_id % 5) as albedo, 263.15e0 + a/12.345678e0 as temperature,
 case when cell_id <> 11 then 273.15e0 + a/30.123457e0 end as soil_temperature, 260.15e0 + a/15.234567e0 as dewpoint_temperature,
 influx_toa*0.7e0*least(1e0, a/501.2345e0) as influx_direct, influx_toa*0.2e0 as influx_diffuse, a/1000.12345e0 as runoff from wt),
cells as (select i::bigint as cell_id, (i % 4)::int as ix, (i // 4)::int as iy, 5e0 + 0.25e0*(i % 4) as x, 50e0 + 0.25e0*(i // 4) as y from range(12) t(i)),
weights as (select r_name as bus, s_suppkey % 12 as cell_id, sum(round(abs(s_acctbal), 2)) as w from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2)"""
)


def sql(select: str, extra: str = "") -> str:
    return f"with recursive {BASE}{',' if extra else ''} {extra} {select}"


def interp_sql(x: str, xs: list[float], ys: list[float]) -> str:
    out = f"case when {x} is null then null when {x} < {xs[0]!r}::double then {ys[0]!r}::double"
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False):
        if x1 > x0:
            out += f" when {x} < {x1!r}::double then {y0!r}::double + ({x} - {x0!r}::double)*({(y1 - y0) / (x1 - x0)!r}::double)"
    return out + f" else {ys[-1]!r}::double end"
