"""Queries of the conversions and of their aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import solar, thermal, wind
from ..functions.basic import DEG, num
from ..operators import hydro
from ..operators.aggregate import aggregate_matrix, convert_and_aggregate, reduce_time
from ..sources.catalog import CSPINSTALLATIONS, SOLARPANELS, validate_turbine, windturbine
from .weather import cutout, interp_sql, r6, read, sql, weather, weights

V112 = windturbine("Vestas_V112_3MW")
V112_SMOOTH = wind.smooth(V112)
PANEL, BOFINGER = SOLARPANELS["CSi"], SOLARPANELS["KANENA"]
SLOPE, AZIMUTH = 35.0, 180.0


def _rows(convert, name: str = "value"):
    """A query of one converted value by time and cell."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = weather(spark, sf_dir)
        return w.select("time", "cell_id", r6(convert(w)).alias(name))

    return run


def _buses(convert, **options):
    """A query of one converted value by bus (and time) through the gateway."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = cutout(spark, sf_dir)
        out = convert_and_aggregate(c, convert, matrix=weights(spark, sf_dir), **options)
        return out.select(*(x for x in out.columns if x != "v"), F.round("v", 6 if options.get("per_unit") else 3).alias("value"))

    return run


def _rows_sql(expression: str, name: str = "value", source: str = "w", extra: str = "") -> str:
    return sql(f"select time, cell_id, round({expression}, 6) as {name} from {source}", extra)


def _bus_sql(expression: str, per_unit: bool = False, how: str | None = None, source: str = "w", extra: str = "") -> str:
    value = "coalesce(v / nullif(capacity, 0), 0)" if per_unit else "v"
    n = 6 if per_unit else 3
    reduce = {"sum": f"select bus, round(coalesce(sum(v), 0), {n}) as value from pu group by bus", "mean": f"select bus, round(avg(v), {n}) as value from pu group by bus", None: f"select bus, time, round(v, {n}) as value from pu"}[how]
    tail = f"""f as (select time, cell_id, {expression} as v from {source}),
g as (select bus, time, case when count(f.v*k.w) = count(*) then sum(f.v*k.w) end as v from f join weights k using (cell_id) group by bus, time),
cap as (select bus, sum(w) as capacity from weights group by bus),
pu as (select bus, time, {value} as v from g join cap using (bus))"""
    return sql(reduce, (extra + ", " if extra else "") + tail)


_LOG = "wnd100m * ln(80e0/roughness)/ln(100e0/roughness)"
_CURVE = interp_sql("hub", V112["V"], [p / V112["P"] for p in V112["POW"]])
_SMOOTH = interp_sql("hub", V112_SMOOTH["V"], [p / V112_SMOOTH["P"] for p in V112_SMOOTH["POW"]])
_HUB = f"hub as (select *, {_LOG} as hub from w)"


def _wind(turbine: dict, method: str = "logarithmic"):
    return lambda w: wind.power_curve(wind.extrapolate(w.columns, turbine["hub_height"], method=method), turbine)


def _sun(w: DataFrame) -> solar.Sun:
    return solar.Sun(F.col("solar_altitude"), F.col("solar_azimuth"))


def _face(w: DataFrame, tracking: str | None = None, spec=None) -> solar.Surface:
    place = solar.orientation(spec or {"slope": SLOPE, "azimuth": AZIMUTH})(F.col("x"), F.col("y"))
    return solar.surface(_sun(w), *place, tracking)


def _tilted(w: DataFrame, tracking: str | None = None, trigon: str = "simple", part: str = "total", spec=None) -> Column:
    return solar.tilted_irradiation(w.columns, _sun(w), _face(w, tracking, spec), trigon, None, tracking, part=part)


_B, _G = f"{SLOPE * DEG!r}::double", f"{AZIMUTH * DEG!r}::double"
_ALT, _AZ = "solar_altitude", "solar_azimuth"


def _fixed_sql(b: str, g: str) -> str:
    return f"sin({b})*cos({_ALT})*cos({g} - {_AZ}) + cos({b})*sin({_ALT})"


def _face_sql(tracking: str | None = None, slope: str = _B) -> str:
    """CTE ``face`` with ci and slope."""
    if tracking is None:
        return f"face as (select *, greatest(0e0, {_fixed_sql(slope, _G)}) as ci, {slope} as slope from w)"
    if tracking == "vertical":
        return f"face as (select *, greatest(0e0, sin({_B})*cos({_ALT}) + cos({_B})*sin({_ALT})) as ci, {_B} as slope from w)"
    if tracking == "dual":
        return f"face as (select *, 1e0 as ci, {_B} as slope from w)"
    if tracking == "horizontal":
        return f"""fa as (select *, atan(cos({_ALT})/nullif(sin({_ALT}), 0)*sin({_AZ} - {_G})) as rot from w),
face as (select *, greatest(0e0, {_fixed_sql("abs(rot)", f"({_G} + asin(case when sin(abs(rot)) = 0 then null else sin(rot)/sin(abs(rot)) end))")}) as ci, abs(rot) as slope from fa)"""
    return f"""fa as (select *, {_AZ} - {_G} as off from w),
fb as (select *, atan(cos({_ALT})*sin(off)/nullif(cos({_ALT})*cos(off)*sin({_B}) + sin({_ALT})*cos({_B}), 0)) as rot,
 case when off > pi() then off - 2e0*pi() when off < -pi() then 2e0*pi() + off else off end as wr from fa),
fc as (select *, case when rot < 0 and wr > 0 then rot + pi() else rot end as up from fb),
fd as (select *, case when up > 0 and wr < 0 then up - pi() else up end as dn from fc),
face as (select *, greatest(0e0, cos(dn)*(sin({_B})*cos({_ALT})*cos(off) + cos({_B})*sin({_ALT})) + sin(dn)*cos({_ALT})*sin(off)) as ci, acos(cos(rot)*cos({_B})) as slope from fd)"""


def _irr_sql(tracking: str | None = None, trigon: str = "simple", slope: str = _B) -> str:
    """CTE ``irr`` with direct, diffuse, ground and total of ``face``."""
    view = f"(1e0 + {'sin(' + _ALT + ')' if tracking == 'dual' else 'cos(slope)'})/2e0"
    if trigon == "simple":
        parts = f"coalesce(rb*dir, 0) as p_dir, coalesce({view}*dif, 0) as p_dif, coalesce((dir + dif)*albedo*(1e0 - cos(slope))/2e0, 0) as p_gnd"
    else:
        parts = "rb*dir as p_dir, coalesce(greatest(0e0, ((1e0 - dir/nullif(influx_toa, 0))*(1e0 + cos(slope))/2e0*(1e0 + coalesce(sqrt(dir/nullif(dir + dif, 0)), 0)*pow(sin(slope/2e0), 3e0)) + dir/nullif(influx_toa, 0)*rb)*dif), 0) as p_dif, (dir + dif)*albedo*(1e0 - cos(slope))/2e0 as p_gnd"
        parts = parts.replace("greatest(0e0, (", "greatest(0e0, (", 1)
    dark = f"{_ALT} < {DEG!r}::double or dir + dif <= 0.01e0"
    return f"""{_face_sql(tracking, slope)},
ia as (select *, greatest(0e0, least(influx_direct, influx_toa)) as dir, ci/nullif(sin({_ALT}), 0) as rb from face),
ib as (select *, greatest(0e0, least(influx_diffuse, influx_toa - dir)) as dif from ia),
ic as (select *, {parts} from ib),
irr as (select *, case when {dark} then 0e0 else p_dir + p_dif + p_gnd end as total, case when {dark} then 0e0 else p_dir end as direct,
 case when {dark} then 0e0 else p_dif end as diffuse, case when {dark} then 0e0 else p_gnd end as ground from ic)"""


def _huld_sql() -> str:
    p = {k: f"({v!r}::double)" for k, v in PANEL.items() if not isinstance(v, str)}
    t = f"({p['c_temp_amb']}*temperature + {p['c_temp_irrad']}*total - {p['r_tmod']})"
    x = f"(case when total > 0 then ln(total/{p['r_irradiance']}) end)"
    eff = f"1e0 + {p['k_1']}*{x} + {p['k_2']}*{x}*{x} + {t}*({p['k_3']} + {p['k_4']}*{x} + {p['k_5']}*{x}*{x}) + {p['k_6']}*{t}*{t}"
    return f"total/{p['r_irradiance']}*greatest(0e0, coalesce({eff}, 0))*{p['inverter_efficiency']}"


def _bofinger_sql() -> str:
    p = BOFINGER
    fraction = (p["NOCT"] - p["Tamb"]) / p["Intc"]
    cap = (p["A"] + 1000.0 * p["B"] + p["C"] * 6.907755278982137) * 1000.0
    base = f"({p['A']!r}::double + {p['B']!r}::double*total + {p['C']!r}::double*(case when total > 0 then ln(total) end))"
    eff = f"{base}*(1e0 + {p['D']!r}::double*({fraction!r}::double*total + temperature - {p['Tstd']!r}::double))/nullif(1e0 + {p['D']!r}::double*{fraction / p['ta']!r}::double*{base}*total, 0)"
    return f"case when total >= {p['threshold']!r}::double then total*coalesce({eff}, 0)*{p['inverter_efficiency']!r}::double/{cap!r}::double else 0e0 end"


def _pv(panel: dict, tracking: str | None = None, trigon: str = "simple", spec=None):
    return lambda w: solar.panel_power(_tilted(w, tracking, trigon, spec=spec), F.col("temperature"), panel)


def _optimal_sql() -> str:
    a = "abs(radians(y))"
    return f"(case when {a} <= {25 * DEG!r}::double then 0.87e0*{a} when {a} <= {50 * DEG!r}::double then 0.76e0*{a} + {0.31 * DEG!r}::double else {40 * DEG!r}::double end)"


def _daily(convert, shift: float = 0.0):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        days = thermal.daily_mean(weather(spark, sf_dir), "temperature", shift)
        return days.select("cell_id", "time", r6(convert(F.col("temperature"))).alias("value"))

    return run


def _daily_sql(expression: str, shift: int = 0) -> str:
    return sql(
        f"select cell_id, time, round({expression}, 6) as value from full_days",
        f"""days as (select cell_id, date_trunc('day', time + interval {shift} hour) as time, avg(temperature) as t from w group by 1, 2),
span as (select unnest(generate_series(min(time), max(time), interval 1 day)) as time from days),
full_days as (select c.cell_id, s.time, d.t from (select distinct cell_id from days) c cross join span s left join days d on d.cell_id = c.cell_id and d.time = s.time)""",
    )


def _time(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = weather(spark, sf_dir).select("cell_id", F.col("soil_temperature").alias("v"))
        return reduce_time(w, "cell_id", how).select("cell_id", r6("v").alias("value"))

    return run


def _capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cap = convert_and_aggregate(cutout(spark, sf_dir), lambda w: F.col("temperature"), matrix=weights(spark, sf_dir), return_capacity=True)
    return cap.select("bus", r6("capacity").alias("capacity"))


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cutout(spark, sf_dir)
    layout = c.cells.select("cell_id", (num(1) + F.col("cell_id") % 3).alias("capacity"))
    out = convert_and_aggregate(c, lambda w: thermal.temperature(F.col("temperature")), matrix=weights(spark, sf_dir), layout=layout, per_unit=True, aggregate_time="mean")
    return out.select("bus", r6("v").alias("value"))


def _nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate_matrix(weather(spark, sf_dir).select("cell_id", "time", F.col("soil_temperature").alias("v")), weights(spark, sf_dir))
    return out.select("bus", "time", F.round("v", 3).alias("value"))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_matrix(weather(spark, sf_dir).select("cell_id", "time", (F.col("runoff") * F.col("height")).alias("v")), weights(spark, sf_dir))


_SERIES = "f as (select bus, time, sum(runoff*height*k.w) as v from w join weights k using (cell_id) group by bus, time)"


def _rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydro.rolling_mean(_series(spark, sf_dir), True).select("bus", "time", F.round("v", 3).alias("value"))


def _threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydro.drop_low(_series(spark, sf_dir), 0.25).select("bus", "time", F.round("v", 3).alias("value"))


def _hourly_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years of hours for each region: enough rows for the full-year rule."""
    hours = spark.sql("select explode(sequence(timestamp'2022-07-01 00:00:00', timestamp'2024-06-30 23:00:00', interval 1 hour)) time")
    r = read(spark, sf_dir, "region")
    return r.crossJoin(hours).select(F.col("r_name").alias("bus"), "time", (num(1) + F.col("r_regionkey") + F.hour("time") / num(24)).alias("v"))


_YEARS = "hy as (select r_name as bus, h as time, 1e0 + r_regionkey + hour(h)/24e0 as v from region, (select unnest(generate_series(timestamp '2022-07-01 00:00:00', timestamp '2024-06-30 23:00:00', interval 1 hour)) as h))"


def _full_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydro.full_years(_hourly_years(spark, sf_dir))


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = read(spark, sf_dir, "region").select(F.col("r_name").alias("bus"), F.lit(2023).alias("year"), (num(1000) * (F.col("r_regionkey") + 1)).alias("total"))
    out = hydro.normalize_yearly(_hourly_years(spark, sf_dir), totals)
    return out.groupBy("bus", F.year("time").alias("year")).agg(F.round(F.sum("v"), 4).alias("total"))


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather(spark, sf_dir).groupBy("cell_id", F.date_trunc("week", "time").alias("week")).agg(r6(F.avg("temperature")).alias("value"))


def _duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = weather(spark, sf_dir).select("cell_id", "time", "wnd100m")
    rank = F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("wnd100m"), "time"))
    return w.select("cell_id", rank.cast("int").alias("rank"), r6("wnd100m").alias("value"))


def _orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weather(spark, sf_dir).select("cell_id", "x", "y").distinct()
    slope, azimuth = solar.orientation("latitude_optimal")(F.col("x"), F.col("y"))
    flat, _ = solar.orientation("latitude")(F.col("x"), F.col("y"))
    return w.select("cell_id", r6(slope).alias("optimal"), r6(azimuth).alias("azimuth"), r6(flat).alias("latitude"))


def _reindl(w: DataFrame) -> Column:
    return solar.diffuse_fraction(F.col("influx_direct") + F.col("influx_diffuse"), F.col("influx_toa"), _sun(w), F.col("temperature"), num(0.6))


_CSP = {"technology": "solar tower", "r_irradiance": 1000.0, "altitude": [0.0, 30.0, 60.0, 90.0], "azimuth": [0.0, 120.0, 240.0, 360.0], "efficiency": [[0.1, 0.2, 0.2, 0.1], [0.4, 0.5, 0.5, 0.4], [0.6, 0.7, 0.7, 0.6], [0.8, 0.8, 0.8, 0.8]]}


def _bilinear_sql() -> str:
    rows = ", ".join(f"({i}, {j}, {v!r}::double)" for i, row in enumerate(_CSP["efficiency"]) for j, v in enumerate(row))
    return f"""eff(i, j, e) as (values {rows}),
ca as (select *, degrees(solar_altitude)/30e0 as u, degrees(solar_azimuth)/120e0 as v from w),
cb as (select *, least(floor(u), 2)::int as i0, least(floor(v), 2)::int as j0 from ca),
cc as (select cb.*, case when u between 0 and 3 and v between 0 and 3 then a.e*(1 - (u - i0))*(1 - (v - j0)) + b.e*(u - i0)*(1 - (v - j0)) + c.e*(1 - (u - i0))*(v - j0) + d.e*(u - i0)*(v - j0) end as e from cb
 left join eff a on a.i = i0 and a.j = j0 left join eff b on b.i = i0 + 1 and b.j = j0 left join eff c on c.i = i0 and c.j = j0 + 1 left join eff d on d.i = i0 + 1 and d.j = j0 + 1)"""


def _cop(kind: str, sink: float = 55.0):
    return lambda w: thermal.coefficient_of_performance(thermal.temperature(F.col("temperature")) if kind == "air" else thermal.soil_temperature(F.col("soil_temperature")), kind, sink)


_LOSSLESS = CSPINSTALLATIONS["lossless_installation"]
_TURBINE = validate_turbine({"V": [0, 25], "POW": [0, 1], "hub_height": 100, "P": 1})
_DELTA_AIR, _DELTA_SOIL = "(55e0 - (temperature - 273.15e0))", "(55e0 - coalesce(soil_temperature - 273.15e0, 0))"
_TRACKS = ("horizontal", "tilted_horizontal", "vertical", "dual")

QUERIES: dict[str, tuple] = {
    "a01_sum": (_time("sum"), sql("select cell_id, round(coalesce(sum(soil_temperature), 0), 6) as value from w group by 1")),
    "a01_mean": (_time("mean"), sql("select cell_id, round(avg(soil_temperature), 6) as value from w group by 1")),
    "a02_gateway_sum": (_buses(lambda w: F.col("runoff"), aggregate_time="sum"), _bus_sql("runoff", how="sum")),
    "a02_gateway_mean": (_buses(lambda w: F.col("runoff"), per_unit=True, aggregate_time="mean"), _bus_sql("runoff", per_unit=True, how="mean")),
    "a03_capacity": (_capacity, sql("select bus, round(sum(w), 6) as capacity from weights group by 1")),
    "a04_per_unit": (_buses(lambda w: F.col("soil_temperature"), per_unit=True), _bus_sql("soil_temperature", per_unit=True)),
    "a06_daily_mean": (_daily(lambda t: t, 3), _daily_sql("t", 3)),
    "a09_full_years": (_full_years, sql("select bus, year(time)::int as year from hy group by 1, 2 having count(*) > 8700", _YEARS)),
    "a10_normalize_yearly": (
        _normalized,
        sql(
            "select hy.bus, year(time)::int as year, round(sum(v*k), 4) as total from hy join (select bus, any_value(1000e0*(r_regionkey + 1)) / sum(v) as k from hy join region on r_name = bus where year(time) = 2023 group by bus) q on q.bus = hy.bus group by 1, 2",
            _YEARS,
        ),
    ),
    "a11_threshold": (_threshold, sql("select bus, time, round(case when v >= (select quantile_cont(v, 0.25) from f) then v else 0 end, 3) as value from f", _SERIES)),
    "w01_rolling_mean": (_rolling, sql("select bus, time, round(avg(v) over (partition by bus order by time rows between 167 preceding and current row), 3) as value from f", _SERIES)),
    "o02_duration_curve": (_duration, sql("select cell_id, row_number() over (partition by cell_id order by wnd100m desc, time)::int as rank, round(wnd100m, 6) as value from w")),
    "o03_weekly_mean": (_weekly, sql("select cell_id, date_trunc('week', time)::timestamp as week, round(avg(temperature), 6) as value from w group by 1, 2")),
    "j01_weight_product": (_nulls, _bus_sql("soil_temperature")),
    "j02_layout": (
        _layout,
        sql(
            "select bus, round(avg(coalesce(v / nullif(cap, 0), 0)), 6) as value from g join c using (bus) group by bus",
            """k as (select bus, cell_id, w*(1 + cell_id % 3) as w from weights), c as (select bus, sum(w) as cap from k group by bus),
g as (select bus, time, sum((temperature - 273.15e0)*k.w) as v from w join k using (cell_id) group by bus, time)""",
        ),
    ),
    "c01_temperature": (_rows(lambda w: thermal.temperature(F.col("temperature"))), _rows_sql("temperature - 273.15e0")),
    "c02_soil_temperature": (_rows(lambda w: thermal.soil_temperature(F.col("soil_temperature"))), _rows_sql("coalesce(soil_temperature - 273.15e0, 0)")),
    "c03_dewpoint": (_rows(lambda w: thermal.dewpoint_temperature(F.col("dewpoint_temperature"))), _rows_sql("dewpoint_temperature - 273.15e0")),
    "c04_cop_air": (_rows(_cop("air")), _rows_sql(f"6.81e0 + (-0.121e0)*{_DELTA_AIR} + 0.000630e0*{_DELTA_AIR}*{_DELTA_AIR}")),
    "c04_cop_soil": (_rows(_cop("soil")), _rows_sql(f"8.77e0 + (-0.150e0)*{_DELTA_SOIL} + 0.000734e0*{_DELTA_SOIL}*{_DELTA_SOIL}")),
    "c05_heat_demand": (_daily(lambda t: thermal.heat_demand(t, 15, 2, 1)), _daily_sql("case when t is not null then 1e0 + greatest(2e0*(288.15e0 - t), 0) end")),
    "c06_cooling_demand": (_daily(lambda t: thermal.cooling_demand(t, 10), 2), _daily_sql("case when t is not null then greatest(t - 283.15e0, 0) end", 2)),
    "c07_wind": (_buses(_wind(V112), per_unit=True), _bus_sql(_CURVE, per_unit=True, source="hub", extra=_HUB)),
    "c07_wind_smooth": (_buses(_wind(V112_SMOOTH), aggregate_time="sum"), _bus_sql(_SMOOTH, how="sum", source="hub", extra=_HUB)),
    "v01_logarithmic": (_rows(lambda w: wind.extrapolate(w.columns, 80)), _rows_sql(_LOG)),
    "v01_power": (_rows(lambda w: wind.extrapolate(w.columns, 80, method="power")), _rows_sql("wnd100m*pow(0.8e0, wnd_shear_exp)")),
    "v02_smooth_curve": (_rows(_wind(V112_SMOOTH)), _rows_sql(_SMOOTH, source="hub", extra=_HUB)),
    "v03_cutout_speed": (_rows(_wind(_TURBINE)), _rows_sql("case when wnd100m < 25 then wnd100m/25e0 else 0 end")),
    "r01_sun_position": (
        lambda s, d: weather(s, d).select("time", "cell_id", r6("solar_altitude").alias("altitude"), r6("solar_azimuth").alias("azimuth")),
        sql("select time, cell_id, round(solar_altitude, 6) as altitude, round(solar_azimuth, 6) as azimuth from w"),
    ),
    "r02_orientation": (_orientation, sql(f"select distinct cell_id, round({_optimal_sql()}, 6) as optimal, round(pi(), 6) as azimuth, round(radians(y), 6) as latitude from w")),
    "r03_surface_fixed": (_rows(lambda w: _face(w).cosine), _rows_sql("ci", source="face", extra=_face_sql())),
    **{f"r03_surface_{t}": (_rows(lambda w, t=t: _face(w, t).cosine), _rows_sql("ci", source="face", extra=_face_sql(t))) for t in _TRACKS},
    "r04_diffuse_fraction": (
        _rows(_reindl),
        _rows_sql(
            "case when k > 0 and k <= 0.3e0 then least(1e0, 1e0 - 0.232e0*k + 0.0239e0*s - 0.000682e0*temperature + 0.0195e0*0.6e0) when k > 0.3e0 and k < 0.78e0 then least(0.97e0, greatest(0.1e0, 1.329e0 - 1.716e0*k + 0.267e0*s - 0.00357e0*temperature + 0.106e0*0.6e0)) when k >= 0.78e0 then greatest(0.1e0, 0.426e0*k - 0.256e0*s + 0.00349e0*temperature + 0.0734e0*0.6e0) else 0 end",
            source="q",
            extra="q as (select *, (influx_direct + influx_diffuse)/nullif(influx_toa, 0) as k, sin(solar_altitude) as s from w)",
        ),
    ),
    "r05_hay_davies_diffuse": (_rows(lambda w: _tilted(w, trigon="other", part="diffuse")), _rows_sql("diffuse", source="irr", extra=_irr_sql(trigon="other"))),
    "r06_tilted_direct": (_rows(lambda w: _tilted(w, part="direct")), _rows_sql("direct", source="irr", extra=_irr_sql())),
    "r07_tilted_ground": (_rows(lambda w: _tilted(w, part="ground")), _rows_sql("ground", source="irr", extra=_irr_sql())),
    "r08_tilted_total": (_rows(lambda w: _tilted(w, trigon="other")), _rows_sql("total", source="irr", extra=_irr_sql(trigon="other"))),
    "r12_dni": (_rows(lambda w: solar.dni(F.col("influx_direct"), _sun(w)) * num(0.987654321)), _rows_sql(f"influx_direct/sin(greatest(solar_altitude, {3.75 * DEG!r}::double))*0.987654321e0")),
    "c08_irradiation": (_buses(lambda w: _tilted(w), aggregate_time="mean", per_unit=True), _bus_sql("total", per_unit=True, how="mean", source="irr", extra=_irr_sql())),
    "c08_irradiation_dual": (_rows(lambda w: _tilted(w, "dual")), _rows_sql("total", source="irr", extra=_irr_sql("dual"))),
    "c09_pv": (_buses(_pv(PANEL), per_unit=True), _bus_sql(_huld_sql(), per_unit=True, source="irr", extra=_irr_sql())),
    "c09_pv_bofinger": (_rows(_pv(BOFINGER)), _rows_sql(_bofinger_sql(), source="irr", extra=_irr_sql())),
    "c09_pv_tracking": (_rows(_pv(PANEL, "horizontal")), _rows_sql(_huld_sql(), source="irr", extra=_irr_sql("horizontal"))),
    "c09_pv_optimal": (_rows(_pv(PANEL, spec="latitude_optimal")), _rows_sql(_huld_sql(), source="irr", extra=_irr_sql(slope=_optimal_sql()))),
    "c10_solar_thermal": (_rows(lambda w: solar.collector(_tilted(w), F.col("temperature"))), _rows_sql("coalesce(greatest(total*(0.8e0 - 3e0*coalesce((353.15e0 - temperature)/nullif(total, 0), 0)), 0), 0)", source="irr", extra=_irr_sql())),
    "c11_csp_tower": (_rows(lambda w: solar.csp_power(F.col("influx_direct"), _sun(w), _CSP)), _rows_sql(f"coalesce(case when e is not null then least(1e0, influx_direct/sin(greatest(solar_altitude, {3.75 * DEG!r}::double))*e/1000e0) end, 0)", source="cc", extra=_bilinear_sql())),
    "c11_csp_trough": (_rows(lambda w: solar.csp_power(F.col("influx_direct"), _sun(w), _LOSSLESS, "parabolic trough")), _rows_sql("case when solar_altitude >= 0 then least(1e0, influx_direct/1000e0) else 0 end")),
    "c12_runoff": (_buses(lambda w: hydro.runoff(w)), _bus_sql("runoff*height")),
}
