"""Dataset modules: their variables, and how raw fields become them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.basic import PI, div, num
from ..functions.solar import sun_position


@dataclass(frozen=True)
class Module:
    crs: int
    features: dict[str, list[str]]
    static: set[str] = field(default_factory=set)
    deprecated: bool = False


# The variables of each feature.
MODULES = {
    "era5": Module(
        4326,
        {
            "height": ["height"],
            "wind": ["wnd100m", "wnd_shear_exp", "wnd_azimuth", "roughness"],
            "influx": ["influx_toa", "influx_direct", "influx_diffuse", "albedo", "solar_altitude", "solar_azimuth"],
            "temperature": ["temperature", "soil_temperature", "dewpoint_temperature"],
            "runoff": ["runoff"],
        },
        {"height"},
    ),
    "sarah": Module(4326, {"influx": ["influx_direct", "influx_diffuse", "solar_altitude", "solar_azimuth"]}),
    "gebco": Module(4326, {"height": ["height"]}, {"height"}),
}


def available_features(spark, module: str | None = None) -> DataFrame:
    """(module, feature, variable) of one module, or of all that are not deprecated."""
    rows = [(m, f, v) for m, d in MODULES.items() if (module == m or module is None and not d.deprecated) for f, names in d.features.items() for v in names]
    return spark.createDataFrame(rows, "module string, feature string, variable string")


def reanalysis_wind(raw: DataFrame, sanitize: bool = True) -> DataFrame:
    """u, v at 10 and 100 m and fsr -> wnd100m, wnd_shear_exp, wnd_azimuth, roughness."""
    w10, w100 = (F.sqrt(F.col(f"u{h}") ** 2 + F.col(f"v{h}") ** 2) for h in (10, 100))
    angle = F.atan2("u100", "v100")
    rough = F.when(F.coalesce(F.col("fsr") >= 0, F.lit(False)), F.col("fsr")).otherwise(num(2e-4)) if sanitize else F.col("fsr")
    out = {"wnd100m": w100, "wnd_shear_exp": F.ln(div(w10, w100)) / F.ln(num(0.1)), "wnd_azimuth": F.when(angle < 0, angle + num(2 * PI)).otherwise(angle), "roughness": rough}
    return raw.withColumns(out).drop("u10", "v10", "u100", "v100", "fsr")


def reanalysis_influx(raw: DataFrame, sanitize: bool = True) -> DataFrame:
    """Hourly sums (J/m2) ssrd, ssr, fdir, tisr -> W/m2, albedo and the sun's place half an hour before the label."""
    floor = (lambda c: F.greatest(c, num(0))) if sanitize else (lambda c: c)
    sun = sun_position(F.col("time") - F.expr("interval 30 minutes"), F.col("lon"), F.col("lat"))
    out = {
        "albedo": F.coalesce(div(F.col("ssrd") - F.col("ssr"), F.col("ssrd")), num(0)),
        "influx_toa": floor(F.col("tisr") / num(3600)),
        "influx_direct": floor(F.col("fdir") / num(3600)),
        "influx_diffuse": floor((F.col("ssrd") - F.col("fdir")) / num(3600)),
        "solar_altitude": sun.altitude,
        "solar_azimuth": sun.azimuth,
    }
    return raw.withColumns(out).drop("ssrd", "ssr", "fdir", "tisr")


def reanalysis_temperature(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed({"t2m": "temperature", "stl4": "soil_temperature", "d2m": "dewpoint_temperature"})


def reanalysis_runoff(raw: DataFrame, sanitize: bool = True) -> DataFrame:
    return raw.withColumn("runoff", F.greatest("ro", num(0)) if sanitize else F.col("ro")).drop("ro")


def reanalysis_height(raw: DataFrame) -> DataFrame:
    """Geopotential of the first step as metres."""
    return raw.groupBy("cell_id").agg((F.min_by("z", "time") / num(9.80665)).alias("height"))


def clean_coordinates(raw: DataFrame) -> DataFrame:
    """longitude, latitude, valid_time -> x, y, time with five digits; lon and lat beside them."""
    out = raw.withColumnsRenamed({"longitude": "x", "latitude": "y", "valid_time": "time"}).drop("expver", "number")
    return out.withColumns({"x": F.round("x", 5), "y": F.round("y", 5)}).withColumns({"lon": F.col("x"), "lat": F.col("y")})


def request_plan(times: DataFrame, monthly: bool = False, static: bool = False) -> DataFrame:
    """One row for each request (year, or year and month) with its months, days and hours; static: the first step only."""
    if static:
        times = times.agg(F.min("time").alias("time"))
    parts = times.select(F.year("time").alias("year"), F.month("time").alias("month"), F.day("time").alias("day"), F.date_format("time", "HH:mm").alias("hour"))
    keys = ["year", "month"] if monthly else ["year"]
    sets = [F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("month", "day", "hour")]
    return parts.groupBy(*keys).agg(*sets)


def area(cells: DataFrame) -> DataFrame:
    return cells.agg(F.max("y").alias("north"), F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"))


def fill_gaps(df: DataFrame, value: str, by: list[str], time: str = "time") -> DataFrame:
    """Linear fill of NULLs by position in the series, flat at the ends; series of only NULLs stay."""
    w = Window.partitionBy(*by).orderBy(time)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col("__n"))
    df = df.withColumn("__n", F.row_number().over(w))
    df = df.withColumns({"__a": F.last(known, True).over(back), "__b": F.first(known, True).over(ahead), "__u": F.last(value, True).over(back), "__v": F.first(value, True).over(ahead)})
    filled = F.when(F.col("__a").isNull(), F.col("__v")).when(F.col("__b").isNull() | (F.col("__a") == F.col("__b")), F.col("__u"))
    filled = filled.otherwise(F.col("__u") + (F.col("__v") - F.col("__u")) * (F.col("__n") - F.col("__a")) / (F.col("__b") - F.col("__a")))
    return df.withColumn(value, filled).drop("__n", "__a", "__b", "__u", "__v")


def hourly_mean(df: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """Means of the :00 and :30 rows of an hour; hours without both are left out."""
    hour = df.groupBy(*by, F.date_trunc("hour", "time").alias("time")).agg(F.count("*").alias("__n"), *(F.when(F.count(v) == F.count("*"), F.avg(v)).alias(v) for v in values))
    return hour.where("__n = 2").drop("__n")


def satellite_influx(df: DataFrame, by: list[str]) -> DataFrame:
    """SIS and SID (W/m2) -> direct, diffuse and the sun's place at the label."""
    sun = sun_position(F.col("time"), F.col("lon"), F.col("lat"))
    return df.withColumns({"influx_direct": F.col("SID"), "influx_diffuse": F.col("SIS") - F.col("SID"), "solar_altitude": sun.altitude, "solar_azimuth": sun.azimuth}).drop("SIS", "SID")


def satellite_files(files: DataFrame, first: Column, last: Column) -> DataFrame:
    """(day, sis, sid): files of both kinds by the day in their names, within the range."""
    named = files.select("path", F.regexp_extract("path", r"(SIS|SID)in(\d{8})", 1).alias("kind"), F.to_date(F.regexp_extract("path", r"SI.in(\d{8})", 1), "yyyyMMdd").alias("day"))
    kinds = [named.where(F.col("kind") == k).select("day", F.col("path").alias(k.lower())) for k in ("SIS", "SID")]
    return kinds[0].join(kinds[1], "day").where(F.col("day").between(F.to_date(first), F.to_date(last)))


def uncovered_days(found: DataFrame, first: Column, last: Column) -> DataFrame:
    """Days from first to last for which ``satellite_files`` has not both files."""
    days = found.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(first), F.to_date(last))).alias("day"))
    return days.join(found.select("day"), "day", "left_anti")


def archive_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modified, bytes) of all files under a folder whose names match, at any depth; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def deaccumulate(df: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """x_i - x_(i-1) within a forecast; the first value as it is."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(value, F.col(value) - F.coalesce(F.lag(value).over(w), num(0)))


def deaverage(df: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """i * x_i - (i - 1) * x_(i-1) of running means within a forecast."""
    w = Window.partitionBy(*by).orderBy(order)
    i = F.row_number().over(w)
    return df.withColumn(value, i * F.col(value) - (i - 1) * F.coalesce(F.lag(value).over(w), num(0)))


def backfill(df: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """The next known value in each series."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(value, F.first(value, True).over(w))


def wrap_longitude(df: DataFrame, column: str = "lon") -> DataFrame:
    """Longitudes from 0 to 360 as -180 to 180."""
    return df.withColumn(column, F.when(F.col(column) > 180, F.col(column) - num(360)).otherwise(F.col(column)))


def forecast_time(df: DataFrame, start: str = "initial_time", hours: str = "forecast_hours") -> DataFrame:
    """``time`` of a forecast's steps: when it began and how many hours it looked ahead; both columns go."""
    return df.withColumn("time", F.col(start) + F.make_dt_interval(F.lit(0), F.col(hours).cast("int"), F.lit(0), F.lit(0).cast("decimal(18,6)"))).drop(start, hours)


def clip_lower(df: DataFrame, value: str, low: float, fill: float) -> DataFrame:
    """``fill`` where the value is not above ``low``, or missing."""
    return df.withColumn(value, F.when(F.col(value) > num(low), F.col(value)).otherwise(num(fill)))


def bin_starts(df: DataFrame, minutes: int = 90) -> DataFrame:
    """Labels of means moved from the middle of their interval to its beginning."""
    return df.withColumn("time", F.col("time") - F.expr(f"interval {minutes} minutes"))


def halved_bins(df: DataFrame, value: str, by: list[str], hours: int = 3) -> DataFrame:
    """(by, time, value): means of intervals that end at their labels, also at the label ``hours`` earlier; a label of both keeps its own value."""
    earlier = df.select(*by, (F.col("time") - F.expr(f"interval {hours} hours")).alias("time"), F.col(value).alias("__v"), F.lit(1).alias("__late"))
    both = earlier.unionByName(df.select(*by, "time", F.col(value).alias("__v"), F.lit(0).alias("__late")))
    return both.groupBy(*by, "time").agg(F.min_by("__v", "__late").alias(value))
