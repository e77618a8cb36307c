"""Runoff series, river basins and inflow of hydro plants; line ratings over the cells of a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basic import num, zero
from ..functions.line import line_limit
from ..sources.cutout import Cutout
from ..sources.shared import written
from .aggregate import aggregate_matrix
from .geometry import indicator_matrix, intersection_matrix, next_points, reproject, shape_area
from .quantile import with_quantile


def runoff(weather: DataFrame, weight_with_height: bool = True) -> Column:
    return F.col("runoff") * F.col("height") if weight_with_height else F.col("runoff")


def rolling_mean(df: DataFrame, window: int | bool = 168, by: str = "bus") -> DataFrame:
    """Trailing mean of v over ``window`` rows (True: 168), from the first row on."""
    n = 168 if window is True else int(window)
    return df.withColumn("v", F.avg("v").over(Window.partitionBy(by).orderBy("time").rowsBetween(1 - n, 0)))


def drop_low(df: DataFrame, quantile: float | bool = 0.005) -> DataFrame:
    """v below its exact quantile (True: 0.005) over all rows becomes 0, as does NULL. The rows are written once, for the rounds that find the quantile and for the result."""
    rows, edge = with_quantile(df, 0.005 if quantile is True else float(quantile))
    return rows.withColumn("v", F.when(F.col("v") >= F.lit(edge), F.col("v")).otherwise(num(0)) if edge is not None else num(0))


def full_years(df: DataFrame, rows: int = 8700) -> DataFrame:
    """(bus, year) with more than ``rows`` rows."""
    return df.groupBy("bus", F.year("time").alias("year")).agg(F.count("*").alias("n")).where(F.col("n") > rows).select("bus", "year")


def normalize_yearly(df: DataFrame, totals: DataFrame, rows: int = 8700) -> DataFrame:
    """v scaled so that a bus has the total (bus, year, total) over the full years that both know."""
    years = full_years(df, rows).join(totals, ["bus", "year"])
    sums = df.groupBy("bus", F.year("time").alias("year")).agg(F.sum("v").alias("v"))
    ratio = sums.join(years, ["bus", "year"]).groupBy("bus").agg(F.try_divide(F.sum("total"), F.sum("v")).alias("ratio"))
    return df.join(ratio, "bus").select("bus", "time", (F.col("v") * F.col("ratio")).alias("v"))


def find_basins(plants: DataFrame, basins: DataFrame) -> DataFrame:
    """(plant, hid): the basin of each plant; of several the first by id; no row for a plant outside all of them.

    plants: plant, lon, lat; basins: hid, pts (one row for each ring), ... Boxes are met by tiles of a degree, with ids only; each plant then
    counts the edges to its right among those of its candidates that cross its own degree of latitude, so no outline is copied or walked as a whole.
    """
    xs, ys = F.transform("pts", lambda p: p["x"]), F.transform("pts", lambda p: p["y"])
    tile = lambda c: F.floor(c).cast("int")
    boxes = basins.groupBy("hid").agg(F.min(F.array_min(xs)).alias("x0"), F.max(F.array_max(xs)).alias("x1"), F.min(F.array_min(ys)).alias("y0"), F.max(F.array_max(ys)).alias("y1"))
    spread = boxes.withColumn("tx", F.explode(F.sequence(tile("x0"), tile("x1")))).withColumn("ty", F.explode(F.sequence(tile("y0"), tile("y1"))))
    near = plants.withColumns({"tx": tile("lon"), "ty": tile("lat")}).join(spread, ["tx", "ty"]).where("lon between x0 and x1 and lat between y0 and y1").select("plant", "lon", "lat", "ty", "hid")
    edge = F.explode(F.zip_with("pts", next_points(F.col("pts")), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))).alias("e")
    edges = basins.select("hid", edge).select("hid", "e.*").withColumn("ty", F.explode(F.sequence(tile(F.least("ay", "by")), tile(F.greatest("ay", "by")))))
    cross = (F.col("bx") - F.col("ax")) * (F.col("lat") - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), num(0)) + F.col("ax")
    right = ((F.col("ay") > F.col("lat")) != (F.col("by") > F.col("lat"))) & (F.col("lon") < cross)
    counts = near.join(edges, ["hid", "ty"]).where(right).groupBy("plant", "hid").agg(F.count("*").alias("n"))
    return counts.where("n % 2 = 1").groupBy("plant").agg(F.min("hid").alias("hid"))


def upstream(basins: DataFrame, targets: DataFrame) -> DataFrame:
    """(root, hid): each target basin and all that flow into it.

    basins: hid, next_down. Rounds of pointer jumping: after round k a basin knows the targets under 2^k steps down the river, and the basin
    2^k steps down. So a river of n basins takes log n rounds, each a join by id; what they know is as long as the result. A cycle, in which pointers
    never end, adds nothing new once 2^k passes the number of basins. Each round is written, so that the plan does not grow.
    """
    jump = basins.where("next_down is not null and next_down <> hid").select(F.col("hid").alias("at"), F.col("next_down").alias("down")).join(basins.select(F.col("hid").alias("down")).distinct(), "down", "left_semi").select("at", "down")
    found = targets.select(F.col("hid").alias("root"), "hid").distinct().checkpoint(eager=True)
    jump = jump.checkpoint(eager=True)
    steps, most = 1, jump.count() + 1
    while steps < 2 * most and not jump.isEmpty():
        below = found.select("root", F.col("hid").alias("down"))
        found = found.unionByName(jump.join(below, "down").select("root", F.col("at").alias("hid"))).distinct().checkpoint(eager=True)
        jump = jump.join(jump.select(F.col("at").alias("down"), F.col("down").alias("next")), "down").select("at", F.col("next").alias("down")).checkpoint(eager=True)
        steps *= 2
    return found


def first_appearance(df: DataFrame, what: str, order: str) -> DataFrame:
    """(what, first): each distinct value with the smallest ``order`` at which it stands, by which ``orderBy("first")`` lists values as they first appear; nulls have no row."""
    return df.where(F.col(what).isNotNull()).groupBy(what).agg(F.min(order).alias("first"))


def determine_basins(plants: DataFrame, basins: DataFrame) -> DataFrame:
    """(plant, basin, hid, distance): the basin of each plant, and it and all basins upstream with their distance up the river in km.

    plants: plant, lon, lat; basins as published: HYBAS_ID, DIST_MAIN (km to the outlet), NEXT_DOWN and pts. A missing
    column raises ValueError. A plant outside all basins has no row.
    """
    if missing := {"hybas_id", "dist_main", "next_down", "pts"} - {c.lower() for c in basins.columns}:
        raise ValueError(f"the basins lack the columns {sorted(c.upper() for c in missing)}")
    named = basins.withColumnRenamed("HYBAS_ID", "hid")
    own = find_basins(plants, named).withColumnRenamed("hid", "basin")
    meta = named.groupBy("hid").agg(F.first("DIST_MAIN").alias("dist"), F.first("NEXT_DOWN").alias("next_down"))  # a basin of several rings is one
    members = upstream(meta, own.select(F.col("basin").alias("hid"))).withColumnRenamed("root", "basin")
    far = lambda id, name: meta.select(F.col("hid").alias(id), F.col("dist").alias(name))
    return own.join(members, "basin").join(far("hid", "up"), "hid").join(far("basin", "down"), "basin").select("plant", "basin", "hid", (F.col("up") - F.col("down")).alias("distance"))


def hydro(cutout: Cutout, plants: DataFrame, basins: DataFrame, flowspeed: float = 1.0, weight_with_height: bool = False) -> DataFrame:
    """(plant, time, v): inflow of each plant from the runoff of its basin and of all upstream.

    Runoff is averaged over a basin by its shares of cells (nothing for a basin beside the grid), times the basin's area in an equal-area cylinder
    (m2), delayed by the way down to the plant at ``flowspeed`` m/s. plants and basins as in ``determine_basins``.
    """
    members = determine_basins(plants, basins).checkpoint(eager=True)
    wanted = members.select("hid").distinct()
    shapes = basins.withColumnRenamed("HYBAS_ID", "hid").join(wanted, "hid", "left_semi").withColumnRenamed("hid", "shape_id")
    weights = basin_weights(indicator_matrix(cutout.grid(), shapes))
    weather = cutout.weather
    if weight_with_height and "height" not in weather.columns:
        weather = weather.join(cutout.cells.select("cell_id", "height"), "cell_id")
    values = weather.select("cell_id", "time", runoff(weather, weight_with_height).alias("v"))
    areas = shape_area(shapes.withColumn("pts", reproject(F.col("pts"), "cea"))).select(F.col("shape_id").alias("bus"), "area")
    rows = aggregate_matrix(values, weights).join(areas, "bus").select(F.col("bus").alias("hid"), "time", (F.col("v") * F.col("area")).alias("v"))
    return shifted_inflow(members.select("plant", "hid", "distance"), rows, flowspeed)


def upstream_sql(basins: str = "basins", targets: str = "targets", depth: int = 100) -> str:
    """The same as one recursive query with a path that stops at cycles; it raises an error where a river has ``depth`` steps or more. Spark's own limits, of levels
    and of a million rows in all, are lifted within the statement."""
    return f"""with recursive up(root, hid, path, depth) max recursion level {depth + 1} as (
        select hid, hid, array(hid), 0 from {targets}
        union all
        select u.root, b.hid, concat(u.path, array(b.hid)), u.depth + 1 from up u join {basins} b
        on b.next_down = u.hid and not array_contains(u.path, b.hid) where u.depth < {depth})
        select distinct root, hid from (select * from up limit all) where if(depth < {depth}, true, raise_error('a river has {depth} steps or more: raise depth or use upstream()'))"""


def numbered_times(rows: DataFrame) -> DataFrame:
    """(time, k, n): the distinct times in order from 0, and how many there are. Times are numbered within their days, and days by
    a running sum over one short list, so no task sorts the whole axis."""
    times = rows.select("time").distinct().withColumn("day", F.to_date("time"))
    inside = times.withColumn("__k", F.row_number().over(Window.partitionBy("day").orderBy("time")) - 1)
    days = times.groupBy("day").agg(F.count("*").alias("m")).agg(F.array_sort(F.collect_list(F.struct("day", "m"))).alias("days"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.array(F.struct(x["day"].alias("day"), s["n"].alias("before")))).alias("out"), (s["n"] + x["m"]).alias("n"))
    start = F.struct(F.array().cast("array<struct<day:date,before:bigint>>").alias("out"), F.lit(0).cast("long").alias("n"))
    placed = days.select(F.aggregate("days", start, step).alias("s")).select(F.explode("s.out").alias("d"), "s.n").select("d.day", "d.before", "n")
    return inside.join(placed, "day").select("time", (F.col("before") + F.col("__k")).alias("k"), "n")


def shifted_inflow(members: DataFrame, runoff_rows: DataFrame, flowspeed: float = 1.0) -> DataFrame:
    """(plant, time, v): runoff of all upstream basins, each rolled by its travel time (whole hours, wrapping at the end).

    members: plant, hid, distance (km up the river from the plant); runoff_rows: hid, time, v over one common time axis. Basins of a plant that are
    equally far in hours are rolled as one. Nothing is broadcast unless Spark finds it small.
    """
    axis = written(numbered_times(runoff_rows), "times")
    hours = F.floor(F.col("distance") / num(flowspeed * 3.6) + num(0.5)).cast("int")
    groups = members.select("plant", "hid", hours.alias("hours"))
    rows = runoff_rows.join(groups, "hid").groupBy("plant", "hours", "time").agg(F.sum("v").alias("v"))
    moved = rows.join(axis, "time").groupBy("plant", F.pmod(F.col("k") + F.col("hours"), F.col("n")).alias("k")).agg(F.sum("v").alias("v"))
    return moved.join(axis.select("time", "k"), "k").select("plant", "time", "v")


def basin_weights(indicator: DataFrame) -> DataFrame:
    """Shares of cells in a basin, normalised to 1 for each basin; nothing for an empty one."""
    sums = indicator.groupBy(F.col("shape_id").alias("s")).agg(F.sum("share").alias("total"))
    return indicator.join(sums, F.col("shape_id") == F.col("s")).select(F.col("shape_id").alias("bus"), "cell_id", zero(F.try_divide("share", "total")).alias("w"))


def line_azimuth(points: Column) -> Column:
    """Radians clockwise from north, from the ends of the line; a line has no direction, so within [0, pi)."""
    a, b = points[0], F.element_at(points, -1)
    angle = F.atan2(a["x"] - b["x"], a["y"] - b["y"])
    return F.when(angle < 0, angle + num(3.141592653589793)).otherwise(angle)


def line_rating(weather: DataFrame, grid: DataFrame, lines: DataFrame, compat: bool = True, **params) -> DataFrame:
    """(line, time, v): the least limit over the cells that a line meets; NULL where it meets none.

    lines: shape_id, pts, resistance. ``compat`` passes the azimuth on as if it were degrees; False uses it as radians.
    """
    met = intersection_matrix(grid, lines, lines=True)
    placed = lines.select("shape_id", "resistance", line_azimuth(F.col("pts")).alias("psi"))
    pairs = met.join(placed, "shape_id")
    limit = line_limit(F.col("psi"), F.col("resistance"), psi_unit="deg" if compat else "rad", **params)
    rows = weather.join(pairs, "cell_id").select("shape_id", "time", limit.alias("v")).groupBy("shape_id", "time").agg(F.min("v").alias("v"))
    beside = lines.join(met, "shape_id", "left_anti").select("shape_id")
    if not beside.isEmpty():  # a job over lines and cells only; without such lines the weather is not read for its times
        missing = F.broadcast(weather.select("time").distinct()).crossJoin(beside).select("shape_id", "time", F.lit(None).cast("double").alias("v"))
        rows = rows.unionByName(missing)
    return rows.withColumnRenamed("shape_id", "line")
