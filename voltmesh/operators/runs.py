"""Runs of pixels: rows (by, py, x0, x1) stand for the pixels x0 to x1 of a row, both included.

Union, intersection and difference sort the ends of runs within a row of pixels and count what is open; so they cost runs, however
many pixels these have. ``by`` names the columns that tell sets apart (none: one set).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runs of different sets meet by stretches of so many pixels of a row.
TILE = 1024


def _ends(runs: DataFrame, by: list[str], a: int, b: int) -> DataFrame:
    """A row where a run begins and one behind its end, with what it opens (1) or closes (-1) of the first and of the second set."""
    end = lambda x, sign: F.struct(x.alias("x"), F.lit(sign * a).alias("a"), F.lit(sign * b).alias("b"))
    return runs.select(*by, "py", F.explode(F.array(end(F.col("x0"), 1), end(F.col("x1") + 1, -1))).alias("e")).select(*by, "py", "e.*")


def _open(ends: DataFrame, by: list[str], keep: Column) -> DataFrame:
    """Longest runs over which ``keep``, a condition on the numbers of open runs ``a`` and ``b``, holds."""
    sums = ends.groupBy(*by, "py", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    row = Window.partitionBy(*by, "py").orderBy("x")
    upto = row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = sums.withColumns({"a": F.sum("a").over(upto), "b": F.sum("b").over(upto)}).select(*by, "py", "x", keep.alias("on"))
    changed = state.withColumn("was", F.lag("on", 1, False).over(row)).where("on <> was")
    return changed.withColumn("x1", F.lead("x").over(row) - 1).where("on").select(*by, "py", F.col("x").alias("x0"), "x1")


def union(runs: DataFrame, by: list[str]) -> DataFrame:
    """The same pixels in runs that neither overlap nor touch."""
    return _open(_ends(runs, by, 1, 0), by, F.col("a") > 0)


def subtract(runs: DataFrame, less: DataFrame, by: list[str]) -> DataFrame:
    """Pixels of the first set without those of the second."""
    return _open(_ends(runs, by, 1, 0).unionByName(_ends(less, by, 0, 1)), by, (F.col("a") > 0) & (F.col("b") == 0))


def intersect(runs: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """Pixels of both sets."""
    return _open(_ends(runs, by, 1, 0).unionByName(_ends(other, by, 0, 1)), by, (F.col("a") > 0) & (F.col("b") > 0))


def _tiled(runs: DataFrame) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / TILE).cast("int")
    return runs.withColumn("tile", F.explode(F.sequence(at("x0"), at("x1"))))


def meet(runs: DataFrame, common: DataFrame, by: list[str]) -> DataFrame:
    """Where the runs of each set meet those of one common set, which has no ``by``: pieces that may touch each other.

    Both are joined by row and TILE pixels of it, so a row that many sets cross is not one group.
    """
    other = _tiled(common).select("py", "tile", F.col("x0").alias("o0"), F.col("x1").alias("o1"))
    pairs = _tiled(runs.select(*by, "py", "x0", "x1")).join(other, ["py", "tile"])
    low, high = F.greatest("x0", "o0", F.col("tile") * TILE), F.least("x1", "o1", F.col("tile") * TILE + (TILE - 1))
    return pairs.select(*by, "py", low.alias("x0"), high.alias("x1")).where("x0 <= x1")


def dilate(runs: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Pixels within n steps (|dx| + |dy| <= n): each run gives 2 n + 1 runs, however long it is."""
    near = runs.withColumn("dy", F.explode(F.sequence(F.lit(-n), F.lit(n))))
    left = F.lit(n) - F.abs("dy")
    return union(near.select(*by, (F.col("py") + F.col("dy")).alias("py"), (F.col("x0") - left).alias("x0"), (F.col("x1") + left).alias("x1")), by)


def of_pixels(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Runs of single pixels (by, px, py), repeated ones too."""
    return union(pixels.select(*by, "py", F.col("px").alias("x0"), F.col("px").alias("x1")), by)


def pixels(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, px, py), a row for each pixel of runs that do not overlap."""
    return runs.select(*by, F.explode(F.sequence("x0", "x1")).alias("px"), "py")


def length() -> Column:
    return F.col("x1") - F.col("x0") + 1
