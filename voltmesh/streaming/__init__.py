"""Conversions over streams: converters are Column functions, so stateless ones apply as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def convert_stream(rows: DataFrame, convert: Callable[[DataFrame], Column], weights: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """(bus, time, v) of a stream of weather rows: converted, weighted by a static table and summed in event-time windows.

    Rows later than ``late`` are left out; state is one sum for each bus and open window.
    """
    values = rows.withWatermark("time", late).select("cell_id", "time", convert(rows).alias("v"))
    met = values.join(weights.withColumnRenamed("w", "weight"), "cell_id")
    sums = met.groupBy("bus", F.window("time", width).alias("w")).agg(F.sum(F.col("v") * F.col("weight")).alias("v"))
    return sums.select("bus", F.col("w.start").alias("time"), "v")
