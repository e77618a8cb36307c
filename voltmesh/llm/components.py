"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links -> (id, component): the smallest id reachable, for each id in a link.

    A round lets each node take the smallest label among its neighbours (a partial minimum before the shuffle, so a
    hub sends one row from each task) and then the label of its label, which halves long chains. Labels and links are
    written tables, so joins read two plain exchanges that skew handling can split. Self links, repeated and reversed
    links change nothing; null ends are not links.
    """
    edges = edges.where("a is not null and b is not null")
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        heard = both.join(labels, F.col("a") == F.col("id")).groupBy(F.col("b").alias("to")).agg(F.min("label").alias("low"))
        hooked = scratch.save(labels.join(heard, F.col("id") == F.col("to"), "left").select("id", F.col("label").alias("was"), F.least("label", "low").alias("label")), "hooked")
        up = hooked.select(F.col("id").alias("at"), F.col("label").alias("top"))
        after = scratch.save(hooked.join(up, F.col("label") == F.col("at"), "left").select("id", "was", F.least("label", "top").alias("label")), "labels")
        scratch.drop(hooked)
        scratch.drop(labels)
        done = after.where("label <> was").isEmpty()
        labels = after.select("id", "label")
        if done:
            scratch.drop(both)
            return labels.withColumnRenamed("label", "component")
