"""Connected components of a link table by alternating large and small stars; nothing is gathered on the driver but two flags a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kinetrace.plans.shared import Scratch


def components(links: DataFrame, temp: Scratch, name: str) -> DataFrame:
    """(a, b) links to (node, component): the smallest node that can be reached; nodes without a link to another are left out. The result is a table `name` of `temp`.

    Large star: a node's larger neighbours are linked to its smallest. Small star: its smaller ones are. Both keep what is
    connected connected, and after a number of rounds logarithmic in the longest path each node is linked to its component alone.
    Links point from the larger to the smaller end, so the larger neighbours of a star's centre are rows whose only match is the
    centre's own smallest neighbour: an equi-join of two stored tables, which Spark splits where the centre is hot. When every
    larger end has one link, to a node that is no larger end itself, all are stars; the jobs of a round tell that on their way.
    """
    with Scratch(links.sparkSession) as own:
        edges = own.stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        while not edges.isEmpty():
            several, chained = Observation(), Observation()
            lower = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).observe(several, F.max(F.col("n") > 1).alias("any"))
            lower = own.stored(lower.select("u", "m"), "lower")
            large = edges.join(lower.select(F.col("u").alias("v"), "m"), "v", "left").observe(chained, F.max(F.col("m").isNotNull()).alias("any"))
            large = own.stored(large.select("u", F.coalesce("m", "v").alias("v")).distinct(), "large")
            if not several.get["any"] and not chained.get["any"]:
                break
            least = own.stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
            both = large.join(least, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
            edges = own.stored(both.filter("u <> v").distinct(), "edges")
        found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return temp.stored(found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), name)
