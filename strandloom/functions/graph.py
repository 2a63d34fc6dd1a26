"""Connected components, prefix sums and dense numbering as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Keys in a range of the prefix sums; only the ranges' sums meet in one window.
RANGE = 1 << 16


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (u, v): component is the same, and one of its nodes, within a component.

    Every node points at its least neighbour, pointers are followed twice, edges are renamed by them and those inside
    a tree dropped, until none is left: the number of nodes at least halves in a round.
    """
    edges, steps = stored(edges.select("u", "v").where("u <> v"), "edges"), []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "near")
        step = lambda x, near=near: x.join(near.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p").select("u", F.col("pp").alias("p"))
        to = stored(step(step(step(near))), "to")
        steps.append(to)
        a, b = to.select("u", F.col("p").alias("pu")), to.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = stored(edges.join(a, "u").join(b, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    labels = steps[0].select(F.col("u").alias("node"), F.col("p").alias("component"))
    for to in steps[1:]:  # one join a round, and rounds are as many as the logarithm of the nodes
        labels = labels.join(to.select(F.col("u").alias("component"), F.col("p").alias("up")), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return labels


def before(rows: DataFrame, key: str, value: Column, width: int = RANGE) -> DataFrame:
    """(key, before): the sum of value over all rows of smaller keys, for each key; keys are non-negative longs."""
    own = rows.groupBy(F.col(key).cast("long").alias(key)).agg(F.sum(value).alias("v")).withColumn("range", F.floor(F.col(key) / width))
    earlier = lambda by: F.coalesce(F.sum("v").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = own.groupBy("range").agg(F.sum("v").alias("v")).select("range", earlier(Window.orderBy("range")).alias("start"))
    inside = own.withColumn("inside", earlier(Window.partitionBy("range").orderBy(key)))
    return inside.join(ranges, "range").select(key, (F.col("start") + F.col("inside")).alias("before"))


def dense(values: DataFrame, column: str, width: int = RANGE) -> DataFrame:
    """(column, rank): the place from 0 of each distinct non-negative long in order."""
    own = values.select(F.col(column).cast("long").alias(column)).distinct()
    return before(own, column, F.lit(1), width).withColumnRenamed("before", "rank")
