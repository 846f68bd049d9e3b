"""Connected components by contraction.

In each round every node joins the neighbour (or itself) that comes first in a random order drawn anew,
and edges move to the nodes so chosen. A constant share of the nodes goes in every round whatever the
graph's shape, paths and stars included, so rounds grow with the logarithm of its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.llm.shared import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); a component is named by its smallest node.

    Loops and repeated or reversed edges do no harm; no edges give no rows; null ends are ignored.
    """
    now = saved(edges.where("a is not null and b is not null and a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), "edges")
    maps, k = [], 0
    while not now.isEmpty():
        k += 1
        both = now.unionAll(now.selectExpr("b a", "a b"))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", F.lit(k)).alias("h"), F.col("b"))).alias("m"))
        own = F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("b"))
        maps.append(chosen := saved(first.select("node", F.least(own, "m")["b"].alias("label")), "chosen"))
        ends = now.join(chosen.toDF("a", "x"), "a").select("x", "b").join(chosen.toDF("b", "y"), "b")
        now = saved(ends.where("x <> y").selectExpr("least(x, y) a", "greatest(x, y) b").distinct(), "edges")
    if not maps:
        return now.selectExpr("a node", "b component")
    last = maps.pop()
    while maps:
        last = maps.pop().join(last.toDF("label", "root"), "label", "left").selectExpr("node", "coalesce(root, label) label")
    last = saved(last, "labels")
    return last.join(saved(last.groupBy("label").agg(F.min("node").alias("component")), "roots"), "label").select("node", "component")
