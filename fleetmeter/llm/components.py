"""Connected components of a graph given by its edges."""

from pyspark.sql import functions as F

from fleetmeter.sources.staging import staged


def connected(edges):
    """(node, component) of every node of `edges` (lower, upper): the smallest node reached.

    Each round a node takes the least label among its own, its neighbours' and that
    of the node its label names, so paths shorten fast. Labels are written each
    round: both sides of the join with the edges are then shuffled as they are, and a
    node that holds a third of all edges can be split.
    """
    both = staged(edges.select(F.col("lower").alias("a"), F.col("upper").alias("b")).unionByName(
        edges.select(F.col("upper").alias("a"), F.col("lower").alias("b"))), "graph-edges")
    labels = both.groupBy("a").agg(F.min("b").alias("least"))
    labels = staged(labels.select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "graph-labels")
    while True:
        named = labels.select(F.col("node").alias("named"), F.col("component").alias("further"))
        told = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("told"))
        after = labels.join(told, labels["node"] == told["a"], "left").join(
            named, labels["component"] == F.col("named"), "left"
        ).select("node", F.col("component").alias("old"), F.least("component", "told", "further").alias("component"))
        after = staged(after, "graph-labels")
        labels = after.select("node", "component")
        if after.where("old <> component").isEmpty():
            return labels


def merged(components, links):
    """`components` (node, component) after links between nodes of different ones."""
    lower = components.select(F.col("node").alias("lower"), F.col("component").alias("a"))
    upper = components.select(F.col("node").alias("upper"), F.col("component").alias("b"))
    between = links.join(lower, "lower").join(upper, "upper").where("a <> b").select(
        F.least("a", "b").alias("lower"), F.greatest("a", "b").alias("upper")).distinct()
    renamed = connected(between).select(F.col("node").alias("component"), F.col("component").alias("new"))
    return staged(components.join(renamed, "component", "left").select(
        "node", F.coalesce("new", "component").alias("component")), "graph-components")
