"""Graph kernels over edge tables: reachability, strongly connected components, components.

Rounds are driver loops whose state is written to the shared folder (or checkpointed), since
WITH RECURSIVE has no set semantics on cyclic graphs. Frontiers shrink, and pairs are kept distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.operators.tables import settle


def reachable(edges: DataFrame, seeds: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node) reachable from seeds (node) over edges (src, dst) in any number of hops, seeds included."""
    edges = edges.select("src", "dst").distinct()
    known = settle(seeds.select("node").distinct())
    frontier = known
    for _ in range(max_rounds):
        found = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = settle(found.join(known, "node", "left_anti"))
        if frontier.isEmpty():
            return known
        known = settle(known.union(frontier))
    raise RuntimeError("reachability did not settle")


def components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, label): the least node of each undirected component; minimum labels with pointer jumping."""
    both = settle(edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct())
    labels = settle(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("label")).withColumnRenamed("src", "node"))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        moved = settle(least.join(jump, "new").select("node", "old", F.least("new", "far").alias("label")))
        labels = moved.select("node", "label")
        if moved.filter("label < old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def strong_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, label) for nodes on cycles: label is the least node that reaches the node and is reached by it.

    Nodes without an edge in or out can't be on a cycle and are trimmed first, again and again; what is left is
    coloured by least reaching node, and each colour's root takes the nodes that reach it back; then the rest goes on.
    Work is proportional to edges by round; the transitive closure is never built.
    """
    left = settle(edges.select("src", "dst").filter("src <> dst").distinct())
    out = None
    for _ in range(max_rounds):
        while True:  # trim
            kept = settle(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if kept.count() == left.count():
                break
            left = kept
        if left.isEmpty():
            return out if out is not None else left.select(F.col("src").alias("node"), F.col("src").alias("label"))
        colour = settle(left.select(F.col("src").alias("node")).union(left.select(F.col("dst"))).distinct().withColumn("label", F.col("node")))
        while True:  # least reaching node
            pushed = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("in"))
            new = settle(colour.join(pushed, "node", "left").select("node", F.least("label", F.coalesce("in", "label")).alias("label"), (F.col("in") < F.col("label")).alias("moved")))
            colour = new.select("node", "label")
            if new.filter("moved").isEmpty():
                break
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").filter("a = b")
        inside = settle(inside.select("src", "dst", F.col("a").alias("label")))
        found = settle(colour.filter("node = label").select("node", "label"))
        frontier = found
        while not frontier.isEmpty():  # backwards within the colour
            back = inside.join(frontier.select(F.col("node").alias("dst"), "label"), ["dst", "label"]).select(F.col("src").alias("node"), "label").distinct()
            frontier = settle(back.join(found, ["node", "label"], "left_anti"))
            found = settle(found.union(frontier))
        out = found if out is None else settle(out.union(found))
        left = settle(left.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    raise RuntimeError("strong components did not settle")


def cycles(edges: DataFrame) -> DataFrame:
    """(label, node, size) of strongly connected components of two nodes and more."""
    found = strong_components(edges)
    sizes = found.groupBy("label").agg(F.count(F.lit(1)).alias("size")).filter("size >= 2")
    return found.join(sizes, "label")
