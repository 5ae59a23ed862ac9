"""Connected components of a link table by minimum labels with pointer jumping, each round written to the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the smallest node reachable.

    A round takes the least label over a node's links (partial minima before the shuffle) and then the label of
    that label, so the number of rounds grows with the logarithm of a chain's length.
    """
    both = scratch.keep(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), f"{name}-both")
    labels = scratch.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), f"{name}-0")
    for n in range(1, 1000):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jumped = least.join(labels.select(F.col("node").alias("new"), F.col("label").alias("far")), "new").select("node", F.least("new", "far").alias("label"), (F.least("new", "far") < F.col("label")).alias("moved"))
        kept = scratch.keep(jumped, f"{name}-{n}")
        labels = kept.select("node", "label")
        moved = kept.filter("moved").limit(1).count()
        if n > 1:
            scratch.drop(f"{name}-{n - 1}")
        if not moved:
            scratch.drop(f"{name}-both")
            return labels
    raise RuntimeError("components did not settle")


def block_components(linked: np.ndarray, ka: np.ndarray, kb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, labels) of the linked keys of two blocks: the least key that each reaches within them. Equal keys on both sides are one node."""
    some_a, some_b = linked.any(1), linked.any(0)
    sub, na, nb = linked[some_a][:, some_b], ka[some_a], kb[some_b]
    if not sub.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    row, col = np.nonzero(sub)
    by_col = np.argsort(col, kind="stable")
    row_starts, col_starts = np.flatnonzero(np.diff(row, prepend=-1)), np.flatnonzero(np.diff(col[by_col], prepend=-1))
    la, lb = na.copy(), nb.copy()
    _, ia, ib = np.intersect1d(na, nb, return_indices=True)
    while True:
        ma = np.minimum(la, np.minimum.reduceat(lb[col], row_starts))
        mb = np.minimum(lb, np.minimum.reduceat(ma[row[by_col]], col_starts))
        ma[ia] = mb[ib] = np.minimum(ma[ia], mb[ib])
        if (ma == la).all() and (mb == lb).all():
            return np.concatenate([na, nb]), np.concatenate([la, lb])
        la, lb = ma, mb


def edge_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, labels) of edges between keys a[i] and b[i]: the least key that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        li, lj, new = label[i], label[j], label.copy()
        low = np.minimum(li, lj)
        for end in (i, j, li, lj):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new
