"""Connected components by hooking to the smallest neighbour and pointer jumping, all on tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); root is one node per component.

    Each round every node hooks to its smallest neighbour if that is smaller; chains of hooks are
    shortened until they end at roots; links between different roots go into the next round. Rounds
    and jumps are logarithmic for ids that are hashes. Every step is an equi-join or a combined
    minimum, so a star of any size is only partial minima; nothing is collected.
    """
    edges = store(links.select("a", "b").filter("a <> b").distinct())
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = store(both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("root")))
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = store(hook.join(up, "root").select(
                "node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            hook = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = hook
        else:
            moves = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = store(labels.join(moves, "root", "left").select(
                "node", F.coalesce("above", "root").alias("root")))
        left, right = (hook.select(F.col("node").alias(c), F.col("root").alias("r" + c))
                       for c in ("a", "b"))
        edges = store(edges.join(left, "a").join(right, "b").filter("ra <> rb").select(
            F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        if edges.isEmpty():
            return labels


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what the matrix ``near`` connects, at most one per row and column.

    a numbers rows and then columns, b is the first row of a's component.
    """
    n = len(near)
    rows = np.where(near.any(1), np.arange(n), n)
    while True:
        columns = np.where(near, rows[:, None], n).min(0, initial=n)
        again = np.minimum(rows, np.where(near, columns[None, :], n).min(1, initial=n))
        if (again == rows).all():
            break
        rows = again
    root = np.concatenate([rows, columns])
    linked = np.flatnonzero(root < n)
    return linked, root[linked]
