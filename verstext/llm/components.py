"""Connected components of a table of links, as joins and grouped minima."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from verstext.runtime import materialise


def merge_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Join the sets of ``left[i]`` and ``right[i]``; a label is the smallest index of its set."""
    while len(left):
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while True:  # follow the labels down to their roots
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped
    return labels


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component`` for every node with a link; the component is its smallest node.

    Alternates two rewrites until each node points at a root: point a node's parent at the parent's
    own smallest neighbour, then point all of a node's parents at the smallest. Each round is
    written to the shared folder, so a lost executor costs one round. A node without a link to
    another node, or with a NULL end, has no row. An empty table gives an empty table.
    """
    edges = links.select(
        F.greatest(left, right).alias("child"), F.least(left, right).alias("parent")
    ).where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    state = materialise(edges.distinct(), "links")
    while True:
        lowest = state.groupBy("child").agg(F.min("parent").alias("low"))
        above = lowest.select(F.col("child").alias("parent"), F.col("low").alias("up"))
        lifted = state.join(above, "parent", "left").select("child", F.coalesce("up", "parent").alias("parent"))
        smallest = lifted.groupBy("child").agg(F.min("parent").alias("low"))
        both = lifted.join(smallest, "child")
        rows = F.array(
            F.struct(F.col("child"), F.col("low").alias("parent")),
            F.struct(F.col("parent").alias("child"), F.col("low").alias("parent")),
        )
        turned = both.select(F.explode(rows).alias("e")).select("e.*").where("child != parent").distinct()
        state = materialise(turned, "links")
        several = state.groupBy("child").count().where("count > 1").select("child")
        parents = state.select(F.col("parent").alias("child")).join(state.select("child"), "child", "left_semi")
        if several.unionAll(parents).isEmpty():
            return state.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionAll(
                state.select("parent", "parent").distinct()
            )
