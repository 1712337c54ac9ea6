"""Near-duplicate vectors by int8 tile products with error bounds for each vector.

A unit vector x is stored as scale times whole numbers of -127..127, with the length e of what is
lost. Products of whole numbers are exact in single precision, and for two vectors the product of
the rounded ones is off by at most ``e_x + (1 + e_x) * e_y``. A tile product therefore settles
nearly all pairs; a pair whose bound still reaches the threshold is computed again in double
precision from the given components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verstext.llm.components import components, merge_labels
from verstext.runtime import materialise

TILE_ROWS = 2048
BLOCK_ROWS = 1024
SLACK = 1e-6


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers, scale and length of the rest of each row of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None])
    rest = np.linalg.norm(unit - whole * scale[:, None], axis=1)
    return whole.astype(np.int8), scale, rest


def tile_links(vectors: np.ndarray, copies: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float):
    """For the pairs of rows ``first`` x ``second``: links of each row, and the sets they form.

    Returns the number of linked vectors of each row (copies counted) and the smallest linked
    position of each row's set. Pairs are not listed; memory is one block product.
    """
    # powers of two change no digit and keep squares of very large and very small components finite
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / norms[:, None]
    whole, scale, rest = quantise(unit)
    exact = vectors.shape[1] * 127 * 127 < 1 << 24
    wide = whole.astype(np.float32 if exact else np.float64)
    links = np.zeros(len(vectors), dtype=np.int64)
    labels = np.arange(len(vectors))
    same = first is second
    for i in range(0, len(first), BLOCK_ROWS):
        a = first[i : i + BLOCK_ROWS]
        for j in range(i if same else 0, len(second), BLOCK_ROWS):
            b = second[j : j + BLOCK_ROWS]
            rough = (wide[a] @ wide[b].T).astype(np.float64) * scale[a][:, None] * scale[b]
            bound = rest[a][:, None] + (1 + rest[a])[:, None] * rest[b]
            maybe = rough + bound + SLACK >= threshold
            if same and i == j:
                maybe &= np.tri(len(a), len(b), -1, dtype=bool).T  # each pair once
            x, y = np.nonzero(maybe)
            for at in range(0, len(x), 1 << 17):
                u, v = a[x[at : at + (1 << 17)]], b[y[at : at + (1 << 17)]]
                near = np.einsum("ij,ij->i", vectors[u], vectors[v]) / (norms[u] * norms[v]) >= threshold
                u, v = u[near], v[near]
                links += np.bincount(u, weights=copies[v], minlength=len(links)).astype(np.int64)
                links += np.bincount(v, weights=copies[u], minlength=len(links)).astype(np.int64)
                labels = merge_labels(labels, u, v)
    return links, labels


def cell_links(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One row for each vector of a cell that has links in it."""
    rows = rows.sort_values("node", ignore_index=True)
    vectors = np.stack([np.asarray(v, dtype=np.float64) for v in rows["vector"]])
    tile, copies = rows["tile"].to_numpy(), rows["copies"].to_numpy()
    low, high = np.flatnonzero(tile == rows["low"].iloc[0]), np.flatnonzero(tile == rows["high"].iloc[0])
    second = low if rows["low"].iloc[0] == rows["high"].iloc[0] else high
    links, labels = tile_links(vectors, copies, low, second, threshold)
    node = rows["node"].to_numpy()
    found = pd.DataFrame({"node": node, "links": links, "linked": node[labels]})
    return found[(found["links"] > 0) | (found["linked"] != found["node"])]


def near_vectors(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding",
                 label: str = "label", tile_rows: int = TILE_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors are compared when their labels are equal and not NULL and they have the same number of
    components. A vector that is NULL, empty, zero or holds a NULL or non-finite component links
    with nothing: ``n_links`` 0 and its own component. Rows with equal vectors of a label link with each other
    and are searched as one node. A repeated key counts as a further vector, each row with the links of its own
    label and vector. A NULL key has a NULL component and links nothing. Keys must be
    integers. An empty table gives an empty result.

    The vectors of a label are dealt by hash to tiles of about ``tile_rows`` and every pair of
    tiles is one task, so a label that holds a third of all rows is cut like any other, and a task
    holds two tiles. All pairs of a label are compared, as cosine in double precision has to be
    exact, but only sets and counts leave a task: one row for each vector, not one for each pair.
    """
    size = F.transform(vector, lambda x: F.abs(x.cast("double")))
    finite = F.forall(size, lambda x: x.isNotNull() & ~F.isnan(x) & (x < F.lit(float("inf"))))
    usable = F.col(label).isNotNull() & F.col(key).isNotNull() & finite & F.exists(size, lambda x: x > 0)
    rows = vectors.select(
        F.col(key).alias("key"), F.col(label).alias("label"),
        F.when(F.coalesce(usable, F.lit(False)), F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))).alias("vector"),
    )
    # two hashes stand for the vector wherever rows meet again
    same = ["label", "hash", "hash_back"]
    rows = rows.withColumns({"hash": F.xxhash64("vector"), "hash_back": F.xxhash64(F.reverse("vector"), F.lit(1))})
    good = rows.where(F.col("vector").isNotNull())
    distinct = good.groupBy(*same, "vector").agg(F.min("key").cast("long").alias("low"), F.count(F.lit(1)).alias("copies"))
    distinct = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct_vectors")
    shape = ["label", "dim"]
    sized = distinct.withColumn("dim", F.size("vector"))
    tiles = sized.groupBy(*shape).agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles"))
    placed = sized.join(tiles, shape).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = placed.withColumn("other", other).select(
        "label", "dim", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "copies", "vector"
    )
    found = dealt.groupBy("label", "dim", "low", "high").applyInPandas(
        lambda cell: cell_links(cell, threshold), "node long, links long, linked long"
    )
    found = materialise(found, "vector_links")
    n_links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found, "node", "linked")
    sets = distinct.select(*same, "node", "copies", "low").join(n_links, "node", "left").join(joined, "node", "left").select(
        *same, "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("set")
    )
    sets = materialise(sets, "vector_sets")
    lowest = sets.groupBy("set").agg(F.min("low").alias("component"))
    answer = materialise(sets.join(lowest, "set").select(*same, "n_links", "component"), "vector_answers")
    linked = rows.select("key", *same, F.col("vector").isNotNull().alias("good")).join(answer.withColumn("good", F.lit(True)), [*same, "good"], "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "key")).cast("long")
    return linked.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"), (F.col("key") == component).alias("kept"),
    )
