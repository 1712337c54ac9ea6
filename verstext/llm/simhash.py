"""SimHash fingerprints and a Gray-order hierarchical index for all pairs within a few bits.

Fingerprints that differ in at most ``distance`` of 64 bits agree in at least one of
``distance + 1`` bands. The bits of a band are the top nodes of the index: a node of band value v
holds the fingerprints with these bits, and a search enters the nodes that it has no difference
to. Inside a node the fingerprints are sorted by Gray rank, so that neighbours share most bits. A
group of neighbours becomes an upper node with the mask of the bits they share and their common
pattern; what an upper node has factored out is left out below. A search adds up the differences
to the patterns on its way down, drops a group as soon as the sum is too large and accepts a whole
group when its open bits cannot bring the sum above the limit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from verstext.llm.components import components, merge_labels
from verstext.llm.rows import map_keyed
from verstext.runtime import materialise

FAN = 8
CELL_ROWS = 40_000
QUERY_ROWS = 4096


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the word shingles of one text, as a signed 64-bit number; no words give 0."""
    words = text.lower().split()  # bytes: A-Z and the white space x20, x09-x0D only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, view = xxhash.xxh64_intdigest, memoryview(line)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), 16384):
        pieces = zip(starts[at : at + 16384].tolist(), ends[at : at + 16384].tolist(), strict=True)
        hashes = np.array([digest(view[s:e], 42) for s, e in pieces], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; level 0 are the fingerprints."""

    def __init__(self, codes: np.ndarray):
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        masks, patterns = [np.full(len(codes), full)], [codes]
        while len(masks[-1]) > FAN:
            first = np.arange(0, len(masks[-1]), FAN)
            every = np.bitwise_and.reduceat(patterns[-1], first)
            some = np.bitwise_or.reduceat(patterns[-1], first)
            shared = np.bitwise_and.reduceat(masks[-1], first) & ~(every ^ some)
            masks.append(shared)
            patterns.append(every & shared)
        self.patterns, self.masks = patterns, masks
        # below an upper node only the bits that it has not factored out are compared
        self.rest = [m & ~np.repeat(masks[k + 1], FAN)[: len(m)] if k + 1 < len(masks) else m for k, m in enumerate(masks)]

    def links(self, codes: np.ndarray, queries: np.ndarray, labels: np.ndarray, distance: int):
        """Pairs (query, fingerprint) within the distance that are not yet in one set.

        Pairs of one set need no search: only sets are asked for. A group that is accepted as a
        whole is linked through its fingerprints without comparing them one by one.
        """
        found = []
        top = len(self.patterns) - 1
        query = np.repeat(queries, len(self.patterns[top]))
        node = np.tile(np.arange(len(self.patterns[top])), len(queries))
        total = np.zeros(len(query), dtype=np.int64)
        for level in range(top, -1, -1):
            differ = (codes[query] ^ self.patterns[level][node]) & self.rest[level][node]
            total = total + np.bitwise_count(differ)
            near = total <= distance
            query, node, total = query[near], node[near], total[near]
            if level == 0:
                apart = labels[query] != labels[node]
                found.append((query[apart], node[apart]))
                break
            width = FAN**level
            low, high = node * width, np.minimum((node + 1) * width, len(codes)) - 1
            one_set = self.uniform[level][node] & (labels[query] == labels[low])
            whole = ~one_set & (total + np.bitwise_count(~self.masks[level][node]) <= distance)
            if whole.any():
                sizes = (high - low + 1)[whole]
                inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                found.append((np.repeat(query[whole], sizes), np.repeat(low[whole], sizes) + inside))
            go = ~one_set & ~whole
            query, node, total = query[go], node[go], total[go]
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            real = child < len(self.patterns[level - 1])
            query, total, node = np.repeat(query, FAN)[real], np.repeat(total, FAN)[real], child[real]
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def sets(self, distance: int) -> np.ndarray:
        """For each fingerprint the smallest position of its set of linked fingerprints."""
        codes = self.patterns[0]
        labels = np.arange(len(codes))
        step = np.flatnonzero(np.bitwise_count(codes[1:] ^ codes[:-1]) <= distance)
        labels = merge_labels(labels, step, step + 1)  # neighbours in Gray order come first
        for start in range(0, len(codes), QUERY_ROWS):
            self.uniform = [np.ones(len(codes), dtype=bool)]
            for level in range(1, len(self.patterns)):
                first = np.arange(0, len(codes), FAN**level)
                self.uniform.append(np.minimum.reduceat(labels, first) == np.maximum.reduceat(labels, first))
            queries = np.arange(start, min(start + QUERY_ROWS, len(codes)))
            left, right = self.links(codes, queries, labels, distance)
            labels = merge_labels(labels, left, right)
        return labels


def small_nodes(codes: np.ndarray, value: np.ndarray, distance: int) -> np.ndarray:
    """Sets of a cell whose top nodes are small: all nodes are searched at once.

    A fingerprint meets the groups of its node; the groups do not reach over the end of a node.
    """
    labels = np.arange(len(codes))
    new = np.concatenate(([True], value[1:] != value[:-1]))
    begin = np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))
    first = np.flatnonzero(new | ((np.arange(len(codes)) - begin) % FAN == 0))
    group = np.searchsorted(first, np.arange(len(codes)), side="right") - 1
    stops = np.append(first[1:], len(codes))
    every, some = np.bitwise_and.reduceat(codes, first), np.bitwise_or.reduceat(codes, first)
    shared = ~(every ^ some)
    last_group = np.searchsorted(first, np.append(np.flatnonzero(new)[1:], len(codes)), side="left") - 1
    end = last_group[np.cumsum(new) - 1]
    for start in range(0, len(codes), QUERY_ROWS):
        rows = np.arange(start, min(start + QUERY_ROWS, len(codes)))
        sizes = end[rows] - group[rows] + 1
        query = np.repeat(rows, sizes)
        node = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + group[query]
        total = np.bitwise_count((codes[query] ^ every[node]) & shared[node]).astype(np.int64)
        near = total <= distance
        query, node, total = query[near], node[near], total[near]
        sizes = stops[node] - first[node]
        leaf = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[node], sizes)
        query, rest, total = np.repeat(query, sizes), np.repeat(~shared[node], sizes), np.repeat(total, sizes)
        total += np.bitwise_count((codes[query] ^ codes[leaf]) & rest)
        near = (total <= distance) & (query < leaf)
        labels = merge_labels(labels, query[near], leaf[near])
    return labels


def cell_links(rows: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Links of one cell, from each fingerprint to one of its set: at most one for each row."""
    codes = rows["fp"].to_numpy().view(np.uint64)
    value, rep = rows["value"].to_numpy(), rows["rep"].to_numpy()
    order = np.lexsort((gray_rank(codes), value))
    codes, value, rep = codes[order], value[order], rep[order]
    bounds = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1], [True])))
    sizes = np.diff(bounds)
    large = sizes > FAN * FAN
    small = np.repeat(~large, sizes)
    left, right = [], []
    if small.any():
        own = rep[small]
        labels = small_nodes(codes[small], value[small], distance)
        left.append(own)
        right.append(own[labels])
    for start, size in zip(bounds[:-1][large], sizes[large], strict=True):
        own = rep[start : start + size]
        labels = GrayIndex(codes[start : start + size]).sets(distance)
        left.append(own)
        right.append(own[labels])
    links = pd.DataFrame({"left": np.concatenate(left), "right": np.concatenate(right)})
    return links[links["left"] != links["right"]]


def fingerprints(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp`` of every row; a NULL text has no words, like an empty one."""

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return map_keyed(rows, lambda: lambda texts: (None, [[fingerprint(t, shingle) for t in texts]]), "fp long")


def near_links(distinct: DataFrame, distance: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``left, right`` keys that connect exactly the fingerprints within ``distance`` bits.

    ``distinct`` has each fingerprint once (``fp``) with the key that stands for it (``rep``). A
    band value with more than ``cell_rows`` fingerprints is cut into tiles by hash, and every
    pair of tiles is searched, so no task gets more than about two tiles of it. The other band
    values are dealt to as many cells as their number asks for.
    """
    n_bands = distance + 1
    width = -(-64 // n_bands)
    bands = [
        F.struct(F.lit(b).alias("band"), F.shiftrightunsigned("fp", b * width).bitwiseAND((1 << min(width, 64 - b * width)) - 1).alias("value"))
        for b in range(n_bands)
    ]
    placed = distinct.select("fp", "rep", F.explode(F.array(*bands)).alias("b")).select("fp", "rep", "b.*")
    cells = max(1, -(-distinct.count() * n_bands // cell_rows))
    crowded = placed.groupBy("band", "value").count().where(F.col("count") > cell_rows)
    tiles = crowded.select("band", "value", F.ceil(F.col("count") / cell_rows).cast("int").alias("tiles"))
    cut = placed.join(tiles, ["band", "value"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pairs = F.when(F.col("tiles").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.least(t, own) * F.col("tiles").cast("long") + F.greatest(t, own))
    )
    dealt = cut.withColumn("pair", F.explode(pairs))
    home = F.when(F.col("pair") < 0, F.pmod(F.xxhash64("band", "value"), F.lit(cells)).cast("string")).otherwise(
        F.concat_ws(":", "band", "value", "pair")
    )
    dealt = dealt.select(home.alias("cell"), (F.col("band") * (1 << width) + F.col("value")).alias("value"), "fp", "rep")
    return dealt.groupBy("cell").applyInPandas(lambda rows: cell_links(rows, distance), "left long, right long")


def fingerprint_sets(distinct: DataFrame, distance: int) -> DataFrame:
    """``fp, set``: for each fingerprint of ``distinct`` the smallest one that links reach.

    Fingerprints are the nodes, so rows that share an id but not their text stay apart.
    """
    own = distinct.select("fp", F.col("fp").alias("rep"))
    joined = components(near_links(own, distance), "left", "right")
    return distinct.join(joined, F.col("fp") == F.col("node"), "left").select(*distinct.columns, F.coalesce("component", "fp").alias("set"))


def near_duplicates(docs: DataFrame, shingle: int, distance: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``component_id`` is the smallest key that links of at most ``distance`` differing bits reach.
    Rows without words have fingerprint 0 and link like any other. A row with a NULL key is
    returned with a NULL component and links nothing; repeated rows are returned as often as they
    come, and rows that share a key are linked by their texts only. Keys must be integers. An empty
    table gives an empty result. Only fingerprints and keys are shuffled.
    """
    prints = materialise(fingerprints(docs, shingle, key, text), "fingerprints")
    keyed = prints.where(F.col("key").isNotNull())
    distinct = materialise(keyed.groupBy("fp").agg(F.min("key").cast("long").alias("low")), "distinct_fingerprints")
    sets = materialise(fingerprint_sets(distinct, distance), "fingerprint_sets")
    lowest = sets.groupBy("set").agg(F.min("low").alias("component"))
    owner = materialise(sets.join(lowest, "set").select("fp", "component"), "fingerprint_owners")
    return prints.join(owner, "fp", "left").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("key").isNotNull(), F.col("component")).alias("component_id"),
    )


def keep_first(docs: DataFrame, shingle: int, distance: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stand for their groups: one row for each group, all columns kept.

    The row with the smallest key stays; of rows that share the key as well, the one with the smallest hash
    of all its columns, and of rows equal in all columns any one. A row is judged by its own text: rows that
    share a key but are not linked stay both. Rows with a NULL key belong to no group and stay.
    """
    row = F.struct(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("text"), F.xxhash64(*docs.columns).alias("all"))
    marked = next(n for n in ("row", "row_", "row__") if n not in docs.columns)
    named = docs.where(F.col(key).isNotNull()).withColumn(marked, row)
    prints = materialise(fingerprints(named, shingle, marked, text), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("key").alias("low")), "distinct_fingerprints")
    lowest = fingerprint_sets(distinct, distance).groupBy("set").agg(F.min("low").alias(marked))
    stay = materialise(lowest.select(marked), "rows_kept")
    first = named.join(stay, marked, "left_semi").dropDuplicates([marked]).select(*docs.columns)
    return first.unionByName(docs.where(F.col(key).isNull()))
