"""Near pairs of vectors: exact by cells around pivots, approximate by hashed projections, or only those of adjacent versions."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from verstext.operators.nearest import ranges, with_stretches
from verstext.runtime import materialise

PAIRS = "word_a long, word_b long, distance double"
LEAST_PIVOTS, MOST_PIVOTS = 16, 16_384
PART_WORDS = 1_000_000
BLOCK, OUT_ROWS = 2048, 100_000


def stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


class Pivots:
    """About the square root of N vectors that stand for cells, and the bounds that keep vectors apart.

    With ``unit`` all vectors have length 1 and distances are angles, which bound a third side
    more tightly than chords do. The pivots go with every task: at most ``MOST_PIVOTS`` of them.
    """

    def __init__(self, sample: pd.DataFrame, cutoff: float, unit: bool):
        self.centres = stack(sample["vector"])
        self.unit = unit
        self.cutoff = float(self.metric(np.array(cutoff))) + 1e-9
        self.reach = np.zeros(len(self.centres))
        # leading dimensions say most; which ones only matters for speed
        self.order = np.argsort(-self.centres.var(axis=0), kind="stable")

    def metric(self, chord: np.ndarray) -> np.ndarray:
        return 2 * np.arcsin(np.clip(chord / 2, 0, 1)) if self.unit else chord

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        square = (vectors * vectors).sum(1)[:, None] + (self.centres * self.centres).sum(1) - 2 * vectors @ self.centres.T
        return self.metric(np.sqrt(np.maximum(square, 0)))

    def home(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(vectors)
        at = d.argmin(axis=1)
        return at, d[np.arange(len(d)), at]

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, whether it is the row's home) of all cells that may hold something near a row."""
        d = self.distances(vectors)
        at, slack = d.argmin(axis=1), 1e-6
        may = (d <= d.min(axis=1, keepdims=True) + 2 * self.cutoff + slack) & (d <= self.reach + self.cutoff + slack)
        may[np.arange(len(d)), at] = True
        row, cell = np.nonzero(may)
        return row, cell, at[row] == cell


def find_pivots(vectors: DataFrame, cutoff: float, count: int | None, unit: bool) -> Pivots | None:
    """Pivots chosen by hash, and for each cell how far its members lie from its pivot."""
    if count is None:
        count = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(vectors.count())))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).toPandas()
    if sample.empty:
        return None
    pivots = Pivots(sample, cutoff, unit)

    def homes(batches):
        for pdf in batches:
            if len(pdf):
                cell, far = pivots.home(stack(pdf["vector"]))
                yield pd.DataFrame({"cell": cell, "far": far}).groupby("cell", as_index=False).max()

    reach = vectors.select("vector").mapInPandas(homes, "cell long, far double").groupBy("cell").agg(F.max("far").alias("far"))
    for r in reach.collect():  # one row for each pivot
        pivots.reach[r.cell] = r.far
    return pivots


def in_cells(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """``vec_id, vector, cell, home``: every vector in its own cell and in those it may have a near vector in."""

    def place(batches):
        for pdf in batches:
            if len(pdf):
                row, cell, home = pivots.cells(stack(pdf["vector"]))
                yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy()[row], "vector": pdf["vector"].to_numpy()[row], "cell": cell, "home": home})

    return vectors.select("vec_id", "vector").mapInPandas(place, "vec_id long, vector array<double>, cell long, home boolean")


def cell_sizes(placed: DataFrame) -> DataFrame:
    """``cell, members, visitors``; members of a cell are compared with all its visitors."""
    return placed.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("members"), F.count(F.lit(1)).alias("visitors"))


def close_rows(a: np.ndarray, b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, cutoff: float, order: np.ndarray | None, digits: int):
    """(row of a, row of b, distance) of all pairs below ``cutoff``; equal ids are at distance zero.

    The leading dimensions give a lower bound of the distance: their own part and the difference of what the
    rest can add; only pairs that it leaves are computed in full.
    """
    dims = np.arange(a.shape[1]) if order is None else order
    lead, rest = np.split(dims, [max(1, len(dims) // 4)])
    size_a, size_b = (np.sqrt((v[:, rest] ** 2).sum(1)) for v in (a, b))
    bound = (a[:, lead] ** 2).sum(1)[:, None] + (b[:, lead] ** 2).sum(1) - 2.0 * (a[:, lead] @ b[:, lead].T) + (size_a[:, None] - size_b) ** 2
    i, j = np.nonzero(bound < (cutoff + 1e-6) ** 2)
    found_i, found_j, found_d = [i[:0]], [j[:0]], [np.zeros(0)]
    for at in range(0, len(i), 1 << 18):
        x, y = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
        exact = np.sqrt(((a[x] - b[y]) ** 2).sum(1)).round(digits)
        exact[ids_a[x] == ids_b[y]] = 0.0
        keep = exact < cutoff
        for out, values in ((found_i, x), (found_j, y), (found_d, exact)):
            out.append(values[keep])
    return np.concatenate(found_i), np.concatenate(found_j), np.concatenate(found_d)


def compare_cells(placed: DataFrame, cutoff: float, order: np.ndarray | None, block: int, digits: int) -> DataFrame:
    """Pairs (member, visitor) of the same cell below ``cutoff``, block by block.

    Only as many blocks are made as a cell needs, on either side, so a crowded cell is many tasks and a
    task holds two blocks.
    """
    sizes = cell_sizes(placed).select(
        "cell", F.ceil(F.col("members") / block).cast("int").alias("left_blocks"), F.ceil(F.col("visitors") / block).cast("int").alias("right_blocks")
    ).where("left_blocks > 0")
    own = F.xxhash64("vec_id")

    def blocks(name: str) -> Column:
        return F.sequence(F.lit(0), F.col(name) - 1)

    def dealt(role: str, left: Column, right: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), left.cast("int").alias("left"), right.cast("int").alias("right"))

    members = F.when(F.col("home"), F.transform(blocks("right_blocks"), lambda b: dealt("a", F.pmod(own, F.col("left_blocks")), b)))
    visitors = F.transform(blocks("left_blocks"), lambda b: dealt("b", b, F.pmod(own, F.col("right_blocks"))))
    none = F.array().cast("array<struct<role:string,left:int,right:int>>")
    spread = placed.join(sizes, "cell").withColumn("to", F.explode(F.concat(F.coalesce(members, none), visitors)))
    spread = spread.select("vec_id", "vector", "cell", "to.*")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["role"] == "a"], group[group["role"] == "b"]
        if left.empty or right.empty:
            return pd.DataFrame({"word_a": [], "word_b": [], "distance": []})
        a, b = stack(left["vector"]), stack(right["vector"])
        ids_a, ids_b = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        i, j, distance = close_rows(a, b, ids_a, ids_b, cutoff, order, digits)
        return pd.DataFrame({"word_a": ids_a[i], "word_b": ids_b[j], "distance": distance})

    return spread.groupBy("cell", "left", "right").applyInPandas(compare, PAIRS)


def near_vectors(
    vectors: DataFrame, cutoff: float, pivots: int | None = None, block: int = 2048, digits: int = 9, unit: bool = False
) -> DataFrame:
    """All (word_a, word_b, distance) below ``cutoff``, exact, for a table (vec_id, vector).

    Every vector lives in the cell of its nearest pivot. It can only be near a member of another cell
    if its distance to that cell's pivot is at most the cell's radius and ``cutoff``, and at most ``2 * cutoff``
    more than to its own pivot; it visits those cells and no others. There are about as many cells as the square
    root of the number of vectors, so where the vectors form groups the pairs compared grow less than its
    square. Where all vectors are about equally far apart, no bound of this kind rules anything out.
    """
    found = find_pivots(vectors, cutoff, pivots, unit)
    if found is None:
        return vectors.sparkSession.createDataFrame([], PAIRS)
    return compare_cells(in_cells(vectors, found), cutoff, found.order, block, digits)


def near_words(words: DataFrame, vectors: DataFrame, cutoff: float, part_words: int = PART_WORDS, digits: int = 9) -> DataFrame:
    """``entry_id, version_x, word_a, word_b, distance``: the near words that adjacent versions hold.

    ``word_a`` is a word of ``version_x`` and ``word_b`` one of the next version; ``words`` names its vectors
    (vec_id, vector) by ``word``. Exact. No list of all near words is made, whose length grows with the square of the
    vocabulary: only words of two adjacent versions are compared, where they lie. Stretches of versions of
    some ``part_words`` words form a part; the vector of a word goes to each part that has the word, once, and a task holds these
    vectors and the words of two versions.
    """
    words = words.withColumn("sent_idx", F.lit(0)).select("entry_id", "version", "sent_idx", "word").where("word IS NOT NULL").distinct()
    words = materialise(with_stretches(words).drop("sent_idx"), "version_words")
    parts = max(words.sparkSession.sparkContext.defaultParallelism, words.count() // part_words + 1)
    words = words.withColumn("part", F.pmod(F.xxhash64("entry_id", "stretch"), F.lit(parts)).cast("int"))
    known = vectors.where("vector IS NOT NULL").select(F.col("vec_id").alias("word"), "vector")
    known = words.select("part", "word").distinct().join(known, "word")
    rows = words.unionByName(known, allowMissingColumns=True).select("part", "entry_id", "stretch", "version", "word", "vector")
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "entry_id", "stretch", "version")  # vectors first
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([
        *[StructField(n, kinds[k]) for n, k in (("entry_id", "entry_id"), ("version_x", "version"), ("word_a", "word"), ("word_b", "word"))],
        StructField("distance", DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for key, *found in _met(batches, cutoff, digits):
            made.append((key, *found))
            size += len(found[0])
            if size >= OUT_ROWS:
                yield batch_of(made)
                made, size = [], 0
        if made:
            yield batch_of(made)

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        counts = [len(m[1]) for m in made]
        place = np.repeat(np.arange(len(made)), counts)
        heads = [pa.array([m[0][k] for m in made], kind).take(pa.array(place)) for k, kind in ((1, entry_kind), (3, version_kind))]
        a, b, distance = (np.concatenate([m[i] for m in made]) for i in (1, 2, 3))
        return pa.RecordBatch.from_arrays([*heads, pa.array(a, word_kind), pa.array(b, word_kind), pa.array(distance)], schema.names)

    entry_kind, version_kind, word_kind = (to_arrow_type(kinds[k]) for k in ("entry_id", "version", "word"))
    return rows.mapInArrow(run, schema)


def _met(batches: Iterator[pa.RecordBatch], cutoff: float, digits: int) -> Iterator[tuple]:
    """(key of the older version, its words, words of the next version, distances) of adjacent versions with near words."""
    part = ids = vectors = before = None
    for key, table in _versions(batches):
        if key[0] != part:
            part, ids, vectors, before = key[0], None, None, None
        word = table.column("word").to_numpy()
        if key[1] is None:
            order = np.argsort(word, kind="stable")
            lists = table.column("vector").combine_chunks()
            ids, vectors = word[order], lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)[order]
            continue
        if ids is None:
            continue
        low, high = (np.searchsorted(ids, word, side) for side in ("left", "right"))
        now = key, ranges(low, high - low)
        if before is not None and before[0][1:3] == key[1:3] and before[0][3] + 1 == key[3]:
            for a in range(0, len(before[1]), BLOCK):
                for b in range(0, len(now[1]), BLOCK):
                    x, y = before[1][a : a + BLOCK], now[1][b : b + BLOCK]
                    i, j, distance = close_rows(vectors[x], vectors[y], ids[x], ids[y], cutoff, None, digits)
                    if len(i):
                        yield before[0], ids[x[i]], ids[y[j]], distance
        before = now


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """((part, entry, stretch, version), its rows) of rows sorted by these; the vectors of a part come as its NULL entry."""
    held, last = [], None
    for batch in batches:
        columns = [batch.column(i) for i in range(4)]
        fresh = np.zeros(batch.num_rows, dtype=bool)
        fresh[:1] = True
        for c in columns:
            at = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            fresh[1:] |= at[1:] != at[:-1]
        begins = np.flatnonzero(fresh)
        keys = zip(*(c.take(pa.array(begins)).to_pylist() for c in columns), strict=True)
        for key, begin, end in zip(keys, begins.tolist(), [*begins[1:].tolist(), batch.num_rows], strict=True):
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def hashed_normal(seed: int, table: int, dim: int) -> float:
    """A standard normal number that depends on the three numbers only."""
    first, second = (int(hashlib.md5(f"{seed}-{table}-{dim}-{c}".encode()).hexdigest()[:8], 16) for c in "ab")
    return math.sqrt(-2 * math.log((first + 1) / (2**32 + 1))) * math.cos(2 * math.pi * second / 2**32)


def projections(vectors: DataFrame, dims: int, bucket_length: float, tables: int, seed: int) -> DataFrame:
    """``vec_id, vector, table, place``: the place of each vector on the line of each table, in buckets."""
    lines = [F.array(*[F.lit(hashed_normal(seed, t, d)) for d in range(dims)]) for t in range(tables)]

    def place(line: Column) -> Column:
        parts = F.zip_with("vector", line, lambda a, b: a * b)
        return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p) / F.lit(float(bucket_length))

    return vectors.select("vec_id", "vector", F.posexplode(F.array(*[place(n) for n in lines])).alias("table", "place"))


def lsh_near_vectors(
    vectors: DataFrame, cutoff: float, bucket_length: float, tables: int, seed: int = 7, probe: float = 0.5, block: int = 2048, digits: int = 9
) -> DataFrame:
    """The pairs that random projections bring together; a subset of the exact ones.

    A vector is a member of one bucket of each table and visits the buckets within ``probe`` of a bucket of
    its place as well, so a pair on both sides of a border is met. The lines are made of hashes of (seed, table,
    dimension), so the same buckets can be computed anywhere. Pairs are below ``cutoff`` exactly.
    """
    first = vectors.select(F.size("vector")).first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], PAIRS)
    placed = projections(vectors, first[0], bucket_length, tables, seed)
    own = F.floor("place")
    visited = F.array_distinct(F.array(own, F.floor(F.col("place") - probe), F.floor(F.col("place") + probe)))
    cells = placed.select("vec_id", "vector", "table", own.alias("own"), F.explode(visited).alias("bucket"))
    cells = cells.select("vec_id", "vector", F.xxhash64("table", "bucket").alias("cell"), (F.col("own") == F.col("bucket")).alias("home"))
    found = compare_cells(cells, cutoff, None, block, digits)
    back = found.select(F.col("word_b").alias("word_a"), F.col("word_a").alias("word_b"), "distance")
    return found.unionByName(back).distinct()
