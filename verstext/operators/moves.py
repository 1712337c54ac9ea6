"""Sentences that changed place, found as crossing edges of the match graph.

Edge (x, y) says that old sentence x is new sentence y. Edges a and b cross when x_a < x_b and
y_a > y_b. The edge with most crossings is removed again and again until none cross; the removed
edges are the moves.

Crossings are counted without pairing edges. Split the y ranks by their binary digits: two ranks
first differ at exactly one digit, so at that digit, among the edges that agree on all higher
digits, an edge with digit 0 is crossed by the edges with digit 1 that come before it in x. One
running count per digit replaces the pairs, ``E log E`` rows instead of ``E * E``.

Crossing edges are cut into components first: in x order a component ends where no later edge has a
smaller y. Removal in one component never touches another, so each is finished on its own, by the
rule as it stands. A component holds edges of one pair of versions at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from verstext.operators.dealing import deal
from verstext.operators.nearest import codes, in_pieces, stretch_of

PAIR = ["entry_id", "version_x", "version_y"]
EDGE = ["sent_idx_x", "sent_idx_y"]
KEY = ["entry_id", "version_x"]


def ranked_edges(matched: DataFrame) -> DataFrame:
    """Edges with both ends, dense ranks of both ends in their pair, and the digits of the largest.

    Dense ranks do not mind repeated edges, so these are dropped last, where the rows of a pair are
    together already. A pair holds the sentences of one text.
    """
    edges = matched.where("sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL").select(*PAIR, *EDGE)
    pair = Window.partitionBy(*KEY)
    ranked = edges.withColumn("rx", F.dense_rank().over(pair.orderBy("sent_idx_x"))).withColumn(
        "ry", F.dense_rank().over(pair.orderBy("sent_idx_y"))
    )
    return ranked.withColumn("bits", F.length(F.bin(F.max("ry").over(pair)))).distinct()


def _spread_digits(edges: DataFrame) -> DataFrame:
    """One row per edge and binary digit of its y rank.

    ``node`` numbers the ranks that agree on all higher digits, as in a binary heap; ``one`` is
    the digit itself.
    """
    spread = edges.withColumn("digit", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)))
    leaf = F.call_function("shiftleft", F.lit(1), F.col("bits")) + F.col("ry")
    half = F.call_function("shiftright", leaf, F.col("digit"))
    return spread.withColumn("node", F.call_function("shiftright", half, F.lit(1))).withColumn(
        "one", half % 2 == 1
    ).drop("digit")


def _in_node(order: str | None = None) -> Window:
    w = Window.partitionBy(*KEY, "node")
    return w.orderBy(order) if order else w


def count_crossings(edges: DataFrame) -> DataFrame:
    """Edges with the number of edges they cross; shared ends do not cross.

    An edge with digit 0 meets the edges with digit 1 at smaller x, an edge with digit 1 those
    with digit 0 at larger x: all of them less those up to its own x.
    """
    order = _in_node("rx")
    before = order.rangeBetween(Window.unboundedPreceding, -1)
    up_to = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ones = F.when(F.col("one"), 1).otherwise(0)
    zeros = F.when(~F.col("one"), 1).otherwise(0)
    crossed = F.when(F.col("one"), F.sum(zeros).over(whole) - F.sum(zeros).over(up_to)).otherwise(
        F.coalesce(F.sum(ones).over(before), F.lit(0))
    )
    return (
        _spread_digits(edges).withColumn("_c", crossed).groupBy(*edges.columns)
        .agg(F.sum("_c").cast("long").alias("crossings"))
    )


def crossing_edges(matched: DataFrame) -> DataFrame:
    """Number of crossings of every edge of a match table."""
    return count_crossings(ranked_edges(matched)).select(*PAIR, *EDGE, "crossings")


def moved_edges(matched: DataFrame) -> DataFrame:
    """Edges (entry_id, version_x, version_y, sent_idx_x, sent_idx_y) whose removal leaves no crossing.

    The edges of a pair of versions are dealt once and finished where they lie, as arrays of some ten thousand of them.
    """
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*KEY, *EDGE])
    edges = matched.where(known).select(*PAIR, *EDGE).withColumn("stretch", stretch_of(F.col("version_x")))
    dealt = deal(edges, ["entry_id", "stretch"], ["version_x", *EDGE, "version_y"])

    def work(table: pa.Table, last: bool):
        return _moved(table, last)

    return dealt.mapInArrow(in_pieces(work, {}), matched.select(*PAIR, *EDGE).schema)


def _steps(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return fresh


def _dense_rank(pair: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Rank of a value among the distinct values of its pair, from 1; pairs are numbered in order."""
    order = np.lexsort((value, pair))
    count = np.cumsum(_steps(pair[order], value[order]))
    first = np.maximum.accumulate(np.where(_steps(pair[order]), count, 0))
    rank = np.empty(len(order), np.int64)
    rank[order] = count - first + 1
    return rank


def _moved(table: pa.Table, last: bool):
    """Batches of the moved edges of the pairs that are complete, and the first row still needed.

    Rows are sorted by pair and both ends.
    """
    table = table.combine_chunks()
    key = [codes(table.column("entry_id")), table.column("version_x").to_numpy()]
    begins = np.flatnonzero(_steps(*key))
    rest = table.num_rows if last else int(begins[-1]) if len(begins) else 0
    if rest == 0:
        return [], 0
    pair = np.cumsum(_steps(*key))[:rest]
    sx, sy = (table.column(c).to_numpy()[:rest].astype(np.int64) for c in EDGE)
    version = codes_or_null(table.column("version_y"))[:rest]
    # repeated rows count once
    row = np.flatnonzero(_steps(pair, sx, sy, version))
    spot = np.cumsum(_steps(pair[row], sx[row], sy[row])) - 1  # the edge of each of them
    edge = row[np.flatnonzero(_steps(spot))]
    times = np.bincount(spot)
    pair, rx, ry = pair[edge], _dense_rank(pair[edge], sx[edge]), _dense_rank(pair[edge], sy[edge])
    gone = np.zeros(len(edge), bool)
    gone[_crossed_and_removed(pair, rx, ry, times)] = True
    found = table.select([*PAIR, *EDGE]).take(pa.array(row[gone[spot]]))
    return found.to_batches(), rest


def codes_or_null(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _crossed_and_removed(pair: np.ndarray, rx: np.ndarray, ry: np.ndarray, times: np.ndarray) -> list[int]:
    """Numbers of the moved edges; edges are sorted by pair and ranks, and ``times`` is how often each counts."""
    if not len(pair):
        return []
    # a component begins where no earlier edge of the pair has a greater y than this or a later one
    span = int(ry.max()) + 2
    level = pair * span + ry
    highest = np.r_[-1, np.maximum.accumulate(level)[:-1]]
    lowest = np.minimum.accumulate(level[::-1])[::-1]
    component = np.cumsum(highest <= lowest)
    sizes = np.bincount(component)
    inner = np.flatnonzero(sizes[component] > 1)
    if not len(inner):
        return []
    component, x, y, times = component[inner], rx[inner], ry[inner], times[inner]
    begins = np.flatnonzero(_steps(component))
    ends = np.r_[begins[1:], len(component)]
    low = np.minimum.reduceat(y, begins)
    crossings = _crossings(np.repeat(np.arange(len(begins)), ends - begins), y - np.repeat(low, ends - begins), times)
    gone = []
    for b, e in zip(begins.tolist(), ends.tolist()):
        gone.extend(inner[b + np.array(_remove(x[b:e], y[b:e], crossings[b:e]), np.int64)].tolist())
    return gone


def _crossings(component: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How many edges of its component each edge crosses, digit by digit; edges are sorted by component, x and y.

    Of two edges with one x the one with the smaller y comes first, so neither counts the other.
    """
    found = np.zeros(len(y), np.int64)
    bits = int(y.max()).bit_length()
    for digit in range(bits):
        node = (component << (bits - digit)) + (y >> (digit + 1))
        order = np.argsort(node, kind="stable")
        weight, one = times[order], (y[order] >> digit) & 1 == 1
        begins = np.flatnonzero(_steps(node[order]))
        lengths = np.diff(np.r_[begins, len(order)])

        def so_far(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Running sums inside a node up to a row, and the sum of the node."""
            total = np.cumsum(values)
            before = np.repeat(total[begins] - values[begins], lengths)
            return total - before, np.repeat(total[begins + lengths - 1], lengths) - before

        ones, _ = so_far(np.where(one, weight, 0))
        zeros, all_zeros = so_far(np.where(one, 0, weight))
        found[order] += np.where(one, all_zeros - zeros, ones)
    return found * times


def _remove(x: np.ndarray, y: np.ndarray, crossings: np.ndarray) -> list[int]:
    """Remove the edge with most crossings of one component until none cross.

    Of equals the one with the longest move goes first, then an upward one, then the first edge.
    """
    n = len(x)
    place = np.empty(n, "int64")
    place[np.lexsort((y, x, y >= x, -abs(y - x)))] = np.arange(n)
    # crossings decide, then the place in the fixed order of the other criteria
    power = crossings * n + (n - 1 - place)
    gone = []
    while (top := int(power.argmax())) >= 0 and power[top] >= n:
        gone.append(top)
        power[((x - x[top]) * (y - y[top]) < 0) & (power >= n)] -= n
        power[top] = -1
    return gone


def num_moves(matched: DataFrame, moved: DataFrame) -> DataFrame:
    """Moves per pair of versions, zero where nothing moved."""
    moves = moved.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("num_moves"))
    pairs = matched.select(*PAIR).distinct()
    return pairs.join(moves, PAIR, "left").withColumn("num_moves", F.coalesce("num_moves", F.lit(0)))
