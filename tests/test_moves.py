"""Moved sentences: golden graphs, and random graphs against one-at-a-time removal."""

import random

import pytest

from verstext.operators import moves

COLS = "entry_id long, version_x int, version_y int, sent_idx_x int, sent_idx_y int"
N = None

# The index pairs of the golden graphs and the edges that count as moved.
GOLDEN = {
    1: ([(10, 11), (0, 0), (9, 10), (7, 7), (2, 2), (1, 1), (8, 8), (3, 3), (6, 6), (4, 4), (9, 9), (5, 5),
         (12, N)], set()),
    2: ([(0, 0), (1, 2), (2, 3), (3, 4), (4, 5), (5, N), (6, 7), (7, N), (8, N), (10, N), (11, N), (12, 6),
         (13, 7), (14, 8), (15, N), (16, N), (17, N), (18, 11), (N, 1), (N, 9), (N, 10)], {(12, 6)}),
    3: ([(2, 2), (9, 6), (7, 4), (0, 0), (10, 10), (5, 9), (8, 5), (4, 8), (6, 3), (1, 1), (3, 7)],
        {(3, 7), (4, 8), (5, 9)}),
    4: ([(10, 5), (12, 7), (11, 6), (18, 17), (2, N), (17, 16), (7, 3), (9, 11), (0, 0), (13, 2), (6, 10),
         (5, 10), (N, 12), (8, 4), (14, 13), (N, 1), (4, 9), (16, 15), (3, 8), (1, N), (15, 14)],
        {(13, 2), (3, 8), (4, 9), (5, 10), (6, 10), (9, 11)}),
    5: ([(1, 2), (1, 3), (2, 2), (2, 3), (3, 1)], {(3, 1), (1, 3)}),
    6: ([(7, 5), (14, 16), (8, 9), (6, 8), (5, 6)], {(7, 5)}),
}


def one_at_a_time(pairs):
    """Plain statement of the rule for one small graph."""
    edges = sorted({(x, y) for x, y in pairs if x is not None and y is not None})
    xs, ys = sorted({x for x, _ in edges}), sorted({y for _, y in edges})
    rank = {e: (xs.index(e[0]), ys.index(e[1])) for e in edges}
    gone = set()

    def crossings(e):
        return sum((rank[e][0] - rank[f][0]) * (rank[e][1] - rank[f][1]) < 0 for f in edges if f not in gone)

    while True:
        left = [e for e in edges if e not in gone]
        counts = {e: crossings(e) for e in left}
        if not left or max(counts.values()) == 0:
            return gone
        step = {e: rank[e][1] - rank[e][0] for e in left}
        gone.add(min(left, key=lambda e: (-counts[e], -abs(step[e]), step[e] >= 0, rank[e])))


def run(spark, graphs):
    rows = [(k, 0, 1, x, y) for k, pairs in graphs.items() for x, y in pairs]
    got = {k: set() for k in graphs}
    for r in moves.moved_edges(spark.createDataFrame(rows, COLS)).collect():
        got[r.entry_id].add((r.sent_idx_x, r.sent_idx_y))
    return got


def test_golden_moves(spark):
    got = run(spark, {k: pairs for k, (pairs, _) in GOLDEN.items()})
    assert got == {k: want for k, (_, want) in GOLDEN.items()}


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_random_graphs_match_one_at_a_time_removal(spark, seed):
    rng = random.Random(seed)
    graphs = {}
    for k in range(60):
        n = rng.randint(1, 14)
        graphs[k] = list({(rng.randint(0, n), rng.randint(0, n)) for _ in range(rng.randint(1, 22))})
    assert run(spark, graphs) == {k: one_at_a_time(p) for k, p in graphs.items()}


def test_nothing_crosses_after_removal_and_a_second_run_finds_nothing(spark):
    rng = random.Random(9)
    pairs = [(i, y) for i, y in enumerate(rng.sample(range(40), 40))]
    gone = run(spark, {0: pairs})[0]
    left = [p for p in pairs if p not in gone]
    assert gone and not run(spark, {0: left})[0]


@pytest.mark.parametrize("graph, total", [(5, 5), (6, 2)])
def test_crossing_counts(spark, graph, total):
    rows = [(graph, 0, 1, x, y) for x, y in GOLDEN[graph][0]]
    counted = moves.crossing_edges(spark.createDataFrame(rows, COLS)).collect()
    assert sum(r.crossings for r in counted) == 2 * total


def test_pairs_in_one_task_and_repeated_rows_match_one_at_a_time_removal(spark, monkeypatch):
    from verstext.operators import nearest

    monkeypatch.setattr(nearest, "BATCH_ROWS", 40)  # pairs end inside and across tables
    rng = random.Random(11)
    graphs = {}
    for entry in range(12):
        for version in range(rng.randint(1, 30)):
            n = rng.randint(1, 9)
            graphs[entry, version] = [(rng.randint(0, n), rng.randint(0, n)) for _ in range(rng.randint(1, 14))]
    rows = [(e, v, v + 1, x, y) for (e, v), pairs in graphs.items() for x, y in pairs]
    rows += rows[::3] + [(None, 0, 1, 1, 2), (None, 0, 1, 2, 1), (3, 0, 1, None, 1), (3, 0, 1, 1, None)]
    moved = moves.moved_edges(spark.createDataFrame(rows, COLS).coalesce(2))
    got = {k: set() for k in graphs}
    for r in moved.collect():
        assert r.version_y == r.version_x + 1 and (r.sent_idx_x, r.sent_idx_y) not in got[r.entry_id, r.version_x]
        got[r.entry_id, r.version_x].add((r.sent_idx_x, r.sent_idx_y))
    assert got == {k: one_at_a_time(p) for k, p in graphs.items()}
    plan = moved._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "FlatMapGroups" not in plan
