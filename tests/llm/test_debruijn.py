"""Repeated word spans against brute force over all windows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from verstext.llm import debruijn as db

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_spans(texts, window=35):
    """For each text its words, and which windows the texts have more than once."""
    words = [WORD.findall(t or "") for t in texts]
    times = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    return words, [[times[tuple(w[i : i + window])] for i in range(len(w) - window + 1)] for w in words]


def slow_report(rows, window=35):
    words, times = slow_spans([t for _, t in rows], window)
    out = []
    for (key, _), w, n in zip(rows, words, times, strict=True):
        gone = [False] * len(w)
        for i, k in enumerate(n):
            if k > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def slow_paths(texts, window=35):
    """Number of words and occurrences of every path: runs of windows that always occur together."""
    words = [WORD.findall(t or "") for t in texts]
    edge, pair = Counter(), Counter()
    for w in words:
        edge.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
        pair.update(tuple(w[i : i + window + 1]) for i in range(len(w) - window))
    out = Counter()
    for w in words:
        n = len(w) - window + 1
        i = 0
        while i < n:
            j = i
            if edge[tuple(w[i : i + window])] > 1:
                while j + 1 < n and edge[tuple(w[j : j + window])] == pair[tuple(w[j : j + window + 1])] == edge[tuple(w[j + 1 : j + 1 + window])]:
                    j += 1
                out[tuple(w[i : j + window])] += 1
            i = j + 1
    return out


def planted():
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 4000, n)]
    say = lambda w: "".join(x + s for x, s in zip(w, rng.choice([" ", "\n", "  ", "\t"], len(w)), strict=True))
    passage, other = words(200), words(120)
    rows = [(d, say(words(int(rng.integers(0, 150))))) for d in range(30)]
    rows += [(100 + d, say(words(20) + passage[5 * d : 5 * d + 60] + words(20))) for d in range(25)]
    rows += [(200 + d, say(words(9) + passage[40:90] + other[: 30 + d] + words(3) + other)) for d in range(15)]
    rows += [(300 + d, say(passage)) for d in range(3)] + [(310, " ".join(passage)), (310, " ".join(passage)), (310, say(words(50)))]
    rows += [(400, "a " * 400), (401, "a " * 34), (402, "a b " * 60), (403, "b a " * 60 + "c"), (404, "b " * 35), (405, "x " * 36)]
    rows += [(410, None), (411, ""), (412, " \n"), (None, " ".join(other)), (None, None), (413, "é中 " * 40 + " " + "\x0b".join(other))]
    rows += [(420, say(words(10) + other[:34] + words(10))), (421, say((words(5) + passage[150:190]) * 3)), (422, "word " + "y" * 100_000)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "a", 1, 2) for r in planted()], "doc_id long, text string, anchor string, at long, key long").repartition(5)


def test_spans_equal_brute_force(spark, table):
    rows = planted()
    got = sorted(map(tuple, db.span_report(table).collect()), key=repr)
    assert got == sorted(slow_report(rows), key=repr)
    assert db.span_report(table.limit(0)).count() == 0


def test_paths_equal_a_plain_compaction(spark, table):
    cut = db.remove_repeated_spans(table)
    want = slow_paths([t for _, t in planted()])
    got = {bytes(r.digest): (r.n_words, r.n_occurrences) for r in db.repeated_paths(cut).collect()}
    assert got == {hashlib.blake2b(" ".join(p).encode(), digest_size=16).digest(): (len(p), n) for p, n in want.items()}


def test_spans_of_the_small_table(spark, sf_dir, odd_docs):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, db.span_report(docs).collect()), key=repr) == sorted(slow_report(rows), key=repr)


@pytest.mark.parametrize(("window", "seed"), [(5, 2), (12, 12), (9, 1)])
def test_other_windows(spark, window, seed):
    rng = np.random.default_rng(window)
    rows = [(d, " ".join(rng.choice(list("abcd"), int(rng.integers(0, 60))))) for d in range(40)]
    got = db.span_report(spark.createDataFrame(rows, "doc_id long, text string"), db.WindowConfig(window, seed))
    assert sorted(map(tuple, got.collect())) == sorted(slow_report(rows, window))


def test_shared_hash_values_lead_to_another_trial(spark, monkeypatch):
    rows = planted()[30:70]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    tried = []
    count = db.count_edges

    def poor(texts, config):  # the first trial counts one edge too often
        tried.append(config.hash_seed)
        found = count(texts, config)
        return found.selectExpr("text_id", "transform(edges, e -> named_struct('at', e.at, 'size', e.size, 'times', e.times + 1, "
                                "'across_times', e.across_times, 'counted', e.counted)) edges") if len(tried) == 1 else found  # fmt: skip

    monkeypatch.setattr(db, "count_edges", poor)
    assert sorted(map(tuple, db.span_report(table).collect())) == sorted(slow_report(rows))
    assert len(tried) == 2


def test_places_do_not_depend_on_the_piece(monkeypatch):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    seeds[500:900] = seeds[500]
    whole = db.anchor_places(seeds, 28)
    monkeypatch.setattr(db, "PLACE_BITS", 7)  # pieces of 100 places, ranked by the other 57 bits
    assert np.array_equal(db.anchor_places(seeds, 28), whole)
    want = [i + int(np.argmin(seeds[i : i + 28] >> np.uint64(24))) for i in range(len(whole))]
    assert whole.tolist() == want
