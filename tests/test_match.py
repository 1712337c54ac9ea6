"""The pruned match against scoring every word pair, on small random documents."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verstext.config import MatchConfig
from verstext.operators import match, near, sentences as sent

KEYS = ["source", "entry_id", "version", "sent_idx"]


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(25)] + ["the", "of", "a"] * 6
    rows = []
    for entry in range(12):
        base = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(rng.randint(3, 9))]
        for version in range(3):
            base = [
                " ".join(w for w in s.split() if rng.random() > 0.12) + rng.choice(["", " w3", " the"])
                if rng.random() < 0.6 else s
                for s in base
            ]
            rng.shuffle(base) if rng.random() < 0.3 else None
            base = base + [base[0]] if rng.random() < 0.4 else base
            rows += [("s", entry, version, i, s) for i, s in enumerate(base)]
    schema = "source string, entry_id long, version int, sent_idx int, sentence string"
    return spark.createDataFrame(rows, schema).cache()


def rows(df):
    cols = ["entry_id", "version_x", "version_y", "sent_idx_x", "sent_idx_y",
            "avg_sentence_distance_x", "avg_sentence_distance_y"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def brute(documents, near, config):
    """All word pairs, scored in plain Python; equal texts first among equal distances."""
    texts = {}
    for r in documents.collect():
        texts.setdefault((r.entry_id, r.version), {})[r.sent_idx] = r.sentence
    out = {}
    for (e, v), old in texts.items():
        new = texts.get((e, v + 1))
        if new is None:
            continue
        for side, own, other in (("x", old, new), ("y", new, old)):
            for i, s in own.items():
                best = None
                for j, t in other.items():
                    a, b = s.lower().split(), t.lower().split()
                    ds = [min((near.get((p, q), 9.0) for q in b), default=9.0) for p in a]
                    hit = [d for d in ds if d < config.word_cutoff]
                    n = len(a) if config.norm == "own" or side == "x" else len(b)
                    if s == t:
                        dist = 0.0
                    elif not hit or not n:
                        continue
                    else:
                        dist = round((sum(hit) + config.word_cutoff * (n - len(hit))) / n, 9)
                    if dist < config.sentence_threshold:
                        key = (dist, s != t, abs(i - j), j)
                        best = key if best is None or key < best else best
                pair = (e, v, v + 1, i, best and best[3]) if side == "x" else (e, v, v + 1, best and best[3], i)
                row = out.setdefault(pair, [None, None])
                row[side == "y"] = best and best[0]
    return sorted(((*k, *d) for k, d in out.items()), key=repr)


@pytest.mark.parametrize("options", [{}, {"heavy_limit": 0}, {"heavy_limit": 20, "rungs": (0.1, 0.2, 0.3)}])
@pytest.mark.parametrize("norm", ["own", "x"])
def test_equal_words(spark, documents, options, norm):
    config = MatchConfig(norm=norm)
    words = {w for r in documents.collect() for w in r.sentence.lower().split()}
    want = brute(documents, {(w, w): 0.0 for w in words}, config)
    assert rows(match.match_bidirectional(documents, config=config, **options)) == want


@pytest.mark.parametrize("options", [{}, {"heavy_limit": 0}])
def test_near_words(spark, documents, options):
    rng = np.random.default_rng(1)
    words = sorted({w for r in documents.collect() for w in r.sentence.lower().split()})
    near = {(w, w): 0.0 for w in words}
    for a in words:
        for b in words:
            if a < b and rng.random() < 0.1:
                near[a, b] = near[b, a] = round(float(rng.uniform(0.1, 0.45)), 3)
    table = spark.createDataFrame([(a, b, d) for (a, b), d in near.items()], "word_a string, word_b string, distance double")
    got = match.match_bidirectional(documents, words=sent.words(documents, KEYS), near=table, **options)
    assert rows(got) == brute(documents, near, MatchConfig())


def test_steps_and_completion_agree_with_the_whole(spark, documents):
    distinct = documents.dropDuplicates(["entry_id", "version", "sentence"])
    pairs = match.word_pairs(sent.words(distinct, KEYS), None)
    steps = match.complete_matches(match.match_steps(pairs), distinct)
    whole = match.match_bidirectional(distinct)

    def distances(df):
        return sorted((tuple(r) for r in df.groupBy("entry_id", "version_x", "sent_idx_x").agg(
            F.min("avg_sentence_distance_x").alias("d")).collect()), key=repr)

    assert distances(steps) == distances(whole)


@pytest.mark.parametrize("block", [7, 2048])
def test_near_vectors_are_exact_and_lsh_finds_a_subset(spark, block):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    v[30:] = v[:30] + rng.normal(scale=0.1, size=(30, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, vector array<double>")
    got = {(r.word_a, r.word_b): r.distance for r in near.near_vectors(table, 0.5, pivots=4, block=block, unit=block > 7).collect()}
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    assert set(got) == {(int(i), int(j)) for i, j in zip(*np.nonzero(d < 0.5))}
    assert all(abs(got[k] - d[k]) < 1e-8 for k in got)
    found = {(r.word_a, r.word_b) for r in near.lsh_near_vectors(table, 0.5, 0.5, 3, block=block).collect()}
    assert found <= set(got) and len(found) >= 0.9 * len(got)
    assert near.near_vectors(table.limit(0), 0.5).count() == near.lsh_near_vectors(table.limit(0), 0.5, 0.5, 3).count() == 0


@pytest.mark.parametrize(("norm", "part_words"), [("own", 40), ("x", 1_000_000)])
def test_near_words_of_adjacent_versions_stand_for_the_whole_list(spark, documents, norm, part_words):
    rng = np.random.default_rng(6)
    many = documents.unionByName(documents.where("version = 0").withColumn("version", F.explode(F.sequence(F.lit(5), F.lit(30)))))
    words = sent.words(many, KEYS).withColumn("word", F.pmod(F.xxhash64("token"), F.lit(31)))  # some words have no vector
    v = rng.normal(size=(20, 6))
    v[10:] = v[:10] + rng.normal(scale=0.1, size=(10, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    table += [table[3], (4, table[5][1]), (25, None), (None, table[0][1])]  # an id may come twice or be NULL
    vectors = spark.createDataFrame(table, "vec_id long, vector array<double>")
    whole = near.near_vectors(vectors.where("vector IS NOT NULL"), 0.5, unit=True).localCheckpoint()
    local = near.near_words(words, vectors, 0.5, part_words).localCheckpoint()
    older = words.select("entry_id", F.col("version").alias("version_x"), F.col("word").alias("word_a")).distinct()
    newer = words.select("entry_id", (F.col("version") - 1).alias("version_x"), F.col("word").alias("word_b")).distinct()
    want = older.join(whole, "word_a").join(newer, ["entry_id", "version_x", "word_b"]).select(local.columns)
    assert local.count() and sorted(map(tuple, local.collect())) == sorted(map(tuple, want.collect()))
    assert near.near_words(words, vectors.limit(0), 0.5).count() == near.near_words(words.limit(0), vectors, 0.5).count() == 0
    config = MatchConfig(norm=norm)
    for limit in (None, 0):
        found = (match.match_bidirectional(many, words=words, near=n, config=config, heavy_limit=limit) for n in (local, whole))
        assert rows(next(found)) == rows(next(found))
    pairs = (match.word_pairs(words, n) for n in (local, whole))
    assert sorted(map(repr, next(pairs).collect())) == sorted(map(repr, next(pairs).select(match.word_pairs(words, local).columns).collect()))


def test_a_word_meets_its_near_words_once_for_all_sentences_that_have_it(spark):
    rows = spark.createDataFrame([(1, 0, s, w, 1, 2) for s in range(3) for w in (7, 8)], "entry_id long, version_x long, sent_idx int, word long, c long, n int")
    others = spark.createDataFrame([(1, 0, o, 2, w) for o in range(4) for w in (8, 9)], "entry_id long, version_x long, other int, n_other int, word_b long")
    near_list = spark.createDataFrame([(7, 9, 0.3), (7, 8, 0.1), (8, 8, 0.0), (5, 8, 0.1)], "word_a long, word_b long, distance double")
    side = match._Side("x", None, near_list, MatchConfig(), others)
    found = match._hits(side, rows, [])
    assert sorted(map(tuple, found.collect())) == [(1, 0, s, o, 0.1, 2, 2) for s in range(3) for o in range(4)]
    given = rows.withColumn("other", F.col("sent_idx"))
    assert sorted(map(tuple, match._hits(side, given, ["other"]).collect())) == [(1, 0, s, s, 0.1, 2, 2) for s in range(3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("[", 1)[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert keys and not [k for k in keys if "sent_idx" in k and "word" in k]


def test_pairs_compared_grow_less_than_the_square(spark):
    rng = np.random.default_rng(9)
    compared = []
    for n in (250, 1000, 4000):
        v = rng.normal(size=(n, 3))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id long, vector array<double>")
        pivots = near.find_pivots(table, 0.05, None, True)
        compared.append(near.cell_sizes(near.in_cells(table, pivots)).selectExpr("sum(members * visitors)").first()[0])
        if n == 1000:
            d = np.linalg.norm(v[:, None] - v[None], axis=2)
            assert near.near_vectors(table, 0.05, unit=True).count() == (d < 0.05).sum()
    assert compared[1] < 12 * compared[0] and compared[2] < 12 * compared[1] and compared[2] < 0.1 * 4000**2
