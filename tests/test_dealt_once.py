"""Matches and diffs shuffle each sentence once, and no combinations of sentences or words."""

import random

import pytest
from pyspark.sql import functions as F

from test_match import brute, rows
from verstext.config import MatchConfig
from verstext.operators import align, diff, match, nearest, stats
from verstext.operators.attached import _dealt

SCHEMA = "source string, entry_id long, version int, sent_idx int, sentence string"


@pytest.fixture(scope="module")
def many_versions(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(20)] + ["the"] * 4
    found = []
    for entry, versions in ((1, 40), (2, 3), (3, 1)):
        base = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(6)]
        for version in range(versions):
            base = [" ".join(w for w in s.split() if rng.random() > 0.1) or "w1" if rng.random() < 0.5 else s for s in base]
            base = base + [rng.choice(base)] if rng.random() < 0.2 and len(base) < 9 else base
            found += [("s", entry, version, i, s) for i, s in enumerate(base)]
    return spark.createDataFrame(found, SCHEMA).cache()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_versions_of_many_stretches(many_versions):
    texts = [r.sentence.split() for r in many_versions.collect()]
    want = brute(many_versions, {(w, w): 0.0 for t in texts for w in t}, MatchConfig())
    assert rows(match.match_bidirectional(many_versions)) == want


def test_match_shuffles_sentences_only(spark, many_versions, monkeypatch):
    stored, keep = [], match.materialise
    monkeypatch.setattr(match, "materialise", lambda df, label: stored.append(df) or keep(df, label))
    match.match_bidirectional(many_versions)
    assert sum(exchanges(df) for df in stored) == 1


def test_diff_and_texts_shuffle_once(many_versions):
    matched = match.match_bidirectional(many_versions)
    tags = many_versions.select("entry_id", "version", "sent_idx", F.split("sentence", " ").alias("tags"))
    assert exchanges(diff.sentence_diffs_long(many_versions, matched)) == 1
    assert exchanges(diff.set_diff(many_versions)) == 1
    assert exchanges(align.attach_sentences(matched, many_versions)) == 1
    assert exchanges(diff.word_diffs_long(diff.word_diff(diff.sentence_diffs_long(many_versions, matched)))) == 1
    assert stats.tag_transitions(matched, tags, 5).count() == 5


def test_pieces_give_the_same_rows(many_versions, monkeypatch):
    dealt = _dealt(many_versions.withColumn("value", F.col("sentence")), None).where("value IS NOT NULL")
    table = dealt.coalesce(1).sortWithinPartitions("entry_id", "stretch", "version").toArrow()
    seen = []

    def work(piece, last):
        versions = nearest.Versions(piece, last)
        at = versions.begins
        for v in versions.older:
            seen.append(tuple(piece.column(c)[int(at[v])].as_py() for c in ("entry_id", "version")) + (int(versions.lengths[v]), int(versions.lengths[v + 1])))
        return [], versions.rest

    list(nearest.in_pieces(work, {})(iter(table.to_batches())))
    whole, seen[:] = sorted(seen), []
    monkeypatch.setattr(nearest, "BATCH_ROWS", 10)
    list(nearest.in_pieces(work, {})(iter(table.to_batches(max_chunksize=4))))
    assert sorted(seen) == whole and len(whole) == 41


def test_words_pair_by_occurrence(spark):
    row = [(1, 0, 0, "-", "+", "a b a c", "a a d  b a"), (1, 0, 1, "-", " ", "x", ""), (1, 0, 2, "-", "+", "", "q")]
    diffs = spark.createDataFrame(row, "entry_id long, version_x int, s_idx int, tag_old string, tag_new string, sent_old string, sent_new string")
    got = [tuple(r) for r in diff.word_diffs_long(diff.word_diff(diffs)).orderBy("s_idx", "word_idx").select("s_idx", "pos_old", "pos_new", "word_old", "word_new").collect()]
    assert got == [
        (0, 0, 0, "a", "a"), (0, 1, 3, "b", "b"), (0, 2, 1, "a", "a"), (0, None, 2, "", "d"), (0, 3, None, "c", ""), (0, None, 4, "", "a"), (2, None, 0, "", "q"),
    ]
