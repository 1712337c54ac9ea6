"""A stored match is small on disk and large in memory: no join may send it, or the words of all texts, to the driver."""

import re

import pytest
from pyspark.sql import functions as F

from verstext.operators import labels, match, sentences as sent
from verstext.runtime import materialise


def joins(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return re.findall(r"(\w+Join)\b[^\n]* (Inner|LeftAnti|LeftOuter)\b", plan)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(e, v, i, f"w{i} of {e}" if i + v < 6 else f"new {i} {v}") for e in range(4) for v in range(3) for i in range(6)]
    texts = spark.createDataFrame(rows, "entry_id long, version int, sent_idx int, sentence string").withColumn("source", F.lit("s"))
    texts = materialise(texts, "sentences", "zstd")
    return texts, materialise(match.match_bidirectional(texts), "matched", "zstd")


@pytest.mark.parametrize("name, kind", [("complete_matches", "LeftAnti"), ("label_deleted", "LeftAnti"), ("label_additions", "Inner"), ("sentence_labels", "LeftOuter"), ("sentence_labels", "Inner")])
def test_a_match_is_not_broadcast(tables, name, kind):
    texts, matched = tables
    made = {
        "complete_matches": lambda: match.complete_matches(matched, texts),
        "label_deleted": lambda: labels.label_deleted(matched, texts),
        "label_additions": lambda: labels.label_additions(matched),
        "sentence_labels": lambda: labels.sentence_labels(matched, texts),
    }[name]()
    found = [j for j, k in joins(made) if k == kind]
    assert found and set(found) == {"SortMergeJoin"}


def test_words_are_not_broadcast(spark, tables):
    words = sent.words(tables[0], ["entry_id", "version", "sent_idx"]).withColumn("word", F.xxhash64("token") % 7)
    near = spark.createDataFrame([(a, a, 0.0) for a in range(-6, 7)], "word_a long, word_b long, distance double")
    for found in (match.word_pairs(words, near), match.word_pairs(words, None)):
        assert {j for j, _ in joins(found)} == {"SortMergeJoin"} and found.count() > 0


def test_labels_stand_next_to_every_old_sentence(spark):
    rows = [("s", 1, 0, 0, "a"), ("s", 1, 0, 0, "a"), ("s", 1, 0, None, "b"), ("s", 1, 1, 0, "c"), ("t", 2, 0, 0, "d"), ("s", None, 0, 0, "e"), ("s", 3, None, 0, "f")]
    texts = spark.createDataFrame(rows, "source string, entry_id long, version int, sent_idx int, sentence string")
    merged = spark.createDataFrame([(1, 0, 0, 1, None, 2, 0, 0, -1), (1, 1, 0, 1, 1, 1, 1, 1, 1)], "entry_id long, version_x int, sent_idx_x int, " + ", ".join(f"{c} int" for c in labels.LABELS))
    found = labels.label_all_sentences(merged, texts)
    assert sorted((tuple(r) for r in found.collect()), key=str) == [("s", 1, 0, 0, "a", 1, 0, 2, 0, 0, -1)] * 2 + [("s", 1, 0, None, "b", 0, 0, 0, 0, 0, 0)]
    below = found._jdf.queryExecution().optimizedPlan().toString().partition("LeftOuter")[2]
    assert below and not any("sentence#" in line for line in below.splitlines() if "Project [" in line)  # no text joins them
