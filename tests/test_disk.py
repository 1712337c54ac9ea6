"""What is on disk while a query runs: no shuffle behind a stored step, no step stored twice."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_dealt_once import exchanges, many_versions  # noqa: F401
from verstext.operators import diff, match, stats
from verstext.operators.attached import weighted_texts
from verstext.runtime import SHUFFLES_GO, list_path, materialise, shared_dir


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_shuffles_go_with_their_step(spark):
    before = shuffle_files(spark)
    stored = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "step")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert stored.count() == 7 and spark.conf.get(SHUFFLES_GO) == "false"


def test_match_is_stored_once(spark, many_versions):  # noqa: F811
    found = match.match_bidirectional(many_versions)
    assert found.stored_at.rsplit("/", 1)[1] in list_path(spark, shared_dir(spark))


def test_changes_are_gathered_where_the_slots_are(many_versions):  # noqa: F811
    matched = match.match_bidirectional(many_versions)
    found = diff.changes_by_pair(many_versions, matched)
    assert exchanges(found) == 1
    ordered = F.array_sort(F.collect_list(F.struct("s_idx", "sent_new")))
    slots = diff.changes(diff.sentence_diffs_long(many_versions, matched)).where("kind <> 'same'")
    want = slots.groupBy("entry_id", "version_x", "kind").agg(F.count(F.lit(1)).alias("n"), F.transform(ordered, lambda s: s["sent_new"]).alias("texts"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert found.count() > 0


TEXTS = [
    (1, 0, 0, "Red fox jumps."), (1, 1, 0, "Red fox jumps."), (1, 1, 1, "blue whale"), (1, 1, None, "blue whale"),
    (2, 0, 0, "red fox"), (2, 0, 0, "red fox"), (2, None, 1, "green"), (3, 0, 0, "not there"), (None, 0, 0, "no entry"), (4, 0, 0, None),
]


def flagged_by_joins(rows, flagged, entries):
    hits = flagged.distinct().withColumn("hit", F.lit(1))
    joined = rows.join(entries, "entry_id").join(hits, ["entry_id", "version", "sent_idx"], "left").na.fill(0, ["hit"])
    return joined.where("sentence IS NOT NULL")


@pytest.fixture
def texts(spark):
    rows = spark.createDataFrame(TEXTS, "entry_id long, version int, sent_idx int, sentence string")
    flagged = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 0, 0), (3, 0, 0), (1, 1, None)], "entry_id long, version int, sent_idx int")
    entries = spark.createDataFrame([(1,), (2,), (2,), (4,), (None,)], "entry_id long")
    return rows, flagged, entries


def test_weighted_texts_count_like_joins(texts):
    found = weighted_texts(*texts).groupBy("sentence").agg(F.sum("f"), F.sum("n"))
    want = flagged_by_joins(*texts).groupBy("sentence").agg(F.sum("hit"), F.count(F.lit(1)))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_lift_in_parts_counts_every_run(texts):
    rows, n = flagged_by_joins(*texts), {}
    for r in rows.collect():
        words = r.sentence.lower().replace(".", "").split()
        for run in words + [" ".join(p) for p in zip(words, words[1:])]:
            f, c = n.get(run, (0, 0))
            n[run] = f + r.hit, c + 1
    flagged, total = (sum(v[i] for v in n.values()) for i in (0, 1))
    want = sorted((-round((f / flagged) / (c / total), 6), run, c) for run, (f, c) in n.items() if f)
    for found in (stats.ngram_lift(rows, "sentence", "hit", 3), stats.ngram_lift(weighted_texts(*texts), "sentence", "f", 3, count="n")):
        top = [(-round(r.lift, 6), r.ngram, r.n) for r in found.where("side = 'top'").orderBy(F.desc("lift"), "ngram").collect()]
        assert top == want[:3]
        assert found.where("side = 'bottom'").count() == min(3, len(want))


def test_runs_are_counted_before_they_are_shuffled():
    t = pa.array([["a", "b", "a", "b"], ["a", "b"]], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([t, pa.array([1, 0]), pa.array([1, 5])], ["t", "f", "n"])
    got = [tuple(r.values()) for p in range(stats.LIFT_PARTS) for b in stats._runs_of_part((1, 2), p)([batch]) for r in b.to_pylist()]
    assert sorted(got) == [("a", 2, 7), ("a b", 2, 7), ("b", 2, 7), ("b a", 1, 1)]
