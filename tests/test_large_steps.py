"""Steps whose rows grew faster than their input: shares of tokens, mean vectors, rewritten files."""

import pytest
from pyspark.sql import functions as F

from verstext.operators import diff, sentences as sent
from verstext.sources import writers


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_shared_tokens_stay_where_the_versions_are(spark):
    rows = [(1, 0, "a b b c"), (1, 1, "b B d"), (2, 0, "x"), (2, 1, "x"), (3, 0, "p"), (3, 1, ""), (4, 0, ""), (4, 1, None), (5, 0, "x"), (5, 2, "x"), (None, 0, "x")]
    versions = spark.createDataFrame(rows, "entry_id long, version int, summary string")
    got = diff.diff_ratio_bands(versions)
    assert exchanges(got) == 2
    # 2 * 2 / 7 is in the middle, equal texts are the same, nothing in common is low; no tokens at all is no pair
    assert {r.band: r.n for r in got.collect()} == {"middle": 1, "same": 1, "low": 1}


def test_mean_vector_has_no_row_for_each_word_and_dimension(spark):
    words = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 2), (2, 9), (3, 3)], "k int, word long")
    vectors = spark.createDataFrame(
        [(0, [1.0, None]), (1, [4.0, 6.0]), (2, [None, 2.0]), (3, None)], "vec_id long, vector array<double>"
    )
    out = sent.mean_vector(words, vectors, ["k"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, 2.0), (1, 1, 2.0), (2, 0, None), (2, 1, 2.0)]
    assert "Generate posexplode" not in out._jdf.queryExecution().executedPlan().toString()


def test_files_are_joined_without_a_shuffle(spark, tmp_path, monkeypatch):
    source, target = str(tmp_path / "small"), str(tmp_path / "large")
    spark.range(1000).withColumn("t", F.lit("x")).repartition(10).write.parquet(source)
    cls = type(spark.range(1))
    monkeypatch.setattr(cls, "repartition", lambda *a, **k: pytest.fail("rows are shuffled"))
    writers.compact_outputs(spark, source, target, rows_per_file=500)
    assert spark.read.parquet(target).agg(F.count("id"), F.sum("id")).first() == (1000, 499500)


def test_small_files_are_read_by_path(spark, tmp_path):
    source, target = str(tmp_path / "files"), str(tmp_path / "rewritten")
    spark.range(100).coalesce(1).write.parquet(source)
    spark.range(100, 105).coalesce(1).write.mode("append").parquet(source)
    writers.rewrite_small(spark, source, target, least_rows=10, rows_per_file=100)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(100, 105))
    writers.rewrite_small(spark, source, target + "2", least_rows=1, rows_per_file=100)
    assert spark.read.parquet(target + "2").count() == 0
