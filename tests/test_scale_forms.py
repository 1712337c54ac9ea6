"""Forms that keep frequent words, long texts and histories out of one task."""

import pytest
from pyspark.sql import functions as F

from verstext.operators import align, frequent, stats
from verstext.sources import writers


@pytest.mark.parametrize("how", ["inner", "left"])
def test_frequent_words_join_like_any_other(spark, how):
    rows = [(n, "the" if n % 3 else f"w{n % 17}") for n in range(300)] + [(900, None), (901, "unknown")]
    words = spark.createDataFrame(rows, "n int, word string")
    table = spark.createDataFrame([("the", 1.0), *[(f"w{k}", float(k)) for k in range(10)]], "word string, value double")
    got = frequent.join_by_word(words, table, "word", how, frequent=2)
    assert sorted(map(repr, got.select("n", "word", "value").collect())) == sorted(
        map(repr, words.join(table, "word", how).select("n", "word", "value").collect())
    )


def test_a_frequent_word_is_no_shuffle_key(spark):
    words = spark.range(20_000).select(F.when(F.col("id") % 4 > 0, "the").otherwise(F.concat(F.lit("w"), F.col("id"))).alias("word"))
    table = words.distinct().withColumn("value", F.lit(1.0)).repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = frequent.join_by_word(words, table, "word", frequent=5)
        per_task = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert per_task[1] == 20_000 and per_task[0] < 8_000


def test_a_thousand_sentences_of_a_long_text_are_located(spark):
    parts = [" ".join(f"w{(n * 31 + k) % 7919}" for k in range(20)) for n in range(1000)]
    docs = spark.createDataFrame([(1, ". ".join(parts))], "entry_id long, text string")
    order = list(range(1000))
    order[10], order[11] = 11, 10
    rows = [(1, 0, i, parts[n]) for i, n in enumerate(order)] + [(1, 1, 0, "not there")]
    sentences = spark.createDataFrame(rows, "entry_id long, version int, sent_idx int, sentence string")
    got = {(r.version, r.sent_idx): r for r in align.locate_sentences(sentences, docs).collect()}
    whole = ". ".join(parts)
    assert all(got[0, i].start == whole.find(parts[n]) + 1 for i, n in enumerate(order))
    assert got[0, 11].out_of_order and not got[0, 12].out_of_order and not got[1, 0].found


def test_sketches_add_up(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), (F.col("id") % 9000).alias("entry_id"),
        (F.col("id") % 5).cast("int").alias("version"), F.concat(F.lit("s"), F.col("id") % 20_000).alias("sentence"),
    )
    whole = stats.sketched_totals(stats.corpus_sketches(rows)).collect()
    days = [rows.where(F.col("entry_id") % 4 != k) for k in (1, 2, 3)]
    added = stats.sketched_totals(stats.add_sketches(*map(stats.corpus_sketches, days))).collect()
    for a, b in zip(sorted(whole, key=str), sorted(added, key=str), strict=True):
        assert [a[n] for n in stats.SKETCHED] == pytest.approx([b[n] for n in stats.SKETCHED], rel=0.02)
    total = next(r for r in whole if r.source is None)
    assert total.entries == pytest.approx(9000, rel=0.03) and total.sentences == pytest.approx(20_000, rel=0.03) and total.rows == 30_000


def test_a_table_is_replaced_without_a_moment_without_it(spark, tmp_path):
    def make(name, n):
        writers.save_table(spark.range(n), name, str(tmp_path / name), "overwrite")

    make("kept", 3), make("kept_v2", 5)
    writers.replace_table(spark, "kept_v2", "kept")
    assert spark.table("kept").count() == 5 and not spark.catalog.tableExists("kept_replaced")
    make("kept_v3", 7)
    spark.sql("ALTER TABLE kept RENAME TO kept_replaced")  # a run that ended in the middle
    writers.replace_table(spark, "kept_v3", "kept")
    assert spark.table("kept").count() == 7 and not spark.catalog.tableExists("kept_replaced")
    writers.replace_table(spark, "kept_v3", "kept")  # nothing left to do
    assert spark.table("kept").count() == 7
    spark.sql("DROP TABLE kept")
