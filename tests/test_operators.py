"""Ordering helpers, labels, diffs, text functions, ingest and streaming on small inputs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verstext.functions import grams, similarity, text as tx
from verstext.operators import diff, ingest, labels, match, ordering, sampling, sentences as sent
from verstext.plans import jobs
from verstext.streaming import jobs as streaming


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(11)
    rows = [(rng.choice("abb"), rng.randint(-40, 400), i) for i in range(300)]
    return spark.createDataFrame(rows, "k string, v long, i long").cache()


@pytest.mark.parametrize("width", [1, 7, 65536])
def test_positions_and_quantiles(numbers, width):
    pdf = numbers.toPandas()
    got = ordering.dense_position(numbers, ["k"], "v", width=width).toPandas()
    want = pdf[["k", "v"]].drop_duplicates()
    want["position"] = want.groupby("k")["v"].rank(method="dense").astype(int) - 1
    key = ["k", "v"]
    pd.testing.assert_frame_equal(
        got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False)
    q = ordering.quantiles(numbers, ["k"], "v", {"a": 0.01, "b": 0.5, "c": 0.9}, width=width).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert np.allclose(q.loc[k], np.quantile(g["v"], [0.01, 0.5, 0.9]))


@pytest.mark.parametrize("width", [12, 65536])
def test_rolling_mean(numbers, width):
    pos = ordering.dense_position(numbers, ["k"], "i")
    df = numbers.join(pos, ["k", "i"])
    got = ordering.rolling_mean(df, ["k"], "position", "v", 10, "m", width=width).toPandas().sort_values("i")
    want = numbers.toPandas().sort_values("i").groupby("k")["v"].rolling(10).mean().reset_index(level=0, drop=True).sort_index()
    assert np.allclose(got["m"].to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


def test_average_rank(numbers):
    pdf = numbers.toPandas()
    got = ordering.average_rank(numbers, "v", "r", width=9).toPandas().set_index("v")["r"]
    assert np.allclose(pdf["v"].map(got), pdf["v"].rank())


MATCH = ("entry_id long, version_x int, version_y int, sent_idx_x int, sent_idx_y int, "
         "avg_sentence_distance_x double, avg_sentence_distance_y double")


def test_additions_above_and_below(spark):
    rows = [(1, 0, 1, None, 0, None, None), (1, 0, 1, None, 1, None, None), (1, 0, 1, 0, 2, 0.0, 0.0),
            (1, 0, 1, 1, 3, 0.2, 0.2), (1, 0, 1, None, 4, None, None)]
    got = {r.sent_idx_x: (r.add_above_label, r.add_below_label) for r in
           labels.label_additions(spark.createDataFrame(rows, MATCH)).collect()}
    assert got == {0: (2, None), 1: (None, 1)}


def test_sentence_and_document_labels(spark):
    texts = {0: ["a a", "b b", "c c", "d d"], 1: ["n n", "c c", "a a", "b b x"]}
    rows = [("s", 1, v, i, t) for v, ts in texts.items() for i, t in enumerate(ts)]
    sentences = spark.createDataFrame(rows, "source string, entry_id long, version int, sent_idx int, sentence string")
    matched = match.match_bidirectional(sentences)
    out = {r.sent_idx: r for r in labels.sentence_labels(matched, sentences).collect()}
    assert [out[i].deleted_label for i in range(4)] == [0, 0, 0, 1]
    assert [out[i].unchanged_label for i in range(4)] == [1, 1, 1, 0]
    assert out[2].refactored_label == -1 and out[2].add_above_label == 1
    doc = labels.doc_labels(labels.sentence_labels(matched, sentences)).first()
    assert (doc.num_deleted, doc.num_added, doc.num_refactored) == (1, 1, 1)
    assert doc.sentences == "a a<SENT>b b<SENT>c c<SENT>d d"


def test_smooth_blocks_keep_both_texts(spark):
    blocks = [("-", "a"), (" ", "x"), ("+", "b"), ("-", "c"), (" ", "one two three four five six"), ("+", "d"), (" ", "y"), ("+", "e")]
    rows = [(1, 0, i, label, text) for i, (label, text) in enumerate(blocks)]
    df = spark.createDataFrame(rows, "entry_id long, version_x int, block long, label string, text string")
    got = {(r.region, r.label): r.text for r in diff.smooth_blocks(df, 3).collect()}
    long = "one two three four five six"
    assert sorted(got.items()) == [((0, "+"), "x b"), ((0, "-"), "a x c"), ((1, " "), long), ((2, "+"), "d y e"), ((2, "-"), "y")]


def test_text_functions(spark):
    df = spark.createDataFrame([("<p><a href='x'>l</a></p><p>Version 2 of 3</p><p>Body &lt;b&gt;text</p><p>"
                                 "Currently monitoring 1,234 news articles</p>",)], "t string")
    assert df.select(tx.clean_html("t")).first()[0] == "Body text"
    one = spark.createDataFrame([("PARIS — The talks began",), ("a quiet place — x",), ("none",)], "t string")
    got = [(r.dateline, r.body) for r in sent.split_dateline(one, "t").collect()]
    assert got == [("PARIS", "The talks began"), (None, "a quiet place — x"), (None, "none")]
    kept = sent.filter_boilerplate(spark.createDataFrame([("Share on Twitter now",), ("[note",), ("Fine.",)], "sentence string"))
    assert [r[0] for r in kept.collect()] == ["Fine."]
    toks = spark.createDataFrame([('The "quick," (fox) -- isn\'t a--b !',)], "t string").select(tx.content_tokens("t")).first()[0]
    assert toks == ["quick", "fox", "isn't", "a--b"]


def test_similarity(spark):
    df = spark.createDataFrame([(1, "a b c d", "a b x d"), (2, "same text", "same text"), (3, "é", "e")], "k int, x string, y string")
    sim = {r.k: r.s for r in df.select("k", similarity.edit_similarity("x", "y").alias("s")).collect()}
    assert sim[2] == sim[3] == 1.0 and abs(sim[1] - (1 - 1 / 7)) < 1e-9
    bag = {r.k: r.ratio for r in grams.token_bag_ratio(df, ["k"], "x", "y").collect()}
    assert bag == {1: 0.75, 2: 1.0, 3: 0.0}
    cov = grams.shared_kgram_coverage(df.where("k = 1"), ["k"], "x", "y", 2).first()
    assert (cov.coverage_x, cov.coverage_y) == (0.5, 0.5)


def test_version_chains_with_a_loop(spark):
    links = [(1, 2), (2, 3), (3, 3), (10, 11), (20, 21), (21, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {(r.root, r.position, r.id) for r in ingest.version_chains(
        spark.createDataFrame(links, "old_id long, new_id long")).collect()}
    want = {(1, 0, 1), (1, 1, 2), (1, 2, 3), (10, 0, 10), (10, 1, 11)} | {(100, i, 100 + i) for i in range(41)}
    assert got == want


def test_samples_do_not_depend_on_the_partitioning(numbers):
    picks = [
        {r.i for r in sampling.inverse_frequency_sample(numbers.repartition(n), ["i"], ["k"], 30).collect()} for n in (1, 5)
    ]
    assert picks[0] == picks[1] and len(picks[0]) == 30


@pytest.fixture(scope="module")
def versions(spark):
    text = "First one. Second one. Third one with more words"
    rows = []
    for e in range(6):
        for v in range(3):
            body = text + (f" and {v}" if e % 2 else "") + (". Added line" if v == 2 else "")
            rows.append((e * 10 + v, "s", e, v, 3, f"t{v // 2}", body, v * 60, f"u/{e}/{v}", None))
    schema = ("id long, source string, entry_id long, version int, num_versions int, title string, summary string, "
              "created long, url string, archive_url string")
    return spark.createDataFrame(rows, schema).withColumn("created", F.timestamp_seconds(F.col("created") + 1704067200)).cache()


def test_jobs_from_versions_to_labels(versions):
    sentences = jobs.split_job(versions).cache()
    matched = jobs.match_job(versions)
    tables = jobs.diff_job(sentences, matched)
    stats = {(r.a_id, r.version_old): (r.num_added_sents, r.num_changed_sents) for r in tables.sentence_stats.collect()}
    assert stats[0, 0] == (0, 0) and stats[0, 1] == (1, 0) and stats[1, 0] == (0, 1)
    out = jobs.label_job(sentences, matched)
    assert {(r.entry_id, r.version) for r in out.documents.collect()} == {(e, v) for e, v in stats if (e % 2 or v == 1)}
    assert jobs.split_job(versions, versions.where("entry_id < 5")).select("entry_id").distinct().count() == 1


def test_streams_equal_their_batch_result(spark, versions, tmp_path):
    sentences = jobs.split_job(versions).select("source", "entry_id", "version", "sent_idx", "sentence")
    arriving, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    sentences.where("entry_id < 3").coalesce(1).write.parquet(arriving)
    streaming.continuous_match(spark, arriving, out, progress)
    # later files: new entries, and one that is done already
    sentences.where("entry_id >= 2").repartition(2, "entry_id").write.mode("append").parquet(arriving)
    got = streaming.continuous_match(spark, arriving, out, progress)
    cols = ["entry_id", "version_x", "sent_idx_x", "sent_idx_y"]
    want = match.match_bidirectional(sentences).select(*cols)
    assert sorted(got.select(*cols).collect(), key=repr) == sorted(want.collect(), key=repr)

    late = str(tmp_path / "versions")
    versions.where("version <> 1").coalesce(1).write.parquet(late)
    pairs_out, pairs_progress = str(tmp_path / "pairs"), str(tmp_path / "pairs_progress")
    streaming.stream_adjacent_versions(spark, late, pairs_out, pairs_progress)
    versions.where("version = 1").coalesce(1).write.mode("append").parquet(late)
    pairs = streaming.stream_adjacent_versions(spark, late, pairs_out, pairs_progress)
    assert {(r.entry_id, r.version_x) for r in pairs.collect()} == {(e, v) for e in range(6) for v in (0, 1)}
