"""Results that no fixed size, prefix or cutoff may cut short."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog.views import Views
from verstext.functions import similarity
from verstext.operators import align, evaluate, labels, stats

ARC = "entry_id long, version_x int, version_y int, sent_idx_x int, sent_idx_y int"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_every_cutoff_has_a_row_and_one_is_best(spark):
    arcs = spark.createDataFrame([(1, 0, 1, 0, 0, 0.0), (1, 0, 1, 1, 1, 0.3), (1, 0, 1, 2, 2, 0.59)], ARC + ", distance double")
    got = evaluate.cutoff_sweep(arcs, arcs.where("distance < 0.5")).orderBy("cutoff").collect()
    assert [r.cutoff for r in got] == [round(0.02 * k, 2) for k in range(31)]
    assert (got[0].precision, got[0].recall, got[0].f1) == (None, 0.0, None)
    assert (got[1].precision, got[1].recall) == (1.0, 0.5)
    assert [r.cutoff for r in got if r.best] == [0.32]


def test_no_arcs_have_no_best_cutoff(spark):
    none = spark.createDataFrame([], ARC + ", distance double")
    got = evaluate.cutoff_sweep(none, none).collect()
    assert len(got) == 31 and not any(r.best for r in got)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_places_with_edits_are_those_of_brute_force(spark, k):
    rng = random.Random(k)
    docs, sents, want = [], [], {}
    for n in range(60):
        text = "".join(rng.choice("ab\\EQ.é") for _ in range(rng.randint(0, 60)))
        size = rng.randint(1, 14)
        sent = list(text[rng.randint(0, 40) :][:size] or "abcabc")
        for _ in range(rng.randint(0, k + 1)):
            sent[rng.randrange(len(sent))] = rng.choice(string.ascii_lowercase)
        sent = "".join(sent)
        docs.append((n, text))
        sents.append((n, 0, 0, sent))
        flat, probe = text.replace("é", "e"), sent.replace("é", "e")
        near = [p + 1 for p in range(len(flat)) if len(probe) > k and edits(flat[p : p + len(probe)], probe) <= k]
        want[n] = text.find(sent) + 1 if sent in text else min(near, default=None)
    found = align.locate_sentences(
        spark.createDataFrame(sents, "entry_id long, version int, sent_idx int, sentence string"),
        spark.createDataFrame(docs, "entry_id long, text string"), max_edits=k)
    assert {r.entry_id: r.start for r in found.collect()} == want


def test_an_edit_in_the_first_letter_is_found(spark):
    found = align.locate_sentences(
        spark.createDataFrame([(1, 0, 0, "The mayor spoke")], "entry_id long, version int, sent_idx int, sentence string"),
        spark.createDataFrame([(1, "Later on the mayor spoke again")], "entry_id long, text string"), max_edits=5)
    assert found.first().found


def test_long_sentences_can_be_subsets(spark):
    words = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: i.cast("string")).alias("w"))
    got = words.select(similarity.near_subset("w", "w"), similarity.near_subset("w", "w", max_tokens=50)).first()
    assert tuple(got) == (True, False)


def test_large_counts_have_a_bin(spark):
    docs = spark.createDataFrame([("s", 1, 0, 100, 5000, 10**6, -1000)], "source string, entry_id long, version int, "
                                 "num_deleted long, num_edited long, num_added long, num_refactored long")
    flipped = docs.unionByName(docs.withColumn("num_refactored", F.lit(1000).cast("long")))
    got = labels.doc_label_bins(flipped).collect()
    assert {(r.num_deleted_bin, r.num_edited_bin, r.num_added_bin) for r in got} == {(2, 2, 2)}
    assert {r.num_refactored_bin for r in got} == {None, 0}  # 1000 upward moves; a negative count is none


def test_correlation_keeps_its_digits_far_from_zero(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 50, 400)
    b = a + rng.integers(0, 30, 400)
    far = 10**9
    rows = spark.createDataFrame([(int(x) + far, int(y) + far) for x, y in zip(a, b)], "a long, b long")
    assert stats.correlation(rows, "a", "b").first().pearson == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)


@pytest.mark.parametrize("n", [1, 7, 1500])
def test_the_control_sample_is_the_first_n_of_each_source(spark, n):
    sents = spark.range(1700).select(
        F.when(F.col("id") < 1600, "a").when(F.col("id") < 1690, "b").alias("source"),
        F.col("id").alias("entry_id"), F.lit(0).alias("version"), F.lit(0).alias("sent_idx"), F.lit("t").alias("sentence"))
    matched = sents.select(
        "entry_id", F.lit(0).alias("version_x"), F.lit(1).alias("version_y"), F.lit(0).alias("sent_idx_x"), F.lit(0).alias("sent_idx_y"),
        F.lit(0.0).alias("avg_sentence_distance_x"), F.lit(0.0).alias("avg_sentence_distance_y"))
    got = labels.unedited_control(matched, sents, n).collect()
    drawn = sents.select("source", "entry_id", labels.hash_uniform(labels.key_of("entry_id", "version", "sent_idx")).alias("u")).collect()
    want = set()
    for source in ("a", "b", None):
        own = sorted((r.u, r.entry_id) for r in drawn if r.source == source)[:n]
        want |= {(source, e, i + 1) for i, (_, e) in enumerate(own)}
    assert {(r.source, r.entry_id, r["rank"]) for r in got} == want and len(got) == len(want)


def test_the_query_finds_sentences_with_edits(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rng = random.Random(4)
    line = "".join(rng.choice("abcdé —") for _ in range(40))
    # an updated sentence is the old one and " updated 0": the text goes on nearly so, or it does not
    texts = [f"{line}{end}. {line}. And so on, {line} upd4ted {v}s. {line} ùpdatd 0. X" for v, end in enumerate((" upda 0", " was here", "", " updated 0", "ab"))]
    docs = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts * 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["locate_sentences"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    res = con.execute(entry.oracle_sql()["locate_sentences"])
    names = [d[0] for d in res.description]
    want = {tuple(dict(zip(names, r, strict=True))[c] for c in got[0].asDict()) for r in res.fetchall()}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    views = Views(spark, str(tmp_path))
    exact = align.locate_sentences(views.sentences, views.documents.select(F.col("doc_id").alias("entry_id"), "text"))
    assert sum(r.found for r in got) > exact.where("found").count()


@pytest.mark.parametrize("seed", [1, 2])
def test_near_places_are_the_first_of_all(seed, monkeypatch):
    monkeypatch.setattr(align, "PLACES", 5)
    monkeypatch.setattr(align, "FEW_PLACES", 0 if seed == 1 else 4)
    rng = random.Random(seed)
    for _ in range(300):
        k = rng.randint(1, 5)
        text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))
        probe = list(text[rng.randint(0, 30):][: rng.randint(1, 16)] or "abab")
        for _ in range(rng.randint(0, k + 1)):
            at = rng.randrange(len(probe) + 1)
            probe[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
        probe = "".join(probe)
        want = [p + 1 for p in range(len(text)) if len(probe) > k and edits(text[p : p + len(probe)], probe) <= k]
        assert align._near_place(text, probe, k) == min(want, default=None)
