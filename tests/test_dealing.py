"""Rows dealt as blocks come out whole and in order, and texts of several versions take little room."""

import random
import re

import pandas as pd
import pyarrow as pa
import pytest

from verstext.functions import text
from verstext.operators import align, dealing, ingest, sentences as sent
from verstext.plans.payload import payload_nodes_arcs

KEYS, ORDER = ["entry_id", "stretch"], ["version", "sent_idx"]


def rows(count=300, seed=3):
    rng = random.Random(seed)
    return [(rng.randrange(9), rng.randrange(2), rng.randrange(20), rng.choice([None, *range(5)]), f"text {i}") for i in range(count)]


def table(found):
    names = [*KEYS, *ORDER, "sentence"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)


@pytest.mark.parametrize("open_rows", [1, 40, 10_000])
def test_blocks_come_out_whole_and_sorted(monkeypatch, open_rows):
    monkeypatch.setattr(dealing, "OPEN_ROWS", open_rows)
    monkeypatch.setattr(dealing, "BLOCK_ROWS", 4)
    found = rows()
    packed = [dealing._packed(pa.Table.from_batches([table(found[a : a + 70])]), KEYS, "version") for a in range(0, len(found), 70)]
    blocks = pa.Table.from_batches(packed).sort_by([(c, "ascending") for c in (*KEYS, "version")])
    out = [tuple(r.values()) for b in dealing._opened(iter(blocks.to_batches()), KEYS, ORDER) for r in b.to_pylist()]
    assert sorted(out, key=str) == sorted(found, key=str)
    places = [(e, s, v, 99 if i is None else i) for e, s, v, i, _ in out]
    assert places == sorted(places)


def test_versions_of_a_text_travel_once():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghij ", k=120)) for _ in range(30)]
    one, five = ([(1, 0, v, i, t) for v in range(n) for i, t in enumerate(texts)] for n in (1, 5))
    sizes = [sum(len(b) for b in dealing._packed(pa.Table.from_batches([table(r)]), KEYS, "version").column("block").to_pylist()) for r in (one, five)]
    assert sizes[1] < 1.5 * sizes[0]


def test_payload_keeps_sources_apart_and_shuffles_blocks(spark):
    sentences = spark.createDataFrame(
        [("a", 1, 0, 0, "x"), ("b", 1, 0, None, "n"), ("a", 1, 1, 1, "z"), ("a", 1, 1, 0, "y"), (None, 1, 1, 0, "u"), ("a", 2, 0, 0, "q"), ("a", 2, 2, 0, "r")],
        "source string, entry_id long, version int, sent_idx int, sentence string",
    )
    matched = spark.createDataFrame([(1, 0, 1, 0, 1), (1, 0, 1, 0, 0), (1, 1, 2, 0, 0), (1, 0, 1, None, 1)], "entry_id long, version_x int, version_y int, sent_idx_x int, sent_idx_y int")
    df = payload_nodes_arcs(matched, sentences)
    assert df.columns == ["entry_id", "version_x", "source", "nodes", "arcs"]
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.source: ([tuple(n) for n in r.nodes], [tuple(a) for a in r.arcs]) for r in df.collect()}
    arcs = [(0, 0), (0, 1)]
    assert got == {"a": ([(0, 0, "x"), (1, 0, "y"), (1, 1, "z")], arcs), "b": ([(0, None, "n")], arcs), None: ([(1, 0, "u")], arcs)}


def exchanges(df):
    """Shuffles of the plan before it has run."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_joined_sentences(spark):
    rows = [(1, 0, 1, "b"), (1, 0, 0, "a"), (1, 0, None, "n"), (1, 0, 2, None), (None, 0, 0, "u"), (2, 1, 0, "c"), (None, 0, 1, "w"), (3, 0, 0, None)]
    df = spark.createDataFrame(rows, "entry_id long, version int, sent_idx int, sentence string")
    out = sent.join_sentences(df, separator="|", out="story", count="n")
    assert exchanges(out) == 1
    assert {(r.entry_id, r.version): (r.story, r.n) for r in out.collect()} == {
        (1, 0): ("n|a|b", 4), (None, 0): ("u|w", 2), (2, 1): ("c", 1), (3, 0): ("", 1),
    }


def test_places_need_one_shuffle_of_sentences(spark):
    df = spark.createDataFrame([(1, 0, 0, "b c"), (1, 0, 1, "é"), (1, 0, 2, "zz"), (1, 0, 3, None), (2, 0, 0, "q")], "entry_id long, version int, sent_idx int, sentence string")
    docs = spark.createDataFrame([(1, "é b c b c"), (2, None)], "entry_id long, text string").hint("merge")
    out = align.locate_sentences(df, docs)
    assert exchanges(out) == 2
    assert {(r.entry_id, r.sent_idx): (r.start, r.found, r.out_of_order) for r in out.collect()} == {
        (1, 0): (3, True, False), (1, 1): (1, True, True), (1, 2): (None, False, False), (1, 3): (None, False, False), (2, 0): (None, False, False),
    }


def test_runs_are_counted_where_their_text_lies(spark):
    df = spark.createDataFrame([(1, "red fox red fox"), (1, "red"), (2, "fox")], "doc long, text string")
    out = sent.ngram_counts(df, "text", "doc")
    assert not re.search(r"hashpartitioning\(ngram#\d+, doc", out._jdf.queryExecution().executedPlan().toString())
    assert {r.ngram: (r.n, r.doc_freq) for r in out.collect()} == {"red": (3, 1), "fox": (3, 2), "red fox": (2, 1), "fox red": (1, 1)}


def test_links_are_read_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    links = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (5, 6)], "old_id long, new_id long").mapInArrow(count, "old_id long, new_id long")
    out = ingest.version_chains(links)
    assert sorted(map(tuple, out.collect())) == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (5, 0, 5), (5, 1, 6)]
    assert reads.value == 4


def test_words_that_begin_like_numerals_stay():
    found = text.strip_list_marks.func(pd.Series(["a mild (iv) dim VI x. civic ", "1. (a) iv. b", "(ii) c (\n) mix", None, "no x", " İ ı "]))
    old = [re.compile(m.replace("WORD", r"\w")) for m in text.LIST_MARKS]

    def slow(s):
        before = None
        while s is not None and s != before:
            before = s
            for m in old:
                s = m.sub("", s)
        return s

    rng = random.Random(2)
    many = pd.Series(["".join(rng.choices("ivxm. ()ab1\n", k=14)) for _ in range(4000)])
    assert list(text.strip_list_marks.func(many)) == [slow(s) for s in many]
    assert found[3] is None and found[0] == slow("a mild (iv) dim VI x. civic ") and found[5] == slow(" İ ı ")


def test_tokens_are_made_once(spark, tmp_path):
    spark.createDataFrame([(1, "A  b"), (2, " "), (3, None)], "k int, sentence string").write.parquet(str(tmp_path / "s"))
    out = sent.words(spark.read.parquet(str(tmp_path / "s")), ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString().split("FileScan")[0]
    assert plan.count("split(lower(") == 1
    assert [tuple(r) for r in out.orderBy("word_idx").collect()] == [(1, 2, 0, "a", "a"), (1, 2, 1, "b", "b")]
