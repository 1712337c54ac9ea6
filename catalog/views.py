"""Versioned-text tables derived from the driver's tables, whole tables and whole texts.

``documents`` has one text per document. The views below give every document several versions
by rules that drop, edit and move sentences; FIXTURES.md lists the rules. ``ctes.py`` states the
same rules in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from verstext.config import MatchConfig
from verstext.functions.text import sentence_pieces
from verstext.functions.vector import l2_normalise
from verstext.operators import diff, labels, match, moves, near as near_pairs, sentences as sent
from verstext.runtime import materialise, scratch_path

# Fixed value: 2024-01-01T00:00:00Z in seconds.
START = 1704067200

# The nearest vectors of the test table are 0.99 apart, so its checks use a wider cutoff.
VECTOR_CONFIG = MatchConfig(word_cutoff=1.2, sentence_threshold=0.9)
CONFIG = MatchConfig()
NORM_X_CONFIG = MatchConfig(word_cutoff=1.2, sentence_threshold=0.9, norm="x")
LSH = {"bucket_length": 1.0, "tables": 4, "seed": 7, "probe": 0.5}


class Views:
    """Frames of one data folder.

    Tables that the workflow keeps between its steps (sentences, matches, diffs, labels, moves)
    are written once per session and read by the steps after them; the query that makes such a
    table computes it itself.
    """

    _stored: dict[tuple[str, str, str], DataFrame] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def stored(self, name: str, make) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in self._stored:
            made = make()
            # a match without heavy pairs is stored already
            self._stored[key] = made if hasattr(made, "stored_at") else materialise(made, name, "zstd")
        return self._stored[key]

    def scratch(self, label: str) -> str:
        return scratch_path(self.spark, label)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def labels_table(self) -> DataFrame:
        return self.table("labels")

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages")

    @cached_property
    def conversations(self) -> DataFrame:
        return self.table("conversations")

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings")

    @cached_property
    def versions(self) -> DataFrame:
        """One row per (entry, version) with the array of its sentences."""
        return versions_of(self.documents)

    def make_sentences(self) -> DataFrame:
        return self.versions.select(
            "source", "entry_id", "version", F.posexplode("kept").alias("sent_idx", "sentence")
        )

    @cached_property
    def sentences(self) -> DataFrame:
        return self.stored("sentences", self.make_sentences)

    @cached_property
    def entryversion(self) -> DataFrame:
        hours = F.col("entry_id") + F.col("version") * (F.col("entry_id") % 5 + 1)
        address = F.concat(
            F.lit("https://www."), "source", F.lit(".example.com/a/diff/"),
            F.col("entry_id").cast("string"), F.lit("/"), F.col("version").cast("string"),
        )
        archived = F.concat(
            F.lit("https://archive.example.org/"), F.col("entry_id").cast("string"), F.lit("-"),
            F.col("version").cast("string"),
        )
        return self.versions.select(
            (F.col("entry_id") * 10 + F.col("version")).alias("id"),
            "source",
            "entry_id",
            "version",
            "num_versions",
            F.concat("lead", F.lit(" v"), F.floor(F.col("version") / 2).cast("string")).alias("title"),
            F.array_join("kept", "</p><p>").alias("summary"),
            F.timestamp_seconds(F.lit(START) + hours * 3600).alias("created"),
            address.alias("url"),
            F.when((F.col("entry_id") + F.col("version")) % 5 != 0, archived).alias("archive_url"),
        )

    @cached_property
    def words(self) -> DataFrame:
        """Token rows of the derived sentences; a token is its own word id."""
        return sent.words(self.sentences, ["source", "entry_id", "version", "sent_idx"])

    def make_matched(self) -> DataFrame:
        return match.match_bidirectional(self.sentences, config=CONFIG)

    @cached_property
    def matched(self) -> DataFrame:
        return self.stored("matched", self.make_matched)

    @cached_property
    def moved(self) -> DataFrame:
        return self.stored("moved", lambda: moves.moved_edges(self.matched))

    @cached_property
    def turns(self) -> DataFrame:
        """Conversations as documents: a turn is a version."""
        return self.conversations.select(
            F.lit("chat").alias("source"),
            F.col("conv_id").alias("entry_id"),
            F.col("turn").cast("int").alias("version"),
            F.posexplode(F.filter(sentence_pieces("text"), lambda s: F.trim(s) != "")).alias(
                "sent_idx", "sentence"
            ),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.embeddings.select("vec_id", l2_normalise("embedding").alias("vector"))

    @cached_property
    def turn_words(self) -> DataFrame:
        """Token rows of the turns with the id of a vector chosen by a hash of the token."""
        n = self.embeddings.agg(F.count(F.lit(1))).scalar()
        digest = F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, 8), 16, 10).cast("long")
        rows = sent.words(self.turns, ["source", "entry_id", "version", "sent_idx"])
        return rows.withColumn("word", digest % n)

    def make_near(self) -> DataFrame:
        return near_pairs.near_vectors(self.vectors, VECTOR_CONFIG.word_cutoff, unit=True)

    @cached_property
    def near(self) -> DataFrame:
        return self.stored("near", self.make_near)

    @cached_property
    def turn_near(self) -> DataFrame:
        """Near words of adjacent turns."""
        return self.stored("turn_near", lambda: near_pairs.near_words(self.turn_words, self.vectors, VECTOR_CONFIG.word_cutoff))

    @cached_property
    def production_near(self) -> DataFrame:
        """Near words of adjacent turns at the cutoff that the matcher is run with."""
        return self.turn_near.where(F.col("distance") < CONFIG.word_cutoff)

    @cached_property
    def lsh_near(self) -> DataFrame:
        return self.stored("lsh_near", lambda: near_pairs.lsh_near_vectors(self.vectors, VECTOR_CONFIG.word_cutoff, **LSH))

    @cached_property
    def turn_pairs(self) -> DataFrame:
        return match.word_pairs(self.turn_words, self.turn_near)

    @cached_property
    def turn_matched(self) -> DataFrame:
        return match.match_bidirectional(
            self.turns, words=self.turn_words, near=self.turn_near, config=VECTOR_CONFIG
        )

    @cached_property
    def sentence_diffs(self) -> DataFrame:
        return self.stored(
            "sentence_diffs", lambda: diff.sentence_diffs_long(self.sentences, self.matched)
        )

    @cached_property
    def word_diffs(self) -> DataFrame:
        return diff.word_diff(self.sentence_diffs)

    @cached_property
    def blocks(self) -> DataFrame:
        return diff.diff_blocks(self.sentence_diffs)

    def make_labels(self) -> DataFrame:
        return labels.sentence_labels(self.matched, self.sentences, moved=self.moved)

    @cached_property
    def sentence_labels(self) -> DataFrame:
        return self.stored("sentence_labels", self.make_labels)

    @cached_property
    def doc_labels(self) -> DataFrame:
        return labels.doc_labels(self.sentence_labels)


def versions_of(documents: DataFrame) -> DataFrame:
    """Derive the versions of every document inside its row, without a shuffle."""
    doc = F.col("entry_id")
    rows = documents.select(
        "source",
        F.col("doc_id").alias("entry_id"),
        (F.col("doc_id") % 4 + 2).cast("int").alias("num_versions"),
        F.array_join(F.slice(F.split("text", r"\s+", -1), 1, 6), " ").alias("lead"),
        sentence_pieces("text").alias("pieces"),
    ).withColumn("version", F.explode(F.sequence(F.lit(0), F.col("num_versions") - 1)))
    version = F.col("version")
    numbered = F.transform(
        "pieces",
        lambda p, i: F.struct(
            i.alias("i"),
            p.alias("raw"),
            F.when(
                (i + version * 2 + doc) % 11 == 0, F.concat(p, F.lit(" updated "), version.cast("string"))
            ).otherwise(p).alias("text"),
        ),
    )
    present = F.filter(
        numbered, lambda s: ((s["i"] + doc + version) % 7 != 0) & (F.trim(s["raw"]) != "")
    )
    moves = version % 2 == 1

    def placed(p):
        return F.concat(F.filter(p, lambda s: ~moves | (s["i"] != 1)), F.filter(p, lambda s: moves & (s["i"] == 1)))

    # one-element array: the sentences are made once, not once per filter
    texts = F.transform(F.flatten(F.transform(F.array(present), placed)), lambda s: s["text"])
    some = F.filter("pieces", lambda p, i: ((i + doc + version) % 7 != 0) & (F.trim(p) != ""))
    return rows.where(F.size(some) > 0).select("source", "entry_id", "version", "num_versions", "lead", texts.alias("kept"))
