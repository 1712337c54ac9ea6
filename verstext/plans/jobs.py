"""The three jobs from raw versions to results, each one lazy plan up to its stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from verstext.config import MatchConfig
from verstext.functions import text as tx
from verstext.operators import diff, ingest, labels, match, moves
from verstext.runtime import materialise


def split_job(versions: DataFrame, done: DataFrame | None = None, high: int | None = None) -> DataFrame:
    """Sentences of the versions of entries with several versions that are not done, numbered without gaps.

    Markup goes, marked letters become plain ones, then the text is split. Entries with ``high``
    and more versions are left out only if a number is given.
    """
    rows = ingest.eligible_versions(versions, high=high)
    if done is not None:
        rows = ingest.only_new_entries(rows, done, ["entry_id"])
    pieces = tx.sentence_pieces(tx.fold_latin(tx.strip_markup("summary")))
    kept = F.filter(pieces, lambda s: F.trim(s) != "")
    return rows.select("source", "entry_id", "version", F.posexplode(kept).alias("sent_idx", "sentence"))


def match_job(versions: DataFrame, done: DataFrame | None = None, config: MatchConfig = MatchConfig(), high: int | None = None) -> DataFrame:
    sentences = materialise(split_job(versions, done, high), "sentences", "zstd")
    return match.match_bidirectional(sentences, config=config)


@dataclass(frozen=True)
class DiffTables:
    sentence_diffs: DataFrame
    sentence_stats: DataFrame
    word_diffs: DataFrame
    word_stats: DataFrame


def diff_job(sentences: DataFrame, matched: DataFrame) -> DiffTables:
    """The four diff tables of all adjacent versions."""
    slots = materialise(diff.sentence_diffs_long(sentences, matched), "sentence_diffs", "zstd")
    words = diff.word_diffs_long(diff.word_diff(slots))
    return DiffTables(slots, diff.sentence_stats(slots), words, diff.word_stats(words))


@dataclass(frozen=True)
class LabelTables:
    sentences: DataFrame
    documents: DataFrame
    pairs: DataFrame


def label_job(sentences: DataFrame, matched: DataFrame) -> LabelTables:
    """Sentence labels, document labels and pair statistics of the changed pairs of versions."""
    moved = materialise(moves.moved_edges(matched), "moved")
    stats = labels.changed_pairs(labels.pair_stats(matched, moved))
    changed = stats.select("entry_id", "version_x")
    labelled = labels.sentence_labels(matched, sentences, moved=moved)
    labelled = labelled.join(changed.withColumnRenamed("version_x", "version"), ["entry_id", "version"], "left_semi")
    labelled = materialise(labelled, "sentence_labels")
    return LabelTables(labelled, labels.doc_labels(labelled), stats)
