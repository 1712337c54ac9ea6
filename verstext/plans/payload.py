"""Nested payload of a pair of versions for an annotation tool."""

from __future__ import annotations

from pyspark.sql import DataFrame

from verstext.operators.attached import pair_lists


def payload_nodes_arcs(matched: DataFrame, sentences: DataFrame) -> DataFrame:
    """Per pair the sentences of both versions in order and the arcs between them.

    One pair holds the text of two versions, so the nested lists are bounded by their texts.
    """
    return pair_lists(sentences, matched.where("sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL"))
