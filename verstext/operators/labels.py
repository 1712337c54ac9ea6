"""Edit-action labels of sentences and documents."""

from __future__ import annotations

from math import inf

from pyspark.sql import Column, DataFrame, Window, functions as F

from verstext.config import UNCHANGED_DISTANCE
from verstext.functions.text import SENT_SEPARATOR
from verstext.functions.uniform import hash_uniform, key_of
from verstext.operators import moves
from verstext.operators.match import version_pairs
from verstext.runtime import materialise, unsent

OLD = ["entry_id", "version_x", "sent_idx_x"]
LABELS = [
    "deleted_label", "add_above_label", "add_below_label", "edited_label", "unchanged_label",
    "refactored_label",
]


def old_sentences(sentences: DataFrame) -> DataFrame:
    """Sentences of the versions that have a next version, keyed as the old side of a match."""
    keys = sentences.withColumnRenamed("version", "version_x").withColumnRenamed("sent_idx", "sent_idx_x")
    return keys.join(unsent(version_pairs(sentences)), ["entry_id", "version_x"], "left_semi")


def label_deleted(matched: DataFrame, sentences: DataFrame) -> DataFrame:
    """Old sentences that no match row mentions, or that a row shows without a partner."""
    unmentioned = old_sentences(sentences).select(*OLD).join(
        unsent(matched).where("sent_idx_x IS NOT NULL"), OLD, "left_anti"
    )
    alone = matched.where("sent_idx_y IS NULL AND sent_idx_x IS NOT NULL").select(*OLD)
    return unmentioned.unionByName(alone).distinct().withColumn("deleted_label", F.lit(1))


def label_additions(matched: DataFrame) -> DataFrame:
    """Size of the runs of new sentences right above and right below each kept old sentence.

    A new sentence counts as added when no row gives it an old partner.
    """
    pair = ["entry_id", "version_x"]
    matched = unsent(matched)
    new = matched.where("sent_idx_y IS NOT NULL").groupBy(*pair, "sent_idx_y").agg(
        F.max(F.col("sent_idx_x").isNotNull().cast("int")).alias("kept")
    )
    order = Window.partitionBy(*pair).orderBy("sent_idx_y").rowsBetween(Window.unboundedPreceding, 0)
    new = new.withColumn("kept_so_far", F.sum("kept").over(order))
    runs = new.where("kept = 0").groupBy(*pair, "kept_so_far").agg(F.count(F.lit(1)).cast("int").alias("run"))
    kept = new.where("kept = 1").select(*pair, "sent_idx_y", "kept_so_far")
    above = kept.withColumn("kept_so_far", F.col("kept_so_far") - 1).join(runs, [*pair, "kept_so_far"])
    below = kept.join(runs, [*pair, "kept_so_far"])
    sizes = (
        above.withColumn("slot", F.lit("above")).unionByName(below.withColumn("slot", F.lit("below")))
        .groupBy(*pair, "sent_idx_y")
        .agg(
            F.max(F.when(F.col("slot") == "above", F.col("run"))).alias("add_above_label"),
            F.max(F.when(F.col("slot") == "below", F.col("run"))).alias("add_below_label"),
        )
    )
    old = matched.where("sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL").select(*OLD, "sent_idx_y")
    return sizes.join(old, [*pair, "sent_idx_y"]).groupBy(*OLD).agg(
        F.max("add_above_label").alias("add_above_label"), F.max("add_below_label").alias("add_below_label")
    )


def match_distance(strict: bool = False) -> Column:
    """Distance of an edge; ``strict`` uses the old side only and leaves one-sided rows undecided."""
    x = F.col("avg_sentence_distance_x")
    return x if strict else F.coalesce(x, F.col("avg_sentence_distance_y"))


def label_edited(matched: DataFrame, strict: bool = False) -> DataFrame:
    both = matched.where("sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL")
    changed = both.where(match_distance(strict) > UNCHANGED_DISTANCE)
    return changed.select(*OLD).distinct().withColumn("edited_label", F.lit(1))


def label_unchanged(matched: DataFrame, strict: bool = False) -> DataFrame:
    both = matched.where("sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL")
    same = both.where(match_distance(strict) <= UNCHANGED_DISTANCE)
    return same.select(*OLD).distinct().withColumn("unchanged_label", F.lit(1))


def label_moved(matched: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """Signed distance y - x of the moved edges; negative is upwards."""
    moved = moves.moved_edges(matched) if moved is None else moved
    return moved.select(*OLD, (F.col("sent_idx_y") - F.col("sent_idx_x")).alias("refactored_label"))


def sentence_labels(
    matched: DataFrame, sentences: DataFrame, moved: DataFrame | None = None, strict: bool = False,
    keep_down: bool = False,
) -> DataFrame:
    """All labels of every old sentence, zero where a label does not apply.

    A sentence takes the largest value of each label, and the smallest of the move distances with
    zero among the candidates whenever another label applies, so by default only upward moves
    remain. ``keep_down`` keeps downward moves too.
    """
    parts = [
        label_deleted(matched, sentences),
        label_additions(matched),
        label_edited(matched, strict),
        label_unchanged(matched, strict),
        label_moved(matched, moved),
    ]
    # stored one after the other: the shuffles of one label are gone when the next is found
    parts = [materialise(p, "label", "zstd") for p in parts]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    move = F.col("refactored_label")
    merged = rows.groupBy(*OLD).agg(
        *[F.max(c).alias(c) for c in LABELS[:-1]],
        F.min(move if keep_down else F.coalesce(move, F.lit(0))).alias("refactored_label"),
    )
    return label_all_sentences(merged, sentences)


def label_all_sentences(merged: DataFrame, sentences: DataFrame) -> DataFrame:
    """Labels next to every sentence of the old versions.

    Which sentences are old is settled by keys, so the texts are shuffled once.
    """
    old = old_sentences(sentences.select("entry_id", "version", "sent_idx")).select(*OLD).distinct()
    filled = old.join(unsent(merged), OLD, "left").na.fill(0, LABELS)
    entry, version, place = "_entry_id", "_version", "_sent_idx"
    keyed = filled.select(
        F.col("entry_id").alias(entry), F.col("version_x").alias(version), F.col("sent_idx_x").alias(place),
        *[F.col(c).cast("int").alias(c) for c in LABELS],
    )
    same = (F.col("entry_id") == F.col(entry)) & (F.col("version") == F.col(version)) & F.col("sent_idx").eqNullSafe(F.col(place))
    rows = sentences.select("source", "entry_id", "version", "sent_idx", "sentence").join(unsent(keyed), same)
    return rows.drop(entry, version, place)


def doc_labels(labelled: DataFrame) -> DataFrame:
    """Label sums per document version with its sentences as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("sent_idx", "sentence")))
    return labelled.groupBy("source", "entry_id", "version").agg(
        F.sum("deleted_label").alias("num_deleted"),
        F.sum("add_above_label").alias("num_added"),
        F.sum("edited_label").alias("num_edited"),
        F.sum((F.col("refactored_label") != 0).cast("int")).alias("num_refactored"),
        F.array_join(F.transform(ordered, lambda s: s["sentence"]), SENT_SEPARATOR).alias("sentences"),
    )


def num_added_total(matched: DataFrame) -> DataFrame:
    """All added sentences per pair, also those at the end of a document."""
    new = matched.where("sent_idx_y IS NOT NULL").groupBy("entry_id", "version_x", "sent_idx_y").agg(
        F.max(F.col("sent_idx_x").isNotNull().cast("int")).alias("kept")
    )
    return new.groupBy("entry_id", "version_x").agg(F.sum(1 - F.col("kept")).alias("num_added_total"))


def label_invariant(labelled: DataFrame) -> DataFrame:
    """Sentences that are not exactly one of edited, unchanged and deleted."""
    total = F.col("edited_label") + F.col("unchanged_label") + F.col("deleted_label")
    return labelled.withColumn("num_classes", total).where(total != 1)


def pair_stats(matched: DataFrame, moved: DataFrame) -> DataFrame:
    """Mean distances, additions, deletions and moves per pair of versions."""
    stats = matched.groupBy("entry_id", "version_x", "version_y").agg(
        F.avg("avg_sentence_distance_x").alias("mean_distance_x"),
        F.avg("avg_sentence_distance_y").alias("mean_distance_y"),
        F.count_if(F.col("sent_idx_x").isNull()).alias("num_added"),
        F.count_if(F.col("sent_idx_y").isNull()).alias("num_deleted"),
    )
    counts = moved.groupBy("entry_id", "version_x", "version_y").agg(F.count(F.lit(1)).alias("num_moved"))
    return stats.join(counts, ["entry_id", "version_x", "version_y"], "left").withColumn(
        "num_moved", F.coalesce("num_moved", F.lit(0))
    )


def changed_pairs(stats: DataFrame, min_distance: float = UNCHANGED_DISTANCE) -> DataFrame:
    """Pairs with a mean distance above the cut or any addition, deletion or move."""
    mean = (F.col("mean_distance_x") + F.col("mean_distance_y")) / 2
    return stats.where(
        (mean > min_distance) | (F.col("num_added") > 0) | (F.col("num_deleted") > 0) | (F.col("num_moved") > 0)
    )


def matches_from_annotation(answers: DataFrame, column: str = "annotated") -> DataFrame:
    """Match rows from an annotator's list of connections stored as JSON text.

    A sentinel of -1 stands for "no partner"; an edited connection gets distance 1, else 0.
    """
    schema = "array<struct<sent_idx_x:int, sent_idx_y:int, edited:boolean>>"
    rows = answers.select(
        "entry_id", "version_x", "version_y", F.explode(F.from_json(F.col(column), schema)).alias("_c")
    )
    distance = F.when(F.col("_c.edited"), 1.0).otherwise(0.0)
    x, y = F.nullif(F.col("_c.sent_idx_x"), F.lit(-1)), F.nullif(F.col("_c.sent_idx_y"), F.lit(-1))
    both = x.isNotNull() & y.isNotNull()
    return rows.select(
        "entry_id", "version_x", "version_y", x.alias("sent_idx_x"), y.alias("sent_idx_y"),
        F.when(both, distance).alias("avg_sentence_distance_x"),
        F.when(both, distance).alias("avg_sentence_distance_y"),
    )


def doc_section_grid(labelled: DataFrame, n: int) -> DataFrame:
    """Label sums and move counts in each of ``n`` equal sections of a document, as columns."""
    doc = ["source", "entry_id", "version"]
    sizes = labelled.groupBy(*doc).agg(F.count(F.lit(1)).alias("_len"))
    step = F.greatest(F.floor(F.col("_len") / n), F.lit(1))
    section = F.least(F.floor(F.col("sent_idx") / step), F.lit(n - 1)).cast("int")
    rows = labelled.join(sizes, doc).withColumn("_sec", section)
    move = F.col("refactored_label")
    measures = {
        "deleted": F.col("deleted_label"), "edited": F.col("edited_label"),
        "add_above": F.col("add_above_label"), "add_below": F.col("add_below_label"),
        "move_up": (move < 0).cast("int"), "move_none": (move == 0).cast("int"),
        "move_down": (move > 0).cast("int"),
    }
    # one conditional sum per column: the sections are known, so no pivot pass over the data
    return rows.groupBy(*doc).agg(
        *[
            F.sum(F.when(F.col("_sec") == k, value).otherwise(0)).alias(f"{name}_{k + 1}_{n}")
            for name, value in measures.items()
            for k in range(n)
        ]
    )


def doc_label_sums(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("source", "entry_id", "version").agg(
        *[F.sum(c).alias(c) for c in LABELS]
    )


def operation_class() -> Column:
    """Largest of deleted, edited and unchanged; the first one wins a tie."""
    d, e, u = F.col("deleted_label"), F.col("edited_label"), F.col("unchanged_label")
    return (
        F.when((d >= e) & (d >= u), "deleted").when(e >= u, "edited").otherwise("unchanged")
    )


def move_class(up_is_positive: bool = False) -> Column:
    """Direction of a move; y - x below zero is upwards unless the other sign is asked for."""
    m = F.col("refactored_label") * (-1 if up_is_positive else 1)
    return F.when(m < 0, "up").when(m > 0, "down").otherwise("unchanged")


def addition_class(both: str = "add_above") -> Column:
    above, below = F.col("add_above_label") > 0, F.col("add_below_label") > 0
    return (
        F.when(above & below, both).when(above, "add_above").when(below, "add_below").otherwise("unchanged")
    )


def multitask_label() -> Column:
    return F.concat_ws("|||", operation_class(), move_class(), addition_class())


# Bin edges of the document labels, closed on the left; the outer bins are open, so no count is without a bin.
DOC_BINS = {"num_deleted": (0, 1, 3, inf), "num_edited": (0, 1, 3, inf), "num_added": (0, 1, 5, inf)}
MOVE_BINS = (-inf, -1, 0)


def bin_left_closed(value: Column, edges) -> Column:
    """Number of the bin [edge, next edge) that holds the value, NULL outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        out = F.when((value >= edges[k]) & (value < edges[k + 1]), k).otherwise(out)
    return out


def bin_right_closed(value: Column, edges) -> Column:
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        out = F.when((value > edges[k]) & (value <= edges[k + 1]), k).otherwise(out)
    return out


def doc_label_bins(docs: DataFrame) -> DataFrame:
    binned = [bin_left_closed(F.col(c), e).alias(f"{c}_bin") for c, e in DOC_BINS.items()]
    move = bin_right_closed(-F.col("num_refactored"), MOVE_BINS).alias("num_refactored_bin")
    return docs.select("source", "entry_id", "version", *binned, move)


def binarise(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: (F.col(c) != 0).cast("int") for c in cols})


def last_version_label(versions: DataFrame) -> DataFrame:
    return versions.withColumn(
        "is_last", (F.col("version") == F.col("num_versions") - 1).cast("int")
    )


def clean_training_docs(labelled: DataFrame, low: int = 5, high: int = 15) -> DataFrame:
    """Sentences of documents with low < n < high sentences and no blank or NULL one."""
    doc = ["source", "entry_id", "version"]
    blank = F.col("sentence").isNull() | (F.trim("sentence") == "")
    good = (
        labelled.groupBy(*doc)
        .agg(F.count(F.lit(1)).alias("_n"), F.max(blank.cast("int")).alias("_blank"))
        .where((F.col("_n") > low) & (F.col("_n") < high) & (F.col("_blank") == 0))
    )
    return labelled.join(good.select(*doc), doc, "left_semi")


def train_test_split(df: DataFrame, keys: list[str], share: float = 0.95) -> DataFrame:
    """Mark each row ``train`` or ``test`` by a hash of its document key."""
    u = hash_uniform(key_of(*keys))
    return df.withColumn("part", F.when(u < share, "train").otherwise("test"))


def relabel(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Prefix of a label before ``_`` under its new name, one-hot; unmapped labels are dropped."""
    prefix = F.split_part(F.col(column), F.lit("_"), F.lit(1))
    names = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    out = df.withColumn("label", F.try_element_at(names, prefix)).where("label IS NOT NULL")
    return out.withColumns(
        {f"is_{n}": (F.col("label") == n).cast("int") for n in dict.fromkeys(mapping.values())}
    )


def added_deleted_table(matched: DataFrame) -> DataFrame:
    """Added and deleted sentences with a flag each."""
    key = ["entry_id"]
    added = matched.where("sent_idx_x IS NULL").select(
        *key, F.col("version_y").alias("version"), F.col("sent_idx_y").alias("sent_idx"),
        F.lit(1).alias("is_added"), F.lit(0).alias("is_deleted"),
    )
    deleted = matched.where("sent_idx_y IS NULL").select(
        *key, F.col("version_x").alias("version"), F.col("sent_idx_x").alias("sent_idx"),
        F.lit(0).alias("is_added"), F.lit(1).alias("is_deleted"),
    )
    return added.unionByName(deleted)


def unedited_control(matched: DataFrame, sentences: DataFrame, n: int) -> DataFrame:
    """Per source, ``n`` unedited sentences of either side chosen by hash order."""
    same = matched.where(
        (F.col("avg_sentence_distance_x") <= UNCHANGED_DISTANCE)
        & (F.col("avg_sentence_distance_y") <= UNCHANGED_DISTANCE)
    )
    keys = same.select(
        "entry_id",
        F.explode(
            F.array(
                F.struct(F.col("version_x").alias("version"), F.col("sent_idx_x").alias("sent_idx")),
                F.struct(F.col("version_y").alias("version"), F.col("sent_idx_y").alias("sent_idx")),
            )
        ).alias("_k"),
    ).select("entry_id", "_k.version", "_k.sent_idx").distinct()
    rows = sentences.select("source", "entry_id", "version", "sent_idx").join(
        keys, ["entry_id", "version", "sent_idx"], "left_semi"
    )
    u = hash_uniform(key_of("entry_id", "version", "sent_idx"))
    order = Window.partitionBy("source").orderBy("u", "entry_id", "version", "sent_idx")
    # the draws are uniform: counts by their first 12 binary digits tell how far a source's first n can reach
    drawn = rows.withColumn("u", u).withColumn("_step", F.floor(F.col("u") * 4096))
    counts = drawn.groupBy("source", "_step").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_step")) - F.col("_n")
    reach = counts.withColumn("_before", before).where(F.col("_before") < n).groupBy("source").agg(F.max("_step").alias("_last"))
    near = drawn.join(reach.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    near = near.where(F.col("_step") <= F.col("_last")).drop("_step", "_last", "_source")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def document_key_rows(docs: DataFrame, text: str, max_tokens: int) -> DataFrame:
    """Headerless training rows: document key, sentence position 0 and the text below a length."""
    n = F.size(F.split(F.col(text), r"\s+", -1))
    return docs.where(n < max_tokens).select(
        key_of("source", "entry_id", "version").alias("doc_key"), F.lit(0).alias("sent_pos"), F.col(text).alias("text")
    )
