"""Diffs between adjacent versions, at sentence and word level.

Equal sentences of two versions pair by text and number of occurrence, so a sentence that only
changed place counts as kept; moves are reported by ``moves``. What remains pairs when each is the
other's best match. Tags follow the usual form: ``' '`` kept, ``'-'`` old, ``'+'`` new.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from verstext.functions import text as tx
from verstext.functions.similarity import near_subset
from verstext.operators.attached import changed_texts, diff_slots, set_slots, shared_tokens

PAIR = ["entry_id", "version_x"]
WORD_ROWS = 1000


def set_diff(sentences: DataFrame) -> DataFrame:
    """Aligned slots by equal text alone: both indexes for a kept sentence, one for the others."""
    return set_slots(sentences)


def sentence_diff(sentences: DataFrame, matched: DataFrame) -> DataFrame:
    """One row per aligned slot with texts and tags of both versions."""
    return diff_slots(sentences, matched).drop("s_idx")


def sentence_diffs_long(sentences: DataFrame, matched: DataFrame) -> DataFrame:
    """The sentence diff with a running slot number in reading order."""
    return diff_slots(sentences, matched)


def change_kind() -> Column:
    old, new = F.col("tag_old") == "-", F.col("tag_new") == "+"
    return (
        F.when(old & new, "changed").when(old, "removed").when(new, "added").otherwise("same")
    )


def changes(diffs: DataFrame) -> DataFrame:
    """Kind of every slot: added, removed, changed or same."""
    return diffs.withColumn("kind", change_kind())


def changes_by_pair(sentences: DataFrame, matched: DataFrame) -> DataFrame:
    """``entry_id, version_x, kind, n, texts``: the slots that are not the same, by kind, with their new texts in reading order."""
    return changed_texts(sentences, matched)


def sentence_stats(diffs: DataFrame) -> DataFrame:
    """Counts of changes and lengths per pair of versions."""
    k = change_kind()
    return diffs.groupBy(F.col("entry_id").alias("a_id"), F.col("version_x").alias("version_old"),
                         F.col("version_y").alias("version_new")).agg(
        F.count_if(k == "added").alias("num_added_sents"),
        F.count_if(k == "removed").alias("num_removed_sents"),
        F.count_if(k == "changed").alias("num_changed_sents"),
        F.count_if(F.trim("sent_old") != "").alias("len_old_doc"),
        F.count_if(F.trim("sent_new") != "").alias("len_new_doc"),
    )


def word_diff(diffs: DataFrame) -> DataFrame:
    """Tokens of changed pairs: equal tokens pair by number of occurrence, the rest is old or new.

    The words are paired inside the row of their slot and come out with their number in reading order (``word_idx``).
    """
    slot = [*PAIR, "s_idx"]
    changed = diffs.where("tag_old = '-' AND tag_new = '+'").select(
        *slot, tx.raw_tokens("sent_old").alias("old"), tx.raw_tokens("sent_new").alias("new")
    )
    kinds = [f for f in changed.schema.fields if f.name in slot]
    schema = StructType([*kinds, StructField("token", StringType()), *[StructField(c, IntegerType()) for c in ("pos_old", "pos_new", "word_idx")]])
    paired = changed.mapInArrow(_pair_words, schema)
    old, new = F.col("pos_old").isNotNull(), F.col("pos_new").isNotNull()
    return paired.select(
        *slot, "pos_old", "pos_new",
        F.when(old, F.col("token")).otherwise("").alias("word_old"),
        F.when(new, F.col("token")).otherwise("").alias("word_new"),
        F.when(old & ~new, "-").otherwise(" ").alias("tag_old"),
        F.when(new & ~old, "+").otherwise(" ").alias("tag_new"),
        "word_idx",
    )


def _pair_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, WORD_ROWS):
            yield _paired_words(batch.slice(at, WORD_ROWS))


def _paired_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The words of the slots of a batch, sorted by slot and reading order."""
    lists = [batch.column(c) for c in ("old", "new")]
    sizes = [c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in lists]
    tokens = pa.concat_arrays([c.flatten() for c in lists]).dictionary_encode()
    code = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
    spot = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes])
    new = np.arange(len(row)) >= sizes[0].sum()
    # the number of the occurrence of a token on its side
    order = np.lexsort((spot, new, code, row))
    starts = np.r_[True, (np.diff(row[order]) != 0) | (np.diff(code[order]) != 0) | (np.diff(new[order]) != 0)][: len(order)]
    occurrence = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    number = np.empty(len(order), np.int64)
    number[order] = occurrence
    order = np.lexsort((new, number, code, row))
    r, c, o = row[order], code[order], number[order]
    head = np.r_[True, (np.diff(r) != 0) | (np.diff(c) != 0) | (np.diff(o) != 0)][: len(order)]
    at = np.flatnonzero(head)
    alone = np.diff(np.r_[at, len(order)]) == 1
    first, last = order[at], order[np.where(alone, at, at + 1)] if len(at) else order[at]
    none = len(order) + 1
    place = [np.where(new[first], none, spot[first]), np.where(new[last], spot[last], none)]
    reading = np.lexsort((place[1], place[0], np.where(place[0] < none, place[0], place[1]), row[first]))
    row, code, place = row[first][reading], code[first][reading], [p[reading] for p in place]
    counts = np.bincount(row, minlength=batch.num_rows)
    idx = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    whole = batch.select([i for i, name in enumerate(batch.schema.names) if name not in ("old", "new")]).take(pa.array(row))
    columns = [*whole.columns, tokens.dictionary.take(pa.array(code)), *[pa.array(p.astype(np.int32), mask=p == none) for p in place], pa.array(idx.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, [*whole.schema.names, "token", "pos_old", "pos_new", "word_idx"])


def word_diffs_long(words: DataFrame) -> DataFrame:
    """The word diff with a running word number in reading order."""
    if "word_idx" in words.columns:
        return words
    order = Window.partitionBy(*PAIR, "s_idx").orderBy(
        F.coalesce("pos_old", "pos_new"), F.col("pos_old").asc_nulls_last(), F.col("pos_new").asc_nulls_last()
    )
    return words.withColumn("word_idx", F.row_number().over(order) - 1)


def word_stats(words: DataFrame) -> DataFrame:
    """Removed and added words and lengths, one row per changed pair of sentences."""
    return words.groupBy(F.col("entry_id").alias("a_id"), "version_x", "s_idx").agg(
        F.count_if(F.col("tag_old") == "-").alias("num_removed_words"),
        F.count_if(F.col("tag_new") == "+").alias("num_added_words"),
        F.count_if(F.col("word_old") != "").alias("len_old_sent"),
        F.count_if(F.col("word_new") != "").alias("len_new_sent"),
    )


def edit_clusters(diffs: DataFrame) -> DataFrame:
    """Contiguous runs of edited slots, numbered within their pair of versions."""
    same = (F.col("tag_old") == " ") & (F.col("tag_new") == " ")
    order = Window.partitionBy(*PAIR).orderBy("s_idx").rowsBetween(Window.unboundedPreceding, 0)
    return diffs.withColumn("cluster", F.sum(same.cast("int")).over(order)).where(~same)


def merge_split_sentences(diffs: DataFrame, slack: float = 0.5, max_tokens: int | None = None) -> DataFrame:
    """Sentences of an edit cluster that are nearly contained in one of the other side.

    Each smaller sentence joins its best container: most shared tokens, then the nearest slot,
    then the lower one. The pieces of a container are joined in reading order. Candidates share at
    least one token, so two sentences without a common word never meet, and the sizes decide in the
    join. With ``max_tokens`` longer sentences stay as they are.
    """
    cluster = [*PAIR, "cluster"]
    runs = edit_clusters(diffs)
    sides = []
    for column, name in (("sent_old", "x"), ("sent_new", "y")):
        sides.append(
            runs.where(F.col(column) != "").select(
                *cluster, "s_idx", F.lit(name).alias("side"), F.col(column).alias("sentence"),
                tx.content_tokens(column).alias("toks"),
            )
        )
    rows = sides[0].unionByName(sides[1])
    spread = rows.select(*cluster, "side", "s_idx", F.size("toks").alias("n"), F.posexplode("toks").alias("p", "token"))
    small = spread.select(*cluster, F.col("side").alias("small_side"), F.col("s_idx").alias("small"),
                          F.col("n").alias("n_small"), "p", "token")
    big = spread.select(*cluster, F.col("side").alias("big_side"), F.col("s_idx").alias("big"),
                        F.col("n").alias("n_big"), "token").distinct()
    if max_tokens is not None:
        small = small.where(F.col("n_small") <= max_tokens)
    fits = (F.col("small_side") != F.col("big_side")) & (F.col("small") != F.col("big")) & (F.col("n_small") <= F.col("n_big"))
    shared = (
        small.join(big, [*cluster, "token"]).where(fits)
        .groupBy(*cluster, "small_side", "small", "n_small", "big", "n_big")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    held = shared.where(F.col("hits") >= F.col("n_small") * (1 - slack))
    best = held.groupBy(*cluster, "small_side", "small").agg(
        F.min(F.struct((-F.col("hits")).alias("h"), F.abs(F.col("big") - F.col("small")).alias("gap"),
                       F.col("big").alias("big"))).alias("_b")
    ).select(*cluster, "small_side", F.col("small").alias("s_idx"), F.col("_b.big").alias("big"))
    texts = rows.select(*cluster, F.col("side").alias("small_side"), "s_idx", F.trim("sentence").alias("sentence"))
    pieces = best.join(texts, [*cluster, "small_side", "s_idx"])
    ordered = F.array_sort(F.collect_list(F.struct("s_idx", "sentence")))
    return pieces.groupBy(*cluster, F.col("small_side").alias("side"), F.col("big").alias("into_slot")).agg(
        F.count(F.lit(1)).alias("num_pieces"),
        F.array_join(F.transform(ordered, lambda s: s["sentence"]), " ").alias("merged"),
    )


def subset_pairs(diffs: DataFrame, slack: float = 0.5, max_tokens: int | None = None) -> DataFrame:
    """Changed pairs whose new sentence is nearly contained in the old one."""
    changed = diffs.where("tag_old = '-' AND tag_new = '+'")
    return changed.select(
        *PAIR, "s_idx",
        near_subset(tx.content_tokens("sent_old"), tx.content_tokens("sent_new"), slack, max_tokens).alias("is_subset"),
    )


def _labelled_pieces(diffs: DataFrame) -> DataFrame:
    """Slots as labelled texts in reading order; a changed pair gives its old, then its new text."""
    old = F.struct(F.lit(0).alias("part"), F.lit("-").alias("label"), F.col("sent_old").alias("text"))
    new = F.struct(F.lit(1).alias("part"), F.lit("+").alias("label"), F.col("sent_new").alias("text"))
    same = F.struct(F.lit(0).alias("part"), F.lit(" ").alias("label"), F.col("sent_old").alias("text"))
    kind = change_kind()
    pieces = (
        F.when(kind == "same", F.array(same)).when(kind == "removed", F.array(old))
        .when(kind == "added", F.array(new)).otherwise(F.array(old, new))
    )
    return diffs.select(*PAIR, "s_idx", F.explode(pieces).alias("_p")).select(
        *PAIR, "s_idx", "_p.part", "_p.label", "_p.text"
    )


def _islands(rows: DataFrame, order: list[str], start: Column, out: str) -> DataFrame:
    w = Window.partitionBy(*PAIR).orderBy(*order)
    return rows.withColumn("_start", start).withColumn(
        out, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_start")


def diff_blocks(diffs: DataFrame) -> DataFrame:
    """Runs of equal labels joined to one block each."""
    rows = _labelled_pieces(diffs)
    w = Window.partitionBy(*PAIR).orderBy("s_idx", "part")
    new_run = F.coalesce((F.col("label") != F.lag("label").over(w)).cast("int"), F.lit(0))
    rows = _islands(rows, ["s_idx", "part"], new_run, "block")
    ordered = F.array_sort(F.collect_list(F.struct("s_idx", "part", "text")))
    return rows.groupBy(*PAIR, "block", "label").agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("text")
    )


def smooth_blocks(blocks: DataFrame, min_tokens: int = 5) -> DataFrame:
    """Absorb short unchanged blocks between two edited ones.

    An absorbed text becomes part of the old and of the new text around it. Between two surviving
    unchanged blocks at most one ``-`` and one ``+`` block remain, so nothing is left to absorb
    after one pass and both versions can still be rebuilt.
    """
    w = Window.partitionBy(*PAIR).orderBy("block")
    inner = F.lag("label").over(w).isNotNull() & F.lead("label").over(w).isNotNull()
    # neighbours of an unchanged block are edited, because equal labels are already joined
    stays = (F.col("label") == " ") & ~(inner & (tx.token_count("text") < min_tokens))
    rows = blocks.withColumn("stays", stays.cast("int"))
    before = F.sum("stays").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("region", before * 2 - F.col("stays"))
    spread = rows.withColumn(
        "label",
        F.explode(
            F.when((F.col("label") == " ") & (F.col("stays") == 0), F.array(F.lit("-"), F.lit("+")))
            .otherwise(F.array("label"))
        ),
    )
    ordered = F.array_sort(F.collect_list(F.struct("block", "text")))
    return spread.groupBy(*PAIR, "region", "label").agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("text")
    )


def roundtrip_check(diffs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Whether the unchanged and old blocks give the old text back, and likewise the new one.

    Reading order is that of the slots, since kept sentences may have changed place.
    """
    def joined(order, text, keep):
        items = F.collect_list(F.when(keep, F.struct(*order, F.col(text).alias("_t"))))
        return F.array_join(F.transform(F.array_sort(items), lambda s: s["_t"]), " ")

    old_slot, new_slot = F.col("sent_idx_x").isNotNull(), F.col("sent_idx_y").isNotNull()
    texts = diffs.groupBy(*PAIR).agg(
        joined(["s_idx"], "sent_old", old_slot).alias("old_text"),
        joined(["s_idx"], "sent_new", new_slot).alias("new_text"),
    )
    rebuilt = blocks.groupBy(*PAIR).agg(
        joined(["block"], "text", F.col("label").isin(" ", "-")).alias("old_rebuilt"),
        joined(["block"], "text", F.col("label").isin(" ", "+")).alias("new_rebuilt"),
    )
    return texts.join(rebuilt, PAIR).select(
        *PAIR,
        (F.col("old_text") == F.col("old_rebuilt")).alias("old_ok"),
        (F.col("new_text") == F.col("new_rebuilt")).alias("new_ok"),
    )


def bag_ratio(x: DataFrame, y: DataFrame, keys: list[str], x_text: str, y_text: str) -> DataFrame:
    """Shared tokens of two texts, 2 * common / (n_x + n_y), equal tokens counted once each."""
    def bag(df, column, name):
        return df.select(*keys, F.explode(tx.tokens(column)).alias("token")).groupBy(*keys, "token").agg(
            F.count(F.lit(1)).alias("n")
        ).withColumn("side", F.lit(name))

    counts = bag(x, x_text, "x").unionByName(bag(y, y_text, "y")).groupBy(*keys, "token").agg(
        F.sum(F.when(F.col("side") == "x", F.col("n")).otherwise(0)).alias("nx"),
        F.sum(F.when(F.col("side") == "y", F.col("n")).otherwise(0)).alias("ny"),
    )
    return counts.groupBy(*keys).agg(
        (2 * F.sum(F.least("nx", "ny")) / F.sum(F.col("nx") + F.col("ny"))).alias("ratio")
    )


def diff_ratio_bands(versions: DataFrame, text: str = "summary") -> DataFrame:
    """Number of adjacent version pairs per band of token similarity."""
    ratio = shared_tokens(versions, text).withColumn("ratio", 2 * F.col("shared") / F.col("total"))
    r = F.round("ratio", 9)
    band = F.when(r <= 0.2, "low").when(r > 0.99, "same").otherwise("middle")
    return ratio.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def block_counts(blocks: DataFrame) -> DataFrame:
    """Blocks and words per label and revision order."""
    order = (F.col("version_x") + 1).alias("revision")
    return blocks.groupBy(order, "label").agg(
        F.count(F.lit(1)).alias("num_blocks"), F.sum(tx.token_count("text")).alias("num_words")
    )


def change_ratios(diffs: DataFrame, words: DataFrame) -> DataFrame:
    """Shares of added words, characters and sentences per pair of versions."""
    k = change_kind()
    base = diffs.groupBy(*PAIR).agg(
        F.count_if(k == "added").alias("_added"), F.count_if(F.col("sent_idx_y").isNotNull()).alias("_len_new"),
        F.sum(F.when(k == "added", F.length("sent_new")).otherwise(0)).alias("_added_chars"),
        F.sum(F.when(k == "same", F.length("sent_new")).otherwise(0)).alias("_kept_chars"),
    )
    per_word = words.groupBy(*PAIR).agg(
        F.count_if(F.col("tag_new") == "+").alias("_plus"), F.count_if(F.col("tag_old") == "-").alias("_minus"),
        F.count_if(F.col("word_old") != "").alias("_old"),
    )
    return base.join(per_word, PAIR, "left").select(
        *PAIR,
        F.try_divide(F.col("_plus"), F.col("_old") - F.col("_minus")).alias("added_words_ratio"),
        F.try_divide(F.col("_added_chars"), F.col("_kept_chars")).alias("added_chars_ratio"),
        F.try_divide(F.col("_added"), F.col("_len_new")).alias("added_sents_ratio"),
    )


def tag_positions(diffs: DataFrame, n: int) -> DataFrame:
    """Mean share of edited slots in each of ``n`` equal bins of a document.

    A bin is edited when any of its slots is; an empty bin takes the value of the bin before it.
    """
    edited = ((F.col("tag_old") != " ") | (F.col("tag_new") != " ")).cast("int")
    sizes = diffs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_len"))
    slot_bin = F.floor(F.col("s_idx") * n / F.col("_len")).cast("int")
    used = (
        diffs.withColumn("_e", edited).join(sizes, PAIR).groupBy(*PAIR, slot_bin.alias("bin"))
        .agg(F.max("_e").alias("_v"))
    )
    grid = sizes.select(*PAIR, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    w = Window.partitionBy(*PAIR).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(used, [*PAIR, "bin"], "left").withColumn(
        "value", F.last("_v", ignorenulls=True).over(w)
    )
    return filled.groupBy("bin").agg(F.avg("value").alias("edited_share"))


def change_density(blocks: DataFrame, n: int) -> DataFrame:
    """Share of revisions that touch each of ``n`` relative positions of the text.

    Positions are measured in tokens over the blocks in order.
    """
    size = tx.token_count("text")
    w = Window.partitionBy(*PAIR).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumn("_n", size).withColumn("_end", F.sum("_n").over(w))
    total = blocks.withColumn("_n", size).groupBy(*PAIR).agg(F.sum("_n").alias("_total")).where("_total > 0")
    rows = rows.where(F.col("label") != " ").where("_n > 0").join(total, PAIR)
    first = F.floor((F.col("_end") - F.col("_n")) * n / F.col("_total")).cast("int")
    last = F.least(F.floor((F.col("_end") - 1) * n / F.col("_total")), F.lit(n - 1)).cast("int")
    touched = rows.select(*PAIR, F.explode(F.sequence(first, last)).alias("position")).distinct()
    pairs = total.agg(F.count(F.lit(1))).scalar()
    return touched.groupBy("position").agg(F.count(F.lit(1)).alias("_k")).select(
        "position", (F.col("_k") / pairs).alias("share")
    )


def tagged_text(words: DataFrame, front: str = "<b>", back: str = "</b>") -> DataFrame:
    """Old and new sentence of each changed pair with the changed words wrapped."""
    def side(pos, word, tag, mark):
        shown = F.when(F.col(tag) == mark, F.concat(F.lit(front), F.col(word), F.lit(back))).otherwise(F.col(word))
        items = F.collect_list(F.when(F.col(pos).isNotNull(), F.struct(F.col(pos).alias("p"), shown.alias("w"))))
        return F.array_join(F.transform(F.array_sort(items), lambda s: s["w"]), " ")

    return words.groupBy(*PAIR, "s_idx").agg(
        side("pos_old", "word_old", "tag_old", "-").alias("tagged_old"),
        side("pos_new", "word_new", "tag_new", "+").alias("tagged_new"),
    )


def changed_pairs_hist(diffs: DataFrame) -> DataFrame:
    """How many pairs of versions have how many changed sentences."""
    per_pair = diffs.groupBy(*PAIR).agg(
        F.count_if((F.col("tag_old") == "-") & (F.col("tag_new") == "+")).alias("num_changed")
    )
    return per_pair.groupBy("num_changed").agg(F.count(F.lit(1)).alias("n"))


def growth_curve(versions: DataFrame, text: str = "summary") -> DataFrame:
    """Mean length of each version relative to the longest version of its entry.

    The maximum is aggregated and joined, so an entry with very many versions is not one task.
    """
    sized = versions.select("entry_id", "version", F.length(text).alias("_len"))
    longest = sized.groupBy("entry_id").agg(F.max("_len").alias("_max"))
    return sized.join(longest, "entry_id").groupBy("version").agg(
        F.avg(F.col("_len") / F.col("_max")).alias("mean_share"), F.count(F.lit(1)).alias("n")
    )


def entry_lifetime(versions: DataFrame) -> DataFrame:
    """Days between the first and the last version of an entry, count and first source."""
    seconds = F.unix_seconds(F.max("created")) - F.unix_seconds(F.min("created"))
    return versions.groupBy("entry_id").agg(
        (seconds / 86400).alias("lifetime_days"), F.count(F.lit(1)).alias("num_versions"),
        F.min_by("source", F.struct("created", "version")).alias("first_source"),
    )
