"""Corpus statistics on versions, sentences and matches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from verstext.config import UNCHANGED_DISTANCE
from verstext.functions import text as tx
from verstext.operators.attached import attach_values
from verstext.operators.dealing import gathered
from verstext.operators.match import adjacent_versions
from verstext.operators.ordering import average_rank, quantiles, weighted_quantiles
from verstext.runtime import materialise

PAIR = ["entry_id", "version_x", "version_y"]


def edit_flags() -> dict[str, Column]:
    """Whether a match row is an addition, a deletion or an edit."""
    x, y = F.col("sent_idx_x"), F.col("sent_idx_y")
    d = F.coalesce("avg_sentence_distance_x", "avg_sentence_distance_y")
    return {
        "addition": x.isNull(),
        "deletion": y.isNull(),
        "edit": x.isNotNull() & y.isNotNull() & (d > UNCHANGED_DISTANCE),
    }


def _rates(prefix: str = "") -> list[Column]:
    return [F.avg(c.cast("int")).alias(f"{prefix}{n}_rate") for n, c in edit_flags().items()]


def pair_change_rates(matched: DataFrame) -> DataFrame:
    """Shares of additions, deletions and edits per pair of versions."""
    return matched.groupBy(*PAIR).agg(*_rates())


def change_by_version(matched: DataFrame, max_version: int | None = None) -> DataFrame:
    """Mean percentage of each kind of change by version, one column per kind."""
    rates = pair_change_rates(matched)
    if max_version is not None:
        rates = rates.where(F.col("version_x") < max_version)
    names = [f"{n}_rate" for n in edit_flags()]
    return rates.groupBy("version_x").agg(
        *[F.round(F.avg(F.col(n)) * 100, 2).alias(n.replace("_rate", "_pct")) for n in names]
    )


def change_by_position(matched: DataFrame, max_position: int | None = None) -> DataFrame:
    """Shares of changes by sentence position; an addition counts at its new position."""
    position = F.coalesce("sent_idx_x", "sent_idx_y")
    if max_position is not None:
        matched = matched.where(position < max_position)
    return matched.groupBy(position.alias("sent_idx")).agg(
        *_rates(), F.count(F.lit(1)).alias("n")
    )


def corpus_totals(matched: DataFrame, total_versions: int) -> DataFrame:
    """Entries, versions, changes, their shares and the counts scaled to a larger corpus."""
    flags = edit_flags()
    per_pair = matched.groupBy(*PAIR).agg(
        *[F.sum(c.cast("int")).alias(n) for n, c in flags.items()], F.count(F.lit(1)).alias("n")
    )
    # one row per entry before the final sum, so no distinct count has to hold all entries
    per_entry = per_pair.groupBy("entry_id").agg(
        F.count(F.lit(1)).alias("versions"), *[F.sum(n).alias(n) for n in [*flags, "n"]]
    )
    total = per_entry.agg(
        F.count(F.lit(1)).alias("entries"), F.sum("versions").alias("versions"),
        *[F.sum(n).alias(f"{n}s") for n in flags], F.sum("n").alias("sentences"),
    )
    factor = F.lit(total_versions) / F.col("versions")
    return total.select(
        "*", *[(F.col(f"{n}s") / F.col("sentences")).alias(f"{n}_share") for n in flags],
        *[(F.col(f"{n}s") * factor).alias(f"scaled_{n}s") for n in flags],
    )


SKETCHED = ("entries", "versions", "sentences")


def corpus_sketches(sentences: DataFrame) -> DataFrame:
    """Per source the sketches of its distinct entries, versions and sentence texts, and its number of sentences.

    A sketch has a few kilobytes whatever it counted, and sketches add up: the table of a day can be
    united with that of all days before, and a large source is counted in parts like any other.
    """
    keys = {"entries": F.xxhash64("entry_id"), "versions": F.xxhash64("entry_id", "version"), "sentences": F.xxhash64("sentence")}
    sketches = [F.hll_sketch_agg(k, F.lit(14)).alias(n) for n, k in keys.items()]
    return sentences.groupBy("source").agg(*sketches, F.count(F.lit(1)).alias("rows"))


def add_sketches(*tables: DataFrame) -> DataFrame:
    """Several sketch tables as one: what both have seen counts once."""
    together = tables[0]
    for t in tables[1:]:
        together = together.unionByName(t)
    return together.groupBy("source").agg(*[F.hll_union_agg(n).alias(n) for n in SKETCHED], F.sum("rows").alias("rows"))


def sketched_totals(sketches: DataFrame) -> DataFrame:
    """Approximate distinct numbers for each source and, in the row without a source, for all of them."""
    whole = sketches.agg(F.lit(None).cast("string").alias("source"), *[F.hll_union_agg(n).alias(n) for n in SKETCHED], F.sum("rows").alias("rows"))
    both = sketches.select("source", *SKETCHED, "rows").unionByName(whole)
    return both.select("source", *[F.hll_sketch_estimate(n).alias(n) for n in SKETCHED], "rows")


def source_totals(versions: DataFrame, low: int = 1, high: int = 40) -> DataFrame:
    """Articles and versions per source, overall and for low < n < high versions."""
    per_entry = versions.groupBy("source", "entry_id").agg(F.count(F.lit(1)).alias("n"))
    inside = (F.col("n") > low) & (F.col("n") < high)
    return per_entry.groupBy("source").agg(
        F.count(F.lit(1)).alias("articles"), F.sum("n").alias("versions"),
        F.count_if(inside).alias("articles_in_band"),
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("versions_in_band"),
    )


def _version_counts(versions: DataFrame) -> DataFrame:
    """How many entries of a source have how many versions."""
    return (
        versions.groupBy("source", "entry_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("source", "n").agg(F.count(F.lit(1)).alias("entries"))
    )


def versions_per_entry(versions: DataFrame) -> DataFrame:
    """Median number of versions of an entry per source."""
    return weighted_quantiles(_version_counts(versions), ["source"], "n", "entries", {"median_versions": 0.5})


def p75_by_source(versions: DataFrame) -> DataFrame:
    """Upper quartile of the version counts per source, numbered from the highest."""
    q = weighted_quantiles(_version_counts(versions), ["source"], "n", "entries", {"p75": 0.75})
    # one row per source remains here
    return q.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("p75"), "source")))


def power_of_two_bin(n: Column) -> Column:
    """Lower end of the power-of-two bin of a positive count."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n)) - 1)


def version_histogram(versions: DataFrame) -> DataFrame:
    """Number of entries per version count with its power-of-two bin."""
    per = versions.select("entry_id", "num_versions").distinct().groupBy("num_versions").agg(
        F.count(F.lit(1)).alias("entries")
    )
    return per.withColumn("bin", power_of_two_bin(F.col("num_versions")))


def update_lag(versions: DataFrame) -> DataFrame:
    """Median and upper quartile of the days between adjacent versions per source."""
    pairs = adjacent_versions(versions, ["created"], ("source", "entry_id"))
    lag = pairs.select(
        "source", (F.unix_seconds("created_y") - F.unix_seconds("created_x")).alias("seconds")
    )
    q = quantiles(lag, ["source"], "seconds", {"median": 0.5, "p75": 0.75})
    return q.select("source", (F.col("median") / 86400).alias("median_days"), (F.col("p75") / 86400).alias("p75_days"))


def headline_change_rate(versions: DataFrame, width: int = 2) -> DataFrame:
    """Share of adjacent versions with a changed title by version bin."""
    pairs = adjacent_versions(versions, ["title"])
    return pairs.groupBy((F.floor(F.col("version_x") / width) * width).alias("version_bin")).agg(
        F.avg((F.col("title_x") != F.col("title_y")).cast("int")).alias("change_rate"), F.count(F.lit(1)).alias("n")
    )


def mean_match_distance(matched: DataFrame) -> DataFrame:
    """Mean distance per pair with 1 for an absent partner; unchanged pairs are left out."""
    dx, dy = (F.coalesce(f"avg_sentence_distance_{s}", F.lit(1.0)) for s in "xy")
    means = matched.groupBy(*PAIR).agg(F.avg((dx + dy) / 2).alias("mean_distance"))
    return means.where(F.col("mean_distance") != 0)


# Phrases of correction notes (lower case, substring) and of contributor lines.
CORRECTION_PATTERNS = {
    "corrected": ("corrected",),
    "revised": ("revised",),
    "article_was": ("article was",),
    "clarification": ("clarification",),
    "error": (" error ",),
    "earlier": ("earlier version", "earlier article"),
}
CONTRIBUTOR_PATTERNS = {
    "reporting_by": ("reporting by",),
    "additional_reporting": ("additional reporting",),
    "editing_by": ("editing by",),
    "contributed": ("contributed",),
}


def correction_tests(sentence: str = "sentence") -> dict[str, Column]:
    low = F.lower(F.col(sentence))
    tests = {"correction": low.contains("correction") & ~low.contains("correctional")}
    for name, phrases in CORRECTION_PATTERNS.items():
        test = F.lit(False)
        for p in phrases:
            test = test | low.contains(p)
        tests[name] = test
    return tests


def contains_any(column: str, patterns: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """One test per category: the lower-cased text contains one of its phrases."""
    low = F.lower(F.col(column))
    tests = {}
    for name, phrases in patterns.items():
        test = F.lit(False)
        for p in phrases:
            test = test | low.contains(p)
        tests[name] = test
    return tests


def categorise(df: DataFrame, keys: list[str], tests: dict[str, Column]) -> DataFrame:
    """Distinct (keys, category) of the tests a row passes, in one pass."""
    names = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda n: n.isNotNull())
    return df.select(*keys, F.explode(names).alias("category")).distinct()


def keyword_entries(versions: DataFrame, pattern: str, text: str = "summary") -> DataFrame:
    """All versions of the entries with a keyword in any version."""
    hits = versions.where(F.col(text).rlike(pattern)).select("entry_id").distinct()
    return versions.join(hits, "entry_id", "left_semi")


def any_version_matches(versions: DataFrame, test: Column, out: str = "matches") -> DataFrame:
    return versions.groupBy("entry_id").agg(F.bool_or(test).alias(out))


def label_odds(rows: DataFrame, label: str) -> DataFrame:
    """P(label | added) / P(label) and P(label | deleted) / P(label).

    ``rows`` has 0/1 columns ``is_added`` and ``is_deleted``.
    """
    per = rows.groupBy(label).agg(
        F.sum("is_added").alias("_a"), F.sum("is_deleted").alias("_d"), F.count(F.lit(1)).alias("_n")
    )
    sums = {c: per.agg(F.sum(c)).scalar() for c in ("_a", "_d", "_n")}
    share = F.col("_n") / sums["_n"]
    return per.select(
        label,
        F.try_divide(F.col("_a") / sums["_a"], share).alias("odds_added"),
        F.try_divide(F.col("_d") / sums["_d"], share).alias("odds_deleted"),
        F.col("_n").alias("n"),
    )


def label_share_by_bin(rows: DataFrame, bin_col: str, label: str) -> DataFrame:
    """Share of each label within its bin, and its ratio to the mean share over the bins."""
    counts = rows.groupBy(bin_col, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(bin_col).agg(F.sum("n").alias("_t"))
    shares = counts.join(totals, bin_col).select(bin_col, label, "n", (F.col("n") / F.col("_t")).alias("share"))
    means = shares.groupBy(label).agg(F.avg("share").alias("_m"))
    return shares.join(means, label).select(
        bin_col, label, "n", "share", (F.col("share") / F.col("_m")).alias("ratio")
    )


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson and Spearman correlation of two integer columns, from values centred on their means.

    Equal value pairs are counted first; ranks come from the distinct values, not from a sort of
    the table in one task.
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = both.groupBy(a, b).agg(F.count(F.lit(1)).alias("_w"))
    ranked = pairs.join(average_rank(both, a, "_ra"), a).join(average_rank(both, b, "_rb"), b)

    def weighted(x, y):
        x, y, w = F.col(x), F.col(y), F.col("_w")
        return F.try_divide(F.sum(w * x * y), F.sqrt(F.sum(w * x * x)) * F.sqrt(F.sum(w * y * y)))

    used = [a, b, "_ra", "_rb"]
    mean = {c: ranked.agg((F.sum(F.col("_w") * F.col(c).cast("double")) / F.sum("_w")).alias("_m")).scalar() for c in used}
    centred = ranked.select("_w", *[(F.col(c) - mean[c]).alias(f"_c{i}") for i, c in enumerate(used)])
    return centred.agg(weighted("_c0", "_c1").alias("pearson"), weighted("_c2", "_c3").alias("spearman"))


def tag_transitions(matched: DataFrame, tags: DataFrame, k: int) -> DataFrame:
    """Most frequent pairs of different tags of an old sentence and its new partner."""
    edges = matched.where("sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL")
    joined = attach_values(edges, tags.withColumn("value", F.col("tags")), ("_x", "_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    # equal tag lists are counted first, so the lists are spread once per distinct pair of lists
    counted = joined.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    spread = counted.select("_n", F.explode("_x").alias("tag_x"), "_y").select("_n", "tag_x", F.explode("_y").alias("tag_y"))
    return (
        spread.where("tag_x <> tag_y").groupBy("tag_x", "tag_y").agg(F.sum("_n").alias("n"))
        .orderBy(F.desc("n"), "tag_x", "tag_y").limit(k)
    )


def share_with_feature(rows: DataFrame, group: str, feature: str) -> DataFrame:
    """Share of rows whose feature list is not empty, per group."""
    return rows.groupBy(group).agg(
        F.avg((F.size(feature) > 0).cast("int")).alias("share"), F.count(F.lit(1)).alias("n")
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts and shares of the values of a column."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_t")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col).limit(k)


LIFT_PARTS = 4  # the runs are counted in so many parts, one after the other


def ngram_lift(
    sentences: DataFrame, text: str, flag: str, k: int, sizes: tuple[int, ...] = (1, 2), count: str | None = None
) -> DataFrame:
    """Runs of content tokens whose mean frequency in flagged sentences differs most from the overall mean.

    ``sentences`` has one row for each sentence with a 0/1 ``flag``, or for each text, with the number of its sentences in
    ``count`` and of the flagged ones in ``flag``; the k highest and the k lowest runs. Runs are counted by some thousand
    sentences before they are shuffled, and in ``LIFT_PARTS`` parts by their first token, so that only one part of them is on
    disk at a time. The totals follow from the lengths.
    """
    weight = F.lit(1).cast("long") if count is None else F.col(count).cast("long")
    once = sentences.select(tx.content_tokens(text).alias("t"), F.coalesce(F.col(flag).cast("long"), F.lit(0)).alias("f"), weight.alias("n"))
    once = materialise(once.where(F.size("t") > 0), "sentence_weights", "zstd")
    runs = sum((F.greatest(F.size("t") - (s - 1), F.lit(0)) for s in sizes), F.lit(0))
    totals = once.agg(F.sum(runs * F.col("f")).alias("flagged"), F.sum(runs * F.col("n")).alias("total")).first()

    def extremes(lift: DataFrame) -> DataFrame:
        top = lift.orderBy(F.desc("lift"), "ngram").limit(k).withColumn("side", F.lit("top"))
        bottom = lift.orderBy("lift", "ngram").limit(k).withColumn("side", F.lit("bottom"))
        return top.unionByName(bottom)

    found = []
    for part in range(LIFT_PARTS):
        per = once.mapInArrow(_runs_of_part(sizes, part), "ngram string, f long, n long").groupBy("ngram").agg(F.sum("f").alias("_f"), F.sum("n").alias("n"))
        lift = per.where("_f > 0").select(
            "ngram", "n", F.round((F.col("_f") / totals["flagged"]) / (F.col("n") / totals["total"]), 9).alias("lift")
        )
        found.append(materialise(extremes(lift), "lift"))
    # the extremes of all runs are among those of the parts
    return extremes(reduce(DataFrame.unionByName, found).select("ngram", "n", "lift").distinct())


def _runs_of_part(sizes: tuple[int, ...], part: int):
    """The runs whose first token falls into a part, added up by some thousand sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            lists = table.column("t").combine_chunks()
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            tokens = lists.flatten().dictionary_encode()
            words, code = tokens.dictionary, tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.array([zlib.crc32(w) % LIFT_PARTS == part for w in words.cast(pa.binary()).to_pylist()], bool)
            row = np.repeat(np.arange(len(size)), size)
            left = np.repeat(np.cumsum(size), size) - np.arange(len(row))  # tokens from here to the end of the sentence
            f, n = (table.column(c).to_numpy() for c in "fn")
            for s in sizes:
                start = np.flatnonzero((left >= s) & first[code])
                if not len(start):
                    continue
                key = code[start]
                for j in range(1, s):
                    key = np.unique(key, return_inverse=True)[1] * len(words) + code[start + j]
                at, group = np.unique(key, return_index=True, return_inverse=True)[1:]
                sums = [np.zeros(len(at), np.int64) for _ in "fn"]
                for total, values in zip(sums, (f, n)):
                    np.add.at(total, group, values[row[start]])
                text = [words.take(pa.array(code[start[at] + j])) for j in range(s)]
                ngram = pc.binary_join_element_wise(*text, " ") if s > 1 else text[0]
                yield pa.RecordBatch.from_arrays([ngram, *(pa.array(v) for v in sums)], ["ngram", "f", "n"])

    return run


def doc_len_attach(sentences: DataFrame, width: int = 10) -> DataFrame:
    """Sentences per document on every row, with its length bin."""
    doc = ["entry_id", "version"]
    sizes = sentences.groupBy(*doc).agg(F.count(F.lit(1)).alias("doc_len"))
    return sentences.join(sizes, doc).withColumn("len_bin", F.floor(F.col("doc_len") / width) * width)


def coverage(eligible: DataFrame, produced: DataFrame) -> DataFrame:
    """Processed pairs and entries against the eligible ones per source."""
    def agg(df, name):
        per = df.groupBy("source", "entry_id").agg(F.count(F.lit(1)).alias("_n"))
        return per.groupBy("source").agg(F.sum("_n").alias(f"{name}_pairs"), F.count(F.lit(1)).alias(f"{name}_entries"))

    both = agg(eligible, "eligible").join(agg(produced, "produced"), "source", "full").na.fill(0)
    return both.withColumn("finished", F.try_divide(F.col("produced_pairs"), F.col("eligible_pairs")))


def duplicate_audit(matched: DataFrame) -> DataFrame:
    """How many keys occur how many times."""
    per = matched.groupBy(*PAIR, "sent_idx_x", "sent_idx_y").agg(F.count(F.lit(1)).alias("multiplicity"))
    return per.groupBy("multiplicity").agg(F.count(F.lit(1)).alias("n"))


def dedup_keep_first(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """The row with the smallest id per key; NULL keys count as equal."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, F.col(row_id)).alias("_row")).select("_row.*")


def date_histogram(versions: DataFrame) -> DataFrame:
    day = F.date_trunc("day", "created").cast("date").alias("day")
    return versions.groupBy("source", day).agg(F.count(F.lit(1)).alias("n"))


def title_counts(versions: DataFrame, k: int) -> DataFrame:
    """Titles by the number of entries that used them."""
    return (
        versions.select("entry_id", "title").distinct().groupBy("title").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "title").limit(k)
    )


def partition_skew(df: DataFrame) -> DataFrame:
    """Rows in each partition that Spark has made; empty ones have no row."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n"))


def place_rows(df: DataFrame, partition: Column, partitions: int) -> DataFrame:
    """Rows in the partition that a rule names, 0 to ``partitions`` - 1."""
    return df.repartitionById(partitions, partition.cast("int"))
