"""Match the sentences of adjacent versions of a document.

The distance of a sentence x to a sentence y adds, over the words of x, the distance to the
nearest word of y (at most ``word_cutoff``) and divides by the word count of x. Each sentence
keeps its nearest partner when that is closer than ``sentence_threshold``.

Pairs are found by equal keys only, never by pairing all sentences of two versions:

1. sentences with an exact copy on the other side are settled by their text;
2. the rest is scored against the sentences that share a near word;
3. in pairs of very long documents even that is too much, so there the search goes in rungs of
   growing distance. A partner closer than ``tau`` shares at least ``1 - tau / word_cutoff`` of
   the words, so that many of the most frequent words may be left out of the search without
   losing one partner. Tight rungs search by rare words only and settle most sentences; the last
   rung uses the full threshold.

Every way is exact, so the result equals that of scoring all pairs.

Texts stay where they are: sentences meet by 128-bit keys of their texts, and the tokens of those that no
copy settles follow once, as 64-bit hashes, which only meet inside a pair of versions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from verstext.config import MatchConfig
from verstext.functions import text as tx
from verstext.operators.nearest import nearest_partners_of
from verstext.runtime import materialise, unsent

PAIR = ["entry_id", "version_x"]
RUNGS = (0.1, 0.25)
HEAVY_LIMIT = 4_000_000
ARRAY_LIMIT = 100_000_000  # the same for a search by arrays: some seconds of one task
SLACK = 1e-6


# ---------------------------------------------------------------- adjacent versions


def adjacent_versions(df: DataFrame, cols: list[str], keys=("entry_id",)) -> DataFrame:
    """Rows of version v next to rows of version v + 1 of the same entry."""
    x = df.select(*keys, F.col("version").alias("version_x"), *[F.col(c).alias(f"{c}_x") for c in cols])
    y = df.select(
        *keys,
        (F.col("version") - 1).alias("version_x"),
        F.col("version").alias("version_y"),
        *[F.col(c).alias(f"{c}_y") for c in cols],
    )
    return x.join(y, [*keys, "version_x"])


def version_pairs(df: DataFrame) -> DataFrame:
    """Distinct (entry_id, version_x) whose next version exists."""
    v = df.select("entry_id", "version").distinct()
    x = v.select("entry_id", F.col("version").alias("version_x"))
    y = v.select("entry_id", (F.col("version") - 1).alias("version_x"))
    return x.join(y, PAIR, "left_semi")


# ---------------------------------------------------------------- near words


def _near_keys(near: DataFrame) -> list[str]:
    """What a word meets its near words by: the pair of versions too, if the list tells them apart (``near.near_words``)."""
    return [*[c for c in PAIR if c in near.columns], "word_a"]


def _turned(near: DataFrame) -> DataFrame:
    """The list as the newer version sees it."""
    return near.select(*[F.col({"word_a": "word_b", "word_b": "word_a"}.get(c, c)).alias(c) for c in near.columns])


def word_pairs(word_rows: DataFrame, near: DataFrame | None) -> DataFrame:
    """Near word pairs of adjacent versions: equal keys first, then the list of near words."""
    x = word_rows.select(
        "entry_id", F.col("version").alias("version_x"), F.col("sent_idx").alias("sent_idx_x"),
        F.col("word_idx").alias("word_idx_x"), F.col("num_words").alias("num_words_x"),
        F.col("token").alias("token_x"), F.col("word").alias("word_a"),
    )
    y = word_rows.select(
        "entry_id", (F.col("version") - 1).alias("version_x"), F.col("version").alias("version_y"),
        F.col("sent_idx").alias("sent_idx_y"), F.col("word_idx").alias("word_idx_y"),
        F.col("num_words").alias("num_words_y"), F.col("token").alias("token_y"),
        F.col("word").alias("word_b"),
    )
    if near is None:
        x = x.withColumn("word_b", F.col("word_a")).withColumn("distance", F.lit(0.0))
    else:
        x = unsent(x).join(near, _near_keys(near))
    return x.join(unsent(y), [*PAIR, "word_b"]).drop("word_a", "word_b")


# ---------------------------------------------------------------- the scoring steps


SENT_PAIR = ["entry_id", "version_x", "version_y", "sent_idx_x", "sent_idx_y"]


def word_min_distance(pairs: DataFrame, side: str, norm: str = "own") -> DataFrame:
    """Distance of each word on ``side`` to its nearest word of the other sentence."""
    count = "num_words_x" if norm == "x" else f"num_words_{side}"
    return pairs.groupBy(*SENT_PAIR, f"word_idx_{side}").agg(
        F.min(count).alias("num_words"), F.min("distance").alias("min_word_distance")
    )


def sentence_distance(minima: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Mean word distance; a word without a near word counts as the cutoff."""
    sums = minima.groupBy(*SENT_PAIR).agg(
        F.sum("min_word_distance").alias("_s"),
        F.count(F.lit(1)).alias("_m"),
        F.min("num_words").alias("_n"),
    )
    return sums.select(*SENT_PAIR, _distance(config).alias("avg_sentence_distance"))


def _distance(config: MatchConfig):
    missing = F.col("_n") - F.col("_m")
    return F.round((F.col("_s") + F.lit(config.word_cutoff) * missing) / F.col("_n"), config.digits)


def best_match(scored: DataFrame, side: str) -> DataFrame:
    """Nearest partner per sentence of ``side``; ties go to the nearest position, then the lower index."""
    other = "y" if side == "x" else "x"
    own_idx, other_idx = f"sent_idx_{side}", f"sent_idx_{other}"
    rank = F.struct(
        F.col("avg_sentence_distance").alias("d"),
        F.abs(F.col("sent_idx_x") - F.col("sent_idx_y")).alias("gap"),
        F.col(other_idx).alias("other"),
    )
    return (
        scored.groupBy("entry_id", "version_x", "version_y", own_idx)
        .agg(F.min(rank).alias("_best"))
        .select(
            "entry_id", "version_x", "version_y", own_idx,
            F.col("_best.other").alias(other_idx), F.col("_best.d").alias("avg_sentence_distance"),
        )
    )


def apply_threshold(best: DataFrame, side: str, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Partner and distance become NULL where the distance is not below the threshold."""
    other_idx = "sent_idx_y" if side == "x" else "sent_idx_x"
    close = F.col("avg_sentence_distance") < config.sentence_threshold
    return best.withColumn(other_idx, F.when(close, F.col(other_idx))).withColumn(
        "avg_sentence_distance", F.when(close, F.col("avg_sentence_distance"))
    )


def combine_sides(x_side: DataFrame, y_side: DataFrame) -> DataFrame:
    """Both directions in one table; a pair found from both sides becomes one row.

    Equal keys meet in one aggregation. A NULL index occurs once per sentence, so grouping keeps
    such rows apart just as a full outer join would.
    """
    def side(df, name):
        dist = F.col("avg_sentence_distance")
        null = F.lit(None).cast("double")
        return df.select(
            *SENT_PAIR,
            (dist if name == "x" else null).alias("dx"),
            (dist if name == "y" else null).alias("dy"),
        )

    return (
        side(x_side, "x").unionByName(side(y_side, "y"))
        .groupBy(*SENT_PAIR)
        .agg(
            F.max("dx").alias("avg_sentence_distance_x"), F.max("dy").alias("avg_sentence_distance_y")
        )
    )


def match_steps(pairs: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """The scoring steps one after the other on a table of word pairs, without completion."""
    sides = {}
    for side in "xy":
        scored = sentence_distance(word_min_distance(pairs, side, config.norm), config)
        sides[side] = apply_threshold(best_match(scored, side), side, config)
    return combine_sides(sides["x"], sides["y"])


def complete_matches(matched: DataFrame, sentences: DataFrame) -> DataFrame:
    """Add the sentences that a match table lost because none of their words had a near word."""
    pairs = unsent(version_pairs(sentences))
    keys = sentences.select("entry_id", "version", "sent_idx")
    known = unsent(matched)
    old = keys.select(
        "entry_id", F.col("version").alias("version_x"), F.col("sent_idx").alias("sent_idx_x")
    ).join(pairs, PAIR, "left_semi")
    new = keys.select(
        "entry_id", (F.col("version") - 1).alias("version_x"), F.col("sent_idx").alias("sent_idx_y")
    ).join(pairs, PAIR, "left_semi")
    lost_old = old.join(known.where("sent_idx_x IS NOT NULL"), [*PAIR, "sent_idx_x"], "left_anti")
    lost_new = new.join(known.where("sent_idx_y IS NOT NULL"), [*PAIR, "sent_idx_y"], "left_anti")
    extra = lost_old.unionByName(lost_new, allowMissingColumns=True).withColumn(
        "version_y", F.col("version_x") + 1
    )
    return matched.unionByName(extra, allowMissingColumns=True)


# ---------------------------------------------------------------- the whole match


def _sides(sentences: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Each sentence, by the key of its text, once as an older and once as a newer one, keyed by the older version."""
    sentences = sentences.withColumn("text", tx.text_key("sentence"))
    cols = ["entry_id", "sent_idx", "text", *more]
    old = sentences.select(*cols, F.col("version").alias("version_x"), F.lit("x").alias("side"))
    new = sentences.select(*cols, (F.col("version") - 1).alias("version_x"), F.lit("y").alias("side"))
    return old.unionByName(new)


def exact_partners(sentences: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Every sentence in both roles with the nearest equal sentence of the other side, or NULL.

    Two running extremes over the occurrences of one text replace the pairs of occurrences.
    Columns named in ``more`` are carried along.
    """
    rows = _sides(sentences, more)
    up = Window.partitionBy(*PAIR, "text").orderBy("sent_idx")
    down = Window.partitionBy(*PAIR, "text").orderBy(F.desc("sent_idx"))
    at_x = F.when(F.col("side") == "x", F.col("sent_idx"))
    at_y = F.when(F.col("side") == "y", F.col("sent_idx"))
    rows = (
        rows.withColumn("_bx", F.max(at_x).over(up)).withColumn("_by", F.max(at_y).over(up))
        .withColumn("_ax", F.min(at_x).over(down)).withColumn("_ay", F.min(at_y).over(down))
    )
    before = F.when(F.col("side") == "x", F.col("_by")).otherwise(F.col("_bx"))
    after = F.when(F.col("side") == "x", F.col("_ay")).otherwise(F.col("_ax"))
    idx = F.col("sent_idx")
    nearest = (
        F.when(before.isNull(), after)
        .when(after.isNull(), before)
        .when(idx - before <= after - idx, before)
        .otherwise(after)
    )
    return rows.withColumn("partner", nearest).drop("text", "_bx", "_by", "_ax", "_ay")


def _token_column(near: DataFrame | None) -> Column:
    """Tokens as hashes, or as texts where a list of near words names them."""
    return tx.token_hashes("sentence") if near is None else tx.tokens("sentence")


def _open_tokens(settled: DataFrame, sentences: DataFrame, near: DataFrame | None, every: bool) -> DataFrame:
    """``entry_id, version, sent_idx, tokens`` of the sentences that are searched, or of all."""
    place = ["entry_id", "version", "sent_idx"]
    rows = sentences.select(*place, _token_column(near).alias("tokens"))
    if every:
        return rows
    version = F.col("version_x") + (F.col("side") == "y").cast("int")
    opened = settled.where("partner IS NULL").select("entry_id", version.alias("version"), "sent_idx").distinct()
    return materialise(rows.join(opened, place, "left_semi"), "open_tokens")


def _spread_words(side: _Side, rows: DataFrame, version_shift: int) -> DataFrame:
    """Word rows (pair key, sent_idx, word, num_words) of sentence rows, from their tokens or a given word table."""
    if side.words is None:
        at = (F.col("version") + version_shift).alias("version_x")
        found = side.tokens.select("entry_id", at, "sent_idx", "tokens").join(rows.select(*PAIR, "sent_idx"), [*PAIR, "sent_idx"])
        return found.select(*PAIR, "sent_idx", F.size("tokens").alias("num_words"), F.explode("tokens").alias("word"))
    keyed = side.words.select(
        "entry_id", (F.col("version") + version_shift).alias("version_x"), "sent_idx", "num_words", "word"
    )
    return keyed.join(rows.select(*PAIR, "sent_idx"), [*PAIR, "sent_idx"], "left_semi")


@dataclass(frozen=True)
class _Side:
    """Inputs of one search direction; ``sent_idx`` is the searching side, ``other`` the partner."""

    name: str
    words: DataFrame | None
    near: DataFrame | None
    config: MatchConfig
    others: DataFrame
    tokens: DataFrame | None = None

    @property
    def own_norm(self) -> bool:
        return self.config.norm == "own" or self.name == "x"


def _other_words(sentences: DataFrame, words: DataFrame | None, shift: int, sized: bool, near: DataFrame | None = None) -> DataFrame:
    """Distinct words of the sentences that can be partners, with their word count if ``sized``."""
    size = ["n_other"] if sized else []
    if words is None:
        rows = sentences.select(
            "entry_id", (F.col("version") + shift).alias("version_x"), F.col("sent_idx").alias("other"),
            _token_column(near).alias("_t"),
        )
        return rows.withColumn("n_other", F.size("_t")).select(
            *PAIR, "other", *size, F.explode(F.array_distinct("_t")).alias("word_b")
        )
    return words.select(
        "entry_id", (F.col("version") + shift).alias("version_x"), F.col("sent_idx").alias("other"),
        F.col("num_words").alias("n_other"), F.col("word").alias("word_b"),
    ).select(*PAIR, "other", *size, "word_b").distinct()


def _hits(side: _Side, rows: DataFrame, on: list[str]) -> DataFrame:
    """Word distances and matched words summed per candidate pair of sentences.

    ``rows`` holds (pair, sent_idx, word, c, n); ``on`` adds ``other`` when the partner is given.
    """
    keys = [*PAIR, "sent_idx", "other"]
    sized = not side.own_norm
    sizes = [F.max("n").alias("_own"), *([F.max("n_other").alias("_other")] if sized else [])]
    if side.near is None:
        found = rows.withColumnRenamed("word", "word_b").join(side.others, [*PAIR, *on, "word_b"])
        return found.groupBy(*keys).agg(F.lit(0.0).alias("_s"), F.sum("c").alias("_m"), *sizes)
    near = side.near if side.name == "x" else _turned(side.near)
    # the distance of a word to a partner is found once for all sentences with the word, and lies where they meet it
    near = rows.select(*PAIR, F.col("word").alias("word_a")).distinct().join(near, _near_keys(near))
    nearest = near.join(side.others, [*PAIR, "word_b"]).withColumnRenamed("word_a", "word").repartition(*PAIR, "word").groupBy(
        *PAIR, "word", "other"
    ).agg(F.min("distance").alias("d"), *([F.max("n_other").alias("n_other")] if sized else []))
    return rows.join(nearest, [*PAIR, *on, "word"]).groupBy(*keys).agg(
        F.sum(F.col("c") * F.col("d")).alias("_s"), F.sum("c").alias("_m"), *sizes
    )


def _nearest(side: _Side, sums: DataFrame, tau: float) -> DataFrame:
    """Best partner below ``tau`` per sentence; ties as in ``best_match``."""
    sums = sums.withColumn("_n", F.col("_own") if side.own_norm else F.col("_other"))
    scored = sums.withColumn("avg_sentence_distance", _distance(side.config))
    rank = F.struct(
        F.col("avg_sentence_distance").alias("d"),
        F.abs(F.col("sent_idx") - F.col("other")).alias("gap"),
        F.col("other").alias("o"),
    )
    best = scored.where(F.col("avg_sentence_distance") < tau).groupBy(*PAIR, "sent_idx").agg(
        F.min(rank).alias("_b")
    )
    return best.select(
        *PAIR, "sent_idx", F.col("_b.o").alias("partner"), F.col("_b.d").alias("avg_sentence_distance")
    )


def _bags(spread: DataFrame) -> DataFrame:
    return spread.groupBy(*PAIR, "sent_idx", "word").agg(
        F.count(F.lit(1)).alias("c"), F.max("num_words").alias("n")
    )


def _search_direct(side: _Side, spread: DataFrame) -> DataFrame:
    """Score every pair of sentences that shares a near word."""
    if side.near is None:
        # the sum over repeated words replaces the count, so rows need no aggregation first
        rows = spread.select(*PAIR, "sent_idx", "word", F.lit(1).alias("c"), F.col("num_words").alias("n"))
    else:
        rows = _bags(spread)
    return _nearest(side, _hits(side, rows, []), side.config.sentence_threshold)


def _search_in_rungs(side: _Side, spread: DataFrame, rungs: tuple[float, ...]) -> DataFrame:
    """The same result for pairs of long documents, rare words first."""
    config = side.config
    bags = _bags(spread)
    rarity = bags.groupBy("word").agg(F.count(F.lit(1)).alias("_freq"))
    # config.frequent_words rows whatever the data, so the broadcast has a fixed bound
    common = rarity.orderBy(F.desc("_freq"), "word").limit(config.frequent_words)
    by_freq = Window.partitionBy(*PAIR, "sent_idx").orderBy(F.desc("_freq"), "word")
    bags = (
        bags.join(F.broadcast(common), "word", "left")
        .withColumn("_freq", F.coalesce("_freq", F.lit(0)))
        .withColumn("cum", F.sum("c").over(by_freq.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_freq")
    )
    bags = materialise(bags, "bags")
    steps = [t for t in rungs if t < config.sentence_threshold]
    best = None
    for tau in [*steps, config.sentence_threshold]:
        share = 1 - tau / config.word_cutoff
        spare = F.floor(F.col("n") * share - SLACK)
        first = _hits(side, bags.where(F.col("cum") > spare), [])
        may_miss = F.greatest(F.floor(F.col("_own") * share - SLACK), F.lit(0))
        at_best = F.col("_s") + config.word_cutoff * (
            F.col("_own") - F.least(F.col("_own"), F.col("_m") + may_miss)
        )
        first = first.where(at_best < tau * F.col("_own") + SLACK)
        rest = first.select(*PAIR, "sent_idx", "other").join(
            bags.where(F.col("cum") <= spare), [*PAIR, "sent_idx"]
        )
        sums = first.unionByName(_hits(side, rest, ["other"])).groupBy(*PAIR, "sent_idx", "other").agg(
            F.sum("_s").alias("_s"), F.sum("_m").alias("_m"), F.max("_own").alias("_own")
        )
        found = materialise(_nearest(side, sums, tau), "rung")
        bags = bags.join(found, [*PAIR, "sent_idx"], "left_anti")
        best = found if best is None else best.unionByName(found)
    return best


def _search(side: _Side, open_rows: DataFrame, heavy: DataFrame | None, rungs, shift: int) -> DataFrame:
    """Best partners of ``open_rows``; pairs of versions named in ``heavy`` are searched in rungs."""
    if heavy is None:
        return _search_direct(side, _spread_words(side, open_rows, shift))
    light_rows = open_rows.join(heavy, PAIR, "left_anti")
    heavy_rows = open_rows.join(heavy, PAIR, "left_semi")
    return _search_direct(side, _spread_words(side, light_rows, shift)).unionByName(
        _search_in_rungs(side, _spread_words(side, heavy_rows, shift), rungs)
    )


def _one_side(side: _Side, settled: DataFrame, heavy: DataFrame | None, rungs) -> DataFrame:
    own = settled.where(F.col("side") == side.name)
    exact = own.where("partner IS NOT NULL").select(
        *PAIR, "sent_idx", "partner", F.lit(0.0).alias("avg_sentence_distance")
    )
    shift = 0 if side.name == "x" else -1
    if not side.own_norm:
        return _named(_with_foreign_norm(side, own, exact, shift), side.name)
    open_rows = own.where("partner IS NULL")
    best = _search(side, open_rows, heavy, rungs, shift)
    opened = open_rows.select(*PAIR, "sent_idx").join(best, [*PAIR, "sent_idx"], "left")
    return _named(exact.unionByName(opened), side.name)


def _with_foreign_norm(side: _Side, own: DataFrame, exact: DataFrame, shift: int) -> DataFrame:
    """Divided by the partner's word count a distance can fall below zero, so an equal text does
    not settle a sentence: every sentence is searched, and the equal text only wins a tie."""
    found = _search_direct(side, _spread_words(side, own, shift))
    rank = F.struct("avg_sentence_distance", "inexact", "partner")
    best = (
        exact.withColumn("inexact", F.lit(0)).unionByName(found.withColumn("inexact", F.lit(1)))
        .groupBy(*PAIR, "sent_idx").agg(F.min(rank).alias("_b"))
        .select(*PAIR, "sent_idx", "_b.partner", "_b.avg_sentence_distance")
    )
    return own.select(*PAIR, "sent_idx").join(best, [*PAIR, "sent_idx"], "left")


def _named(rows: DataFrame, own: str) -> DataFrame:
    other = "y" if own == "x" else "x"
    return rows.select(
        *PAIR,
        (F.col("version_x") + 1).alias("version_y"),
        F.col("sent_idx").alias(f"sent_idx_{own}"),
        F.col("partner").alias(f"sent_idx_{other}"),
        "avg_sentence_distance",
    )


def _heavy_pairs(settled: DataFrame, limit: int) -> DataFrame:
    """Pairs of versions with more than ``limit`` (open sentence, possible partner) combinations."""
    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    x, opened = F.col("side") == "x", F.col("partner").isNull()
    work = F.greatest(n(x & opened) * n(~x), n(~x & opened) * n(x))
    return settled.groupBy(*PAIR).agg(work.alias("_work")).where(F.col("_work") > limit).select(*PAIR)


def match_bidirectional(
    sentences: DataFrame,
    words: DataFrame | None = None,
    near: DataFrame | None = None,
    config: MatchConfig = MatchConfig(),
    rungs: tuple[float, ...] = RUNGS,
    heavy_limit: int | None = None,
) -> DataFrame:
    """Match table of all adjacent versions, complete on both sides.

    Without ``words`` the words are the lower-cased tokens; without ``near`` only equal words are
    near each other, at distance zero. ``near`` is a list of near words, or that of each pair of versions
    (``near.near_words``), which needs no list of all near words of the vocabulary. Pairs of long documents (more than ``heavy_limit``
    combinations of sentences) are searched in rungs, all others directly; both are exact.
    """
    if words is None and near is None and config.norm == "own":
        return _match_equal_words(sentences, config, rungs, ARRAY_LIMIT if heavy_limit is None else heavy_limit)
    heavy_limit = HEAVY_LIMIT if heavy_limit is None else heavy_limit
    settled = exact_partners(sentences).join(version_pairs(sentences), PAIR, "left_semi")
    settled = materialise(settled, "settled")
    tokens = _open_tokens(settled, sentences, near, config.norm != "own") if words is None else None
    heavy = None
    if config.norm == "own":
        heavy = _heavy_pairs(settled, heavy_limit)
        if heavy.isEmpty():
            heavy = None
    x = _Side("x", words, near, config, _other_words(sentences, words, -1, False, near), tokens)
    y = _Side("y", words, near, config, _other_words(sentences, words, 0, config.norm != "own", near), tokens)
    # one after the other: the shuffles of the first side are gone when the second is searched
    return combine_sides(*[materialise(_one_side(side, settled, heavy, rungs), "side") for side in (x, y)])


def _match_equal_words(sentences: DataFrame, config: MatchConfig, rungs: tuple[float, ...], heavy_limit: int) -> DataFrame:
    """The match by equal words: all but the heavy pairs of versions are searched where their sentences lie."""
    found = materialise(nearest_partners_of(sentences, config, heavy_limit), "partners")
    light = found.where("side IS NULL").drop("side")
    light.stored_at = found.stored_at
    searched = found.where("side IS NOT NULL")
    if searched.isEmpty():
        return light
    own, partner = (F.when(F.col("side") == "x", F.col(f"sent_idx_{a}")).otherwise(F.col(f"sent_idx_{b}")) for a, b in ("xy", "yx"))
    settled = searched.select(*PAIR, "side", own.alias("sent_idx"), partner.alias("partner"))
    heavy = materialise(settled.select(*PAIR).distinct(), "heavy")
    versions = heavy.select("entry_id", F.explode(F.array("version_x", F.col("version_x") + 1)).alias("version")).distinct()
    sentences = materialise(sentences.join(versions, ["entry_id", "version"], "left_semi"), "heavy_sentences", "zstd")
    tokens = _open_tokens(settled, sentences, None, False)
    sides = []
    for name, shift in (("x", -1), ("y", 0)):
        version = F.col("version_x") + (0 if name == "y" else 1)
        there = sentences.join(heavy.select("entry_id", version.alias("version")), ["entry_id", "version"], "left_semi")
        side = _Side(name, None, None, config, _other_words(there, None, shift, False), tokens)
        sides.append(_one_side(side, settled, heavy, rungs))
    return light.unionByName(combine_sides(*sides))


# ---------------------------------------------------------------- sentences that arrive over time


PARTNER = ["entry_id", "version_x", "side", "sent_idx"]


def improved_partners(
    sentences: DataFrame, config: MatchConfig = MatchConfig(), rungs: tuple[float, ...] = RUNGS, heavy_limit: int = HEAVY_LIMIT
) -> DataFrame:
    """What new sentences (``fresh``) change in the partners of the versions that they touch.

    One row for every sentence of the touched pairs of versions: its nearest partner among the new
    sentences, or among all if it is new itself, or NULL. Old sentences are not compared
    with old ones again. ``nearest_partners`` adds such tables up.
    """
    changed = sentences.where("fresh").select("entry_id", F.explode(F.array("version", F.col("version") - 1)).alias("version_x"))
    pairs = changed.distinct().join(version_pairs(sentences), PAIR, "left_semi")
    settled = exact_partners(sentences, ("fresh",)).join(pairs, PAIR, "left_semi")
    settled = materialise(settled, "settled")
    tokens = _open_tokens(settled, sentences, None, config.norm != "own")
    heavy = None
    if config.norm == "own":
        heavy = _heavy_pairs(settled, heavy_limit)
        if heavy.isEmpty():
            heavy = None
    sides = []
    for name, shift in (("x", 0), ("y", -1)):
        sized = name == "y" and config.norm != "own"
        own = settled.where(F.col("side") == name)
        every, new = (_other_words(s, None, -1 - shift, sized) for s in (sentences, sentences.where("fresh")))
        # without a norm of its own a distance can fall below that of an equal text, so all are searched
        wanted = own if sized else own.where("partner IS NULL")
        found = [
            _search(_Side(name, None, None, config, others, tokens), wanted.where(rows), heavy, rungs, shift)
            for rows, others in ((F.col("fresh"), every), (~F.col("fresh"), new))
        ]
        exact = own.select(*PAIR, "sent_idx", "partner", F.lit(0).alias("inexact"), F.when(F.col("partner").isNotNull(), 0.0).alias("avg_sentence_distance"))
        near = found[0].unionByName(found[1]).withColumn("inexact", F.lit(1))
        sides.append(exact.unionByName(near.select(*exact.columns)).withColumn("side", F.lit(name)))
    return nearest_partners(sides[0].unionByName(sides[1]))


def nearest_partners(rows: DataFrame) -> DataFrame:
    """The nearest of several partners of a sentence; equal texts, then positions settle ties as in the match.

    Adding up parts in any order and more than once gives the same table.
    """
    gap = F.abs(F.col("sent_idx") - F.col("partner"))
    rank = F.struct("avg_sentence_distance", "inexact", gap.alias("gap"), "partner")
    best = rows.groupBy(*PARTNER).agg(F.min(F.when(F.col("partner").isNotNull(), rank)).alias("best"))
    return best.select(*PARTNER, "best.partner", "best.inexact", "best.avg_sentence_distance")


def match_of_partners(partners: DataFrame) -> DataFrame:
    """The match table of a table of nearest partners."""
    return combine_sides(*[_named(partners.where(F.col("side") == name), name) for name in "xy"])
