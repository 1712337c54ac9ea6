"""Mixing sources to target weights with DataFrame functions only.

The words of a source form one stream, cut into blocks of equal length. Output shards have a fixed
number of slots; every slot draws a source, which gives each shard multinomial source counts. Where
a source drew more slots than its target allows, its last slots go to the sources that drew too
few. The slots of a source run through its blocks pass by pass, each pass in its own pseudorandom
order, and blocks are joined to slots by their index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from verstext.operators.ordering import running_total
from verstext.runtime import materialise

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    block_words: int = 128
    shard_slots: int = 4096
    most_passes: int = 3
    weights: tuple[int, ...] = (1, 2, 3)
    rounds: int = 12
    band_rows: int = 256
    task_slots: int = 65_536
    seed: str = "mix"


def hashed(*parts) -> Column:
    """60 bits of the MD5 of the parts, as a whole number."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``key, source, size, tie`` of every row; size is the number of words."""
    return docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("tie"),
    )


def source_plan(sized: DataFrame, config: MixConfig) -> DataFrame:
    """One row for each source: number, size, target, blocks and the slots it gets.

    Works on one row for each source. Sources are taken in the order of the size that they could
    give for each unit of weight: while that is not above the level of the rest, they are full.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weighted = totals.withColumn("source_no", place.cast("long")).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, config.weights)), (place % len(config.weights) + 1).cast("int"))
    )
    whole = Window.partitionBy(F.lit(0))
    by_room = whole.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    room = F.col("source_size") * config.most_passes
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(0, Window.unboundedFollowing)
    level = weighted.select(
        "*", F.sum("source_size").over(whole).alias("all"), F.coalesce(F.sum(room).over(before), F.lit(0)).alias("full"),
        F.sum("weight").over(after).alias("left"),
    )
    # full: this source and all before it cannot take more than they have
    filled = level.withColumn("is_full", room * F.col("left") <= (F.col("all") - F.col("full")) * F.col("weight"))
    open_full = F.max(F.when(F.col("is_full"), F.col("full") + room)).over(whole)
    open_left = F.max(F.when(~F.col("is_full"), F.col("left"))).over(whole)
    share = (F.col("all") - F.coalesce(open_full, F.lit(0))) * F.col("weight") / open_left
    target = F.when(F.col("is_full"), room.cast("double")).otherwise(share.cast("double"))
    planned = filled.withColumn("target", target).withColumn("blocks", F.ceil(F.col("source_size") / config.block_words).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.col("blocks") * config.most_passes))
    planned = planned.withColumn("slots", F.coalesce(slots, F.lit(0)).cast("long"))
    upto = F.sum("slots").over(whole.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0))
    return planned.select("source", "source_no", "source_size", "target", "blocks", "slots", (upto - F.col("slots")).alias("low"))


def look_up(points: DataFrame, at: Column, ranges: DataFrame, low: str, count: str, total: int) -> DataFrame:
    """Join each point to the range ``low .. low + count - 1`` that holds it, by equal cells.

    The ranges lie side by side over ``0 .. total - 1`` and are cut into at most 1024 cells, so
    there is one row for each range and cell.
    """
    width = -(-total // 1024)
    high = F.col(low) + F.col(count)
    cells = ranges.where(F.col(count) > 0).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((high - 1) / width)))
    )
    placed = points.withColumn("at", at).withColumn("cell", F.floor(F.col("at") / width))
    return placed.join(cells, "cell").where((F.col("at") >= F.col(low)) & (F.col("at") < high)).drop("cell")


def shard_counts(spark, plan: DataFrame, total: int, config: MixConfig) -> DataFrame:
    """``source_no, shard, n, first``: slots of each source in each shard, numbered through the shards."""
    slots = spark.range(total).select("id", F.floor(F.col("id") / config.shard_slots).alias("shard"))
    quota = plan.select("source_no", "slots", "low")
    drawn = look_up(slots, hashed(config.seed, F.lit("draw"), F.col("id")) % total, quota, "low", "slots", total)
    counts = materialise(drawn.groupBy("source_no", "shard").agg(F.count(F.lit(1)).alias("n")), "mix_draws")
    ranked = running_total(counts, ["source_no"], "shard", "n", "first", width=4096, levels=1)
    within = ranked.join(quota, "source_no").withColumn(
        "kept", F.greatest(F.lit(0), F.least(F.col("n"), F.col("slots") - F.col("first")))
    )
    within = materialise(within.select("source_no", "shard", "n", "kept"), "mix_kept")
    taken = within.groupBy("source_no").agg(F.sum("kept").alias("kept"))
    short = quota.join(taken, "source_no", "left").select("source_no", (F.col("slots") - F.coalesce("kept", F.lit(0))).alias("short"))
    upto = F.sum("short").over(Window.partitionBy(F.lit(0)).orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0))
    short = short.withColumn("low", upto - F.col("short"))
    freed = within.groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("freed"))
    freed = running_total(freed, [], "shard", "freed", "start", width=4096, levels=1).where("freed > 0")
    units = freed.select("shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("freed") - 1)).alias("unit"))
    given = look_up(units, F.col("unit"), short, "low", "short", total).groupBy("source_no", "shard").agg(F.count(F.lit(1)).alias("n"))
    final = within.select("source_no", "shard", F.col("kept").alias("n")).unionAll(given.select("source_no", "shard", "n"))
    final = final.groupBy("source_no", "shard").agg(F.sum("n").alias("n")).where("n > 0")
    return running_total(final, ["source_no"], "shard", "n", "first", width=4096, levels=1)


def permuted(index: Column, size: Column, keys: Column, name: list[Column], config: MixConfig) -> Column:
    """Swap-or-not permutation of ``0 .. size - 1``: in each round an index and its mirror image
    about the round's key change places if a hash bit of the pair says so."""

    def turn(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.element_at(keys, r) - x, size)
        bit = F.substring(F.md5(F.concat_ws(":", F.lit(config.seed), *name, r.cast("string"), F.greatest(x, mirror).cast("string"))), 1, 1)
        return F.when(bit >= "8", mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(config.rounds)), index, turn)


def block_slots(spark, plan: DataFrame, total: int, config: MixConfig) -> DataFrame:
    """``source_no, shard, pass_no, block``: one row for each slot of the mix."""
    counts = shard_counts(spark, plan, total, config)
    # counts are small, but each stands for many slots: they are dealt to as many tasks as the slots need
    counts = counts.repartition(max(1, -(-total // config.task_slots)), "source_no", "shard")
    numbered = counts.select(
        "source_no", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("number")
    ).join(plan.select("source_no", "blocks"), "source_no")
    passes = numbered.withColumn("pass_no", F.floor(F.col("number") / F.col("blocks")))
    name = [F.col("source_no").cast("string"), F.col("pass_no").cast("string")]
    keys = plan.where("slots > 0").select("source_no", "blocks", F.explode(F.sequence(F.lit(0), F.lit(config.most_passes - 1))).alias("pass_no"))
    keys = keys.select(
        "source_no", F.col("pass_no").cast("long").alias("pass_no"),
        F.array(*[F.pmod(hashed(config.seed, "key", F.col("source_no"), F.col("pass_no"), r), F.col("blocks")) for r in range(1, config.rounds + 1)]).alias("keys"),
    )
    ready = passes.join(keys, ["source_no", "pass_no"])
    order = F.pmod(F.col("number"), F.col("blocks"))
    return ready.select("source_no", "shard", "number", "pass_no", permuted(order, F.col("blocks"), F.col("keys"), name, config).alias("block"))


def streams(sized: DataFrame, plan: DataFrame, n_rows: int, config: MixConfig) -> DataFrame:
    """Every row with the place of its first word in the stream of its source (``start``)."""
    bands = max(1, -(-n_rows // config.band_rows))
    numbered = sized.join(plan.select(F.col("source").alias("s"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    banded = numbered.withColumn("band", F.pmod(F.xxhash64("key", "tie"), F.lit(bands)))
    inside = Window.partitionBy("source_no", "band").orderBy("key", "tie", "size").rowsBetween(Window.unboundedPreceding, 0)
    banded = materialise(banded.withColumn("local", F.sum("size").over(inside) - F.col("size")), "mix_streams")
    totals = banded.groupBy("source_no", "band").agg(F.sum("size").alias("band_size"))
    offsets = running_total(totals, ["source_no"], "band", "band_size", "offset", width=4096, levels=1).drop("band_size")
    return banded.join(offsets, ["source_no", "band"]).withColumn("start", F.col("offset") + F.col("local")).drop("band", "offset", "local")


def mix(docs: DataFrame, config: MixConfig = MixConfig(), key: str = "doc_id", text: str = "text", source: str = "source"):
    """``(rows, pieces)``: the documents in their streams, and the words that each slot takes.

    ``rows``: key, source, size, tie, source_no, source_size, target, start. ``pieces``: source_no, start, shard, number,
    pass_no, first and last: words ``first .. last - 1`` of the row that begins at ``start`` of
    its source's stream. A NULL or empty text has no words and is never taken. A NULL source is a
    source of its own, the last. Repeated rows follow each other in the stream. An empty table
    gives empty results. Other columns are not read.
    """
    spark = docs.sparkSession
    sized = materialise(sizes(docs, key, text, source), "mix_sizes")
    plan = materialise(source_plan(sized, config), "mix_plan")
    total, n_rows = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0], sized.count()
    rows = materialise(streams(sized, plan, n_rows, config), "mix_rows")
    length = config.block_words
    blocks = F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("size") - 1) / length))
    parts = rows.where("size > 0").select("source_no", "start", "size", F.explode(blocks).alias("block"))
    if not total:
        slots = spark.createDataFrame([], "source_no long, shard long, number long, pass_no long, block long")
    else:
        slots = block_slots(spark, plan, total, config)
    begin = F.greatest(F.lit(0), F.col("block") * length - F.col("start"))
    end = F.least(F.col("size"), (F.col("block") + 1) * length - F.col("start"))
    pieces = parts.join(slots, ["source_no", "block"]).select(
        "source_no", "start", "shard", "number", "pass_no", begin.alias("first"), end.alias("last")
    )
    return rows, pieces


def taken_words(docs: DataFrame, config: MixConfig = MixConfig(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``docs``."""
    rows, pieces = mix(docs, config, key, text, source)
    taken = pieces.groupBy("source_no", "start").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    found = rows.join(taken, ["source_no", "start"], "left")
    return found.select(
        F.col("key").alias(key), "size", "source_size", "target",
        F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, config: MixConfig = MixConfig(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as documents: one row for each document and pass that takes words of it.

    A pass that takes all words keeps the text as it is; otherwise the text is the taken words with
    the white space before them, in their order. All columns are kept, ``n_chars`` follows the text
    if there is such a column. Rows that nothing is taken of do not appear.
    """
    rows, pieces = mix(docs, config, key, text, source)
    spans = pieces.groupBy("source_no", "start", "pass_no").agg(
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("__spans"), F.sum(F.col("last") - F.col("first")).alias("n")
    )
    nth = Window.partitionBy("key", "source", "tie").orderBy("start")
    numbered = rows.where("size > 0").withColumn("nth", F.row_number().over(nth))
    chosen = numbered.join(spans, ["source_no", "start"]).select(
        F.col("key").alias("__key"), F.col("source").alias("__source"), F.col("tie").alias("__tie"), F.col("nth").alias("__nth"),
        (F.col("n") == F.col("size")).alias("__whole"), "__spans",
    )
    tie = F.xxhash64(text)
    full = docs.withColumn("__row", F.row_number().over(Window.partitionBy(key, source, tie).orderBy(key)))
    same = (
        F.col(key).eqNullSafe(F.col("__key")) & F.col(source).eqNullSafe(F.col("__source")) & (tie == F.col("__tie")) & (F.col("__row") == F.col("__nth"))
    )
    words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"))
    cut = F.aggregate("__spans", F.lit(""), lambda acc, s: F.concat(acc, F.array_join(F.slice(words, (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")), "")))
    out = full.join(chosen, same).withColumn(text, F.when(F.col("__whole"), F.col(text)).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
