"""Version bookkeeping and filters on crawled article tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verstext.operators.ordering import dense_position, weighted_quantiles
from verstext.runtime import materialise

MIN_VERSIONS, MAX_VERSIONS = 1, 40


def version_rank(df: DataFrame, entry: str = "entry_id", row_id: str = "id") -> DataFrame:
    """Number the rows of an entry from zero in the order of their ids."""
    ranks = dense_position(df, [entry], row_id, "version")
    return df.drop("version").join(ranks, [entry, row_id])


def num_versions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of versions of an entry on each of its rows.

    Counted before the shuffle and joined back, so a large entry is no single task.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_versions"))
    return df.drop("num_versions").join(counts, keys)


def _lowest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, F.col(order)).alias("_row")).select("_row.*")


def lowest_per_url(df: DataFrame, order: str = "id") -> DataFrame:
    """One row per url; rows without a url are no copies of each other and all stay."""
    return _lowest(df.where(F.col("url").isNotNull()), ["url"], order).unionByName(df.where(F.col("url").isNull()))


def dedup_versions(df: DataFrame, order: str = "id") -> DataFrame:
    """One row per url, then one per (entry, version); the lowest ``order`` stays.

    Which rows stay is settled on their keys; the rows themselves are shuffled once, at the end.
    """
    version = ["entry_id", "version"]
    keys = df.select(order, "url", *version)
    first = keys.where(F.col("url").isNotNull()).groupBy("url").agg(F.min(F.struct(order, *version)).alias("k")).select("k.*")
    left = first.unionByName(keys.where(F.col("url").isNull()).drop("url"))
    stay = left.groupBy(*version).agg(F.min(order).alias(order))
    return df.join(stay, [*version, order], "left_semi").dropDuplicates([*version, order])


def version_of_text(text) -> Column:
    """First digits of a text such as ``Version 3 of 7``."""
    digits = F.regexp_extract(text, r"([0-9]+)", 1)
    return F.when(digits != "", digits.cast("int"))


def url_part(url, k: int) -> Column:
    return F.split_part(url, F.lit("/"), F.lit(k))


def eligible_versions(df: DataFrame, low: int = MIN_VERSIONS, high: int | None = MAX_VERSIONS) -> DataFrame:
    """Versions of entries with low < n < high versions (no upper bound if None) and a text that is not blank."""
    rows = df.where((F.col("num_versions") > low) & F.col("summary").isNotNull() & (F.trim("summary") != ""))
    return rows if high is None else rows.where(F.col("num_versions") < high)


def only_new_entries(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def entry_slice(df: DataFrame, entry: str, k: int, n: int) -> DataFrame:
    """Rows of the k-th of n equal slices of the sorted distinct ids."""
    ids = dense_position(df, [], entry, "_pos")
    total = df.select(entry).distinct().agg(F.count(F.lit(1)).alias("_n")).scalar()
    size = F.ceil(total / n)
    wanted = ids.where((F.col("_pos") >= size * k) & (F.col("_pos") < size * (k + 1)))
    return df.join(wanted.select(entry), entry, "left_semi")


def multi_version_only(df: DataFrame, entry: str = "entry_id", text: str = "summary") -> DataFrame:
    """Rows with text whose entry has more than one such row."""
    good = df.where(F.trim(text) != "")
    many = good.groupBy(entry).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return good.join(many.select(entry), entry, "left_semi")


def next_versions(df: DataFrame, entry: str = "entry_id") -> DataFrame:
    """(entry, version, next version), also where version numbers have gaps."""
    pos = dense_position(df, [entry], "version", "_pos")
    nxt = pos.select(entry, (F.col("_pos") - 1).alias("_pos"), F.col("version").alias("version_y"))
    return pos.withColumnRenamed("version", "version_x").join(nxt, [entry, "_pos"]).drop("_pos")


def missing_pairs(versions: DataFrame, produced: DataFrame) -> DataFrame:
    """Expected adjacent pairs that a result table lacks, and the shortfall of each entry."""
    expected = next_versions(versions)
    lost = expected.join(produced, ["entry_id", "version_x", "version_y"], "left_anti")
    short = lost.groupBy("entry_id").agg(F.count(F.lit(1)).alias("shortfall"))
    return lost.join(short, "entry_id")


def version_chains(links: DataFrame) -> DataFrame:
    """Follow old_id -> new_id links: (root, position, id) for every id on a chain.

    Each round doubles the distance an id has looked back, so the number of rounds is the
    logarithm of the longest chain. A link of an id to itself ends a chain. Ids on a closed loop
    have no root and are left out.
    """
    links = materialise(links.select("old_id", "new_id"), "links")
    real = links.where("old_id <> new_id").select("old_id", "new_id").distinct()
    nodes = links.select(F.col("old_id").alias("id")).unionByName(links.select(F.col("new_id").alias("id"))).distinct()
    parents = real.select(F.col("new_id").alias("id"), F.col("old_id").alias("anc"))
    state = nodes.join(parents, "id", "left").select(
        "id", F.coalesce("anc", "id").alias("anc"),
        F.when(F.col("anc").isNull(), 0).otherwise(1).cast("long").alias("dist"),
        F.col("anc").isNull().alias("done"),
    )
    state = materialise(state, "chain_state")
    finished, open_rows = state.where("done"), state.where("NOT done")
    longest, reached = nodes.count(), 1
    while reached <= 2 * longest and not open_rows.isEmpty():  # no chain is longer; what is left then is on a loop
        reached *= 2
        table = finished.unionByName(open_rows).select(
            F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"),
            F.col("done").alias("done2"),
        )
        step = materialise(
            open_rows.join(table, "anc").select(
                "id", F.col("anc2").alias("anc"), (F.col("dist") + F.col("dist2")).alias("dist"),
                F.col("done2").alias("done"),
            ).distinct(),  # two ways to the same id are one row, or merging links would multiply
            "chain_step",
        )
        finished = finished.unionByName(step.where("done"))
        open_rows = step.where("NOT done")
    return finished.select(F.col("anc").alias("root"), F.col("dist").alias("position"), "id")


def parse_time(text) -> Column:
    """Timestamp of a crawl time, NULL where it cannot be read."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def url_domain(df: DataFrame, url: str = "url") -> DataFrame:
    return df.groupBy(F.parse_url(F.col(url), F.lit("HOST")).alias("domain")).agg(
        F.count(F.lit(1)).alias("n")
    )


def missing_ids(seen: DataFrame, ruled_out: DataFrame, top: int) -> DataFrame:
    """Ids below ``top`` that neither table holds."""
    ids = seen.sparkSession.range(top)
    return ids.join(seen, "id", "left_anti").join(ruled_out, "id", "left_anti")


def percentile_band(df: DataFrame, count: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows whose count lies between two quantiles of the counts that are not zero."""
    freq = df.where(F.col(count) != 0).groupBy(count).agg(F.count(F.lit(1)).alias("_w"))
    band = weighted_quantiles(freq, [], count, "_w", {"lo": low, "hi": high})
    return df.where(
        (F.col(count) >= band.select("lo").scalar()) & (F.col(count) <= band.select("hi").scalar())
    )


def adjacent_urls(df: DataFrame) -> DataFrame:
    """One address per step s -> s + 1 of an entry with n versions."""
    rows = df.select("entry_id", F.explode(F.sequence(F.lit(0), F.col("num_versions") - 1)).alias("step"))
    address = F.concat_ws(
        "/", F.lit("diff"), F.col("entry_id").cast("string"), F.col("step").cast("string"),
        (F.col("step") + 1).cast("string"),
    )
    return rows.withColumn("next_step", F.col("step") + 1).withColumn("address", address)


def max_version_per_entry(df: DataFrame) -> DataFrame:
    return df.groupBy("entry_id").agg(
        F.max("version").alias("max_version"), F.max_by("title", F.col("version")).alias("last_title")
    )


def version_keys(matched: DataFrame) -> DataFrame:
    """Distinct (entry, version) of both sides of a match table."""
    return (
        matched.unpivot("entry_id", ["version_x", "version_y"], "side", "version")
        .select("entry_id", "version").distinct()
    )


def page_paragraphs(df: DataFrame, html: str = "html") -> DataFrame:
    """Paragraphs of a page in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    return df.select("page_id", F.posexplode(found).alias("par_idx", "paragraph"))


def since(df: DataFrame, date: str, column: str = "created") -> DataFrame:
    return df.where(F.col(column) > F.lit(date).cast("timestamp"))


def unify_sources(frames: list[DataFrame]) -> DataFrame:
    """Article tables with different columns as one table; absent columns are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def exclude_multi_attr(df: DataFrame, flag: Column, entry: str = "entry_id") -> DataFrame:
    """Rows of the entries none of whose versions has the flag."""
    flagged = df.groupBy(entry).agg(F.bool_or(flag).alias("_f")).where("_f")
    return df.join(flagged.select(entry), entry, "left_anti")
