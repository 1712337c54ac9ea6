"""Reproducible samples: every random choice is a hash of the row's key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verstext.functions.uniform import hash_uniform, key_of


def sample_entries(df: DataFrame, n: int, entry: str = "entry_id") -> DataFrame:
    """All rows of ``n`` entries."""
    ids = df.select(entry).distinct().withColumn("_u", hash_uniform(entry)).orderBy("_u", entry).limit(n)
    return df.join(ids.select(entry), entry, "left_semi")


def bernoulli_by_source(df: DataFrame, keys: list[str], target: int) -> DataFrame:
    """Each row with probability target / size of its source."""
    rates = df.groupBy("source").agg((F.lit(float(target)) / F.count(F.lit(1))).alias("_rate"))
    return df.join(rates, "source").where(hash_uniform(key_of(*keys)) < F.col("_rate")).drop("_rate")


def inverse_frequency_sample(df: DataFrame, keys: list[str], classes: list[str], n: int) -> DataFrame:
    """``n`` rows without replacement, weighted by one over the size of each class of a row.

    The key -ln(u) / weight orders rows as drawing one after the other would.
    """
    weight = F.lit(1.0)
    out = df
    for k, c in enumerate(classes):
        sizes = df.groupBy(c).agg(F.count(F.lit(1)).alias(f"_n{k}"))
        out = out.join(sizes, c)
        weight = weight / F.col(f"_n{k}")
    u = hash_uniform(key_of(*keys))
    drawn = F.round(-F.log(u + F.lit(2.0**-33)) / weight, 6)
    picked = out.withColumn("draw", drawn).orderBy("draw", *keys).limit(n)
    return picked.drop(*[f"_n{k}" for k in range(len(classes))])


def balanced_eval_sample(
    df: DataFrame, training: DataFrame, keys: list[str], label: str, n_label: int, n_source: int
) -> DataFrame:
    """Rows outside the training set, balanced by label, then by source."""
    fresh = df.join(training.select(*keys).distinct(), keys, "left_anti")
    by_label = inverse_frequency_sample(fresh, keys, [label], n_label).drop("draw")
    return inverse_frequency_sample(by_label, keys, ["source"], n_source)


def sample_rows(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    u = hash_uniform(key_of(*keys))
    return df.withColumn("u", u).orderBy("u", *keys).limit(n)
