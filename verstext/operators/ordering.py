"""Positions, ranks and quantiles that stay parallel when one key holds most of the rows.

An ordered window needs all rows of a key in one task. The functions here cut the order values
of a key into ranges of fixed width, number the rows inside each range, and add the number of
rows in the lower ranges. A range holds at most ``width`` distinct values whatever the key, so
no task grows with the size of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

WIDTH = 65536
LEVELS = 3


def running_total(
    counts: DataFrame, keys: list[str], value: str, weight: str, out: str = "below", width: int = WIDTH,
    levels: int = LEVELS,
) -> DataFrame:
    """Add the total weight of the smaller values of the same key.

    ``counts`` must hold each (keys, value) once, with an integer ``value`` and keys that are not
    NULL. The totals of the bands are summed in the same way one level up, so that values spread
    over all 64 bits still give small groups on every level.
    """
    if levels == 0:
        order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(value)
        upto = F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0))
        return counts.withColumn(out, upto - F.col(weight))
    band, local, offset, total = (f"_{n}{levels}" for n in ("band", "local", "offset", "total"))
    banded = counts.withColumn(band, F.floor(F.col(value) / F.lit(width)))
    inside = Window.partitionBy(*keys, band).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    numbered = banded.withColumn(local, F.sum(weight).over(inside) - F.col(weight))
    totals = banded.groupBy(*keys, band).agg(F.sum(weight).alias(total))
    offsets = running_total(totals, keys, band, total, offset, width, levels - 1).drop(total)
    return (
        numbered.join(offsets, [*keys, band])
        .withColumn(out, F.col(offset) + F.col(local))
        .drop(band, local, offset)
    )


def dense_position(
    df: DataFrame, keys: list[str], value: str, out: str = "position", width: int = WIDTH
) -> DataFrame:
    """Distinct (keys, value) with the zero-based position of the value within its key."""
    distinct = df.select(*keys, value).distinct().withColumn("_one", F.lit(1).cast("long"))
    return running_total(distinct, keys, value, "_one", out, width).drop("_one")


def average_rank(df: DataFrame, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """Distinct values with their rank in the whole table, ties sharing the mean rank."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    return running_total(counts, [], value, "_n", "_below", width).select(
        value, (F.col("_below") + (F.col("_n") + 1) / 2).alias(out)
    )


def quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], width: int = WIDTH
) -> DataFrame:
    """Exact quantiles with linear interpolation of an integer column, one row per key."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return weighted_quantiles(counts, keys, value, "_n", probabilities, width)


def weighted_quantiles(
    counts: DataFrame,
    keys: list[str],
    value: str,
    weight: str,
    probabilities: dict[str, float],
    width: int = WIDTH,
) -> DataFrame:
    """Quantiles of a table of (keys, value, number of occurrences)."""
    total = counts.groupBy(*keys).agg(F.sum(weight).alias("_total"))
    ranked = running_total(counts, keys, value, weight, "_below", width)
    if keys:
        ranked = ranked.join(total, keys)
    else:
        ranked = ranked.withColumn("_total", total.select("_total").scalar())

    def at(rank):
        holds = (F.col("_below") <= rank) & (rank < F.col("_below") + F.col(weight))
        return F.max(F.when(holds, F.col(value)))

    aggs = []
    for name, p in probabilities.items():
        target = F.lit(p) * (F.col("_total") - 1)
        low = F.floor(target)
        aggs += [
            at(low).alias(f"{name}_lo"),
            at(F.ceil(target)).alias(f"{name}_hi"),
            F.max(target - low).alias(f"{name}_part"),
        ]
    picked = ranked.groupBy(*keys).agg(*aggs)
    return picked.select(
        *keys,
        *[
            (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_part")).alias(n)
            for n in probabilities
        ],
    )


def rolling_mean(
    df: DataFrame, keys: list[str], position: str, value: str, size: int, out: str, width: int = WIDTH
) -> DataFrame:
    """Mean of the last ``size`` rows of a key, NULL until that many exist.

    ``position`` numbers the rows of a key from zero without gaps. The last ``size - 1`` rows of
    each band of positions are copied into the next band, so bands are independent tasks.
    """
    band = F.floor(F.col(position) / width)
    carried = (F.col(position) % width) >= (width - size + 1)
    homes = F.when(carried, F.array(band, band + 1)).otherwise(F.array(band))
    spread = df.withColumn("_home", band).withColumn("_band", F.explode(homes))
    last = Window.partitionBy(*keys, "_band").orderBy(position).rowsBetween(-(size - 1), 0)
    return (
        spread.withColumn("_n", F.count(F.lit(1)).over(last))
        .withColumn(out, F.when(F.col("_n") == size, F.avg(value).over(last)))
        .where(F.col("_home") == F.col("_band"))
        .drop("_home", "_band", "_n")
    )
