"""Similarity of matched sentence pairs by shared token runs.

The pairs are dealt by their key once, as hashes of their tokens. After that the runs of both sides are spread
into rows and counted by (pair, run) where they are: the rows of runs, many times the size of the
texts, are never shuffled. The work grows with the number of tokens; pairs with equal tokens are settled
without spreading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verstext.functions import text as tx


def _hashed(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pairs dealt by ``keys``, so that grouping by them and more needs no further exchange."""
    return pairs.select(*keys, tx.token_hashes(x).alias("tx"), tx.token_hashes(y).alias("ty")).repartition(*keys)


def shared_kgram_coverage(pairs: DataFrame, keys: list[str], x: str, y: str, k: int) -> DataFrame:
    """Share of each side's tokens that lie in a run of ``k`` tokens the other side has too; NULL for an empty side."""
    rows = _hashed(pairs, keys, x, y)
    same = F.col("tx") == F.col("ty")
    whole = F.when(F.size("tx") > 0, (F.size("tx") >= k).cast("double"))
    equal = rows.where(same).select(*keys, whole.alias("coverage_x"), whole.alias("coverage_y"))

    def runs(side: str) -> Column:
        return F.transform(tx.run_keys(F.col(f"t{side}"), k), lambda g, i: F.struct(g.alias("g"), F.lit(side).alias("side"), i.alias("i")))

    other = rows.where(~same)
    spread = other.select(*keys, F.explode(F.concat(runs("x"), runs("y"))).alias("_r")).select(*keys, "_r.*")
    at = [F.collect_list(F.when(F.col("side") == side, F.col("i"))).alias(f"at_{side}") for side in "xy"]
    shared = spread.groupBy(*keys, "g").agg(*at).where((F.size("at_x") > 0) & (F.size("at_y") > 0))
    places = shared.groupBy(*keys).agg(*[F.sort_array(F.flatten(F.collect_list(f"at_{side}"))).alias(f"at_{side}") for side in "xy"])

    def covered(side: str) -> Column:
        # a run that begins at i covers k tokens, or those up to where the next run begins
        steps = F.transform(f"at_{side}", lambda p, i: F.coalesce(F.least(F.get(f"at_{side}", i + 1) - p, F.lit(k)), F.lit(k)))
        n = F.aggregate(steps, F.lit(0), lambda acc, s: acc + s)
        return F.try_divide(F.coalesce(n, F.lit(0)), F.size(f"t{side}"))

    joined = other.join(places, keys, "left")
    return equal.unionByName(joined.select(*keys, covered("x").alias("coverage_x"), covered("y").alias("coverage_y")))


def ngram_precision(pairs: DataFrame, keys: list[str], x: str, y: str, weights: tuple[float, ...]) -> DataFrame:
    """Clipped n-gram precision of ``x`` against ``y`` with a brevity penalty.

    Runs of ``x`` count at most as often as they occur in ``y``. A run size with a weight above zero
    and without any match makes the score zero, as does an empty side.
    """
    sizes = [n for n, w in enumerate(weights, start=1) if w > 0]
    rows = _hashed(pairs, keys, x, y)
    same = F.col("tx") == F.col("ty")
    equal = rows.where(same).select(*keys, (F.size("tx") >= max(sizes)).cast("double").alias("score"))
    other = rows.where(~same)

    def runs(side: str, n: int) -> Column:
        mine = tx.run_keys(F.col(f"t{side}"), n)
        return F.transform(
            mine, lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(int(side == "x")).alias("x"), F.lit(int(side == "y")).alias("y"))
        )

    every = F.concat(*[runs(side, n) for n in sizes for side in "xy"])
    spread = other.select(*keys, F.explode(every).alias("_r")).select(*keys, "_r.*")
    counts = spread.groupBy(*keys, "n", "g").agg(F.sum("x").alias("cx"), F.sum("y").alias("cy"))
    clipped = [F.sum(F.when(F.col("n") == n, F.least("cx", "cy"))).alias(f"c{n}") for n in sizes]
    joined = other.join(counts.groupBy(*keys).agg(*clipped), keys, "left")
    total = F.lit(0.0)
    for n in sizes:
        precision = F.try_divide(F.col(f"c{n}"), F.greatest(F.size("tx") - (n - 1), F.lit(0)))
        total = total + F.lit(weights[n - 1]) * F.log(F.when(precision > 0, precision))
    usable = (F.size("tx") > 0) & (F.size("ty") > 0)
    penalty = F.least(F.lit(1.0), F.exp(1 - F.size("ty") / F.when(usable, F.size("tx"))))
    return equal.unionByName(joined.select(*keys, F.coalesce(penalty * F.exp(total), F.lit(0.0)).alias("score")))


def token_bag_ratio(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Shared tokens of the two texts of a row, 2 * common / (n_x + n_y).

    Rows with equal texts are settled as they are; only the others are spread into tokens.
    """
    same = F.col(x) == F.col(y)
    equal = pairs.where(same & (F.size(tx.tokens(x)) > 0)).select(*keys, F.lit(1.0).alias("ratio"))

    def side(column, in_x, in_y):
        return F.transform(column, lambda t: F.struct(t.alias("t"), F.lit(in_x).alias("x"), F.lit(in_y).alias("y")))

    spread = _hashed(pairs.where(~same), keys, x, y).select(*keys, F.explode(F.concat(side("tx", 1, 0), side("ty", 0, 1))).alias("_w"))
    counts = spread.groupBy(*keys, "_w.t").agg(F.sum("_w.x").alias("nx"), F.sum("_w.y").alias("ny"))
    other = counts.groupBy(*keys).agg(
        (2 * F.sum(F.least("nx", "ny")) / F.sum(F.col("nx") + F.col("ny"))).alias("ratio")
    )
    return equal.unionByName(other)
