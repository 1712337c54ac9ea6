"""Column functions on dense vectors stored as arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from verstext.functions.text import as_column


def dot(a, b) -> Column:
    prods = F.zip_with(
        as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double")
    )
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v) -> Column:
    """Vector of length one; a zero vector stays as it is."""
    c = as_column(v)

    def scaled(s: Column) -> Column:
        return F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(x.cast("double")))

    # one-element array: the norm is taken once, not once per component
    return F.transform(F.array(F.struct(c.alias("v"), norm(c).alias("n"))), scaled)[0]


def euclidean(a, b) -> Column:
    sq = F.zip_with(
        as_column(a),
        as_column(b),
        lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")),
    )
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))
