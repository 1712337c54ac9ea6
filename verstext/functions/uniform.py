"""A reproducible uniform number derived from a key, used instead of a random generator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from verstext.functions.text import as_column


def hash_uniform(key) -> Column:
    """Number in [0, 1) that depends only on ``key``; equal after any repartitioning."""
    digest = F.substring(F.md5(as_column(key).cast("string").cast("binary")), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(2**32))


def key_of(*cols) -> Column:
    """Text key ``a-b-c`` of several columns."""
    return F.concat_ws("-", *[as_column(c).cast("string") for c in cols])
