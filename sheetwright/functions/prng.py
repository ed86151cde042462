"""Portable seeded draws: the same numbers in Spark and in SQL engines that have MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A draw in [0, 1) that depends on the keys' text and the seed only."""
    text = F.concat_ws("/", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def rank_key(seed: int, *keys: Column) -> Column:
    """A text to order rows by at random but reproducibly."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys)))


def pick(items: list, draw: Column) -> Column:
    """One of the items, by a draw in [0, 1)."""
    return F.get(F.array(*map(F.lit, items)), F.floor(draw * len(items)).cast("int"))
