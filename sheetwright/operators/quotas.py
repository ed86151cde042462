"""Quotas by hashed ranks: what a running controller or a shuffle would pick, without any order among rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prng import rank_key


def smallest(rows: DataFrame, group: str, key: str, sizes: dict, seed: int) -> DataFrame:
    """Of each group the given number of rows, at random by a hash of the key; groups without a size have none.

    Each group's cut is found by a top-k over its hashes, which is partial in every task, so no task sorts a group.
    """
    ranked = rows.where(F.col(group).isin(*sizes)).withColumn("__rank__", F.concat(rank_key(seed, F.col(key)), F.lit("/"), F.col(key).cast("string")))
    out = None
    for name, size in sizes.items():
        part = ranked.where(F.col(group) == name).orderBy("__rank__").limit(size)
        out = part if out is None else out.unionByName(part)
    return out.drop("__rank__")


def proportional(rows: DataFrame, key: str, seed: int, sizes: dict[int, int] | None = None, most: int = 500) -> DataFrame:
    """A sample by depth, 50, 300 and 150 rows of depth 0, 1 and 2 where there are as many, ``most`` in all, in random order."""
    picked = smallest(rows, "depth", key, sizes or {0: 50, 1: 300, 2: 150}, seed)
    return picked.orderBy(rank_key(seed + 1, F.col(key)), key).limit(most)


def derived_quota(rows: DataFrame, key: str, derived: Column, count: int, low: float, high: float, seed: int) -> DataFrame:
    """``count`` rows of which a share halfway between ``low`` and ``high`` uses a derived measure."""
    if count < 1 or not 0 <= low <= high <= 1:
        raise ValueError("bad count or shares")
    # The least number that keeps the running share at the target or above.
    wanted = -(-int(round(count * (low + high) * 1000)) // 2000)
    return smallest(rows.withColumn("__derived__", derived), "__derived__", key, {True: wanted, False: count - wanted}, seed).drop("__derived__")


#: Leading hexadecimal digits of a rank that make a bucket: rows of a group are put in order by 4096 tasks at most, not by one.
DIGITS = 3


def ring(rows: DataFrame, group: str, rank: Column, value: str) -> DataFrame:
    """``rows`` with ``next``: the value of the row after it in its group, in the order of a hexadecimal rank (no two alike), the first's after the last.

    A row that is alone in its group has none.  Rows are sorted within buckets of the rank's first digits; only the buckets' first
    values, at most 4096 a group, are put in order as a whole.
    """
    made = rows.withColumns({"__rank__": rank, "__bucket__": F.substring(rank, 1, DIGITS)})
    firsts = made.groupBy(group, "__bucket__").agg(F.min_by(value, "__rank__").alias("__first__"), F.count(F.lit(1)).alias("__n__"))
    order = Window.partitionBy(group).orderBy("__bucket__")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("__first__").over(order), F.first("__first__").over(whole))
    firsts = firsts.select(group, "__bucket__", after.alias("__after__"), F.sum("__n__").over(whole).alias("__all__"))
    within = Window.partitionBy(group, "__bucket__").orderBy("__rank__")
    found = made.withColumn("__lead__", F.lead(value).over(within)).join(firsts, [group, "__bucket__"])
    return found.withColumn("next", F.when(F.col("__all__") > 1, F.coalesce("__lead__", "__after__"))).drop("__rank__", "__bucket__", "__lead__", "__after__", "__all__")


def numbered(rows: DataFrame, rank: Column) -> DataFrame:
    """``rows`` with ``place``, from 0 in the order of a hexadecimal rank (no two alike), and ``places``, their number; in buckets as ``ring``."""
    made = rows.withColumns({"__rank__": rank, "__bucket__": F.substring(rank, 1, DIGITS)})
    order = Window.orderBy("__bucket__")  # over at most 4096 rows
    sizes = made.groupBy("__bucket__").agg(F.count(F.lit(1)).alias("__n__"))
    sizes = sizes.select("__bucket__", (F.sum("__n__").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n__")).alias("__before__"), F.sum("__n__").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("places"))
    within = Window.partitionBy("__bucket__").orderBy("__rank__")
    found = made.withColumn("__at__", F.row_number().over(within)).join(sizes, "__bucket__")
    return found.withColumn("place", F.col("__before__") + F.col("__at__") - 1).drop("__rank__", "__bucket__", "__at__", "__before__")
