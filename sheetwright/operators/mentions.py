"""Names that occur in texts: an inverted index of short substrings, and a check of the few pairs that it gives.

Each name is filed under one of its substrings of ``width`` characters or, where it is long enough, twice, four times as many and so on
(the whole name, if it is shorter): the one that the fewest names have.  Long names so share hardly any, however many they are.  A text meets the names that are filed under its own substrings, each once, and only those pairs are looked at as a whole.  So
neither side is compared with all of the other, and a substring that all names share costs nothing as long as each has another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sharing import cut

#: The longest substring that a name is filed under; so many names are broadcast, and hashes of so many.
LONGEST, FEW, SCREEN = 32, 65536, 1 << 20


def substrings(text: Column, width: int) -> Column:
    """The different substrings of so many characters."""
    n = F.char_length(text) - width + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, i, F.lit(width))))).otherwise(F.array().cast("array<string>"))


def lengths(name: Column, width: int) -> Column:
    """How long a substring a name is filed under: ``width`` doubled as often as the name holds it, up to LONGEST; a shorter name is whole."""
    n, fit = F.char_length(name), F.lit(width)
    long = width
    while (long := 2 * long) <= LONGEST:
        fit = F.when(n >= long, long).otherwise(fit)
    return F.least(n, fit)


def filed(names: DataFrame, name: str, order: str, width: int) -> DataFrame:
    """(name, order, gram) of the different names that are not empty: the earliest order of each, and its rarest substring."""
    own = names.where(F.col(name) != "").groupBy(F.col(name).alias("name")).agg(F.min(order).alias("order"))
    long = lengths(F.col("name"), width)
    starts = F.sequence(F.lit(1), F.char_length("name") - long + 1)
    grams = own.select("name", "order", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr("name", i, long)))).alias("gram"))
    known = grams.join(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).hint("merge"), "gram")
    return known.groupBy("name", "order").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def pairs(texts: DataFrame, id_col: str, text_col: str, names: DataFrame, name: str, order: str, width: int = 4) -> DataFrame:
    """(id, name, order) of every text and each different name that it contains; a null text contains none.

    Up to FEW names are broadcast, and hashes of the substrings of up to SCREEN screen the texts' own before any is shuffled; Spark
    would take a table of exploded texts for a small one, and is told not to.
    """
    index = cut(filed(names, name, order, width))
    # at most as many numbers as LONGEST, and the number of names
    widths, n = index.agg(F.collect_set(F.char_length("gram")), F.count(F.lit(1))).first()
    own = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    grams = own.select("id", "text", F.explode(F.concat(F.array().cast("array<string>"), *(substrings(F.col("text"), w) for w in sorted(widths)))).alias("gram"))
    if n <= FEW:
        near = grams.join(F.broadcast(index), "gram")
    else:
        if n <= SCREEN:
            hashes = index.select(F.xxhash64("gram").alias("hash")).distinct()
            grams = grams.withColumn("hash", F.xxhash64("gram")).join(F.broadcast(hashes), "hash", "left_semi").drop("hash")
        near = grams.join(index.hint("merge"), "gram")
    return near.where(F.contains("text", "name")).select("id", "name", "order").distinct()


def first_mention(texts: DataFrame, id_col: str, text_col: str, names: DataFrame, name: str, order: str, width: int = 4) -> DataFrame:
    """(id, mention): of the names that a text contains, the first in order (of names of one order, the alphabetically first)."""
    found = pairs(texts, id_col, text_col, names, name, order, width)
    return found.groupBy("id").agg(F.min_by("name", F.struct("order", "name")).alias("mention")).withColumnRenamed("id", id_col)
