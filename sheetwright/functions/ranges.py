"""Ranges that generators draw from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The range of a column without one, the factor of big numbers, and the columns that are shares.
DEFAULT_RANGE = (100, 1_000_000_000)
BIG_NUMBERS = 100.0
RATIO_COLUMNS = ("income_tax",)


def normalize_range(given: dict[str, float] | None) -> tuple[float, float]:
    """(least, most) of a range; the default where none is given, an error where it is empty."""
    if given is None:
        return DEFAULT_RANGE
    if given["min"] > given["max"]:
        raise ValueError(f"a range from {given['min']} to {given['max']}")
    return given["min"], given["max"]


def scale_ranges(ranges: DataFrame, factor: float = BIG_NUMBERS, ratios: tuple[str, ...] = RATIO_COLUMNS) -> DataFrame:
    """Ranges (column, min, max) of amounts times a factor; those of shares, and missing ones, stay."""
    if factor <= 0:
        raise ValueError("factor must be positive")
    scaled = lambda c: F.when(F.col("column").isin(*ratios), F.col(c)).otherwise(F.col(c) * factor).alias(c)
    return ranges.select("column", scaled("min"), scaled("max"))
