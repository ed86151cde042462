"""Time aggregates and growth over (entity, period) series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(entity: str = "entity", period: str = "period"):
    return Window.partitionBy(entity).orderBy(period)


def window_stats(sheet: DataFrame, value: str, back: int | None = None) -> DataFrame:
    """Minimum, maximum and average of this and ``back`` earlier periods, where there are at least two."""
    frame = series().rowsBetween(Window.unboundedPreceding if back is None else -back, 0)
    out = sheet.select("entity", "period", F.min(value).over(frame).alias("low"), F.max(value).over(frame).alias("high"), F.round(F.avg(value).over(frame), 4).alias("mean"), F.count(value).over(frame).alias("n"))
    return out.where("n >= 2")


def all_windows(sheet: DataFrame, value: str, longest: int | None = None) -> DataFrame:
    """Every contiguous window of at least two periods of an entity: (entity, from_period, to_period, low, high, mean).

    A row keeps its place, the running sum up to it, and the extremes of the stretches of 1, 2, 4, .. rows that begin and that end at it, so a
    window is two rows' worth of numbers: its sum is a difference of running sums, and two stretches of the largest power of
    two that fits cover it.  ``longest`` bounds an entity's periods; if it is not given, it is looked up.
    """
    if longest is None:
        longest = sheet.groupBy("entity").count().agg(F.max("count")).first()[0] or 0
    order, powers = series(), range(max(1, longest.bit_length()))
    stretch = lambda f, first, last: f(value).over(order.rowsBetween(first, last))
    kept = sheet.select(
        "entity", "period", F.col(value).alias("v"), F.row_number().over(order).alias("at"), F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
        *(F.array(*(stretch(f, 0, (1 << k) - 1) for k in powers)).alias(f"{name}_on") for f, name in ((F.min, "low"), (F.max, "high"))),
        *(F.array(*(stretch(f, 1 - (1 << k), 0) for k in powers)).alias(f"{name}_back") for f, name in ((F.min, "low"), (F.max, "high"))),
    )
    first = kept.select("entity", F.col("period").alias("from_period"), F.col("at").alias("a"), (F.col("total") - F.col("v")).alias("before"), "low_on", "high_on")
    last = kept.select("entity", F.col("period").alias("to_period"), F.col("at").alias("b"), "total", "low_back", "high_back")
    n = F.col("b") - F.col("a") + 1
    k = F.floor(F.log2(n + F.lit(0.5))).cast("int")  # half a row more, so that no power of two is missed by rounding
    pairs = first.join(last, "entity").where("a < b")
    return pairs.select(
        "entity", "from_period", "to_period", F.least(F.get("low_on", k), F.get("low_back", k)).alias("low"), F.greatest(F.get("high_on", k), F.get("high_back", k)).alias("high"),
        F.round((F.col("total") - F.col("before")) / n, 4).alias("mean"),
    )


def growth(now: Column, then: Column) -> Column:
    return F.try_divide(now - then, then)


def all_growth_pairs(sheet: DataFrame, value: str) -> DataFrame:
    """Growth between every earlier and later period of an entity."""
    a = sheet.select("entity", F.col("period").alias("from_period"), F.col(value).alias("then"))
    b = sheet.select("entity", F.col("period").alias("to_period"), F.col(value).alias("now"))
    pairs = a.join(b, "entity").where("from_period < to_period")
    return pairs.select("entity", "from_period", "to_period", F.round(growth(F.col("now"), F.col("then")), 6).alias("growth")).where("growth is not null")


def yoy(sheet: DataFrame, value: str) -> DataFrame:
    """Change against the year before, and in percent of its absolute value."""
    then = F.lag(value).over(series())
    out = sheet.select("entity", "period", F.round(F.col(value) - then, 2).alias("delta"), F.round(F.try_divide(F.col(value) - then, F.abs(then)) * 100, 4).alias("pct"))
    return out.where("delta is not null")


#: What a period label says about its kind.
FLOW = r"^(Three|Six|Nine|Twelve) Months Ended"


def period_kind(label: Column) -> Column:
    """The length word of a flow's label, or ``instant``."""
    word = F.regexp_extract(label, FLOW, 1)
    return F.when(word == "", "instant").otherwise(F.lower(word))


def period_date(label: Column) -> Column:
    """The date that a label ends with; labels that have none come first."""
    tail = F.element_at(F.split(label, "Ended "), -1)
    return F.coalesce(F.try_to_date(tail, "MMMM d, yyyy"), F.make_date(F.lit(1), F.lit(1), F.lit(1)))


def period_group(label: Column) -> Column:
    """Kind and month: periods of one group may be compared over years."""
    return F.concat_ws("_", period_kind(label), F.month(period_date(label)).cast("string"))
