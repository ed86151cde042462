"""Typed operators over pairs of columns, over entities, and the table of which columns an operator may take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operator -> (what its operands must share, kind of result).
OPERATIONS = {
    "add": ("same_unit", "numeric"),
    "subtract": ("same_unit", "numeric"),
    "multiply": ("any_numeric", "numeric"),
    "divide": ("any_numeric", "numeric"),
    "greater_than": ("same_base_or_unit", "boolean"),
    "less_than": ("same_base_or_unit", "boolean"),
    "greater_equal": ("same_base_or_unit", "boolean"),
    "less_equal": ("same_base_or_unit", "boolean"),
    "equals": ("same_type", "boolean"),
    "not_equals": ("same_type", "boolean"),
    "ratio": ("any_numeric", "ratio"),
    "change": ("same_base_different_year", "numeric"),
    "pct_change": ("same_base_different_year", "percentage"),
    "sum_agg": ("single_numeric_col", "numeric"),
    "avg_agg": ("single_numeric_col", "numeric"),
    "max_agg": ("single_numeric_col", "numeric"),
    "min_agg": ("single_numeric_col", "numeric"),
    "count_agg": ("single_col", "count"),
}


def typed(op: str, a: Column, b: Column) -> Column:
    """A typed operator; NULL for a zero denominator. ``change`` and ``pct_change`` go from a to b."""
    match op:
        case "add":
            return F.round(a + b, 2)
        case "subtract":
            return F.round(a - b, 2)
        case "multiply":
            return F.round(a * b, 2)
        case "divide" | "ratio":
            return F.round(F.try_divide(a, b), 4)
        case "greater_than":
            return a > b
        case "less_than":
            return a < b
        case "greater_equal":
            return a >= b
        case "less_equal":
            return a <= b
        case "equals":
            return a == b
        case "not_equals":
            return a != b
        case "change":
            return F.round(b - a, 2)
        case "pct_change":
            return F.round(F.try_divide(b - a, F.abs(a)) * 100, 2)
    raise ValueError(f"unknown operator {op}")


def over_entities(op: str, value: Column) -> Column:
    """An aggregate over entities; only numbers count."""
    number = value.try_cast("double")
    return {"sum_agg": F.round(F.sum(number), 2), "avg_agg": F.round(F.avg(number), 2), "max_agg": F.max(number), "min_agg": F.min(number), "count_agg": F.count(number)}[op]


def can_combine(constraint: Column) -> Column:
    """Whether columns ``a`` and ``b`` (structs of type, unit, base_name, year) meet an operator's constraint."""
    a, b = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    numeric = (a("type") == "numeric") & (b("type") == "numeric")
    same = lambda f: a(f).eqNullSafe(b(f))
    return (
        F.when(constraint == "same_type", same("type")).when(constraint == "same_unit", numeric & same("unit")).when(constraint == "any_numeric", numeric)
        .when(constraint == "same_base_or_unit", numeric & (same("base_name") | same("unit"))).when(constraint == "same_base_different_year", numeric & same("base_name") & ~same("year"))
        .otherwise(False)
    )


def result_unit(op: Column, left_unit: Column) -> Column:
    return (
        F.when(op.isin("add", "subtract", "change", "sum_agg", "avg_agg", "max_agg", "min_agg"), left_unit).when(op == "ratio", "ratio").when(op == "pct_change", "percentage")
        .when(op.isin("greater_than", "less_than", "greater_equal", "less_equal", "equals", "not_equals"), "boolean").when(op == "count_agg", "count").otherwise("derived")
    )


def valid_pairs(columns: DataFrame, operations: DataFrame) -> DataFrame:
    """Every operator with every pair of different columns it may take; both tables are schema-sized.

    ``columns`` has name, type, unit, base_name, year; ``operations`` has op and constraint.
    """
    info = F.struct("type", "unit", "base_name", "year")
    a, b = columns.select(F.col("name").alias("left"), info.alias("a")), columns.select(F.col("name").alias("right"), info.alias("b"))
    joined = a.join(b, F.col("left") != F.col("right")).join(operations, can_combine(F.col("constraint")))
    return joined.select("op", "left", "right", result_unit(F.col("op"), F.col("a.unit")).alias("unit"))


#: Operators over one column, of all entities.
AGGREGATES = ("sum_agg", "avg_agg", "max_agg", "min_agg", "count_agg")


def valid_unary(columns: DataFrame) -> DataFrame:
    """Every aggregate with every column it may take: counts take any, the others numeric ones."""
    ops = F.explode(F.array(*map(F.lit, AGGREGATES))).alias("op")
    rows = columns.select("name", "type", "unit", ops).where((F.col("type") == "numeric") | (F.col("op") == "count_agg"))
    return rows.select("op", "name", result_unit(F.col("op"), F.col("unit")).alias("unit"))
