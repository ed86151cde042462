"""Questions in plain language, as text columns over a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prng import pick
from .expr import Derived, Expr, Growth, Leaf, Literal, Node, Over

#: Templates of questions and of requests.
QUESTIONS = [
    "What is the {phrase}", "What is the value of the {phrase}", "What's the value of the {phrase}", "Whats the value of the {phrase}", "What would be the {phrase}",
    "What do we obtain as the {phrase}", "What does the following give: {phrase}", "Which value corresponds to the {phrase}", "Which result follows from the {phrase}",
    "Which quantity is given by the {phrase}", "Could you give the {phrase}", "May you calculate the {phrase}", "May you give the {phrase}",
]
REQUESTS = [
    "Give the {phrase}", "Provide the {phrase}", "State the {phrase}", "Determine the {phrase}", "Compute the {phrase}", "Calculate the {phrase}", "Evaluate the {phrase}",
    "You should calculate the {phrase}", "You should give the {phrase}",
]


def clean_label(text: str) -> str:
    return text.replace("_", " ").strip() or "value"


def copula(text: Column) -> Column:
    """``are`` for a plural in s, else ``is``; a double s is singular."""
    low = F.lower(F.trim(text))
    return F.when(low.endswith("s") & ~low.endswith("ss"), "are").otherwise("is")


def oxford(items: list[str]) -> str:
    if len(items) < 3:
        return " and ".join(items)
    return ", ".join(items[:-1]) + ", and " + items[-1]


def oxford_column(items: Column) -> Column:
    """The same of an array column."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).when(n == 2, F.array_join(items, " and ")).otherwise(F.concat(head, F.lit(", and "), F.try_element_at(items, F.lit(-1))))


def bare_phrase(expr: Expr) -> str:
    """What a tree says, without entity and period, which all its leaves share."""
    match expr:
        case Leaf(concept):
            return clean_label(concept)
        case Derived(name):
            return clean_label(name)
        case Literal(value):
            return str(value)
        case Node(op, left, right):
            a, b = bare_phrase(left), bare_phrase(right)
            return {"sum": f"sum of {a} and {b}", "diff": f"difference between {a} and {b}", "ratio": f"ratio of {a} to {b}", "mul": f"result of {a} scaled by {b}", "growth": f"growth between {a} and {b}", "min": f"the minimum of {a} and {b}", "max": f"the maximum of {a} and {b}", "avg": f"the average of {a} and {b}"}[op]
        case Over(op, operand, _):
            return f"the {({'min': 'minimum', 'max': 'maximum', 'avg': 'average'})[op]} of {bare_phrase(operand)}"
        case Growth(operand, _):
            return f"growth in {bare_phrase(operand)}"
    raise TypeError(expr)


def phrase(expr: Expr, entity: Column, period: Column, start: Column | None = None) -> Column:
    """A tree's phrase with its entity and period; ``start`` is the first period of windows and growth."""
    text = F.lit(bare_phrase(expr))
    if isinstance(expr, Growth):
        return F.concat(text, F.lit(" for "), entity, F.lit(" from "), start.cast("string"), F.lit(" to "), period.cast("string"))
    if isinstance(expr, Over):
        return F.concat(text, F.lit(" for "), entity, F.lit(" using values from "), start.cast("string"), F.lit(" through "), period.cast("string"))
    return F.concat(text, F.lit(" for "), entity, F.lit(" in "), period.cast("string"))


def render(said: Column, draw: Column, marks: Column, case: Column) -> Column:
    """A question or request by a draw in [0, 1); ``marks`` draws the punctuation and ``case`` the first letter."""
    templates = [*QUESTIONS, *REQUESTS]
    text = F.replace(pick(templates, draw), F.lit("{phrase}"), said)
    mark = F.when(draw * len(templates) < len(QUESTIONS), "?").otherwise(".")
    text = F.concat(text, F.when(marks < 1 / 3, "").when(marks < 2 / 3, F.concat(F.lit(" "), mark)).otherwise(mark))
    return F.concat(F.when(case < 0.5, F.upper(F.substring(text, 1, 1))).otherwise(F.lower(F.substring(text, 1, 1))), F.substr(text, F.lit(2)))


def format_answer(value: Column, kind: Column) -> Column:
    """An answer by its kind: boolean, percentage, count, ratio, else an amount with thousands separators.

    An amount of 1,000 or more has no decimals, a smaller one two.
    """
    two, four = value.cast("decimal(20,2)").cast("string"), value.cast("decimal(20,4)").cast("string")
    return (
        F.when(value.isNull(), "N/A").when(kind == "boolean", F.when(value != 0, "Yes").otherwise("No")).when(kind == "percentage", F.concat(two, F.lit("%")))
        .when(kind == "count", value.cast("bigint").cast("string")).when(kind == "ratio", four).when(F.abs(value) >= 1000, F.format_number(value, 0)).otherwise(F.format_number(value, 2))
    )


def kind_phrase(kind: str, label: Column, entity: Column, period: Column, from_period: Column, to_period: Column) -> Column:
    """The phrase of a meaning whose kind has a wording of its own; other kinds are NULL."""
    name = F.when(F.trim(F.replace(label, F.lit("_"), F.lit(" "))) == "", "value").otherwise(F.trim(F.replace(label, F.lit("_"), F.lit(" "))))
    match kind:
        case "aggregate_components":
            return filled("total {a} for {who} in {p}", a=name, who=entity, p=period)
        case "growth_rate":
            return filled("growth rate of {a} for {who} from {f} to {t}", a=F.regexp_replace(name, "^growth rate of ", ""), who=entity, f=from_period, t=to_period)
        case "avg_over_all_periods":
            return filled("average {a} for {who} across years {f} through {t}", a=name, who=entity, f=from_period, t=to_period)
    return F.lit(None).cast("string")


#: What precedes a metric's name in a label.
PREFIXES = ["growth rate of ", "minimum ", "maximum ", "average "]


def base_metric_name(label: Column) -> Column:
    """A label without the prefixes of growth and of windows, each taken off once in this order."""
    for prefix in PREFIXES:
        label = F.regexp_replace(label, f"^{prefix}", "")
    label = F.trim(F.replace(label, F.lit("_"), F.lit(" ")))
    return F.when(label == "", "value").otherwise(label)


#: Wordings of two-operand questions, of aggregates and of compositions, in formal style.
FORMAL_PAIRS = {
    "add": "What is the sum of {a} and {b} for {who} {when}?",
    "subtract": "What is the difference between {a} and {b} (i.e., {a} minus {b}) for {who} {when}?",
    "multiply": "What is the product of {a} and {b} for {who} {when}?",
    "divide": "What is the ratio of {a} to {b} for {who} {when}?",
    "ratio": "What is the ratio of {a} to {b} for {who} {when}?",
    "greater_than": "Is {a} strictly greater than {b} for {who} {when}?",
    "less_than": "Is {a} strictly less than {b} for {who} {when}?",
    "greater_equal": "Is {a} greater than or equal to {b} for {who} {when}?",
    "less_equal": "Is {a} less than or equal to {b} for {who} {when}?",
    "equals": "Is the {a} equal to {b} for {who}?",
    "not_equals": "Is the {a} different from {b} for {who}?",
    "change": "What is the absolute change in {a} for {who} from fiscal year {year_a} to fiscal year {year_b}?",
    "pct_change": "What is the percentage change in {a} for {who} from fiscal year {year_a} to fiscal year {year_b}?",
}
FORMAL_AGGREGATES = {"sum": "total sum", "avg": "average (arithmetic mean)", "max": "maximum value", "min": "minimum value", "count": "count of all companies with data"}


def filled(template: str, **values: Column) -> Column:
    """A template's text with columns in the places of its {names}."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p))


def formal_leaf(label: Column, who: Column, year: Column) -> Column:
    """A lookup's question: with a year, the value reported for it."""
    dated = filled("What was the {a} reported by {who} for the fiscal year ending {year}?", a=label, who=who, year=year)
    return F.when(year.isNotNull(), dated).otherwise(filled("What is the {a} of {who}?", a=label, who=who))


def formal_pair(op: str, a: Column, b: Column, who: Column, year_a: Column, year_b: Column) -> Column:
    """The question of one of the twelve two-operand operations, and ``ratio``."""
    span = filled("from fiscal year {a} to fiscal year {b}", a=year_a, b=year_b)
    when = F.when(year_a == year_b, filled("for fiscal year {a}", a=year_a)).when(year_a.isNotNull() & year_b.isNotNull(), span).when(year_a.isNotNull(), filled("for fiscal year {a}", a=year_a)).otherwise("")
    return filled(FORMAL_PAIRS[op], a=a, b=b, who=who, when=when, year_a=year_a, year_b=year_b)


def formal_aggregate(op: str, label: Column, year: Column) -> Column:
    when = F.when(year.isNotNull(), filled("for fiscal year {y}", y=year)).otherwise("")
    return filled("What is the {op} of {a} across all companies in the dataset {when}?", op=F.lit(FORMAL_AGGREGATES[op]), a=label, when=when)


def formal_composed(expression: Column, who: Column, operands: int) -> Column:
    """A composition's question: it names the expression, and with two operands or more the order of work."""
    if operands >= 2:
        return filled("For {who}, what is the result of computing {e}? Specifically, evaluate the sub-expression first, then apply the outer operation.", who=who, e=expression)
    return filled("For {who}, evaluate: {e}", who=who, e=expression)


#: How a computation is traced.
TRACES = {
    "add": "{na}({a}) + {nb}({b}) = {v}", "subtract": "{na}({a}) - {nb}({b}) = {v}", "multiply": "{na}({a}) × {nb}({b}) = {v}", "divide": "{na}({a}) / {nb}({b}) = {v}", "ratio": "{na}({a}) / {nb}({b}) = {v}",
    "greater_than": "{na}({a}) > {nb}({b}) → {v}", "less_than": "{na}({a}) < {nb}({b}) → {v}", "greater_equal": "{na}({a}) ≥ {nb}({b}) → {v}", "less_equal": "{na}({a}) ≤ {nb}({b}) → {v}",
    "change": "Δ = {nb}({b}) - {na}({a}) = {v}", "pct_change": "%Δ = ({nb}({b}) - {na}({a})) / |{a}| × 100 = {v}%",
}


def trace(op: str, name_a: Column, a: Column, name_b: Column, b: Column, value: Column) -> Column:
    """What was computed, as text; operands and value are texts already."""
    return filled(TRACES[op], na=name_a, a=a, nb=name_b, b=b, v=value)


def sheet_lines(sheet: DataFrame, entity: str, period: str, fields: list[str]) -> DataFrame:
    """A whole sheet as text: (entity, text), a ``Year y:`` block a period, in order, with a ``field: value`` line each; missing values are left out."""
    line = lambda f: F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}: "), F.col(f).cast("decimal(20,2)").cast("string")))
    block = F.concat_ws("\n", F.concat(F.lit("Year "), F.col(period).cast("string"), F.lit(":")), *map(line, fields))
    rows = sheet.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct(period, block.alias("t")))).alias("rows"))  # an entity's periods
    return rows.select(entity, F.array_join(F.transform("rows", lambda r: r["t"]), "\n").alias("text"))


def sheet_row_lines(fields: list[str]) -> Column:
    """A single row as text, a ``field: value`` line each; missing values are left out."""
    return F.concat_ws("\n", *(F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}: "), F.col(f).cast("decimal(20,2)").cast("string"))) for f in fields))
