"""Questions of five levels over a sheet of company measures: lookups, single operations, named ratios, changes, comparisons.

A composer makes plans: which measures and years a question takes.  Plans are rows, so that they cross with companies and are
worded and answered by columns; which of a level's candidates are asked is a draw by seed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .render import filled
from .sampling import Draws

#: The measures whose change, and the pairs whose ratio, is asked for; growth by name; ratios that are compared.
CHANGES = ["total_revenue", "net_income", "total_assets", "total_liabilities", "total_stockholders_equity", "cash_and_equivalents", "operating_income", "long_term_debt", "gross_profit"]
PAIRS = [
    ("cash_and_equivalents", "total_assets"), ("long_term_debt", "total_assets"), ("accounts_receivable_net", "total_revenue"), ("inventories", "cost_of_goods_sold"),
    ("selling_general_admin", "total_revenue"),
]
GROWTH = {
    "revenue_growth": "total_revenue",
    "net_income_growth": "net_income",
    "asset_growth": "total_assets",
    "equity_growth": "total_stockholders_equity",
    "operating_income_growth": "operating_income",
}
CHANGED_RATIOS = ["current_ratio", "debt_to_equity", "gross_margin", "operating_margin", "net_profit_margin"]
IMPROVED_RATIOS = ["gross_margin", "operating_margin", "current_ratio", "debt_to_equity"]
LESS_IS_BETTER = {"debt_to_equity"}
#: How many of a level's candidates are asked.
LOOKUPS, DIFFERENCES, SIMPLE_RATIOS, NAMED, RATIO_CHANGES, GROWTHS, IMPROVEMENTS = 15, 6, 4, 10, 4, 3, 2


@dataclass(frozen=True)
class Plan:
    """A question's plan: what is asked of which measures, at which years (the earlier first)."""

    level: int
    kind: str
    name: str
    measures: tuple[str, ...]
    years: tuple[int, ...]


def some(draws: Draws, items: list, count: int) -> list:
    """Different items at random, at most ``count``."""
    left, out = list(items), []
    while left and len(out) < count:
        out.append(left.pop(int(draws.uniform() * len(left))))
    return out


def compose(level: int, measures: list[str], ratios: dict[str, bool], years: list[int], seed: int) -> list[Plan]:
    """The plans of a level; ``ratios`` says of each named ratio whether it needs the year before.

    Levels four and five, and ratios that need the year before, take the last two years; with one year there are none.
    """
    draws, own, two = Draws(seed), set(measures), tuple(sorted(years)[-2:])
    known = lambda names: [n for n in names if n in ratios]
    if level == 1:
        return [Plan(1, "lookup", m, (m,), (draws.pick(years),)) for m in some(draws, sorted(own), LOOKUPS)]
    if level == 2:
        out = [Plan(2, "change", m, (m,), two) for m in some(draws, [m for m in CHANGES if m in own], DIFFERENCES)] if len(two) == 2 else []
        return out + [Plan(2, "ratio", f"{a}/{b}", (a, b), (draws.pick(years),)) for a, b in some(draws, [p for p in PAIRS if own.issuperset(p)], SIMPLE_RATIOS)]
    if level == 3:
        picked = some(draws, sorted(ratios), NAMED)
        return [Plan(3, "named", n, (), two if ratios[n] else (draws.pick(years),)) for n in picked if len(two) == 2 or not ratios[n]]
    if level not in (4, 5):
        raise ValueError(f"no level {level}")
    if len(two) < 2:
        return []
    if level == 4:
        out = [Plan(4, "ratio_change", n, (), two) for n in some(draws, known(CHANGED_RATIOS), RATIO_CHANGES)]
        return out + [Plan(4, "growth", n, (m,), two) for n, m in some(draws, [g for g in GROWTH.items() if g[1] in own], GROWTHS)]
    out = [Plan(5, "improved", n, (), two) for n in some(draws, known(IMPROVED_RATIOS), IMPROVEMENTS)]
    return out + ([Plan(5, "fcf_margin_change", "change_in_fcf_margin", ("cash_from_operations", "capital_expenditures", "total_revenue"), two)] if own >= {"cash_from_operations", "capital_expenditures", "total_revenue"} else [])


def growth_percent(then: Column, now: Column) -> Column:
    """Growth in percent of the earlier value's size, two decimals; NULL where that is 0."""
    return F.round(F.try_divide((now - then) * 100, F.abs(then)), 2)


def fcf_margin_change(operations: tuple[Column, Column], investment: tuple[Column, Column], sales: tuple[Column, Column]) -> Column:
    """The change of free cash flow over sales from the first of two years to the second; NULL where sales are 0."""
    margin = [F.try_divide(o - i, s) for o, i, s in zip(operations, investment, sales, strict=True)]
    return F.round(margin[1] - margin[0], 4)


#: Wordings by kind of plan; own texts.
WORDINGS = {
    "lookup": ["Read {name} off the {y1} column for {who}.", "Fiscal {y1}, {who}: state {name}."],
    "change": ["Take {who} and subtract its {y1} {name} from its {y2} {name}.", "By which amount does {name} at {who} end up above {y1} once {y2} is reached?"],
    "ratio": ["Divide {a} by {b}, both as {who} states them for {y1}.", "Express {a} as a multiple of {b}, using the {y1} column of {who}."],
    "named": ["Work out {name} for {who}, fiscal {last}.", "Derive the {last} {name} from the sheet of {who}."],
    "ratio_change": ["Evaluate {name} of {who} for {y1} and again for {y2}; give the second less the first.", "{y2} less {y1}: {name}, {who}."],
    "growth": ["Measured against {y1}, how many percent more {a} does {who} show in {y2}?", "Give {name} of {who} in percent, with {y1} as the base and {y2} as the end."],
    "improved": ["Yes or no: is {name} of {who} in a healthier place at {y2} than it was at {y1}?", "True or false: {who} ends {y2} with a more favourable {name} than {y1}."],
    "fcf_margin_change": ["Free cash flow per unit of revenue at {who}: subtract the {y1} figure from the {y2} figure."],
}


def worded(plan: Plan, who: Column, draw: Column) -> Column:
    """A plan as a question, one of its kind's wordings by a draw in [0, 1)."""
    label = lambda x: F.lit(x.replace("_", " "))
    values = {"who": who, "name": label(plan.name), "y1": F.lit(plan.years[0]), "last": F.lit(plan.years[-1]), "y2": F.lit(plan.years[-1]), "a": label(plan.measures[0] if plan.measures else ""), "b": label(plan.measures[-1] if plan.measures else "")}
    made = [filled(w, **values) for w in WORDINGS[plan.kind]]
    return F.get(F.array(*made), F.floor(draw * len(made)).cast("int"))


#: What a placeholder's name says of the number that stands for it: (pattern, least, most, step, text before, after).
PLACEHOLDERS = [
    ("^multiplier$", 105, 140, 1, "x", ""),
    ("^margin_pts$|_pts$", 3, 12, 1, "", " percentage points"),
    ("^decade$", 1960, 1990, 10, "", "s"),
    ("^months$", 1, 27, 1, "", ""),
    ("^amount$", 5000, 33999, 1, "", ""),
    ("^year", 1900, 2018, 1, "", ""),
    ("^rate", 1, 12, 1, "", ""),
    ("", 5, 45, 1, "", ""),
]


def placeholder_value(name: Column, draw: Column) -> Column:
    """The text that fills a placeholder, by its name and a draw; a multiplier has two decimals."""
    out = F.lit(None).cast("string")
    for pattern, least, most, step, before, after in reversed(PLACEHOLDERS):
        number = F.floor(draw * ((most - least) // step + 1)) * step + least
        text = F.concat(F.lit("1."), F.lpad((number - 100).cast("string"), 2, "0")) if before == "x" else F.concat(number.cast("string"), F.lit(after))
        out = F.when(F.lower(name).rlike(pattern), text).otherwise(out)
    return out

