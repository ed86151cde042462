"""Named ratios, their change over time, and compound measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .windows import series

Values = Callable[[str], Column]


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a, b), 4)


def _averaged(v: Values, top: str, bottom: str) -> Column:
    """A flow against the mean of a stock at this and the earlier period."""
    return ratio(v(top), (v(bottom) + F.lag(v(bottom)).over(series())) / 2)


#: Named ratios of company statements.
RATIOS: dict[str, Callable[[Values], Column]] = {
    "current_ratio": lambda v: ratio(v("total_current_assets"), v("total_current_liabilities")),
    "quick_ratio": lambda v: ratio(v("total_current_assets") - v("inventories"), v("total_current_liabilities")),
    "working_capital": lambda v: v("total_current_assets") - v("total_current_liabilities"),
    "debt_to_equity": lambda v: ratio(v("total_liabilities"), v("total_stockholders_equity")),
    "debt_to_assets": lambda v: ratio(v("total_liabilities"), v("total_assets")),
    "interest_coverage": lambda v: ratio(v("operating_income"), v("interest_expense")),
    "gross_margin": lambda v: ratio(v("gross_profit"), v("total_revenue")),
    "operating_margin": lambda v: ratio(v("operating_income"), v("total_revenue")),
    "net_profit_margin": lambda v: ratio(v("net_income"), v("total_revenue")),
    "return_on_assets": lambda v: _averaged(v, "net_income", "total_assets"),
    "return_on_equity": lambda v: _averaged(v, "net_income", "total_stockholders_equity"),
    "effective_tax_rate": lambda v: ratio(v("income_tax_expense"), v("income_before_tax")),
    "free_cash_flow": lambda v: v("cash_from_operations") - v("capital_expenditures"),
    "rd_to_revenue": lambda v: ratio(v("research_and_development"), v("total_revenue")),
    "capex_to_revenue": lambda v: ratio(v("capital_expenditures"), v("total_revenue")),
}


def change(value: Column) -> Column:
    return F.round(value - F.lag(value).over(series()), 4)


def improved(value: Column, less_is_better: bool = False) -> Column:
    then = F.lag(value).over(series())
    return value < then if less_is_better else value > then


def dupont(income: Column, sales: Column, assets: Column, equity: Column) -> dict[str, Column]:
    """Return on equity as margin times turnover times leverage."""
    parts = {"margin": F.try_divide(income, sales), "turnover": F.try_divide(sales, assets), "leverage": F.try_divide(assets, equity)}
    return {k: F.round(v, 4) for k, v in parts.items()} | {"roe": F.round(parts["margin"] * parts["turnover"] * parts["leverage"], 4)}


def discounted(flow: Column, growth: float, rate: float, years: int = 5) -> Column:
    """Present value of a flow that grows for some years."""
    terms = F.transform(F.sequence(F.lit(1), F.lit(years)), lambda k: flow * F.pow(F.lit(1 + growth), k) / F.pow(F.lit(1 + rate), k))
    return F.round(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), 2)


def percent(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a * 100, b), 2)


def margins(gross: Column, operating: Column, sales: Column) -> dict[str, Column]:
    """Gross and operating margin in percent, and their difference."""
    g, o = percent(gross, sales), percent(operating, sales)
    return {"gross_margin": g, "operating_margin": o, "difference": F.round(g - o, 2)}


def free_cash(operations: Column, investment: Column, sales: Column) -> dict[str, Column]:
    """Free cash flow and its margin in percent."""
    flow = F.round(operations - investment, 2)
    return {"fcf": flow, "fcf_margin": percent(flow, sales)}


def leverage_effect(income: Column, equity: Column, assets: Column) -> dict[str, Column]:
    """Returns on equity and on assets in percent, and how much of the former debt makes."""
    roe, roa = percent(income, equity), percent(income, assets)
    return {"roe": roe, "roa": roa, "leverage_effect": F.round(roe - roa, 2)}


def debt_scenario(sales: Column, cost: Column, expenses: Column, interest: Column, tax_rate: Column, income: Column, equity: Column, share: Column, rate: Column, growth: Column) -> dict[str, Column]:
    """Return on equity after new debt (a share of sales, at a rate) that lets sales grow, cost and expenses staying as they are."""
    new_sales, new_interest = F.round(sales * (1 + growth), 2), F.round(interest + F.round(sales * share, 2) * rate, 2)
    before_tax = F.round(F.round(F.round(new_sales - cost, 2) - expenses, 2) - new_interest, 2)
    old, new = percent(income, equity), percent(F.round(before_tax * (1 - tax_rate), 2), equity)
    return {"new_roe": new, "old_roe": old, "roe_delta": F.round(new - old, 2)}
