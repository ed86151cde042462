"""Totals of statements and of the notes to them, as columns; a missing part follows the rule stated with each total."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    """The sum of an array or of a map's values (arrays only hold doubles); nothing sums to 0, and missing parts count 0."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def map_values_total(parts: Column) -> Column:
    return F.coalesce(total(F.map_values(parts)), F.lit(0.0))


def balance_totals(current_assets: Column, other_assets: Column, current_debts: Column, other_debts: Column, equity: Column) -> dict[str, Column]:
    """Totals of a balance sheet whose sections are maps from line to amount."""
    own = {
        "total_current_assets": map_values_total(current_assets), "total_non_current_assets": map_values_total(other_assets), "total_current_liabilities": map_values_total(current_debts),
        "total_non_current_liabilities": map_values_total(other_debts), "total_shareholders_equity": map_values_total(equity),
    }
    assets = own["total_current_assets"] + own["total_non_current_assets"]
    debts = own["total_current_liabilities"] + own["total_non_current_liabilities"]
    return own | {"total_assets": assets, "total_liabilities": debts, "total_liabilities_and_equity": debts + own["total_shareholders_equity"]}


def income_totals(net_sales: Column, other_revenue: Column, cost_of_sales: Column, other_costs: Column, other_income: Column, tax: Column, minority: Column) -> dict[str, Column]:
    """Derived lines of a statement of operations, and margins in percent of net sales.

    Gross profit, and the margins, are NULL without net sales (the margins also at 0); the parent's share is NULL without a minority's.
    """
    sales = F.coalesce(net_sales, F.lit(0.0))
    operating = sales + F.coalesce(other_revenue, F.lit(0.0)) - F.coalesce(cost_of_sales, F.lit(0.0)) - F.coalesce(other_costs, F.lit(0.0))
    before = operating + F.coalesce(other_income, F.lit(0.0))
    net = before - F.coalesce(tax, F.lit(0.0))
    gross = net_sales - F.coalesce(cost_of_sales, F.lit(0.0))
    share = lambda x: F.try_divide(x * 100, net_sales)
    return {
        "gross_profit": gross, "operating_income": operating, "income_before_taxes": before, "net_income": net, "net_income_parent": net - minority,
        "gross_profit_pct": share(gross), "operating_margin_pct": share(operating), "net_margin_pct": share(net),
    }


def cash_totals(operating: Column, investing: Column, financing: Column, exchange: Column, opening: Column) -> dict[str, Column]:
    """Totals of a cash flow statement whose sections are maps from line to amount."""
    own = {"net_cash_operating": map_values_total(operating), "net_cash_investing": map_values_total(investing), "net_cash_financing": map_values_total(financing)}
    change = sum(own.values(), F.coalesce(exchange, F.lit(0.0)))
    return own | {"net_change": change, "closing_cash": opening + change}


def comprehensive(net_income: Column, other: Column, minority: Column) -> dict[str, Column]:
    """Comprehensive income, from a map of its other parts; the parent's share is NULL where the minority's is."""
    oci = map_values_total(other)
    return {"other_comprehensive_income": oci, "comprehensive_income": net_income + oci, "comprehensive_income_parent": net_income + oci - minority}


def debt_totals(instruments: Column) -> dict[str, Column]:
    """Totals of an array of debts (carrying_value, is_current)."""
    part = lambda keep: total(F.transform(F.filter(instruments, keep), lambda i: i["carrying_value"]))
    return {"total_debt": part(lambda i: F.lit(True)), "current_portion": part(lambda i: i["is_current"]), "non_current_portion": part(lambda i: ~i["is_current"])}


def segment_totals(segments: Column, reconciling_sales: Column, reconciling_income: Column) -> dict[str, Column]:
    """Totals of an array of segments (net_sales, operating_income), and consolidated by maps of reconciling items."""
    sales, income = total(F.transform(segments, lambda s: s["net_sales"])), total(F.transform(segments, lambda s: s["operating_income"]))
    return {
        "segment_net_sales": sales, "consolidated_net_sales": sales + map_values_total(reconciling_sales),
        "segment_operating_income": income, "consolidated_operating_income": income + map_values_total(reconciling_income),
    }


def lease_present_value(payments: Column, imputed_interest: Column) -> Column:
    """All payments of a lease less the interest in them; NULL where that is not known."""
    return map_values_total(payments) - imputed_interest


def repurchased(programs: Column) -> Column:
    """What an array of repurchase programs (amount_repurchased_period) bought back."""
    return total(F.transform(programs, lambda p: p["amount_repurchased_period"]))
