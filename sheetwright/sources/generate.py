"""Synthetic sheets: companies by year, and quarterly filings, from portable draws; every row stands alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prng import uniform

FIRST_YEAR, YEARS = 2020, 6
#: Shares of revenue, or of another measure, that a company's amounts are drawn from: measure -> (of, low, high).
SHARES = {
    "cost_of_goods_sold": ("revenue", 0.35, 0.65), "operating_expenses": ("revenue", 0.10, 0.25), "non_operating_expenses": ("revenue", 0.01, 0.05), "total_assets": ("revenue", 0.8, 2.0),
    "total_liabilities": ("total_assets", 0.3, 0.7), "cash": ("total_assets", 0.05, 0.15), "accounts_receivable": ("total_assets", 0.05, 0.12), "inventories": ("total_assets", 0.03, 0.10),
    "short_term_investments": ("total_assets", 0.02, 0.08), "current_liabilities": ("total_liabilities", 0.2, 0.5), "capex": ("revenue", 0.03, 0.12), "dividends_paid": ("revenue", 0.0, 0.04),
}


def between(low: float, high: float, seed: int, *keys: Column) -> Column:
    return uniform(seed, *keys) * (high - low) + low


def annual_companies(spark: SparkSession, companies: int | DataFrame, seed: int = 1, factor: float = 1.0) -> DataFrame:
    """One row a company and year: revenue grows along a chain of draws, other amounts are shares, assets balance.

    ``companies`` is how many, or a table of their numbers (company), each once; a company's rows depend on its number only.  ``factor`` multiplies revenue, and so everything drawn from it, as well as shares, price and employees.
    """
    if factor <= 0:
        raise ValueError("factor must be positive")
    numbers = spark.range(companies).withColumnRenamed("id", "company") if isinstance(companies, int) else companies
    rows = numbers.select(F.col("company"), F.explode(F.sequence(F.lit(0), F.lit(YEARS - 1))).alias("k"))
    who = F.col("company")
    # Growth factors up to a year are recomputed from draws, so that no row waits for another.
    path = F.aggregate(F.sequence(F.lit(0), F.col("k")), F.lit(1.0), lambda a, j: a * F.when(j == 0, 1.0).otherwise(1 + between(-0.05, 0.15, seed + 1, who, j)))
    rows = rows.withColumn("revenue", F.floor(between(5e3, 2e5, seed, who) * path * factor))
    for i, (name, (of, low, high)) in enumerate(SHARES.items()):
        rows = rows.withColumn(name, F.floor(F.col(of) * between(low, high, seed + 10 + i, who, F.col("k"))))
    return rows.select(
        F.concat(F.lit("Company "), who.cast("string")).alias("company_name"), F.concat(F.lit("C"), who.cast("string")).alias("ticker"), (F.col("k") + FIRST_YEAR).cast("int").alias("year"), "revenue", *SHARES,
        F.round(between(0.10, 0.30, seed + 50, who, F.col("k")), 4).alias("income_tax"), (F.col("total_assets") - F.col("total_liabilities")).alias("total_equity"),
        F.floor(between(50, 5000, seed + 51, who) * factor).alias("shares_outstanding"), F.round(between(5, 500, seed + 52, who, F.col("k")) * factor, 2).alias("stock_price"), F.floor(between(100, 1e5, seed + 53, who) * factor).alias("employees"),
    )


#: Industry profiles of quarterly filings: scale of revenue, share of cost (None: no gross profit), month in which the fiscal
#: year starts, letters that tickers begin with.
PROFILES = {
    "tech": (90e3, 0.35, 10, "T"), "retail": (40e3, 0.72, 2, "R"), "pharma": (15e3, 0.30, 1, "P"), "energy": (60e3, 0.68, 1, "E"), "airline": (12e3, None, 1, "A"), "wholesale": (30e3, 0.85, 7, "W"),
    "manufacturing": (20e3, 0.70, 1, "M"), "finance": (25e3, None, 1, "F"), "healthcare": (35e3, 0.60, 1, "H"), "construction": (8e3, 0.82, 1, "C"), "professional_services": (10e3, 0.65, 9, "S"), "information": (18e3, 0.45, 1, "I"),
}


#: Lines that a filing's totals are broken down into: those of every industry, and each industry's own, own wordings.
COMMON_LINES = {
    "operating_expenses": ["General and administrative"], "total_assets": ["Cash", "Receivables", "Property and equipment"], "total_liabilities": ["Payables", "Borrowings"],
    "operating_cash": ["Net income", "Depreciation and amortization"],
}
INDUSTRY_LINES = {
    "tech": {"operating_expenses": ["Research", "Selling"], "total_assets": ["Capitalized software"], "total_liabilities": ["Unearned subscriptions"], "operating_cash": ["Stock awards"]},
    "retail": {"operating_expenses": ["Store payroll", "Advertising"], "total_assets": ["Merchandise"], "total_liabilities": ["Gift cards outstanding", "Store leases"], "operating_cash": ["Merchandise purchases"]},
    "pharma": {"operating_expenses": ["Clinical trials", "Selling"], "total_assets": ["Acquired compounds"], "total_liabilities": ["Milestones owed"], "operating_cash": ["Rebate accruals"]},
    "energy": {"operating_expenses": ["Exploration", "Depletion"], "total_assets": ["Reserves"], "total_liabilities": ["Well retirement"], "operating_cash": ["Dry holes"]},
    "airline": {"operating_expenses": ["Crew pay", "Jet fuel", "Airport fees"], "total_assets": ["Aircraft", "Route rights"], "total_liabilities": ["Tickets sold ahead", "Mileage owed"], "operating_cash": ["Tickets sold ahead"]},
    "wholesale": {"operating_expenses": ["Warehousing", "Freight out"], "total_assets": ["Goods for resale"], "total_liabilities": ["Vendor financing"], "operating_cash": ["Goods for resale"]},
    "manufacturing": {"operating_expenses": ["Plant overhead", "Selling"], "total_assets": ["Raw materials", "Work in process"], "total_liabilities": ["Product warranty"], "operating_cash": ["Raw materials"]},
    "finance": {"operating_expenses": ["Credit losses", "Branch costs"], "total_assets": ["Loans", "Securities"], "total_liabilities": ["Deposits"], "operating_cash": ["Credit losses"]},
    "healthcare": {"operating_expenses": ["Clinical salaries", "Supplies"], "total_assets": ["Medical equipment"], "total_liabilities": ["Malpractice reserve"], "operating_cash": ["Patient accounts"]},
    "construction": {"operating_expenses": ["Site overhead", "Bonding"], "total_assets": ["Unbilled contracts"], "total_liabilities": ["Billings ahead of work"], "operating_cash": ["Unbilled contracts"]},
    "professional_services": {"operating_expenses": ["Consultant pay", "Travel"], "total_assets": ["Unbilled hours"], "total_liabilities": ["Bonuses owed"], "operating_cash": ["Unbilled hours"]},
    "information": {"operating_expenses": ["Content costs", "Network operations"], "total_assets": ["Content rights"], "total_liabilities": ["Royalties owed"], "operating_cash": ["Content spending"]},
}
#: The map that holds a total's lines, and what their concepts begin with.
BREAKDOWNS = {"operating_expenses": ("operating_lines", "opx_"), "total_assets": ("asset_lines", "ast_"), "total_liabilities": ("liability_lines", "lia_"), "operating_cash": ("cash_lines", "ocf_")}


def with_breakdowns(filings: DataFrame, seed: int = 1) -> DataFrame:
    """Filings with their totals broken down into lines of their industry: the maps of BREAKDOWNS, which add up to the totals.

    Shares are draws; the last line takes what rounding leaves.
    """
    for total, (column, _) in BREAKDOWNS.items():
        names = F.lit(None).cast("array<string>")
        for industry, lines in INDUSTRY_LINES.items():
            names = F.when(F.col("industry") == industry, F.array(*map(F.lit, [*lines[total], *COMMON_LINES[total]]))).otherwise(names)
        weights = F.transform(names, lambda n: between(0.2, 1.2, seed + 60, F.col("id"), n))
        rows = filings.withColumns({"__names__": names, "__weights__": weights})
        all_of = F.aggregate("__weights__", F.lit(0.0), lambda a, x: a + x)
        parts = F.transform(F.slice("__weights__", 1, F.size("__weights__") - 1), lambda w: F.round(F.col(total) * w / all_of, 2))
        rows = rows.withColumn("__parts__", parts)
        rest = F.round(F.col(total) - F.aggregate("__parts__", F.lit(0.0), lambda a, x: a + x), 2)
        filings = rows.withColumn(column, F.map_from_arrays("__names__", F.concat("__parts__", F.array(rest)))).drop("__names__", "__weights__", "__parts__")
    return filings


def quarterly_filings(spark: SparkSession, filings: int, seed: int = 1, year: int = 2025) -> DataFrame:
    """One row a filing: breakdown maps, derived totals, balance and cash, prior-year figures by scaling, dates."""
    names = F.array(*map(F.lit, PROFILES))
    who = F.col("id")
    rows = spark.range(filings).withColumns({"industry": F.get(names, F.floor(uniform(seed, who) * len(PROFILES)).cast("int")), "quarter": (F.floor(uniform(seed + 1, who) * 3) + 1).cast("int")})
    scale, cost, start, letter, sells = F.lit(0.0), F.lit(0.0), F.lit(1), F.lit(""), F.lit(False)
    for name, (s, c, m, t) in PROFILES.items():
        own = F.col("industry") == name
        scale, cost, start = F.when(own, s).otherwise(scale), F.when(own, c or 0.6).otherwise(cost), F.when(own, m).otherwise(start)
        letter, sells = F.when(own, t).otherwise(letter), F.when(own, c is not None).otherwise(sells)
    ticker = F.concat(letter, F.upper(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), who.cast("string"))), 1, 3)))
    rows = rows.withColumns({"ticker": ticker, "sells": sells, "scale": scale * between(0.5, 1.5, seed + 2, who), "cost_share": cost, "start_month": start})
    rows = rows.withColumn("share", between(0.5, 0.9, seed + 3, who))
    whole = lambda c: F.round(c, 2)
    rows = rows.withColumns({
        "revenues": F.create_map(F.lit("Products"), whole(F.col("scale") * F.col("share")), F.lit("Services"), whole(F.col("scale") * (1 - F.col("share")))),
        "costs": F.create_map(F.lit("Products"), whole(F.col("scale") * F.col("share") * F.col("cost_share")), F.lit("Services"), whole(F.col("scale") * (1 - F.col("share")) * F.col("cost_share"))),
    })
    rows = rows.withColumns({"total_revenues": map_total("revenues"), "cost_of_sales": map_total("costs"), "operating_expenses": whole(F.col("scale") * between(0.05, 0.2, seed + 4, who)), "tax": between(0.15, 0.25, seed + 5, who)})
    rows = rows.withColumns({"gross_profit": F.when(F.col("sells"), F.col("total_revenues") - F.col("cost_of_sales")), "total_assets": whole(F.col("scale") * between(2, 5, seed + 6, who)), "opening_cash": whole(F.col("scale") * between(0.1, 0.4, seed + 8, who))})
    rows = rows.withColumns({"operating_income": F.col("total_revenues") - F.col("cost_of_sales") - F.col("operating_expenses"), "total_liabilities": whole(F.col("total_assets") * between(0.3, 0.7, seed + 7, who))})
    rows = rows.withColumns({"net_income": whole(F.col("operating_income") * (1 - F.col("tax"))), "total_equity": F.col("total_assets") - F.col("total_liabilities")})
    rows = rows.withColumns({"shares_basic": F.floor(between(50, 5000, seed + 10, who)), "dilution": between(1.0, 1.05, seed + 11, who)})
    rows = rows.withColumns({"shares_diluted": F.ceil(F.col("shares_basic") * F.col("dilution")), "eps_basic": F.round(F.col("net_income") / F.col("shares_basic"), 4)})
    rows = rows.withColumn("eps_diluted", F.round(F.col("net_income") / F.col("shares_diluted"), 4))
    rows = rows.withColumns({"operating_cash": whole(F.col("net_income") * 1.2), "investing_cash": whole(F.col("scale") * -0.08), "financing_cash": whole(F.col("scale") * -0.03)})
    rows = rows.withColumns({"net_change": F.col("operating_cash") + F.col("investing_cash") + F.col("financing_cash")})
    ends = F.last_day(F.add_months(F.make_date(F.lit(year), F.col("start_month"), F.lit(1)), F.col("quarter") * 3 - 1))
    words = F.element_at(F.array(F.lit("Three"), F.lit("Six"), F.lit("Nine")), F.col("quarter"))
    rows = rows.withColumns({"closing_cash": F.col("opening_cash") + F.col("net_change"), "prior_revenues": whole(F.col("total_revenues") / between(1.0, 1.2, seed + 9, who)), "period_end": ends})
    label = lambda w: F.concat(w, F.lit(" Months Ended "), F.date_format("period_end", "MMMM d, yyyy"))
    return rows.withColumns({"quarter_label": label(F.lit("Three")), "ytd_label": label(words), "ytd_revenues": whole(F.col("total_revenues") * F.col("quarter")), "instant_label": F.date_format("period_end", "MMMM d, yyyy")}).drop("scale", "cost_share", "share", "tax", "sells", "dilution").transform(with_breakdowns, seed)


def map_total(column: str) -> Column:
    """The sum of a map's values; an empty or missing map has none."""
    return F.when(F.size(column) > 0, F.aggregate(F.map_values(column), F.lit(0.0), lambda a, x: a + x))


def known_sum(*columns: str) -> Column:
    """The sum of the known among some columns; NULL if none is."""
    some = F.lit(False)
    for c in columns:
        some = some | F.col(c).isNotNull()
    return F.when(some, sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0)))


def percent_of(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100, whole)


def roll_forward(opening: Column, movements: Column) -> dict[str, Column]:
    """Closing equity by account: movements are routed by words in their names."""
    total = lambda pattern: F.aggregate(F.map_values(F.map_filter(movements, lambda k, v: F.lower(k).rlike(pattern))), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return {"paid_in": total("apic|stock|issu"), "retained": total("retained|dividend"), "noncontrolling": total("noncontrolling|nci"), "closing": opening + total(".")}


def snake_case(label: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), F.lit("_"))


def filing_facts(filings: DataFrame) -> DataFrame:
    """Typed facts of filings: (key, concept, entity, period, period_type, unit, value), breakdown lines included.

    Flows stand for the quarter and, from the second quarter on, for the year so far; balances for the last day.
    """
    flow = lambda c, label, kind: F.struct(F.lit(c).alias("concept"), F.col(label).alias("period"), F.lit(kind).alias("period_type"), F.col(c).cast("double").alias("value"))
    fixed = F.array(
        *(flow(c, "quarter_label", "quarter") for c in ("total_revenues", "cost_of_sales", "gross_profit", "operating_expenses", "operating_income", "net_income", "operating_cash", "net_change")),
        *(flow(c, "instant_label", "instant") for c in ("total_assets", "total_liabilities", "total_equity", "closing_cash")),
    )
    so_far = F.struct(F.lit("total_revenues").alias("concept"), F.col("ytd_label").alias("period"), F.lit("ytd").alias("period_type"), F.when(F.col("quarter") > 1, F.col("ytd_revenues")).alias("value"))
    lines = lambda m, prefix: F.transform(F.map_entries(m), lambda e: F.struct(F.concat(F.lit(prefix), snake_case(e["key"])).alias("concept"), F.col("quarter_label").alias("period"), F.lit("quarter").alias("period_type"), e["value"].alias("value")))
    balances = lambda m, prefix: F.transform(lines(m, prefix), lambda x: x.withField("period", F.col("instant_label")).withField("period_type", F.lit("instant")))
    broken = [balances(c, prefix) if total in ("total_assets", "total_liabilities") else lines(c, prefix) for total, (c, prefix) in BREAKDOWNS.items() if c in filings.columns]
    facts = filings.select(F.col("id").alias("entity"), F.inline(F.concat(fixed, F.array(so_far), lines("revenues", "rev_"), lines("costs", "cos_"), *broken))).where("value is not null")
    return facts.withColumns({"key": F.concat_ws("_", F.col("entity").cast("string"), "concept", "period_type"), "unit": F.lit("M_USD")})


def filing_checks(filings: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """The filings that break an identity: balance, cash reconciliation, earnings a share, more diluted shares than basic ones."""
    balance = F.abs(F.col("total_assets") - F.col("total_liabilities") - F.col("total_equity"))
    cash = F.abs(F.col("closing_cash") - F.col("opening_cash") - F.col("net_change"))
    earnings = F.abs(F.col("eps_basic") * F.col("shares_basic") - F.col("net_income"))
    found = {"balances": balance <= tolerance, "reconciles": cash <= tolerance, "earns": earnings <= tolerance, "dilutes": F.col("shares_diluted") >= F.col("shares_basic")}
    found |= {f"adds_up_{total}": F.abs(map_total(c) - F.col(total)) <= tolerance for total, (c, _) in BREAKDOWNS.items() if c in filings.columns}
    return filings.select("id", *(v.alias(k) for k, v in found.items())).where(f"not ({' and '.join(found)})")


#: The statements of a report: statement -> section -> lines, in order.
STATEMENTS = {
    "operations": {"revenue": ["total_revenues"], "costs": ["cost_of_sales", "gross_profit", "operating_expenses"], "income": ["operating_income", "net_income"], "per_share": ["eps_basic", "eps_diluted"]},
    "balance_sheet": {"assets": ["total_assets"], "liabilities": ["total_liabilities"], "equity": ["total_equity"]},
    "cash_flows": {"activities": ["operating_cash", "investing_cash", "financing_cash"], "cash": ["opening_cash", "net_change", "closing_cash"]},
    "shareholders_equity": {"equity": ["total_equity"]},
}


def report_document(filings: DataFrame) -> DataFrame:
    """Each filing as nested JSON, statement by statement: (id, document); missing lines are left out."""
    section = lambda lines: F.struct(*(F.col(c).alias(c) for c in lines))
    statement = lambda parts: F.struct(*(section(lines).alias(name) for name, lines in parts.items()))
    head = ["ticker", "industry", "quarter", F.col("period_end").cast("string").alias("period_end")]
    head += [F.struct(*(c for c, _ in BREAKDOWNS.values() if c in filings.columns)).alias("breakdowns")] if "asset_lines" in filings.columns else []
    return filings.select("id", F.to_json(F.struct(*head, *(statement(parts).alias(name) for name, parts in STATEMENTS.items()))).alias("document"))


def report_lines(filings: DataFrame, width: int = 32) -> DataFrame:
    """Each filing as text, the four statements with their period, sections and fixed-width lines: (id, text)."""
    label = lambda c: c.replace("_", " ").capitalize()
    line = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("    " + label(c).ljust(width)), F.lpad(F.format_number(c, 2), 18, " ")))
    parts = []
    for name, sections in STATEMENTS.items():
        period = F.col("instant_label" if name in ("balance_sheet", "shareholders_equity") else "quarter_label")
        parts += [F.lit(label(name)), F.concat(F.lit("  "), period)]
        for section, lines in sections.items():
            parts += [F.lit("  " + label(section)), *map(line, lines)]
    return filings.select("id", F.concat_ws("\n", *parts).alias("text"))


def wide_by_year(sheet: DataFrame, measures: list[str], years: list[int]) -> DataFrame:
    """One row a company with columns ``measure_year``."""
    wide = sheet.groupBy("company_name").pivot("year", years).agg(*(F.max(m).alias(m) for m in measures))
    return wide.select("company_name", *(F.col(f"`{y}_{m}`" if len(measures) > 1 else f"`{y}`").alias(f"{m}_{y}") for m in measures for y in years))


def column_schema(wide: DataFrame) -> list[dict]:
    """What a wide sheet's column names say: base name and year, and the kind of values."""
    import re

    out = []
    for name, kind in wide.dtypes:
        found = re.fullmatch(r"(.+)_(\d{4})", name)
        out.append({"column": name, "type": "numeric" if kind in ("bigint", "int", "double", "float") else "categorical", "base_name": found[1] if found else name, "year": int(found[2]) if found else None})
    return out


def distinct_filers(filings: DataFrame, most: int) -> DataFrame:
    """At most ``most`` filings of different tickers, the first by id of each: over-generate, then keep."""
    first = filings.groupBy("ticker").agg(F.min("id").alias("id"))
    return filings.join(first, ["ticker", "id"]).orderBy("id").limit(most)


def many_filings(spark: SparkSession, count: int, seed: int = 1, year: int = 2025) -> DataFrame:
    """Filings of ``count`` different tickers out of at most twenty times as many candidates; fewer where there are not enough."""
    if count < 1:
        raise ValueError("count is at least 1")
    return distinct_filers(quarterly_filings(spark, 20 * count, seed, year), count)
