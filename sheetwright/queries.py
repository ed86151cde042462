"""Queries over the star-schema tables, one an operator, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.prng import rank_key, uniform
from .operators import catalog, corrupt, mentions, obstacles, quotas, scoring, turns, typed, windows
from .plans import render
from .plans.expr import PROGRAM, SALES, Compiler, Derived, Growth, Leaf, Literal, Node, Over, fold, run_programs
from .sources import star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The sheets in SQL.
LINES = """
    select l.*, p_retailprice, cast(l_extendedprice as decimal(12,2)) as ep, cast(l_discount as decimal(4,2)) as off, cast(l_tax as decimal(4,2)) as tax
    from lineitem l join part on l_partkey = p_partkey"""
MEASURES = """
    cast(cast(sum(ep) as decimal(20,2)) as double) as list_sales,
    cast(cast(sum(ep * off) as decimal(20,2)) as double) as discounts,
    cast(cast(sum(ep * (1 - off) * tax) as decimal(20,2)) as double) as taxes,
    cast(cast(sum(case when l_returnflag = 'R' then ep else 0 end) as decimal(20,2)) as double) as returned_sales,
    cast(cast(sum(cast(l_quantity as decimal(12,2)) * cast(p_retailprice as decimal(12,2))) as decimal(20,2)) as double) as catalog_cost,
    cast(sum(cast(l_quantity as decimal(12,2))) as double) as units_sold, count(*) as line_count"""
RATES = "round(list_sales / nullif(units_sold, 0), 6) as avg_price, round(taxes / nullif(list_sales - discounts, 0), 6) as tax_rate"
SHEET = f"""lines as ({LINES}), sums as (
    select n_name as entity, cast(year(l_shipdate) as integer) as period, {MEASURES}
    from lines join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2),
    sheet as (select *, {RATES} from sums)"""
QUARTERS = """quarters as (
    select n_name as entity, cast(year(o_orderdate) as integer) as year, cast(quarter(o_orderdate) as integer) as quarter,
           cast(sum(cast(o_totalprice as decimal(12,2))) as double) as order_total, count(*) as order_count,
           year(o_orderdate) || 'Q' || quarter(o_orderdate) as period
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2, 3, 6)"""
CONCEPTS = "concepts as (select * from (values " + ", ".join(f"('{k}', '{t}', '{u}', '{p}', {repr(r) if r else 'null'})" for k, (t, u, p, r) in star.CONCEPTS.items()) + ") v(concept, semantic_type, unit, parent_concept, role))"
NAMES = list(star.CONCEPTS)
ATOMS = f"""{SHEET}, {CONCEPTS}, longer as (
    select entity, period, concept, value from (select entity, period, {', '.join(f'cast({c} as double) as {c}' for c in NAMES)} from sheet) unpivot (value for concept in ({', '.join(NAMES)}))),
    atoms as (select entity || '_' || period || '_' || concept as key, * from longer join concepts using (concept))"""


def draw_sql(seed: int, *keys: str) -> str:
    """The portable draw in SQL."""
    return "cast(concat('0x', substr(md5(concat_ws('/', '" + str(seed) + "', " + ", ".join(keys) + ")), 1, 8)) as bigint) / 4294967296.0"


def rank_sql(seed: int, *keys: str) -> str:
    return f"md5(concat_ws('/', '{seed}', {', '.join(keys)}))"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def sheet_of(spark, d):
    return star.annual_sheet(spark, d)


# ---- sources and reshaping -------------------------------------------------------------------------------------

query(f"with {SHEET} select * from sheet", "sheet_annual")(sheet_of)
query(f"with lines as ({LINES}), sums as (select l_suppkey as entity, cast(year(l_shipdate) as integer) as period, {MEASURES} from lines group by 1, 2) select *, {RATES} from sums", "sheet_supplier")(star.supplier_sheet)
query(f"with {QUARTERS} select * from quarters", "sheet_quarterly")(star.quarterly_sheet)


@query(f"with {ATOMS} select key, entity, period, concept, value, semantic_type, unit, parent_concept, role from atoms")
def atoms_unpivot(spark, d):
    return star.atoms(sheet_of(spark, d))


@query(f"with {SHEET} select entity, period, list_sales, discounts, taxes from sheet")
def atoms_repivot(spark, d):
    return star.repivot(star.atoms(sheet_of(spark, d), ["list_sales", "discounts", "taxes"]), ["list_sales", "discounts", "taxes"])


@query(f"with {ATOMS} select key, value from atoms where semantic_type in ('amount', 'price') and period = 1997 and entity = 'NATION_1'")
def atom_filter(spark, d):
    return star.atoms(sheet_of(spark, d)).where(F.col("semantic_type").isin("amount", "price") & (F.col("period") == 1997) & (F.col("entity") == "NATION_1")).select("key", "value")


@query(f"with {ATOMS} select distinct concept from atoms where semantic_type = 'amount'")
def amount_concepts(spark, d):
    return star.atoms(sheet_of(spark, d)).where("semantic_type = 'amount'").select("concept").distinct()


@query(f"with {ATOMS} select parent_concept, role, count(distinct concept) as n_concepts, count(*) as n_facts from atoms where role is not null group by 1, 2")
def sibling_components(spark, d):
    return star.atoms(sheet_of(spark, d)).where("role is not null").groupBy("parent_concept", "role").agg(F.countDistinct("concept").alias("n_concepts"), F.count(F.lit(1)).alias("n_facts"))


@query(f"with {ATOMS} select count(distinct entity) as entities, count(distinct period) as periods, count(distinct concept) as concepts from atoms")
def distinct_keys(spark, d):
    return star.atoms(sheet_of(spark, d)).agg(F.countDistinct("entity").alias("entities"), F.countDistinct("period").alias("periods"), F.countDistinct("concept").alias("concepts"))


@query("select c_custkey as entity, cast(c_acctbal as varchar) as raw, try_cast(replace(replace('$' || c_acctbal, '$', ''), ',', '') as double) as number from customer where c_acctbal <> round(c_acctbal)")
def lex_numbers(spark, d):
    from .sources.files import lex_number

    rows = star.table(spark, d, "customer").where("c_acctbal <> round(c_acctbal)")
    raw = F.col("c_acctbal").cast("string")
    return rows.select(F.col("c_custkey").alias("entity"), raw.alias("raw"), lex_number(F.concat(F.lit("$"), raw))[0].alias("number"))


@query(f"""with {SHEET} select entity, period, 'Year ' || period || ':' || chr(10) || 'discounts: ' || cast(cast(discounts as decimal(20,2)) as varchar) || chr(10) ||
    'list_sales: ' || cast(cast(list_sales as decimal(20,2)) as varchar) as sheet_text from sheet""")
def sheet_text(spark, d):
    line = lambda c: F.concat(F.lit(f"{c}: "), corrupt.cell_text(F.col(c)))
    return sheet_of(spark, d).select("entity", "period", F.concat_ws("\n", F.concat(F.lit("Year "), F.col("period").cast("string"), F.lit(":")), line("discounts"), line("list_sales")).alias("sheet_text"))


@query(f"""with {SHEET} select entity, string_agg('Year ' || period || ': ' || cast(cast(list_sales as decimal(20,2)) as varchar), chr(10) order by period) || chr(10) || 'Question: What is the list sales?' || chr(10) || 'Answer:' as prompt from sheet group by entity""")
def prompt_text(spark, d):
    row = F.struct("period", F.concat(F.lit("Year "), F.col("period").cast("string"), F.lit(": "), corrupt.cell_text(F.col("list_sales"))).alias("line"))
    grouped = sheet_of(spark, d).groupBy("entity").agg(F.sort_array(F.collect_list(row)).alias("rows"))  # an entity's years
    return grouped.select("entity", F.concat_ws("\n", F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("Question: What is the list sales?"), F.lit("Answer:")).alias("prompt"))


# ---- expressions -----------------------------------------------------------------------------------------------

SALES_SQL = {
    "net_sales": "(list_sales - discounts)", "billed": "(list_sales - discounts + taxes)", "gross_profit": "(list_sales - discounts - catalog_cost)",
    "tax_expense": "((list_sales - discounts - catalog_cost) * tax_rate)", "net_income": "(list_sales - discounts - catalog_cost - (list_sales - discounts - catalog_cost) * tax_rate)",
    "deductions": "(discounts + taxes + returned_sales)", "gross_margin": "((list_sales - discounts - catalog_cost) / nullif(list_sales - discounts, 0))",
}


def expression(name: str, tree, sql: str, digits: int = 4) -> None:
    """A query that evaluates one tree for the whole sheet."""

    def run(spark, d):
        return Compiler().evaluate(sheet_of(spark, d), tree, digits=digits)

    query(f"with {SHEET}, v as (select entity, period, round({sql}, {digits}) as answer from sheet) select * from v where answer is not null", name)(run)


L = Leaf
PREVIOUS = "lag({0}) over (partition by entity order by period)"
expression("expr_leaf", L("list_sales"), "list_sales")
expression("expr_literal", Node("mul", L("list_sales"), Literal(2.5)), "list_sales * 2.5")
expression("expr_sum", Node("sum", L("discounts"), L("taxes")), "discounts + taxes")
expression("expr_diff", Node("diff", L("list_sales"), L("discounts")), "list_sales - discounts")
expression("expr_ratio", Node("ratio", L("returned_sales"), L("list_sales")), "returned_sales / nullif(list_sales, 0)", 6)
expression("expr_mul", Node("mul", L("list_sales"), L("tax_rate")), "list_sales * tax_rate")
expression("expr_growth", Growth(L("list_sales")), f"(list_sales - {PREVIOUS.format('list_sales')}) / nullif({PREVIOUS.format('list_sales')}, 0)", 6)
expression("expr_growth_operands", Node("growth", L("list_sales"), L("catalog_cost")), "(list_sales - catalog_cost) / nullif(catalog_cost, 0)", 6)
expression("expr_min_pair", Node("min", L("discounts"), L("taxes")), "least(discounts, taxes)")
expression("expr_max_pair", Node("max", L("discounts"), L("taxes")), "greatest(discounts, taxes)")
expression("expr_nary_sum", fold("sum", [L("discounts"), L("taxes"), L("returned_sales"), L("catalog_cost")], balanced=True), "(discounts + taxes) + (returned_sales + catalog_cost)")
expression("expr_nested_depth3", Node("ratio", Node("diff", Node("sum", L("list_sales"), L("taxes")), L("discounts")), L("units_sold")), "(list_sales + taxes - discounts) / nullif(units_sold, 0)")
expression("gross_margin_by_entity_year", Derived("gross_margin"), SALES_SQL["gross_margin"], 6)
expression("expr_avg_window", Over("avg", Derived("net_sales"), 2), "avg(list_sales - discounts) over (partition by entity order by period rows between 2 preceding and current row)", 4)
expression("expr_of_window", Node("diff", L("list_sales"), Over("min", L("list_sales"))), "list_sales - min(list_sales) over (partition by entity order by period rows unbounded preceding)", 2)


@query(f"with {SHEET} select entity, period, " + ", ".join(f"round({sql}, 4) as {n}" for n, sql in SALES_SQL.items()) + " from sheet")
def derived_registry_all(spark, d):
    derived = Compiler().derive(sheet_of(spark, d))
    return derived.select("entity", "period", *(F.round(n, 4).alias(n) for n in SALES))


@query(f"with {SHEET}, w as (select entity, period, " + ", ".join(f"round({sql}, 4) as {n}" for n, sql in SALES_SQL.items()) + f" from sheet) select entity, period, name, value from w unpivot (value for name in ({', '.join(SALES_SQL)}))")
def derived_long(spark, d):
    return derived_registry_all(spark, d).unpivot(["entity", "period"], list(SALES), "name", "value")


@query(f"""with {SHEET} select entity, period, period % 3 as kind, round(case period % 3 when 0 then list_sales - discounts when 1 then (returned_sales + taxes) / nullif(list_sales, 0)
    else (list_sales - catalog_cost) / nullif(catalog_cost, 0) end, 6) as answer from sheet""")
def expr_rpn_batch(spark, d):
    """A different program for each row, evaluated in one pass."""
    push = lambda c: F.struct(F.lit("push").alias("op"), F.col(c).cast("double").alias("v"))
    op = lambda o: F.struct(F.lit(o).alias("op"), F.lit(None).cast("double").alias("v"))
    kind = F.col("period") % 3
    code = (
        F.when(kind == 0, F.array(push("list_sales"), push("discounts"), op("diff")))
        .when(kind == 1, F.array(push("returned_sales"), push("taxes"), op("sum"), push("list_sales"), op("ratio")))
        .otherwise(F.array(push("list_sales"), push("catalog_cost"), op("growth")))
    )
    return sheet_of(spark, d).select("entity", "period", kind.alias("kind"), F.round(run_programs(code.cast(PROGRAM)), 6).alias("answer"))


# ---- typed operators and aggregates ----------------------------------------------------------------------------

TYPED_SQL = {
    "add": "round(a + b, 2)", "subtract": "round(a - b, 2)", "multiply": "round(a * b, 2)", "divide": "round(a / nullif(b, 0), 4)", "ratio": "round(a / nullif(b, 0), 4)",
    "greater_than": "a > b", "less_than": "a < b", "greater_equal": "a >= b", "less_equal": "a <= b", "equals": "a = b", "not_equals": "a <> b",
}
for _op, _sql in TYPED_SQL.items():

    def _typed(spark, d, op=_op):
        return sheet_of(spark, d).select("entity", "period", typed.typed(op, F.col("discounts"), F.col("taxes")).alias("answer"))

    query(f"with {SHEET}, v as (select entity, period, discounts as a, taxes as b from sheet) select entity, period, {_sql} as answer from v", f"typed_{_op}")(_typed)
for _op, _sql in {"change": "round(b - a, 2)", "pct_change": "round((b - a) / nullif(abs(a), 0) * 100, 2)"}.items():

    def _change(spark, d, op=_op):
        then = F.lag("list_sales").over(windows.series())
        return sheet_of(spark, d).select("entity", "period", typed.typed(op, then, F.col("list_sales")).alias("answer")).where("answer is not null")

    query(f"with {SHEET}, v as (select entity, period, {PREVIOUS.format('list_sales')} as a, list_sales as b from sheet), w as (select entity, period, {_sql} as answer from v) select * from w where answer is not null", f"typed_{_op}")(_change)
for _op, _sql in {"sum": "round(sum(list_sales), 2)", "avg": "round(avg(list_sales), 2)", "max": "max(list_sales)", "min": "min(list_sales)", "count": "count(list_sales)"}.items():

    def _agg(spark, d, op=_op):
        return sheet_of(spark, d).groupBy("period").agg(typed.over_entities(f"{op}_agg", F.col("list_sales")).alias("answer"))

    query(f"with {SHEET} select period, {_sql} as answer from sheet group by period", f"agg_{_op}")(_agg)


@query(f"with {SHEET}, v as (select entity, period, round(list_sales - discounts, 2) as x, catalog_cost from sheet) select entity, period, x > catalog_cost as is_greater, round(x / nullif(catalog_cost, 0), 4) as quotient from v")
def typed_depth2(spark, d):
    inner = typed.typed("subtract", F.col("list_sales"), F.col("discounts"))
    return sheet_of(spark, d).select("entity", "period", typed.typed("greater_than", inner, F.col("catalog_cost")).alias("is_greater"), typed.typed("divide", inner, F.col("catalog_cost")).alias("quotient"))


#: Columns of a wide sheet: a metric a year that orders have, a mark a priority, a flag a market segment; as many as there are different ones.
COLUMN_SQL = """cols as (
        select m || '_' || y as name, 'numeric' as type, case m when 'units' then 'units' else 'USD' end as unit, m as base_name, cast(y as integer) as year from (select distinct year(o_orderdate) as y from orders), (values ('sales'), ('costs'), ('units')) v(m)
        union all select 'rating_' || left(o_orderpriority, 1), 'ordinal', null, 'rating', null from (select distinct o_orderpriority from orders)
        union all select 'is_' || lower(c_mktsegment), 'categorical', null, 'segment', null from (select distinct c_mktsegment from customer)),
    ops as (select * from (values """ + ", ".join(f"('{o}', '{c}')" for o, (c, _) in typed.OPERATIONS.items()) + ") v(op, c))"
PAIR_SQL = """pairs as (select op, a.name as "left", b.name as "right", case when op in ('add', 'subtract', 'change') then a.unit when op = 'ratio' then 'ratio' when op = 'pct_change' then 'percentage'
        when op in ('greater_than', 'less_than', 'greater_equal', 'less_equal', 'equals', 'not_equals') then 'boolean' else 'derived' end as unit
    from cols a join cols b on a.name <> b.name join ops on case c when 'same_type' then a.type = b.type
        when 'same_unit' then a.type = 'numeric' and b.type = 'numeric' and a.unit is not distinct from b.unit when 'any_numeric' then a.type = 'numeric' and b.type = 'numeric'
        when 'same_base_or_unit' then a.type = 'numeric' and b.type = 'numeric' and (a.base_name = b.base_name or a.unit is not distinct from b.unit)
        when 'same_base_different_year' then a.type = 'numeric' and b.type = 'numeric' and a.base_name = b.base_name and a.year is distinct from b.year else false end)"""


def schema_columns(spark, d) -> DataFrame:
    """(name, type, unit, base_name, year) of the wide sheet's columns."""
    row = lambda name, kind, unit, base, year: [name.alias("name"), F.lit(kind).alias("type"), unit.cast("string").alias("unit"), base.alias("base_name"), year.cast("int").alias("year")]
    none = F.lit(None)
    years = star.table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    metrics = years.select("y", F.explode(F.array(*map(F.lit, ["sales", "costs", "units"]))).alias("m"))
    numeric = metrics.select(*row(F.concat_ws("_", "m", F.col("y").cast("string")), "numeric", F.when(F.col("m") == "units", "units").otherwise("USD"), F.col("m"), F.col("y")))
    marks = star.table(spark, d, "orders").select("o_orderpriority").distinct()
    ordinal = marks.select(*row(F.concat(F.lit("rating_"), F.substring("o_orderpriority", 1, 1)), "ordinal", none, F.lit("rating"), none))
    segments = star.table(spark, d, "customer").select("c_mktsegment").distinct()
    return numeric.union(ordinal).union(segments.select(*row(F.concat(F.lit("is_"), F.lower("c_mktsegment")), "categorical", none, F.lit("segment"), none)))


@query(f'with {COLUMN_SQL}, {PAIR_SQL} select op, "left", "right", unit from pairs')
def valid_pairs(spark, d):
    columns = schema_columns(spark, d)
    operations = spark.createDataFrame([(o, c) for o, (c, _) in typed.OPERATIONS.items()], "op string, constraint string")
    return typed.valid_pairs(columns, operations)


@query(f"""with {COLUMN_SQL}, {PAIR_SQL}, inner_ as (select op || '(' || "left" || ', ' || "right" || ')' as e, unit from pairs where op in ('add', 'subtract')),
    made as (select o.op || '(' || e || ', ' || name || ')' as expression from inner_ join cols on type = 'numeric' and inner_.unit = cols.unit, (values ('divide'), ('subtract')) o(op)),
    ranked as (select expression, row_number() over (order by {rank_sql(5, 'expression')}, expression) as r from made)
    select expression from ranked where r <= 500""")
def depth2_enumeration(spark, d):
    """Compositions of depth two over a schema table; a random but reproducible 500 of them, as the enumeration asks."""
    columns = schema_columns(spark, d)
    pairs = valid_pairs(spark, d).where("op in ('add', 'subtract')").select(F.concat("op", F.lit("("), "left", F.lit(", "), "right", F.lit(")")).alias("e"), F.col("unit").alias("u"))
    made = pairs.join(columns.where("type = 'numeric'"), F.col("u") == F.col("unit")).select("e", "name", F.explode(F.array(F.lit("divide"), F.lit("subtract"))).alias("op"))
    made = made.select(F.concat("op", F.lit("("), "e", F.lit(", "), "name", F.lit(")")).alias("expression"))
    return made.orderBy(rank_key(5, F.col("expression")), "expression").limit(500)


# ---- windows ---------------------------------------------------------------------------------------------------

WINDOW_SQL = "from sheet window w as (partition by entity order by period rows between {0} and current row)"
for _name, _back, _frame in (("win_stats_all", None, "unbounded preceding"), ("win_stats_3", 2, "2 preceding")):

    def _stats(spark, d, back=_back):
        return windows.window_stats(sheet_of(spark, d), "list_sales", back)

    query(f"with {SHEET}, v as (select entity, period, min(list_sales) over w as low, max(list_sales) over w as high, round(avg(list_sales) over w, 4) as mean, count(list_sales) over w as n {WINDOW_SQL.format(_frame)}) select * from v where n >= 2", _name)(_stats)


@query(f"""with {SHEET} select a.entity, a.period as from_period, b.period as to_period, min(c.list_sales) as low, max(c.list_sales) as high, round(avg(c.list_sales), 4) as mean
    from sheet a join sheet b on a.entity = b.entity and a.period < b.period join sheet c on c.entity = a.entity and c.period between a.period and b.period group by 1, 2, 3""")
def win_all_contiguous(spark, d):
    return windows.all_windows(sheet_of(spark, d), "list_sales")


@query(f"with {SHEET}, v as (select a.entity, a.period as from_period, b.period as to_period, round((b.list_sales - a.list_sales) / nullif(a.list_sales, 0), 6) as growth from sheet a join sheet b on a.entity = b.entity and a.period < b.period) select * from v where growth is not null")
def growth_all_pairs(spark, d):
    return windows.all_growth_pairs(sheet_of(spark, d), "list_sales")


@query(f"with {SHEET}, v as (select entity, period, list_sales as x, {PREVIOUS.format('list_sales')} as y from sheet) select entity, period, round(x - y, 2) as delta, round((x - y) / nullif(abs(y), 0) * 100, 4) as pct from v where y is not null")
def yoy_delta(spark, d):
    return windows.yoy(sheet_of(spark, d), "list_sales")


@query(f"with {QUARTERS} select entity, year, quarter, round(sum(order_total) over (partition by entity, year order by quarter rows unbounded preceding), 2) as ytd from quarters")
def ytd_cumulative(spark, d):
    frame = Window.partitionBy("entity", "year").orderBy("quarter").rowsBetween(Window.unboundedPreceding, 0)
    return star.quarterly_sheet(spark, d).select("entity", "year", "quarter", F.round(F.sum("order_total").over(frame), 2).alias("ytd"))


@query(f"with {QUARTERS} select a.entity, a.period, a.order_total, b.order_total as prior_total from quarters a left join quarters b on a.entity = b.entity and a.quarter = b.quarter and a.year = b.year + 1")
def prior_year_quarter(spark, d):
    """The same quarter one year earlier: an outer join, since a quarter may be missing."""
    now = star.quarterly_sheet(spark, d)
    then = now.select("entity", (F.col("year") + 1).alias("year"), "quarter", F.col("order_total").alias("prior_total"))
    return now.join(then, ["entity", "year", "quarter"], "left").select("entity", "period", "order_total", "prior_total")


@query(f"with {QUARTERS}, v as (select entity, period, min(order_total) over w as low, max(order_total) over w as high, count(*) over w as n from quarters window w as (partition by entity, quarter order by year rows between 3 preceding and current row)) select * from v where n >= 2")
def quarter_group_window(spark, d):
    """Windows of at most four periods of one group: the same quarter of consecutive years."""
    frame = Window.partitionBy("entity", "quarter").orderBy("year").rowsBetween(-3, 0)
    out = star.quarterly_sheet(spark, d).select("entity", "period", F.min("order_total").over(frame).alias("low"), F.max("order_total").over(frame).alias("high"), F.count(F.lit(1)).over(frame).alias("n"))
    return out.where("n >= 2")


@query(f"""with {QUARTERS}, v as (select distinct year, quarter, case quarter when 1 then 'Three Months Ended March 31, ' when 2 then 'Six Months Ended June 30, ' when 3 then 'Nine Months Ended September 30, ' else 'December 31, ' end || year as label,
        make_date(cast(year as bigint), case quarter when 1 then 3 when 2 then 6 when 3 then 9 else 12 end, case when quarter in (2, 3) then 30 else 31 end) as ends from quarters)
    select label, case quarter when 1 then 'three' when 2 then 'six' when 3 then 'nine' else 'instant' end as kind, ends, case quarter when 1 then 'three_3' when 2 then 'six_6' when 3 then 'nine_9' else 'instant_12' end as grp from v""")
def period_labels(spark, d):
    """Kind, date and group of quarterly labels."""
    names = F.array(*map(F.lit, ["Three Months Ended March 31, ", "Six Months Ended June 30, ", "Nine Months Ended September 30, ", "December 31, "]))
    rows = star.quarterly_sheet(spark, d).select("year", "quarter").distinct().select(F.concat(F.element_at(names, F.col("quarter")), F.col("year").cast("string")).alias("label"))
    label = F.col("label")
    return rows.select("label", windows.period_kind(label).alias("kind"), windows.period_date(label).alias("ends"), windows.period_group(label).alias("grp"))


@query(f"with {SHEET}, v as (select entity, period, list_sales, 1 + (period - 1990) / 100.0 as f from sheet) select entity, period, round(first_value(list_sales) over w * product(f) over w, 2) as path from v window w as (partition by entity order by period rows unbounded preceding)")
def running_product(spark, d):
    """A chain of growth factors: a running product, kept row by row."""
    order = windows.series().rowsBetween(Window.unboundedPreceding, 0)
    product = F.product((1 + (F.col("period") - 1990) / 100.0).cast("double")).over(order)
    return sheet_of(spark, d).select("entity", "period", F.round(F.first("list_sales").over(order) * product, 2).alias("path"))


# ---- concepts, ratios, checks ----------------------------------------------------------------------------------

@query(f"with {ATOMS}, w as (select *, value - case when concept = 'discounts' then 500000 else 0 end as v from atoms) select concept, min(v) < 0 as is_negative from w group by concept")
def negative_concepts(spark, d):
    value = F.col("value") - F.when(F.col("concept") == "discounts", 500000).otherwise(0)
    return star.atoms(sheet_of(spark, d)).groupBy("concept").agg((F.min(value) < 0).alias("is_negative"))


@query(f"with {ATOMS}, bad as (select concept from atoms group by concept having min(value - case when concept = 'discounts' then 500000 else 0 end) < 0) select distinct concept from atoms where semantic_type = 'amount' and concept <> 'taxes' and concept not in (select concept from bad)")
def eligible_concepts(spark, d):
    facts = star.atoms(sheet_of(spark, d))
    value = F.col("value") - F.when(F.col("concept") == "discounts", 500000).otherwise(0)
    bad = facts.groupBy("concept").agg(F.min(value).alias("low")).where("low < 0")
    return facts.where("semantic_type = 'amount' and concept <> 'taxes'").select("concept").distinct().join(bad, "concept", "left_anti")


#: The star sheet's stand-ins for statement lines.
STATEMENT = {
    "total_current_assets": "list_sales", "inventories": "catalog_cost", "total_current_liabilities": "discounts", "total_liabilities": "catalog_cost", "total_stockholders_equity": "returned_sales", "total_assets": "list_sales",
    "operating_income": "taxes", "interest_expense": "discounts", "gross_profit": "returned_sales", "total_revenue": "list_sales", "net_income": "taxes", "income_tax_expense": "taxes", "income_before_tax": "catalog_cost",
    "cash_from_operations": "list_sales", "capital_expenditures": "catalog_cost", "research_and_development": "discounts",
}


def statement(name: str) -> Column:
    return F.col(STATEMENT[name]).cast("double")


def _quotient(a: str, b: str) -> str:
    return f"round({a} / nullif({b}, 0), 4)"


RATIO_SQL = {
    "current_ratio": _quotient("list_sales", "discounts"), "quick_ratio": _quotient("(list_sales - catalog_cost)", "discounts"), "working_capital": "list_sales - discounts", "debt_to_equity": _quotient("catalog_cost", "returned_sales"),
    "debt_to_assets": _quotient("catalog_cost", "list_sales"), "interest_coverage": _quotient("taxes", "discounts"), "gross_margin": _quotient("returned_sales", "list_sales"), "operating_margin": _quotient("taxes", "list_sales"),
    "net_profit_margin": _quotient("taxes", "list_sales"), "return_on_assets": _quotient("taxes", f"((list_sales + {PREVIOUS.format('list_sales')}) / 2)"), "return_on_equity": _quotient("taxes", f"((returned_sales + {PREVIOUS.format('returned_sales')}) / 2)"),
    "effective_tax_rate": _quotient("taxes", "catalog_cost"), "free_cash_flow": "list_sales - catalog_cost", "rd_to_revenue": _quotient("discounts", "list_sales"), "capex_to_revenue": _quotient("catalog_cost", "list_sales"),
}


@query(f"with {SHEET} select entity, period, " + ", ".join(f"round({sql}, 4) as {n}" for n, sql in RATIO_SQL.items()) + " from sheet")
def ratio_catalog(spark, d):
    return sheet_of(spark, d).select("entity", "period", *(F.round(f(statement), 4).alias(n) for n, f in catalog.RATIOS.items()))


@query(f"with {SHEET}, v as (select entity, period, {RATIO_SQL['gross_margin']} as m, {RATIO_SQL['debt_to_equity']} as e from sheet), w as (select entity, period, round(m - {PREVIOUS.format('m')}, 4) as change, m > {PREVIOUS.format('m')} as margin_improved, e < {PREVIOUS.format('e')} as leverage_improved from v) select * from w where change is not null")
def ratio_change(spark, d):
    rows = sheet_of(spark, d).select("entity", "period", catalog.RATIOS["gross_margin"](statement).alias("m"), catalog.RATIOS["debt_to_equity"](statement).alias("e"))
    out = rows.select("entity", "period", catalog.change(F.col("m")).alias("change"), catalog.improved(F.col("m")).alias("margin_improved"), catalog.improved(F.col("e"), True).alias("leverage_improved"))
    return out.where("change is not null")


@query(f"with {SHEET} select entity, period, round(taxes / list_sales, 4) as margin, round(list_sales / catalog_cost, 4) as turnover, round(catalog_cost / nullif(returned_sales, 0), 4) as leverage, round(taxes / list_sales * (list_sales / catalog_cost) * (catalog_cost / nullif(returned_sales, 0)), 4) as roe from sheet")
def dupont(spark, d):
    parts = catalog.dupont(F.col("taxes"), F.col("list_sales"), F.col("catalog_cost"), F.col("returned_sales"))
    return sheet_of(spark, d).select("entity", "period", *(v.alias(k) for k, v in parts.items()))


@query(f"with {SHEET} select entity, period, round(" + " + ".join(f"taxes * pow(1.03, {k}) / pow(1.08, {k})" for k in range(1, 6)) + ", 2) as present_value from sheet")
def dcf(spark, d):
    return sheet_of(spark, d).select("entity", "period", catalog.discounted(F.col("taxes"), 0.03, 0.08).alias("present_value"))


@query(f"with {SHEET} select entity, period, round(abs(list_sales - discounts + taxes - (list_sales + taxes - discounts)), 2) as residual, abs(list_sales - discounts - catalog_cost) <= 1 as balanced from sheet")
def balance_check(spark, d):
    c = Compiler()
    residual = c.column(Derived("billed")) - (F.col("list_sales") + F.col("taxes") - F.col("discounts"))
    return sheet_of(spark, d).select("entity", "period", F.round(F.abs(residual), 2).alias("residual"), (F.abs(c.column(Node("diff", Derived("net_sales"), L("catalog_cost")))) <= 1).alias("balanced"))


@query(f"with {QUARTERS}, v as (select entity, year, order_total, sum(order_total) over (partition by entity, year) as total, quarter from quarters) select entity, year, round(abs(max(total) - sum(order_total)), 2) as residual, abs(max(total) - sum(order_total)) <= 1 as reconciled from v group by 1, 2")
def cash_reconcile(spark, d):
    rows = star.quarterly_sheet(spark, d)
    total = F.sum("order_total").over(Window.partitionBy("entity", "year"))
    residual = F.max("total") - F.sum("order_total")
    return rows.withColumn("total", total).groupBy("entity", "year").agg(F.round(F.abs(residual), 2).alias("residual"), (F.abs(residual) <= 1).alias("reconciled"))


# ---- units, corruption, rewordings -----------------------------------------------------------------------------

@query(f"with {ATOMS} select key, case when unit = 'USD' then value / 1000.0 else value end as value from atoms")
def unit_scale(spark, d):
    return star.atoms(sheet_of(spark, d)).select("key", obstacles.to_display(F.col("value"), F.col("unit"), 1000.0).alias("value"))


@query(f"with {ATOMS} select key, round(case when semantic_type = 'amount' then value / 1000.0 * 1000.0 else value end, 6) as value from atoms")
def unit_restore(spark, d):
    shown = star.atoms(sheet_of(spark, d)).withColumn("shown", obstacles.to_display(F.col("value"), F.col("unit"), 1000.0))
    return shown.select("key", F.round(obstacles.from_display(F.col("shown"), F.col("semantic_type"), 1000.0), 6).alias("value"))


@query(f"with {SHEET} select entity, period, case when units_sold = floor(units_sold) then cast(cast(units_sold as bigint) as varchar) else cast(cast(units_sold as decimal(20,2)) as varchar) end as units, case when list_sales = floor(list_sales) then cast(cast(list_sales as bigint) as varchar) else cast(cast(list_sales as decimal(20,2)) as varchar) end as sales from sheet")
def plain_numbers(spark, d):
    return sheet_of(spark, d).select("entity", "period", obstacles.plain_number(F.col("units_sold")).alias("units"), obstacles.plain_number(F.col("list_sales")).alias("sales"))


@query(f"with {ATOMS} select key, variant, round(case when semantic_type = 'amount' then value * factor else value end, 2) as value from atoms, (values ('baseline', 1.0::double), ('big_numbers', 100.0), ('multi_factor', 1000000.0)) v(variant, factor)")
def variants_cross(spark, d):
    return obstacles.variants(star.atoms(sheet_of(spark, d)), {"baseline": 1.0, "big_numbers": 100.0, "multi_factor": 1e6})


USED_SQL = f"used as (select distinct key from atoms where concept = 'taxes' and {draw_sql(77, 'key')} < 0.5)"


def used_keys(facts: DataFrame) -> DataFrame:
    """Keys that questions use: half of the facts of one concept, by a draw."""
    return facts.where((F.col("concept") == "taxes") & (uniform(77, F.col("key")) < 0.5)).select("key").distinct()


TEXT_SQL = "cast(cast(value as decimal(20,2)) as varchar)"
RING_SQL = f"ring as (select key, case when count(*) over w2 > 1 then coalesce(lead(value) over w, first_value(value) over w2) end as donor from atoms window w as (partition by concept order by {rank_sql(13, 'key')}, key), w2 as (partition by concept order by {rank_sql(13, 'key')}, key rows between unbounded preceding and unbounded following))"


def LOOKS_SQL(cells: str, seeds: list[int], other: str = "olZSbBg", negative: str = "false") -> str:
    """SQL of ``looks`` (key, text): up to two look-alike characters in the integer part of (key, t), as two draws pick them."""
    d = [draw_sql(x, "key") for x in seeds]
    swap = lambda draw: f"translate(substr(s, i, 1), '0125689', case when {draw} < 0.5 then 'OIZSbBg' else '{other}' end)"
    return f"""l1 as (select *, split_part(t, '.', 1) as s from ({cells})),
        l2 as (select *, list_filter(range(1, length(s) + 1), lambda i: contains('0125689', substr(s, i, 1))) as places from l1),
        l3 as (select *, places[1 + cast(floor({d[0]} * len(places)) as integer)] as one from l2),
        l4 as (select *, list_filter(places, lambda i: i <> one) as rest from l3),
        l5 as (select *, rest[1 + cast(floor({d[1]} * len(rest)) as integer)] as two from l4),
        looks as (select key, case when len(places) = 0 then t else case when {negative} then '-' else '' end || list_aggregate(list_transform(range(1, length(s) + 1),
            lambda i: case when i = one then {swap(d[2])} when i = two then {swap(d[3])} else substr(s, i, 1) end), 'string_agg', '') end as text from l5)"""


CELL_SQL = {
    "missing": "''", "garbage": f"(['-9999999', '999999999999', '-1', 'ERROR'])[1 + cast(floor({draw_sql(14, 'key')} * 4) as integer)]",
    "lookalike": "text", "cross": f"coalesce({TEXT_SQL.replace('value', 'donor')}, '')",
}
ROLL_SQL = f"case when {draw_sql(12, 'key')} < 0.25 then 'missing' when {draw_sql(12, 'key')} < 0.5 then 'garbage' when {draw_sql(12, 'key')} < 0.75 then 'lookalike' else 'cross' end"


def corruption_sql(mode: str) -> str:
    kind = ROLL_SQL if mode == "combined" else f"'{mode}'"
    looks = LOOKS_SQL(f"select key, {TEXT_SQL} as t from atoms", [15, 16, 17, 18])
    return f"""with {ATOMS}, {USED_SQL}, {RING_SQL}, {looks}, k as (select atoms.*, donor, text, case when key in (select key from used) then 'protected' when {draw_sql(11, 'key')} < 0.3 then {kind} else 'untouched' end as corruption from atoms join ring using (key) join looks using (key))
        select key, concept, entity, period, case corruption when 'missing' then {CELL_SQL['missing']} when 'garbage' then {CELL_SQL['garbage']} when 'lookalike' then {CELL_SQL['lookalike']} when 'cross' then {CELL_SQL['cross']} else {TEXT_SQL} end as cell, corruption from k"""


for _mode in (*corrupt.MODES, "combined"):

    def _corrupt(spark, d, mode=_mode):
        facts = star.atoms(sheet_of(spark, d))
        return corrupt.corrupt(facts, mode, 0.3, 11, used_keys(facts))

    query(corruption_sql(_mode), f"corrupt_{_mode}")(_corrupt)


@query(f"select corruption, count(*) as n from ({corruption_sql('combined')}) group by 1")
def corrupt_stats(spark, d):
    return corrupt.corruption_stats(QUERIES["corrupt_combined"](spark, d))


@query(f"""with {ATOMS}, own as (select concept, entity, arg_min(value, period) as value from atoms group by 1, 2),
    ring as (select concept, entity, case when count(*) over w2 > 1 then coalesce(lead(value) over w, first_value(value) over w2) end as donor from own window w as (partition by concept order by {rank_sql(13, 'entity')}, entity), w2 as (partition by concept order by {rank_sql(13, 'entity')}, entity rows between unbounded preceding and unbounded following))
    select key, donor from atoms join ring using (concept, entity)""")
def donors_of_other_entities(spark, d):
    return corrupt.donors(star.atoms(sheet_of(spark, d)), 13, other_entity=True)


def _array(items: list[str]) -> str:
    return "([" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "])"


def _pick(items: list[str], draw: str) -> str:
    return f"{_array(items)}[1 + cast(floor({draw} * {len(items)}) as integer)]"


ASK_SQL = "'What is the list sales for ' || entity || ' in ' || period || '?'"
LOWER_SQL = "lower(substr({0}, 1, 1)) || substr({0}, 2)"


def asked(spark, d) -> DataFrame:
    question = F.concat(F.lit("What is the list sales for "), F.col("entity"), F.lit(" in "), F.col("period").cast("string"), F.lit("?"))
    return sheet_of(spark, d).withColumn("question", question)


@query(f"with {SHEET}, q as (select *, {ASK_SQL} as question from sheet) select entity, period, case when {draw_sql(31, 'question')} < 0.5 then {_pick(obstacles.PREFIXES, draw_sql(32, 'question'))} || {LOWER_SQL.format('question')} else question || {_pick(obstacles.SUFFIXES, draw_sql(32, 'question'))} end as question from q")
def q_negation(spark, d):
    text = F.col("question")
    return asked(spark, d).select("entity", "period", obstacles.negated(text, uniform(31, text), uniform(32, text)).alias("question"))


@query(f"with {SHEET}, q as (select *, {ASK_SQL} as question from sheet) select entity, period, 'If catalog cost for ' || entity || ' in ' || period || ' exceeds ' || format('{{:,}}', cast(floor(catalog_cost * ({draw_sql(33, 'question')} * 0.4 + 0.3)) as bigint)) || ', ' || {LOWER_SQL.format('question')} as question from q")
def q_conditional(spark, d):
    text = F.col("question")
    return asked(spark, d).select("entity", "period", obstacles.conditional(text, F.col("entity"), F.col("period"), "catalog_cost", F.col("catalog_cost"), uniform(33, text)).alias("question"))


@query(f"with {SHEET}, q as (select *, {ASK_SQL} as question from sheet), c as (select *, {_pick(obstacles.CLAUSES['sales'], draw_sql(34, 'question'))} as clause from q) select entity, period, case when {draw_sql(35, 'question')} < 0.5 then clause || ' ' || question else question || ' ' || clause end as question from c")
def q_useless_info(spark, d):
    text = F.col("question")
    return asked(spark, d).select("entity", "period", obstacles.with_clause(text, uniform(34, text), uniform(35, text)).alias("question"))


@query(f"with {SHEET}, q as (select *, {ASK_SQL} as question from sheet) select entity, period, 'All amounts are given in ' || {_pick(list(obstacles.UNITS), draw_sql(36, 'question'))} || '. ' || question as question from q")
def q_unit_prefix(spark, d):
    from .functions.prng import pick

    return asked(spark, d).select("entity", "period", obstacles.unit_prefix(F.col("question"), pick(list(obstacles.UNITS), uniform(36, F.col("question")))).alias("question"))


SCORED = ["list_sales", "discounts", "tax_rate", "avg_price"]
SCORE_SQL = """case when contains(low, replace(concept, '_', ' ')) then 100 + length(concept) when hits = len(ws) then 50 + hits else hits end"""


@query(f"""with {SHEET}, q as (select entity, period, lower('What is the ' || case period % 3 when 0 then 'list sales' when 1 then 'average price and tax rate' else 'rate of sales' end || ' for ' || entity || ' in ' || period || '?') as low from sheet),
    w as (select entity, period, low, concept, string_split(concept, '_') as ws from q, (select unnest([{', '.join(f"'{c}'" for c in SCORED)}]) as concept)), h as (select *, len(list_filter(ws, lambda x: contains(low, x))) as hits from w)
    select entity, period, concept, cast({SCORE_SQL} as integer) as score from h""")
def concept_scores(spark, d):
    """How well the names of a question's concepts fit it."""
    asked_for = F.when(F.col("period") % 3 == 0, "list sales").when(F.col("period") % 3 == 1, "average price and tax rate").otherwise("rate of sales")
    question = F.concat(F.lit("What is the "), asked_for, F.lit(" for "), "entity", F.lit(" in "), F.col("period").cast("string"), F.lit("?"))
    rows = sheet_of(spark, d).select("entity", "period", question.alias("question"), F.explode(F.array(*map(F.lit, SCORED))).alias("concept"))
    return rows.select("entity", "period", "concept", obstacles.concept_score(F.col("question"), F.col("concept")).alias("score"))


# ---- rendering -------------------------------------------------------------------------------------------------

PHRASE_SQL = "'ratio of gross profit to list sales for ' || entity || ' in ' || period"


@query(f"""with {SHEET}, p as (select entity, period, {PHRASE_SQL} as phrase from sheet), t as (select *, replace({_pick([*render.QUESTIONS, *render.REQUESTS], draw_sql(41, 'phrase'))}, '{{phrase}}', phrase) as said,
        case when {draw_sql(41, 'phrase')} * 22 < 13 then '?' else '.' end as mark from p), m as (select *, said || case when {draw_sql(42, 'phrase')} < 1.0 / 3 then '' when {draw_sql(42, 'phrase')} < 2.0 / 3 then ' ' || mark else mark end as text from t)
    select entity, period, case when {draw_sql(43, 'phrase')} < 0.5 then upper(substr(text, 1, 1)) else lower(substr(text, 1, 1)) end || substr(text, 2) as question from m""")
def render_question(spark, d):
    tree = Node("ratio", Derived("gross_profit"), L("list_sales"))
    rows = sheet_of(spark, d).withColumn("phrase", render.phrase(tree, F.col("entity"), F.col("period")))
    text = F.col("phrase")
    return rows.select("entity", "period", render.render(text, uniform(41, text), uniform(42, text), uniform(43, text)).alias("question"))


@query(f"with {SHEET}, v as (select entity, period, 'boolean' as kind, case when taxes > discounts then 1.0::double else 0 end as v from sheet union all select entity, period, 'percentage', tax_rate * 100 from sheet union all select entity, period, 'count', units_sold from sheet union all select entity, period, 'ratio', taxes / list_sales from sheet union all select entity, period, 'amount', list_sales from sheet) select entity, period, kind, case kind when 'boolean' then case when v <> 0 then 'Yes' else 'No' end when 'percentage' then cast(cast(v as decimal(20,2)) as varchar) || '%' when 'count' then cast(cast(v as bigint) as varchar) when 'ratio' then cast(cast(v as decimal(20,4)) as varchar) else case when abs(v) >= 1000 then format('{{:,.0f}}', v) else format('{{:,.2f}}', v) end end as text from v")
def format_answer(spark, d):
    values = {"boolean": F.when(F.col("taxes") > F.col("discounts"), 1.0).otherwise(0.0), "percentage": F.col("tax_rate") * 100, "count": F.col("units_sold"), "ratio": F.col("taxes") / F.col("list_sales"), "amount": F.col("list_sales")}
    listed = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in values.items()))).alias("x")
    return sheet_of(spark, d).select("entity", "period", listed).select("entity", "period", F.col("x.kind").alias("kind"), render.format_answer(F.col("x.v"), F.col("x.kind")).alias("text"))


@query("select s_nationkey as k, case when count(*) = 1 then min(s_name) when count(*) = 2 then string_agg(s_name, ' and ' order by s_name) else string_agg(s_name, ', ' order by s_name)[: length(string_agg(s_name, ', ' order by s_name)) - length(max(s_name)) - 2] || ', and ' || max(s_name) end as names from supplier group by 1")
def oxford_lists(spark, d):
    names = star.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sort_array(F.collect_list("s_name")).alias("names"))  # the query's own result
    return names.select("k", render.oxford_column(F.col("names")).alias("names"))


# ---- answers and scores ----------------------------------------------------------------------------------------

#: Responses made of the sheet: right, wrong, off by a little, without an answer line, and with several.
RESPONSE_SQL = f"""{SHEET}, truth as (select entity, period, list_sales as truth, cast(cast(list_sales as decimal(20,2)) as varchar) as t from sheet),
    responses as (select entity, period, truth, m as model, case (period + m) % 6 when 0 then 'Answer: ' || t || '.' when 1 then 'so 12 and ' || t when 2 then 'x' || chr(10) || 'answer : 1,234.5;' when 3 then 'Answer: ' || cast(cast(truth * 1.05 as decimal(20,2)) as varchar) || chr(10) || 'Answer: 7'
        when 4 then 'no number' else '<|channel|>a<|message|>t<|end|><|channel|>b<|message|>Answer: ' || t || '<|end|>' end as response from truth, (values (1), (2)) v(m))"""


def responses(spark, d) -> DataFrame:
    rows = sheet_of(spark, d).select("entity", "period", F.col("list_sales").alias("truth"), corrupt.cell_text(F.col("list_sales")).alias("t"), F.explode(F.array(F.lit(1), F.lit(2))).alias("model"))
    near = corrupt.cell_text(F.col("truth") * 1.05)
    kind = (F.col("period") + F.col("model")) % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("Answer: "), "t", F.lit("."))).when(kind == 1, F.concat(F.lit("so 12 and "), "t")).when(kind == 2, "x\nanswer : 1,234.5;")
        .when(kind == 3, F.concat(F.lit("Answer: "), near, F.lit("\nAnswer: 7"))).when(kind == 4, "no number")
        .otherwise(F.concat(F.lit("<|channel|>a<|message|>t<|end|><|channel|>b<|message|>Answer: "), "t", F.lit("<|end|>")))
    )
    return rows.select("entity", "period", "truth", "model", text.alias("response"))


NUM = "(-?[0-9]+(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
LINE = "(?i)Answer\\s*:\\s*([^\\n]+)"


def _uncomma_sql(x: str) -> str:
    return f"regexp_replace({x}, '([0-9]),([0-9])', '\\1\\2', 'g')"


def _number_sql(x: str) -> str:
    return f"try_cast(nullif(regexp_extract({_uncomma_sql(x)}, '{NUM}', 1), '') as double)"


FIRST_SQL = f"coalesce({_number_sql(f"nullif(regexp_extract(response, '{LINE}', 1), '')")}, try_cast(regexp_extract_all({_uncomma_sql('response')}, '{NUM}', 1)[-1] as double))"
LAST_SQL = _number_sql(f"regexp_extract_all(response, '{LINE}', 1)[-1]")


@query(f"with {RESPONSE_SQL} select entity, period, model, {FIRST_SQL} as number from responses")
def parse_first_answer(spark, d):
    return responses(spark, d).select("entity", "period", "model", scoring.parse_first(F.col("response"))[0].alias("number"))


@query(f"with {RESPONSE_SQL} select entity, period, model, {LAST_SQL} as number from responses")
def parse_last_answer(spark, d):
    return responses(spark, d).select("entity", "period", "model", scoring.parse_last(F.col("response"))[0].alias("number"))


@query(f"with {RESPONSE_SQL} select entity, period, model, trim(regexp_replace(string_split(response, '<|message|>')[-1], '<\\|[^|]*\\|>', '', 'g')) as text from responses")
def strip_tokens(spark, d):
    return responses(spark, d).select("entity", "period", "model", scoring.strip_tokens(F.col("response")).alias("text"))


@query("select conv_id, turn, case when role = 'assistant' then trim(split_part(text, chr(10), 1)) else '' end as thinking, case when role = 'assistant' then trim(substr(text, length(split_part(text, chr(10), 1)) + 1), ' ') else trim(text, ' ') end as answer from conversations where text is not null")
def split_think(spark, d):
    """Assistant texts with their first line as a thinking block, then split again."""
    rows = star.table(spark, d, "conversations").where("text is not null")
    head = F.substring_index("text", "\n", 1)
    marked = F.when(F.col("role") == "assistant", F.concat(F.lit("<think>"), head, F.lit("</think>"), F.substr("text", F.char_length(head) + 1))).otherwise(F.col("text"))
    thinking, answer = scoring.split_thinking(marked)
    return rows.select("conv_id", "turn", thinking.alias("thinking"), answer.alias("answer"))


SCORED_SQL = f"{RESPONSE_SQL}, p as (select *, {FIRST_SQL} as predicted from responses), scored as (select *, coalesce(abs(predicted - truth) / nullif(abs(truth), 0) <= 0.1, false) as correct, period % 5 = 0 as skipped from p)"


def scored(spark, d) -> DataFrame:
    rows = responses(spark, d).withColumn("predicted", scoring.parse_first(F.col("response"))[0])
    return rows.withColumns({"correct": scoring.correct(F.col("predicted"), F.col("truth"), 0.1), "skipped": F.col("period") % 5 == 0})


@query(f"with {SCORED_SQL} select entity, period, model, correct, round(abs(predicted - truth) / nullif(abs(truth), 0), 6) as error, coalesce(abs(predicted - truth) / nullif(abs(truth), 0) <= 0.1, false) as within_tol from scored")
def score_tolerance(spark, d):
    error = scoring.relative_error(F.col("predicted"), F.col("truth"))
    return scored(spark, d).select("entity", "period", "model", "correct", F.round(error, 6).alias("error"), F.coalesce(error <= 0.1, F.lit(False)).alias("within_tol"))


COUNT_SQL = "count(case when not skipped then 1 end) as total, count(case when skipped then 1 end) as skipped, count(case when not skipped and correct then 1 end) as correct, round(count(case when not skipped and correct then 1 end) / nullif(count(case when not skipped then 1 end), 0), 6) as accuracy"
for _name, _by in (("accuracy_by_model", "model"), ("accuracy_by_period", "period"), ("accuracy_by_entity", "entity")):

    def _accuracy(spark, d, by=_by):
        return scoring.accuracy(scored(spark, d), by)

    query(f"with {SCORED_SQL} select {_by}, {COUNT_SQL} from scored group by 1", _name)(_accuracy)


@query(f"with {SCORED_SQL} select coalesce(cast(model as varchar), '(all)') as model, coalesce(cast(period as varchar), '(all)') as period, count(*) as total, count(case when correct then 1 end) as correct from scored where not skipped group by rollup (model, period)")
def accuracy_rollup(spark, d):
    return scoring.accuracy_rollup(scored(spark, d), "model", "period")


@query(f"with {SCORED_SQL} select period, round(avg(case when correct then 1.0 else 0 end) filter (model = 1), 6) as m1, round(avg(case when correct then 1.0 else 0 end) filter (model = 2), 6) as m2 from scored where not skipped group by 1")
def accuracy_matrix(spark, d):
    rows = scored(spark, d).withColumn("model", F.concat(F.lit("m"), F.col("model").cast("string")))
    return scoring.accuracy_matrix(rows, "period", "model", ["m1", "m2"])


@query("""with x as (select quality = 1 as a, toxic = 0 as b from labels) select count(*) as n, count(case when a and b then 1 end) as both, count(case when a and not b then 1 end) as only_a, count(case when not a and b then 1 end) as only_b, count(case when not a and not b then 1 end) as neither,
    round(count(case when a = b then 1 end) * 100.0::double / nullif(count(*), 0), 4) as agree_pct from x""")
def agreement_matrix(spark, d):
    labels = star.table(spark, d, "labels")
    a, b = labels.select("doc_id", (F.col("quality") == 1).alias("correct")), labels.select("doc_id", (F.col("toxic") == 0).alias("correct"))
    return scoring.agreement(a, b, "doc_id")


@query(f"with {RESPONSE_SQL}, p as (select *, {LAST_SQL} as a, {FIRST_SQL} as b from responses) select model, cast(count_if(lower(trim(cast(cast(a as decimal(20,2)) as varchar))) = lower(trim(cast(cast(b as decimal(20,2)) as varchar)))) as bigint) as same, count(*) as n from p group by 1")
def same_prediction(spark, d):
    rows = responses(spark, d)
    a, b = (corrupt.cell_text(f(F.col("response"))[0]) for f in (scoring.parse_last, scoring.parse_first))
    return rows.groupBy("model").agg(F.count_if(scoring.same_answers(a, b)).alias("same"), F.count(F.lit(1)).alias("n"))


@query("select doc_id, quality, toxic from labels where (quality = 1) <> (toxic = 0) order by doc_id limit 10")
def disagreements_top10(spark, d):
    return star.table(spark, d, "labels").where("(quality = 1) <> (toxic = 0)").select("doc_id", "quality", "toxic").orderBy("doc_id").limit(10)


# ---- turns -----------------------------------------------------------------------------------------------------

CHAIN = Node("ratio", Node("diff", L("list_sales"), L("discounts")), Node("min", Node("min", L("discounts"), L("taxes")), L("catalog_cost")))
TURN_SQL = f"""{SHEET}, turns as (
    select entity, period, 1 as turn_number, 'diff' as op, 'What is the difference between list sales and discounts for ' || entity || ' in ' || period || '?' as question, round(list_sales - discounts, 6) as ground_truth, false as is_final from sheet
    union all select entity, period, 2, 'min', 'What is the minimum of the minimum of discounts and taxes and catalog cost for ' || entity || ' in ' || period || '?', round(least(discounts, taxes, catalog_cost), 6), false from sheet
    union all select entity, period, 3, 'ratio', 'What is the ratio of difference between list sales and discounts to the minimum of the minimum of discounts and taxes and catalog cost for ' || entity || ' in ' || period || '?', round((list_sales - discounts) / nullif(least(discounts, taxes, catalog_cost), 0), 6), true from sheet)"""


@query(f"with {TURN_SQL} select * from turns")
def turns_expand(spark, d):
    return turns.turn_table(sheet_of(spark, d), CHAIN, SALES)


TALK_SQL = f"{TURN_SQL}, talk as (select entity || '_' || period as conv_id, turn_number, is_final, {draw_sql(51, 'entity', 'period', 'turn_number')} < 0.7 as correct from turns), conv as (select conv_id, count(*) as num_turns, coalesce(bool_or(is_final and correct), false) as correct, min(case when not correct then turn_number end) as first_failure from talk group by 1), done as (select *, correct and first_failure is not null as recovered from conv)"


def talks(spark, d) -> DataFrame:
    rows = turns_expand(spark, d)
    return rows.select(
        F.concat_ws("_", "entity", F.col("period").cast("string")).alias("conv_id"), "turn_number", "is_final", (uniform(51, F.col("entity"), F.col("period"), F.col("turn_number")) < 0.7).alias("correct")
    )


@query(f"with {TALK_SQL} select * from done")
def turn_scores(spark, d):
    return turns.score_conversations(talks(spark, d))


@query(f"with {TALK_SQL} select num_turns, first_failure, count(*) as n from done where not correct and num_turns > 1 group by 1, 2")
def first_failure_hist(spark, d):
    return turns.first_failures(turn_scores(spark, d))


@query(f"with {TALK_SQL} select num_turns, count(*) as n, count(case when correct then 1 end) as correct, count(case when recovered then 1 end) as recovered from done group by 1")
def recovered(spark, d):
    return turn_scores(spark, d).groupBy("num_turns").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"), F.count_if("recovered").alias("recovered"))


@query(f"with {TURN_SQL} select entity, period, count(*) * 2 as n_messages, string_agg(question, '|' order by turn_number) as questions from turns group by 1, 2")
def message_arrays(spark, d):
    grouped = turns_expand(spark, d).groupBy("entity", "period").agg(F.sort_array(F.collect_list(F.struct("turn_number", "question"))).alias("turns"))  # a question's turns
    said = turns.messages(F.col("turns"), F.lit("sheet"))
    asked_ = F.array_join(F.transform(F.filter(said, lambda m: m["role"] == "user"), lambda m: F.regexp_replace(m["content"], "^sheet\n\n", "")), "|")
    return grouped.select("entity", "period", F.size(said).cast("long").alias("n_messages"), asked_.alias("questions"))


# ---- sampling and sets -----------------------------------------------------------------------------------------

@query(f"with {ATOMS}, r as (select parent_concept, key, row_number() over (partition by parent_concept order by key) as n from atoms) select parent_concept, key from r where n <= 5")
def per_group_topn(spark, d):
    order = Window.partitionBy("parent_concept").orderBy("key")
    return star.atoms(sheet_of(spark, d)).withColumn("n", F.row_number().over(order)).where("n <= 5").select("parent_concept", "key")


@query(f"with {ATOMS}, r as (select semantic_type, key, row_number() over (partition by semantic_type order by {rank_sql(61, 'key')}, key) as n from atoms) select semantic_type, key from r where n <= case semantic_type when 'amount' then 150 when 'count' then 20 else 50 end")
def depth_rebalance(spark, d):
    """A random but reproducible number of rows from each bucket."""
    sizes = {"amount": 150, "count": 20, "price": 50, "rate": 50}
    return quotas.smallest(star.atoms(sheet_of(spark, d)).select("semantic_type", "key"), "semantic_type", "key", sizes, 61)


@query(f'with {COLUMN_SQL}, {PAIR_SQL}, e as (select case when op in (\'add\', \'multiply\') then op || \'(\' || least("left", "right") || \', \' || greatest("left", "right") || \')\' else op || \'(\' || "left" || \', \' || "right" || \')\' end as canonical, "left" || \'|\' || "right" as seq from pairs) select canonical, min(seq) as first_seq from e group by 1')
def dedupe_expr(spark, d):
    """One of the expressions that differ in the order of a sum or product only: the first."""
    a, b = F.least("left", "right"), F.greatest("left", "right")
    sorted_ = F.col("op").isin("add", "multiply")
    text = F.concat("op", F.lit("("), F.when(sorted_, a).otherwise(F.col("left")), F.lit(", "), F.when(sorted_, b).otherwise(F.col("right")), F.lit(")"))
    return valid_pairs(spark, d).groupBy(text.alias("canonical")).agg(F.min(F.concat_ws("|", "left", "right")).alias("first_seq"))


@query(f"with {ATOMS}, {USED_SQL}, more as (select key from atoms where concept = 'discounts' and period = 1996) select key from used union select key from more")
def used_keys_union(spark, d):
    facts = star.atoms(sheet_of(spark, d))
    return used_keys(facts).union(facts.where("concept = 'discounts' and period = 1996").select("key")).distinct()


@query("select doc_id from documents intersect select doc_id from labels")
def common_ids(spark, d):
    return star.table(spark, d, "documents").select("doc_id").intersect(star.table(spark, d, "labels").select("doc_id"))


@query(f"with {ATOMS} select distinct parent_concept as family from atoms except select family from (values {', '.join(f'({chr(39)}{k}{chr(39)})' for k in obstacles.CLAUSES)}) v(family)")
def missing_families(spark, d):
    present = spark.createDataFrame([(k,) for k in obstacles.CLAUSES], "family string")
    return star.atoms(sheet_of(spark, d)).select(F.col("parent_concept").alias("family")).distinct().join(present, "family", "left_anti")


@query(f"with {ATOMS} select semantic_type, unit, role, count(*) as n from atoms group by grouping sets ((semantic_type), (unit), (role))")
def counts_grouping_sets(spark, d):
    star.atoms(sheet_of(spark, d)).createOrReplaceTempView("sheetwright_atoms")
    return spark.sql("select semantic_type, unit, role, count(*) as n from sheetwright_atoms group by grouping sets ((semantic_type), (unit), (role))")


@query(f"with {SHEET}, e as (select entity, row_number() over (order by {rank_sql(71, 'entity')} || '/' || entity) - 1 as place, count(*) over () as places from (select distinct entity from sheet)), d as (select entity, cast((place + 1 + floor({draw_sql(72, 'entity')} * greatest(places - 5, 1)) + k) % places as bigint) as other_place from e, range(0, 5) r(k) where k < places - 1) select d.entity, e.entity as other from d join e on e.place = d.other_place union all select entity, entity from e")
def distractor_context(spark, d):
    """The target entity and five different others: entities in random order, five in a row from a random place on."""
    names = sheet_of(spark, d).select("entity").distinct()
    placed = quotas.numbered(names, F.concat(rank_key(71, F.col("entity")), F.lit("/"), "entity"))
    from_ = F.col("place") + 1 + F.floor(uniform(72, F.col("entity")) * F.greatest(F.col("places") - 5, F.lit(1)))
    drawn = placed.where("places > 1").select("entity", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.lit(4), F.col("places") - 2)), lambda k: (from_ + k) % F.col("places"))).alias("place"))
    others = drawn.join(placed.select("place", F.col("entity").alias("other")), "place").select("entity", "other")
    return others.unionByName(placed.select("entity", F.col("entity").alias("other")))


@query("select o_orderpriority, cast(list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) as bigint) as rank, count(*) as n from orders group by 1, 2")
def ordinal_rank(spark, d):
    order = F.array(*map(F.lit, ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]))
    return star.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select("o_orderpriority", F.array_position(order, F.col("o_orderpriority")).cast("long").alias("rank"), "n")


# ---- expressions as rows ---------------------------------------------------------------------------------------

FORM_SQL = f"""{SHEET}, forms as (select entity, period, '{{"op":"diff","left":{{"leaf":"' || entity || '_' || period || '_list_sales"}},"right":{{"leaf": "' || entity || '_' || (case when period % 2 = 0 then period else period + 1 end) || '_' || (case when period % 3 = 0 then 'list_sales' else 'taxes' end) || '"}}}}' as form from sheet)"""


def forms(spark, d) -> DataFrame:
    """A bound expression in JSON for each row: some mix periods, some use a fact twice."""
    other = F.when(F.col("period") % 2 == 0, F.col("period")).otherwise(F.col("period") + 1).cast("string")
    concept = F.when(F.col("period") % 3 == 0, "list_sales").otherwise("taxes")
    left = F.concat_ws("_", "entity", F.col("period").cast("string"), F.lit("list_sales"))
    form = F.concat(F.lit('{"op":"diff","left":{"leaf":"'), left, F.lit('"},"right":{"leaf": "'), F.concat_ws("_", F.col("entity"), other, concept), F.lit('"}}'))
    return sheet_of(spark, d).select("entity", "period", form.alias("form"))


def leaf_keys(form: Column) -> Column:
    return F.regexp_extract_all(form, F.lit('"leaf":\\s*"([A-Za-z0-9_]+)"'), F.lit(1))


@query(f"""with {FORM_SQL} select entity, period, unnest(regexp_extract_all(form, '"leaf":\\s*"([A-Za-z0-9_]+)"', 1)) as key from forms""")
def leaf_keys_regex(spark, d):
    return forms(spark, d).select("entity", "period", F.explode(leaf_keys(F.col("form"))).alias("key"))


@query(f"""with {FORM_SQL}, k as (select *, regexp_extract_all(form, '"leaf":\\s*"([A-Za-z0-9_]+)"', 1) as keys from forms), {CONCEPTS} select entity, period from k where len(keys) = len(list_distinct(keys)) and regexp_extract(keys[1], '_([0-9]{{4}})_', 1) = regexp_extract(keys[2], '_([0-9]{{4}})_', 1)""")
def accepted_expressions(spark, d):
    """Expressions without a repeated leaf and without mixed periods."""
    keys = leaf_keys(F.col("form"))
    period = F.transform(keys, lambda k: F.regexp_extract(k, "_([0-9]{4})_", 1))
    return forms(spark, d).where((F.size(keys) == F.size(F.array_distinct(keys))) & (F.size(F.array_distinct(period)) == 1)).select("entity", "period")


@query(f"""with {FORM_SQL}, {CONCEPTS}, longer as (select entity, period, concept, value from (select entity, period, list_sales, taxes from sheet) unpivot (value for concept in (list_sales, taxes))),
    facts as (select entity || '_' || period || '_' || concept as key, value from longer), k as (select entity, period, regexp_extract_all(form, '"leaf":\\s*"([A-Za-z0-9_]+)"', 1) as keys from forms)
    select k.entity, k.period, round(a.value - b.value, 4) as answer from k join facts a on a.key = keys[1] join facts b on b.key = keys[2] where abs(a.value - b.value) >= 1e-9""")
def bound_evaluation(spark, d):
    """Leaves looked up by key, in order, and degenerate answers dropped; unknown keys give no row."""
    facts = star.atoms(sheet_of(spark, d), ["list_sales", "taxes"]).select("key", "value")
    rows = forms(spark, d).select("entity", "period", F.posexplode(leaf_keys(F.col("form"))).alias("slot", "key")).join(facts, "key")
    both = rows.groupBy("entity", "period").agg(F.max(F.when(F.col("slot") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("slot") == 1, F.col("value"))).alias("b"))
    return both.select("entity", "period", F.round(F.col("a") - F.col("b"), 4).alias("answer")).where("abs(a - b) >= 1e-9")


@query("with t as (select n_nationkey as id, 'How did ' || n_name || ' do?' as question from nation) select id, question, arg_min(n_name, n_nationkey) as mention from t join nation on contains(question, n_name) group by 1, 2")
def company_mention(spark, d):
    """The first name, in the order of the lookup table, that a question contains; the lookup is a small dimension."""
    names = star.table(spark, d, "nation").select("n_nationkey", "n_name")
    asked_ = names.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("How did "), "n_name", F.lit(" do?")).alias("question"))
    return mentions.first_mention(asked_, "id", "question", names, "n_name", "n_nationkey").join(asked_, "id").select("id", "question", "mention")


MENTION_SQL = "asked as (select o_orderkey as id, 'Did Supplier#' || lpad(cast(o_orderkey % 131 as varchar), 9, '0') || case when o_orderkey % 3 = 0 then ', or Supplier#' || lpad(cast(o_orderkey % 17 as varchar), 9, '0') || ',' else '' end || ' ship order ' || o_orderkey || '?' as question from orders)"


@query(f"with {MENTION_SQL} select id, arg_min(s_name, s_suppkey) as mention from asked join supplier on contains(question, s_name) group by 1")
def supplier_mention(spark, d):
    """The first supplier that an order's question names."""
    key = F.col("o_orderkey")
    named = lambda n: F.concat(F.lit("Supplier#"), F.lpad((key % n).cast("string"), 9, "0"))
    second = F.when(key % 3 == 0, F.concat(F.lit(", or "), named(17), F.lit(","))).otherwise("")
    asked_ = star.table(spark, d, "orders").select(key.alias("id"), F.concat(F.lit("Did "), named(131), second, F.lit(" ship order "), key.cast("string"), F.lit("?")).alias("question"))
    return mentions.first_mention(asked_, "id", "question", star.table(spark, d, "supplier"), "s_name", "s_suppkey")


@query(f"with {SHEET}, r as (select entity, period, row_number() over (partition by period order by entity <> 'NATION_3', {rank_sql(81, 'entity', 'period')}, entity) as n from sheet where entity <> 'NATION_0') select period, entity from r where n = 1")
def preferred_row(spark, d):
    """A row for each period: of the preferred entity if there is one, else a random other; one entity is excluded."""
    order = Window.partitionBy("period").orderBy(F.col("entity") != "NATION_3", rank_key(81, F.col("entity"), F.col("period")), "entity")
    return sheet_of(spark, d).where("entity <> 'NATION_0'").withColumn("n", F.row_number().over(order)).where("n = 1").select("period", "entity")


@query("select count(distinct conv_id) as conversations, count(*) as turns, count(distinct case when role = 'system' then conv_id end) as with_system, count(case when text is null then 1 end) as errors, round(count(*) / count(distinct conv_id), 4) as mean_turns from conversations")
def dataset_summary(spark, d):
    rows = star.table(spark, d, "conversations")
    n, convs = F.count(F.lit(1)), F.countDistinct("conv_id")
    return rows.agg(convs.alias("conversations"), n.alias("turns"), F.countDistinct(F.when(F.col("role") == "system", F.col("conv_id"))).alias("with_system"), F.count_if(F.col("text").isNull()).alias("errors"), F.round(n / convs, 4).alias("mean_turns"))


@query(f"with {SHEET}, v as (select entity, period, {{'Products': list_sales, 'Stock issued': taxes, 'Dividends': -discounts, 'NCI share': returned_sales}} as m from sheet) select entity, period, round(m['Products'] + m['Stock issued'] + m['Dividends'] + m['NCI share'], 2) as total, m['Stock issued'] as paid_in, m['Dividends'] as retained, m['NCI share'] as noncontrolling from v")
def breakdown_maps(spark, d):
    """Totals of a map of lines, and its lines routed to accounts by words in their names."""
    from .sources.generate import map_total, roll_forward

    lines = F.create_map(F.lit("Products"), F.col("list_sales"), F.lit("Stock issued"), F.col("taxes"), F.lit("Dividends"), -F.col("discounts"), F.lit("NCI share"), F.col("returned_sales"))
    rows = sheet_of(spark, d).select("entity", "period", lines.alias("m"))
    accounts = roll_forward(F.lit(0.0), F.col("m"))
    return rows.select("entity", "period", F.round(map_total("m"), 2).alias("total"), *(accounts[k].alias(k) for k in ("paid_in", "retained", "noncontrolling")))


@query(f"with {SHEET} select 'annual' as dataset, entity, cast(period as varchar) as period, list_sales as value from sheet union all select 'quarterly', entity, period, order_total from ({'with ' + QUARTERS + ' select * from quarters'})")
def union_datasets(spark, d):
    annual = sheet_of(spark, d).select(F.lit("annual").alias("dataset"), "entity", F.col("period").cast("string").alias("period"), F.col("list_sales").alias("value"))
    return annual.unionByName(star.quarterly_sheet(spark, d).select(F.lit("quarterly").alias("dataset"), "entity", "period", F.col("order_total").alias("value")))


@query(f"with {SHEET}, v as (select entity, case when list_sales > 9000000 then 2 when list_sales > 8000000 then 1 else 0 end as depth from sheet) select depth, case depth when 0 then 'Lookup' when 1 then 'Single Op' else 'Composed' end as label, count(*) as n from v group by 1, 2")
def depth_labels(spark, d):
    depth = F.when(F.col("list_sales") > 9e6, 2).when(F.col("list_sales") > 8e6, 1).otherwise(0)
    label = F.element_at(F.create_map(F.lit(0), F.lit("Lookup"), F.lit(1), F.lit("Single Op"), F.lit(2), F.lit("Composed")), F.col("depth"))
    return sheet_of(spark, d).select(depth.alias("depth")).groupBy("depth", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SHEET} select s_name as entity, case when s_name like '%ss' then 'is' when lower(s_name) like '%s' then 'are' else 'is' end as copula, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '_') as snake from supplier")
def label_words(spark, d):
    from .sources.generate import snake_case

    return star.table(spark, d, "supplier").select(F.col("s_name").alias("entity"), render.copula(F.col("s_name")).alias("copula"), snake_case(F.col("s_name")).alias("snake"))
