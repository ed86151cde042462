"""Queries of statements, notes, wordings, quotas, aliases and turns, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.prng import uniform
from .functions.ranges import RATIO_COLUMNS, scale_ranges
from .operators import catalog, corrupt, notes, obstacles, quotas, scoring, turns, typed
from .plans import levels, render
from .plans.binder import mixes_flows
from .plans.expr import ANNUAL, Compiler, Leaf, Node
from .queries import ATOMS, COLUMN_SQL, LOOKS_SQL, SHEET, USED_SQL, draw_sql, query, rank_sql, schema_columns, sheet_of, used_keys
from .sources import files, generate, star


def text_sql(value: str) -> str:
    """Two decimals in SQL."""
    return f"cast(cast({value} as decimal(20,2)) as varchar)"


def plain_sql(value: str) -> str:
    return f"case when {value} = floor({value}) then cast(cast({value} as bigint) as varchar) else regexp_replace(cast(cast({value} as decimal(38,6)) as varchar), '0+$', '') end"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- statements and notes --------------------------------------------------------------------------------------

LINES_SQL = f"""{ATOMS}, facts as (select entity, parent_concept as section, concept as metric, period as year, value from atoms where not (concept = 'taxes' and period = 1994) and not (concept = 'avg_price' and period > 1995)),
    years as (select distinct entity, section, year from facts),
    metrics as (select distinct entity, section, metric from facts),
    cells as (select m.entity, m.section, m.metric, string_agg(coalesce({plain_sql('f.value')}, ''), ',' order by y.year) as cells
        from metrics m join years y using (entity, section) left join facts f on f.entity = m.entity and f.section = m.section and f.metric = m.metric and f.year = y.year group by 1, 2, 3),
    heads as (select entity, section, section || ',' || string_agg(cast(year as varchar), ',' order by year) as head from years group by 1, 2),
    parts as (select c.entity, c.section, head || chr(10) || string_agg(metric || ',' || cells, chr(10) order by case metric when 'taxes' then 1 when 'discounts' then 2 else 3 end, metric) as t
        from cells c join heads using (entity, section) group by c.entity, c.section, head)"""


@query(f"""with {LINES_SQL} select entity, 'Field,Value' || chr(10) || 'name,' || entity || chr(10) || 'note,"first, ""second"" x"' || chr(10) || chr(10) ||
    string_agg(t, chr(10) || chr(10) order by case section when 'sales' then 1 when 'deductions' then 2 else 3 end, section) || chr(10) as text from parts group by entity""")
def statement_text(spark, d):
    facts = star.atoms(sheet_of(spark, d)).where("not (concept = 'taxes' and period = 1994) and not (concept = 'avg_price' and period > 1995)")
    facts = facts.select("entity", F.col("parent_concept").alias("section"), F.col("concept").alias("metric"), F.col("period").alias("year"), "value")
    fields = F.array(F.struct(F.lit("name").alias("field"), F.col("entity").alias("value")), F.struct(F.lit("note").alias("field"), F.lit('first, "second" x').alias("value")))
    info = facts.select("entity").distinct().select("entity", F.inline(fields))
    return files.statement_text(facts, info, ["sales", "deductions"], ["taxes", "discounts"])


@query(f"with {ATOMS} select entity as path, concept as metric, cast(period as varchar) as year, round(value, 2) as number from atoms where concept in ('taxes', 'discounts', 'list_sales')")
def statement_cells(spark, d):
    """Statements written as text and parsed again."""
    facts = star.atoms(sheet_of(spark, d), ["taxes", "discounts", "list_sales"]).select("entity", F.col("parent_concept").alias("section"), F.col("concept").alias("metric"), F.col("period").alias("year"), "value")
    info = facts.select("entity").distinct().select("entity", F.lit("name").alias("field"), F.col("entity").alias("value"))
    lines = files.statement_text(facts, info).select(F.col("entity").alias("path"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return files.parse_statement_lines(lines).where("year is not null").select("path", "metric", "year", F.round("number", 2).alias("number"))


@query(f"""with {SHEET} select entity, period, round(list_sales + returned_sales, 2) as total_current_assets, round(catalog_cost, 2) as total_non_current_assets, round(taxes, 2) as total_current_liabilities, round(discounts, 2) as total_non_current_liabilities,
    0.0::double as total_shareholders_equity, round(list_sales + returned_sales + catalog_cost, 2) as total_assets, round(taxes + discounts, 2) as total_liabilities, round(taxes + discounts, 2) as total_liabilities_and_equity from sheet""")
def balance_totals(spark, d):
    amounts = lambda *names: F.create_map(*(x for n in names for x in (F.lit(n), F.col(n))))
    made = notes.balance_totals(amounts("list_sales", "returned_sales"), amounts("catalog_cost"), amounts("taxes"), amounts("discounts"), F.create_map().cast("map<string,double>"))
    return sheet_of(spark, d).select("entity", "period", *(F.round(v, 2).alias(k) for k, v in made.items()))


INCOME_SQL = "case when period = 1993 then null else list_sales end"


@query(f"""with {SHEET}, s as (select *, {INCOME_SQL} as net_sales, case when period % 2 = 0 then returned_sales end as minority from sheet), t as (select *, coalesce(net_sales, 0) + returned_sales - catalog_cost - discounts as op from s)
    select entity, period, round(net_sales - catalog_cost, 2) as gross_profit, round(op, 2) as operating_income, round(op + 5, 2) as income_before_taxes, round(op + 5 - taxes, 2) as net_income, round(op + 5 - taxes - minority, 2) as net_income_parent,
    round((net_sales - catalog_cost) * 100 / net_sales, 4) as gross_profit_pct, round(op * 100 / net_sales, 4) as operating_margin_pct, round((op + 5 - taxes) * 100 / net_sales, 4) as net_margin_pct from t""")
def income_totals(spark, d):
    rows = sheet_of(spark, d).withColumns({"net_sales": F.when(F.col("period") != 1993, F.col("list_sales")), "minority": F.when(F.col("period") % 2 == 0, F.col("returned_sales"))})
    made = notes.income_totals(F.col("net_sales"), F.col("returned_sales"), F.col("catalog_cost"), F.col("discounts"), F.lit(5.0), F.col("taxes"), F.col("minority"))
    return rows.select("entity", "period", *(F.round(v, 4 if k.endswith("pct") else 2).alias(k) for k, v in made.items()))


@query(f"""with {SHEET} select entity, period, round(list_sales + taxes, 2) as net_cash_operating, round(-catalog_cost, 2) as net_cash_investing, 0.0::double as net_cash_financing, round(list_sales + taxes - catalog_cost + 7, 2) as net_change,
    round(discounts + (list_sales + taxes - catalog_cost + 7), 2) as closing_cash from sheet""")
def cash_totals(spark, d):
    one = lambda **kw: F.create_map(*(x for k, v in kw.items() for x in (F.lit(k), v)))
    made = notes.cash_totals(one(a=F.col("list_sales"), b=F.col("taxes")), one(a=-F.col("catalog_cost")), F.create_map().cast("map<string,double>"), F.lit(7.0), F.col("discounts"))
    return sheet_of(spark, d).select("entity", "period", *(F.round(v, 2).alias(k) for k, v in made.items()))


@query(f"""with {SHEET} select entity, period, round(taxes - discounts, 2) as other_comprehensive_income, round(list_sales + (taxes - discounts), 2) as comprehensive_income,
    case when period % 2 = 0 then round(list_sales + (taxes - discounts) - returned_sales, 2) end as comprehensive_income_parent from sheet""")
def comprehensive_income(spark, d):
    other = F.create_map(F.lit("translation"), F.col("taxes"), F.lit("hedges"), -F.col("discounts"))
    made = notes.comprehensive(F.col("list_sales"), other, F.when(F.col("period") % 2 == 0, F.col("returned_sales")))
    return sheet_of(spark, d).select("entity", "period", *(F.round(v, 2).alias(k) for k, v in made.items()))


@query(f"""with {SHEET} select entity, period, round(list_sales + taxes + discounts, 2) as total_debt, round(list_sales + discounts, 2) as current_portion, round(taxes, 2) as non_current_portion, round(list_sales + catalog_cost, 2) as segment_net_sales,
    round(list_sales + catalog_cost - 50, 2) as consolidated_net_sales, round(taxes, 2) as segment_operating_income, round(taxes, 2) as consolidated_operating_income,
    case when period <> 1995 then round(returned_sales + discounts - taxes, 2) end as lease_present_value, round(discounts, 2) as repurchased, round(returned_sales + discounts, 2) as disaggregated_revenue from sheet""")
def notes_totals(spark, d):
    debt = F.array(*(F.struct(F.col(c).alias("carrying_value"), F.lit(now).alias("is_current")) for c, now in (("list_sales", True), ("taxes", False), ("discounts", True))))
    none = F.lit(None).cast("double")
    segments = F.array(F.struct(F.col("list_sales").alias("net_sales"), F.col("taxes").alias("operating_income")), F.struct(F.col("catalog_cost").alias("net_sales"), none.alias("operating_income")))
    payments = F.create_map(F.lit("2026"), F.col("returned_sales"), F.lit("Thereafter"), F.col("discounts"))
    made = notes.debt_totals(debt) | notes.segment_totals(segments, F.create_map(F.lit("Eliminations"), F.lit(-50.0)), F.create_map().cast("map<string,double>"))
    made |= {"lease_present_value": notes.lease_present_value(payments, F.when(F.col("period") != 1995, F.col("taxes"))), "disaggregated_revenue": notes.map_values_total(payments)}
    made["repurchased"] = notes.repurchased(F.array(F.struct(F.col("discounts").alias("amount_repurchased_period")), F.struct(none.alias("amount_repurchased_period"))))
    return sheet_of(spark, d).select("entity", "period", *(F.round(v, 2).alias(k) for k, v in made.items()))


@query(f"""with {ATOMS} select concept as "column", min(value) * case when concept in ('tax_rate', 'income_tax') then 1 else 100 end as min, max(value) * case when concept in ('tax_rate', 'income_tax') then 1 else 100 end as max from atoms group by concept""")
def scaled_ranges(spark, d):
    """The ranges that a sheet's measures have, scaled; shares stay."""
    ranges = star.atoms(sheet_of(spark, d)).groupBy(F.col("concept").alias("column")).agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return scale_ranges(ranges, ratios=("tax_rate", *RATIO_COLUMNS))


@query("select c_custkey as entity, x as raw, case when regexp_matches(p, '^[+-]?[0-9]{1,18}$') then cast(p as bigint) end as integer, case when not regexp_matches(p, '^[+-]?[0-9]{1,18}$') then try_cast(p as double) end as real, case when try_cast(p as double) is null then x end as text from (select *, regexp_replace(trim(x), '[$,]', '', 'g') as p from (select c_custkey, unnest(['$' || cast(floor(c_acctbal) as bigint), cast(cast(c_acctbal as decimal(12,2)) as varchar), c_mktsegment, '1,234,567']) as x from customer))")
def lex_typed(spark, d):
    raw = F.array(F.concat(F.lit("$"), F.floor("c_acctbal").cast("string")), F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.col("c_mktsegment"), F.lit("1,234,567"))
    rows = star.table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.explode(raw).alias("raw"))
    return rows.select("entity", "raw", files.lex_value(F.col("raw")).alias("v")).select("entity", "raw", "v.*")


# ---- wordings --------------------------------------------------------------------------------------------------

FORMAL_SQL = " union all ".join(
    f"select entity, period, '{op}' as op, replace(replace(replace(replace(replace(replace({quoted(text)}, '{{a}}', 'discounts'), '{{b}}', 'taxes'), '{{who}}', entity), '{{when}}', case when period % 2 = 0 then 'for fiscal year ' || period else 'from fiscal year ' || period || ' to fiscal year ' || (period + 1) end), '{{year_a}}', cast(period as varchar)), '{{year_b}}', cast(period + period % 2 as varchar)) as question from sheet"
    for op, text in render.FORMAL_PAIRS.items()
)


@query(f"with {SHEET} {FORMAL_SQL}")
def render_formal(spark, d):
    rows, out = sheet_of(spark, d).select("entity", "period"), []
    for op in render.FORMAL_PAIRS:
        said = render.formal_pair(op, F.lit("discounts"), F.lit("taxes"), F.col("entity"), F.col("period"), F.col("period") + F.col("period") % 2)
        out.append(F.struct(F.lit(op).alias("op"), said.alias("question")))
    return rows.select("entity", "period", F.inline(F.array(*out)))


@query(
    f"with {SHEET}, y as (select distinct period from sheet) select op, period, 'What is the ' || name || ' of list sales across all companies in the dataset ' || case when period <> 1995 then 'for fiscal year ' || period else '' end || '?' as question from y, (values "
    + ", ".join(f"('{k}', '{v}')" for k, v in render.FORMAL_AGGREGATES.items()) + ") v(op, name)"
)
def formal_aggregates(spark, d):
    years = sheet_of(spark, d).select("period").distinct()
    year = F.when(F.col("period") != 1995, F.col("period"))
    made = [F.struct(F.lit(op).alias("op"), render.formal_aggregate(op, F.lit("list sales"), year).alias("question")) for op in render.FORMAL_AGGREGATES]
    return years.select("period", F.inline(F.array(*made)))


@query(f"""with {SHEET} select entity, period, 'What was the list sales reported by ' || entity || ' for the fiscal year ending ' || period || '?' as leaf, 'What is the list sales of ' || entity || '?' as undated,
    'For ' || entity || ', what is the result of computing ratio(diff(a, b), c)? Specifically, evaluate the sub-expression first, then apply the outer operation.' as composed from sheet""")
def formal_lookups(spark, d):
    who, label = F.col("entity"), F.lit("list sales")
    return sheet_of(spark, d).select(
        "entity", "period", render.formal_leaf(label, who, F.col("period")).alias("leaf"), render.formal_leaf(label, who, F.lit(None).cast("int")).alias("undated"),
        render.formal_composed(F.lit("ratio(diff(a, b), c)"), who, 3).alias("composed"),
    )


@query(f"with {SHEET} select entity, string_agg('Year ' || period || ':' || case when taxes > discounts then chr(10) || 'taxes: ' || {text_sql('taxes')} else '' end || chr(10) || 'list_sales: ' || {text_sql('list_sales')}, chr(10) order by period) as text from sheet group by entity")
def sheet_lines(spark, d):
    rows = sheet_of(spark, d).withColumn("taxes", F.when(F.col("taxes") > F.col("discounts"), F.col("taxes")))
    return render.sheet_lines(rows, "entity", "period", ["taxes", "list_sales"])


TRACE_SQL = {
    "add": "list_sales + taxes", "subtract": "list_sales - taxes", "multiply": "cast(list_sales as decimal(18,2)) * cast(taxes as decimal(18,2))", "change": "taxes - list_sales", "greater_than": "list_sales > taxes", "less_equal": "list_sales <= taxes",
}


@query(
    f"with {SHEET}, t as (select entity, period, {text_sql('list_sales')} as a, {text_sql('taxes')} as b, " + ", ".join((f"case when {v} then 'true' else 'false' end" if k in ("greater_than", "less_equal") else f"cast(cast(round({v}, 2) as decimal(38,2)) as varchar)") + f" as v_{k}" for k, v in TRACE_SQL.items()) + " from sheet) "
    + " union all ".join(f"select entity, period, '{k}' as op, replace(replace(replace(replace(replace({quoted(render.TRACES[k])}, '{{na}}', 'list_sales'), '{{nb}}', 'taxes'), '{{a}}', a), '{{b}}', b), '{{v}}', v_{k}) as trace from t" for k in TRACE_SQL)
)
def computation_trace(spark, d):
    a, b, out = F.col("list_sales"), F.col("taxes"), []
    value = {"add": a + b, "subtract": a - b, "multiply": a.cast("decimal(18,2)") * b.cast("decimal(18,2)"), "change": b - a, "greater_than": a > b, "less_equal": a <= b}
    for op, v in value.items():
        text = v.cast("string") if op in ("greater_than", "less_equal") else F.round(v, 2).cast("decimal(38,2)").cast("string")
        out.append(F.struct(F.lit(op).alias("op"), render.trace(op, F.lit("list_sales"), corrupt.cell_text(a), F.lit("taxes"), corrupt.cell_text(b), text).alias("trace")))
    return sheet_of(spark, d).select("entity", "period", F.inline(F.array(*out)))


@query("select label, case when name = '' then 'value' else name end as name from (select label, trim(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(label, '^growth rate of ', ''), '^minimum ', ''), '^maximum ', ''), '^average ', ''), '_', ' ')) as name from (select distinct unnest(['growth rate of ' || n, 'minimum ' || n, 'maximum ' || n, 'growth rate of average ' || n, n, 'average ']) as label from (select lower(n_name) as n from nation)))")
def base_metric_names(spark, d):
    n = F.lower("n_name")
    labels = F.array(F.concat(F.lit("growth rate of "), n), F.concat(F.lit("minimum "), n), F.concat(F.lit("maximum "), n), F.concat(F.lit("growth rate of average "), n), n, F.lit("average "))
    rows = star.table(spark, d, "nation").select(F.explode(labels).alias("label")).distinct()
    return rows.select("label", render.base_metric_name(F.col("label")).alias("name"))


def _placeholder_sql() -> str:
    out = "case "
    for pattern, least, most, step, before, after in levels.PLACEHOLDERS:
        number = f"cast(floor(draw * {(most - least) // step + 1}) as bigint) * {step} + {least}"
        text = f"'1.' || lpad(cast({number} - 100 as varchar), 2, '0')" if before else f"cast({number} as varchar) || '{after}'"
        out += f"when regexp_matches(name, '{pattern}') then {text} "
    return out + "end"


@query(f"select k, name, {_placeholder_sql()} as text from (select s_suppkey as k, name, {draw_sql(71, 's_suppkey', 'name')} as draw from supplier, (values ('multiplier'), ('margin_pts'), ('growth_pts'), ('decade'), ('months'), ('amount'), ('year_2'), ('rate'), ('tax_pct'), ('other')) v(name))")
def placeholder_values(spark, d):
    names = F.explode(F.array(*map(F.lit, ["multiplier", "margin_pts", "growth_pts", "decade", "months", "amount", "year_2", "rate", "tax_pct", "other"]))).alias("name")
    rows = star.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), names)
    return rows.select("k", "name", levels.placeholder_value(F.col("name"), uniform(71, F.col("k"), F.col("name"))).alias("text"))


LEVEL_MEASURES = ["total_revenue", "net_income", "total_assets", "total_liabilities", "cash_and_equivalents", "cash_from_operations", "capital_expenditures", "operating_income"]
LEVEL_RATIOS = {"current_ratio": False, "debt_to_equity": False, "gross_margin": False, "return_on_assets": True, "operating_margin": False}
LEVEL_PLANS = [p for level in range(1, 6) for p in levels.compose(level, LEVEL_MEASURES, LEVEL_RATIOS, [1995, 1996, 1997], 5 + level)]


def _plan_sql(i: int, p: levels.Plan) -> str:
    values = {"name": p.name, "y1": p.years[0], "y2": p.years[-1], "last": p.years[-1], "a": p.measures[0] if p.measures else "", "b": p.measures[-1] if p.measures else ""}
    texts = []
    for wording in levels.WORDINGS[p.kind]:
        for k, v in values.items():
            wording = wording.replace("{" + k + "}", str(v).replace("_", " "))
        texts.append(quoted(wording))
    return f"select n_name as entity, {i} as plan, {p.level} as level, '{p.kind}' as kind, replace(([{', '.join(texts)}])[1 + cast(floor({draw_sql(81, 'n_name', str(i))} * {len(texts)}) as integer)], '{{who}}', n_name) as question from nation"


@query(" union all ".join(_plan_sql(i, p) for i, p in enumerate(LEVEL_PLANS)))
def level_questions(spark, d):
    made = [F.struct(F.lit(i).alias("plan"), F.lit(p.level).alias("level"), F.lit(p.kind).alias("kind"), levels.worded(p, F.col("entity"), uniform(81, F.col("entity"), F.lit(i))).alias("question")) for i, p in enumerate(LEVEL_PLANS)]
    return star.table(spark, d, "nation").select(F.col("n_name").alias("entity")).select("entity", F.inline(F.array(*made)))


GROWTH_SQL = ", ".join(f"round(({c} - lag({c}) over w) * 100 / nullif(abs(lag({c}) over w), 0), 2) as {c}_growth" for c in ("list_sales", "taxes", "discounts", "catalog_cost", "units_sold"))


@query(f"with {SHEET} select entity, period, {GROWTH_SQL} from sheet window w as (partition by entity order by period)")
def growth_catalog(spark, d):
    from .operators.windows import series

    then = lambda c: F.lag(c).over(series())
    return sheet_of(spark, d).select("entity", "period", *(levels.growth_percent(then(c), F.col(c)).alias(f"{c}_growth") for c in ("list_sales", "taxes", "discounts", "catalog_cost", "units_sold")))


@query(f"with {SHEET} select entity, period, round((list_sales - catalog_cost) / nullif(list_sales, 0) - (lag(list_sales) over w - lag(catalog_cost) over w) / nullif(lag(list_sales) over w, 0), 4) as change from sheet window w as (partition by entity order by period)")
def fcf_margin_change(spark, d):
    from .operators.windows import series

    pair = lambda c: (F.lag(c).over(series()), F.col(c))
    return sheet_of(spark, d).select("entity", "period", levels.fcf_margin_change(pair("list_sales"), pair("catalog_cost"), pair("list_sales")).alias("change"))


# ---- corruption ------------------------------------------------------------------------------------------------

FIELDS = {"value": ["list_sales", "discounts", "taxes", "returned_sales"], "text": ["company_name", "sector"]}


def _inject_sql() -> str:
    cells = []
    for kind, share, texts, at in (("value", corrupt.VALUE_SHARE, corrupt.VALUE_INJECTIONS, 22), ("text", corrupt.TEXT_SHARE, corrupt.TEXT_INJECTIONS, 25)):
        names = FIELDS[kind]
        for i, f in enumerate(names):
            cell = text_sql(f) if kind == "value" else f
            hit = f"{draw_sql(21, 'k')} < 0.15 and {draw_sql(at, 'k')} < {share} and floor({draw_sql(at + 1, 'k')} * {len(names)}) = {i}"
            cells.append(f"{cell} || case when {hit} then ' ' || ([{', '.join(map(quoted, texts))}])[1 + cast(floor({draw_sql(at + 2, 'k')} * {len(texts)}) as integer)] else '' end as {f}")
    return f"with {SHEET}, r as (select *, entity || '_' || period as k, entity as company_name, 'sector ' || period % 5 as sector from sheet) select entity, period, {', '.join(cells)} from r"


@query(_inject_sql())
def inject_text(spark, d):
    rows = sheet_of(spark, d).withColumns({"company_name": F.col("entity"), "sector": F.concat(F.lit("sector "), (F.col("period") % 5).cast("string"))})
    return corrupt.inject(rows, ["entity", "period"], FIELDS["value"] + ["total_equity"], FIELDS["text"], 0.15, 21)


def _signed_sql() -> str:
    looks = LOOKS_SQL("select key, cast(abs(cast(trunc(value) as bigint)) as varchar) as t, value from signed", [31, 32, 33, 34], "OIZSbBg", "value < 0")
    return f"with {ATOMS}, signed as (select key, case when period % 2 = 0 then -value else value end as value from atoms), {looks} select key, text from looks"


@query(_signed_sql())
def lookalike_signed(spark, d):
    facts = star.atoms(sheet_of(spark, d)).withColumn("value", F.when(F.col("period") % 2 == 0, -F.col("value")).otherwise(F.col("value")))
    return facts.select("key", corrupt.lookalike_signed(F.col("value"), 31, F.col("key")).alias("text"))


@query(f"""with {ATOMS}, {USED_SQL}, {LOOKS_SQL("select key, cast(abs(cast(trunc(value) as bigint)) as varchar) as t, value from atoms", [19, 20, 21, 22], "OIZSbBg", "value < 0")},
    own as (select concept, entity, arg_min(value, period) as value from atoms group by 1, 2),
    ring as (select concept, entity, case when count(*) over w2 > 1 then coalesce(lead(value) over w, first_value(value) over w2) end as donor from own window w as (partition by concept order by {rank_sql(13, 'entity')}, entity), w2 as (partition by concept order by {rank_sql(13, 'entity')}, entity rows between unbounded preceding and unbounded following)),
    k as (select atoms.*, donor, text, (['-9999999', '999999999999', '-1', 'ERROR'])[1 + cast(floor({draw_sql(14, 'key')} * 4) as integer)] as garbage,
        case when key in (select key from used) then 'protected' when semantic_type <> 'amount' or {draw_sql(11, 'key')} >= 0.4 then 'untouched' when {draw_sql(12, 'key')} < 0.25 then 'missing' when {draw_sql(12, 'key')} < 0.5 then 'garbage' when {draw_sql(12, 'key')} < 0.75 then 'lookalike' when donor is null then 'missing' else 'cross' end as corruption
        from atoms join ring using (concept, entity) join looks using (key))
    select key, case corruption when 'untouched' then value when 'protected' then value when 'garbage' then try_cast(garbage as double) when 'cross' then round(donor, 2) end as value,
        case corruption when 'lookalike' then text when 'garbage' then case when garbage = 'ERROR' then garbage end end as value_display, corruption from k""")
def corrupt_amounts(spark, d):
    facts = star.atoms(sheet_of(spark, d))
    return corrupt.corrupt_amounts(facts, "combined", 0.4, 11, used_keys(facts))


# ---- quotas, aliases and joins ---------------------------------------------------------------------------------


@query(f"""with rows as (select o_orderkey as id, cast(o_orderkey % 4 as integer) as depth from orders), r as (select *, row_number() over (partition by depth order by {rank_sql(91, 'id')} || '/' || id) as n from rows)
    select id, depth from r where n <= case depth when 0 then 50 when 1 then 300 when 2 then 150 else 0 end""")
def proportional_sample(spark, d):
    rows = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).cast("int").alias("depth"))
    return quotas.proportional(rows, "id", 91)


@query(f"""with rows as (select o_orderkey as id, o_orderkey % 7 = 0 as derived from orders), r as (select *, row_number() over (partition by derived order by {rank_sql(92, 'id')} || '/' || id) as n from rows)
    select id, derived from r where n <= case when derived then 40 else 60 end""")
def derived_quota(spark, d):
    rows = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7 == 0).alias("derived"))
    return quotas.derived_quota(rows, "id", F.col("derived"), 100, 0.3, 0.5, 92)


ALIAS_SQL = "aliases as (select alias, min(key) as key from (select s_suppkey as key, unnest([lower(trim(s_name)), 's' || s_suppkey, cast(s_suppkey as varchar)]) as alias from supplier) group by 1 having min(key) = max(key))"


@query(f"with {ALIAS_SQL}, asked as (select o_orderkey as id, case o_orderkey % 3 when 0 then 'Supplier#' || lpad(cast(o_orderkey % 20 as varchar), 9, '0') when 1 then ' S' || o_orderkey % 20 when 2 then cast(o_orderkey % 20 as varchar) end as name from orders) select id, name, key from asked left join aliases on alias = lower(trim(name))")
def alias_lookup(spark, d):
    rows = star.table(spark, d, "supplier").select("s_suppkey", "s_name", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"))
    index = files.alias_index(rows, "s_suppkey", ["s_name", "ticker", "s_suppkey"])
    n = (F.col("o_orderkey") % 20).cast("string")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Supplier#"), F.lpad(n, 9, "0"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" S"), n)).otherwise(n)
    asked = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), name.alias("name"))
    return asked.join(index, F.lower(F.trim("name")) == F.col("alias"), "left").select("id", "name", "key")


@query("with c as (select s_suppkey as k, s_name as company_name, 'S' || s_suppkey as ticker from supplier), q as (select o_orderkey as id, case when o_orderkey % 2 = 0 then 'S' || o_orderkey % 30 else 'Supplier#' || lpad(cast(o_orderkey % 30 as varchar), 9, '0') end as entity from orders) select id, entity, k from q join c on entity = company_name or entity = ticker")
def entity_or_ticker(spark, d):
    """Rows whose name or ticker is the one asked for: two equal joins, one a name, so that no side is compared with all of the other."""
    rows = star.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.array_distinct(F.array("s_name", F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))))).alias("entity"))
    n = (F.col("o_orderkey") % 30).cast("string")
    asked = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("S"), n)).otherwise(F.concat(F.lit("Supplier#"), F.lpad(n, 9, "0"))).alias("entity"))
    return asked.join(rows, "entity").select("id", "entity", "k")


INNER = ["add(list_sales, taxes)", "subtract(list_sales, discounts)", "divide(taxes, list_sales)"]


@query(f"""with {SHEET}, one as (select entity, period, unnest(['{INNER[0]}', '{INNER[1]}', '{INNER[2]}']) as expression, unnest([round(list_sales + taxes, 2), round(list_sales - discounts, 2), round(taxes / list_sales, 4)]) as value from sheet),
    two as (select entity, period, unnest(['{INNER[0]}', '{INNER[1]}', 'gone()']) as inner_expression, catalog_cost from sheet)
    select entity, period, 'divide(' || inner_expression || ', catalog_cost)' as expression, round(value / catalog_cost, 4) as value from two join one on two.entity = one.entity and two.period = one.period and inner_expression = expression""".replace("select entity, period, 'divide('", "select two.entity, two.period, 'divide('"))
def subexpression_lookup(spark, d):
    """Compositions look their inner expression's value up by its text, of the same entity and period."""
    s = sheet_of(spark, d)
    values = [F.round(F.col("list_sales") + F.col("taxes"), 2), F.round(F.col("list_sales") - F.col("discounts"), 2), F.round(F.col("taxes") / F.col("list_sales"), 4)]
    one = s.select("entity", "period", F.inline(F.array(*(F.struct(F.lit(e).alias("inner"), v.alias("value")) for e, v in zip(INNER, values, strict=True)))))
    two = s.select("entity", "period", "catalog_cost", F.explode(F.array(*map(F.lit, [*INNER[:2], "gone()"]))).alias("inner"))
    return two.join(one, ["entity", "period", "inner"]).select("entity", "period", F.concat(F.lit("divide("), "inner", F.lit(", catalog_cost)")).alias("expression"), F.round(F.col("value") / F.col("catalog_cost"), 4).alias("value"))


# ---- turns -----------------------------------------------------------------------------------------------------

WIDE_SQL = f"""wide as (select entity || '_' || period as question_id, case when period % 3 = 0 then '' else 'a' end as leaf_1_key, 'taxes' as leaf_1_label, case when period % 2 = 0 then entity else '' end as leaf_1_entity, cast(period as varchar) as leaf_1_period, {text_sql('taxes')} as leaf_1_value,
    'b' as leaf_2_key, 'discounts' as leaf_2_label, entity as leaf_2_entity, cast(period - 1 as varchar) as leaf_2_period, {text_sql('discounts')} as leaf_2_value from sheet)"""
LEAVES_SQL = f"""{SHEET}, {WIDE_SQL}, leaves as (select question_id, 1 as slot, leaf_1_key as leaf_key, leaf_1_label as concept, leaf_1_entity as entity, leaf_1_period as period, cast(leaf_1_value as double) as value from wide where leaf_1_key <> ''
    union all select question_id, 2, leaf_2_key, leaf_2_label, leaf_2_entity, leaf_2_period, cast(leaf_2_value as double) from wide)"""


def wide_questions(spark, d):
    text = lambda c: corrupt.cell_text(F.col(c))
    return sheet_of(spark, d).select(
        F.concat_ws("_", "entity", F.col("period").cast("string")).alias("question_id"), F.when(F.col("period") % 3 == 0, "").otherwise("a").alias("leaf_1_key"), F.lit("taxes").alias("leaf_1_label"),
        F.when(F.col("period") % 2 == 0, F.col("entity")).otherwise("").alias("leaf_1_entity"), F.col("period").cast("string").alias("leaf_1_period"), text("taxes").alias("leaf_1_value"),
        F.lit("b").alias("leaf_2_key"), F.lit("discounts").alias("leaf_2_label"), F.col("entity").alias("leaf_2_entity"), (F.col("period") - 1).cast("string").alias("leaf_2_period"), text("discounts").alias("leaf_2_value"),
    )


@query(f"with {LEAVES_SQL} select * from leaves")
def leaf_map(spark, d):
    return turns.leaf_map(wide_questions(spark, d))


@query(f"with {LEAVES_SQL} select question_id, arg_min(entity, slot) as entity from leaves where entity <> '' group by 1")
def first_leaf_entity(spark, d):
    grouped = turns.leaf_map(wide_questions(spark, d)).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("slot", "entity"))).alias("leaves"))  # a question's leaves
    return grouped.select("question_id", turns.first_entity(F.col("leaves")).alias("entity"))


@query(f"with {LEAVES_SQL} select question_id, array_to_string(list_sort(list(distinct cast(period as integer))), ',') as years, arg_min(concept, slot) as concept, arg_min(entity, slot) filter (where entity <> '') as entity from leaves group by 1")
def subtree_facts(spark, d):
    found = turns.subtree_facts(Node("sum", Leaf("taxes"), Leaf("discounts")), turns.leaf_map(wide_questions(spark, d)))
    return found.withColumn("years", F.array_join(F.col("years").cast("array<string>"), ","))


@query(f"""with {SHEET}, q as (select *, entity || '_' || period as question_id, cast(period % 3 as integer) as depth from sheet)
    select question_id, depth, case when depth < 1 then 1 when period % 2 = 0 then 2 end as num_turns, depth < 1 or period % 2 = 1 as skipped, case when depth >= 1 and period % 2 = 1 then case when period % 5 = 0 then 'no turns' else 'a turn has no value' end end as error from q""")
def dataset_pass(spark, d):
    rows = sheet_of(spark, d).select(F.concat_ws("_", "entity", F.col("period").cast("string")).alias("question_id"), F.lit("q").alias("question"), F.col("taxes").alias("answer"), (F.col("period") % 3).cast("int").alias("depth"), "period")
    made = rows.where("period % 2 = 0 or period % 5 <> 0").select(
        "question_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("turn_number"), F.lit("sum").alias("op"), F.lit("q").alias("question"), F.when(F.col("period") % 2 == 0, F.col("answer")).alias("ground_truth"), F.lit(False).alias("is_final")
    )
    return turns.dataset_pass(rows.drop("period"), made).select("question_id", "depth", "num_turns", "skipped", "error")


@query(f"""with {SHEET}, t as (select entity || '_' || period as conv_id, n as turn_number, n = 2 as is_final, case n when 1 then taxes else discounts end as truth, period, entity from sheet, (values (1), (2)) v(n)),
    a as (select *, case when (period + turn_number) % 4 = 0 then null when (period + turn_number) % 4 = 1 then cast(cast(truth * 2 as decimal(20,2)) as double) else cast(cast(truth as decimal(20,2)) as double) end as predicted from t)
    select conv_id, turn_number, is_final, predicted, coalesce(case when truth = 0 then abs(predicted) < 1e-6 else abs(predicted - truth) / abs(truth) <= 0.05 end, false) as correct from a""")
def replay_scores(spark, d):
    """Turns against the responses to them, a quarter of which are missing."""
    truth = F.array(F.struct(F.lit(1).alias("turn_number"), F.lit(False).alias("is_final"), F.col("taxes").alias("ground_truth")), F.struct(F.lit(2).alias("turn_number"), F.lit(True).alias("is_final"), F.col("discounts").alias("ground_truth")))
    rows = sheet_of(spark, d).select(F.concat_ws("_", "entity", F.col("period").cast("string")).alias("conv_id"), "period", F.inline(truth))
    kind = (F.col("period") + F.col("turn_number")) % 4
    told = rows.where(kind != 0).select("conv_id", "turn_number", F.concat(F.lit("Answer: "), corrupt.cell_text(F.when(kind == 1, F.col("ground_truth") * 2).otherwise(F.col("ground_truth")))).alias("response"))
    return turns.replay(rows.drop("period"), told, lambda text: scoring.parse_first(text)[0], lambda p, t: scoring.correct(p, t, 0.05))


@query(f"with {SHEET}, r as (select *, case period % 3 when 0 then 'ratio' when 1 then 'amount' else 'boolean' end as kind, cast(period % 2 as integer) as depth, {draw_sql(61, 'entity', 'period')} < 0.6 as correct, period = 1996 as skipped from sheet) select kind, depth, count(case when not skipped then 1 end) as total, count(case when skipped then 1 end) as skipped, count(case when correct and not skipped then 1 end) as correct, round(count(case when correct and not skipped then 1 end) / nullif(count(case when not skipped then 1 end), 0), 6) as accuracy from r group by kind, depth")
def accuracy_by_kind_and_depth(spark, d):
    kind = F.when(F.col("period") % 3 == 0, "ratio").when(F.col("period") % 3 == 1, "amount").otherwise("boolean")
    rows = sheet_of(spark, d).select(kind.alias("kind"), (F.col("period") % 2).cast("int").alias("depth"), (uniform(61, F.col("entity"), F.col("period")) < 0.6).alias("correct"), (F.col("period") == 1996).alias("skipped"))
    return scoring.accuracy(rows, "kind", "depth")


@query(f"with {SHEET} select entity || '_' || period as id, 'taxes|discounts' as leaves, {text_sql('taxes')} as answer from sheet")
def qa_export_rows(spark, d):
    rows = sheet_of(spark, d).select(F.concat_ws("_", "entity", F.col("period").cast("string")).alias("id"), F.array(F.lit("taxes"), F.lit("discounts")).alias("leaves"), F.col("taxes").cast("decimal(20,2)").alias("answer"))
    return files.bar_joined(rows)


# ---- compound measures and kinds -------------------------------------------------------------------------------


@query(f"""with {SHEET}, s as (select *, list_sales - discounts as g, list_sales - discounts - taxes as o from sheet), m as (select *, round(g * 100 / list_sales, 2) as gross_margin, round(o * 100 / list_sales, 2) as operating_margin, round(g - taxes, 2) as fcf,
    round(taxes * 100 / discounts, 2) as roe, round(taxes * 100 / catalog_cost, 2) as roa from s)
    select entity, period, gross_margin, operating_margin, round(gross_margin - operating_margin, 2) as difference, fcf, round(fcf * 100 / list_sales, 2) as fcf_margin, roe, roa, round(roe - roa, 2) as leverage_effect from m""")
def compound_measures(spark, d):
    gross = F.col("list_sales") - F.col("discounts")
    made = catalog.margins(gross, gross - F.col("taxes"), F.col("list_sales")) | catalog.free_cash(gross, F.col("taxes"), F.col("list_sales")) | catalog.leverage_effect(F.col("taxes"), F.col("discounts"), F.col("catalog_cost"))
    return sheet_of(spark, d).select("entity", "period", *(v.alias(k) for k, v in made.items()))


@query(f"""with {SHEET}, s as (select *, round(list_sales * 1.15, 2) as ns, round(taxes + round(list_sales * 0.2, 2) * 0.06, 2) as ni from sheet), t as (select *, round(round(round(ns - catalog_cost, 2) - discounts, 2) - ni, 2) as before from s),
    r as (select *, round(round(before * (1 - 0.25), 2) * 100 / list_sales, 2) as new_roe, round(taxes * 100 / list_sales, 2) as old_roe from t)
    select entity, period, new_roe, old_roe, round(new_roe - old_roe, 2) as roe_delta from r""")
def debt_scenario(spark, d):
    c = F.col
    made = catalog.debt_scenario(c("list_sales"), c("catalog_cost"), c("discounts"), c("taxes"), F.lit(0.25), c("taxes"), c("list_sales"), F.lit(0.2), F.lit(0.06), F.lit(0.15))
    return sheet_of(spark, d).select("entity", "period", *(v.alias(k) for k, v in made.items()))


@query(f"with {SHEET} select entity, period, 'total list sales for ' || entity || ' in ' || period as total, 'growth rate of list sales for ' || entity || ' from ' || (period - 1) || ' to ' || period as growth, 'average list sales for ' || entity || ' across years ' || (period - 1) || ' through ' || period as average from sheet")
def kind_phrases(spark, d):
    said = lambda kind, label: render.kind_phrase(kind, F.lit(label), F.col("entity"), F.col("period"), F.col("period") - 1, F.col("period"))
    return sheet_of(spark, d).select(
        "entity", "period", said("aggregate_components", "list_sales").alias("total"), said("growth_rate", "growth rate of list_sales").alias("growth"), said("avg_over_all_periods", "list_sales").alias("average")
    )


@query(f"with {COLUMN_SQL} select o.op, c.name, case o.op when 'count_agg' then 'count' else c.unit end as unit from (values ('sum_agg'), ('avg_agg'), ('max_agg'), ('min_agg'), ('count_agg')) o(op), cols c where c.type = 'numeric' or o.op = 'count_agg'")
def valid_unary(spark, d):
    return typed.valid_unary(schema_columns(spark, d))


@query(f"""with {SHEET}, r as (select entity, period, case period % 4 when 0 then 'Answer: True' when 1 then 'Answer: ' || {text_sql('taxes')} else 'Answer: ' || {text_sql('taxes * 1.04')} end as response,
        case period % 3 when 0 then 'TRUE' when 1 then {text_sql('taxes')} else 'none' end as truth, period % 4 as k, period % 3 as t, cast({text_sql('taxes')} as double) as a, cast({text_sql('taxes * 1.04')} as double) as b from sheet)
    select entity, period, case when k = 0 then t = 0 when t = 1 then abs(case when k = 1 then a else b end - a) / abs(a) <= 0.05 else false end as correct from r""")
def score_any_kind(spark, d):
    k, t = F.col("period") % 4, F.col("period") % 3
    said = F.when(k == 0, "Answer: True").when(k == 1, F.concat(F.lit("Answer: "), corrupt.cell_text(F.col("taxes")))).otherwise(F.concat(F.lit("Answer: "), corrupt.cell_text(F.col("taxes") * 1.04)))
    truth = F.when(t == 0, "TRUE").when(t == 1, corrupt.cell_text(F.col("taxes"))).otherwise("none")
    number, value = scoring.parse_first(said)
    return sheet_of(spark, d).select("entity", "period", scoring.correct_any(number, value, truth, 0.05).alias("correct"))


@query(f"""with {SHEET}, q as (select entity, period, 'What is the list sales for ' || entity || ' in ' || period || '?' as q, {draw_sql(95, 'entity', 'period')} as side, {draw_sql(96, 'entity', 'period')} as which from sheet),
    u as (select *, 'All amounts are given in millions. ' || q as v from q)
    select entity, period, case when side < 0.5 then ([{', '.join(map(quoted, obstacles.PREFIXES))}])[1 + cast(floor(which * {len(obstacles.PREFIXES)}) as integer)] || lower(substr(v, 1, 1)) || substr(v, 2) else v || ([{', '.join(map(quoted, obstacles.SUFFIXES))}])[1 + cast(floor(which * {len(obstacles.SUFFIXES)}) as integer)] end as question from u""")
def q_dispatch(spark, d):
    """Two rewordings by name, in their fixed order whatever the order of the names."""
    question = F.concat(F.lit("What is the list sales for "), "entity", F.lit(" in "), F.col("period").cast("string"), F.lit("?"))
    draws = [uniform(s, F.col("entity"), F.col("period")) for s in (93, 94, 95, 96, 97)]
    made = obstacles.reworded(["negation", "unit_scale_change"], question, F.col("entity"), F.col("period"), "list_sales", F.col("list_sales"), F.lit("millions"), draws)
    return sheet_of(spark, d).select("entity", "period", made.alias("question"))


# ---- generators ------------------------------------------------------------------------------------------------


def _companies_sql(seed: int, factor: float) -> str:
    """The generator's rows in SQL: draws by the same keys, measures in the order in which they build on each other."""
    between = lambda low, high, at, *keys: f"({draw_sql(at, *keys)} * {high - low!r} + {low!r})"
    parts = [
        f"c0 as (select i as company, k, list_reduce(list_transform(range(0, k + 1), lambda j: case when j = 0 then 1.0::double else 1 + {between(-0.05, 0.15, seed + 1, 'i', 'j')} end), lambda a, x: a * x) as path from (select s_suppkey as i from supplier), range({generate.YEARS}) s(k))",
        f"c1 as (select *, cast(floor({between(5e3, 2e5, seed, 'company')} * path * {factor!r}) as bigint) as revenue from c0)",
    ]
    for i, (name, (of, low, high)) in enumerate(generate.SHARES.items()):
        parts.append(f"c{i + 2} as (select *, cast(floor({of} * {between(low, high, seed + 10 + i, 'company', 'k')}) as bigint) as {name} from c{i + 1})")
    return f"""with {', '.join(parts)} select 'Company ' || company as company_name, 'C' || company as ticker, cast(k + {generate.FIRST_YEAR} as integer) as year, revenue, {', '.join(generate.SHARES)},
        round({between(0.10, 0.30, seed + 50, 'company', 'k')}, 4) as income_tax, total_assets - total_liabilities as total_equity, cast(floor({between(50, 5000, seed + 51, 'company')} * {factor!r}) as bigint) as shares_outstanding,
        round({between(5, 500, seed + 52, 'company', 'k')} * {factor!r}, 2) as stock_price, cast(floor({between(100, 1e5, seed + 53, 'company')} * {factor!r}) as bigint) as employees from c{len(generate.SHARES) + 1}"""


def numbers(spark, d):
    return star.table(spark, d, "supplier").select(F.col("s_suppkey").alias("company"))


@query(_companies_sql(7, 1.0))
def generated_companies(spark, d):
    """A synthetic company for each supplier."""
    return generate.annual_companies(spark, numbers(spark, d), 7)


@query(_companies_sql(8, 1e6))
def generated_big_companies(spark, d):
    return generate.annual_companies(spark, numbers(spark, d), 8, 1e6)


@query(_companies_sql(7, 1.0).replace("with c0 as", "with made as (with c0 as", 1) + """), a as (select *, revenue - cost_of_goods_sold as gross_profit, cash + accounts_receivable + inventories + short_term_investments as current_assets from made),
    b as (select *, gross_profit - operating_expenses as operating_income from a), c as (select *, operating_income - non_operating_expenses as pretax_income from b)
    select company_name, year, gross_profit::double as gross_profit, operating_income::double as operating_income, pretax_income::double as pretax_income, round(pretax_income * income_tax, 4) as income_tax_expense, round(pretax_income - pretax_income * income_tax, 4) as net_income,
           current_assets::double as current_assets, (total_assets - current_assets)::double as longterm_assets, (total_liabilities - current_liabilities)::double as longterm_liabilities from c""")
def derived_annual(spark, d):
    """The eight derived measures of the annual sheet, for a synthetic company of each supplier."""
    sheet = Compiler(ANNUAL, "company_name", "year").derive(generate.annual_companies(spark, numbers(spark, d), 7))
    return sheet.select("company_name", "year", *(F.round(c, 4).alias(c) for c in ANNUAL))


@query(f"""with {SHEET}, r as (select entity, period, case period % 3 when 0 then null when 1 then taxes * 1.03 else taxes * 0.5 end as predicted, case when period % 5 = 0 then 0.0 else taxes end as truth from sheet)
    select entity, period, round(abs((predicted - truth) / nullif(truth, 0)), 6) as relative_error, coalesce(abs((predicted - truth) / nullif(truth, 0)) <= 0.05, false) as within_tolerance from r""")
def evaluation_errors(spark, d):
    """Relative errors of predictions, none where the truth is 0 or a prediction is missing."""
    k = F.col("period") % 3
    predicted = F.when(k == 1, F.col("taxes") * 1.03).when(k == 2, F.col("taxes") * 0.5)
    rows = sheet_of(spark, d).select("entity", "period", predicted.alias("predicted"), F.when(F.col("period") % 5 == 0, 0.0).otherwise(F.col("taxes")).alias("ground_truth"))
    return files.with_errors(rows).select("entity", "period", "relative_error", "within_tolerance")


@query("""with r as (select o_orderkey, (['Answer: TRUE', 'I think so. Answer: false.', 'Answer: True;', 'no answer', 'Answer: 12'])[1 + o_orderkey % 5] as response from orders)
    select o_orderkey, case o_orderkey % 5 when 0 then true when 1 then false when 2 then true end as truth, case o_orderkey % 5 when 4 then 12.0 end as number from r""")
def truth_answers(spark, d):
    """Answers that are true or false, whatever their case and what trails them."""
    said = F.array(*map(F.lit, ["Answer: TRUE", "I think so. Answer: false.", "Answer: True;", "no answer", "Answer: 12"]))
    number, truth = scoring.parse_first(F.get(said, (F.col("o_orderkey") % 5).cast("int")))
    return star.table(spark, d, "orders").select("o_orderkey", truth.alias("truth"), number.alias("number"))


LABELS = ["Three Months Ended June 30, 2024", "Three Months Ended June 30, 2023", "Three Months Ended March 31, 2024", "Six Months Ended June 30, 2024", "June 30, 2024", "December 31, 2023"]


@query("""with r as (select o_orderkey, (['three_6', 'three_6', 'three_3', 'six_6', null, null])[1 + o_orderkey % 6] as a, (['three_6', 'three_6', 'three_3', 'six_6', null, null])[1 + o_orderkey // 6 % 6] as b from orders)
    select o_orderkey, coalesce(a <> b, false) as mixed from r""")
def mixed_flows(spark, d):
    """Whether two labels are flows that don't go together; instants go with any."""
    key, labels = F.col("o_orderkey"), F.array(*map(F.lit, LABELS))
    periods = F.array(F.get(labels, (key % 6).cast("int")), F.get(labels, (F.floor(key / 6) % 6).cast("int")))
    return star.table(spark, d, "orders").select("o_orderkey", mixes_flows(periods).alias("mixed"))


ASKED_CONCEPTS = {"balance": ("amount", "USD", "balance", "component"), "orders": ("count", "orders", "volume", None)}


@query("""with s as (select c_custkey, case when c_custkey % 3 = 0 then null else c_name end as company_name, case when c_custkey % 2 = 0 then '' else 'C' || c_custkey end as ticker, 'customer ' || c_custkey as entity,
        cast(1990 + c_custkey % 9 as varchar) as period, case when c_custkey % 7 = 0 then 'n/a' else '$' || cast(cast(c_acctbal as decimal(12,2)) as varchar) end as balance, cast(c_nationkey as varchar) as orders from customer),
    e as (select *, coalesce(company_name, nullif(ticker, ''), entity) as who from s)
    select who || '_' || period || '_balance' as key, who as entity, period, 'balance' as concept, try_cast(replace(balance, '$', '') as double) as value, 'amount' as semantic_type, 'component' as role from e where try_cast(replace(balance, '$', '') as double) is not null
    union all select who || '_' || period || '_orders', who, period, 'orders', cast(orders as double), 'count', null from e""")
def atoms_named(spark, d):
    """Facts of customers that are named by name, else by ticker, else by entity."""
    key = F.col("c_custkey")
    sheet = star.table(spark, d, "customer").select(
        F.when(key % 3 != 0, F.col("c_name")).alias("company_name"), F.when(key % 2 == 0, "").otherwise(F.concat(F.lit("C"), key.cast("string"))).alias("ticker"), F.concat(F.lit("customer "), key.cast("string")).alias("entity"),
        (key % 9 + 1990).alias("year"), F.when(key % 7 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.col("c_acctbal").cast("decimal(12,2)").cast("string"))).alias("balance"), F.col("c_nationkey").cast("string").alias("orders"),
    )
    return star.atomize(sheet, ASKED_CONCEPTS).select("key", "entity", "period", "concept", "value", "semantic_type", "role")


KEPT_SQL = draw_sql(141, "entity", "period", "'trace'")


@query(f"""with {SHEET}, t as (select entity, period, 'list_sales(' || {text_sql('list_sales')} || ') - taxes(' || {text_sql('taxes')} || ') = ' || {text_sql('round(list_sales - taxes, 2)')} as trace, list_sales - taxes as truth, (list_sales - taxes) * case when {KEPT_SQL} < 0.6 then 1.01 else 1.5 end as said from sheet)
    select entity, period, trace from t where abs(said - truth) <= 0.05 * abs(truth)""")
def traces_kept(spark, d):
    """Traces of computations whose answers were right; the others are dropped."""
    a, b = F.col("list_sales"), F.col("taxes")
    factor = F.when(uniform(141, F.col("entity"), F.col("period"), F.lit("trace")) < 0.6, 1.01).otherwise(1.5)
    text = F.round(a - b, 2).cast("decimal(38,2)").cast("string")
    made = render.trace("subtract", F.lit("list_sales"), corrupt.cell_text(a), F.lit("taxes"), corrupt.cell_text(b), text)
    rows = sheet_of(spark, d).select("entity", "period", made.alias("trace"), (a - b).alias("truth"), ((a - b) * factor).alias("predicted"))
    return scoring.kept_traces(rows, "predicted", "truth", 0.05).select("entity", "period", "trace")
