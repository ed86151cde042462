"""The two-company fixture, expression rules, type rules and sampling."""

import json

import pytest
from pyspark.sql import functions as F

from sheetwright.operators.turns import decompose
from sheetwright.plans import render, sampling
from sheetwright.plans.analyze import Fact, Rejected, analyze
from sheetwright.plans.expr import ANNUAL, PROGRAM, QUARTERLY, SALES, Compiler, Derived, Growth, Leaf, Literal, Node, Over, canonical, expand, fold, from_json, is_balanced, load_registry, program, restates, run_programs, show, to_json

CONCEPTS = [
    "revenue", "cost_of_goods_sold", "operating_expenses", "non_operating_expenses", "income_tax", "total_assets", "total_liabilities", "total_equity", "cash", "accounts_receivable", "inventories",
    "short_term_investments", "current_liabilities", "capex", "dividends_paid", "shares_outstanding", "stock_price", "employees",
]


@pytest.fixture(scope="module")
def sheet(spark):
    rows = []
    for company in range(2):
        for year in (2021, 2022, 2023):
            row = {"entity": f"Corp{company}", "period": year}
            for offset, name in enumerate(CONCEPTS, 1):
                row[name] = float({"income_tax": 0.21, "shares_outstanding": 100 + company + offset, "stock_price": 50 + company + offset, "employees": 5000 + 100 * company + offset}.get(name, (company + 1) * 1000 + (year - 2020) * 100 + offset))
            rows.append(row)
    return spark.createDataFrame(rows)


@pytest.mark.parametrize(
    ("tree", "period", "value"),
    [
        (Leaf("revenue"), 2021, 1101), (Node("sum", Leaf("revenue"), Leaf("cost_of_goods_sold")), 2021, 2203), (Derived("gross_profit"), 2021, -1), (Node("ratio", Leaf("revenue"), Leaf("total_assets")), 2021, 0.995479),
        (Node("mul", Leaf("revenue"), Leaf("income_tax")), 2021, 231.21), (Growth(Leaf("revenue")), 2022, 0.090827), (Derived("current_assets"), 2021, 4442), (Over("min", Leaf("revenue")), 2023, 1101), (Over("max", Leaf("revenue")), 2023, 1301),
        (Over("avg", Leaf("revenue")), 2023, 1201), (Node("min", Leaf("cash"), Literal(5.0)), 2021, 5),
    ],
)
def test_values(sheet, tree, period, value):
    rows = Compiler(ANNUAL).evaluate(sheet, tree).where((F.col("entity") == "Corp0") & (F.col("period") == period)).collect()
    assert [r.answer for r in rows] == [pytest.approx(value, abs=1e-6)]


def test_zero_bases_and_nulls_give_no_row(spark):
    sheet = spark.createDataFrame([("a", 1, 5.0, 0.0), ("a", 2, 5.0, None), ("a", 3, None, 1.0)], "entity string, period int, x double, y double")
    for op in ("ratio", "growth", "min", "max", "sum"):
        rows = Compiler({}).evaluate(sheet, Node(op, Leaf("x"), Leaf("y"))).collect()
        assert [r.period for r in rows] == ([] if op in ("ratio", "growth") else [1])


def test_net_income_chain(sheet):
    derived = Compiler(ANNUAL).derive(sheet)
    for r in derived.collect():
        gross = r.revenue - r.cost_of_goods_sold
        pretax = gross - r.operating_expenses - r.non_operating_expenses
        assert r.net_income == pytest.approx(pretax * (1 - 0.21))
        assert r.longterm_assets == pytest.approx(r.total_assets - r.cash - r.accounts_receivable - r.inventories - r.short_term_investments)
    assert {n: expand(Derived(n), QUARTERLY).depth for n in ("gross_profit", "net_income", "total_current_assets")} == {"gross_profit": 1, "net_income": 3, "total_current_assets": 4}


def test_growth_bases(spark):
    sheet = spark.createDataFrame([("a", 1, 10.0, 15.0)], "entity string, period int, x double, y double")
    tree = Node("growth", Leaf("x"), Leaf("y"))
    assert Compiler({}).evaluate(sheet, tree).first().answer == pytest.approx(-1 / 3, abs=1e-6)
    assert Compiler({}, growth_base="left").evaluate(sheet, tree).first().answer == pytest.approx(0.5)


def test_programs_equal_columns(sheet, spark):
    tree = Node("ratio", Node("diff", Leaf("revenue"), Leaf("cash")), Node("max", Leaf("capex"), Literal(2.0)))
    rows = [(r.entity, r.period, program(tree, r.asDict())) for r in sheet.collect()]
    ran = spark.createDataFrame(rows, f"entity string, period long, code {PROGRAM}").select("entity", "period", F.round(run_programs(F.col("code")), 6).alias("answer"))
    assert {tuple(r) for r in ran.collect()} == {tuple(r) for r in Compiler(ANNUAL).evaluate(sheet, tree).collect()}


def test_json_round_trip_and_errors():
    tree = Node("ratio", Node("sum", Leaf("a"), Literal(2.0)), Over("avg", Growth(Derived("b")), 3))
    assert from_json(json.dumps(to_json(tree))) == tree
    assert show(tree) == "ratio(sum(a, 2.0), avg_over(growth(b, 1), 3))"
    for bad in ({"garbage": True}, {"op": "power", "left": {"leaf": "a"}, "right": {"leaf": "b"}}, {"leaf": "a", "depth": 3}):
        with pytest.raises(ValueError):
            from_json(bad)


def test_shapes():
    parts = [Leaf(x) for x in "abcdefgh"]
    assert fold("sum", parts).depth == 7 and fold("sum", parts, balanced=True).depth == 3
    assert is_balanced(fold("sum", parts, balanced=True)) and not is_balanced(fold("sum", parts))
    assert canonical(Node("sum", Leaf("b"), Node("sum", Leaf("c"), Leaf("a")))) == canonical(fold("sum", parts[:3]))
    assert restates(Node("diff", Leaf("list_sales"), Leaf("discounts")), SALES) == "net_sales"
    assert restates(Node("diff", Leaf("discounts"), Leaf("list_sales")), SALES) is None


def test_registry_checks():
    assert load_registry('[{"name": "x", "op": "sum", "args": ["a", "b", "c"]}]')["x"].args == ("a", "b", "c")
    with pytest.raises(ValueError):
        load_registry({"x": {"op": "diff", "args": ["a", "b", "c"]}})
    with pytest.raises(ValueError):
        expand(Derived("x"), load_registry({"x": {"op": "sum", "args": ["y", "b"]}, "y": {"op": "sum", "args": ["x", "b"]}}))


def fact(concept, entity="A", period="2021", kind="amount", unit="USD", parent=None, role=None):
    return Fact(concept, kind, entity, period, unit, parent, role)


def test_type_rules():
    sales, cost, rate = fact("sales"), fact("cost"), fact("tax", kind="rate", unit="ratio")
    assert analyze(("sum", sales, cost)).kind == "sum_amount"
    assert analyze(("sum", sales, fact("cost", period="2022"))).kind == "sum_amounts"
    assert analyze(("ratio", sales, cost)).semantic_type == "ratio"
    assert analyze(("mul", rate, sales)).kind == analyze(("mul", sales, rate)).kind == "scaled_amount"
    grown = analyze(("growth", fact("sales", period="2022"), sales))
    assert (grown.kind, grown.from_period, grown.to_period) == ("growth_rate", "2021", "2022")
    over = analyze(("max", sales, fact("sales", period="2023"), fact("sales", period="2022")))
    assert (over.kind, over.from_period, over.period) == ("max_over_time", "2021", "2023")
    assert analyze(("ratio", ("sum", sales, fact("sales", period="2022")), 2.0)).kind == "avg_over_time"
    parts = [fact(c, parent="expenses", role="component") for c in ("rent", "wages")]
    assert analyze(("sum", *parts), {("expenses", "component"): {"rent", "wages"}}).text == "total expenses for A in 2021"
    assert analyze(("sum", *parts), {("expenses", "component"): {"rent", "wages", "fees"}}).kind == "sum_amount"
    for bad in (("diff", sales, fact("cost", period="2022")), ("sum", sales, fact("cost", entity="B")), ("diff", sales, fact("cost", unit="EUR")), ("sum", sales, rate), ("mul", sales, cost), ("growth", sales, sales), ("power", sales, cost)):
        with pytest.raises(Rejected):
            analyze(bad)


def test_turns():
    a, b, c = map(Leaf, "abc")
    assert [t.expr for t in decompose(Node("min", Node("min", a, b), c))] == [Node("min", Node("min", a, b), c)]
    assert [show(t.expr) for t in decompose(Node("ratio", Node("sum", a, b), Derived("d")))] == ["sum(a, b)", "d", "ratio(sum(a, b), d)"]
    assert decompose(a) == []


def test_words():
    assert [render.oxford(list("abc"[:n])) for n in range(4)] == ["", "a", "a and b", "a, b, and c"]
    assert render.bare_phrase(Node("mul", Derived("net_sales"), Leaf("tax_rate"))) == "result of net sales scaled by tax rate"


def test_sampling_is_reproducible_and_valid():
    options = dict(depths=(1, 3), amounts=["list_sales", "discounts", "taxes", "catalog_cost"], rates=["tax_rate"], registry=SALES)
    trees = sampling.sample(7, 40, **options)
    assert trees == sampling.sample(7, 40, **options) and len(trees) == 40 == len({canonical(t) for t in trees})
    for t in trees:
        assert 1 <= expand(t, SALES).depth <= 3 and restates(t, SALES) is None
    assert all(is_balanced(t) for t in sampling.sample(8, 10, balanced=True, **options))
    assert all("Derived" in repr(t) for t in sampling.sample(9, 10, require_derived=True, **options))
    with pytest.raises(ValueError):
        sampling.sample(1, 0, **options)
