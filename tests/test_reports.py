"""Reports, wordings, quotas, aliases and turns: each query against its SQL, and what SQL does not reach."""

import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from sheetwright import queries, report_queries
from sheetwright.functions.ranges import normalize_range
from sheetwright.operators import corrupt, obstacles, quotas
from sheetwright.plans import analyze, levels, render, sampling
from sheetwright.sources import files, generate

SF = "/root/testdata/sf0.001"
OWN = sorted(n for n, f in queries.QUERIES.items() if f.__module__ == report_queries.__name__)
ALSO = ["corrupt_missing", "corrupt_garbage", "corrupt_lookalike", "corrupt_cross", "corrupt_combined", "format_answer"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    out = [tuple(round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r) for r in rows]
    return sorted(out, key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("name", OWN + ALSO)
def test_query_against_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    names = sorted(found.columns)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(want.columns) == names
    a, b = plain(found.select(*names).collect()), plain(want.select(*(f'"{n}"' for n in names)).fetchall())
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-6) for p, q in zip(x, y, strict=True)), (x, y)


def test_lookalike_changes_two_digits_at_most(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["10258.75", "-6.5", "3947", "74.3", "", "8", "000000"] * 20)], "k int, t string")
    digits = {c for v in corrupt.LOOKALIKE.values() for c in v}
    seen = set()
    for r in rows.select("t", corrupt.lookalike(F.col("t"), 3, F.col("k")).alias("x")).collect():
        whole = r.t.split(".")[0]
        if not set(whole) & set(corrupt.LOOKALIKE):
            assert r.x == r.t
            continue
        changed = [(a, b) for a, b in zip(whole, r.x, strict=True) if a != b]
        assert len(changed) == min(2, sum(c in corrupt.LOOKALIKE for c in whole)) and all(b in corrupt.LOOKALIKE[a] for a, b in changed)
        seen |= {b for _, b in changed}
    assert seen == digits


def test_injection_shares(spark):
    sheet = spark.range(4000).select(F.col("id").alias("year"), F.lit("A").alias("company_name"), F.lit(1.5).alias("revenue"), F.lit(2.0).alias("cash"))
    rows = corrupt.inject(sheet, ["year"], corrupt.VALUE_FIELDS, corrupt.TEXT_FIELDS, 0.5, 3).collect()
    value = [r for r in rows if r.revenue != "1.50" or r.cash != "2.00"]
    text = [r for r in rows if r.company_name != "A"]
    assert abs(len(value) / 4000 - 0.35) < 0.03 and abs(len(text) / 4000 - 0.25) < 0.03
    assert not any(r.revenue != "1.50" and r.cash != "2.00" for r in rows)
    assert {r.company_name[2:] for r in text} == set(corrupt.TEXT_INJECTIONS)
    with pytest.raises(ValueError):
        corrupt.inject(sheet, ["year"], [], [], 1.5, 3)


def test_statement_years_do_not_shift(spark):
    facts = spark.createDataFrame([("e", "s", "m1", 2022, 1.0), ("e", "s", "m1", 2023, 2.5), ("e", "s", "m1", 2024, 3.0), ("e", "s", "m2", 2022, 10.0), ("e", "s", "m2", 2024, 30.0), ("e", "s", "total_m", 2023, 1e9), ("e", "s", "zz", 2023, None)], "entity string, section string, metric string, year int, value double")
    info = spark.createDataFrame([("e", "name", "Acme, Inc"), ("e", "motto", 'so "good"')], "entity string, field string, value string")
    text = files.statement_text(facts, info, items=["m2"]).first().text
    assert text == 'Field,Value\nmotto,"so ""good"""\nname,"Acme, Inc"\n\ns,2022,2023,2024\nm2,10,,30\nm1,1,2.5,3\nzz,,,\ntotal_m,,1000000000,\n'


def test_sinks_and_configuration(spark, tmp_path):
    sheet = generate.annual_companies(spark, 4)
    files.write_companies(spark, sheet, str(tmp_path / "c"))
    nested = spark.read.json(str(tmp_path / "c/companies"))
    assert nested.count() == 4 and {len(r.years) for r in nested.collect()} == {generate.YEARS}
    assert {(r.alias, r.key) for r in spark.read.json(str(tmp_path / "c/aliases")).collect()} >= {("company 1", "C1"), ("c1", "C1")}
    rows = spark.createDataFrame([("q1", ["a", None, "b"], [{"x": 1}])], "id string, keys array<string>, steps array<map<string,int>>")
    files.export_questions(rows, str(tmp_path / "q"))
    assert spark.read.option("header", True).csv(str(tmp_path / "q/csv")).first().keys == "a||b"
    assert spark.read.json(str(tmp_path / "q/jsonl")).first().id == "q1"
    write = lambda name, value: (tmp_path / name).write_text(json.dumps(value)) and str(tmp_path / name)
    good = write("companies.json", [{"company_name": "A", "ticker": "A", "sector": "s", "credit_rating": "AA"}]), write("numeric.json", [{"column": "c", "min": 1, "max": 2}]), write("meta.json", [{"concept": "c", "semantic_type": "amount", "unit": "USD"}])
    assert {k: v.count() for k, v in files.read_config(spark, *good).items()} == {"companies": 1, "numeric": 1, "concepts": 1}
    with pytest.raises(ValueError, match="numeric"):
        files.read_config(spark, good[0], write("bad.json", [{"column": "c", "min": 3, "max": 2}]), good[2])
    with pytest.raises(ValueError, match="concepts"):
        files.read_config(spark, good[0], good[1], write("bad2.json", [{"concept": "c", "semantic_type": "odd"}]))


def test_ranges_and_quotas(spark):
    assert normalize_range(None) == (100, 1_000_000_000) and normalize_range({"min": 1, "max": 1}) == (1, 1)
    with pytest.raises(ValueError):
        normalize_range({"min": 2, "max": 1})
    rows = spark.range(60).select("id", (F.col("id") % 3).cast("int").alias("depth"))
    picked = quotas.proportional(rows, "id", 1, {0: 5, 1: 50, 2: 3}).collect()
    assert len(picked) == 28 and len({r.id for r in picked}) == 28
    found = quotas.derived_quota(rows, "id", F.col("depth") == 0, 20, 0.4, 0.6, 1)
    assert found.where("depth = 0").count() == 10 and found.count() == 20
    with pytest.raises(ValueError):
        quotas.derived_quota(rows, "id", F.lit(True), 0, 0.1, 0.2, 1)


def test_level_composers():
    measures, ratios = report_queries.LEVEL_MEASURES, report_queries.LEVEL_RATIOS
    for level in range(1, 6):
        plans = levels.compose(level, measures, ratios, [2020, 2021, 2022], 3)
        assert plans and len(set(plans)) == len(plans) and plans == levels.compose(level, measures, ratios, [2020, 2021, 2022], 3)
        assert all(p.level == level and set(p.measures) <= set(measures) and set(p.years) <= {2020, 2021, 2022} for p in plans)
    assert not levels.compose(4, measures, ratios, [2020], 3) and not levels.compose(5, measures, ratios, [2020], 3)
    with pytest.raises(ValueError):
        levels.compose(6, measures, ratios, [2020], 3)


def test_prototype_meanings():
    fact = lambda c, p: analyze.Fact(c, "amount", "A", p, "USD")
    identity = analyze.analyze_prototype(("diff", fact("assets", "2020"), fact("liabilities", "2020")))
    assert (identity.kind, identity.concept, identity.text) == ("named_identity", "equity", "equity of A in 2020")
    change = ("diff", fact("cash", "2021"), fact("cash", "2020"))
    assert (analyze.analyze_prototype(change).kind, analyze.analyze_prototype(change).from_period) == ("change_over_time", "2020")
    growth = analyze.analyze_prototype(("ratio", change, fact("cash", "2020")))
    assert (growth.kind, growth.from_period, growth.to_period) == ("growth_rate", "2020", "2021")
    assert analyze.analyze_prototype(("mul", fact("cash", "2020"), fact("debt", "2021"))).kind == "product_amounts"
    assert analyze.analyze_prototype(("sum", fact("cash", "2020"), fact("debt", "2020"))).kind == "sum_amount"


def test_products_take_ratio_trees():
    found = sampling.sample(3, 60, (2, 3), [f"a{i}" for i in range(12)], ["r1", "r2"], {})
    products = [n for t in found for n in walk(t) if getattr(n, "op", "") == "mul"]
    assert any(type(n.right).__name__ in ("Growth", "Node") for n in products)


def walk(tree):
    return [tree, *(n for c in tree.children() for n in walk(c))]


def test_formal_texts(spark):
    one = spark.range(1)
    said = lambda c: one.select(c.alias("x")).first().x
    year = lambda y: F.lit(y).cast("int")
    assert said(render.formal_pair("add", F.lit("a"), F.lit("b"), F.lit("W"), year(2020), year(None))) == "What is the sum of a and b for W for fiscal year 2020?"
    assert said(render.formal_pair("equals", F.lit("a"), F.lit("b"), F.lit("W"), year(None), year(None))) == "Is the a equal to b for W?"
    assert said(render.formal_composed(F.lit("e"), F.lit("W"), 1)) == "For W, evaluate: e"


def test_filings_of_twelve_industries(spark):
    rows = generate.quarterly_filings(spark, 600).cache()
    kinds = {r.industry: r for r in rows.groupBy("industry").agg(F.count("gross_profit").alias("n")).collect()}
    assert len(kinds) == 12 and {k for k, r in kinds.items() if not r.n} == {"airline", "finance"}
    assert generate.filing_checks(rows).count() == 0
    assert generate.filing_checks(rows.withColumn("shares_diluted", F.col("shares_basic") - 1)).count() == 600
    some = generate.many_filings(spark, 40).collect()
    assert len({r.ticker for r in some}) == len(some) == 40
    with pytest.raises(ValueError):
        generate.many_filings(spark, 0)
    one = rows.where("industry = 'airline'").limit(1)
    document = json.loads(generate.report_document(one).first().document)
    assert set(generate.STATEMENTS) < set(document) and "gross_profit" not in document["operations"]["costs"]
    text = generate.report_lines(one).first().text
    assert [x for x in text.split("\n") if not x.startswith(" ")] == ["Operations", "Balance sheet", "Cash flows", "Shareholders equity"] and "Gross profit" not in text


def test_breakdowns_by_industry(spark):
    rows = generate.quarterly_filings(spark, 300).cache()
    for r in rows.collect():
        for total, (column, _) in generate.BREAKDOWNS.items():
            own = getattr(r, column)
            assert set(own) == {*generate.INDUSTRY_LINES[r.industry][total], *generate.COMMON_LINES[total]}
            assert sum(own.values()) == pytest.approx(getattr(r, total), abs=0.01)
    assert set(generate.INDUSTRY_LINES) == set(generate.PROFILES)
    assert generate.filing_checks(rows.withColumn("total_assets", F.col("total_assets") + 2).withColumn("total_equity", F.col("total_equity") + 2)).count() == 300
    facts = generate.filing_facts(rows)
    kinds = {(r.concept, r.period_type) for r in facts.select("concept", "period_type").distinct().collect()}
    assert {("opx_jet_fuel", "quarter"), ("ast_loans", "instant"), ("lia_deposits", "instant"), ("ocf_dry_holes", "quarter")} <= kinds
    assert facts.where("concept = 'opx_jet_fuel'").count() == rows.where("industry = 'airline'").count()
    assert facts.count() == facts.select("key").distinct().count()
    document = json.loads(generate.report_document(rows.where("industry = 'finance'").limit(1)).first().document)
    assert set(document["breakdowns"]["liability_lines"]) == {"Deposits", "Payables", "Borrowings"}


def test_obstacle_names():
    assert obstacles.check_obstacles(["negation", "useless_info", "big_numbers"]) == ["useless_info", "negation"]
    assert obstacles.check_obstacles(["combined_all"]) == list(obstacles.REWORDINGS)
    for names, sheet in ((["odd"], True), (["combined_all", "negation"], True), (["conditional"], False)):
        with pytest.raises(ValueError):
            obstacles.check_obstacles(names, sheet)
