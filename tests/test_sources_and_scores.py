"""Sources, sinks, generators, answer parsing and reports on small tables."""

import pytest
from pyspark.sql import functions as F

from sheetwright.functions.prng import pick, uniform
from sheetwright.operators import corrupt, obstacles, scoring, windows
from sheetwright.sources import files, generate, star

STATEMENT = """Field,Value
Company Name,Acme Corp
Rating,AA

Income Statement,2022,2023
Revenue,"$67,781",78857
Cost Of Goods Sold,27804.5,N/A

Balance Sheet,2022,2023
Cash,2886,14140
"""


def test_statement_files(spark, tmp_path):
    (tmp_path / "acme.csv").write_text(STATEMENT)
    cells = files.read_statements(spark, f"file://{tmp_path}/acme.csv")
    found = {(r.metric, r.year): (r.number, r.text) for r in cells.collect()}
    assert found["company_name", None] == (None, "Acme Corp") and found["revenue", "2022"] == (67781.0, None)
    assert found["cost_of_goods_sold", "2023"] == (None, "N/A") and found["cash", "2023"] == (14140.0, None)
    record = files.statement_records(cells).first().record
    assert record["revenue_2022"] == "67781" and record["cost_of_goods_sold_2022"] == "27804.5" and record["rating"] == "AA"


def test_sheet_files(spark, tmp_path):
    sheet = spark.createDataFrame([("a", 2020, 5.0, 1.5)], "entity string, period int, x double, y double")
    files.write_sheet_csv(sheet, f"file://{tmp_path}/csv")
    assert files.read_sheet_csv(spark, f"file://{tmp_path}/csv").first().asDict() == {"entity": "a", "period": "2020", "x": "5.0", "y": "1.5"}
    files.write_records_json(sheet, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").first().asDict() == {"entity": "a", "period": "2020", "x": "5", "y": "1.5"}
    (tmp_path / "atoms.json").write_text('[{"key": "k", "value": 2, "extra": 1}]')
    assert files.read_atoms_json(spark, f"file://{tmp_path}/atoms.json").first().value == 2.0
    questions = spark.createDataFrame([(1, [("k", 1.0)])], "id int, leaves array<struct<key: string, value: double>>")
    wide = files.wide_leaves(questions)
    assert len(wide.columns) == 1 + 18 and wide.first().leaf_1_key == "k" and wide.first().leaf_9_value == ""


def test_companies(spark):
    rows = generate.annual_companies(spark, 15)
    assert rows.count() == 90 and rows.where("total_assets <> total_liabilities + total_equity or cost_of_goods_sold >= revenue or income_tax not between 0.1 and 0.3 or dividends_paid < 0").count() == 0
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, generate.annual_companies(spark, 15).repartition(3).collect()))
    assert generate.annual_companies(spark, 2, factor=1e6).agg(F.min("revenue")).first()[0] > 1e9
    wide = generate.wide_by_year(rows, ["revenue", "cash"], [2020, 2021])
    assert wide.columns == ["company_name", "revenue_2020", "revenue_2021", "cash_2020", "cash_2021"]
    assert generate.column_schema(wide)[1] == {"column": "revenue_2020", "type": "numeric", "base_name": "revenue", "year": 2020}


def test_filings(spark):
    rows = generate.quarterly_filings(spark, 60)
    assert generate.filing_checks(rows).count() == 0
    assert generate.filing_checks(rows.withColumn("total_equity", F.col("total_equity") + 2)).count() == 60
    facts = generate.filing_facts(rows)
    assert {r.concept for r in facts.select("concept").distinct().collect()} >= {"rev_products", "cos_services", "total_assets", "net_income"}
    assert facts.where("period_type = 'ytd'").count() == rows.where("quarter > 1").count()
    assert generate.distinct_filers(rows, 5).count() == 5
    one = spark.createDataFrame([(100.0, {"Stock issued": 5.0, "Dividends": -2.0, "NCI share": 1.0})], "o double, m map<string, double>")
    found = one.select(*(v.alias(k) for k, v in generate.roll_forward(F.col("o"), F.col("m")).items())).first()
    assert (found.paid_in, found.retained, found.noncontrolling, found.closing) == (5.0, -2.0, 1.0, 104.0)


def test_period_labels(spark):
    rows = spark.createDataFrame([("Three Months Ended December 31, 2025",), ("Nine Months Ended June 30, 2024",), ("March 1, 2023",), ("?",)], "p string")
    found = rows.select("p", windows.period_kind(F.col("p")).alias("k"), windows.period_date(F.col("p")).cast("string").alias("d")).collect()
    assert [(r.k, r.d) for r in found] == [("three", "2025-12-31"), ("nine", "2024-06-30"), ("instant", "2023-03-01"), ("instant", "0001-01-01")]


CASES = [
    ("Answer: 1,234.50.", 1234.5, 1234.5), ("x\nanswer :\n -2e3;", -2000.0, -2000.0), ("no 12 and 7", 7.0, None), ("Answer: 1,2,3", 12.0, 12.0), ("Answer: 5\nAnswer: 6", 5.0, 6.0), ("", None, None), (None, None, None),
]


def test_answers(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    found = rows.select("i", scoring.parse_first(F.col("t"))[0].alias("a"), scoring.parse_last(F.col("t"))[0].alias("b")).orderBy("i").collect()
    assert [(r.a, r.b) for r in found] == [c[1:] for c in CASES]
    truth = spark.createDataFrame([("Answer: True.",), ("answer: FALSE",), ("Answer: 5",)], "t string").select(scoring.parse_first(F.col("t"))[1].alias("x")).collect()
    assert [r.x for r in truth] == [True, False, None]


def test_tolerance(spark):
    rows = spark.createDataFrame([(110.0, "100"), (110.1, "100"), (1e-7, "0"), (None, "5"), (5.0, "5,0"), (5.0, "x")], "p double, t string")
    t = scoring.truth_number(F.col("t"))
    found = rows.select(scoring.correct(F.col("p"), t, 0.1).alias("ok"), F.coalesce(scoring.relative_error(F.col("p"), t) <= 0.1, F.lit(False)).alias("near")).collect()
    assert [r.ok for r in found] == [True, False, True, False, False, False]
    assert [r.near for r in found] == [True, False, False, False, False, False]


def test_texts(spark):
    rows = spark.createDataFrame([("<think>a b</think> c",), ("a</think>c",), ("plain",)], "t string")
    think, answer = scoring.split_thinking(F.col("t"))
    assert [tuple(r) for r in rows.select(think, answer).collect()] == [("a b", "c"), ("a", "c"), ("", "plain")]
    tokens = spark.createDataFrame([("<|a|>x<|end|>keep<|b|>",), ("q<|message|>one<|message|>two<|end|>",)], "t string").select(scoring.strip_tokens(F.col("t")).alias("s")).collect()
    assert [r.s for r in tokens] == ["keep", "two"]


def facts(spark):
    rows = [(f"e{e}_{p}_{c}", f"e{e}", p, c, float(100 * e + 10 * p + len(c))) for e in range(6) for p in range(4) for c in ("cash", "sales")]
    return spark.createDataFrame(rows, "key string, entity string, period int, concept string, value double")


def test_corruption(spark):
    table = facts(spark)
    safe = table.where("entity = 'e1'").select("key")
    for mode in (*corrupt.MODES, "combined"):
        rows = corrupt.corrupt(table, mode, 0.5, 3, safe).collect()
        assert len(rows) == 48 and {r.corruption for r in rows if r.entity == "e1"} == {"protected"}
        assert {r.corruption for r in rows} - {"protected", "untouched"} <= set(corrupt.MODES)
        assert sorted(map(tuple, rows)) == sorted(map(tuple, corrupt.corrupt(table.repartition(5), mode, 0.5, 3, safe).collect()))
    given = corrupt.donors(table, 5, other_entity=True).join(table, "key").collect()
    assert all(int(r.donor // 100) != int(r.value // 100) for r in given)
    assert corrupt.corrupt(table, "missing", 0.0, 1).where("corruption <> 'untouched'").count() == 0
    with pytest.raises(ValueError):
        corrupt.corrupt(table, "missing", 1.5, 1)
    wide = table.groupBy("entity", "period").pivot("concept").sum("value")
    fields = [c for c in wide.columns if c not in ("entity", "period")]
    hit = corrupt.inject(wide, ["entity", "period"], fields, [], 0.6, 1).where(" or ".join(f"`{c}` like '% %'" for c in fields)).count()
    assert 0 < hit < wide.count()


def test_obstacles(spark):
    row = spark.createDataFrame([("What is the tax?", 12.0)], "q string, v double")
    assert row.select(obstacles.fill(F.lit("{a} and {b}"), {"a": F.col("v"), "b": F.lit("x")})).first()[0] == "12.0 and x"
    with pytest.raises(Exception, match="unfilled"):
        row.select(obstacles.fill(F.lit("{a} and {b}"), {"a": F.col("v")})).collect()
    assert row.select(obstacles.with_clause(F.col("q"), F.lit(0.0), F.lit(0.0))).first()[0].startswith(obstacles.CLAUSES["tax"][0])
    with pytest.raises(ValueError):
        obstacles.to_display(F.col("v"), F.lit("USD"), 0)


def test_draws(spark):
    rows = spark.range(4000).select(uniform(1, F.col("id")).alias("u"), pick(["a", "b"], uniform(2, F.col("id"))).alias("p"))
    found = rows.agg(F.avg("u").alias("m"), F.min("u").alias("a"), F.max("u").alias("b"), F.count_if(F.col("p") == "a").alias("n")).first()
    assert abs(found.m - 0.5) < 0.02 and 0 <= found.a and found.b < 1 and 1800 < found.n < 2200


def test_round_trip_of_facts(spark):
    sheet = star.annual_sheet(spark, "/root/testdata/sf0.001")
    names = ["list_sales", "taxes"]
    back = star.repivot(star.atoms(sheet, names), names)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sheet.select("entity", "period", *names).collect()))


def test_stream(spark, tmp_path):
    from sheetwright.streaming.scorer import score_stream

    spark.createDataFrame([(1, "Answer: 5"), (2, "Answer: 9")], "id long, response string").write.parquet(f"file://{tmp_path}/in")
    arriving = spark.readStream.schema("id long, response string").parquet(f"file://{tmp_path}/in")
    truths = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, truth double")
    score_stream(arriving, truths, "id", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination(120)
    assert {r.id: r.correct for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {1: True, 2: False}


def test_statement_and_report_texts(spark, tmp_path):
    facts = spark.createDataFrame([("a", "Income", "Revenue", y, v) for y, v in ((2022, 5.0), (2023, 6.5))] + [("a", "Balance", "Cash", y, 1.0) for y in (2022, 2023)], "entity string, section string, metric string, year int, value double")
    info = spark.createDataFrame([("a", "Ticker", "A")], "entity string, field string, value string")
    text = files.statement_text(facts, info).first().text
    assert text == "Field,Value\nTicker,A\n\nBalance,2022,2023\nCash,1,1\n\nIncome,2022,2023\nRevenue,5,6.5\n"
    (tmp_path / "a.csv").write_text(text)
    record = files.statement_records(files.read_statements(spark, f"file://{tmp_path}/a.csv")).first().record
    assert record == {"ticker": "A", "cash_2022": "1", "cash_2023": "1", "revenue_2022": "5", "revenue_2023": "6.5"}
    filing = generate.quarterly_filings(spark, 1)
    assert '"revenues":{"Products":' in files.report_json(filing).first().document
    assert "total revenues" in files.report_text(filing).first().text
