"""Sheets of measures by entity and period, derived from star-schema tables.

Money is summed as decimals, so totals do not depend on the order of rows, and given as doubles with two places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Concepts: (semantic type, unit, parent, role).
CONCEPTS = {
    "list_sales": ("amount", "USD", "sales", "component"),
    "discounts": ("amount", "USD", "deductions", "component"),
    "taxes": ("amount", "USD", "deductions", "component"),
    "returned_sales": ("amount", "USD", "sales", None),
    "catalog_cost": ("amount", "USD", "cost", "component"),
    "units_sold": ("count", "units", "volume", None),
    "line_count": ("count", "lines", "volume", None),
    "avg_price": ("price", "USD_per_unit", "price", None),
    "tax_rate": ("rate", "ratio", "rate", None),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str, digits: int = 12) -> Column:
    return F.col(column).cast(f"decimal({digits},2)")


def _measures() -> list[Column]:
    price, off, tax = money("l_extendedprice"), money("l_discount", 4), money("l_tax", 4)
    cents = lambda c: c.cast("decimal(20,2)").cast("double")
    return [
        cents(F.sum(price)).alias("list_sales"),
        cents(F.sum(price * off)).alias("discounts"),
        cents(F.sum(price * (F.lit(1).cast("decimal(3,2)") - off) * tax)).alias("taxes"),
        cents(F.sum(F.when(F.col("l_returnflag") == "R", price).otherwise(F.lit(0).cast("decimal(12,2)")))).alias("returned_sales"),
        cents(F.sum(money("l_quantity") * money("p_retailprice"))).alias("catalog_cost"),
        F.sum(money("l_quantity")).cast("double").alias("units_sold"),
        F.count(F.lit(1)).alias("line_count"),
    ]


def _with_rates(sheet: DataFrame) -> DataFrame:
    return sheet.withColumns(
        {"avg_price": F.round(F.try_divide("list_sales", "units_sold"), 6), "tax_rate": F.round(F.try_divide(F.col("taxes"), F.col("list_sales") - F.col("discounts")), 6)}
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their part's price: both tables are shuffled by part, or parts broadcast where Spark finds them small."""
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))


def annual_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a supplier nation and shipping year; rows are summed by supplier first, so the nation join is small."""
    by_supplier = _lines(spark, sf_dir).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    named = by_supplier.join(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("entity")), F.col("s_nationkey") == F.col("n_nationkey"))
    return _with_rates(named.groupBy("entity", F.year("l_shipdate").alias("period")).agg(*_measures()))


def supplier_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a supplier and shipping year."""
    return _with_rates(_lines(spark, sf_dir).groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("period")).agg(*_measures()))


def quarterly_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a customer nation and order quarter: order totals and counts, with the quarter's label."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    named = orders.join(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("entity")), F.col("c_nationkey") == F.col("n_nationkey"))
    year, quarter = F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")
    out = named.groupBy("entity", year, quarter).agg(F.sum(money("o_totalprice")).cast("double").alias("order_total"), F.count(F.lit(1)).alias("order_count"))
    return out.withColumn("period", F.concat(F.col("year").cast("string"), F.lit("Q"), F.col("quarter").cast("string")))


def concept_table(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in CONCEPTS.items()]
    return spark.createDataFrame(rows, "concept string, semantic_type string, unit string, parent_concept string, role string")


def atoms(sheet: DataFrame, concepts: list[str] | None = None) -> DataFrame:
    """Unpivot a sheet into typed facts: (key, entity, period, concept, value, semantic_type, unit, parent_concept, role)."""
    names = concepts or [c for c in CONCEPTS if c in sheet.columns]
    long = sheet.select("entity", "period", *(F.col(c).cast("double").alias(c) for c in names)).unpivot(["entity", "period"], names, "concept", "value")
    typed = long.join(F.broadcast(concept_table(sheet.sparkSession)), "concept")  # as many rows as CONCEPTS has
    return typed.withColumn("key", F.concat_ws("_", F.col("entity").cast("string"), F.col("period").cast("string"), F.col("concept")))


def atomize(sheet: DataFrame, concepts: dict[str, tuple], period: str = "year") -> DataFrame:
    """Facts of a sheet at question time: as ``atoms``, with a label, for rows that name their entity in one of several columns.

    The entity is a row's company name, else its ticker, else its entity: of those columns that the sheet has, the first that is not
    empty.  ``concepts`` are as CONCEPTS; a sheet without the period or a concept, or without any of the three columns, is an error.  Cells
    that are no numbers give no fact.
    """
    named = [c for c in ("company_name", "ticker", "entity") if c in sheet.columns]
    if missing := sorted({period, *concepts} - set(sheet.columns)):
        raise ValueError(f"a sheet without {', '.join(missing)}")
    if not named:
        raise ValueError("a sheet without company_name, ticker or entity")
    entity = F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in named))
    info = lambda k, i: F.lit(concepts[k][i]).cast("string")
    cells = F.array(*(F.struct(F.lit(k).alias("concept"), F.regexp_replace(F.col(k).cast("string"), "[$,]", "").try_cast("double").alias("value"), *(info(k, i).alias(n) for i, n in enumerate(("semantic_type", "unit", "parent_concept", "role")))) for k in concepts))
    rows = sheet.select(entity.alias("entity"), F.col(period).cast("string").alias("period"), F.inline(cells)).where("value is not null")
    return rows.withColumns({"label": F.replace("concept", F.lit("_"), F.lit(" ")), "key": F.concat_ws("_", "entity", "period", "concept")})


def repivot(facts: DataFrame, concepts: list[str]) -> DataFrame:
    """Facts back to a wide sheet."""
    return facts.groupBy("entity", "period").pivot("concept", concepts).agg(F.max("value"))
