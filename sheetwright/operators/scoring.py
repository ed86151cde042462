"""Parsing of answers, scoring within a tolerance, and grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
ANSWER = r"(?i)Answer\s*:\s*([^\n]+)"


def _last(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def _uncomma(text: Column) -> Column:
    return F.regexp_replace(text, "([0-9]),([0-9])", "$1$2")


def _said(raw: Column) -> Column:
    """An answer's text without what may trail it."""
    return F.regexp_replace(F.trim(raw), "[.,;]+$", "")


def _first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(_uncomma(text), NUMBER, 1), F.lit("")).try_cast("double")


def parse_first(text: Column) -> tuple[Column, Column]:
    """(number, truth) of the first answer line; without a number there, the last number of the whole text."""
    raw = F.nullif(F.regexp_extract(text, ANSWER, 1), F.lit(""))
    said = _said(raw)
    truth = F.when(F.lower(said) == "true", True).when(F.lower(said) == "false", False)
    return F.when(truth.isNull(), F.coalesce(_first_number(said), _last(_uncomma(text), NUMBER).try_cast("double"))), truth


def parse_last(text: Column) -> tuple[Column, Column]:
    """(number, truth) of the last answer line, and nothing else."""
    said = _said(_last(text, ANSWER))
    truth = F.when(F.lower(said) == "true", True).when(F.lower(said) == "false", False)
    return F.when(truth.isNull(), _first_number(said)), truth


def strip_tokens(text: Column) -> Column:
    """The final message without special tokens and blocks."""
    tail = F.element_at(F.split(text, r"<\|message\|>"), -1)
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)<\|(?!end\|)[^|]*\|>.*?<\|end\|>", ""), r"<\|[^|]*\|>", "")
    return F.trim(F.when(text.contains("<|message|>"), F.regexp_replace(tail, r"<\|[^|]*\|>", "")).otherwise(plain))


def split_thinking(text: Column) -> tuple[Column, Column]:
    """(thinking, answer) of a text with a ``<think>`` block, whose opening tag may be missing."""
    has = text.contains("</think>")
    before = F.regexp_replace(F.substring_index(text, "</think>", 1), "^\\s*<think>", "")
    after = F.substr(text, F.locate("</think>", text) + 8)
    return F.when(has, F.trim(before)).otherwise(""), F.trim(F.when(has, after).otherwise(text))


def correct(predicted: Column, truth: Column, tolerance: float) -> Column:
    """Within a relative tolerance; a truth of 0 takes predictions below 1e-6; NULL is wrong."""
    close = F.when(truth == 0, F.abs(predicted) < 1e-6).otherwise(F.try_divide(F.abs(predicted - truth), F.abs(truth)) <= tolerance)
    return F.coalesce(close, F.lit(False))


def correct_any(number: Column, truth_value: Column, truth: Column, tolerance: float) -> Column:
    """A prediction, a number or a truth value, against a stated truth of any kind, as text.

    Truth values must be equal; a truth that is neither true, false nor a number is never met.
    """
    said = F.lower(F.trim(truth))
    is_truth = said.isin("true", "false")
    return F.coalesce(F.when(is_truth | truth_value.isNotNull(), truth_value == (said == "true")).otherwise(correct(number, truth_number(truth), tolerance)), F.lit(False)) & (is_truth | truth_value.isNull())


def relative_error(predicted: Column, truth: Column) -> Column:
    return F.try_divide(F.abs(predicted - truth), F.abs(truth))


def truth_number(text: Column) -> Column:
    """A stated truth as a number; thousands commas go."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def accuracy(results: DataFrame, *by: str) -> DataFrame:
    """Total and correct among the rows that were not skipped, skipped, and the accuracy, by some columns."""
    asked = ~F.col("skipped")
    out = results.groupBy(*by).agg(F.count_if(asked).alias("total"), F.count_if(F.col("skipped")).alias("skipped"), F.count_if(asked & F.col("correct")).alias("correct"))
    return out.withColumn("accuracy", F.round(F.try_divide("correct", "total"), 6))


def accuracy_rollup(results: DataFrame, *by: str) -> DataFrame:
    """Accuracy by all prefixes of the columns, pooled; what is pooled over is ``(all)``."""
    out = results.where(~F.col("skipped")).rollup(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("correct")).alias("correct"))
    return out.select(*(F.coalesce(F.col(c).cast("string"), F.lit("(all)")).alias(c) for c in by), "total", "correct")


def accuracy_matrix(results: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    score = F.round(F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)), 6)
    return results.where(~F.col("skipped")).groupBy(rows).pivot(columns, values).agg(score)


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How often two raters are both right, only one is, or none, on the keys both have."""
    x = a.select(key, F.col("correct").alias("x")).join(b.select(key, F.col("correct").alias("y")), key)
    n = F.count(F.lit(1))
    cells = {"both": F.col("x") & F.col("y"), "only_a": F.col("x") & ~F.col("y"), "only_b": ~F.col("x") & F.col("y"), "neither": ~F.col("x") & ~F.col("y")}
    return x.agg(n.alias("n"), *(F.count_if(v).alias(k) for k, v in cells.items()), F.round(F.try_divide(F.count_if(F.col("x") == F.col("y")) * 100.0, n), 4).alias("agree_pct"))


def same_answers(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def kept_traces(rows: DataFrame, predicted: str, truth: str, tolerance: float) -> DataFrame:
    """The rows whose answer is right, with their traces; a trace of a wrong or missing answer is not kept."""
    return rows.where(correct(F.col(predicted), F.col(truth), tolerance))
