"""The corpus pipeline: language ID, exact dedup, near-duplicate removal, mixing to target weights, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwright.llm.common import KeyFilter, Scratch, discard
from sheetwright.llm.exact_dedup import drop_exact_duplicates
from sheetwright.llm.near_texts import near_texts
from sheetwright.llm.queries import mixed, packed, table, with_languages


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that have a language, and write the predicted one to ``lang``.

    A document is rejected if its text is null or has no letter, if its best language's code is not shorter than plain
    bytes, or if no language is likelier than all others together.  Rows are judged each, repeated or not.
    """
    known = ("doc_id", "text", "lang")
    own = {c: c if c in known else f"__own{i}__" for i, c in enumerate(docs.columns)}  # other columns may have any name
    rows = docs.select(*(F.col(f"`{c}`").alias(name) for c, name in own.items()))
    found = with_languages(rows, rows.columns)
    sure = (F.col("lang_pred") != "und") & (F.col("bits_per_byte") < 8) & (F.col("score") > 0.5)
    return found.where(sure).withColumn("lang", F.col("lang_pred")).select(*(F.col(name).alias(c) for c, name in own.items()))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the largest id of each group of equal texts; of rows of equal id and text, one.

    A null text counts as empty; a null id is smaller than any other.
    """
    return drop_exact_duplicates(docs, Scratch(spark, "stage2"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of near-duplicates: 0.8 or more over five-word shingles.

    Texts without words, null ones too, are one class.  Rows without an id stay; so do repeated rows of an id that stays.
    """
    scratch = Scratch(spark, "stage3")
    found = scratch.table(near_texts(docs, scratch), "found")
    return discard(docs, found.where("doc_id <> component_id").select("doc_id"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its fitted rate says, so that the domains' shares of all tokens meet the targets.

    A rate is rounded up or down by a hash of the id, so that a domain's tokens are those of its rates on the average: a
    rate of 1.2 takes every fifth document twice, and one of 0 leaves it out.  Repeated rows of one id are each taken as
    often as the likeliest of them; rows without an id are taken once.
    """
    scratch = Scratch(spark, "stage4")
    found = mixed(docs, table(spark, sf_dir, "labels"), scratch).groupBy("doc_id").agg(F.max("copies").alias("__copies__"))
    changed = scratch.table(found.where("doc_id is not null and __copies__ <> 1"), "changed")
    split = KeyFilter(changed.select("doc_id"), "doc_id", changed.count()).split(docs, "doc_id")
    once = split.where("not __maybe__").select(*docs.columns)
    rest = split.where("__maybe__").join(changed, "doc_id", "left").withColumn("__copies__", F.coalesce("__copies__", F.lit(1).cast("long"))).where("__copies__ > 0")
    return once.unionByName(rest.withColumn("__k__", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies__")))).select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents that are left into sequences; each row is packed, repeated or not, and a null text counts as empty."""
    return packed(docs, Scratch(spark, "stage5"))


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup), ("mixing to target weights", mixing), ("best-fit packing", packing)]

#: SQL cannot express the stages; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to packed pieces."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{k + 1}")
    return docs
