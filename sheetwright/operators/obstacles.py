"""Units, scales and rewordings that make data or questions harder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prng import pick

#: Display units and divisors; prefixes and suffixes of negations.
UNITS = {"thousands": 1e3, "millions": 1e6, "billions": 1e9, "trillions": 1e12}
PREFIXES = ["Do not apply any adjustment; simply compute: ", "It is not the case that you should ignore the following — determine: ", "Without changing the definition, find: "]
SUFFIXES = [" (compute the value as stated, without sign changes.)", " — answer using the figures exactly as given."]
#: Clauses that add nothing, by family.
CLAUSES = {
    "tax": ["The statutory rate was reviewed in an earlier year.", "A tax advisor commented on the filing."],
    "sales": ["A sales campaign was announced in spring.", "The catalogue was printed on recycled paper."],
    "cost": ["A supplier changed its logo.", "The warehouse was repainted."],
    "generic": ["The annual meeting took place in a hotel.", "The company's anniversary was celebrated."],
}


def to_display(value: Column, unit: Column, factor: float, scaled_unit: str = "USD") -> Column:
    """An amount in display units; other units are left alone."""
    if factor <= 0:
        raise ValueError("factor must be positive")
    return F.when(unit == scaled_unit, value / factor).otherwise(value)


def from_display(answer: Column, semantic_type: Column, factor: float) -> Column:
    return F.when(semantic_type == "amount", answer * factor).otherwise(answer)


def plain_number(value: Column) -> Column:
    """Whole numbers without decimals, others with two."""
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("decimal(20,2)").cast("string"))


def negated(question: Column, side: Column, which: Column) -> Column:
    """A question with a prefix or a suffix, by two draws."""
    return F.when(side < 0.5, F.concat(pick(PREFIXES, which), lower_first(question))).otherwise(F.concat(question, pick(SUFFIXES, which)))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def conditional(question: Column, entity: Column, period: Column, measure: str, value: Column, draw: Column) -> Column:
    """A question under a condition that holds: the measure exceeds 30 to 70 % of itself."""
    threshold = F.format_number(F.floor(value * (draw * 0.4 + 0.3)), 0)
    return F.concat(F.lit(f"If {measure.replace('_', ' ')} for "), entity, F.lit(" in "), period.cast("string"), F.lit(" exceeds "), threshold, F.lit(", "), lower_first(question))


def family_of(question: Column) -> Column:
    """The clause family that a question's words point to."""
    low = F.lower(question)
    return F.when(low.contains("tax"), "tax").when(low.contains("cost"), "cost").when(low.contains("sales"), "sales").otherwise("generic")


def clause_of(family: Column, draw: Column) -> Column:
    """A clause of a family, by a draw."""
    clause = F.lit(None).cast("string")
    for name, clauses in CLAUSES.items():
        clause = F.when(family == name, pick(clauses, draw)).otherwise(clause)
    return clause


def beside(question: Column, clause: Column, side: Column) -> Column:
    """A question with a clause before or after it."""
    return F.when(side < 0.5, F.concat(clause, F.lit(" "), question)).otherwise(F.concat(question, F.lit(" "), clause))


def with_clause(question: Column, draw: Column, side: Column) -> Column:
    """A question with a clause of its family before or after it."""
    return beside(question, clause_of(family_of(question), draw), side)


def matched_family(rows: DataFrame, key: str, families: dict[str, str]) -> DataFrame:
    """(key, question, concept, score, family): the concept of a question's own expression that fits its words best, and its clauses.

    ``rows`` has the key, question, concept and parent of each concept of an expression; ``families`` maps a parent to its clauses.
    Ties go to the concept that sorts first; a question that no concept fits, and a parent without clauses, are ``generic``.
    """
    scored = rows.withColumn("score", concept_score(F.col("question"), F.col("concept")))
    best = scored.groupBy(key, "question").agg(F.min_by(F.struct("concept", "score", "parent"), F.struct((-F.col("score")).alias("s"), "concept")).alias("best"))
    routed = F.lit("generic")
    for parent, family in families.items():
        routed = F.when((F.col("best.score") > 0) & (F.col("best.parent") == parent), family).otherwise(routed)
    return best.select(key, "question", "best.concept", "best.score", routed.alias("family"))


def unit_prefix(question: Column, unit: Column) -> Column:
    return F.concat(F.lit("All amounts are given in "), unit, F.lit(". "), question)


def fill(template: Column, values: dict[str, Column]) -> Column:
    """A template with its {placeholders} filled; one that is left is an error."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return F.when(template.rlike(r"\{\w+\}"), F.raise_error(F.concat(F.lit("unfilled: "), template))).otherwise(template)


def variants(facts: DataFrame, factors: dict[str, float]) -> DataFrame:
    """The amounts under each named factor."""
    listed = F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), F.lit(v).alias("factor")) for k, v in factors.items()))).alias("v")
    scaled = F.when(F.col("semantic_type") == "amount", F.col("value") * F.col("v.factor")).otherwise(F.col("value"))
    return facts.select("*", listed).select("key", F.col("v.variant").alias("variant"), F.round(scaled, 2).alias("value"))


def concept_score(question: Column, concept: Column) -> Column:
    """How well a concept's name fits a question: as a phrase, by all its words, or by some."""
    words = F.split(concept, "_")
    hits = F.size(F.filter(words, lambda w: F.lower(question).contains(w)))
    return F.when(F.lower(question).contains(F.replace(concept, F.lit("_"), F.lit(" "))), F.char_length(concept) + 100).when(hits == F.size(words), hits + 50).otherwise(hits)


#: The names of rewordings, of changes to generated data, and of combinations.
REWORDINGS = ("useless_info", "unit_scale_change", "negation", "conditional")
DATA_OBSTACLES = ("big_numbers", "prompt_injection")
COMBINED = "combined_all"


def check_obstacles(names: list[str], has_sheet: bool = True) -> list[str]:
    """The rewordings that a list of obstacles stands for, in the order of REWORDINGS; an error if one is unknown or does not fit.

    ``combined_all`` stands for all of them and goes with no other; those that quote the sheet need one.
    """
    unknown = [n for n in names if n not in (*REWORDINGS, *DATA_OBSTACLES, COMBINED)]
    if unknown:
        raise ValueError(f"unknown obstacles {unknown}; known are {[*REWORDINGS, *DATA_OBSTACLES, COMBINED]}")
    if COMBINED in names and len(set(names)) > 1:
        raise ValueError(f"{COMBINED} goes with no other obstacle")
    own = list(REWORDINGS) if COMBINED in names else [n for n in REWORDINGS if n in names]
    if not has_sheet and "conditional" in own:
        raise ValueError("conditional needs a sheet")
    return own


def reworded(names: list[str], question: Column, entity: Column, period: Column, measure: str, value: Column, unit: Column, draws: list[Column]) -> Column:
    """A question under all of the named rewordings, one after the other; five draws in [0, 1)."""
    for name in check_obstacles(names):
        match name:
            case "useless_info":
                question = with_clause(question, draws[0], draws[1])
            case "unit_scale_change":
                question = unit_prefix(question, unit)
            case "negation":
                question = negated(question, draws[2], draws[3])
            case "conditional":
                question = conditional(question, entity, period, measure, value, draws[4])
    return question
