"""Binding of many templates at once: each tree of concepts gets an entity, a period and the facts of its leaves.

A template is a tree in JSON whose leaves are concepts (``expr.to_json``).  All its leaves share an entity and a period; growth takes an
earlier period of its own, and windows take all periods of the concept.  Slices, the pairs of entity and period that have facts, are
numbered once; a tree draws one for each attempt, its form is filled in as text, and its leaf keys are looked up among its entity's,
which come with the slice.  The first attempt that is whole is the tree's.  Nothing is compared with all slices, and no tree waits for another.

Bound forms are those that ``nodes.node_table`` reads: growth has its earlier fact on the left, a window is a chain of facts in order
of time, an average the sum of them over their number, and a derived measure keeps its name beside its expansion.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prng import rank_key, uniform
from ..operators import quotas
from ..operators.windows import period_group, period_kind
from .expr import Concept, Derived, expand, to_json
from .sharing import cut

LEAF = '{"leaf": "%s", "depth": 0}'
#: A growth and a window in a template, with their concept.
GROWTH = r'\{"growth": \{"leaf": "(\w+)", "depth": 0\}, "back": 1, "depth": 1\}'
OVER = r'\{"over": "(\w+)", "operand": \{"leaf": "(\w+)", "depth": 0\}, "back": null, "depth": 1\}'
KEYS = r'"leaf": "([^"]+)"'
#: So many slices, or facts, are broadcast.
FEW = 65536


def spelled_out(form: Column, registry: dict[str, Concept]) -> Column:
    """A template with the expansions of its derived measures beside their names."""
    for name in registry:
        whole = json.dumps(to_json(expand(Derived(name), registry)))
        form = F.replace(form, F.lit(json.dumps(to_json(Derived(name)))), F.lit('{"derived": "' + name + '", "expanded": ' + whole + "}"))
    return form


def _key(entity: Column, period: Column, concept: Column) -> Column:
    return F.concat(F.lit('{"leaf": "'), entity.cast("string"), F.lit("_"), period.cast("string"), F.lit("_"), concept, F.lit('"}'))


def filled_in(form: Column, entity: Column, period: Column, series: Column, draw) -> Column:
    """A template's bound form; NULL where a growth has no earlier period or a window fewer than two.

    ``series`` maps a concept to the entity's periods that have it, in order; ``draw`` makes a draw of a concept.
    """

    def growth(text: Column, found: Column) -> Column:
        concept = F.regexp_extract(found, GROWTH, 1)
        earlier = F.filter(F.try_element_at(series, concept), lambda p: p < period)
        then = F.get(earlier, F.floor(draw(concept) * F.size(earlier)).cast("int"))
        made = F.concat(F.lit('{"op": "growth", "left": '), _key(entity, then, concept), F.lit(', "right": '), _key(entity, period, concept), F.lit("}"))
        return F.replace(text, found, made)

    def over(text: Column, found: Column) -> Column:
        op, concept = F.regexp_extract(found, OVER, 1), F.regexp_extract(found, OVER, 2)
        facts = F.transform(F.try_element_at(series, concept), lambda p: _key(entity, p, concept))
        joined = F.when(op == "avg", "sum").otherwise(op)
        chain = F.aggregate(F.slice(facts, 2, F.greatest(F.size(facts) - 1, F.lit(0))), F.get(facts, F.lit(0)), lambda a, x: F.concat(F.lit('{"op": "'), joined, F.lit('", "left": '), a, F.lit(', "right": '), x, F.lit("}")))
        mean = F.concat(F.lit('{"op": "ratio", "left": '), chain, F.lit(', "right": {"literal": '), F.size(facts).cast("string"), F.lit("}}"))
        return F.replace(text, found, F.when(F.size(facts) >= 2, F.when(op == "avg", mean).otherwise(chain)))

    text = F.aggregate(F.array_distinct(F.regexp_extract_all(form, F.lit(GROWTH), F.lit(0))), form, growth)
    text = F.aggregate(F.array_distinct(F.regexp_extract_all(form, F.lit(OVER), F.lit(0))), text, over)
    return F.regexp_replace(text, F.lit(r'\{"leaf": "(\w+)", "depth": 0\}'), _key(entity, period, F.lit("$1")))


def bind(templates: DataFrame, facts: DataFrame, registry: dict[str, Concept], seed: int, attempts: int = 8) -> DataFrame:
    """(tree, attempt, entity, period, form) of every template (tree, form) that can be bound within so many attempts.

    ``facts`` has key (entity_period_concept), entity, period and concept, each fact once.
    """
    # an entity's periods, by concept, and its keys: as many as it has facts
    periods = facts.groupBy("entity", "concept").agg(F.array_sort(F.collect_set("period")).alias("periods"), F.collect_set("key").alias("keys"))
    series = cut(periods.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("concept", "periods"))).alias("series"), F.flatten(F.collect_list("keys")).alias("known")))
    slices = facts.select("entity", "period").distinct()
    placed = cut(quotas.numbered(slices, F.concat(rank_key(seed, F.col("entity"), F.col("period")), F.lit("/"), F.col("entity").cast("string"), F.lit("/"), F.col("period").cast("string"))).drop("places"))
    # Spark takes exploded templates for as small as their table, and would broadcast them; facts are, as far as they are few
    places, keys = placed.count(), series.agg(F.sum(F.size("known"))).first()[0] or 0
    small = lambda table, n: table.hint("broadcast" if n <= FEW else "merge")
    spelled = templates.select("tree", spelled_out(F.col("form"), registry).alias("template"), F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))
    drawn = spelled.withColumn("place", F.floor(uniform(seed + 1, F.col("tree"), F.col("attempt")) * places).cast("long"))
    made = drawn.join(small(placed, places), "place").join(small(series, keys), "entity")
    draw = lambda concept: uniform(seed + 2, F.col("tree"), F.col("attempt"), concept)
    form = filled_in(F.col("template"), F.col("entity"), F.col("period"), F.col("series"), draw)
    # exploded, as the filters would be pushed below a projection, and each make the form again
    made = made.select("tree", "attempt", "entity", "period", "known", F.explode(F.array(form)).alias("form")).where("form is not null")
    # all leaves of a form are its entity's
    whole = made.where(F.size(F.array_except(F.regexp_extract_all("form", F.lit(KEYS), F.lit(1)), "known")) == 0)
    return whole.groupBy("tree").agg(F.min_by(F.struct("attempt", "entity", "period", "form"), "attempt").alias("best")).select("tree", "best.*")


def repeats_a_leaf(form: Column) -> Column:
    """Whether a bound form uses a fact twice."""
    keys = F.regexp_extract_all(form, F.lit(KEYS), F.lit(1))
    return F.size(keys) > F.size(F.array_distinct(keys))


def mixes_flows(periods: Column) -> Column:
    """Whether labels of periods have flows of several lengths or months; instants, as of balance sheets, go with any of them."""
    groups = F.transform(F.filter(periods, lambda p: period_kind(p) != "instant"), period_group)
    return F.size(F.array_distinct(groups)) > 1


def degenerate(value: Column) -> Column:
    """Whether an answer says nothing: none, or next to zero."""
    return value.isNull() | (F.abs(value) < 1e-9)
