"""What the trees of a table mean, or why they mean nothing: type rules as columns, bottom-up over each tree's nodes.

The rules are those of ``analyze``, as an abstract interpretation: a subtree's meaning depends on its operands' meanings only, and on the
terms of its sums, which a meaning carries along.  ``tree_meanings`` runs them over the postorder array of each tree with a stack, so
a table of trees that all differ is typed in one pass, and only a tree's own nodes are gathered.  The first error in evaluation order
is the tree's.  Operations over more than two operands are folded from the left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nodes import tree_arrays

TERM = "struct<fact: boolean, concept: string, entity: string, period: string, parent: string, role: string>"
MEANING = {
    "kind": "string", "semantic_type": "string", "text": "string", "entity": "string", "period": "string", "unit": "string", "concept": "string", "from_period": "string", "to_period": "string",
    "error": "string", "literal": "double", "is_sum": "boolean", "terms": f"array<{TERM}>",
}
FOUND = ["kind", "semantic_type", "text", "entity", "period", "unit", "concept", "from_period", "to_period", "error"]
OPERATIONS = ["sum", "diff", "ratio", "mul", "growth", "min", "max", "avg"]


def meaning(**fields: Column | str) -> Column:
    """A meaning; what is not given is NULL."""
    value = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(*(value(fields.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in MEANING.items()))


def spaced(label: Column) -> Column:
    return F.replace(label, F.lit("_"), F.lit(" "))


def said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("None")) for p in parts))


def _terms(fact: Column, node: Column | None = None) -> Column:
    field = lambda name: node[name] if node is not None else F.lit(None).cast("string")
    return F.array(F.struct(fact.alias("fact"), *(field(c).alias(c) for c in ("concept", "entity", "period", "parent", "role")))).cast(f"array<{TERM}>")


def leaf_meaning(node: Column) -> Column:
    """A bound fact, a number, or the error that neither is known."""
    label = F.trim(spaced(node["concept"]))
    text = said(F.when(label == "", "value").otherwise(label), " for ", node["entity"], " in ", node["period"])
    fact = meaning(
        kind="leaf_metric", semantic_type=node["semantic_type"], text=text, entity=node["entity"], period=node["period"], unit=node["unit"], concept=node["concept"], is_sum=F.lit(False), terms=_terms(F.lit(True), node)
    )
    number = meaning(kind="literal_scalar", semantic_type="ratio", text=node["literal"].cast("string"), literal=node["literal"], is_sum=F.lit(False), terms=_terms(F.lit(False)))
    unknown = meaning(error=F.when(node["leaf"].isNotNull(), F.concat(F.lit("unknown leaf "), node["leaf"])).otherwise("no expression"))
    return F.when(node["concept"].isNotNull(), fact).when(node["literal"].isNotNull(), number).otherwise(unknown)


def _over_time(op: str, concept: Column, entity: Column, semantic_type: Column, unit: Column, first: Column, last: Column) -> Column:
    word = {"min": "minimum", "max": "maximum", "avg": "average"}[op]
    text = said(f"the {word} of ", spaced(concept), " for ", entity, " using values from ", first, " through ", last)
    return meaning(kind=f"{op}_over_time", semantic_type=semantic_type, text=text, entity=entity, period=last, unit=unit, concept=concept, from_period=first, to_period=last)


def pair_meaning(op: Column, a: Column, b: Column, siblings: dict[tuple[str, str], list[str]]) -> Column:
    """The meaning of an operation on two meanings."""
    entity, period, unit, concept = (a[c].eqNullSafe(b[c]) for c in ("entity", "period", "unit", "concept"))
    has_entity, kinds = a["entity"].isNotNull(), F.array(a["semantic_type"], b["semantic_type"])
    context = entity & period & has_entity
    bad = lambda text: meaning(error=text)
    both_amounts = (a["semantic_type"] == "amount") & (b["semantic_type"] == "amount")
    amounts = F.when(~both_amounts, bad_text(op, " takes amounts")).when(~unit, bad_text(op, " takes one unit"))

    terms = F.concat(a["terms"], b["terms"])
    total = F.get(terms, F.lit(0))
    names = F.transform(terms, lambda t: t["concept"])
    all_components = F.forall(terms, lambda t: t["fact"] & t["role"].eqNullSafe("component") & t["parent"].eqNullSafe(total["parent"]))
    wanted = reduce(lambda rest, x: F.when(total["parent"] == x[0][0], F.array(*map(F.lit, sorted(x[1])))).otherwise(rest), [(k, v) for k, v in siblings.items() if k[1] == "component"], F.lit(None).cast("array<string>"))
    is_total = context & all_components & (F.size(F.array_distinct(names)) == F.size(names)) & F.array_sort(names).eqNullSafe(wanted)
    sum_text = said("sum of ", a["text"], " and ", b["text"])
    of_sum = (
        F.when(amounts.isNotNull(), bad(amounts))
        .when(is_total, meaning(kind="aggregate_components", semantic_type="amount", text=said("total ", total["parent"], " for ", a["entity"], " in ", a["period"]), entity=a["entity"], period=a["period"], unit=a["unit"], concept=total["parent"]))
        .when(context, meaning(kind="sum_amount", semantic_type="amount", text=sum_text, entity=a["entity"], period=a["period"], unit=a["unit"]))
        .when(entity, meaning(kind="sum_amounts", semantic_type="amount", text=sum_text, entity=a["entity"], unit=a["unit"]))
        .otherwise(bad("sum takes one entity"))
    )
    of_sum = of_sum.withField("is_sum", F.lit(True)).withField("terms", terms)

    of_diff = (
        F.when(amounts.isNotNull(), bad(amounts)).when(~context, bad("diff takes one entity and period"))
        .otherwise(meaning(kind="difference", semantic_type="amount", text=said("difference between ", a["text"], " and ", b["text"]), entity=a["entity"], period=a["period"], unit=a["unit"]))
    )

    # a sum of n facts of one measure at different periods, over n, is their average
    own, one = a["terms"], F.get(a["terms"], F.lit(0))
    times = F.transform(own, lambda t: t["period"])
    alike = F.forall(own, lambda t: t["fact"] & t["concept"].eqNullSafe(one["concept"]) & t["entity"].eqNullSafe(one["entity"]))
    averaged = (b["kind"] == "literal_scalar") & (F.size(own) == b["literal"]) & alike & (F.size(F.array_distinct(times)) == F.size(times))
    mean = F.when(F.size(own) < 2, bad("avg takes one measure at several periods")).otherwise(_over_time("avg", one["concept"], one["entity"], a["semantic_type"], a["unit"], F.array_min(times), F.array_max(times)))
    of_ratio = (
        F.when(F.coalesce(averaged, F.lit(False)), mean).when(amounts.isNotNull(), bad(amounts)).when(~(entity & has_entity), bad("ratio takes one entity"))
        .otherwise(meaning(kind="ratio", semantic_type="ratio", text=said("ratio of ", a["text"], " to ", b["text"]), entity=a["entity"], period=F.when(period, a["period"]), unit="ratio"))
    )

    first_amount = a["semantic_type"].eqNullSafe("amount")
    amount, factor = F.when(first_amount, a).otherwise(b), F.when(a["semantic_type"].isin("ratio", "rate"), a).otherwise(b)
    scaled = amount["semantic_type"].eqNullSafe("amount") & factor["semantic_type"].isin("ratio", "rate")
    of_mul = (
        F.when(~F.coalesce(scaled, F.lit(False)), bad("mul takes an amount and a ratio or rate")).when(factor["entity"].isNotNull() & ~factor["entity"].eqNullSafe(amount["entity"]), bad("mul takes one entity"))
        .otherwise(
            meaning(
                kind="scaled_amount", semantic_type="amount", text=said("result of ", amount["text"], " scaled by ", factor["text"]), entity=amount["entity"], period=amount["period"], unit=amount["unit"],
                from_period=amount["from_period"], to_period=amount["to_period"],
            )
        )
    )

    early, late = F.least(a["period"], b["period"]), F.greatest(a["period"], b["period"])
    grown = said("growth in ", spaced(a["concept"]), " for ", a["entity"], " from ", early, " to ", late)
    of_growth = (
        F.when(~(entity & unit & has_entity), bad("growth takes one entity and unit")).when(a["concept"].isNotNull() & concept & period, bad("growth takes two periods"))
        .when(a["concept"].isNotNull() & concept, meaning(kind="growth_rate", semantic_type="ratio", text=grown, entity=a["entity"], period=late, unit="ratio", concept=a["concept"], from_period=early, to_period=late))
        .otherwise(meaning(kind="growth_rate_composed", semantic_type="ratio", text=said("growth between ", a["text"], " and ", b["text"]), entity=a["entity"], unit="ratio"))
    )

    one_measure = concept & entity & a["concept"].isNotNull() & (a["concept"] != "") & ~period

    def of_extreme(name: str) -> Column:
        word = {"min": "minimum", "max": "maximum"}[name]
        plain = meaning(kind=f"{name}_amounts", semantic_type="amount", text=said(f"the {word} of ", a["text"], " and ", b["text"]), entity=a["entity"], period=F.when(period, a["period"]), unit=a["unit"])
        over = _over_time(name, a["concept"], a["entity"], a["semantic_type"], a["unit"], early, late)
        return F.when(one_measure, over).when(amounts.isNotNull(), bad(amounts)).when(~entity, bad(f"{name} takes one entity")).otherwise(plain)

    of_avg = F.when(one_measure, _over_time("avg", a["concept"], a["entity"], a["semantic_type"], a["unit"], early, late)).otherwise(bad("avg takes one measure at several periods"))
    made = (
        F.when(op == "sum", of_sum).when(op == "diff", of_diff).when(op == "ratio", of_ratio).when(op == "mul", of_mul).when(op == "growth", of_growth)
        .when(op == "min", of_extreme("min")).when(op == "max", of_extreme("max")).when(op == "avg", of_avg).otherwise(bad(F.concat(F.lit("unknown operation "), F.coalesce(op, F.lit("")))))
    )
    made = F.when(op == "sum", made).otherwise(made.withField("is_sum", F.lit(False)).withField("terms", _terms(F.lit(False))))
    return F.when(a["error"].isNotNull(), meaning(error=a["error"])).when(b["error"].isNotNull(), meaning(error=b["error"])).otherwise(made)


def bad_text(op: Column, text: str) -> Column:
    return F.concat(op, F.lit(text))


def tree_meanings(nodes: DataFrame, siblings: dict[tuple[str, str], list[str]] | None = None) -> DataFrame:
    """(tree, kind, semantic_type, text, entity, period, unit, concept, from_period, to_period, error), one row a tree.

    ``nodes`` are bound ones with ``concept``, ``entity``, ``period``, ``semantic_type``, ``unit``, ``parent`` and ``role`` of leaves;
    ``siblings`` has, by (parent, role), all concepts of the sheet: a sum of all components is their parent's total.
    """
    kind = "array<struct<" + ", ".join(f"{c}: {t}" for c, t in MEANING.items()) + ">>"

    def step(stack: Column, node: Column) -> Column:
        arity, height = node["arity"], F.size(stack)
        args = F.slice(stack, F.greatest(height - arity + 1, F.lit(1)), arity)
        folded = F.aggregate(F.slice(args, 2, F.greatest(arity - 1, F.lit(0))), F.get(args, F.lit(0)), lambda a, b: pair_meaning(node["op"], a, b, siblings or {}))
        alone = meaning(error=F.concat(F.coalesce(node["op"], F.lit("nothing")), F.lit(" takes two operands")))
        made = F.when(arity == 0, leaf_meaning(node)).when(arity == 1, alone).otherwise(folded)
        return F.concat(F.slice(stack, 1, F.greatest(height - arity, F.lit(0))), F.array(made))

    found = F.try_element_at(F.aggregate("nodes", F.array().cast(kind), step), F.lit(-1))
    return tree_arrays(nodes).select("tree", found.alias("m")).select("tree", *(F.col(f"m.{c}").alias(c) for c in FOUND))
