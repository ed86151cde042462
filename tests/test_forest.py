"""Distributed tree sampling: against trees grown one by one with the same draws."""

import hashlib

import pytest

from sheetwright.plans import forest
from sheetwright.plans.expr import SALES, Derived, Growth, Leaf, Node, Over, canonical, expand, from_json, is_balanced, restates

AMOUNTS, RATES = ["list_sales", "discounts", "taxes", "catalog_cost", "returned_sales"], ["tax_rate"]


def grown(seed, tree, attempt, depths):
    draw = lambda path, what: int(hashlib.md5(f"{seed}/{tree}/{attempt}/{path}/{what}".encode()).hexdigest()[:8], 16) / 4294967296.0
    pick = lambda items, path, what: items[int(draw(path, what) * len(items))]

    def amount(path, budget, windows):
        if budget == 0 or draw(path, "stop") < 0.35:
            fit = [n for n, c in SALES.items() if c.family == "amount" and expand(Derived(n), SALES).depth <= budget]
            return Derived(pick(fit, path, "which")) if fit and draw(path, "derived") < 0.3 else Leaf(pick(AMOUNTS, path, "which"))
        op = pick(["sum", "diff", "mul", *(["min", "max", "avg"] if windows else [])], path, "op")
        if op in ("min", "max", "avg"):
            return Over(op, Leaf(pick(AMOUNTS, path, "which")))
        left = amount(path + "0", budget - 1, windows)
        if op == "mul":
            return Node(op, left, ratio(path + "1", budget - 1) if budget > 1 else Leaf(pick(RATES, path + "1", "which")))
        return Node(op, left, amount(path + "1", budget - 1, windows))

    def ratio(path, budget):
        if pick(["ratio", "growth"], path, "op") == "growth":
            return Growth(Leaf(pick(AMOUNTS, path, "which")))
        return Node("ratio", amount(path + "0", budget - 1, False), amount(path + "1", budget - 1, False))

    budget = depths[0] + int(draw("", "depth") * (depths[1] - depths[0] + 1))
    return ratio("", budget) if budget and draw("", "root") < 0.3 else amount("", budget, True)


def plain(seed, n, depths, balanced, require_derived):
    out = {}
    for tree in range(n):
        for attempt in range(forest.BATCHES[-1]):
            t = grown(seed, tree, attempt, depths)
            whole = expand(t, SALES)
            leaves = whole.leaves()
            has = "derived" in str(forest_names(t))
            if depths[0] <= whole.depth <= depths[1] and not restates(t, SALES) and len(set(leaves)) == len(leaves) and (not balanced or is_balanced(t)) and (not require_derived or has):
                out[tree] = (attempt, t)
                break
    return out


def forest_names(t):
    return ["derived"] if isinstance(t, Derived) else [x for c in t.children() for x in forest_names(c)]


@pytest.mark.parametrize(("depths", "balanced", "require_derived"), [((0, 3), False, False), ((2, 3), True, True)])
def test_trees_equal_those_grown_one_by_one_for_any_partitioning(spark, depths, balanced, require_derived):
    want = plain(5, 120, depths, balanced, require_derived)
    found = []
    for parts in (1, 7):
        rows = spark.range(120).select("id").withColumnRenamed("id", "tree").repartition(parts)
        made = forest.sample_trees(rows, 5, depths, AMOUNTS, RATES, SALES, balanced, require_derived, distinct=False)
        found.append({r.tree: (r.attempt, r.form, r.canonical) for r in made.collect()})
    assert found[0] == found[1]
    assert {k: (a, from_json(form), text) for k, (a, form, text) in found[0].items()} == {k: (a, t, canonical(t)) for k, (a, t) in want.items()}
    distinct = {r.canonical: r.tree for r in forest.sample_trees(rows, 5, depths, AMOUNTS, RATES, SALES, balanced, require_derived).collect()}
    first = {}
    for k in sorted(want):
        first.setdefault(canonical(want[k][1]), k)
    assert distinct == first


def test_bad_arguments(spark):
    for bad in ({"depths": (2, 1)}, {"depths": (0, 0), "require_derived": True}, {"depths": (0, 1), "derived_share": 1.5}):
        with pytest.raises(ValueError):
            forest.sample_trees(spark.range(1).withColumnRenamed("id", "tree"), 1, amounts=AMOUNTS, rates=RATES, registry=SALES, **bad)
