"""The binder against templates bound one by one with the same draws."""

import hashlib
import json
import random

import pytest

from sheetwright.plans import binder, nodes
from sheetwright.plans.expr import SALES, Compiler, Derived, Growth, Leaf, Literal, Node, Over, expand, to_json

TREES = [
    Leaf("taxes"), Node("diff", Leaf("list_sales"), Leaf("discounts")), Node("ratio", Derived("net_sales"), Leaf("list_sales")), Node("mul", Derived("gross_profit"), Leaf("tax_rate")), Growth(Leaf("taxes")),
    Over("min", Leaf("discounts")), Node("sum", Over("avg", Leaf("taxes")), Over("max", Leaf("list_sales"))), Node("ratio", Growth(Leaf("discounts")), Node("sum", Leaf("taxes"), Literal(2.0))), Leaf("nowhere"),
]


def facts():
    draw = random.Random(2)
    return [(f"{e}_{y}_{c}", e, y, c, draw.uniform(1, 9)) for e in ("A", "B", "C_D") for y in range(2018, 2023) for c in ("list_sales", "discounts", "taxes", "catalog_cost", "tax_rate") if draw.random() < 0.8]


def md5(*keys):
    return hashlib.md5("/".join(map(str, keys)).encode()).hexdigest()


def uniform(*keys):
    return int(md5(*keys)[:8], 16) / 4294967296.0


def plain(rows, count, attempts=8, seed=3):
    """By tree: (attempt, entity, period, leaf keys, value)."""
    slices = sorted({r[1:3] for r in rows}, key=lambda s: f"{md5(seed, *s)}/{s[0]}/{s[1]}")
    values = {r[0]: r[4] for r in rows}
    out = {}
    for tree in range(count):
        for attempt in range(attempts):
            e, p = slices[int(uniform(seed + 1, tree, attempt) * len(slices))]
            keys = []

            def value(t, e=e, p=p, keys=keys, tree=tree, attempt=attempt):
                def fact(period, concept):
                    keys.append(f"{e}_{period}_{concept}")
                    return values[keys[-1]]

                if isinstance(t, Leaf):
                    return fact(p, t.concept)
                if isinstance(t, Literal):
                    return t.value
                if isinstance(t, Derived):
                    return value(expand(t, SALES))
                if isinstance(t, Growth):
                    c = t.operand.concept
                    earlier = sorted(r[2] for r in rows if r[1] == e and r[3] == c and r[2] < p)
                    then = fact(earlier[int(uniform(seed + 2, tree, attempt, c) * len(earlier))], c)
                    return (fact(p, c) - then) / then
                if isinstance(t, Over):
                    c = t.operand.concept
                    own = [fact(y, c) for y in sorted(r[2] for r in rows if r[1] == e and r[3] == c)]
                    if len(own) < 2:
                        raise KeyError
                    return {"min": min, "max": max, "avg": lambda x: sum(x) / len(x)}[t.op](own)
                a, b = value(t.left), value(t.right)
                return {"sum": a + b, "diff": a - b, "mul": a * b, "ratio": a / b if b else None}[t.op]

            try:
                found = value(TREES[tree % len(TREES)])
            except (KeyError, IndexError):
                continue
            out[tree] = (attempt, e, p, keys, found)
            break
    return out


def test_every_form_is_bound_and_evaluates(spark):
    rows, count = facts(), 180
    table = spark.createDataFrame(rows, "key string, entity string, period int, concept string, value double")
    templates = spark.createDataFrame([(k, json.dumps(to_json(TREES[k % len(TREES)]))) for k in range(count)], "tree long, form string")
    bound = binder.bind(templates, table, SALES, 3)
    want = plain(rows, count)
    got = {r.tree: r for r in bound.collect()}
    assert {k: (r.attempt, r.entity, r.period) for k, r in got.items()} == {k: v[:3] for k, v in want.items()}
    values = {r.tree: r.value for r in nodes.tree_values(nodes.bound(nodes.node_table(bound, "tree", "form"), table.select("key", "value"))).collect()}
    for k, (*_, keys, value) in want.items():
        assert sorted(x.split('"')[0] for x in got[k].form.split('"leaf": "')[1:]) == sorted(keys)
        assert values[k] == pytest.approx(value, abs=1e-6)
    assert len(want) > 120 and all(k % len(TREES) != len(TREES) - 1 for k in want) and any(v[0] > 0 for v in want.values())


def test_filters_of_bound_forms(spark):
    rows = spark.createDataFrame(
        [
            (1, ["Three Months Ended June 30, 2024", "Three Months Ended June 30, 2023", "June 30, 2024"], '{"leaf": "a"} {"leaf": "b"}', 1.0), (2, ["Three Months Ended June 30, 2024", "Six Months Ended June 30, 2024"], '{"leaf": "a"} {"leaf": "a"}', 0.0),
            (3, ["Three Months Ended June 30, 2024", "Three Months Ended March 31, 2024"], "", None), (4, ["June 30, 2024", "March 31, 2024"], "", -1e-10), (5, [], "", -1.0),
        ],
        "k int, periods array<string>, form string, value double",
    )
    from pyspark.sql import functions as F

    got = rows.select("k", binder.mixes_flows(F.col("periods")), binder.repeats_a_leaf(F.col("form")), binder.degenerate(F.col("value"))).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [(False, False, False), (True, True, True), (True, False, True), (False, False, True), (False, False, False)]


def test_no_fact_and_no_template(spark):
    table = spark.createDataFrame(facts(), "key string, entity string, period int, concept string, value double")
    templates = spark.createDataFrame([(1, json.dumps(to_json(TREES[0])))], "tree long, form string")
    assert binder.bind(templates, table.limit(0), SALES, 3).count() == 0
    assert binder.bind(templates.limit(0), table, SALES, 3).count() == 0


def test_a_bound_tree_equals_the_compiled_one(spark):
    """On a sheet without gaps, what the binder and the compiler say of a tree is the same."""
    sheet = spark.createDataFrame([("A", y, 10.0 * y, 3.0 + y % 5) for y in range(2018, 2022)], "entity string, period int, list_sales double, discounts double")
    long = sheet.unpivot(["entity", "period"], ["list_sales", "discounts"], "concept", "value").selectExpr("concat_ws('_', entity, period, concept) as key", "*")
    tree = Node("ratio", Node("diff", Leaf("list_sales"), Leaf("discounts")), Leaf("list_sales"))
    bound = binder.bind(spark.createDataFrame([(k, json.dumps(to_json(tree))) for k in range(9)], "tree long, form string"), long, {}, 3)
    values = nodes.tree_values(nodes.bound(nodes.node_table(bound, "tree", "form"), long.select("key", "value")))
    got = {(r.period, r.value) for r in bound.join(values, "tree").select("period", "value").collect()}
    assert got <= {(r.period, r.answer) for r in Compiler({}).evaluate(sheet, tree).collect()} and got
