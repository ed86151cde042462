"""Sampling of trees moves no nodes: each row grows its own tree, repeated or not."""

import re

from sheetwright.plans import forest
from sheetwright.plans.expr import SALES

AMOUNTS = ["list_sales", "discounts", "taxes", "catalog_cost", "returned_sales"]


def test_each_row_grows_its_own_tree_without_joins_or_groups(spark):
    rows = spark.createDataFrame([(3,), (4,), (4,), (None,)], "tree long")
    made = forest.sample_trees(rows, 5, (1, 3), AMOUNTS, ["tax_rate"], SALES, distinct=False)
    found = [(r.tree, r.form) for r in made.collect()]
    alone = {t: forest.sample_trees(spark.createDataFrame([(t,)], "tree long"), 5, (1, 3), AMOUNTS, ["tax_rate"], SALES, distinct=False).first().form for t in (3, 4)}
    assert sorted(x for x in found if x[0]) == sorted([(3, alone[3]), (4, alone[4]), (4, alone[4])])
    assert sum(t is None for t, _ in found) == 1
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and not re.search("Join|Aggregate|Window", plan)  # the one deals keys to tasks
