"""Trees as rows: values, turns and meanings against the trees of the driver, evaluated one by one."""

import json
import random

import pytest

from sheetwright.plans import analyze, meanings, nodes, sharing
from sheetwright.plans.analyze import Fact, Rejected

FACTS = "key string, value double, concept string, entity string, period string, semantic_type string, unit string, parent string, role string"
KINDS = {"cash": ("amount", "USD", "assets", "component"), "stock": ("amount", "USD", "assets", "component"), "debt": ("amount", "USD", "liabilities", "component"), "assets": ("amount", "USD", None, "total"), "margin": ("rate", "ratio", None, None), "staff": ("amount", "heads", None, None)}
SIBLINGS = {("assets", "component"): ["cash", "stock"], ("liabilities", "component"): ["debt", "loans"]}


def fact_rows():
    draw = random.Random(3)
    return [(f"{e}_{y}_{c}", float(draw.randint(-3, 9)), c, e, str(y), *KINDS[c]) for e in ("A", "B") for y in (2020, 2021, 2022) for c in KINDS]


def random_tree(draw, depth, rows):
    if depth == 0 or draw.random() < 0.2:
        if draw.random() < 0.1:
            return {"literal": draw.choice([2, 3, 0.5])}
        return {"leaf": draw.choice(rows)[0] if draw.random() < 0.97 else "nobody_2020_cash"}
    op = draw.choice(meanings.OPERATIONS)
    base = draw.choice(rows)
    near = [r for r in rows if (r[3] == base[3] and r[4] == base[4]) or (r[3] == base[3] and r[2] == base[2])]
    pool = near if draw.random() < 0.8 else rows
    out = {"op": op, "left": random_tree(draw, depth - 1, pool), "right": random_tree(draw, depth - 1, pool)}
    return {"derived": "some_name", "expanded": out} if draw.random() < 0.1 else out


def bound_tree(tree, facts):
    """The tuples of ``analyze``."""
    tree = tree.get("expanded", tree)
    if "leaf" in tree:
        if tree["leaf"] not in facts:
            raise Rejected(f"unknown leaf {tree['leaf']}")
        _, _, concept, entity, period, kind, unit, parent, role = facts[tree["leaf"]]
        return Fact(concept, kind, entity, period, unit, parent, role)
    if "literal" in tree:
        return float(tree["literal"])
    return (tree["op"], bound_tree(tree["left"], facts), bound_tree(tree["right"], facts))


def value_of(tree, facts):
    """What turns take: growth against the left operand; None where something is missing or a denominator is 0."""
    tree = tree.get("expanded", tree)
    if "leaf" in tree:
        return facts[tree["leaf"]][1] if tree["leaf"] in facts else None
    if "literal" in tree:
        return float(tree["literal"])
    parts = [value_of(t, facts) for t in (tree.get("args") or [tree["left"], tree["right"]])]
    if None in parts:
        return None
    a, b, op = parts[0], parts[1], tree["op"]
    if op in ("ratio", "growth") and (b if op == "ratio" else a) == 0:
        return None
    return {"sum": lambda: sum(parts), "diff": lambda: a - b, "mul": lambda: a * b, "ratio": lambda: a / b, "growth": lambda: (b - a) / a, "min": lambda: min(parts), "max": lambda: max(parts), "avg": lambda: sum(parts) / len(parts)}[op]()


def turns_of(tree, facts, whole):
    """The turns of one tree, by the rules of the docstring."""
    out = []

    def leaves(t):
        t = t.get("expanded", t)
        return [t["leaf"]] if "leaf" in t else [] if "literal" in t else [x for c in (t.get("args") or [t["left"], t["right"]]) for x in leaves(c)]

    def visit(t, above, root):
        name, t = t.get("derived"), t.get("expanded", t)
        if "op" not in t:
            return
        for c in t.get("args") or [t["left"], t["right"]]:
            visit(c, t["op"], False)
        if t["op"] in ("min", "max") and above == t["op"]:
            return
        own = [facts[k] for k in leaves(t) if k in facts]
        years = sorted({int(f[4]) for f in own})
        if root and t["op"] in nodes.CROSS:
            text = whole
        elif not years:
            text = None
        elif name:
            text = f"What is {name.replace('_', ' ')} for {own[0][3]} in {years[0]}?"
        else:
            text = f"What is the {nodes.WORDS[t['op']]} of {own[0][2]} for {own[0][3]} from {years[0]} to {years[-1]}?"
        v = value_of(t, facts)
        out.append((len(out) + 1, t["op"], text, None if v is None else round(v, 6), root))

    visit(tree, None, True)
    return out


@pytest.fixture(scope="module")
def forest(spark):
    rows, draw = fact_rows(), random.Random(11)
    facts = {r[0]: r for r in rows}
    trees = [random_tree(draw, draw.randint(0, 4), rows) for _ in range(1500)]
    cash = [{"leaf": f"A_{y}_cash"} for y in (2020, 2021, 2022)]
    for n in (1, 2, 3):  # averages as a sum over a number, of too few, of all and of repeated periods
        total = cash[0]
        for x in cash[1:n]:
            total = {"op": "sum", "left": total, "right": x}
        trees += [{"op": "ratio", "left": total, "right": {"literal": k}} for k in (1, 2, 3)]
    trees += [{"op": "avg", "left": cash[0], "right": cash[1]}, {"op": "ratio", "left": {"op": "sum", "left": cash[0], "right": cash[0]}, "right": {"literal": 2}}]
    questions = spark.createDataFrame([(i, json.dumps(t), f"Q{i}") for i, t in enumerate(trees)], "question_id long, form string, question string")
    made = nodes.bound(nodes.node_table(questions, "question_id", "form"), spark.createDataFrame(rows, FACTS))
    return trees, facts, questions, made


def test_turns_and_values_of_different_trees(forest):
    trees, facts, questions, made = forest
    got: dict[int, list] = {i: [] for i in range(len(trees))}
    for r in nodes.tree_turns(made, questions).orderBy("question_id", "turn_number").collect():
        got[r[0]].append(tuple(r)[1:])
    for i, tree in enumerate(trees):
        want = turns_of(tree, facts, f"Q{i}")
        assert [x[:3] + x[4:] for x in got[i]] == [x[:3] + x[4:] for x in want]
        assert [x[3] for x in got[i]] == pytest.approx([x[3] for x in want], abs=1e-6)
    for r in nodes.tree_values(made).collect():
        assert r.value == pytest.approx(value_of(trees[r.tree], facts), abs=1e-6)


def test_meanings_equal_those_of_single_trees(forest):
    trees, facts, _, made = forest
    kinds = set()
    for r in meanings.tree_meanings(made, SIBLINGS).collect():
        try:
            m = analyze.analyze(bound_tree(trees[r.tree], facts), {k: set(v) for k, v in SIBLINGS.items()})
            want = (m.kind, m.semantic_type, m.text, m.entity, m.period, m.unit, m.concept, m.from_period, m.to_period, None)
        except Rejected as e:
            want = (None,) * 9 + (str(e),)
        if want[-1] is None or not want[-1].startswith("unknown leaf"):
            assert tuple(r)[1:] == want, (trees[r.tree], tuple(r)[1:], want)
        else:
            assert r.error is not None
        kinds.add(want[0] or want[-1])
    assert {"aggregate_components", "sum_amount", "sum_amounts", "difference", "ratio", "scaled_amount", "growth_rate", "growth_rate_composed", "min_over_time", "max_amounts", "avg_over_time", "leaf_metric"} <= kinds


def test_node_numbers_and_odd_forms(spark):
    forms = [
        '{"op": "sum", "args": ["a", {"op": "min", "args": ["b", "c", {"literal": 2}]}, {"leaf": "a"}]}', '{"leaf": "a"}', "{", "", None, '{"op": "sum"}', '{"op": "mul", "left": {"leaf": "a"}, "right": {"what": 1}}',
        '{"derived": "x", "expanded": {"derived": "y", "expanded": {"op": "diff", "left": {"leaf": "a{"}, "right": {"literal": "1e3"}}}}', '{"derived": "bare"}',
    ]
    questions = spark.createDataFrame(list(enumerate(forms)), "k int, f string")
    rows = nodes.node_table(questions, "k", "f").orderBy("tree", "post").collect()
    by = {k: [r for r in rows if r.tree == k] for k in range(len(forms))}
    assert [(r.post, r.size, r.level, r.op, r.parent_op, r.leaf, r.literal, r.arity) for r in by[0]] == [
        (1, 1, 1, None, "sum", "a", None, 0), (2, 1, 2, None, "min", "b", None, 0), (3, 1, 2, None, "min", "c", None, 0), (4, 1, 2, None, "min", None, 2.0, 0), (5, 4, 1, "min", "sum", None, None, 3), (6, 1, 1, None, "sum", "a", None, 0), (7, 7, 0, "sum", None, None, None, 3),
    ]
    assert [len(by[k]) for k in range(len(forms))] == [7, 1, 1, 1, 1, 1, 3, 3, 1]
    assert all(by[k][0].op is None and by[k][0].leaf is None for k in (2, 3, 4, 5, 8))
    assert (by[7][-1].derived, by[7][-1].op, by[7][0].leaf, by[7][1].literal) == ("x", "diff", "a{", 1000.0)
    facts = spark.createDataFrame([("a", 5.0), ("b", 7.0), ("c", None)], "key string, value double")
    values = {r.tree: r.value for r in nodes.tree_values(nodes.bound(nodes.node_table(questions.where("k < 3"), "k", "f"), facts)).collect()}
    assert values == {0: None, 1: 5.0, 2: None}
    assert nodes.node_table(questions.where("k > 99"), "k", "f").count() == 0


def test_leaves_of_each_question(spark):
    """Two questions use one key for different facts."""
    questions = spark.createDataFrame([(1, '{"op": "diff", "left": {"leaf": "x"}, "right": {"leaf": "y"}}'), (2, '{"leaf": "x"}')], "q int, f string")
    leaves = spark.createDataFrame([(1, "x", 5.0), (1, "y", 2.0), (2, "x", 9.0)], "q int, leaf_key string, value double")
    found = nodes.tree_values(nodes.leaf_rows(nodes.node_table(questions, "q", "f"), leaves, "q")).collect()
    assert {r.tree: r.value for r in found} == {1: 3.0, 2: 9.0}


def test_equal_subtrees_are_one(spark, forest):
    trees, facts, questions, made = forest
    table = spark.createDataFrame(list(facts.values()), FACTS)
    plain_nodes = nodes.node_table(questions, "question_id", "form")
    for r in sharing.shared_values(plain_nodes, table).collect():
        assert r.value == pytest.approx(value_of(trees[r.tree], facts), abs=1e-6)
    signs = sharing.signatures(plain_nodes)
    shared = sharing.different(signs)
    assert shared.count() < signs.count() == plain_nodes.count()
    two = spark.createDataFrame([(1, '{"op": "sum", "left": {"leaf": "a"}, "right": {"literal": 2}}'), (2, '{"op": "sum", "left": {"literal": 2.0}, "right": {"leaf": "a"}}'), (3, '{"op": "diff", "left": {"leaf": "a"}, "right": {"literal": 2}}'), (4, '{"op": "diff", "left": {"literal": 2}, "right": {"leaf": "a"}}')], "k int, f string")
    roots = {r.tree: r.sig for r in sharing.signatures(nodes.node_table(two, "k", "f")).where("root").collect()}
    assert roots[1] == roots[2] and len(set(roots.values())) == 3


def test_values_by_texts_are_those_by_trees(spark, forest):
    trees, facts, questions, _ = forest
    table = spark.createDataFrame(list(facts.values()), FACTS)
    again = questions.select((questions.question_id + len(trees)).alias("question_id"), "form")
    found = sharing.form_values(questions.select("question_id", "form").union(again), "question_id", "form", table)
    got = {r.tree: r.value for r in found.collect()}
    assert sorted(got) == list(range(2 * len(trees)))
    for i, value in got.items():
        assert value == pytest.approx(value_of(trees[i % len(trees)], facts), abs=1e-6)
    # texts that differ, and subtrees that are whole texts too
    forms = ['{"leaf": "a"}', '{ "leaf": "a" }', '{"op": "sum", "args": ["a", {"literal": 2}]}', '{"op": "sum", "args": [{"literal": 2}, "a"]}', '{"op": "diff", "left": {"leaf": "a"}, "right": {"op": "sum", "args": ["a", {"literal": 2}]}}', "{", "", None, None, '{"leaf": "no"}']
    table = spark.createDataFrame([("a", 5.0)], "key string, value double")
    found = sharing.form_values(spark.createDataFrame(list(enumerate(forms)), "k int, f string"), "k", "f", table).collect()
    assert [r.value for r in sorted(found)] == [5.0, 5.0, 7.0, 7.0, -2.0, None, None, None, None, None]
    assert sharing.form_values(spark.createDataFrame([], "k int, f string"), "k", "f", table).count() == 0
