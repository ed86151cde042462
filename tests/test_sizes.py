"""Plans and cells at sizes that the small tables do not reach."""

import duckdb

from sheetwright.operators import mentions
from sheetwright import tree_queries
from sheetwright.plans import binder, nodes, sharing
from sheetwright.sources import files


def broadcast_generators(rows):
    """How many broadcasts of the plan hold exploded rows."""
    lines = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    found = 0
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            found += any("Generate" in x for x in lines[i:below])
    return found


def test_templates_are_not_broadcast(spark, tmp_path):
    spark.range(200).selectExpr("id as tree", """'{"leaf": "taxes", "depth": 0}' as form""").write.parquet(f"{tmp_path}/t")
    facts = spark.createDataFrame([(f"{e}_{y}_taxes", e, y, "taxes") for e in "AB" for y in (2020, 2021)], "key string, entity string, period int, concept string")
    got = binder.bind(spark.read.parquet(f"{tmp_path}/t"), facts, {}, 3)
    assert broadcast_generators(got) == 0
    assert got.count() == 200


def test_grams_of_texts_are_not_broadcast(spark, tmp_path):
    spark.range(300).selectExpr("id", "concat('Did Supplier#', lpad(cast(id as string), 9, '0'), ' ship?') as text").write.parquet(f"{tmp_path}/t")
    spark.range(100).selectExpr("id as o", "concat('Supplier#', lpad(cast(id as string), 9, '0')) as n").write.parquet(f"{tmp_path}/n")
    texts, names = spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/n")
    got = mentions.pairs(texts, "id", "text", names, "n", "o")
    assert broadcast_generators(got) == 0
    assert sorted(r.id for r in got.collect()) == list(range(100))
    # names that differ are told apart by what they are filed under
    assert mentions.filed(names, "n", "o", 4).groupBy("gram").count().where("count > 1").count() == 0


def test_many_names_give_the_same_mentions(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a bcd efghijklm"), (1, "other"), (None, "bcd"), (2, None), (3, "nothing")], "id int, text string")
    names = spark.createDataFrame([(1, "bcd"), (2, "efghijklm"), (3, "a"), (4, "zz")], "o int, n string")
    found = lambda: sorted(map(tuple, mentions.pairs(texts, "id", "text", names, "n", "o").collect()), key=str)
    want = sorted([(1, "bcd", 1), (1, "efghijklm", 2), (1, "a", 3), (None, "bcd", 1)], key=str)
    assert found() == want
    monkeypatch.setattr(mentions, "FEW", 0)
    assert found() == want
    monkeypatch.setattr(mentions, "SCREEN", 0)
    assert found() == want


def test_cells_beyond_the_precision_of_doubles_are_those_of_sql(spark):
    values = [4434996812.1, 612345678901.53, 98765432109876.55, -612345678901.53, -4434996812.1, 0.1, -0.25, 1.0000005, 7.0000015, 2.5e-7, 1234567.8900005, 12345678901.23]
    facts = spark.createDataFrame([("E", "s", f"m{i:02}", 2020, v) for i, v in enumerate(values)], "entity string, section string, metric string, year int, value double")
    info = spark.createDataFrame([("E", "name", "E")], "entity string, field string, value string")
    cells = [line.split(",")[1] for line in files.statement_text(facts, info).first().text.split("\n") if line.startswith("m")]
    sql = duckdb.connect().execute("select " + ", ".join(f"regexp_replace(cast(cast(cast('{v!r}' as double) as decimal(38,6)) as varchar), '0+$', '')" for v in values)).fetchall()[0]
    assert cells == list(sql)


def test_nodes_are_numbered_without_a_shuffle(spark):
    forms = spark.createDataFrame([(1, '{"op": "sum", "args": ["a", {"op": "min", "left": {"leaf": "b"}, "right": {"literal": 2}}, "c"]}'), (2, None)], "id int, form string")
    table = nodes.node_table(forms, "id", "form", 3)
    assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.tree, r.post, r.size, r.level, r.leaf or r.literal or r.op) for r in table.collect())
    assert got == [(1, 1, 1, 1, "a"), (1, 2, 1, 2, "b"), (1, 3, 1, 2, 2.0), (1, 4, 3, 1, "min"), (1, 5, 1, 1, "c"), (1, 6, 6, 0, "sum"), (2, 1, 1, 0, None)]


def test_equal_texts_are_parsed_once(spark, monkeypatch):
    """Trees of 2,000 orders, whose texts are 40: the parser is given 40 rows."""
    form = lambda i: '{"op": "diff", "left": {"leaf": "a"}, "right": {"op": "min", "args": ["b", {"literal": %d}]}}' % (i % 39)
    orders = spark.createDataFrame([(i, form(i) if i % 40 else None) for i in range(2000)], "tree int, form string").distinct()
    facts = spark.createDataFrame([("a", 5.0), ("b", 20.0)], "key string, value double")
    parsed = []

    def read(questions, *rest, own=nodes.node_arrays):
        parsed.append(questions.count())
        return own(questions, *rest)

    for module in (nodes, sharing):
        monkeypatch.setattr(module, "node_arrays", read)
    monkeypatch.setattr(tree_queries, "forms", lambda *_: orders)
    monkeypatch.setattr(tree_queries, "facts", lambda *_: facts)
    got = tree_queries.shared_values(spark, None).collect()
    assert parsed == [40]
    assert {r.tree: r.value for r in got} == {i: 5.0 - min(20.0, i % 39) if i % 40 else None for i in range(2000)}
    assert len(got) == 2000


def test_nodes_are_made_once_for_their_signatures(spark):
    forms = spark.createDataFrame([(1, '{"op": "sum", "left": {"leaf": "a"}, "right": {"literal": 2}}'), (2, None)], "id int, form string").distinct()
    for rows in (nodes.node_table(forms, "id", "form", 3), sharing.signatures(nodes.node_table(forms, "id", "form", 3))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter" not in plan  # it would parse or sign a second time


def test_values_of_texts_are_rounded_as_in_sql(spark):
    values = [53647234.5567015, 547215757.5200005, 4377445368.43, 11891715403.792099, 13395433774.715311, 1189602085.2415045, -4455327522.72, 2.6146845810437427e18, 1e305, 0.0000005, -1e-9, 1.0000005]
    forms = spark.createDataFrame([(i, '{"leaf": "k%d"}' % i) for i in range(len(values))], "tree int, form string")
    facts = spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(values)], "key string, value double")
    got = [r.value for r in sharing.form_values(forms, "tree", "form", facts).orderBy("tree").collect()]
    sql = duckdb.connect().execute("select " + ", ".join(f"round(cast('{v!r}' as double), 6) + 0" for v in values)).fetchall()[0]
    assert list(map(repr, got)) == list(map(repr, sql))
