"""Tool-call linking against hand-made conversations."""

import json
import random

import pytest

from sheetwright.llm.common import Scratch
from sheetwright.llm.tool_chat import link, places

TOOLS = {"find": {"q": ("string", True, 1, 10), "n": ("integer", False, 0, 5)}, "sum": {"x": ("number", True, None, None)}}
CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>, status string"
RESULTS = "conv_id long, turn long, call_id string, content string, level int"


def linked(spark, calls, results):
    return link(spark.createDataFrame([(*c, "clash") for c in calls], CALLS), spark.createDataFrame([(*r, 3) for r in results], RESULTS), TOOLS, Scratch(spark, "t")).collect()


def test_links_statuses_and_json(spark):
    calls = [
        (1, 0, "a", "find", '{"q":"été \\"x\\""}', []), (1, 2, "b", "find", '{"q":"y","n":3}', ["a"]), (1, 2, "b", "find", '{"q":"z"}', None),
        (1, 4, None, "sum", None, []), (2, 0, "a", "sum", '{"x":1.5}', []), (None, 0, "a", "nope", "[]", []),
    ]
    results = [(1, 1, "a", 'said "é"\n'), (1, 3, "b", None), (1, 3, "b", "again"), (1, 5, "zz", "lost"), (1, 6, None, "")]
    rows = linked(spark, calls, results)
    assert len(rows) == len(calls) + len(results)
    status = {(r.kind, r.conv_id, r.turn, r.call_id, r.json[:30]): r.status for r in rows}
    get = lambda kind, *at: sorted(v for k, v in status.items() if k[:4] == (kind, *at))
    assert get("call", 1, 0, "a") == ["linked"] and get("call", 2, 0, "a") == ["unanswered"]
    assert get("call", 1, 2, "b") == ["linked", "repeated"] and get("call", 1, 4, None) == ["unanswered"]
    assert get("result", 1, 1, "a") == ["linked"] and get("result", 1, 5, "zz") == ["orphan"] and get("result", 1, 6, None) == ["orphan"]
    for r in rows:
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    assert {json.loads(r.json)["content"] for r in rows if r.kind == "result"} == {'said "é"\n', None, "again", "lost", ""}


@pytest.mark.parametrize(
    ("name", "arguments", "errors"),
    [
        ("find", '{"q":"ok"}', []), ("find", '{"q":"ok","n":5}', []), ("find", '{"n":9}', ["n: too large", "q: missing"]), ("find", '{"q":"","n":"x"}', ["n: not integer", "q: too small"]),
        ("find", '{"q":"much too long"}', ["q: too large"]), ("find", '{"q":"a","z":1}', ["z: not in schema"]), ("find", "oops", ["not an object"]), ("find", None, ["q: missing"]),
        ("find", '{"q":5}', ["q: not string"]), ("find", '{"q":true}', ["q: not string"]), ("find", '{"q":{"x":1}}', ["q: not string"]), ("find", '{"q":["a"]}', ["q: not string"]),
        ("find", '{"q":"a","n":"3"}', ["n: not integer"]), ("find", '{"q":"a","n":2.5}', ["n: not integer"]), ("find", '{"q":"a","n":1e0}', ["n: not integer"]), ("find", '{"q":"a","q":"b"}', ["not an object"]),
        ("find", '{"q":"a","n":123456789012345678901234567890}', ["n: too large"]), ("find", "[1]", ["not an object"]), ("find", '"q"', ["not an object"]), ("sum", '{"x":"1"}', ["x: not number"]),
        ("sum", '{"x":-2.5e3}', []), ("sum", '{"x":3}', []), ("sum", '{"x":null}', ["x: missing"]), ("other", "{}", ["unknown tool"]), (None, "{}", ["unknown tool"]),
    ],
)
def test_arguments(spark, name, arguments, errors):
    from sheetwright.llm.tool_chat import argument_errors
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(name, arguments)], "name string, arguments string").select(argument_errors(F.col("name"), F.col("arguments"), TOOLS).alias("e")).first()
    assert row.e == errors


def test_order(spark):
    ok = '{"x":1}'
    chain = [(7, i, f"c{i}", "sum", ok, [f"c{i - 1}"]) for i in range(150)]
    late = [(8, 0, "a", "sum", ok, ["b", "gone"]), (8, 1, "b", "sum", ok, ["c"]), (8, 2, "c", "sum", ok, []), (8, 3, "d", "sum", ok, ["a"])]
    cycle = [(9, 0, "a", "sum", ok, ["b"]), (9, 1, "b", "sum", ok, ["a"]), (9, 2, "c", "sum", ok, ["b"]), (9, 3, "e", "sum", ok, [])]
    rows = {(r.conv_id, r.call_id): r for r in linked(spark, chain + late, [(8, 5, "a", "x")]) if r.kind == "call"}
    assert [(rows[7, f"c{i}"].due, rows[7, f"c{i}"].level) for i in range(150)] == [(i, 0) for i in range(150)]
    assert (rows[8, "d"].due, rows[8, "d"].level) == (3, 0)
    order = sorted((k[1] for k in rows if k[0] == 8), key=lambda c: (rows[8, c].due, rows[8, c].level, rows[8, c].turn))
    assert order == ["c", "b", "a", "d"]
    rows = {r.call_id: r.level for r in link(spark.createDataFrame([(*c, "") for c in cycle], CALLS), spark.createDataFrame([], RESULTS), TOOLS, Scratch(spark, "t")).collect()}
    assert rows == {"a": -1, "b": -1, "c": 0, "e": 0}


def slow_places(calls):
    """(due, level) by id, by repeated passes over all calls of one conversation."""
    turn = {c: t for t, c, _ in calls}
    needs = {c: [n for n in set(after) if n in turn] for _, c, after in calls}
    due = dict(turn)
    for _ in calls:
        due = {c: max([due[c], *(due[n] for n in needs[c])]) for c in due}
    same = {c: [n for n in needs[c] if due[n] == due[c]] for c in due}
    level, left = {}, set(due)
    while ready := {c for c in left if all(n in level for n in same[c])}:
        level |= {c: max([level[n] + 1 for n in same[c]], default=0) for c in ready}
        left -= ready
    return {c: (due[c], level.get(c, -1)) for c in due}


def placed(spark, calls):
    rows = [(1, t, c, "sum", '{"x":1}', after, "") for t, c, after in calls]
    scratch = Scratch(spark, "t")
    made = places(spark.createDataFrame(rows, CALLS), scratch)
    found = {r.call_id: (r.due, r.level) for r in made.collect()}
    return {c: found.get(c, (t, 0)) for t, c, _ in calls}


@pytest.mark.parametrize("seed", range(4))
def test_places_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"c{i}" for i in range(14)]
    calls = [(rng.randrange(10), c, [rng.choice(names) for _ in range(rng.choice([0, 1, 1, 2]))]) for c in names]
    assert placed(spark, calls) == slow_places(calls)


def test_long_chains_and_cycles_take_few_rounds(spark, monkeypatch):
    wrote = []
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, old=Scratch.table: wrote.append(name) or old(self, df, name))
    chain = [(i, f"c{i}", [f"c{i + 1}"]) for i in range(100)]
    cycle = [(i, f"c{i}", [f"c{(i + 1) % 60}"]) for i in range(60)]
    for calls in (chain, cycle):
        wrote.clear()
        assert placed(spark, calls) == slow_places(calls)
        assert len(wrote) <= 45


def test_null_conversations_link_to_nothing(spark):
    calls = spark.createDataFrame([(None, 1, "c1", "sum", '{"x":1}', ["c2"], ""), (None, 1, "c1", "sum", '{"x":1}', [], ""), (2, 1, "c1", "sum", '{"x":1}', [], "")], CALLS)
    results = spark.createDataFrame([(None, 2, "c1", "r", 0), (2, 2, "c1", "r", 0), (2, 3, None, "r", 0)], RESULTS)
    rows = link(calls, results, TOOLS, Scratch(spark, "t")).collect()
    assert sorted((r.conv_id or 0, r.kind, r.status, r.due) for r in rows) == [(0, "call", "unanswered", 1), (0, "call", "unanswered", 1), (0, "result", "orphan", 2), (2, "call", "linked", 1), (2, "result", "linked", 1), (2, "result", "orphan", 3)]


def test_plain_messages(spark):
    said = spark.createDataFrame([(1, 0, "system", "be kind", 1), (1, 3, None, None, 2), (None, None, "tool", "", 3)], "conv_id long, turn long, role string, content string, json int")
    rows = link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), TOOLS, Scratch(spark, "t"), said).collect()
    assert sorted(r.json for r in rows) == ['{"content":"","role":"tool"}', '{"content":"be kind","role":"system"}', '{"content":null,"role":null}']
    assert {(r.kind, r.status, r.due, r.level) for r in rows} == {("message", "plain", 0, 0), ("message", "plain", 3, 0), ("message", "plain", None, 0)}


def test_empty(spark):
    assert linked(spark, [], []) == []
