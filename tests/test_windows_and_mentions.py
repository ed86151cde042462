"""All windows and mentions against plain loops."""

import random

import pytest

from sheetwright.operators import mentions, windows


def test_all_windows_of_many_lengths(spark):
    draw = random.Random(1)
    rows = [(f"e{n}", p, float(draw.randint(-50, 50))) for n in (0, 1, 2, 3, 8, 9, 17, 33) for p in range(n)]
    got = sorted(map(tuple, windows.all_windows(spark.createDataFrame(rows, "entity string, period int, v double"), "v").collect()))
    want = []
    for e in {r[0] for r in rows}:
        v = [r[2] for r in rows if r[0] == e]
        want += [(e, a, b, min(v[a : b + 1]), max(v[a : b + 1]), round(sum(v[a : b + 1]) / (b - a + 1), 4)) for a in range(len(v)) for b in range(a + 1, len(v))]
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in sorted(want)], abs=1.01e-4)
    assert windows.all_windows(spark.createDataFrame([], "entity string, period int, v double"), "v").count() == 0


def test_mentions_equal_a_nested_loop(spark):
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abé ") for _ in range(n))
    names = [(i, word(draw.randint(1, 7))) for i in range(150)] + [(150, None), (151, ""), (0, "aa")]
    texts = [(i, word(draw.randint(0, 40)) if i % 50 else None) for i in range(300)]
    args = (spark.createDataFrame(texts, "k int, t string"), "k", "t", spark.createDataFrame(names, "o int, n string"), "n", "o")
    want = {(k, n) for k, t in texts if t for _, n in names if n and n in t}
    assert {(r.id, r.name) for r in mentions.pairs(*args, width=3).collect()} == want
    first = {k: min((o, n) for o, n in names if n and n in t)[1] for k, t in texts if t and any(n and n in t for _, n in names)}
    assert {r.k: r.mention for r in mentions.first_mention(*args, width=3).collect()} == first
    assert mentions.first_mention(args[0], "k", "t", args[3].limit(0), "n", "o").count() == 0
