"""The running controller against the loop that it stands for."""

import random

import numpy as np
import pytest

from sheetwright.operators import controller


def loop(bits, target, start=0, first=0):
    count, needed, out = start, [], []
    for i, b in enumerate(bits):
        need = count / (first + i + 1) < target
        needed.append(need)
        out.append(need or b)
        count += out[-1]
    return needed, out, count


@pytest.mark.parametrize("seed", range(12))
def test_maps_compose(seed):
    draw = random.Random(seed)
    target, share = draw.choice([0.0, 0.1, 0.35, 0.5, 0.9, 1.0]), draw.random()
    first = draw.choice([0, 3, 200])
    a, b = ([draw.random() < share for _ in range(draw.randint(1, 60))] for _ in range(2))
    one = controller.map_of_rows(first, np.array(a), target)
    two = controller.map_of_rows(first + len(a), np.array(b), target)
    both = controller.then(one, two)
    for start in range(first + 1):
        assert controller.apply_map(one, np.array([start]))[0] == loop(a, target, start, first)[2]
        assert controller.apply_map(both, np.array([start]))[0] == loop(a + b, target, start, first)[2]


@pytest.mark.parametrize(("n", "share", "low", "high"), [(500, 0.3, 0.4, 0.6), (700, 0.8, 0.2, 0.3), (65, 0.0, 0.1, 0.1), (1, 1.0, 0.0, 1.0)])
def test_the_scan_equals_the_loop(spark, monkeypatch, n, share, low, high):
    """With groups of eight: up to four rounds up and down."""
    monkeypatch.setattr(controller, "WIDE", 8)
    draw = random.Random(n)
    bits = [draw.random() < share if draw.random() < 0.95 else None for _ in range(n)]
    order = list(range(n))
    draw.shuffle(order)
    rows = spark.createDataFrame([(i, bits[i], "x") for i in order], "at long, own boolean, place string")
    got = controller.controlled(rows.withColumnRenamed("place", "kept"), "at", "own", n, low, high).orderBy("at").collect()
    needed, derived, _ = loop([bool(b) for b in bits], (low + high) / 2)
    assert [(r.needed, r.derived, r.kept) for r in got] == [(a, b, "x") for a, b in zip(needed, derived, strict=True)]


def test_bad_shares_and_no_row(spark):
    rows = spark.createDataFrame([], "at long, own boolean")
    assert controller.controlled(rows, "at", "own", 0, 0.1, 0.2).count() == 0
    with pytest.raises(ValueError):
        controller.controlled(rows, "at", "own", 0, 0.5, 0.2)
