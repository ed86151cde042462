"""Segment-partition edit join against all pairs."""

import random

import pytest

from sheetwright.llm.common import Scratch
from sheetwright.llm.line_dedup import INDEX, drop_near_lines, line_report, marked_lines, signatures, threshold, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, edits):
    out = list(line)
    for _ in range(edits):
        i, kind = rng.randrange(len(out) + 1), rng.randrange(3)
        if kind == 0 or i == len(out):
            out.insert(i, rng.choice("xyé"))
        elif kind == 1:
            out.pop(i)
        else:
            out[i] = rng.choice("xyé")
    return "".join(out)


def test_distance_and_signatures():
    rng = random.Random(1)
    for t in range(4000):
        a = "".join(rng.choice("ab" if t % 2 else "abcdef") for _ in range(rng.randint(0, 40)))
        b = edited(rng, a, rng.randint(0, 4))
        d = distance(a, b)
        assert [within(a, b, k) for k in range(4)] == [d <= k for k in range(4)], (a, b)
        short, long = sorted((a, b), key=len)
        if 0 < d <= threshold(len(short)):
            assert any(x[0] == y[0] for x in signatures(short, 2) if x[1] == INDEX for y in signatures(long, 2))


@pytest.mark.parametrize("crowd", [400, 3])
def test_lines_against_all_pairs(spark, crowd):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(7, 50))).strip("  ") + "end" for _ in range(20)]
    texts = []
    for _ in range(110):
        texts.append("\n".join(rng.choice([edited(rng, rng.choice(base), rng.randint(0, 3)), "short line", "short lime", "", " \t"]) for _ in range(rng.randint(0, 6))))
    texts += [None, "", base[0], base[0], "\n".join([base[1]] * 50), "word " * 20_000]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, lid int, line int")
    flat = [(i, k, x) for i, t in enumerate(texts) if t is not None for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    kinds = sorted({x for *_, x in flat})
    root, near = {x: x for x in kinds}, {x: 0 for x in kinds}
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= min(2, min(len(a), len(b)) // 10):
                near[a], near[b] = near[a] + 1, near[b] + 1
    assert sum(near[x] > 0 and len(x) < 30 for x in kinds) > 10
    moved = True
    while moved:
        moved = False
        for i, a in enumerate(kinds):
            for b in kinds[:i]:
                if root[a] != root[b] and abs(len(a) - len(b)) <= 2 and distance(a, b) <= min(2, min(len(a), len(b)) // 10):
                    root[a] = root[b] = min(root[a], root[b])
                    moved = True
    first, want = {}, {}
    for i, k, x in flat:
        want[i, k] = first.setdefault(root[x], (i, k)) != (i, k)
    rows = marked_lines(frame, Scratch(spark, "t"), crowd=crowd).collect()
    assert {(r.id, r.line_no): r.duplicate for r in rows if r.class_id is not None} == want
    report = {r.doc_id: r for r in line_report(frame, Scratch(spark, "t"), crowd=crowd).collect()}
    assert len(report) == len(texts)
    for i, t in enumerate(texts):
        own = [(k, x) for j, k, x in flat if j == i]
        assert (report[i].n_lines, report[i].n_duplicates) == (len(own), sum(want[i, k] for k, _ in own))
        assert report[i].n_links == sum(near[x] for x in {x for _, x in own})
        assert len(report[i].class_ids) == len({root[x] for _, x in own})
        assert report[i].kept_chars == sum(len(x) for k, x in own if not want[i, k])
    clean = {r.doc_id: r.text for r in drop_near_lines(frame, Scratch(spark, "t")).collect()}
    for i, t in enumerate(texts):
        assert clean[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not want.get((i, k))))


def test_empty_table_and_repeated_rows(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert line_report(frame, Scratch(spark, "t")).count() == 0
    line = "a line that is long enough to be looked at"
    frame = spark.createDataFrame([(None, line), (1, line), (1, line)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_duplicates) for r in line_report(frame, Scratch(spark, "t")).collect()) == [("1", 1), ("1", 1), ("None", 0)]


def test_a_group_of_lines_that_share_a_segment_is_screened(spark):
    """Lines that share two thirds and differ by more than two edits: no links, and no pair is verified one by one."""
    rng = random.Random(4)
    head = "the same beginning of every line, and more of it, "
    lines = sorted({head + "".join(rng.choice("abcdefghijklmnop") for _ in range(25)) for _ in range(1500)})
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    assert {(r.n_links, r.n_duplicates) for r in line_report(frame, Scratch(spark, "t")).collect()} == {(0, 0)}
    pairs = [(i, x) for i, x in enumerate([head + f"{k:03d}" for k in range(300)])]
    found = line_report(spark.createDataFrame(pairs, "doc_id long, text string"), Scratch(spark, "t"), crowd=40).collect()
    texts = dict(pairs)
    for r in found:
        assert r.n_links == sum(distance(texts[r.doc_id][-3:], t[-3:]) <= 2 for i, t in pairs if i != r.doc_id)
