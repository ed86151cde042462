"""Near-duplicate texts by wide SimHash against brute force over all pairs."""

import random

import numpy as np
import pytest

from sheetwright.llm.common import Scratch
from sheetwright.llm.near_texts import Plan, angle, forests, near_texts, shingle_sets, shingles, sketch

VOCABULARY = [f"w{i}" for i in range(3000)]


def edited(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


def corpus(seed, n=300):
    """Texts with some near copies of each grade."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(words))
        if rng.random() < 0.5:
            texts += [" ".join(edited(rng, words, rng.choice([0.002, 0.01, 0.02, 0.04, 0.1]))) for _ in range(rng.randint(1, 3))]
    return texts


def classes(rows):
    return {r.doc_id: r.component_id for r in rows}


def components_of(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_shingles_are_sets_of_hashed_words():
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a b")) == 1 and len(shingles(" ")) == 0
    assert shingles("A b\tC d e").tolist() == shingles("a b c  d e").tolist()
    assert len(shingles("a b c d e " * 50)) == 5


def test_bits_differ_as_often_as_the_angle_says():
    rng, plan = random.Random(3), Plan.of(1 << 16)
    off = []
    for _ in range(60):
        words = [rng.choice(VOCABULARY) for _ in range(400)]
        a, b = " ".join(words), " ".join(edited(rng, words, 0.02))
        x, y = shingles(a), shingles(b)
        similarity = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        differ = np.bitwise_count(sketch(a, plan)[0] ^ sketch(b, plan)[0]).sum()
        off.append(differ / (plan.width * plan.segments) - angle(similarity))
    assert abs(np.mean(off)) < 0.01


def test_forests_connect_at_every_threshold():
    """Against all pairs: the first forest for each distance, the second without the first one's edges."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (6, 4), dtype=np.uint64)
    flips = np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, (40, 4), dtype=np.uint64) for _ in range(4)])
    prints = base[rng.integers(0, 6, 40)] ^ flips
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    one, both = list(forests(prints, 40, 1)), list(forests(prints, 40, 2))
    assert both[: len(one)] == one and len({frozenset(x[:2]) for x in both}) == len(both)
    assert all(d == apart[i, j] <= 40 for i, j, d in both)
    gone = {frozenset(x[:2]) for x in one}
    for edges, barred in ((one, set()), (both[len(one) :], gone)):
        for radius in range(0, 41, 5):
            brute = [(i, j) for i in range(40) for j in range(i) if apart[i, j] <= radius and frozenset((i, j)) not in barred]
            assert components_of(40, [(i, j) for i, j, d in edges if d <= radius]) == components_of(40, brute)


def alike_pairs(texts):
    """Pairs (i, j), j < i, of texts whose sets of shingles have a similarity of 0.8 or more."""
    sets = [set(shingles(t).tolist()) for t in texts]
    return [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]


@pytest.mark.parametrize("seed", [0, 1])
def test_components_against_all_pairs(spark, seed):
    texts = corpus(seed)
    alike = alike_pairs(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = classes(near_texts(docs, Scratch(spark, "t")).collect())
    brute = components_of(len(texts), alike)
    assert all(brute[i] == brute[found[i]] for i in found)  # nothing is linked below the similarity
    assert sum(found[i] == found[j] for i, j in alike) >= 0.95 * len(alike) and len(alike) > 80


def test_a_crowded_group_is_one_class(spark):
    """Dealt to small groups that only leaders and other keys connect, against all pairs."""
    rng = random.Random(5)
    base = [rng.choice(VOCABULARY) for _ in range(400)]
    texts = [" ".join(base), *(" ".join(edited(rng, base, 0.01)) for _ in range(500)), *(" ".join(rng.choice(VOCABULARY) for _ in range(100)) for _ in range(50))]
    brute = components_of(len(texts), alike_pairs(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = classes(near_texts(docs, Scratch(spark, "t"), crowd=20, leaders=8).collect())
    assert all(brute[i] == brute[found[i]] for i in found)
    assert sum(found[i] == b for i, b in enumerate(brute)) >= 0.99 * len(texts)
    assert found == classes(near_texts(docs, Scratch(spark, "t"), crowd=20, leaders=8).collect())


def test_texts_below_the_similarity_stay_apart(spark):
    """Pairs of about .7 lie within the radius at times; a chain of links over .8 still joins its ends."""
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        words = [rng.choice(VOCABULARY) for _ in range(200)]
        texts += [" ".join(words), " ".join(words[34:] + [rng.choice(VOCABULARY) for _ in range(34)])]  # 162 of 230 shingles
    words = [rng.choice(VOCABULARY) for _ in range(300)]
    for _ in range(6):
        texts.append(" ".join(words))
        words = words[15:] + [rng.choice(VOCABULARY) for _ in range(15)]
    found = classes(near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Scratch(spark, "t")).collect())
    assert [found[i] for i in range(120)] == list(range(120))
    assert [found[i] for i in range(120, 126)] == [120] * 6


def test_repeated_rows_are_verified_once(spark):
    rng = random.Random(4)
    words = [rng.choice(VOCABULARY) for _ in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"]))] * 2000
    scratch = Scratch(spark, "t")
    found = near_texts(spark.createDataFrame(rows, "doc_id long, text string"), scratch)
    assert found.where("component_id = 1").count() == 4000
    sets = shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1,), (2,)], "node long"), "doc_id", "text", 5)
    assert sets.count() == 2


def test_odd_rows(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(VOCABULARY) for _ in range(100_000))
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one"), (9, "ONE"), (10, "one two"), (11, long), (12, long + " x"), (None, "one"), (None, "alone here"), (8, "one")]
    docs = spark.createDataFrame([(i, t, 1, "c", "k") for i, t in rows], "doc_id long, text string, node int, close string, key string")
    found = near_texts(docs, Scratch(spark, "t")).collect()
    assert len(found) == len(rows)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == sorted(
        [("5", "5"), ("6", "5"), ("7", "5"), ("8", "8"), ("8", "8"), ("9", "8"), ("10", "10"), ("11", "11"), ("12", "11"), ("None", "8"), ("None", "None")]
    )
    assert near_texts(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_every_pair_that_meets_in_different_classes_is_looked_for(spark):
    from sheetwright.llm.near_texts import _columns, unmet

    rng, plan = np.random.default_rng(5), Plan.of(40)
    used = plan.width * plan.segments
    bits = np.zeros((40, plan.words * 64), dtype=np.uint8)
    bits[:, :used] = rng.integers(0, 2, used)
    for i in range(40):  # many of them more than the radius apart
        flipped = rng.choice(used, rng.integers(0, plan.radius * 5 // 4), replace=False)
        bits[i, flipped] ^= 1
    prints = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    points = spark.createDataFrame([(i, *map(int, prints[i])) for i in range(40)], ", ".join(["node long", *(f"{c} long" for c in _columns(plan))]))
    members = spark.createDataFrame([(key, i, 40 if key == 1 else 10) for key in (1, 2) for i in range(40 if key == 1 else 10)], "key long, node long, n long")
    roots = {i: i // 3 * 3 for i in range(30)}
    apart = lambda i, j: int((bits[i] != bits[j]).sum())
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if apart(i, j) <= plan.radius and roots.get(i, i) != roots.get(j, j)}
    assert 0 < len(want) < 40 * 39 // 2 - 100
    for block in (1, 7, 1000):
        got = [tuple(r) for r in unmet(members, points, spark.createDataFrame(list(roots.items()), "node long, root long"), plan, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_crowds_dealt_apart_are_linked_all_the_same(spark):
    rng = random.Random(8)
    words = [rng.choice(VOCABULARY) for _ in range(400)]
    texts = [" ".join(edited(rng, words, 0.004)) for _ in range(12)]
    sets = [set(shingles(t).tolist()) for t in texts]
    linked = [(i, j) for i in range(12) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    got = near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Scratch(spark, "near"), crowd=1e-4, leaders=0)
    assert classes(got.collect()) == dict(enumerate(components_of(12, linked)))


def test_rows_of_a_group_below_the_similarity_grow_with_it_and_not_its_square(spark, monkeypatch):
    """Pairs of about .74 within the radius, which no link joins, and a few links over .8: no table of pairs has a row for each of them."""
    rng, written = random.Random(11), {}
    base, n = [rng.choice(VOCABULARY) for _ in range(400)], 240

    def changed(words, times):
        out = list(words)
        for at in rng.sample(range(len(words)), times):
            out[at] = rng.choice(VOCABULARY)
        return out

    texts = [changed(base, 7) for _ in range(n)]
    texts = [" ".join(x) for x in [*texts, *(changed(x, 2) for x in texts[:20])]]
    table = Scratch.table

    def counted(self, df, name):
        out = table(self, df, name)
        if out.columns[:2] == ["a", "b"]:
            written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    docs, alike = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), alike_pairs(texts)
    brute = components_of(len(texts), alike)
    for crowd in (256, 20):
        found = classes(near_texts(docs, Scratch(spark, "t"), crowd=crowd).collect())
        assert all(brute[i] == brute[found[i]] for i in found) and sum(found[i] == found[j] for i, j in alike) >= 0.95 * len(alike)
    assert len(set(brute)) > n // 2 and len(alike) >= 20
    assert max(rows for name, rows in written.items() if name != "candidates") <= 2 * len(texts), written


@pytest.mark.parametrize("part", [1, 7, 1000])
def test_late_links_join_what_all_pairs_within_the_radius_join(spark, part):
    """Classes of more than a part, small ones, circles of one class and a text of two sets, against all pairs."""
    from pyspark.sql import functions as F

    from sheetwright.llm.near_texts import _columns, late_links

    rng, plan = np.random.default_rng(3), Plan.of(60)
    sets = {i: sorted({*range(100), *map(int, rng.integers(1000, 9000, rng.integers(0, 30)))} - set(map(int, rng.integers(0, 100, 8)))) for i in range(60)}
    sets[59] = []
    circle, roots = {i: i % 3 for i in range(60)}, {i: i % 3 for i in range(60) if i % 3 == 2 or i < 30}
    prints = np.zeros((60, plan.words), dtype=np.int64)
    prints[50:, 0] = -1  # too far from the others, with all bits of many words
    prints[50:] = -1
    points = spark.createDataFrame([(i, *map(int, prints[i])) for i in range(60)], ", ".join(["node long", *(f"{c} long" for c in _columns(plan))]))
    rows = spark.createDataFrame([(i, sets[i]) for i in range(60)] + [(3, sets[40])], "node long, grams array<long>")
    alike = lambda x, y: len({*x} & {*y}) / max(1, len({*x} | {*y})) >= 0.8
    held = {i: [sets[i], *([sets[40]] if i == 3 else [])] for i in range(60)}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if circle[i] == circle[j] and (i < 50) == (j < 50) and any(alike(x, y) for x in held[i] for y in held[j])}
    pairs = lambda d: spark.createDataFrame(list(d.items()), "node long, root long")
    known = [(i, r) for i, r in roots.items()]
    got = [tuple(r) for r in late_links(pairs(circle).withColumnRenamed("root", "circle"), pairs(roots), points, rows, plan, Scratch(spark, "t"), 0.8, part).select(F.col("a"), F.col("b")).collect()]
    assert got and set(got) <= want and all(circle[a] != 2 for a, _ in got)
    assert components_of(60, [*known, *got]) == components_of(60, [*known, *want])
