"""PPM code lengths against a slow direct definition, and held-out accuracy."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwright.llm.langid import BIT, Model, Tree, fit, identify, windows

SYLLABLES = {"xx": ["ka", "to", "mi", "ru"], "yy": ["ble", "tion", "the", "ing"], "zz": ["été", "où", "ñu", "ße"]}


def sentence(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def slow_bits(texts, text):
    counts = defaultdict(lambda: defaultdict(int))
    for t in texts:
        data = b"\n\n\n" + t
        for i in range(3, len(data)):
            for k in range(4):
                counts[data[i - k : i]][data[i]] += 1
    data, bits = b"\n\n\n" + text, 0.0
    for i in range(3, len(data)):
        gone = set()
        for k in range(3, -1, -1):
            offered = {b: n for b, n in counts.get(data[i - k : i], {}).items() if b not in gone}
            if not offered:
                continue
            whole = sum(offered.values()) + len(offered)
            if data[i] in offered:
                bits += math.log2(whole / offered[data[i]])
                break
            bits += math.log2(whole / len(offered))
            gone |= set(offered)
        else:
            bits += math.log2(256 - len(gone))
    return bits


def test_code_lengths_are_exact():
    rng = random.Random(4)
    texts = [sentence(rng, "xx").encode() for _ in range(20)]
    model = Model(["xx"], [Tree.grow(texts)])
    for probe in (sentence(rng, "xx").encode(), sentence(rng, "zz").encode(), b"q", bytes(range(256))):
        assert model.score([probe])[0, 0] / BIT == pytest.approx(slow_bits(texts, probe), abs=0.01)


def test_probabilities_sum_to_one():
    rng = random.Random(5)
    tree = Tree.grow([sentence(rng, "yy").encode() for _ in range(9)])
    for context in [*(windows(np.frombuffer(sentence(rng, "yy").encode(), dtype=np.uint8)) >> 8)[::11], 0, 0x010203]:
        grams = (np.uint32(context) << np.uint32(8)) | np.arange(256, dtype=np.uint32)
        assert (2.0 ** -tree.code_lengths(grams)).sum() == pytest.approx(1.0)


def test_sums_do_not_depend_on_batches_or_the_table():
    rng = random.Random(6)
    trees = [Tree.grow([sentence(rng, x).encode()]) for x in ("xx", "yy")]
    texts = [sentence(rng, rng.choice("xyz") * 2, rng.randint(0, 90)).encode() for _ in range(60)] + [b"", b"long " * 700_000]
    whole = Model(["xx", "yy"], trees).score(texts)
    small = Model(["xx", "yy"], trees, slot_bits=12)
    assert (whole == np.concatenate([small.score([t]) for t in texts])).all()


def test_identify(spark):
    rng = random.Random(7)
    rows = [(i, sentence(rng, x), x, "clash") for i, x in enumerate(["xx", "yy", "zz"] * 60)]
    rows += [(900, None, "xx", ""), (901, "", "xx", ""), (902, "12 34 !!", None, ""), (903, sentence(rng, "zz", 20_000), None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = fit(frame.where("doc_id % 2 = 0"), "lang", "text", "doc_id")
    found = {r.doc_id: r for r in identify(frame, model, ["doc_id"]).collect()}
    assert len(found) == len(rows)
    assert sum(found[i].lang_pred == x for i, _, x, _ in rows[:180]) >= 178
    assert [found[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "zz"]
    assert all(0 <= r.score <= 1 for r in found.values())
    assert found[901].score == 0


def test_a_language_of_long_texts_only_is_learned(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, "xx", 20_000), "xx") for i in range(8)] + [(100 + i, sentence(rng, "yy"), "yy") for i in range(22)]
    assert min(len(t) for _, t, x in rows if x == "xx") > 1 << 16
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for budget in (1_500_000, 100_000, 1):  # whole texts, some pieces, and one piece at least
        found = {r.doc_id: r.lang_pred for r in identify(frame, fit(frame, "lang", "text", "doc_id", budget), ["doc_id"]).collect()}
        assert all(found[i] == x for i, _, x in rows)


def test_six_hundred_languages(spark):
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x3042 + i % 80)} " * 12, f"l{i:03}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(frame, "lang", "text", "doc_id")
    assert len(model.languages) == 600
    few = frame.where("doc_id % 60 = 0")
    assert {r.doc_id: r.lang_pred for r in identify(few, model, ["doc_id"]).collect()} == {i: f"l{i:03}" for i in range(0, 600, 60)}


def test_identify_without_labels_or_rows(spark):
    frame = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = fit(frame, "lang", "text", "doc_id")
    assert identify(frame, model, ["doc_id"]).first().lang_pred == "und"
    assert identify(frame.limit(0), model, ["doc_id"]).count() == 0


def test_held_out_accuracy_on_the_tables(spark):
    from sheetwright.llm.queries import op3_langid

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = op3_langid(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out and lang is not null")
    hits = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert hits > 0.95
