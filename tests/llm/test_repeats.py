"""Repeated byte strings: against a plain version that looks at every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sheetwright.llm import repeats
from sheetwright.llm.common import Scratch
from sheetwright.llm.repeats import joined_spans, remove_repeats, repeat_report, runs_of


def plain(texts, depth):
    """(bytes, removed, spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + depth] for d in data for i in range(len(d) - depth + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - depth + 1):
            if times[d[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, bytes(x for x, g in zip(d, gone, strict=True) if not g)))
    return out


def found(spark, texts, depth, step):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(remove_repeats(docs, Scratch(spark, "test"), depth, step).collect())
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    return [(r.n_bytes, sum(r.ends) - sum(r.begins), len(r.begins), bytes(r.kept)) for r in rows]


def texts_of(seed, n, letters, longest):
    """Texts that are copied, cut, joined and edited from a few pieces."""
    draw = random.Random(seed)
    pieces = ["".join(draw.choice(letters) for _ in range(draw.randint(1, longest))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(draw.randint(0, 4)):
            p = draw.choice(pieces)
            i = draw.randrange(len(p))
            p = p[i:] if draw.random() < 0.5 else p[: i + 1]
            if draw.random() < 0.3:
                k = draw.randrange(len(p))
                p = p[:k] + draw.choice(letters) + p[k + 1 :]
            parts += [p, "".join(draw.choice(letters) for _ in range(draw.randint(0, 5)))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize(("seed", "letters", "depth", "step"), [(1, "ab", 8, 3), (2, "abcdefghij", 16, 4), (3, "aé漢", 12, 12), (4, "abc", 9, 1)])
def test_random_texts(spark, seed, letters, depth, step):
    texts = texts_of(seed, 60, letters, 80)
    assert found(spark, texts, depth, step) == plain(texts, depth)


def test_copies_runs_of_one_letter_periods_and_short_texts(spark):
    base = "".join(random.Random(5).choice("abcdefgh ") for _ in range(300))
    texts = ["a" * 200, "a" * 15, "a" * 16, "abc" * 40, "bca" * 7, base, base, base[:150] + "X" + base[150:], "Y" + base[20:60], base[:30], "", None, "z" * 16 + base[:15]]
    assert found(spark, texts, 16, 4) == plain(texts, 16)


def test_production_depth_and_a_long_text(spark):
    """A text over several stretches, with repeats across their borders, of itself and of others; repeats of 399 bytes stay."""
    draw = np.random.default_rng(7)
    words = lambda n: bytes(draw.integers(97, 123, n, dtype=np.uint8)).decode()
    passage, edge = words(900), words(400)
    border = repeats.STRETCH - repeats.DEPTH
    long = words(border - 200) + passage + words(border - 900) + edge + words(1000) + passage[:399]
    texts = [long, words(500) + edge + words(500), passage[100:500], words(50) + passage[10:409] + words(50), edge[:399], words(3000)]
    got = found(spark, texts, repeats.DEPTH, repeats.STEP)
    assert got == plain(texts, repeats.DEPTH)
    assert got[3][1] == 0 and got[2][1] == 400


def test_the_report_of_the_smallest_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, n, gone, spans, hashlib.sha256(kept).hexdigest()) for r, (n, gone, spans, kept) in zip(rows, plain([r.text for r in rows], 400), strict=True)]
    assert sorted(map(tuple, repeat_report(docs, Scratch(spark, "test")).collect())) == sorted(want)
    assert sum(r[2] for r in want) > 0


def test_null_ids_clashing_columns_and_no_row(spark):
    text = "".join(random.Random(1).choice("abc") for _ in range(900))
    schema = "doc_id long, text string, key string, data int, first string"
    docs = spark.createDataFrame([(None, text, "k", 1, "f"), (None, text, "k", 1, "f"), (3, text[:399], None, None, None), (3, None, None, None, None)], schema)
    assert sorted(tuple(r)[1:4] for r in repeat_report(docs, Scratch(spark, "test")).collect()) == [(0, 0, 0), (399, 0, 0), (900, 900, 1), (900, 900, 1)]
    assert repeat_report(docs.where("doc_id = 9"), Scratch(spark, "test")).collect() == []


def test_runs_cover_every_start_once_and_depend_on_the_window_alone(monkeypatch):
    """Also where a text is hashed in many stretches."""
    text = "".join(random.Random(2).choice("ab") for _ in range(700)).encode() * 2
    whole = runs_of(text, 20)
    monkeypatch.setattr(repeats, "STRETCH", 128)
    for found_runs in (whole, runs_of(text, 20)):
        place, first, last, *_ = found_runs
        assert first[0] == 0 and last[-1] == len(text) - 20 and (first[1:] == last[:-1] + 1).all()
        assert ((place >= last) & (place - first <= 10)).all()
        gram_of = {}
        for p, a, b in zip(place, first, last, strict=True):
            for s in range(a, b + 1):
                assert gram_of.setdefault(text[s : s + 20], p - s) == p - s


def test_spans_are_maximal():
    b, e = joined_spans(np.array([9, 0, 3, 30]), np.array([9, 1, 3, 30]), 6)
    assert list(zip(b.tolist(), e.tolist(), strict=True)) == [(0, 15), (30, 36)]
