"""Quality rules against a slow Python version."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheetwright.llm import quality
from sheetwright.llm.common import Scratch

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "and", "kappa", "lambda", "été", "x#y", "&", "ñ"])
    plain = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(40)]
    lines = ["\n".join(rng.choice(["a b", "a b c", " ", "", "\t", "the end."]) for _ in range(rng.randint(0, 30))) for _ in range(20)]
    return [None, "", " \n\t ", "one", "a b c d e", "a b c d e f a b c d e", "a a a a a a a a", "\x0bw\x0cx\ry z q", "no break", "r s t u v w " * 3000, *plain, *lines]


def test_base_counts(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    frame = quality.base_features(frame, "text").withColumn("n_symbols", quality.character_counts(F.coalesce("text", F.lit("")))["n_symbols"])
    rows = frame.select("doc_id", "__base__.*", "n_symbols", "n_dup_lines").collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow(texts()[r.doc_id]), repr(texts()[r.doc_id])[:80]


def test_jensen_shannon(spark):
    def plain(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
        return math.sqrt((half(p, q) + half(q, p)) / 2)

    pairs = [([1.0, 2.0, 3.0], [3.0, 2.0, 1.0]), ([1.0, 0.0], [0.0, 5.0]), ([2.0, 2.0], [1.0, 1.0])]
    rows = spark.createDataFrame(pairs, "p array<double>, q array<double>").select("p", "q", quality.jensen_shannon(F.col("p"), F.col("q")).alias("d")).collect()
    for r in rows:
        assert r.d == pytest.approx(plain(r.p, r.q), abs=1e-9)
    assert spark.createDataFrame([([0.0], [1.0])], "p array<double>, q array<double>").select(quality.jensen_shannon(F.col("p"), F.col("q"))).first()[0] is None


def test_judge(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["the", "of", "and", "in", rng.choice("bcdfg") + "at" + rng.choice("abcde")]) + rng.choice(["", "", ","]) for _ in range(150)) + f" w{i}" for i in range(60)]
    bad = ["".join(rng.choice("#$%& ") for _ in range(400)) for _ in range(4)] + [" ".join(f"{rng.randrange(9999)}" for _ in range(90)) for _ in range(4)]
    rows = [(i, t, "en", "clash") for i, t in enumerate(good + bad)] + [(900, None, "en", ""), (901, "too short", "en", ""), (902, good[0], None, ""), (903, good[1] * 400, "en", "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    found = {r.doc_id: r for r in quality.judge(frame, Scratch(spark, "t")).collect()}
    assert len(found) == len(rows)
    assert all(found[i].kept for i in range(60)) and found[902].kept
    assert not any(found[60 + i].kept for i in range(8))
    assert found[900].base_failed and found[901].base_failed and found[903].base_failed
    assert found[902].word_distance is None and found[901].class_distance is None
    assert quality.judge(frame.limit(0), Scratch(spark, "t")).count() == 0


def test_letters_without_common_words_fail(spark):
    rng = random.Random(4)
    spell = lambda lang: lang + "".join(rng.choice("abcdefghij") for _ in range(4))
    usual = {lang: [spell(lang) for _ in range(40)] for lang in ("en", "de")}
    text = lambda lang, share, n: " ".join(rng.choice(usual[lang]) if rng.random() < share else spell(lang) + spell("") for _ in range(n))
    good = [(i, text(lang, 0.5, 60 + i), lang) for i, lang in enumerate(["en", "de"] * 60)]
    bad = [(200 + i, text(lang, share, 80), lang) for i, (lang, share) in enumerate([("en", 0), ("de", 0), ("en", 0.03), ("de", 0.03)])]
    found = {r.doc_id: r for r in quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string"), Scratch(spark, "t")).collect()}
    assert all(found[i].kept for i, _, _ in good)
    assert not any(found[i].kept or found[i].base_failed for i, _, _ in bad)


def test_common_words_are_those_of_all_documents(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    texts = [" ".join(rng.choices(words, k=8)) for _ in range(4000)] + ["copied text of one kind 7x"] * 2500
    frame = spark.createDataFrame([(t, "en") for t in texts] + [("null lang", None), (None, "en"), ("A, a", "de")], "text string, lang string")
    counts = Counter(w for t in texts for w in t.split() if w.isalpha())
    first = sorted(counts, key=lambda w: (-counts[w], w))
    assert {r.lang: r.best for r in quality.common_words(frame, "text", "lang", most=30).collect()} == {"en": first[:30], "de": ["a"]}


def slow_judgement(docs):
    """The whole method on one machine: (kept, class distance, word distance) of (id, text, lang)."""
    def distance(p, q):
        if not sum(p) or not sum(q):
            return None
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
        return math.sqrt(max(0.0, half(p, q) + half(q, p)) / 2)

    def classes(text):
        out = [0] * 6
        for c in text:
            kind = unicodedata.category(c)
            at = 0 if kind == "Ll" else 1 if c in " \t\n\x0b\x0c\r" else 2 if kind == "Lu" else 3 if c in ".,;:?'\"()-" else 4 if c in "0123456789" else 5
            out[at] += 1
        return out

    split = lambda t: [w for w in SPACE.split(t) if w]
    times = {}
    for _, t, lang in docs:
        if lang is not None:
            times.setdefault(lang, Counter()).update(w for w in split((t or "").lower()) if w.isalpha())
    tier = {}
    for lang, c in times.items():
        for r, (w, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON]):
            tier[lang, w] = next(k for k, end in enumerate(quality.TIERS) if r < end)
    made = {}
    for i, t, lang in docs:
        found = Counter(tier.get((lang, w)) for w in split((t or "").lower()))
        made[i] = classes(t or ""), [found[k] for k in range(len(quality.TIERS))], len(split(t or "")), lang
    sums = {}
    for c, f, n, lang in made.values():
        own = sums.setdefault(lang, ([0] * 6, [0] * len(quality.TIERS), [0]))
        for total, part in zip(own, (c, f, [n]), strict=True):
            total[:] = [a + b for a, b in zip(total, part, strict=True)]
    pooled = [sum(x) for x in zip(*(s[0] for s in sums.values()), strict=True)]
    out = {}
    for i, t, _ in docs:
        c, f, n, lang = made[i]
        ref = sums[lang] if lang is not None else None
        by_class = distance(c, ref[0] if ref else pooled) if sum(c) >= quality.LEAST_CHARS else None
        rest = lambda found, n: [*found, max(n - sum(found), 0)]
        by_word = distance(rest(f, n), rest(ref[1], ref[2][0])) if ref and n >= quality.LEAST_WORDS else None
        without = distance(rest([0] * len(f), 1), rest(ref[1], ref[2][0])) if ref else 1.0
        base = slow(t)
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        out[i] = (not failed and (by_class or 0) <= quality.MOST_CLASSES and (by_word or 0) <= quality.FAR * without), by_class, by_word
    return out


@pytest.mark.parametrize(("named", "hot"), [(64, 4096), (1, 0)])
def test_judgement_against_a_slow_version(spark, monkeypatch, named, hot):
    """The registered query's operator on a whole table, and documents of no language; also with joined words and references."""
    monkeypatch.setattr(quality, "NAMED", named)
    monkeypatch.setattr(quality, "HOT_KEYS", hot)
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000 + i, t, None if i % 2 else "en") for i, (_, t, _) in enumerate(rows[:30])] + [(20_000, None, "en"), (20_001, "", None), (20_002, "zq" * 300 + " " + "vx kz " * 80, "en")]
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), Scratch(spark, "t")).collect()
    want = slow_judgement(rows)
    assert len(found) == len(rows) and {want[i][0] for i in want} == {True, False}
    for r in found:
        kept, by_class, by_word = want[r.doc_id]
        assert r.kept == kept
        assert (r.class_distance, r.word_distance) == (pytest.approx(by_class, abs=1e-9) if by_class is not None else None, pytest.approx(by_word, abs=1e-9) if by_word is not None else None)


def test_six_hundred_languages(spark):
    rows = [(i, " ".join(f"wort{'abcdefghij'[i % 10]}{'klmno'[j % 5]}" if j % 2 else f"eigen{'pqrstu'[i % 6]}" for j in range(60)) + f" l{i}", f"l{i:03}") for i in range(600)]
    found = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), Scratch(spark, "t")).collect()}
    want = slow_judgement(rows)
    assert len(found) == 600
    for i, (kept, by_class, by_word) in want.items():
        assert found[i].kept == kept and found[i].class_distance == pytest.approx(by_class, abs=1e-9) and found[i].word_distance == pytest.approx(by_word, abs=1e-9)
