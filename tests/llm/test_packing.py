"""Packing: token ids against the tokenizer library, plans against every constraint and against exhaustive search."""

import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sheetwright.llm.common import Scratch
from sheetwright.llm.packing import Encoder, Plan, cut_points, pack_documents

FILES = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
TEXTS = ["a  b", " a", "a  ", "x\n  y", "it's 's", "<|endoftext|> a", " ", "é è\t ü", "1 23 a1", "a　 　b", "\ta b", "!!??  ##", "Ünï\u0000x", "ab" * 3000]


def laid_out(histogram, capacity, plan):
    used, filled = Counter(), defaultdict(list)
    for length, first, each, sequence, offset, count in plan.runs:
        assert first == used[length]
        used[length] += count
        for i in range(count):
            filled[sequence + i // each].append((offset + i % each * length, length))
    assert used == Counter({k: v for k, v in histogram.items() if v})
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(filled) == list(range(plan.sequences))


def fewest(sizes, capacity):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in sorted(set(bins)):
            if k + sizes[i] <= capacity:
                go(i + 1, [*bins[: bins.index(k)], k + sizes[i], *bins[bins.index(k) + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_ids_equal_the_library():
    own, library = Encoder(*FILES, public_tokenizers.PATTERN), Tokenizer.from_file(FILES[0])
    for text in TEXTS:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("space", [" ", "\t", "\n", "\n \t\r", "\u3000 ", "\x1c", "\x85"])
def test_long_white_space_equals_the_library(space):
    own, library = Encoder(*FILES, public_tokenizers.PATTERN), Tokenizer.from_file(FILES[0])
    for n in (4095, 4096, 20_000, 1_000_000):
        run = (space * n)[:n]
        for text in (run, run + "x", f"a{run}b c", f"{run}\n{run[:300]}é"):
            assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents_of_white_space_are_packed(spark):
    library = Tokenizer.from_file(FILES[0])
    texts = [" " * 300_000 + "x", "\n" * 100_000, "a", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pack_documents(docs, Scratch(spark, "test"), *FILES, public_tokenizers.PATTERN).groupBy("doc_id").sum("length").collect()
    assert dict(map(tuple, got)) == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_plans_are_valid():
    rng = random.Random(1)
    for _ in range(1500):
        capacity = rng.choice([5, 10, 20, 50])
        histogram = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 60)))
        laid_out(histogram, capacity, Plan(histogram, capacity))


def test_dominance_and_fit_are_close_to_the_optimum():
    rng, more = random.Random(2), 0
    for _ in range(300):
        sizes = sorted((rng.randint(3, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        more += Plan(Counter(sizes), 20).sequences - fewest(sizes, 20)
    assert more <= 3


def test_dominating_sets_are_fixed_for_all_copies():
    plan = Plan({2048: 10**9, 1500: 10**9, 548: 10**9, 2000: 5, 100: 7}, 2048)
    assert plan.fixed >= 2 * 10**9 + 5 and plan.sequences == 2 * 10**9 + 6
    assert len(plan.runs) < 10


def test_cut_points():
    assert cut_points(1, 4) == [(0, 1)] and cut_points(4, 4) == [(0, 4)]
    assert cut_points(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("texts", [[None, "", "same", "same", *TEXTS, *[f"word {i} " * (i % 37) for i in range(400)]], []])
def test_packed_documents(spark, texts):
    frame = spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    rows = pack_documents(frame, Scratch(spark, "t"), *FILES, public_tokenizers.PATTERN, 64).collect()
    library, found, places = Tokenizer.from_file(FILES[0]), defaultdict(list), defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        want = [(k, s, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[s : s + n]))) for k, (s, n) in enumerate(cut_points(len(ids), 64))]
        assert sorted(found[i if i else None]) == want
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= -(-total // 64) * 1.02 + 1
