"""The pipeline's stages against brute force, each on its own input."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sheetwright.llm import queries
from sheetwright.llm.common import Scratch
from sheetwright.llm.near_texts import shingles

from .test_dedup_and_warc import lower
from .test_packing import FILES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before each stage, and after the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(9001, None, "en", "s", 0), (9002, "12 34 !!", "en", "s", 8), (9003, "", None, "s", 0)]
    first = docs.limit(3).collect()
    extra += [(9010 + i, r.text.upper() if i == 0 else r.text, r.lang, r.source, r.n_chars) for i, r in enumerate(first)]
    extra += [(9020, first[0].text + " x", "en", "s", 0), (9021, "word " * 30_000, "en", "s", 0)]
    docs, scratch, found = docs.union(spark.createDataFrame(extra, docs.schema)), Scratch(spark, "t"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found.append(docs.collect())
        docs = scratch.table(stage(spark, docs, SF), f"s{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return [*found, docs.collect()]


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_language_id_rejects_texts_without_letters(stages):
    assert ids(stages[1]) == ids(r for r in stages[0] if r.text and re.search(r"[^\W\d_]", r.text))
    stated = {r.doc_id: r.lang for r in stages[0]}
    assert sum(stated[r.doc_id] == r.lang for r in stages[1]) >= 0.98 * len(stages[1])


def test_exact_dedup_keeps_the_last(stages):
    last = defaultdict(int)
    for r in stages[1]:
        last[lower(r.text)] = max(last[lower(r.text)], r.doc_id)
    assert ids(stages[2]) == sorted(last.values())


def test_near_dedup_keeps_the_first_of_each_class(stages):
    rows = sorted(stages[2], key=lambda r: r.doc_id)
    sets = {r.doc_id: set(shingles(r.text).tolist()) for r in rows}
    kept = set(ids(stages[3]))
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    for r in rows:
        nearest = max((alike(r.doc_id, s.doc_id) for s in rows if s.doc_id != r.doc_id), default=0)
        if nearest < 0.6:
            assert r.doc_id in kept
        if r.doc_id in kept:
            assert all(alike(r.doc_id, k) < 0.87 for k in kept if k != r.doc_id)
    assert len(kept) < len(rows)


def test_mixing_takes_each_document_as_often_as_its_rate(stages, spark):
    """Shares of tokens by expected domain after the stage, against the targets that the rates meet."""
    docs = spark.createDataFrame(stages[3], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r for r in queries.mixed(docs, spark.read.parquet(f"{SF}/labels.parquet"), Scratch(spark, "t")).collect()}
    before, after = Counter(ids(stages[3])), Counter(ids(stages[4]))
    assert all(after[i] == found[i].copies * n for i, n in before.items()) and set(after) <= set(before)
    for r in stages[4]:
        assert r.text == next(x.text for x in stages[3] if x.doc_id == r.doc_id)


def test_mixing_meets_the_targets_on_more_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    rows = queries.mixed(docs, labels, Scratch(spark, "t")).collect()
    taken = Counter(r.doc_id for r in corpus_pipeline.mixing(spark, docs, sf).select("doc_id").collect())
    assert all(taken[r.doc_id] == r.copies for r in rows)
    total = sum(r.n_tokens * taken[r.doc_id] for r in rows)
    for name, goal in queries.TARGETS.items():
        assert sum(r[f"p_{name}"] * r.n_tokens * taken[r.doc_id] for r in rows) / total == pytest.approx(goal, abs=0.02)


def test_stages_on_empty_tables(spark):
    docs = queries.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_packing_holds_every_document(stages):
    library, pieces, places = Tokenizer.from_file(FILES[0]), defaultdict(list), defaultdict(list)
    for r in stages[5]:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids(stages[4]))
    times = Counter(ids(stages[4]))
    for r in stages[4]:
        tokens = [*library.encode(r.text, add_special_tokens=False).ids, 0]
        at = 0
        own = sorted(pieces[r.doc_id])
        assert all(own[i] == own[i - i % times[r.doc_id]] for i in range(len(own)))  # as often as the document
        for k, (piece, start, length, crc) in enumerate(own[:: times[r.doc_id]]):
            assert (piece, start) == (k, at) and crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in tokens[start : start + length]))
            at += length
        assert at == len(tokens)
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_with_columns_of_any_name_repeated_rows_and_no_ids(spark):
    docs = queries.table(spark, SF, "documents").limit(60)
    first = docs.first()
    odd = spark.createDataFrame([(first.doc_id, first.text, "en", "s", 0), (None, "The words of the text without an id are these.", "en", "s", 0), (None, None, None, None, None)], docs.schema)
    docs = docs.union(odd)
    for name in ("score", "held_out", "copies", "sha", "rate", "node", "piece"):
        docs = docs.withColumn(name, F.lit(name))
    scratch = Scratch(spark, "t")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = scratch.table(stage(spark, docs, SF), f"s{k}")
        assert found.count() > 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == docs.columns and {r.score for r in found.select("score").distinct().collect()} == {"score"}
            docs = found
