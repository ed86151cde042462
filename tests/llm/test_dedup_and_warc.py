"""Exact dedup, SimHash and WARC against brute force on small fixtures."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwright.llm import exact_dedup, simhash, warc
from sheetwright.llm.common import KeyFilter, Scratch, components, discard, look_up

ODD = [None, "", "a", "A", "É", "é", "  ", "word " * 30_000, "one two", "ONE TWO", "x\ny", "x\ny"]


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "kept", "uid", 7) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, sha string, _maybe int")


def lower(text):
    return (text or "").encode().lower()


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n, width in ((0, 16), (1, 16), (16, 16), (500, 1 << 20), (1000, 1 << 40)):
        values = np.sort(rng.choice(min(width, 1 << 22), size=n, replace=False)).astype(np.int64) * max(1, width >> 22)
        assert (exact_dedup.golomb_decode(n, *exact_dedup.golomb_encode(values, width)) == values).all()


@pytest.mark.parametrize("texts", [ODD, [f"t{i % 40}" for i in range(300)], []])
def test_exact_duplicates(spark, texts):
    frame = docs(spark, texts).repartition(5)
    found = {r.doc_id: r for r in exact_dedup.exact_duplicates(frame, Scratch(spark, "t")).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(lower(t), []).append(i)
    assert len(found) == len(texts)
    for norm, ids in groups.items():
        for i in ids:
            r = found[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert r.text_sha256 == hashlib.sha256(norm).hexdigest()
    stay = exact_dedup.drop_exact_duplicates(frame, Scratch(spark, "t"))
    assert sorted(r.doc_id for r in stay.collect()) == sorted(max(ids) for ids in groups.values())
    assert stay.columns == frame.columns


def test_exact_duplicates_of_repeated_and_null_ids(spark):
    frame = docs(spark, ["a", "a", "A", "b", "b", "c"], [1, 1, None, None, None, 9])
    rows = exact_dedup.exact_duplicates(frame, Scratch(spark, "t")).collect()
    assert len(rows) == 6
    assert [sum(r.kept for r in rows if r.text_sha256 == hashlib.sha256(x).hexdigest()) for x in (b"a", b"b", b"c")] == [1, 1, 1]
    assert {r.keep_id for r in rows if r.group_size == 3} == {1}
    assert exact_dedup.drop_exact_duplicates(frame, Scratch(spark, "t")).count() == 3


def test_key_filter_has_no_false_negatives(spark):
    keys = spark.range(0, 5000, 7).select(F.col("id").alias("k"))
    rows = spark.range(0, 5000).select(F.col("id").alias("k"))
    found = KeyFilter(keys, "k", keys.count()).split(rows, "k").where("__maybe__")
    assert keys.join(found, "k", "left_anti").count() == 0
    assert found.count() < 1500
    assert discard(rows, keys, "k").count() == 5000 - keys.count()


def test_look_up_splits_hot_keys(spark):
    rows = spark.createDataFrame([(k,) for k in [1] * 9000 + [2, 3, 4]], "k int")
    table = spark.createDataFrame([(1, 9000, "a"), (2, 1, "b"), (3, 1, "c")], "k int, n long, v string")
    assert {(r.k, r.v, r["count"]) for r in look_up(rows, table, "k", "n", 9003).groupBy("k", "v").count().collect()} == {(1, "a", 9000), (2, "b", 1), (3, "c", 1), (4, None, 1)}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    label = {x: x for p in pairs for x in p}
    while True:
        moved = False
        for a, b in pairs:
            m = min(label[a], label[b])
            moved |= label[a] != m or label[b] != m
            label[a] = label[b] = m
        if not moved:
            break
    found = components(spark.createDataFrame(pairs, "a long, b long").repartition(6), Scratch(spark, "t"))
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.root for r in found.collect()} == {x: label[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def slow_fingerprint(text):
    import xxhash

    words = lower(text).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


@pytest.mark.parametrize("dense", [64, 1])
def test_simhash_against_all_pairs(spark, dense):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(60)) for _ in range(12)]
    texts = list(ODD)
    for t in base:
        words = t.split()
        for _ in range(6):
            edited = list(words)
            edited[rng.randrange(60)] = "new"
            texts += [" ".join(edited), t]
    frame = docs(spark, texts)
    rows = {r.doc_id: r for r in simhash.near_duplicates(frame, Scratch(spark, "t"), dense=dense).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    assert [int(rows[i].fingerprint, 16) for i in range(len(texts))] == prints
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    assert [rows[i].component_id for i in range(len(texts))] == root


def test_simhash_empty_and_null_ids(spark):
    assert simhash.near_duplicates(docs(spark, []), Scratch(spark, "t")).count() == 0
    rows = simhash.near_duplicates(docs(spark, ["a b c", "a b c", "q"], [None, 4, None]), Scratch(spark, "t")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("4", "4"), ("None", "4"), ("None", "None")]


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "text " * 50
    rows = [(0, "http://a", big), (1, "http://b", big), (2, None, None), (3, "u\r\nWARC/1.1", ""), (4, "x", "é" * 49), (5, "x", "é" * 49), (6, "x", "é" * 50), (7, "x", "é" * 50), (7, "x", "é" * 50), (8, "y", "\r\n\r\nWARC/1.1\r\n" * 20000), (None, "z", big)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


def test_warc_round_trip(spark, pages):
    rows = warc.round_trip(pages, Scratch(spark, "t")).collect()
    want = {}
    for r in pages.collect():
        data = (r.html or "").encode()
        same = [q.page_id for q in pages.collect() if (q.html or "").encode() == data and q.page_id is not None]
        again = len(data) >= 100 and r.page_id != min(same)
        want.setdefault((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else None), []).append(1)
    assert {k: len(v) for k, v in want.items()} == {k: [tuple(r) for r in rows].count(k) for k in {tuple(r) for r in rows}}
    assert warc.round_trip(pages.limit(0), Scratch(spark, "t")).count() == 0


def test_warc_files_are_read_by_their_sidecars(spark, pages, tmp_path):
    records = warc.plan_records(pages, Scratch(spark, "t"), "page_id", "html", "url", 100)
    source, folder = f"file://{tmp_path}/source", f"file://{tmp_path}/normalised"
    scratch = Scratch(spark, "t")
    written = scratch.table(warc.write_archives(records, source, archive_bytes=400), "written")
    listed = warc.normalise(written, source, folder).collect()
    assert len(listed) > 1 and sum(r.records for r in listed) == pages.count()
    for r in listed:
        data = (tmp_path / "normalised" / r.archive).read_bytes()
        assert len(data) == r.bytes
        for line in (tmp_path / "normalised" / (r.archive + ".idx")).read_text().splitlines():
            offset, length, kind, name = line.split("\t")
            head, _ = warc.parse_head(zlib.decompress(data[int(offset) : int(offset) + int(length)], wbits=31))
            assert (head["warc-type"], head["warc-record-id"]) == (kind, name)
        whole = (tmp_path / "source" / r.archive).read_bytes()
        assert zlib.decompress(whole, wbits=31) == b"".join(warc.inflate([data])) == b"".join(warc.inflate([data[:7], data[7:]]))
    index = warc.read_index(spark, folder)
    payloads = {r.record_id: bytes(r.payload).decode() for r in warc.read_records(index, folder).where("record_type = 'response'").collect()}
    assert payloads["8"] == "\r\n\r\nWARC/1.1\r\n" * 20000
    some = index.where("record_type = 'revisit'")
    assert {r.record_type for r in warc.read_records(some, folder).collect()} == {"revisit"}
    assert not [f for f in (tmp_path / "source").iterdir() if f.name.startswith(".pages") and not f.name.endswith(".crc")]


def test_warc_text_ids(spark):
    rows = [("none", "a" * 200), ("a b\t<c>\n", "b" * 200), (None, "a" * 200), ("é", None), (None, "c" * 150)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id string, url string, html string")
    found = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.round_trip(pages, Scratch(spark, "t")).collect())
    assert found == sorted([("none", "response", "None"), ("a b\t<c>\n", "response", "None"), ("None", "revisit", "none"), ("é", "response", "None"), ("None", "response", "None")])


def test_warc_rejects_damage():
    record = warc.make_record("1", "response", "u", "00", 3, b"abc", None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        list(warc.cut(iter([record[:-6]])))
    with pytest.raises(ValueError):
        list(warc.inflate([zlib.compress(record, wbits=31)[:-9]]))
    member = zlib.compress(record, wbits=31)
    with pytest.raises(ValueError):
        warc.read_member(member)
