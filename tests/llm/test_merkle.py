"""Merkle manifest: against a plain version that builds every level, for many sizes of parts and blocks, and with odd rows."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from sheetwright.llm.common import Scratch
from sheetwright.llm.merkle import document_manifest, fold, levels, walk

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, source, lang, n_chars, text = row
    fields = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def tree_of(nodes):
    """All levels from the leaves up, and each leaf's siblings."""
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([sha(*rows[-1][i : i + 2]) for i in range(0, len(rows[-1]), 2)])
    paths = [[row[(i >> k) ^ 1] if (i >> k) ^ 1 < len(row) else None for k, row in enumerate(rows[:-1])] for i in range(len(nodes))]
    return rows[-1][0], paths


def folded(digest, i, path):
    for k, other in enumerate(path):
        pair = [digest] if other is None else [other, digest] if (i >> k) & 1 else [digest, other]
        digest = sha(*pair)
    return digest


def plain(rows):
    parts = defaultdict(list)
    for row in rows:
        parts[row[2]].append(row)
    order = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    for own in parts.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {lang: tree_of([leaf_of(r) for r in parts[lang]]) for lang in order}
    root, tops = tree_of([trees[lang][0] for lang in order])
    out = []
    for at, lang in enumerate(order):
        subroot, paths = trees[lang]
        for i, (row, path) in enumerate(zip(parts[lang], paths, strict=True)):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            end = folded(folded(leaf_of(row, int(hit)), i, path), at, tops[at])
            proof = sha(*(x for x in path + tops[at] if x))
            out.append((row[0], leaf_of(row), subroot, root, proof, end, end == root))
    return sorted(out, key=str)


def found(spark, rows, depth, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema)
    return sorted((tuple(r) for r in document_manifest(docs, Scratch(spark, "test"), depth).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 31])
def test_a_walk_gives_siblings_that_fold_to_its_root(n):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    siblings = [bytearray() for _ in leaves]
    root = walk(leaves, levels(n), siblings)
    want, paths = tree_of([x.hex() for x in leaves])
    assert root.hex() == want
    for i, path in enumerate(paths):
        assert bytes(siblings[i]).hex() == "".join(x for x in path if x)
        assert fold(leaves[i], i, n, bytes(siblings[i])) == (root, len(siblings[i]))


def test_parts_of_many_sizes(spark):
    """Parts of 1 to 70 leaves in blocks of four: up to four traversals, and a part that holds most of the rows."""
    sizes = {"de": 1, "en": 70, "es": 2, "fr": 17, None: 5, "": 3, "é": 4, "z": 16}
    rows, k = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            rows.append((k * 37 % 1009, f"s{k % 3}" if k % 5 else None, lang, k if k % 4 else None, "t" * (k % 6) if k % 7 else None))
            k += 1
    got = found(spark, rows, 2)
    assert got == plain(rows)
    assert got == found(spark, rows, 10)
    assert {r[-1] for r in got} == {True, False}


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(7, "a", "en", 3, "x"), (7, "a", "en", 3, "x"), (7, "a", "en", 4, "y"), (None, None, None, None, None), (None, None, None, None, None), (None, "-", "en", None, ""), (8, "", "en", 1, "ünï" * 5000)]
    want = plain(rows)
    assert found(spark, rows, 1) == want
    wide = [(*r, 0, "v", b"") for r in rows]
    assert found(spark, wide, 1, f"{SCHEMA}, pos int, tree string, leaf binary") == want


def test_one_row_and_no_row(spark):
    rows = [(5, "a", "en", 1, "x")]
    assert found(spark, rows, 10) == plain(rows)
    assert found(spark, [], 10) == []


def test_a_changed_digest_is_noticed(spark):
    rows = [(i, "s", "en", i, "t") for i in range(40)]
    bad = {r[0] for r in found(spark, rows, 3) if not r[-1]}
    assert bad == {i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 0}
