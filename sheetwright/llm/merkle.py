"""Merkle manifest of a dataset: postorder traversal of aligned blocks, whose roots feed another distributed traversal.

Every row is a leaf: a hash of its fields, each with its length, so that no two rows share an encoding.  The leaves of a
part (a language) are ordered by id; while several nodes remain, every two consecutive ones, or the last one alone, become their
hash.  What remains is the part's subroot, and the subroots, ordered by part, give the root in the same way.

1. Leaves are hashed where they are scanned, so only digests are sorted.  A range sort numbers them within their part: a
   row's place is its place in its task, and the counts of the earlier tasks.
2. A block is ``2 ** depth`` consecutive leaves of one part and so a whole subtree.  A task holds one block at a time and walks
   it in postorder: each call returns its subtree's digest, and while the calls unwind each inner node appends its two
   children's digests to the leaves below the other one.  What a block keeps for a leaf is at most ``depth`` digests.
3. The blocks' roots are the leaves of the next traversal, until every part has one node.  The subroots are traversed once more.
4. Downwards, a block's siblings are followed by those of the block above it.  A leaf's proof is its own block's siblings and
   that list, so the only join that leaves take part in has one row a block.

No part, however large, passes one task: blocks are dealt by part and number.

Defined results: a null part comes first and is a part of its own; null ids come first within a part; rows of equal part and
id are ordered by their leaves, and rows that repeat all fields are leaves each; a null field is ``-`` and differs from an
empty one; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parallelism

#: A block is two to this power of leaves.
DEPTH = 10
NODES = "tree string, pos long, n long, digest binary"


def field(column: Column) -> Column:
    """A field's encoding: its bytes' number, a colon and the value; a dash for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    """The digest of a row's fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def join_digests(*digests: bytes) -> bytes:
    """A node's digest: that of its children's, as lowercase hexadecimal text."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def levels(n: int) -> int:
    """How often ``n`` nodes are paired until one remains."""
    return (n - 1).bit_length() if n > 1 else 0


def walk(leaves: list[bytes], height: int, siblings: list[bytearray]) -> bytes:
    """The digest of the subtree of this height over ``leaves``; appends to each leaf's list its siblings, lowest first."""

    def visit(start: int, level: int) -> bytes:
        if not level:
            return leaves[start]
        half = 1 << (level - 1)
        left = visit(start, level - 1)
        middle = start + half
        if middle >= len(leaves):  # the last node of a level has no sibling
            return join_digests(left)
        right = visit(middle, level - 1)
        for at in range(start, middle):
            siblings[at] += right
        for at in range(middle, min(middle + half, len(leaves))):
            siblings[at] += left
        return join_digests(left, right)

    return visit(0, height)


def fold(digest: bytes, pos: int, n: int, siblings: bytes, used: int = 0) -> tuple[bytes, int]:
    """The root that a leaf and its siblings give, and how many bytes of ``siblings`` have been used."""
    while n > 1:
        if pos ^ 1 < n:
            other = siblings[used : used + 32]
            used += 32
            digest = join_digests(other, digest) if pos & 1 else join_digests(digest, other)
        else:
            digest = join_digests(digest)
        pos, n = pos >> 1, (n + 1) >> 1
    return digest, used


def numbered(rows: DataFrame, scratch: Scratch, name: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` in the order of ``order`` within their ``tree``, and ``n``, the tree's number of rows."""
    dealt = rows.repartitionByRange(parallelism(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    # the number is written with the row, so it is that of the one task that wrote it
    dealt = scratch.table(dealt.withColumn("__at__", F.monotonically_increasing_id()), f"{name}-sorted")
    task = F.shiftright("__at__", 33).alias("__task__")
    counts = dealt.groupBy("tree", task).agg(F.min("__at__").alias("__first__"), F.count(F.lit(1)).alias("__c__"))
    whole = Window.partitionBy("tree")
    before = F.sum("__c__").over(whole.orderBy("__task__").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c__")
    shifts = scratch.table(counts.select("tree", "__task__", (before - F.col("__first__")).alias("__shift__"), F.sum("__c__").over(whole).alias("n")), f"{name}-shifts")
    placed = dealt.withColumn("__task__", F.shiftright("__at__", 33)).join(shifts, ["tree", "__task__"])
    return placed.withColumn("pos", F.col("__at__") + F.col("__shift__")).drop("__task__", "__at__", "__shift__")


def _blocks(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[str, int, int, list[bytes]]]:
    """(tree, block, n, digests) of rows that come sorted by tree and place; holds one block at a time."""
    key, held, size = None, [], 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("tree", "pos", "n", "digest"))
        for tree, pos, n, digest in zip(*columns, strict=True):
            if key != (tree, pos >> depth):
                if held:
                    yield *key, size, held
                key, held, size = (tree, pos >> depth), [], n
            held.append(digest)
    if held:
        yield *key, size, held


def traverse(nodes: DataFrame, depth: int) -> DataFrame:
    """Walk each block: a row for each node with its siblings in the block, and one with ``pos`` null for the block's root."""

    def work(batches):
        for tree, block, n, digests in _blocks(batches, depth):
            siblings = [bytearray() for _ in digests]
            root = walk(digests, min(depth, levels(n)), siblings)
            size = len(digests)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([tree] * (size + 1), pa.string()), pa.array([block] * (size + 1), pa.int64()), pa.array([*range(block << depth, (block << depth) + size), None], pa.int64()),
                    pa.array([n] * (size + 1), pa.int64()), pa.array([*map(bytes, siblings), None], pa.binary()), pa.array([*[None] * size, root], pa.binary()),
                ],
                names=["tree", "block", "pos", "n", "siblings", "root"],
            )

    block = F.shiftright("pos", depth)
    dealt = nodes.select("tree", "pos", "n", "digest").repartition(parallelism(nodes.sparkSession), F.col("tree"), block).sortWithinPartitions("tree", "pos")
    return dealt.mapInArrow(work, "tree string, block long, pos long, n long, siblings binary, root binary")


def forest(nodes: DataFrame, scratch: Scratch, name: str, depth: int = DEPTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of trees of nodes (tree, pos, n, digest): each node's siblings in its block, each block's siblings above, the trees' roots.

    The tables are (tree, block, pos, siblings), (tree, block, above) and (tree, root).
    """
    walked = []
    while True:
        made = scratch.table(traverse(nodes, depth), f"{name}-{len(walked)}")
        walked.append(made)
        roots = made.where("pos is null").select("tree", F.col("block").alias("pos"), ((F.col("n") + ((1 << depth) - 1)) / (1 << depth)).cast("long").alias("n"), F.col("root").alias("digest"))
        if not roots.where("n > 1").limit(1).count():
            break
        nodes = roots
    above = roots.select("tree", F.col("pos").alias("block"), F.lit(b"").alias("above"))
    for k in range(len(walked) - 1, 0, -1):  # from the top down, a node of one traversal is a block of the one below
        level = walked[k].where("pos is not null").select("tree", "block", "pos", "siblings").join(above, ["tree", "block"])
        above = level.select("tree", F.col("pos").alias("block"), F.concat("siblings", "above").alias("above"))
    return walked[0].where("pos is not null").select("tree", "block", "pos", "siblings"), above, roots.select("tree", F.col("digest").alias("root"))


def manifest(rows: DataFrame, scratch: Scratch, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Proofs of rows (part, id, leaf and any others): (their columns, tree, pos, n, siblings) and one row a tree and block.

    ``siblings`` are those in the leaf's block.  The second table has (tree, block, above, subroot, part_pos, parts, top, root): the
    siblings above the block up to the subroot, the subroot's place among the parts, its siblings ``top`` and the root.
    """
    tree = F.coalesce(F.concat(F.lit("v"), F.col("part").cast("string")), F.lit("n"))  # sorts null first, then by bytes
    leaves = scratch.table(numbered(rows.withColumn("tree", tree), scratch, "leaves", ["id", "leaf"]), "leaves")
    below, above, subroots = forest(leaves.withColumnRenamed("leaf", "digest"), scratch, "leaf", depth)
    parts = scratch.table(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("part"), F.col("root").alias("digest")), scratch, "parts", ["part"]), "parts")
    own, upper, root = forest(parts, scratch, "part", depth)
    placed = parts.select(F.col("part").alias("tree"), F.col("digest").alias("subroot"), F.col("pos").alias("part_pos"), F.col("n").alias("parts"))
    tops = own.join(upper, ["tree", "block"]).join(root, "tree").select(F.col("pos").alias("part_pos"), F.concat("siblings", "above").alias("top"), "root")
    blocks = scratch.table(above.join(placed.join(tops, "part_pos"), "tree"), "blocks")
    return leaves.join(below, ["tree", "pos"]), blocks


def proved(rows: DataFrame, scratch: Scratch, depth: int = DEPTH) -> DataFrame:
    """Of rows (part, id, leaf, checked): id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``checked`` is the leaf that is folded with the proof; digests are given in hexadecimal.
    """
    leaves, blocks = manifest(rows, scratch, depth)
    kind = rows.schema["id"].dataType.simpleString()
    out = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def work(batches):
        for batch in batches:
            made: dict[str, list] = {c: [] for c in out}
            columns = (batch.column(c).to_pylist() for c in ("leaf", "checked", "pos", "n", "siblings", "above", "subroot", "part_pos", "parts", "top", "root"))
            for leaf, checked, pos, n, siblings, above, subroot, part_pos, parts, top, root in zip(*columns, strict=True):
                proof = siblings + above + top
                folded, used = fold(checked, pos, n, proof)
                folded, used = fold(folded, part_pos, parts, proof, used)
                if used != len(proof):
                    raise ValueError(f"a proof of {len(proof)} bytes, of which {used} belong to its place")
                for c, v in zip(out, (leaf.hex(), subroot.hex(), root.hex(), hashlib.sha256(proof.hex().encode()).hexdigest(), folded.hex()), strict=True):
                    made[c].append(v)
            verified = pa.array([a == b for a, b in zip(made["folded_root"], made["root"], strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(made[c], pa.string()) for c in out), verified], names=["id", *out, "verified"])

    return leaves.join(blocks, ["tree", "block"]).mapInArrow(work, f"id {kind}, {', '.join(f'{c} string' for c in out)}, verified boolean")


def document_manifest(docs: DataFrame, scratch: Scratch, depth: int = DEPTH) -> DataFrame:
    """The manifest of documents by language, with every seventh document's ``n_chars`` tampered with before it is verified.

    A document whose id is null, or whose ``n_chars`` is, is left as it is.
    """
    row = lambda n_chars: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    leaf = row(F.col("n_chars"))
    rows = docs.select(F.col("lang").alias("part"), F.col("doc_id").alias("id"), leaf.alias("leaf"), F.when(tampered, row(F.col("n_chars").cast("decimal(38,0)") + 1)).otherwise(leaf).alias("checked"))
    return proved(scratch.table(rows, "rows"), scratch, depth).withColumnRenamed("id", "doc_id")
