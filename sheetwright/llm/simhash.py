"""Near-duplicate detection by SimHash fingerprints and multi-index hashing.

A text is lower-cased (A-Z), cut into words at ASCII white space, and its word shingles, repeats included, vote on
each of 64 bits by their XXH64 (seed 42); a bit is set by more than half of the votes.  A text with fewer words than a
shingle is one shingle; one without words has fingerprint zero, which is linked like any other.

Fingerprints that differ in at most two bits are linked.  Distinct fingerprints are cut into two segments of 32 bits.
Two bits can be spread so that the upper segment differs in at most one bit, or the lower one in none: so each
fingerprint looks up the Hamming ball of radius one around its upper segment and the very value of its lower segment.
Every match is verified on all 64 bits.  A differing bit is 0 on exactly one side, so only 0 bits are flipped.

A segment value that very many fingerprints share (a dense group of near copies) would pair them all.  Such values
leave the segment index; all fingerprints that hold or look up one instead enumerate the radius-one ball of the whole
fingerprint, 65 values each.  Two of them are linked exactly when their balls meet, and all fingerprints of one meeting
point are linked to its smallest: the links' components are the same, their number grows with the group, not its square.

Defined results: null texts have fingerprint zero; copies of one fingerprint are one node; rows with a null id belong to
their fingerprint's component; other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, look_up, sliced

SEED = 42
SHINGLE = 3
#: Fingerprints that may share a segment value before the whole-fingerprint balls take over.
DENSE = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64)
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * votes > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit integer."""

    def work(batches):
        for batch in sliced(batches):
            found = np.array([fingerprint(x, shingle) for x in batch.column("_text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64), pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).mapInArrow(work, f"id {kind}, fp long")


def links(points: DataFrame, scratch: Scratch, dense: int = DENSE) -> DataFrame:
    """Links (a, b) between representatives of distinct fingerprints (fp, rep) whose components are those of distance <= 2."""
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    low_key = lower.bitwiseOR(F.lit(1 << 32))
    entry = lambda key, flip: F.struct(key.alias("key"), F.lit(flip).alias("flip"))
    table = points.select("fp", "rep", F.inline(F.array(F.struct(upper.alias("key")), F.struct(low_key.alias("key")))))
    flips = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.expr("1L").bitwiseAND(F.call_function("shiftrightunsigned", F.col("fp"), i + 32)) == 0),
        lambda i: F.struct(F.col("upper").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).alias("key"), F.lit(True).alias("flip")),
    )
    probes = points.withColumn("upper", upper).select("fp", "rep", F.inline(F.concat(F.array(entry(upper, False), entry(low_key, False)), flips)))
    crowded = scratch.table(table.groupBy("key").count().where(F.col("count") > dense).select("key"), "crowded")
    thin = table.join(crowded, "key", "left_anti")
    a, b = probes.alias("a"), thin.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 2
    found = a.join(b, F.col("a.key") == F.col("b.key")).where((F.col("a.flip") | (F.col("a.fp") < F.col("b.fp"))) & near).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    if crowded.isEmpty():
        return found
    members = probes.join(crowded, "key", "left_semi").select("fp", "rep").distinct()
    ball = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    spread = members.select("rep", F.explode(ball).alias("centre"))
    meet = spread.groupBy("centre").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.union(spread.join(meet, "centre").where("rep <> b").select(F.col("rep").alias("a"), "b"))


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, dense: int = DENSE) -> DataFrame:
    """One row per row of ``docs``: (id_col, fingerprint as 16 hexadecimal digits, component_id)."""
    prints = scratch.table(fingerprints(docs, id_col, text_col, shingle), "prints")
    points = scratch.table(prints.groupBy("fp").agg(F.min("id").cast("long").alias("rep"), F.count(F.lit(1)).alias("copies")), "points")
    known = points.where("rep is not null").drop("copies")
    roots = components(links(known, scratch, dense), scratch)
    labels = points.join(roots, points["rep"] == roots["node"], "left").select("fp", "copies", F.coalesce("root", "rep").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return look_up(prints, labels, "fp", "copies", prints.count()).select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")
