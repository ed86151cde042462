"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Texts never move unless their fingerprint occurs twice.  The steps:

1. One scan takes each text's SHA-256 (after lower-casing A-Z) and writes a narrow table of digests.  The same tasks cut
   them to about ``log2(256 * rows)`` bits, sort them by blocks of bounded size, and write for each owner (a range of
   fingerprints) its part as Golomb-coded gaps, about ten bits a fingerprint.  Only these codes are shuffled.
2. Each owner decodes what it received and returns a bitmap to every block: which of its fingerprints occur twice.
3. Each block's codes and bitmaps give its suspect fingerprints; a scan of the digests marks their rows by a bounded filter.
   One in 256 of the other rows, and what the filter lets through, is a false suspect, which costs a verification.
4. A second scan moves the suspects' texts only, and groups them by their bytes with a partial aggregate on the map
   side, so a text with very many copies sends one row a task.

Defined results: a null text counts as empty, and empty texts are copies of each other.  Among equal texts the row
with the largest id stays; a null id is smaller than any other; of rows with equal text and id exactly one stays.
Other columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, Scratch, look_up, parallelism, sliced

#: Slots of the fingerprint range for each row: one false suspect in so many rows.
SLOTS_PER_ROW = 256
#: Rows of a block and fingerprints of an owner, about; both bound a task's memory.
BLOCK_ROWS = 500_000
#: What a block sends to an owner.
CODES = {"block": pa.int64(), "owner": pa.int64(), "n": pa.int64(), "k": pa.int32(), "unary": pa.binary(), "rest": pa.binary(), "again": pa.binary()}
KINDS = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def golomb_encode(values: np.ndarray, width: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct values below ``width`` as Golomb-Rice coded gaps: the parameter, unary parts, remainders."""
    gaps = np.diff(values, prepend=np.int64(-1)) - 1
    mean = max(1.0, width / max(1, len(values)))
    k = max(0, int(math.log2(mean * 0.69)) if mean > 1.45 else 0)
    quotients = gaps >> k
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1 if len(ends) else 0, dtype=np.uint8)
    unary[ends] = 0
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.int64)) & 1).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    """The values that ``golomb_encode`` was given."""
    if not n:
        return np.empty(0, dtype=np.int64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, dtype=np.uint8)) == 0)[:n]
    gaps = (np.diff(ends, prepend=np.int64(-1)) - 1).astype(np.int64) << k
    if k:
        bits = np.unpackbits(np.frombuffer(rest, dtype=np.uint8))[: n * k].reshape(n, k).astype(np.int64)
        gaps += bits @ (np.int64(1) << np.arange(k, dtype=np.int64))
    return np.cumsum(gaps + 1) - 1


def _lowered(batches):
    for batch in sliced(batches):
        texts = [x.encode("utf-8", "surrogatepass").lower() for x in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("__id__"), pa.array(texts, pa.binary())], names=["id", "norm"])


def _slots(sha: list[str], bits: int) -> np.ndarray:
    """The first ``bits`` bits of each hexadecimal digest."""
    return np.asarray([int(x[:15], 16) for x in sha], dtype=np.int64) >> (60 - bits)


def _codes(block: int, slots: np.ndarray, width: int) -> list[dict]:
    """What a block sends: for each owner its distinct fingerprints in order, coded, and which of them the block has twice."""
    distinct, times = np.unique(slots, return_counts=True)
    owners, out = distinct // width, []
    cuts = np.flatnonzero(np.diff(owners, prepend=-1, append=-1))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        k, unary, rest = golomb_encode(distinct[i:j] - owners[i] * width, width)
        out.append({"block": block, "owner": int(owners[i]), "n": int(j - i), "k": k, "unary": unary, "rest": rest, "again": np.packbits(times[i:j] > 1).tobytes()})
    return out


def exact_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, keep_id, group_size, kept, text_sha256)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    text = docs.select(F.col(id_col).alias("__id__"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    n = docs.count()
    lanes = max(parallelism(docs.sparkSession), math.ceil(n / BLOCK_ROWS))
    bits = min(60, max(12, (max(n, 1) * SLOTS_PER_ROW - 1).bit_length()))
    owner_bits = min(bits - 4, max(0, (lanes - 1).bit_length()))
    width = 1 << (bits - owner_bits)

    def digests(batches):
        task, serial, held, size = TaskContext.get().partitionId(), 0, [], 0
        empty: list[pa.Array] = []

        def coded():
            rows = _codes(task << 24 | serial, np.concatenate(held), width)
            blank = [pa.nulls(len(rows), t) for t in empty]
            return pa.RecordBatch.from_arrays([*blank, *(pa.array([r[c] for r in rows], t) for c, t in CODES.items())], names=["uid", "id", "sha", "slot", *CODES])

        for batch in sliced(batches):
            sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass").lower()).hexdigest() for x in batch.column("_text").to_pylist()]
            slots = _slots(sha, bits)
            own = [batch.column("_uid"), batch.column("__id__"), pa.array(sha, pa.string()), pa.array(slots)]
            empty = [c.type for c in own]
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(sha), t) for t in CODES.values())], names=["uid", "id", "sha", "slot", *CODES])
            held.append(slots)
            size += len(slots)
            if size >= BLOCK_ROWS:
                yield coded()
                serial, held, size = serial + 1, [], 0
        if size:
            yield coded()

    def judge(sent: pa.Table) -> pa.Table:
        parts = sent.to_pylist()
        lists = [golomb_decode(p["n"], p["k"], p["unary"], p["rest"]) for p in parts]
        again = [np.unpackbits(np.frombuffer(p["again"], dtype=np.uint8))[: p["n"]].astype(bool) for p in parts]
        seen, times = np.unique(np.concatenate(lists), return_counts=True)
        twice = times > 1
        repeated = np.concatenate([a[b] for a, b in zip(lists, again, strict=True)])
        twice[np.searchsorted(seen, repeated)] = True
        maps = [np.packbits(twice[np.searchsorted(seen, x)]).tobytes() for x in lists]
        return pa.table([pa.array([p["block"] for p in parts], pa.int64()), pa.array([p["owner"] for p in parts], pa.int64()), pa.array(maps, pa.binary())], names=["block", "owner", "bitmap"])

    def suspected(batches):
        for batch in batches:
            found = [np.zeros(0, dtype=np.int64)]
            for r in batch.to_pylist():
                flags = np.unpackbits(np.frombuffer(r["bitmap"], dtype=np.uint8))[: r["n"]].astype(bool)
                found.append(golomb_decode(r["n"], r["k"], r["unary"], r["rest"])[flags] + r["owner"] * width)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["slot"])

    kinds = ", ".join(f"{c} {KINDS[t]}" for c, t in CODES.items())
    prints = scratch.table(text.withColumn("_uid", F.monotonically_increasing_id()).mapInArrow(digests, f"uid long, id {id_type}, sha string, slot long, {kinds}"), "prints")
    codes = prints.where("owner is not null").select(*CODES)
    answers = codes.groupBy("owner").applyInArrow(judge, "block long, owner long, bitmap binary")
    slots = scratch.table(codes.drop("again").join(answers, ["block", "owner"]).mapInArrow(suspected, "slot long").distinct(), "slots")
    marked = KeyFilter(slots, "slot", slots.count()).split(prints.where("owner is null").select("uid", "id", "sha", "slot"), "slot")
    suspects = scratch.table(marked.where("__maybe__").select("uid", "id", "sha"), "suspects")

    # Byte verification: only the suspects' texts are moved, one row a text and task.
    screen = KeyFilter(suspects.select("id"), "id", suspects.count())
    moved = screen.split(text, "__id__").where("__maybe__").select("__id__", "_text").mapInArrow(_lowered, f"id {id_type}, norm binary")
    classes = moved.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    classes = classes.select(F.sha2("norm", 256).alias("sha"), "group_size")
    stays = suspects.groupBy("sha").agg(
        F.max("id").alias("keep_id"), F.coalesce(F.max_by("uid", "id"), F.max("uid")).alias("keep_uid"), F.count(F.lit(1)).alias("c")
    ).where("c > 1").drop("c")
    classes = classes.join(stays, "sha")

    single = marked.where("not __maybe__").select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    grouped = look_up(suspects, classes, "sha", "group_size", n).select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return single.union(grouped)


def drop_exact_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows of equal id and text count as one document."""
    verdicts = scratch.table(exact_duplicates(docs, scratch, id_col, text_col), "verdicts")
    gone = verdicts.where("not kept").select(id_col)
    screen = KeyFilter(gone, id_col, gone.count())
    split = screen.split(docs, id_col)
    sure = split.where(~F.col("__maybe__")).drop("__maybe__")
    stay = screen.split(verdicts.where("kept"), id_col).where("__maybe__").select(F.col(id_col).alias("__id__"), F.col("text_sha256").alias("__sha__")).distinct()
    # A kept row's twin with the same id and text has the same digest, so equal (id, digest) rows are merged.
    unsure = split.where(F.col("__maybe__")).drop("__maybe__")
    tagged = unsure.withColumn("__sha__", F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256))
    rest = tagged.join(stay, (F.col(id_col).eqNullSafe(F.col("__id__"))) & (tagged["__sha__"] == stay["__sha__"]), "left_semi")
    return sure.unionByName(rest.dropDuplicates([id_col, "__sha__"]).select(*docs.columns))
