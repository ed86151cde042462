"""Removal of repeated byte strings by a depth-limited radix sort of suffixes, most significant digit first.

Suffixes (every position of every document) are ordered through ``depth`` bytes only, and only as far as it takes to tell which are
alike: groups that are equal through all digits are exactly the repeated windows, and a group of one leaves the sort at once.

Neighbouring suffixes move together.  A *run* is a stretch of consecutive starts that share their most significant digit: the same
occurrence of the least gram (half a window long, by a fixed hash, leftmost of equals) among those in the window.  It depends on the
window's bytes alone, so equal windows have equal grams at equal distances, and about one position in a quarter of a window begins a run.

A pass takes runs, and of each run two digits: its *core*, the bytes that all its windows share, and its *hull*, all its bytes.

* A core that occurs once: no window of the run is repeated, and the run leaves.
* A hull that occurs again: all windows of the run are repeated, so the run is settled.
* One run of each hull goes on where its core has several hulls: it is cut, at fixed distances from its gram, into shorter runs.

The first pass has runs as they are, the second those of ``STEP`` starts, the third single windows, where core and hull are one.  Copies
settle in the first pass; only runs at the edge of a repeat reach the third.

Documents are known by the digest of their text, so copies are one document with several occurrences.  Only texts that may hold
a run that goes on, or lose bytes, are shuffled; digits are counted with partial aggregates, and keys that hold a large
share of the rows are looked up apart (``look_up``).

Defined results: a null text is empty; texts shorter than ``depth`` keep all bytes; windows of one document that overlap count as
repeats of each other; rows that repeat are documents each; an empty table gives an empty result; other columns are ignored.
Digits are 64-bit polynomial hashes under fixed tables, two a run and 96 bits a window; equality is that of the hashes.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, Scratch, look_up, sliced

#: Bytes of a repeated string, and starts of a run in the second pass.
DEPTH, STEP = 400, 25
#: Starts that are hashed at a time; a longer text is taken in stretches.  A start's place takes this many bits of its gram's rank.
PLACE_BITS = 19
STRETCH = 1 << PLACE_BITS
#: Bases of the two polynomials (odd, not near a power of two), and the seed of the byte tables.
BASES, SEED = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 11


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@cache
def tables(which: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A word for each byte, and the powers of a base and of its inverse modulo 2 ** 64."""
    words = np.random.Generator(np.random.PCG64([SEED, which])).integers(0, 1 << 63, 256, dtype=np.uint64)
    powers = []
    for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
        row = np.full(size, np.uint64(base))
        row[0] = 1
        powers.append(np.cumprod(row, dtype=np.uint64))
    return words, *powers


class Hashes:
    """Hashes of any stretch of some bytes, equal for equal stretches wherever they lie."""

    def __init__(self, data: np.ndarray, which: int = 0):
        words, powers, self.inverse = tables(which, 1 << max(16, len(data).bit_length()))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(words[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def all(self, length: int) -> np.ndarray:
        """Those of every stretch of ``length`` bytes."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def _hull(core: np.ndarray, hull: np.ndarray, before: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A run's second digit: its bytes, its number of starts and how far its gram is from the first."""
    return mixed(hull ^ mixed(core + (before.astype(np.uint64) << np.uint64(32)) + starts.astype(np.uint64)))


def runs_of(text: bytes, depth: int) -> tuple[np.ndarray, ...]:
    """The runs of a text in order: place of the gram, first and last start, core, hull."""
    whole = np.frombuffer(text, dtype=np.uint8)
    gram = depth // 2
    width = depth - gram + 1  # grams in a window
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(whole) - depth + 1, STRETCH - depth):
        hashes = Hashes(whole[at : at + STRETCH - 1])
        ranks = hashes.all(gram)
        # the place breaks ties, so the least is the leftmost, and tells where it is
        ranks = (ranks & ~np.uint64(STRETCH - 1)) | np.arange(len(ranks), dtype=np.uint64)
        n = len(ranks) - width + 1
        blocks = np.full(-(-len(ranks) // width) * width, np.iinfo(np.uint64).max)
        blocks[: len(ranks)] = ranks
        blocks = blocks.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
        places = (least & np.uint64(STRETCH - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(places, prepend=-1))
        last = np.append(first[1:], n) - 1
        place = places[first]
        core = hashes.of(place, place + gram)
        hull = _hull(core, hashes.of(first, last + depth), place - first, last - first)
        found.append((place + at, first + at, last + at, core.view(np.int64), hull.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, dtype=np.int64) for _ in range(5))


RUNS = "key binary, place long, first long, last long, core long, hull long"


def runs(texts: DataFrame, depth: int) -> DataFrame:
    """All runs of texts (key, data): one row a run."""

    def work(batches):
        for batch in sliced(batches):
            at, made = [], []
            for i, data in enumerate(batch.column("data")):
                found = runs_of(data.as_buffer(), depth)
                at.append(np.full(len(found[0]), i))
                made.append(found)
            columns = [pa.array(np.concatenate(x)) for x in zip(*made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(np.concatenate(at))), *columns], names=["key", "place", "first", "last", "core", "hull"])

    return texts.where(F.octet_length("data") >= depth).select("key", "data").mapInArrow(work, RUNS)


def joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The batch's ``data`` end to end, and where each begins."""
    parts = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in batch.column("data")]
    return np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])


def shorter_runs(stretches: DataFrame, depth: int, step: int) -> DataFrame:
    """Cut runs (key, place, first, last, core, data: the run's bytes) into runs of at most ``step`` starts.

    Cuts are at multiples of ``step`` from the gram.  A core is that of the whole piece, though the run has only a part of it.
    """

    def work(batches):
        for batch in sliced(batches):
            data, begins = joined(batch)
            place, first, last, gram = (batch.column(c).to_numpy() for c in ("place", "first", "last", "core"))
            low, high = (place - last) // step, (place - first) // step
            row = np.repeat(np.arange(len(place)), high - low + 1)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[row]
            s1 = np.maximum(first[row], place[row] - piece * step - step + 1)
            s2 = np.minimum(last[row], place[row] - piece * step)
            hashes, shift = Hashes(data), begins[row] - first[row]
            at = place[row] - piece * step + shift
            core = mixed(hashes.of(at, at - step + 1 + depth) ^ mixed(gram[row].view(np.uint64) + piece.astype(np.uint64)))
            hull = _hull(core, hashes.of(s1 + shift, s2 + shift + depth), place[row] - s1, s2 - s1)
            columns = [batch.column("key").take(pa.array(row)), *map(pa.array, (first[row], s1, s2, core.view(np.int64), hull.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "run", "first", "last", "core", "hull"])

    return stretches.select("key", "place", "first", "last", "core", "data").mapInArrow(work, "key binary, run long, first long, last long, core long, hull long")


def windows(stretches: DataFrame, depth: int) -> DataFrame:
    """Every window of the ``pieces`` (arrays of first and last starts) of runs (key, first, data): key, start, and its bytes' hashes."""

    def work(batches):
        for batch in sliced(batches):
            data, begins = joined(batch)
            pieces = batch.column("pieces")
            sizes = np.diff(pieces.offsets.to_numpy())
            ends = pieces.flatten()
            s1, s2 = (ends.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
            row = np.repeat(np.repeat(np.arange(batch.num_rows), sizes), s2 - s1 + 1)
            start = np.arange(len(row)) - np.repeat(np.cumsum(s2 - s1 + 1) - (s2 - s1 + 1) - s1, s2 - s1 + 1)
            at = start - batch.column("first").to_numpy()[row] + begins[row]
            k1, k2 = (Hashes(data, which).of(at, at + depth) for which in (0, 1))
            columns = [batch.column("key").take(pa.array(row)), pa.array(start), pa.array(k1.view(np.int64)), pa.array((k2 >> np.uint64(32)).astype(np.uint32).view(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "first", "k1", "k2"])

    return stretches.select("key", "first", "data", "pieces").mapInArrow(work, "key binary, first long, k1 long, k2 int")


def sorted_out(found: DataFrame, name: str, scratch: Scratch, identity: list[str]) -> tuple[DataFrame, DataFrame]:
    """A pass over runs (a written table with first, last, core, hull): those that are settled, and those that go on."""
    hulls = scratch.table(found.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*identity)).alias("one")), f"{name}-hulls")
    total = hulls.count()
    cores = hulls.groupBy("core").agg(F.count(F.lit(1)).alias("hulls")).where("hulls > 1")
    several = look_up(hulls, cores, "core", "hulls", total).where("hulls is not null").select("core", "hull", "one.*")
    both = F.struct("core", "hull").alias("digits")
    again = hulls.where("n > 1").select(both, "n")
    settled = look_up(found.select("key", "first", "last", both), again, "digits", "n", found.count()).where("n is not null").select("key", "first", "last")
    return settled, scratch.table(several, f"{name}-on")


def repeated(texts: DataFrame, scratch: Scratch, depth: int = DEPTH, step: int = STEP) -> DataFrame:
    """The repeated windows of texts (key, data; key is one with data): (key, spans, copies), spans of starts, not yet joined.

    ``copies`` is at most the number of rows that have the key, and that number where it is above one.
    """
    all_runs = scratch.table(runs(texts, depth), "runs")
    total = all_runs.count()
    grams = scratch.table(all_runs.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    screen = KeyFilter(grams, "core", grams.count())
    left = look_up(screen.split(all_runs, "core").where("__maybe__").drop("__maybe__"), grams, "core", "n", total).where("n is not null").drop("n")
    left = scratch.table(left, "left")
    scratch.drop("runs", "grams")
    settled, on = sorted_out(left, "first", scratch, ["key", "place", "first", "last"])

    # the bytes of the runs that go on, each text once
    keys = scratch.table(on.select("key").distinct(), "keys")
    held = KeyFilter(keys, "key", keys.count()).split(texts.select("key", "data"), "key").where("__maybe__").groupBy("key").agg(F.first("data").alias("data"))
    stretches = held.join(on, "key").withColumn("data", F.expr(f"substring(data, cast(first as int) + 1, cast(last - first as int) + {depth})"))
    stretches = scratch.table(stretches.select("key", "place", "first", "last", "core", "data"), "stretches")
    short = scratch.table(shorter_runs(stretches, depth, step), "short")
    settled2, on2 = sorted_out(short, "second", scratch, ["key", "run", "first", "last"])

    pieces = on2.groupBy("key", "run").agg(F.collect_list(F.struct("first", "last")).alias("pieces"))
    single = stretches.select("key", "first", "data").join(pieces.withColumnRenamed("run", "first"), ["key", "first"])
    single = scratch.table(windows(single, depth), "windows")
    digits = F.struct("k1", "k2").alias("digits")
    again = scratch.table(single.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(digits, "n"), "again")
    settled3 = look_up(single.select("key", "first", digits), again, "digits", "n", single.count()).where("n is not null").select("key", "first", F.col("first").alias("last"))

    span = F.struct("first", "last")
    found = settled.groupBy("key", "first", "last").agg(F.count(F.lit(1)).alias("n")).union(settled2.union(settled3).withColumn("n", F.lit(1).cast("long")))
    return found.groupBy("key").agg(F.collect_list(span).alias("spans"), F.max("n").alias("copies"))


def joined_spans(first: np.ndarray, last: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered stretches (begin, end) of windows that start in the given spans."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate(last[order] + depth)
    new = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
    return begin[new], end[np.append(new[1:] - 1, len(end) - 1)]


def _covered(spans: DataFrame, depth: int) -> DataFrame:
    """Spans of starts as covered stretches: (key, begins, ends, copies)."""

    def work(batches):
        for batch in sliced(batches):
            begins, ends = [], []
            for row in batch.column("spans"):
                first, last = (row.values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
                b, e = joined_spans(first, last, depth)
                begins.append(b)
                ends.append(e)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(begins, kind), pa.array(ends, kind), batch.column("copies")], names=["key", "begins", "ends", "copies"])

    return spans.mapInArrow(work, "key binary, begins array<long>, ends array<long>, copies long")


def text_key(text: Column) -> Column:
    """What documents of equal bytes share."""
    return F.unhex(F.md5(text.cast("binary")))


def remove_repeats(docs: DataFrame, scratch: Scratch, depth: int = DEPTH, step: int = STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: (id_col, n_bytes, begins, ends, kept): removed stretches of bytes, and the bytes that are left."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("__id__"), text.alias("data")).withColumn("key", text_key(F.col("data")))
    covered = scratch.table(_covered(repeated(rows.select("key", "data"), scratch, depth, step), depth), "covered")
    scratch.drop("left", "first-hulls", "first-on", "keys", "stretches", "short", "second-hulls", "second-on", "windows", "again")
    split = KeyFilter(covered, "key", covered.count()).split(rows, "key")
    kind = docs.schema[id_col].dataType.simpleString()
    none = F.array().cast("array<long>")
    whole = split.where("not __maybe__").select("__id__", F.octet_length("data").cast("long").alias("n_bytes"), none.alias("begins"), none.alias("ends"), F.col("data").alias("kept"))
    less = look_up(split.where("__maybe__").drop("__maybe__"), covered, "key", "copies", docs.count())

    def work(batches):
        for batch in sliced(batches, 200):
            sizes, kept = [], []
            for data, begins, ends in zip(batch.column("data"), batch.column("begins"), batch.column("ends"), strict=True):
                buffer = memoryview(data.as_buffer())
                sizes.append(len(buffer))
                cuts = [0, *(x for pair in zip(begins.as_py(), ends.as_py(), strict=True) for x in pair), len(buffer)]
                kept.append(b"".join(buffer[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("__id__"), pa.array(sizes, pa.int64()), batch.column("begins"), batch.column("ends"), pa.array(kept, pa.binary())], names=["__id__", "n_bytes", "begins", "ends", "kept"])

    less = less.select("__id__", "data", F.coalesce("begins", none).alias("begins"), F.coalesce("ends", none).alias("ends"))
    out = whole.union(less.mapInArrow(work, f"__id__ {kind}, n_bytes long, begins array<long>, ends array<long>, kept binary"))
    return out.withColumnRenamed("__id__", id_col)


def repeat_report(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The contract's digest of ``remove_repeats``."""
    out = remove_repeats(docs, scratch)
    removed = F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda x, y: x + y)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("begins").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
