"""Near-duplicate lines: segment-partition edit join and removal of all but the first line of each class.

Two lines are linked if at most ``threshold`` characters must be inserted, deleted or replaced to turn one into the
other: one for every ``SHARE`` characters of the shorter line, ``TAU`` at most, so lines below ``SHARE`` characters are only linked to equal ones.
A line is cut into one more segment than its threshold.  If two lines are that close, some segment of the shorter one
occurs in the longer one unchanged, at a place that the lengths and the segment's number bound to a few positions.  So
each line files its segments in an index keyed by (length, number, segment) and probes it with the substrings at those
positions, for every length that it could match.  Candidates are verified by a banded bit-parallel edit distance.

Signatures never carry text.  Keys that only one line has, almost all, are dropped by a keyed minimum and maximum; a
bounded bitmap of the others screens the second pass where it makes them; the texts of the few lines left are fetched by
another scan behind a bounded filter.  Within a key's group every pair is compared: pairs whose
counts of characters differ by more than the threshold allows are told apart for a whole row at once, and only the rest is verified.
A group of more than ``CROWD`` lines is dealt to blocks, pairs of parts of at most about ``CROWD`` lines, which are tasks of their own.
A group sends the links that connect it, one a line at most, and each line's number of links; a pair that meets under
several keys is counted under the least of them, so the numbers are exact.

Equality of lines is that of a 64-bit hash (XXH64, seed 42), which takes two different lines for one by accident with
odds of lines**2 / 2**65.  Classes are the links' connected components.  The first line of a class, by (document id,
line number), stays; blank lines always stay.

Defined results: a null text has no line; repeated rows are separate documents whose lines are duplicates; a null id
comes before all others; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, Scratch, bitmap_of, components, discard, gathered, in_bitmap, look_up, sorted_groups

TAU, SHARE, CROWD = 2, 10, 512
SEED = 42
INDEX, PROBE = 0, 1
#: Groups of so few lines are compared pair by pair; others are screened by counts of characters in so many classes.
FEW, CLASSES = 6, 32


def threshold(length: int, tau: int = TAU) -> int:
    """The edits that a line of this length may be away from a longer one."""
    return min(tau, length // SHARE)


def within(a: str, b: str, tau: int) -> bool:
    """Whether the edit distance of two texts is at most ``tau``: Hyyro's bit-vector over a diagonal band."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > tau:
        return False
    least = min(len(a), len(b))
    left = next((i for i in range(0, least, 64) if a[i : i + 64] != b[i : i + 64]), least)
    while left < least and a[left] == b[left]:
        left += 1
    right = 0
    while right < least - left and a[-1 - right] == b[-1 - right]:
        right += 1
    a, b = a[left : len(a) - right], b[left : len(b) - right]
    if len(a) < len(b):
        a, b = b, a
    if len(a) <= tau or not b:
        return len(a) <= tau
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    # Bit w - 1 of the window is row j + tau of column j; the distance is followed down the band's lowest diagonal to
    # the last row and then along that row.
    width = 2 * tau + 2
    ones, top = (1 << width) - 1, 1 << (width - 1)
    plus, minus, distance = (ones << (width - tau - 1)) & ones, 0, tau
    limit, last = tau + tau + len(b) - len(a), top >> 1
    for j, c in enumerate(b):
        shift = j + tau + 1 - width
        mask = places.get(c, 0)
        equal = (mask >> shift if shift >= 0 else mask << -shift) & ones
        diagonal = ((((equal & plus) + plus) ^ plus) | equal | minus) & ones
        up, down = (minus | ~(diagonal | plus)) & ones, diagonal & plus
        if j < len(a) - tau:
            distance += not diagonal & top
        else:
            distance += bool(up & last) - bool(down & last)
            last >>= 1
        if distance > limit:
            return False
        plus, minus = (down | ~((diagonal >> 1) | up)) & ones, (diagonal >> 1) & up
    return distance <= tau


def segments(length: int, tau: int) -> list[tuple[int, int]]:
    """(start, size) of the tau + 1 even segments of a line of this length."""
    size, more = divmod(length, tau + 1)
    sizes = [size + (k > tau - more) for k in range(tau + 1)]
    return [(sum(sizes[:k]), s) for k, s in enumerate(sizes)]


@lru_cache(1 << 12)
def layout(n: int, tau: int) -> list[tuple[int, int, int, int, int]]:
    """(role, number, start, size, seed) of the index entries and probes of a line of n characters.

    The seed stands for (length, number) in the key's hash.
    """
    own = threshold(n, tau)
    out = [(INDEX, k, start, size, (n * (tau + 1) + k) & 0xFFFFFFFF) for k, (start, size) in enumerate(segments(n, own))] if own else []
    for length in range(max(0, n - tau), n + 1):
        more, edits = n - length, threshold(length, tau)
        if not edits or more > edits:
            continue
        for k, (start, size) in enumerate(segments(length, edits)):
            low = max(0, start - k, start + more - (edits - k))
            high = min(n - size, start + k, start + more + (edits - k))
            # Where neither length nor place differs, it is the index entry, which other lines of this length share.
            out += [(PROBE, k, at, size, (length * (tau + 1) + k) & 0xFFFFFFFF) for at in range(low, high + 1) if more or at != start]
    return out


def signatures(line: str, tau: int) -> list[tuple[int, int]]:
    """(key, role) of a line's index entries and probes."""
    hashed = xxhash.xxh64_intdigest
    return [(hashed(line[at : at + size], seed) - (1 << 63), role) for role, _, at, size, seed in layout(len(line), tau)]


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, id, line_no, lid, chars, line) of every line; a blank or missing line has no lid."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("uid", "id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    worded = F.col("line").rlike(r"[^\x20\x09-\x0D]")
    return rows.withColumns({"lid": F.when(worded, F.xxhash64("line")), "chars": F.when(worded, F.char_length("line"))})


def _entries(lines: DataFrame, tau: int, screen=None) -> DataFrame:
    """(key, lid) of the signatures of lines (lid, line); with a bitmap of keys as ``screen``, (key, lid, role) of those that it may hold."""
    names = ["key", "lid"] if screen is None else ["key", "lid", "role"]

    def work(batches):
        hashed = xxhash.xxh64_intdigest
        for batch in gathered(batches, 5000):
            lids, once = np.unique(batch.column("lid").to_numpy(), return_index=True)
            texts = batch.column("line").take(pa.array(once)).to_pylist()
            keys, roles, times = [], [], []
            for line in texts:
                plan = layout(len(line), tau)
                keys += [hashed(line[at : at + size], seed) for _, _, at, size, seed in plan]
                times.append(len(plan))
                if screen is not None:
                    roles += [p[0] for p in plan]
            columns = [(np.array(keys, dtype=np.uint64) ^ np.uint64(1 << 63)).view(np.int64), np.repeat(lids, times)]
            if screen is not None:
                held = in_bitmap(screen.value, columns[0])
                columns = [c[held] for c in (*columns, np.array(roles, dtype=np.int8))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return lines.select("lid", "line").mapInArrow(work, "key long, lid long" + (", role byte" if screen is not None else ""))


def profiles(lines: list[str]) -> np.ndarray:
    """How many characters of each of ``CLASSES`` classes a line has, 255 at most; an edit changes two numbers by one."""
    out = np.zeros((len(lines), CLASSES), dtype=np.int16)
    for i, line in enumerate(lines):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % CLASSES
        out[i] = np.minimum(np.bincount(codes, minlength=CLASSES), 255)
    return out


def close_pairs(lines: list[str], indexed: list[bool], parts: list[int], across: bool, tau: int):
    """Pairs (i, j) of linked lines of which one is indexed; in a block of two parts (``across``), only pairs across them."""
    n = len(lines)
    lengths = np.array([len(x) for x in lines])
    counts = profiles(lines) if n > FEW else None
    index, part = np.array(indexed), np.array(parts)
    for i in range(n):
        js = np.arange(i + 1, n)
        if counts is not None:
            js = js[(index[js] | index[i]) & (np.abs(lengths[js] - lengths[i]) <= tau)]
            js = js[np.abs(counts[js] - counts[i]).sum(axis=1) <= 2 * tau]
        for j in js.tolist():
            if (index[i] or index[j]) and (part[i] != part[j] or not across) and within(lines[i], lines[j], threshold(min(lengths[i], lengths[j]), tau)):
                yield i, j


def _link_group(rows: pa.Table, tau: int) -> list[tuple[int, int, int]]:
    """(lid, lid, 0) for links that connect what a group connects, and (lid, lid, n) for a line's n links that are counted here."""
    if rows.num_rows < 2:
        return []
    key = rows["key"][0].as_py()
    found = sorted({(r["lid"], r["role"], r["part"], r["line"]) for r in rows.select(["lid", "role", "part", "line"]).to_pylist()})
    found = [r for i, r in enumerate(found) if not i or found[i - 1][0] != r[0]]  # a line that is both is indexed
    lids, lines = [r[0] for r in found], [r[3] for r in found]
    parent = list(range(len(found)))
    keys: dict[int, tuple[set[int], set[int]]] = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def own(i):
        if i not in keys:
            signed = signatures(lines[i], tau)
            keys[i] = {k for k, role in signed if role == INDEX}, {k for k, _ in signed}
        return keys[i]

    out, times = [], [0] * len(found)
    for i, j in close_pairs(lines, [r[1] == INDEX for r in found], [r[2] for r in found], rows["x"][0].as_py() != rows["y"][0].as_py(), tau):
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((lids[i], lids[j], 0))
        (index_i, all_i), (index_j, all_j) = own(i), own(j)
        if min((index_i & all_j) | (index_j & all_i)) == key:
            times[i] += 1
            times[j] += 1
    return out + [(lids[i], lids[i], n) for i, n in enumerate(times) if n]


def near_lines(lines: DataFrame, scratch: Scratch, tau: int = TAU, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(node, root) of each line hash that is linked to another, with the smallest of its class; and (lid, links)."""
    worded = lines.where("lid is not null").select("lid", "line")
    lone = _entries(worded, tau).groupBy("key").agg(F.min("lid").alias("low"), F.max("lid").alias("high"))
    shared = scratch.table(lone.where("low <> high").select("key"), "shared")
    screen = lines.sparkSession.sparkContext.broadcast(bitmap_of(shared, "key", shared.count()))
    kept = scratch.table(_entries(worded, tau, screen).distinct().join(shared, "key", "left_semi"), "kept")
    lids = scratch.table(kept.select("lid").distinct(), "lids")
    texts = KeyFilter(lids, "lid", lids.count()).split(worded, "lid").where("__maybe__").drop("__maybe__").distinct()
    full = scratch.table(kept.join(texts, "lid"), "full")
    sizes = full.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("role").alias("low"))
    sizes = scratch.table(sizes.where(F.col("low") == INDEX).select("key", "n"), "sizes")
    known = look_up(full, sizes, "key", "n", full.count()).where("n is not null")
    known = known.withColumn("parts", F.ceil(F.col("n") / crowd)).withColumn("part", F.pmod(F.xxhash64("lid"), F.col("parts")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    blocks = known.select("key", "lid", "role", "line", "part", others).withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other")})

    def work(batches):
        for group in sorted_groups(batches, ["key", "x", "y"]):
            found = _link_group(group, tau)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], names=["a", "b", "n"])

    grouped = blocks.select("key", "x", "y", "lid", "role", "line", "part").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    found = scratch.table(grouped.mapInArrow(work, "a long, b long, n long"), "found")
    scratch.drop("shared", "kept", "lids", "full", "sizes")
    counts = found.where("n > 0").groupBy(F.col("a").alias("lid")).agg(F.sum("n").alias("links"))
    return components(found.where("n = 0").select("a", "b"), scratch), counts


def marked_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, crowd: int = CROWD) -> DataFrame:
    """(uid, id, line_no, chars, lid, links, class_id, duplicate) of every line; blank lines have no class."""
    lines = line_table(docs, id_col, text_col)
    where = scratch.table(lines.drop("line"), "lines")
    roots, counts = near_lines(lines, scratch, tau, crowd)
    sizes = where.where("lid is not null").groupBy("lid").agg(F.count(F.lit(1)).alias("n"))
    labels = sizes.join(roots, sizes["lid"] == roots["node"], "left").join(counts, "lid", "left").select("lid", "n", F.coalesce("root", "lid").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    total = where.count()
    classed = scratch.table(look_up(where, labels, "lid", "n", total).drop("n"), "classed")
    first = classed.where("class_id is not null").groupBy("class_id").agg(F.min(F.struct("id", "line_no", "uid")).alias("first"), F.count(F.lit(1)).alias("n"))
    joined = look_up(classed, first, "class_id", "n", total)
    again = F.coalesce((F.col("first.uid") != F.col("uid")) | (F.col("first.line_no") != F.col("line_no")), F.lit(False))
    return joined.select("uid", "id", "line_no", "chars", "lid", "links", "class_id", again.alias("duplicate"))


def line_report(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: its lines that have words, how many of them go, and the characters that stay; the
    classes of its lines, in order; and how many links its different lines have, each to a different text."""
    lines = marked_lines(docs, scratch, id_col, text_col, **options)
    worded = F.col("class_id").isNotNull()
    made = lines.groupBy("uid", "id").agg(
        F.count_if(worded).alias("n_lines"), F.count_if(F.col("duplicate")).alias("n_duplicates"), F.coalesce(F.sum(F.when(~F.col("duplicate"), F.col("chars").cast("long"))), F.lit(0).cast("long")).alias("kept_chars"),
        F.sort_array(F.collect_set("class_id")).alias("class_ids"), F.collect_set(F.when(worded, F.struct("lid", "links"))).alias("__links__"),
    )
    n_links = F.aggregate("__links__", F.lit(0).cast("long"), lambda a, x: a + x["links"])
    return made.select(F.col("id").alias(id_col), "n_lines", "n_duplicates", "kept_chars", "class_ids", n_links.alias("n_links"))


def drop_near_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the duplicate lines taken out of its texts; ids must be unique and not null."""
    lines = scratch.table(marked_lines(docs, scratch, id_col, text_col, **options).where("duplicate").select("id", "line_no"), "dropped")
    cuts = lines.groupBy("id").agg(F.collect_list("line_no").alias("__cuts__")).select(F.col("id").alias(id_col), "__cuts__")  # a text's lines at most
    whole = discard(docs, cuts.select(id_col), id_col)
    split = F.split(text_col, "\n")
    rest = F.array_join(F.transform(F.filter(F.transform(split, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col("__cuts__"), s["i"])), lambda s: s["x"]), "\n")
    return whole.unionByName(docs.join(cuts, id_col).withColumn(text_col, rest).select(*docs.columns))
