"""Near-duplicate texts: SimHash wide enough for a similarity of 0.8 over five-word shingles, and multi-index hashing.

``simhash`` links fingerprints of 64 bits at two differing bits, which finds only the closest copies.  Here two texts are to
be linked where their sets of shingles have a Jaccard similarity of ``SIMILARITY`` or more.  A bit of SimHash differs between two
such texts with a chance of at most ``angle(SIMILARITY)``, about 0.15, so fingerprints need hundreds of bits, and no segment
can be trusted to differ in one bit at most.  Instead:

* A fingerprint has ``plan.segments`` segments of ``plan.width`` bits, and candidates are those of at most ``plan.radius`` differing bits
  in all: what texts of just that similarity differ by on the average, plus two standard deviations.
* Each fingerprint files, for every segment, a small Hamming ball: the segment's value, and the values with one of its
  ``plan.flips`` least certain bits flipped, those with the closest votes, which are the likeliest to differ.  Two
  fingerprints meet in a segment that differs in up to two such bits.
* The width grows with the logarithm of the input, so that unrelated texts meet about once a text at any size, and the number of
  segments with the width, so that two texts of just the similarity ``SIMILARITY`` meet with a chance of ``RECALL`` at any size.

Every meeting is measured on all bits.  A key that two fingerprints share is measured as a pair; one of up to ``CROWD`` as a
group, whose candidates are a spanning forest of least distances: it connects what any threshold of
distance connects.  A more crowded key, of a group with very many near
copies, is dealt at random to groups of about ``CROWD``, each of which also gets the key's leaders, about ``LEADERS`` of its fingerprints chosen by hash:
rows grow with the group, not its square, and what two groups hold is linked by way of leaders, or by the many other keys.
What these leave apart is looked for in blocks of pairs of parts, of which only spanning forests are sent on.  So candidates make
*circles*: all fingerprints that share a key and lie within the radius, in any number of steps, are of one circle.

Candidates become links where the whole texts' sets of shingles, 64-bit hashes, have the similarity asked for.  First a spanning forest
of each circle is verified pair by pair: it joins most near copies to one class.  Sets are fetched by keyed joins, and a text with
very many candidates is copied to several tasks, so none holds all of its pairs.  Circles that are of several classes then are dealt
to blocks of pairs of parts, with the texts' sets: there all pairs of two classes within the radius are verified in the task that holds both,
and only links that join classes leave it, fewer than the block has texts.  A class of more than a part has parts of its own, which never meet each other.
So no pair is a row but those of the forests; comparisons, not rows, grow with the square of a circle that is not of one class.

Defined results: a null text, and one without words, has fingerprint zero, and such texts are linked to each other; a text of
fewer words than a shingle is one shingle; copies of one fingerprint are one node; rows with a null id belong to the component
of their fingerprint, whose component id is null if no row has an id; other columns, whatever their names, are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KeyFilter, Scratch, components, look_up, parallelism, sliced, sorted_groups

SEED, SHINGLE, SIMILARITY, RECALL = 42, 5, 0.8, 0.95
#: Bits of a segment beyond the logarithm of the number of texts, and the least width.
SPARE_BITS, LEAST_WIDTH = 8, 20
#: The share of meetings within two differing bits that the least certain bits catch (measured .75 to .85).
CAUGHT = 0.75
CROWD, LEADERS = 256, 32
#: Parts of blocks, in crowds: in which pairs are looked for that forests and leaders left out, and in which circles are verified.
BLOCK, PART = 4, 2
#: Shingles that weigh as much in a part as a text by itself does.
WEIGHED = 1024
#: Nodes of a circle for each group of its candidates whose forest is taken by itself.
GROVE = 2000
#: Pairs of one text that are verified in one task, about.
SALTED = 1000
#: More than any distance.
FAR = 1 << 30


def angle(similarity: float) -> float:
    """The chance that a bit differs between two texts whose shingle sets of one size have this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@dataclass(frozen=True)
class Plan:
    """The sizes of fingerprints for a number of texts."""

    width: int
    segments: int
    flips: int
    radius: int

    @classmethod
    def of(cls, texts: int, similarity: float = SIMILARITY, recall: float = RECALL) -> Plan:
        width, q = max(LEAST_WIDTH, math.ceil(math.log2(max(texts, 2))) + SPARE_BITS), angle(similarity)
        meet = CAUGHT * sum(math.comb(width, k) * q**k * (1 - q) ** (width - k) for k in range(3))
        segments = math.ceil(math.log(1 - recall) / math.log(1 - meet))
        bits = width * segments
        return cls(width, segments, width // 4, round(bits * q + 2 * math.sqrt(bits * q * (1 - q))))

    @property
    def words(self) -> int:
        """64-bit words of a fingerprint."""
        return -(-self.width * self.segments // 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashed shingles of a text's words, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), dtype=np.uint64, count=len(words))
    if not len(hashed):
        return hashed
    n = max(1, len(hashed) - size + 1)
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(min(size, len(hashed))):
        grams = mixed(grams + hashed[k : k + n])
    return np.unique(grams)


def sketch(text: str | None, plan: Plan, size: int = SHINGLE) -> tuple[np.ndarray, bytes]:
    """A text's fingerprint in 64-bit words, and the places of each segment's least certain bits."""
    grams, used = shingles(text, size), plan.width * plan.segments
    votes = np.zeros(plan.words * 64, dtype=np.int64)
    salts = np.arange(1, plan.words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(grams), 255):  # so many votes fit a byte
        part = mixed(grams[i : i + 255, None] + salts)
        votes += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    margin = 2 * votes - len(grams)
    set_ = margin > 0
    set_[used:] = False
    close = np.argpartition(np.abs(margin[:used]).reshape(plan.segments, plan.width), plan.flips, axis=1)[:, : plan.flips]
    return np.packbits(set_, bitorder="little").view(np.uint64), close.astype(np.uint8).tobytes()


def _columns(plan: Plan) -> list[str]:
    return [f"f{k}" for k in range(plan.words)]


def sketches(docs: DataFrame, plan: Plan, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, f0, f1, ..., close) of every row."""

    def work(batches):
        for batch in sliced(batches):
            found = [sketch(x, plan, size) for x in batch.column("_text").to_pylist()]
            prints = np.array([x[0] for x in found], dtype=np.uint64).reshape(len(found), plan.words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(np.ascontiguousarray(prints[:, k])) for k in range(plan.words)), pa.array([x[1] for x in found], pa.binary())], names=["id", *_columns(plan), "close"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).mapInArrow(work, ", ".join([f"id {kind}", *(f"{c} long" for c in _columns(plan)), "close binary"]))


def entries(points: DataFrame, plan: Plan) -> DataFrame:
    """(key, node): the segments' balls of every fingerprint; a key is a segment's number and value."""

    def work(batches):
        powers = np.int64(1) << np.arange(plan.width, dtype=np.int64)
        for batch in sliced(batches):
            n = batch.num_rows
            prints = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _columns(plan)], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")[:, : plan.width * plan.segments]
            values = bits.reshape(n, plan.segments, plan.width).astype(np.int64) @ powers
            values |= np.arange(plan.segments, dtype=np.int64) << np.int64(plan.width)
            close = np.frombuffer(b"".join(batch.column("close").to_pylist()), dtype=np.uint8).reshape(n, plan.segments, plan.flips)
            balls = np.concatenate([values[:, :, None], values[:, :, None] ^ powers[close]], axis=2)
            nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), plan.segments * (plan.flips + 1))
            yield pa.RecordBatch.from_arrays([pa.array(balls.ravel()), pa.array(nodes)], names=["key", "node"])

    return points.select("node", *_columns(plan), "close").mapInArrow(work, "key long, node long")


def forests(prints: np.ndarray, radius: int, count: int = 1) -> Iterator[tuple[int, int, int]]:
    """Edges (i, j, distance) of ``count`` spanning forests of least distances up to ``radius``, each without the edges of those before."""
    apart = np.stack([np.bitwise_count(prints ^ p).sum(axis=1, dtype=np.int32) for p in prints])
    np.fill_diagonal(apart, FAR)
    apart[apart > radius] = FAR
    for _ in range(count):
        if apart.min() == FAR:
            return
        best, source = apart[0].copy(), np.zeros(len(prints), dtype=np.int64)
        best[0] = FAR + 1  # already in a tree
        for _ in range(len(prints) - 1):
            at = int(best.argmin())
            if best[at] < FAR:
                i = int(source[at])
                yield i, at, int(best[at])
                apart[i, at] = apart[at, i] = FAR
            best[at] = FAR + 1
            closer = (apart[at] < best) & (best <= FAR)
            best[closer], source[closer] = apart[at][closer], at


def _group_candidates(plan: Plan):
    """Candidates of groups that come sorted by (key, part)."""

    def work(batches):
        for group in sorted_groups(batches, ["key", "part"]):
            prints = np.stack([group[c].to_numpy() for c in _columns(plan)], axis=1).view(np.uint64)
            found = list(forests(prints, plan.radius))
            if found:
                nodes, edges = group["node"].to_numpy(), np.array(found, dtype=np.int64)
                ends = np.sort(nodes[edges[:, :2]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (ends[:, 0], ends[:, 1], edges[:, 2])], names=["a", "b", "apart"])

    return work


def printed(rows: DataFrame, points: DataFrame, plan: Plan, *columns: str) -> DataFrame:
    """``rows`` with their nodes' fingerprints, which are joined once a node; a node has no more rows than its balls have keys."""
    listed = rows.groupBy("node").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return listed.join(points.select("node", *_columns(plan)), "node").select("node", *_columns(plan), F.inline("rows"))


def candidates(points: DataFrame, plan: Plan, scratch: Scratch, crowd: int = CROWD, leaders: int = LEADERS) -> DataFrame:
    """Pairs (a, b, apart), a < b, of nodes of ``points`` (node, f0, ..., close) within the radius, each once."""
    filed = entries(points, plan)
    counted = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"))
    shared = scratch.table(counted.where("n > 1"), "shared")
    # keys of two: the pair is known
    prints = points.select("node", F.array(*_columns(plan)).alias("f"))
    pairs = shared.where("n = 2").select("a", "b").distinct()
    pairs = pairs.join(prints.select(F.col("node").alias("a"), F.col("f").alias("x")), "a").join(prints.select(F.col("node").alias("b"), F.col("f").alias("y")), "b")
    apart = sum((F.bit_count(F.get("x", F.lit(k)).bitwiseXOR(F.get("y", F.lit(k)))) for k in range(plan.words)), F.lit(0))
    found = pairs.select("a", "b", apart.cast("long").alias("apart")).where(F.col("apart") <= plan.radius)
    # keys of more
    more = scratch.table(shared.where("n > 2").select("key", "n"), "more")
    held = KeyFilter(more, "key", more.count()).split(filed, "key").where("__maybe__").drop("__maybe__")
    held = scratch.table(held, "held")
    members = scratch.table(look_up(held, more, "key", "n", held.count()).where("n is not null").select("key", "node", "n"), "members")
    held = printed(members, points, plan, "key", "n").withColumn("parts", F.ceil(F.col("n") / crowd)).withColumn("part", F.pmod(F.xxhash64("key", "node"), F.col("parts")))
    leader = (F.col("parts") > 1) & (F.pmod(F.xxhash64("node", "key", F.lit(SEED)), F.col("n")) < leaders)
    lead = held.where(leader).withColumn("own", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("part <> own")
    dealt = held.unionByName(lead.select(*held.columns)).select("key", "part", "node", *_columns(plan))
    grouped = dealt.repartition("key", "part").sortWithinPartitions("key", "part")
    return found.union(grouped.mapInArrow(_group_candidates(plan), "a long, b long, apart long")).groupBy("a", "b").agg(F.min("apart").alias("apart"))


def _joined(roots: np.ndarray, i: int, near: np.ndarray) -> np.ndarray:
    """The first of ``near`` of each class, all of which become one with that of ``i`` in ``roots``."""
    found, at = np.unique(roots[near], return_index=True)
    roots[np.isin(roots, found)] = roots[i]
    return near[at]


def _block_pairs(plan: Plan, spanning: bool, batch_size: int = 100_000):
    """Pairs within the radius, of different classes, of blocks that come sorted by (key, low, high): the pairs of a part, or between two.

    With ``spanning`` only those of them that join classes which the block's pairs before do not join.
    """

    def work(batches):
        for group in sorted_groups(batches, ["key", "low", "high"]):
            nodes, roots, parts = (group[c].to_numpy().copy() for c in ("node", "root", "part"))
            prints = np.stack([group[c].to_numpy() for c in _columns(plan)], axis=1).view(np.uint64)
            inside, out, size = group["low"][0] == group["high"][0], [], 0
            for i in range(len(nodes) - 1):
                other = np.flatnonzero((roots[i + 1 :] != roots[i]) & (inside or parts[i + 1 :] != parts[i])) + i + 1
                near = other[np.bitwise_count(prints[other] ^ prints[i]).sum(axis=1, dtype=np.int64) <= plan.radius]
                if spanning and len(near):
                    near = _joined(roots, i, near)
                out.append(np.stack([np.minimum(nodes[near], nodes[i]), np.maximum(nodes[near], nodes[i])], axis=1))
                size += len(near)
                if size >= batch_size or i == len(nodes) - 2:
                    ends, out, size = np.concatenate(out), [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, k])) for k in range(2)], names=["a", "b"])

    return work


def unmet(members: DataFrame, points: DataFrame, roots: DataFrame, plan: Plan, block: int, spanning: bool = False) -> DataFrame:
    """All pairs (a, b), a < b, within the radius that share a key and are in different classes, each once.

    With ``spanning`` only so many of them as join the same classes: fewer than a block has classes.

    ``members`` has key, node and n, how many share the key; ``roots`` node and root.  Keys whose members are all in one class are left
    out; the others are dealt to blocks of pairs of parts of about ``block``, so rows in a task are bounded and no pair is passed over.
    """
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    dealt = printed(rooted.join(mixed, "key", "left_semi"), points, plan, "key", "n", "root").withColumn("parts", F.ceil(F.col("n") / block)).withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")))
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("key", "node", "root", "part", F.least("part", "q").alias("low"), F.greatest("part", "q").alias("high"), *_columns(plan))
    blocks = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return blocks.mapInArrow(_block_pairs(plan, spanning), "a long, b long").distinct()


def shingle_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, grams): the shingles of at least the rows of ``docs`` whose id is among ``nodes``, each once; no text is shuffled."""

    def work(batches):
        for batch in sliced(batches, 100):
            grams = [shingles(x, size).view(np.int64) for x in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(grams, pa.list_(pa.int64()))], names=["node", "grams"])

    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("_text")).where("node is not null")
    maybe = KeyFilter(nodes, "node", nodes.count()).split(rows, "node").where("__maybe__")
    made = maybe.select("node", "_text").mapInArrow(work, "node long, grams array<long>")
    return made.withColumn("hash", F.xxhash64("grams")).dropDuplicates(["node", "hash"]).drop("hash")  # repeated rows


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts' sets of shingles have the similarity; of an id with several texts, any two."""
    n, rows, salts = pairs.count(), pairs.select("a", "b"), F.ceil(F.col("n") / SALTED)
    degrees = {c: pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n")) for c in ("a", "b")}
    for c, degree in degrees.items():
        rows = look_up(rows, degree, c, "n", n).withColumn(f"{c}_salt", F.pmod(F.xxhash64("a", "b"), salts)).drop("n")
    for c, degree in degrees.items():
        copies = degree.select(c, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias(f"{c}_salt"))
        rows = rows.join(sets.select(F.col("node").alias(c), F.col("grams").alias(f"{c}_grams")).join(copies, c), [c, f"{c}_salt"])
    rows = rows.select("a", "b", (F.size("a_grams") + F.size("b_grams")).alias("both"), F.size(F.array_intersect("a_grams", "b_grams")).alias("common"))
    return rows.where(F.col("common") / F.nullif(F.col("both") - F.col("common"), F.lit(0)) >= similarity).select("a", "b").distinct()


def _groves(batches):
    """The pairs of spanning forests of least distances, of groups that come sorted by (circle, grove, apart, a, b)."""
    for group in sorted_groups(batches, ["circle", "grove"]):
        ends, root, kept = np.stack([group[c].to_numpy() for c in ("a", "b")], axis=1), {}, []

        def find(x, root=root):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for k, (a, b) in enumerate(ends.tolist()):
            a, b = find(a), find(b)
            if a != b:
                root[a] = b
                kept.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[kept, c])) for c in range(2)], names=["a", "b"])


def forest(found: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of the candidates ``found`` (a, b, apart), spanning forests of least distances of each circle's.

    ``placed`` has node, circle and n, the circle's nodes.  Candidates of a large circle are dealt to several groups, each of which
    keeps fewer pairs than the circle has nodes, so none holds a whole circle.
    """
    degree = found.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    rows = look_up(found, degree.join(placed.withColumnRenamed("node", "a"), "a"), "a", "degree", found.count())
    rows = rows.select("a", "b", "apart", "circle", F.pmod(F.xxhash64("a", "b"), F.ceil(F.col("n") / GROVE)).alias("grove"))
    return rows.repartition("circle", "grove").sortWithinPartitions("circle", "grove", "apart", "a", "b").mapInArrow(_groves, "a long, b long")


def _block_links(plan: Plan, similarity: float):
    """Verified links (a, b) that join classes, of blocks that come sorted by (circle, low, high): of a part, or between two."""

    def work(batches):
        for group in sorted_groups(batches, ["circle", "low", "high"]):
            nodes, roots, parts = (group[c].to_numpy().copy() for c in ("node", "root", "part"))
            prints = np.stack([group[c].to_numpy() for c in _columns(plan)], axis=1).view(np.uint64)
            grams = group["grams"].combine_chunks()
            sizes = np.array(grams.value_lengths())
            ends = np.cumsum(sizes)
            own = np.unique(grams.flatten().to_numpy(), return_inverse=True)[1]  # the block's shingles, numbered
            sets, held = [own[end - n : end] for n, end in zip(sizes, ends, strict=True)], np.zeros(len(own), dtype=bool)
            inside, found = group["low"][0] == group["high"][0], []
            for i in range(len(nodes) - 1):
                other = np.flatnonzero((roots[i + 1 :] != roots[i]) & (inside or parts[i + 1 :] != parts[i]) & (sizes[i + 1 :] > 0)) + i + 1
                near = other[np.bitwise_count(prints[other] ^ prints[i]).sum(axis=1, dtype=np.int64) <= plan.radius]
                if not len(near):
                    continue
                held[sets[i]] = True
                starts = np.cumsum(sizes[near]) - sizes[near]
                common = np.add.reduceat(held[np.concatenate([sets[j] for j in near])], starts, dtype=np.int64)
                held[sets[i]] = False
                near = near[common / (sizes[near] + sizes[i] - common) >= similarity]
                if len(near):
                    found += [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for j in _joined(roots, i, near)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return work


def late_links(placed: DataFrame, roots: DataFrame, points: DataFrame, sets: DataFrame, plan: Plan, scratch: Scratch, similarity: float, part: int) -> DataFrame:
    """Links (a, b) that join all classes which pairs of one circle within the radius, with the similarity, join.

    ``placed`` has node and circle, ``roots`` node and root, its class.  Circles of one class are left out.  A text weighs 1, and as much
    again for each ``WEIGHED`` shingles; a part weighs about ``part``, whatever the circle's size.
    """
    weights = sets.groupBy("node").agg(F.sum(1 + F.floor(F.size("grams") / WEIGHED)).alias("w"))
    rows = placed.select("node", "circle").join(roots, "node", "left").join(weights, "node").withColumn("root", F.coalesce("root", "node"))
    rows = scratch.table(rows, "classed")
    classes = scratch.table(rows.groupBy("circle", "root").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")), "classes")
    large = F.ceil(F.when(F.col("w") > part, F.col("w")) / part)  # a large class's own parts
    pooled = F.ceil(F.sum(F.when(F.col("w") <= part, F.col("w"))) / part)
    circles = classes.groupBy("circle").agg(F.coalesce(pooled, F.lit(0)).alias("pool"), F.coalesce(F.sum(large), F.lit(0)).alias("own"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    circles = circles.where("k > 1").drop("k")
    before = F.sum("parts").over(Window.partitionBy("circle").orderBy("root").rowsBetween(Window.unboundedPreceding, -1))
    places = classes.where(F.col("w") > part).select("circle", "root", large.alias("parts")).withColumn("first", F.coalesce(before, F.lit(0)))
    dealt = look_up(rows.select("node", "circle", "root"), circles, "circle", "n", rows.count()).where("n is not null").drop("n")
    sized = places.join(classes.select("circle", "root", "n"), ["circle", "root"]).select("root", "n", "parts", F.col("first").alias("at"))
    dealt = look_up(dealt, sized, "root", "n", rows.count()).drop("n")
    first, hashed = F.col("pool") + F.col("at"), F.xxhash64("node")
    dealt = dealt.withColumn("part", F.coalesce(first + F.pmod(hashed, F.col("parts")), F.pmod(hashed, F.nullif("pool", F.lit(0)))))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("pool") + F.col("own") - 1), lambda q: F.coalesce((q < first) | (q >= first + F.col("parts")), F.lit(True)))
    dealt = dealt.withColumn("q", others).hint("merge").join(points.select("node", *_columns(plan)), "node").hint("merge").join(sets, "node")
    dealt = dealt.withColumn("q", F.explode("q")).select("circle", F.least("part", "q").alias("low"), F.greatest("part", "q").alias("high"), "part", "node", "root", *_columns(plan), "grams")
    return dealt.repartition("circle", "low", "high").sortWithinPartitions("circle", "low", "high").mapInArrow(_block_links(plan, similarity), "a long, b long")


def near_texts(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, crowd: int = CROWD, leaders: int = LEADERS
) -> DataFrame:
    """One row per row of ``docs``: (id_col, component_id), the smallest id that links of near-duplicate texts reach."""
    plan = Plan.of(docs.count(), similarity)
    prints = scratch.table(sketches(docs, plan, id_col, text_col, size), "prints")
    same = prints.groupBy(*_columns(plan)).agg(F.min("id").cast("long").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("close").alias("close"))
    # a small table makes many entries: about a million of them a task
    tasks = max(parallelism(docs.sparkSession), math.ceil(prints.count() * plan.segments * (plan.flips + 1) / 1e6))
    points = scratch.table(same.repartition(tasks), "points")
    found = scratch.table(candidates(points.where("node is not null"), plan, scratch, crowd, leaders), "candidates")
    scratch.drop("shared", "more", "held")
    # circles: what forests and leaders left apart is looked for
    circles = scratch.table(components(found, scratch), "circles")
    members = docs.sparkSession.read.parquet(scratch.path("members"))
    apart = scratch.table(unmet(members, points, circles, plan, max(1, round(BLOCK * crowd)), spanning=True), "apart")
    if apart.count():
        circles = scratch.table(components(found.select("a", "b").union(apart), scratch), "all_circles")
    circles = circles.withColumnRenamed("root", "circle")
    placed = scratch.table(look_up(circles, circles.groupBy("circle").agg(F.count(F.lit(1)).alias("n")), "circle", "n", circles.count()), "placed")
    sets = scratch.table(shingle_sets(docs, placed.select("node"), id_col, text_col, size), "sets")
    pairs = scratch.table(forest(found, placed).union(apart).distinct(), "pairs")
    near = scratch.table(verified(pairs, sets, similarity), "links")
    roots = scratch.table(components(near, scratch), "roots")
    late = scratch.table(late_links(placed, roots, points, sets, plan, scratch, similarity, max(1, round(PART * crowd))).distinct(), "late")
    if late.count():
        roots = scratch.table(components(near.union(late), scratch), "all_roots")
    scratch.drop("sets", "candidates", "members", "apart", "circles", "all_circles", "placed", "pairs", "links", "late", "classed", "classes")
    labels = points.join(roots, "node", "left").select(F.struct(*_columns(plan)).alias("print"), "copies", F.coalesce("root", "node").alias("component_id"))
    rows = prints.select("id", F.struct(*_columns(plan)).alias("print"))
    return look_up(rows, labels, "print", "copies", prints.count()).select(F.col("id").alias(id_col), "component_id")
