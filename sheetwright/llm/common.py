"""Shared pieces: scratch tables in the cluster's shared folder, bounded membership filters, connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bits in a membership filter: 2**26 bits are 8 MB, whatever the input's size.
FILTER_BITS = 1 << 26
#: Most keys that a lookup broadcasts.
HOT_KEYS = 4096
#: Positions that one row of Spark's bitmap aggregate covers.
BITMAP_ROW = 32768
#: Most rows of an Arrow batch: Spark's default of 10,000 whole texts is held twice in the JVM and twice in a Python worker.
BATCH_ROWS = 1000
#: Links that are contracted at a time.
CONTRACTED = 100_000


def sliced(batches, rows: int = 1000):
    """Arrow batches in slices of at most ``rows`` rows, which bounds what is unpacked at once; slices share memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS, which bounds what a small executor holds beside its heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def gathered(batches, rows: int):
    """Arrow batches of narrow rows put together until they have at least ``rows``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.concat_batches(held)
            held, size = [], 0
    if size:
        yield pa.concat_batches(held)


class Scratch:
    """Tables written once under the shared folder in ``spark.checkpoint.dir`` and read back.

    A written table cuts the lineage: an executor that is lost later costs a reread, not a recomputation.  Where the
    session names no folder, a session of one process, as in tests, gets one of its own until it ends; a cluster's is an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("sheetwright.scratch", None)
        if not top:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="sheetwright-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            top = "file://" + folder
            spark.conf.set("sheetwright.scratch", top)
        self.root = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the reread table."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads; with no name, everything of this scratch."""
        for path in map(self.path, names) if names else [self.root]:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filter_bits(n_keys: int) -> int:
    """Bits of a filter for ``n_keys`` keys: a power of two, sixteen a key while that fits the bound."""
    return min(FILTER_BITS, max(BITMAP_ROW, 1 << max(0, (16 * max(n_keys, 1) - 1)).bit_length()))


class KeyFilter:
    """A one-hash membership filter over the values of a column: no false negatives, at most FILTER_BITS bits.

    The filter is a table of at most 2048 rows of 4 kB.  That bound does not depend on the input, so it may be
    broadcast: a scan tests its rows before any shuffle and only rows that may match are moved.  Where the filter is
    full, more rows are moved and the exact test that follows decides, so results never depend on it.
    """

    def __init__(self, keys: DataFrame, column: str, n_keys: int):
        self.bits = filter_bits(n_keys)
        position = self._position(F.col(column))
        self.table = (
            keys.select(position.alias("p"))
            .groupBy(F.bitmap_bucket_number("p").alias("__bucket__"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bitmap__"))
        )

    def _position(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits)) + F.lit(1)

    def split(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with a boolean column ``__maybe__``: false where the key is surely not among the filter's."""
        position = self._position(F.col(column))
        bit = F.bitmap_bit_position(position)
        byte = F.conv(F.hex(F.expr("substring(__bitmap__, cast(__bit__ div 8 as int) + 1, 1)")), 16, 10).cast("int")
        hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(__bit__ % 8 as int))")) != 0
        return (
            df.withColumns({"__bucket__": F.bitmap_bucket_number(position), "__bit__": bit})
            .join(F.broadcast(self.table), "__bucket__", "left")
            .withColumn("__maybe__", F.coalesce(hit, F.lit(False)))
            .drop("__bucket__", "__bit__", "__bitmap__")
        )


def bitmap_of(keys: DataFrame, column: str, n_keys: int) -> np.ndarray:
    """The same filter of a column of 64-bit hashes, as bytes on the driver: a power of two of them, 8 MB at most."""
    bits = filter_bits(n_keys)
    position = F.pmod(column, F.lit(bits)) + F.lit(1)
    rows = keys.select(position.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        at = (r["b"] - 1) * (BITMAP_ROW // 8)
        out[at : at + BITMAP_ROW // 8] = np.frombuffer(r["m"], dtype=np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash whether the filter may hold it."""
    at = hashes & np.int64(len(bitmap) * 8 - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def sorted_groups(batches, keys: list[str]):
    """The groups of rows of equal keys, as tables, from Arrow batches that come sorted by them; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if last is not None and any(c[0] != x for c, x in zip(columns, last, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        last = [c[-1] for c in columns]
        starts = [0, *cuts.tolist()]
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            if start:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def discard(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is not in ``dropped`` (one column, the key; nulls never match).

    Rows that surely stay pass straight from the scan; only rows that the bounded filter marks are shuffled.
    """
    screen = KeyFilter(dropped.select(key), key, dropped.count())
    split = screen.split(docs, key)
    sure = split.where(~F.col("__maybe__")).drop("__maybe__")
    unsure = split.where(F.col("__maybe__")).drop("__maybe__")
    return sure.unionByName(unsure.join(dropped.select(key), key, "left_anti").select(*docs.columns))


def look_up(rows: DataFrame, table: DataFrame, key: str, weight: str, n_rows: int) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has each key once and in ``weight`` how many rows hold it.

    A key that more than one row in HOT_KEYS holds is hot; there can be at most HOT_KEYS such keys, so that part of the
    table may be broadcast whatever the input's size, and the shuffled rest has no key with a large share of the rows.
    """
    hot = F.col(weight) > max(1, n_rows // HOT_KEYS)
    own = [c for c in table.columns if c != key]
    first = rows.join(F.broadcast(table.where(hot).withColumn("__hot__", F.lit(True))), key, "left")
    rest = first.where("__hot__ is null").drop("__hot__", *own).join(table.where(~hot), key, "left")
    return first.where("__hot__").drop("__hot__").unionByName(rest)


def _contract(batches):
    """Spanning stars of many links at a time: each node with the smallest node that they connect it to."""
    for batch in gathered(batches, CONTRACTED):
        parent: dict[int, int] = {}

        def find(x):
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        out = [(x, r) for x in parent if (r := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], names=["a", "b"])


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b), both long: one row (node, root) for each node that has a link.

    ``root`` is the component's smallest node.  Links are first contracted to stars batch by batch, which bounds what
    a dense group sends on; then minimum labels spread and jump (large-star and small-star steps), with the links
    written after each round.  All steps are keyed aggregates and joins: no group is gathered anywhere.  Once at most
    CONTRACTED links are left, which is one batch, their stars are the components: small inputs take no rounds.
    """
    spark = links.sparkSession
    stars = links.select("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long")
    now = scratch.table(stars.distinct(), "links0")
    last, total = None, now.count()
    for k in range(most_rounds):
        if total <= CONTRACTED:
            if total:
                now = scratch.table(now.coalesce(1).mapInArrow(_contract, "a long, b long"), f"links{k + 1}")
                scratch.drop(f"links{k}")
            break
        # large star: each node tells its larger neighbours of its smallest neighbour
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        # a star's centre holds as many links as the star has nodes
        large = look_up(both, least, "a", "n", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node ties its smaller neighbours, and itself, to the smallest of them
        down = large.where("a > b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = scratch.table(small.union(low.select("a", F.col("m").alias("b"))).distinct(), f"links{k + 1}")
        count, both_sides = now.count(), now.select("a").intersect(now.select("b")).limit(1).count()
        scratch.drop(f"links{k}")
        total = count
        if not both_sides and now.groupBy("a").count().where("count > 1").limit(1).count() == 0:
            break
        last = count
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds ({last} links)")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots) if total else spark.createDataFrame([], "node long, root long")
