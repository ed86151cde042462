"""Compaction of a folder of Parquet files: bins are packed from a manifest, then the files are really rewritten.

1. ``write_files`` writes a table into a new folder, a file for each (day, lot, piece), each sorted by time and id.  Days with
   many rows have several lots, so a file's share of the table is bounded; there are fewer than 200 such days, whatever the
   table's size, as each holds over one row in 200, and only they are broadcast.
2. ``packed`` sorts the manifest, one row a file, by a secondary sort of an RDD: dealt by day, and in a task by day, descending
   rows, lot and piece.  Each partition is streamed: the open groups of a day are a linked list in the order of opening; a file joins the
   first that has room for it, and a group is unlinked as soon as its room is below the day's smallest file, so the walk meets
   only groups that may still take one.
3. ``rewrite`` streams each group of several files, in joining order, into one new file, a task a group, a row group at a time.
   Only when all are complete are the replaced files deleted.
4. ``report`` reads the files that are left back.

Files are written beside the folder and moved into it when they are whole, so the folder never holds part of one, and
a task that is run again replaces its own files by equal ones.  A file's rows pass one task as a stream and are never held whole.

Defined results: a null time is a day of its own (null), which comes first; a null id counts as hash zero, comes first among
equal times, is left out of least and largest, and is an empty string in the digest; a value that is null or not finite adds
no cents; rows of equal time and id may be in any order; an empty table gives no file and an empty result; other
columns are copied as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, parallelism
from .warc import store

#: A row group is written once it has so many rows or bytes.
GROUP_ROWS, GROUP_BYTES = 1 << 17, 64 << 20
#: Shares of a table: days of more than one part in LOTS are dealt to lots, files below one in SMALL are packed, groups hold one in FULL at most.
LOTS, SMALL, FULL = 200, 750, 300
MANIFEST = "day long, lot long, piece long, n_rows long, name string"
FILES = "day long, lot long, piece long, n_rows long, names array<string>, sources string"


def share(rows: int, parts: int) -> int:
    """More than one part in ``parts`` of ``rows`` rows, by the least."""
    return 1 + rows // parts


def file_name(day: int | None, lot: int, piece: int, files: int = 1) -> str:
    return f"{'null' if day is None else day}-{lot}-{piece}{f'-and-{files - 1}-more' if files > 1 else ''}.parquet"


class Writer:
    """A Parquet file of a folder, written elsewhere in row groups of bounded size and moved there when it is whole."""

    def __init__(self, folder: str, name: str, schema: pa.Schema):
        self.store, root = store(folder)
        self.spare, self.path = f"{root}-parts/{name}.{TaskContext.get().taskAttemptId()}", f"{root}/{name}"
        for path in (root, f"{root}-parts"):
            self.store.create_dir(path, recursive=True)
        self.sink = self.store.open_output_stream(self.spare)
        self.file = pq.ParquetWriter(self.sink, schema, compression="snappy")
        self.schema, self.held, self.size, self.bytes, self.rows = schema, [], 0, 0, 0

    def write(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.size += batch.num_rows
        self.rows += batch.num_rows
        self.bytes += batch.nbytes
        if self.size >= GROUP_ROWS or self.bytes >= GROUP_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.file.write_table(pa.Table.from_batches(self.held, self.schema), row_group_size=max(1, self.size))
        self.held, self.size, self.bytes = [], 0, 0

    def close(self) -> None:
        self._flush()
        self.file.close()
        self.sink.close()
        self.store.move(self.spare, self.path)


def write_files(rows: DataFrame, scratch: Scratch, folder: str, time_col: str, id_col: str) -> tuple[DataFrame, int]:
    """Write ``rows`` to ``folder``; the manifest (day, lot, piece, n_rows, name), one row a file, and the number of rows."""
    names = ["day", "lot", "piece"]
    day, lot, piece = names
    columns = rows.columns  # they may have any names, so they are numbered until they are written
    time_at, id_at = (f"c{columns.index(c)}" for c in (time_col, id_col))
    own = rows.toDF(*(f"c{i}" for i in range(len(columns))))
    key = F.coalesce(F.crc32(F.col(id_at).cast("string").cast("binary")), F.lit(0).cast("long"))
    dated = own.withColumn(day, F.unix_date(F.to_date(time_at)).cast("long"))
    days = scratch.table(dated.groupBy(day).agg(F.count(F.lit(1)).alias("n")), "days")
    total = days.agg(F.sum("n")).first()[0] or 0
    many = F.broadcast(days.where(F.col("n") >= share(total, LOTS)).select(F.col(day).alias("__many__"), (1 + F.floor(F.col("n") / share(total, LOTS))).alias("__lots__")))
    dealt = dated.join(many, F.col(day).eqNullSafe(F.col("__many__")), "left")
    dealt = dealt.withColumns({lot: F.shiftright(key, 4) % F.coalesce("__lots__", F.lit(1)), piece: F.least(key % 4, F.shiftright(key, 2) % 4)})
    dealt = dealt.select(*own.columns, *names).repartition(parallelism(rows.sparkSession), *names).sortWithinPartitions(*names, time_at, id_at)
    width = len(columns)

    def work(batches):
        now, out = None, None
        made: list[tuple] = []

        def done():
            if out is not None:
                out.close()
                made.append((*now, out.rows, file_name(*now)))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(width + i) for i in range(3)]
            marks = [pc.fill_null(k, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False) for k in keys]
            cuts = [0, *(np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1).tolist(), batch.num_rows]
            own = batch.select(list(range(width))).rename_columns(columns)
            for start, end in zip(cuts, cuts[1:], strict=False):
                found = tuple(k[start].as_py() for k in keys)
                if found != now:
                    done()
                    now, out = found, Writer(folder, file_name(*found), own.schema)
                out.write(own.slice(start, end - start))
        done()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], names=["day", "lot", "piece", "n_rows", "name"])

    return scratch.table(dealt.mapInArrow(work, MANIFEST), "manifest"), total


class Group:
    """An open group: its files, the room that is left, and the group that was opened after it."""

    __slots__ = ("after", "files", "room")

    def __init__(self, room: int):
        self.files, self.room, self.after = [], room, None


def first_fit(files: Iterable[tuple[int, object]], most: int, least: int) -> list[list]:
    """Groups of files (rows, file), each file in the earliest-opened group that then holds at most ``most`` rows.

    ``least`` is the smallest file's rows: a group with less room is taken off the list of open ones.
    """
    groups: list[list] = []
    head = last = Group(0)  # stands before the first open group
    for rows, file in files:
        before, group = head, head.after
        while group is not None and group.room < rows:
            before, group = group, group.after
        if group is None:
            group = last.after = Group(most)
            before, last = last, group
            groups.append(group.files)
        group.files.append(file)
        group.room -= rows
        if group.room < least:
            before.after = group.after
            if last is group:
                last = before
    return groups


def packed(manifest: DataFrame, total: int) -> DataFrame:
    """The files that shall be left (day, lot, piece, n_rows, names, sources): the first source's key, all sources in joining order."""
    small, most, lanes = share(total, SMALL), share(total, FULL), parallelism(manifest.sparkSession)
    little = F.col("n_rows") < small
    least = manifest.where(little).groupBy(F.col("day").alias("__day__")).agg(F.min("n_rows").alias("least"))
    rows = manifest.where(little).join(least, F.col("day").eqNullSafe(F.col("__day__"))).select("day", "lot", "piece", "n_rows", "name", "least")

    def keyed(r):
        return (-1 if r.day is None else r.day, r.day is not None, -r.n_rows, r.lot, r.piece), (r.day, r.lot, r.piece, r.n_rows, r.name, r.least)

    def stream(items: Iterator) -> Iterator[tuple]:
        def left(files):
            least = files[0][5]
            for group in first_fit(((f[3], f) for f in files), most, least):
                day, lot, piece = group[0][:3]
                yield day, lot, piece, sum(f[3] for f in group), [f[4] for f in group], ",".join(f"{f[1]}-{f[2]}" for f in group)

        day, held = None, []  # the files of one day, fewer than 4 * (LOTS + 1)
        for key, file in items:
            if held and key[:2] != day:
                yield from left(held)
                held = []
            day = key[:2]
            held.append(file)
        if held:
            yield from left(held)

    groups = rows.rdd.map(keyed).repartitionAndSortWithinPartitions(lanes, lambda key: key[0]).mapPartitions(stream)
    large = manifest.where(~little).select("day", "lot", "piece", "n_rows", F.array("name").alias("names"), F.concat_ws("-", "lot", "piece").alias("sources"))
    return manifest.sparkSession.createDataFrame(groups, FILES).union(large)


def rewrite(files: DataFrame, scratch: Scratch, folder: str) -> DataFrame:
    """Replace each group of several files by one; (day, lot, piece, n_rows, sources, name, rewritten) of the files that are left."""
    several = F.size("names") > 1
    groups = scratch.table(files, "groups")
    keep = ["day", "lot", "piece", "n_rows", "sources", "name"]

    def merge(batches):
        for batch in batches:
            named = []
            for r in batch.to_pylist():
                fs, root = store(folder)
                out = None
                for source in r["names"]:
                    with fs.open_input_file(f"{root}/{source}") as f:
                        parquet = pq.ParquetFile(f)
                        out = out or Writer(folder, file_name(r["day"], r["lot"], r["piece"], len(r["names"])), parquet.schema_arrow)
                        for part in parquet.iter_batches(batch_size=GROUP_ROWS // 8):
                            out.write(part)
                if out.rows != r["n_rows"]:
                    raise ValueError(f"{out.path} has {out.rows} rows instead of {r['n_rows']}")
                out.close()
                named.append(out.path.rpartition("/")[2])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(named, pa.string())], names=[*batch.schema.names, "name"])

    def remove(batches):
        for batch in batches:
            fs, root = store(folder)
            for name in pc.list_flatten(batch.column("names")).to_pylist():
                try:
                    fs.delete_file(f"{root}/{name}")
                except FileNotFoundError:  # an earlier run of this task has
                    pass
            yield batch.select(keep)

    dealt = groups.where(several).repartition(parallelism(files.sparkSession), "day", "lot", "piece")
    merged = scratch.table(dealt.mapInArrow(merge, f"{FILES}, name string"), "merged")  # every new file is complete before one is deleted
    left = scratch.table(merged.mapInArrow(remove, "day long, lot long, piece long, n_rows long, sources string, name string"), "left")
    return left.withColumn("rewritten", F.lit(True)).union(groups.where(~several).select("day", "lot", "piece", "n_rows", "sources", F.col("names")[0], F.lit(False)))


def compact(rows: DataFrame, scratch: Scratch, folder: str, time_col: str, id_col: str) -> DataFrame:
    """Write ``rows`` to the new ``folder`` and compact it: (day, lot, piece, n_rows, sources, name, rewritten), one row a file."""
    manifest, total = write_files(rows, scratch, folder, time_col, id_col)
    return scratch.table(rewrite(packed(manifest, total), scratch, folder), "files")


def report(files: DataFrame, folder: str, id_col: str, value_col: str) -> DataFrame:
    """The files of ``compact`` with what they hold, read back as streams, a row group at a time."""

    def work(batches):
        for batch in batches:
            made: list[tuple] = []
            for name in batch.column("name").to_pylist():
                fs, root = store(folder)
                with fs.open_input_file(f"{root}/{name}") as f:
                    parquet = pq.ParquetFile(f)
                    least = largest = None
                    cents, digest, first = 0, hashlib.sha256(), True
                    for part in parquet.iter_batches(batch_size=GROUP_ROWS // 8, columns=[id_col, value_col]):
                        ids = part.column(id_col)
                        ends = pc.min_max(ids).as_py()
                        if ends["min"] is not None:
                            least = ends["min"] if least is None else min(least, ends["min"])
                            largest = ends["max"] if largest is None else max(largest, ends["max"])
                        values = part.column(value_col).drop_null().to_numpy(zero_copy_only=False)
                        cents += int(np.floor(100 * values[np.isfinite(values)] + 0.5).sum(dtype=object) or 0) if len(values) else 0
                        digest.update((b"" if first else b",") + ",".join(pc.fill_null(ids.cast(pa.string()), "").to_pylist()).encode())
                        first = False
                    made.append((parquet.metadata.num_rows, least, largest, cents, digest.hexdigest(), ",".join(parquet.schema_arrow.names), f"{folder}/{name}"))
            if made:
                kinds = [pa.int64()] * 4 + [pa.string()] * 3
                found = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)]
                own = [batch.column(c) for c in ("day", "lot", "piece", "sources", "rewritten")]
                yield pa.RecordBatch.from_arrays([*own, *found], names=["day", "lot", "piece", "sources", "rewritten", "n_rows", "min_click_id", "max_click_id", "cents", "ids_sha256", "columns", "path"])

    dealt = files.repartition(parallelism(files.sparkSession), "name")
    found = dealt.mapInArrow(work, "day long, lot long, piece long, sources string, rewritten boolean, n_rows long, min_click_id long, max_click_id long, cents long, ids_sha256 string, columns string, path string")
    return found.select("day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", "columns", "path", "rewritten")


def compacted_clicks(clicks: DataFrame, scratch: Scratch) -> DataFrame:
    """The report of the compaction of clicks by the day of their arrival; the folder stays, the tables on the way to it go."""
    folder = f"{scratch.root}-files"
    found = scratch.table(report(compact(clicks, scratch, folder, "arrived_at", "click_id"), folder, "click_id", "value"), "report")
    scratch.drop("days", "manifest", "groups", "merged", "left", "files")
    return found
