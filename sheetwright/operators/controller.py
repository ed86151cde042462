"""A running controller of a share, as a parallel scan: what a loop over all rows would decide, without one task that sees them all.

The controller counts how many of the rows so far use a derived measure.  A row must use one where that count's share of the rows up
to and with this one is below the target; otherwise it uses one if its own draw says so.  So a row maps a count to the next one, and a
block of rows maps the count before it to the count after it.  Such maps rise by 0 or 1 from a count to the next, so they are a few
straight pieces: far below the target every row adds one, far above it only draws do, and between the paths run together.

Maps of blocks compose into maps of groups of blocks, in as many rounds as the number of rows has digits; then the counts go down again from
group to block to row.  A task holds one group of at most ``WIDE`` rows or maps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and maps of a group.
WIDE = 1024
MAPS = "block long, xs array<long>, ys array<long>, rises array<long>"


def apply_map(piece: tuple[np.ndarray, np.ndarray, np.ndarray], counts: np.ndarray) -> np.ndarray:
    """The counts after a map; below its first place it rises by one."""
    xs, ys, rises = piece
    k = np.searchsorted(xs, counts, side="right") - 1
    inner = np.maximum(k, 0)
    return np.where(k < 0, ys[0] - (xs[0] - counts), ys[inner] + rises[inner] * (counts - xs[inner]))


def _pieces(xs: np.ndarray, ys: np.ndarray, rises: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces without those that go on as the one before."""
    keep = np.append(True, rises[1:] != rises[:-1])
    return xs[keep], ys[keep], rises[keep]


def map_of_rows(first: int, own: np.ndarray, target: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The map of rows numbered from ``first``; ``own`` says which use a derived measure unasked."""
    n = len(own)
    xs = np.arange(max(-1, int(target * (first + 1)) - n - 2), int(target * (first + n)) + 4, dtype=np.int64)
    ys = xs.copy()
    for i, b in enumerate(own.tolist()):
        ys += np.where(ys / (first + i + 1) < target, 1, int(b))
    return _pieces(xs, ys, np.append(np.diff(ys), 1))


def then(one: tuple, two: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The map of ``one`` and after it ``two``."""
    xs, ys, rises = one
    ends = np.append(xs[1:], np.iinfo(np.int64).max // 4)
    # where a rising piece of the first reaches a place of the second
    at = xs[:, None] + (two[0][None, :] - ys[:, None])
    within = (rises[:, None] == 1) & (at >= xs[:, None]) & (at < ends[:, None])
    below = xs[0] - (ys[0] - two[0])
    places = np.unique(np.concatenate([xs, at[within], below[below < xs[0]]]))
    values = apply_map(two, apply_map(one, places))
    return _pieces(places, values, apply_map(two, apply_map(one, places + 1)) - values)


def _maps(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    order = np.argsort(table.column("block").to_numpy())
    columns = [table.column(c).to_pylist() for c in ("xs", "ys", "rises")]
    return [tuple(np.array(c[i], dtype=np.int64) for c in columns) for i in order]


def _map_table(block: int, found: tuple) -> pa.Table:
    kind = pa.list_(pa.int64())
    return pa.table([pa.array([block], pa.int64()), *(pa.array([x.tolist()], kind) for x in found)], names=["block", "xs", "ys", "rises"])


def controlled(rows: DataFrame, place: str, own: str, count: int, low: float, high: float) -> DataFrame:
    """``rows`` with ``needed`` (a derived measure is asked for) and ``derived`` (the row uses one).

    ``place`` numbers the ``count`` rows from 0; ``own`` says whether a row uses a derived measure unasked, NULL as no.  The target is
    halfway between ``low`` and ``high``.
    """
    if not 0 <= low <= high <= 1:
        raise ValueError("bad shares")
    target, wide = (low + high) / 2, WIDE
    block = F.floor(F.col(place) / wide).cast("long")
    bits = rows.select(block.alias("block"), F.col(place).cast("long").alias("place"), F.coalesce(F.col(own), F.lit(False)).alias("own"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        return _map_table(table.column("block")[0].as_py(), map_of_rows(table.column("place")[0].as_py(), table.column("own").to_numpy(zero_copy_only=False), target))

    def compose(table: pa.Table) -> pa.Table:
        found = _maps(table)
        out = found[0]
        for x in found[1:]:
            out = then(out, x)
        return _map_table(table.column("block")[0].as_py() // wide, out)

    def spread(maps: pa.Table, starts: pa.Table) -> pa.Table:
        """The count before each map of a group, from the count before the group."""
        blocks = np.sort(maps.column("block").to_numpy())
        count, out = starts.column("start")[0].as_py(), []
        for x in _maps(maps):
            out.append(count)
            count = int(apply_map(x, np.array([count]))[0])
        return pa.table([pa.array(blocks), pa.array(out, pa.int64())], names=["block", "start"])

    levels, groups = [bits.groupBy("block").applyInArrow(build, MAPS)], -(-count // wide)
    while groups > 1:
        levels.append(levels[-1].groupBy(F.floor(F.col("block") / wide).alias("group")).applyInArrow(compose, MAPS))
        groups = -(-groups // wide)
    starts = rows.sparkSession.createDataFrame([(0, 0)], "block long, start long")
    for maps in levels[-2::-1]:
        starts = maps.groupBy(F.floor(F.col("block") / wide).cast("long")).cogroup(starts.groupBy("block")).applyInArrow(spread, "block long, start long")

    def run(table: pa.Table, start: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        count, first, needed, derived = start.column("start")[0].as_py(), table.column("place")[0].as_py(), [], []
        for i, b in enumerate(table.column("own").to_pylist()):
            needed.append(count / (first + i + 1) < target)
            derived.append(needed[-1] or b)
            count += derived[-1]
        return pa.table([table.column("place"), pa.array(needed), pa.array(derived)], names=["place", "needed", "derived"])

    flags = bits.groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(run, "place long, needed boolean, derived boolean")
    return rows.join(flags.withColumnRenamed("place", "__place__"), F.col(place) == F.col("__place__")).drop("__place__")
