"""Compaction: files, groups and bytes against a plain version that follows the contract row by row."""

import datetime
import glob
import hashlib
import math
import os
import random
import uuid
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from sheetwright.llm.common import Scratch
from sheetwright.llm.compaction import compact, compacted_clicks, first_fit, packed, rewrite, write_files

CLICKS = "/root/testdata/sf0.01/clicks.parquet"
EPOCH = datetime.datetime(1970, 1, 1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def plain(rows):
    """From (click_id, arrived_at, value): the rows of the report without path and columns, by key; and the ids of each file."""
    total = len(rows)
    share = lambda x: 1 + total // x
    days, starts = defaultdict(int), defaultdict(list)
    day_of = lambda r: None if r[1] is None else (r[1] - EPOCH).days
    for r in rows:
        days[day_of(r)] += 1
    for r in rows:
        d = day_of(r)
        h = 0 if r[0] is None else zlib.crc32(str(r[0]).encode())
        starts[d, (h // 16) % (1 + days[d] // share(200)), min(h % 4, h // 4 % 4)].append(r)
    low = lambda x: (x is not None, x if x is not None else 0)
    for own in starts.values():
        own.sort(key=lambda r: (low(r[1]) if r[1] is not None else (False, EPOCH), low(r[0])))
    groups = []
    for d in days:
        keys = sorted((k for k in starts if k[0] == d and len(starts[k]) < share(750)), key=lambda k: (-len(starts[k]), k[1:]))
        own = []
        for k in keys:
            for g in own:
                if sum(len(starts[x]) for x in g) + len(starts[k]) <= share(300):
                    g.append(k)
                    break
            else:
                own.append([k])
        groups += own + [[k] for k in starts if k[0] == d and len(starts[k]) >= share(750)]
    out, ids_of = {}, {}
    for g in groups:
        held = [r for k in g for r in starts[k]]
        known = [r[0] for r in held if r[0] is not None]
        cents = sum(math.floor(100 * r[2] + 0.5) for r in held if r[2] is not None and math.isfinite(r[2]))
        digest = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in held).encode()).hexdigest()
        out[g[0]] = (len(held), min(known, default=None), max(known, default=None), cents, ",".join(f"{k[1]}-{k[2]}" for k in g), digest, len(g) > 1)
        ids_of[g[0]] = [r[0] for r in held]
    return out, ids_of


def checked(found, rows):
    """Compare a report with the plain version, its files with the report, and the folder with its files."""
    want, ids = plain(rows)
    got = {(r.day, r.lot, r.piece): r for r in found}
    assert len(got) == len(found)
    assert {k: (r.n_rows, r.min_click_id, r.max_click_id, r.cents, r.sources, r.ids_sha256, r.rewritten) for k, r in got.items()} == want
    paths = {r.path.replace("file://", "") for r in found}
    for k, r in got.items():
        file = pq.ParquetFile(r.path.replace("file://", ""))
        assert ",".join(file.schema_arrow.names) == r.columns
        assert file.read().column("click_id").to_pylist() == ids[k]
    folders = {os.path.dirname(p) for p in paths}
    assert len(folders) <= 1
    for folder in folders:
        assert set(glob.glob(f"{folder}/**", recursive=True, include_hidden=True)) - {f"{folder}/"} == paths
        assert not os.listdir(f"{folder}-parts")


def test_the_whole_table(spark):
    clicks = spark.read.parquet(CLICKS)
    found = compacted_clicks(clicks, Scratch(spark, "test")).collect()
    checked(found, [tuple(r) for r in clicks.select("click_id", "arrived_at", "value").collect()])
    assert {r.columns for r in found} == {",".join(clicks.columns)}
    # what the folder holds is the table
    again = spark.read.parquet(os.path.dirname(found[0].path)).select(*clicks.columns)
    assert again.schema == clicks.schema
    assert again.exceptAll(clicks).count() == 0 == clicks.exceptAll(again).count()


def test_untouched_files_keep_their_bytes_and_a_second_run_its_files(spark):
    clicks = spark.read.parquet(CLICKS).where("arrived_at < '2024-01-20'")
    scratch = Scratch(spark, "test")
    folder = f"{scratch.root}-files"
    manifest, total = write_files(clicks, scratch, folder, "arrived_at", "click_id")
    read = lambda: {os.path.basename(p): open(p, "rb").read() for p in glob.glob(folder.replace("file://", "") + "/*")}  # noqa: E731, SIM115
    before = read()
    assert len(before) == manifest.count()
    files = scratch.table(rewrite(packed(manifest, total), scratch, folder), "files")
    after, rows = read(), files.collect()
    assert {r.name for r in rows} == set(after)
    for r in rows:
        assert (r.name in before) != r.rewritten
        assert r.rewritten or before[r.name] == after[r.name]
    other = compact(clicks, Scratch(spark, "again"), f"{scratch.root}-other", "arrived_at", "click_id")
    columns = ["day", "lot", "piece", "n_rows", "sources", "name", "rewritten"]
    assert sorted(map(str, other.select(*columns).collect())) == sorted(map(str, files.select(*columns).collect()))


@pytest.mark.parametrize("seed", range(20))
def test_linked_groups_equal_a_plain_first_fit(seed):
    draw = random.Random(seed)
    most = draw.randint(5, 60)
    sizes = sorted((draw.randint(1, most) for _ in range(draw.randint(1, 120))), reverse=True)
    want: list[list] = []
    for k, n in enumerate(sizes):
        for g in want:
            if sum(sizes[i] for i in g) + n <= most:
                g.append(k)
                break
        else:
            want.append([k])
    assert first_fit(zip(sizes, range(len(sizes)), strict=True), most, sizes[-1]) == want


def rows_of(n, seed, days, hot=0.0):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        day = 19723 if draw.random() < hot else 19723 + draw.randrange(days)
        at = EPOCH + datetime.timedelta(days=day, seconds=draw.randrange(86400) // 600 * 600)
        out.append((draw.randrange(n), at, at, i % 7, "view", draw.choice([None, 1.005, 2.5, -3.335, float("nan"), float("inf"), 0.0]), "{}"))
    return out


def test_a_day_that_holds_most_rows_nulls_and_old_days(spark):
    """A hot day has many lots; null times and ids, days before 1970, and times that tie."""
    rows = rows_of(3000, 1, 30, hot=0.6)
    rows += [(None, None, None, None, None, None, None)] * 3 + [(k, None, None, 1, "x", 1.0, None) for k in range(40)]
    rows += [(None, r[1], r[2], *r[3:]) for r in rows[:20]] + [(k, None, EPOCH - datetime.timedelta(hours=5 * k), 1, "x", 1.0, None) for k in range(30)]
    found = compacted_clicks(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "test")).collect()
    checked(found, [(r[0], r[2], r[5]) for r in rows])
    assert max(r.lot for r in found) > 50


def test_clashing_columns_one_row_and_no_row(spark):
    rows = rows_of(50, 2, 3)
    wide = [(*r, 5, 6, "p", "n", 1) for r in rows]
    schema = f"{SCHEMA}, day int, lot int, `piece` string, name string, `a.b` int"
    found = compacted_clicks(spark.createDataFrame(wide, schema), Scratch(spark, "test")).collect()
    checked(found, [(r[0], r[2], r[5]) for r in rows])
    assert found[0].columns.endswith("props,day,lot,piece,name,a.b")
    checked(compacted_clicks(spark.createDataFrame(rows[:1], SCHEMA), Scratch(spark, "test")).collect(), [(r[0], r[2], r[5]) for r in rows[:1]])
    assert compacted_clicks(spark.createDataFrame([], SCHEMA), Scratch(spark, "test")).collect() == []


def test_each_call_has_a_folder_of_its_own(spark):
    clicks = spark.createDataFrame(rows_of(20, 3, 2), SCHEMA)
    a, b = (compacted_clicks(clicks, Scratch(spark, f"t{uuid.uuid4().hex[:4]}")).collect() for _ in range(2))
    assert not {r.path for r in a} & {r.path for r in b}
    assert all(os.path.exists(r.path.replace("file://", "")) for r in a + b)
