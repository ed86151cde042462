"""Connected components: few links take one batch, more take rounds, with the same classes."""

import uuid

from sheetwright.llm import common
from sheetwright.llm.common import Scratch, components


def classes(spark, links):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "components")
    try:
        rows = components(links, Scratch(spark, "components")).collect()
        return sorted((r.node, r.root) for r in rows), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_few_links_are_one_batch_and_more_give_the_same_classes(spark, monkeypatch):
    pairs = [(i, i + 7) for i in range(0, 700) if i % 97] + [(900, 900), (1500, 1200), (1500, 1300)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    root = {}
    for i in range(0, 707):
        root[i] = i if i < 7 or (i - 7) % 97 == 0 else root[i - 7]
    want = {(i, r) for i, r in root.items() if any(root[j] == r for j in (i - 7, i + 7) if j in root)} | {(x, 1200) for x in (1200, 1300, 1500)}
    few, jobs = classes(spark, links)
    assert few == sorted(want)
    assert jobs <= 10  # each round takes more
    monkeypatch.setattr(common, "CONTRACTED", 0)  # only on the driver: rounds follow the batches' stars
    found, more = classes(spark, links)
    assert found == few and more > jobs
    assert classes(spark, links.limit(0))[0] == []
