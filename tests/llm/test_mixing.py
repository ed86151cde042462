"""Mixing: the classifier on separable texts, and rates against a plain projected-gradient fit."""

import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sheetwright.llm import mixing, queries
from sheetwright.llm.common import Scratch
from sheetwright.llm.mixing import fit_rates, mix, rate


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], size=400)
    tokens = rng.integers(1, 500, size=400)
    rows = [(*map(float, x), int(t)) for x, t in zip(p, tokens, strict=True)]
    cells = spark.createDataFrame(rows, "p0 double, p1 double, p2 double, tokens long")
    names, targets = ["p0", "p1", "p2"], [0.7, 0.25, 0.05]
    steps = fit_rates(cells, names, targets)
    found = cells.withColumn("r", rate(steps, names)).collect()
    r = np.array([x.r for x in found])
    q, t = np.array([[x.p0, x.p1, x.p2] for x in found]), np.array([x.tokens for x in found])
    assert (r >= 0).all()
    plain = np.ones(len(r))
    for _ in range(20_000):  # a brute-force fit in the same metric, with the plain gradient
        plain = np.maximum(0, plain - q @ (q.T @ (t * plain) / t.sum() - targets))
    assert q.T @ (t * r) / t.sum() == pytest.approx(targets, abs=2e-3)
    assert q.T @ (t * plain) / t.sum() == pytest.approx(q.T @ (t * r) / t.sum(), abs=3e-3)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_targets_out_of_reach_are_met_as_closely_as_least_squares_can(spark, seed):
    rng = np.random.default_rng(seed)
    p = np.round(np.concatenate([rng.dirichlet([6, 0.2, 1.5], size=11), [[0.87, 0, 0.13], [0.02, 0, 0.98], [0.3, 0.5, 0.2]]]) * 256) / 256
    p[:, 2] = np.maximum(p[:, 2], 0.12 * p[:, 0])  # clean never comes without toxic
    tokens = np.array([*rng.integers(1, 400, size=11), 50_000, 4000, 3])
    cells = spark.createDataFrame([(*map(float, x), int(t)) for x, t in zip(p, tokens, strict=True)], "p0 double, p1 double, p2 double, tokens long")
    names, targets = ["p0", "p1", "p2"], np.array([0.94, 0.04, 0.02])
    least = float(targets @ targets)
    for k in (1, 2, 3):  # the least squares are those of some three posteriors at most
        for rows in itertools.combinations(range(len(p)), k):
            weights = np.linalg.lstsq(p[list(rows)].T, targets, rcond=None)[0]
            if (weights >= 0).all():
                least = min(least, float(((p[list(rows)].T @ weights - targets) ** 2).sum()))
    assert least > 1e-4
    r = np.array([(x.r, x.tokens, x.p0, x.p1, x.p2) for x in cells.withColumn("r", rate(fit_rates(cells, names, targets.tolist()), names)).collect()])
    found = r[:, 2:].T @ (r[:, 0] * r[:, 1]) / r[:, 1].sum()
    assert (r[:, 0] >= 0).all() and ((found - targets) ** 2).sum() == pytest.approx(least, abs=1e-5)


def frame(spark, n=120):
    rng = random.Random(1)
    words = {"good": "tree river stone", "bad": "spam win cash"}
    rows = [(i, " ".join(rng.choice((words[k] + " the of and").split()) for _ in range(40)), k) for i, k in ((i, "good" if i % 3 else "bad") for i in range(n))]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t, _ in rows], "doc_id long, text string, rate string, n_tokens int")
    return docs, spark.createDataFrame([(i, k) for i, _, k in rows if i % 2], "doc_id long, domain string"), {i: k for i, _, k in rows}


def test_mix(spark):
    docs, labels, truth = frame(spark)
    odd = spark.createDataFrame([(900, None, "", 0), (901, "", "", 0), (902, "tree " * 50_000, "", 0), (None, "win", "", 0), (0, "spam cash", "", 0), (0, "spam cash", "", 0)], docs.schema)
    labels = labels.union(spark.createDataFrame([(5555, "good"), (1, "zzz"), (None, "good"), (7, None)], labels.schema))
    rows = mix(docs, labels, {"good": 0.9, "bad": 0.1}, Scratch(spark, "t")).collect()
    assert sum((r.p_good > 0.5) == (truth[r.doc_id] == "good") for r in rows) == 120
    share = lambda k: sum(getattr(r, f"p_{k}") * r.n_tokens * r.rate for r in rows) / sum(r.n_tokens for r in rows)
    assert share("good") == pytest.approx(0.9, abs=0.01) and share("bad") == pytest.approx(0.1, abs=0.01)
    rows = mix(docs.union(odd), labels, {"good": 0.9, "bad": 0.1}, Scratch(spark, "t")).collect()
    assert len(rows) == 126 and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows if r.doc_id in (900, 901, 902)} == {900: 0, 901: 0, 902: 50_000}


def test_mix_without_labels_or_rows(spark):
    docs, labels, _ = frame(spark, 9)
    assert {r.rate for r in mix(docs, labels.limit(0), {"good": 1.0}, Scratch(spark, "t")).collect()} == {1.0}
    assert mix(docs.limit(0), labels, {"good": 1.0}, Scratch(spark, "t")).count() == 0
    one = mix(docs, labels.withColumn("domain", F.lit("only")), {"only": 2.0}, Scratch(spark, "t")).collect()
    assert {round(r.rate, 3) for r in one} == {1.0}


def test_targets_on_the_tables(spark):
    """Totals against brute-force nonnegative least squares over the posteriors that the query reports."""
    rows = queries.op2_mixing(spark, "/root/testdata/sf0.001").toPandas()
    names = [f"p_{d}" for d in sorted(queries.TARGETS)]
    p, t, goal = rows[names].to_numpy(), (rows.n_tokens / rows.n_tokens.sum()).to_numpy(), np.array([queries.TARGETS[d] for d in sorted(queries.TARGETS)])
    assert np.allclose(p.sum(axis=1), 1)
    best, plain = p.T @ t, np.ones(len(p))
    for _ in range(100_000):
        plain = np.maximum(0, plain - p @ (p.T @ (t * plain) - goal))
        best = p.T @ (t * plain)
    found = p.T @ (t * rows.rate.to_numpy())
    assert np.linalg.norm(found - goal) <= 1.01 * np.linalg.norm(best - goal) + 2e-3


def test_posteriors_are_calibrated(spark):
    """Expected tokens of the labelled documents by domain against their labels."""
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_mixing(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    toxic, junk = rows.toxic == 1, (rows.toxic == 0) & (rows.quality == 0)
    t = rows.n_tokens / rows.n_tokens.sum()
    assert (rows.p_toxic * t).sum() == pytest.approx(t[toxic].sum(), abs=0.05) and (rows.p_junk * t).sum() == pytest.approx(t[junk].sum(), abs=0.05)
    assert (rows[~toxic & ~junk].p_clean > 0.5).mean() > 0.95


def slow_posteriors(docs, labels, domains):
    """The classifier on one machine; only the regression itself is shared."""
    hashed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), seed=42))
    buckets = {i: {hashed(w) % mixing.BUCKETS for w in re.findall(r"[^\W\d_]+|(?:[^\w\s]|[\d_])+", (t or "").lower())} for i, t in docs}
    sample = {(labels[i], t): (i, (42 if t is None else hashed(t)) % mixing.FOLDS) for i, t in docs if i in labels}
    k, folds = len(domains), range(mixing.FOLDS)

    def weights(use):
        seen = [(domains.index(d), buckets[i]) for (d, _), (i, f) in sample.items() if f in use]
        chance = [sum(d == j for d, _ in seen) / len(seen) for j in range(k)]
        counts = {}
        for d, words in seen:
            for w in words:
                counts.setdefault(w, [0] * k)[d] += 1
        made = {}
        for w, c in counts.items():
            row = [math.log((c[j] + mixing.SHRINK * chance[j]) / ((sum(c) + mixing.SHRINK) * chance[j])) if 0 < chance[j] < 1 else 0.0 for j in range(k)]
            made[w] = [x if abs(x) >= mixing.LEAST_WEIGHT else 0.0 for x in row]
        return made

    def evidence(words, made):
        rows = [made[w] for w in words if w in made]
        sums = [sum(r[j] for r in rows) for j in range(k)]
        return [1.0, float(any(any(r) for r in rows)), *(math.copysign(math.log1p(abs(s)), s) for s in sums), *(max([0.0, *(r[j] for r in rows)]) for j in range(k))]

    left_out = [weights([g for g in folds if g != f]) for f in folds]
    x = np.array([evidence(buckets[i], left_out[f]) for (d, _), (i, f) in sample.items()])
    coefs = mixing.logistic(x, np.array([domains.index(d) for d, _ in sample]), k)
    whole, out = weights(list(folds)), {}
    for i, words in buckets.items():
        z = np.array(evidence(words, whole)) @ coefs
        out[i] = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return out


def test_posteriors_against_a_slow_version(spark):
    rng = random.Random(9)
    words = {"good": "tree river stone ### bird7", "bad": "spam win cash !!! 24", "odd": "été ñu the of x_y"}
    rows = []
    for i in range(240):
        kind = rng.choice(sorted(words))
        rows.append((i, " ".join(rng.choice((words[kind] if rng.random() < 0.4 else "the of and a in to it is").split()) for _ in range(rng.randint(3, 40))), kind))
    rows += [(900, rows[0][1], rows[0][2]), (901, "", "good"), (902, None, "odd")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows if i % 3], "doc_id long, domain string")
    found = mix(docs, labels, {"good": 0.6, "bad": 0.2, "odd": 0.2}, Scratch(spark, "t")).collect()
    want = slow_posteriors([(i, t) for i, t, _ in rows], {i: k for i, _, k in rows if i % 3}, sorted(words))
    assert all((r.p_bad, r.p_good, r.p_odd) == pytest.approx(tuple(want[r.doc_id]), abs=1e-6) for r in found)
