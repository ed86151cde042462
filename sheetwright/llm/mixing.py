"""Mixing to target weights by soft membership, by DataFrame functions only.

A classifier learned from a table of labelled documents predicts each document's posterior over domains.  The expected
tokens of a domain are then the sum over documents of posterior times tokens times rate, and projected-gradient least
squares finds nonnegative rates for which these totals match the targets.

Classifier: words are runs of letters, and runs of other signs, in lower case, hashed to ``BUCKETS`` numbers; each counts once
a text.  A word's weight for a domain is the logarithm of how often the domain's texts hold it against how often they
would by chance, both raised by ``SHRINK`` texts so that rare words weigh little; words count only where that ratio is at
least e**LEAST_WEIGHT either way.  A text's evidence for a domain is the sum of its weights, which naive Bayes would take
at its face, and the largest of them.  Multinomial logistic regression turns this evidence into posteriors; it is fitted on
the sample with each text's evidence by the weights of other texts, so posteriors are calibrated: a domain's expected
total is about its true one.  The sample is about ``LABELLED`` labelled documents chosen by hash, copies of one text counted
once: a documented bound, which also bounds what the driver fits (a few numbers a document).  The sample's ids and the
tables of weights (at most BUCKETS rows) are broadcast.

Fit: the gradient of a rate is the document's posterior times the residual of the domain totals, measured in tokens, so
a rate depends on the posterior alone.  Targets that no nonnegative rates meet are approached as closely as least squares
allow, which can leave most rates zero and a few very high.  For the fit, documents are summed by grid cell of their posterior
(at most ``CELLS ** (domains - 1)`` rows, whatever the corpus), each cell with its tokens' mean posterior, and each look at a
step is one aggregate over the cells.  A document's rate is the same steps applied to its own, unrounded posterior.

Defined results: a null or empty text has no tokens, the prior of texts without telling words as posterior, and a rate;
rows are judged each, repeated or not; labels of unknown ids, null labels and repeated labels of one id are harmless
(the smallest domain name counts); with no labels every rate is 1; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .quality import words_of

LABELLED, BUCKETS, SHRINK, LEAST_WEIGHT = 20_000, 1 << 18, 5.0, 1.2
#: A word, in lower case: letters, or other signs.  The parts of the sample, each calibrated on weights of the others.
WORD, FOLDS = r"\p{L}+|[^\p{L}\s]+", 3
MOST_DOMAINS, CELLS = 12, 256
#: Most steps of the fit and of Newton's method within one, the residuals and slopes taken for zero, the gap, and the longest step.
STEPS, NEWTON, PRECISION, FLAT, GAP, LONGEST = 40, 60, 1e-5, 1e-9, 1e-6, 1e8


def hashed_words(text: Column) -> Column:
    """The distinct hashed words of a text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def evidence(told: str, k: int) -> list[Column]:
    """The numbers that the calibration weighs: one, whether a word told anything, and two for each of k domains."""
    damped = [F.signum(f"s{i}") * F.log1p(F.abs(f"s{i}")) for i in range(k)]
    return [F.lit(1.0), (F.col(told) > 0).cast("double"), *damped, *(F.col(f"m{i}") for i in range(k))]


def logistic(x: np.ndarray, y: np.ndarray, k: int, ridge: float = 1.0) -> np.ndarray:
    """Coefficients (numbers by classes) of multinomial logistic regression with a ridge, by Newton's method."""
    d, coefs, truth = x.shape[1], np.zeros((x.shape[1], k)), np.eye(k)[y]

    def posterior(w):
        z = x @ w
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    loss = lambda w, p: -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum() + ridge * (w * w).sum() / 2
    p = posterior(coefs)
    for _ in range(NEWTON):
        slope = x.T @ (p - truth) + ridge * coefs
        curve = np.einsum("nab,ni,nj->aibj", p[:, :, None] * (np.eye(k) - p[:, None, :]), x, x, optimize=True).reshape(k * d, k * d)
        move = -np.linalg.solve(curve + ridge * np.eye(k * d), slope.T.ravel()).reshape(k, d).T
        share = 1.0
        while (new := loss(coefs + share * move, posterior(coefs + share * move))) > loss(coefs, p) and share > 1e-6:
            share /= 2
        if loss(coefs, p) - new < 1e-9:
            break
        coefs = coefs + share * move
        p = posterior(coefs)
    return coefs


class Classifier:
    """Weights of telling hashed words by domain, a table of at most BUCKETS rows, and the coefficients that calibrate them."""

    def __init__(self, docs: DataFrame, labelled: DataFrame, scratch: Scratch, id_col: str, text_col: str, domain_col: str, most: int = LABELLED):
        known = labelled.where(F.col(id_col).isNotNull() & F.col(domain_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(domain_col).alias("domain"))
        known = scratch.table(known, "known")
        names = [r["domain"] for r in known.select("domain").distinct().limit(MOST_DOMAINS + 1).collect()]
        if len(names) > MOST_DOMAINS:
            raise ValueError(f"more than {MOST_DOMAINS} domains")
        share = min(1.0, most / max(1, known.count()))
        picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
        sample = texts.select("domain", F.xxhash64("text").alias("h"), hashed_words(F.col("text")).alias("buckets")).dropDuplicates(["domain", "h"])
        sample = scratch.table(sample, "sample")
        self.domains = sorted(r["domain"] for r in sample.select("domain").distinct().collect())
        if not self.domains:
            return
        sample = sample.withColumn("fold", F.pmod("h", F.lit(FOLDS)).cast("int"))
        k, folds = range(len(self.domains)), range(FOLDS)
        sizes = {(r["fold"], self.domains.index(r["domain"])): float(r["n"]) for r in sample.groupBy("fold", "domain").agg(F.count(F.lit(1)).alias("n")).collect()}
        times = [F.count_if((F.col("fold") == f) & (F.col("domain") == d)).cast("double").alias(f"c{f}_{i}") for f in folds for i, d in enumerate(self.domains)]
        counts = sample.select("domain", "fold", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(*times)
        # the weights by all folds, and those by all folds but one
        parts = [(f"w{i}", self._weight(i, list(folds), sizes)) for i in k] + [(f"v{f}_{i}", self._weight(i, [g for g in folds if g != f], sizes)) for f in folds for i in k]
        made = scratch.table(counts.select("bucket", *(v.alias(name) for name, v in parts)), "all_weights")
        some = lambda names: made.where(" or ".join(f"{w} <> 0" for w in names))
        self.weights = scratch.table(some([f"w{i}" for i in k]).select("bucket", *(f"w{i}" for i in k)), "weights")
        rows = sample.withColumn("uid", F.monotonically_increasing_id()).select("uid", "domain", "fold", F.explode_outer("buckets").alias("bucket"))
        left_out = rows.join(F.broadcast(some([f"v{f}_{i}" for f in folds for i in k])), "bucket", "left")
        for i in k:
            left_out = left_out.withColumn(f"w{i}", F.coalesce(*(F.when(F.col("fold") == f, F.col(f"v{f}_{i}")) for f in folds)))
        fold = self._told(left_out, ["uid", "domain"])
        rows = fold.select("domain", F.array(*evidence("told", len(self.domains))).alias("x")).collect()  # bounded by LABELLED
        scratch.drop("sample", "all_weights")
        self.coefs = logistic(np.array([r[1] for r in rows]), np.array([self.domains.index(r[0]) for r in rows]), len(self.domains))

    def _weight(self, i: int, folds: list[int], sizes: dict[tuple[int, int], float]) -> Column:
        """A word's weight for domain i by the texts of some folds, from its counts ``c<fold>_<domain>``; 0 where it tells too little."""
        own = sum((F.col(f"c{f}_{i}") for f in folds), F.lit(0.0))
        every = sum((F.col(f"c{f}_{j}") for f in folds for j in range(len(self.domains))), F.lit(0.0))
        whole = sum(n for (f, _), n in sizes.items() if f in folds)
        chance = sum(n for (f, j), n in sizes.items() if f in folds and j == i) / (whole or 1.0)
        if not 0 < chance < 1:
            return F.lit(0.0)
        weight = F.log((own + SHRINK * chance) / ((every + SHRINK) * chance))
        return F.when(F.abs(weight) >= LEAST_WEIGHT, weight).otherwise(0.0)

    def _told(self, spread: DataFrame, keys: list[str]) -> DataFrame:
        """The keys with how many words told anything, and each domain's sum and maximum of weights ``w<domain>``."""
        k = range(len(self.domains))
        sums = [F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in k] + [F.coalesce(F.greatest(F.max(f"w{i}"), F.lit(0.0)), F.lit(0.0)).alias(f"m{i}") for i in k]
        told = F.coalesce(F.greatest(*(F.abs(f"w{i}") for i in k), F.lit(0.0)), F.lit(0.0)) > 0
        return spread.groupBy(*keys).agg(F.count_if(told).alias("told"), *sums)

    def posteriors(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, n_tokens, p0, p1, ...): posteriors in the order of the domains."""
        rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        words = rows.select("uid", "id", F.size(words_of(F.coalesce("text", F.lit("")))).cast("long").alias("n_tokens"), hashed_words(F.col("text")).alias("buckets"))
        if not self.domains:
            return words.select("id", "n_tokens")
        k = range(len(self.domains))
        spread = words.select("uid", "id", "n_tokens", F.explode_outer("buckets").alias("bucket")).join(F.broadcast(self.weights), "bucket", "left")
        told = self._told(spread, ["uid", "id", "n_tokens"])
        x = evidence("told", len(self.domains))
        scores = [sum((v * float(self.coefs[j, i]) for j, v in enumerate(x)), F.lit(0.0)).alias(f"z{i}") for i in k]
        told = told.select("id", "n_tokens", *scores)
        best = F.greatest(*(f"z{i}" for i in k)) if len(self.domains) > 1 else F.col("z0")
        parts = [F.exp(F.col(f"z{i}") - best) for i in k]
        return told.select("id", "n_tokens", *((p / sum(parts, F.lit(0.0))).alias(f"p{i}") for i, p in enumerate(parts)))


def rate(steps: list[list[float]], names: list[str]) -> Column:
    """The rate of a posterior after the fitted steps, from 1; each step goes down and back to nonnegative rates."""
    if not steps:
        return F.lit(1.0)
    posterior = F.array(*names)
    listed = F.split(F.lit(",".join(repr(c) for step in steps for c in step)), ",").cast("array<double>")
    each = lambda r, k: F.greatest(F.lit(0.0), r - sum((F.get(posterior, F.lit(i)) * F.get(listed, k * len(names) + i) for i in range(len(names))), F.lit(0.0)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), F.lit(1.0), each)


def fit_rates(cells: DataFrame, names: list[str], targets: list[float], most: int = STEPS) -> list[list[float]]:
    """Steps of projected gradient descent on the squared residual of the domain totals (as shares of all tokens).

    Each step takes its gradient where it ends, so that the squared residual never rises, however long the step is, and
    the last rates are the best.  A step's end is found by Newton's method with a line search on a convex function of one
    number a domain: its slope is the targets plus the step over its length, less the totals at its end.  Lengths grow
    tenfold up to ``LONGEST``.  The fit ends when the targets are met or, where they cannot be, when the squared residual
    is proven to be within GAP of its least: it exceeds that by no more than the residual times the totals, plus what a
    posterior with a negative product with the residual could still gain.  Without that proof in ``most`` steps it warns.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return []
    t, goal, one = F.col("tokens") / total, np.array(targets), F.col("__rate__")
    moments = {(p, q): F.sum(F.when(one > 0, F.col(p) * F.col(q) * t).otherwise(0.0)) for p in names for q in names}
    sums = [F.sum(t * one * one).alias("energy"), *(F.sum(F.col(p) * t * one).alias(p) for p in names), *(v.alias(f"{p}_{q}") for (p, q), v in moments.items())]
    steps: list[list[float]] = []
    length = 1.0

    def at(step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float]:
        """A step's value, slope and curvature, the totals at its end, and the least product with a cell's posterior."""
        listed = F.split(F.lit(",".join(map(repr, step.tolist()))), ",").cast("array<double>")
        along = sum((F.col(p) * F.get(listed, F.lit(i)) for i, p in enumerate(names)), F.lit(0.0))
        now = cells.where("tokens > 0").withColumn("__rate__", rate([*steps, step.tolist()], names)).agg(*sums, F.min(along).alias("least")).first()
        totals = np.array([now[p] for p in names])
        curve = np.array([[now[f"{p}_{q}"] for q in names] for p in names]) + np.eye(len(names)) / length
        return now["energy"] / 2 + step @ goal + step @ step / length / 2, goal + step / length - totals, curve, totals, now["least"]

    for _ in range(most):
        length = min(LONGEST, length * 10)
        step = np.zeros(len(names))
        value, slope, curve, totals, least = at(step)
        for _ in range(NEWTON):
            if np.abs(totals - goal).max() < PRECISION and not step.any() or np.abs(slope).max() < FLAT:
                break
            move, share = -np.linalg.solve(curve, slope), 1.0
            while True:
                new = at(step + share * move)
                if new[0] <= value + 1e-4 * share * (slope @ move) + 1e-12 * abs(value) or share < 1e-6:
                    break
                share /= 2
            step, (value, slope, curve, totals, least) = step + share * move, new
        residual = totals - goal
        if step.any():
            steps.append(step.tolist())
        gap = abs(residual @ totals) + max(0.0, -least / length) * math.sqrt(len(names)) * float(np.linalg.norm(goal))
        if np.abs(residual).max() < PRECISION or gap < GAP:
            return steps
    warnings.warn(f"rates not proven least within {most} steps: squared residual {residual @ residual:.3g}, gap up to {2 * gap:.3g}", stacklevel=2)
    return steps


def grid_cells(table: DataFrame, names: list[str]) -> DataFrame:
    """(p0, p1, ..., tokens): the documents' tokens by grid cell of the posterior, with the tokens' mean posterior."""
    n = F.col("n_tokens")
    means = [(F.sum(F.col(p) * n) / F.sum(n)).alias(p) for p in names]
    return table.where("n_tokens > 0").groupBy(*(F.round(F.col(p) * CELLS).alias(f"g{i}") for i, p in enumerate(names))).agg(*means, F.sum(n).alias("tokens")).select(*names, "tokens")


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", seed: int = 7
) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, a posterior ``p_<domain>`` a domain, rate and copies.

    ``targets`` are the domains' shares of all tokens; a domain without a target keeps none.  ``copies`` is the rate
    rounded down or up at random by a hash of the id, so that its mean is the rate.
    """
    model = Classifier(docs, labelled, scratch, id_col, text_col, domain_col)
    names = [f"p{i}" for i in range(len(model.domains))]
    table = scratch.table(model.posteriors(docs, id_col, text_col), "posteriors")
    steps: list[list[float]] = []
    if names:
        cells = scratch.table(grid_cells(table, names), "cells")
        whole = sum(targets.values())
        steps = fit_rates(cells, names, [targets.get(d, 0.0) / whole for d in model.domains])
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    out = table.withColumn("rate", rate(steps, names)).withColumn("copies", F.floor(F.col("rate") + draw))
    return out.select(F.col("id").alias(id_col), "n_tokens", *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(model.domains)), "rate", "copies")
