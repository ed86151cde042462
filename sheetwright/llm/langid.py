"""Language identification by prediction with partial matching (PPM, escape method C).

Each language has a context tree over bytes: contexts of up to three preceding bytes, each with the counts of the bytes
that followed it.  The code length of a byte is taken at the longest context that the tree knows; a byte that did not
follow there costs an escape and is looked for one byte shorter, with all bytes that the longer context already offered
excluded, down to a uniform code over the bytes never seen.  Statistics are frozen, so the code length of a text is a
sum over its four-byte windows, exact and independent of order; the language with the shortest code wins.

The trees are fitted on the driver on a bounded sample: about ``budget`` bytes of text a language, less where there are so many
languages that all together would exceed ``most`` bytes.  What is chosen, by a hash, are pieces of at most ``longest`` characters, so a
language counts whatever the length of its texts.  Scoring reads every whole text.  Code lengths are kept in 2**-16 bits as
integers, so that sums do not depend on how texts are batched.

Defined results: a null text, and one without a letter, is ``und`` with score 0; ties go to the language that sorts
first; with no labelled text every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, sliced, small_batches

ORDER = 3
UNDETERMINED = "und"
#: Bytes of the sample a language, and of that of all languages; characters of the longest piece in it.
BUDGET, MOST, LONGEST = 1_500_000, 96_000_000, 1 << 16
#: One bit of code length.
BIT = 1 << 16
#: What stands before a text's first byte.
START = np.full(ORDER, 10, dtype=np.uint8)
#: Bytes that are scored at once.
PIECE = 1 << 19


def windows(data: np.ndarray) -> np.ndarray:
    """The four-byte window that ends at each byte from the fourth on."""
    x = data.astype(np.uint32)
    return (x[:-3] << np.uint32(24)) | (x[1:-2] << np.uint32(16)) | (x[2:-1] << np.uint32(8)) | x[3:]


@dataclass
class Tree:
    """Frozen counts of one language, by context length k: symbols (context and byte), contexts, and exclusions.

    ``total`` and ``kinds`` count a context's bytes and its distinct bytes.  ``left`` and ``fresh`` are the same for the
    context one byte shorter, without the bytes that this context offers: what an escape from here meets there.
    """

    grams: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    total: list[np.ndarray] = field(default_factory=list)
    kinds: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    fresh: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def grow(cls, texts: list[bytes]) -> Tree:
        tree = cls()
        seen = np.concatenate([windows(np.concatenate([START, np.frombuffer(t, dtype=np.uint8)])) for t in texts if t] or [np.empty(0, np.uint32)])
        for k in range(ORDER + 1):
            grams, counts = np.unique(seen & np.uint32((1 << (8 * (k + 1))) - 1), return_counts=True)
            contexts, first = np.unique(grams >> np.uint32(8), return_index=True)
            add = lambda x, first=first: np.add.reduceat(x, first) if len(first) else x
            tree.grams.append(grams)
            tree.counts.append(counts)
            tree.contexts.append(contexts)
            tree.total.append(add(counts))
            tree.kinds.append(add(np.ones_like(counts)))
            if k:
                below = tree.counts[k - 1][np.searchsorted(tree.grams[k - 1], grams & np.uint32((1 << (8 * k)) - 1))]
                parent = np.searchsorted(tree.contexts[k - 1], contexts & np.uint32((1 << (8 * (k - 1))) - 1))
                tree.left.append(tree.total[k - 1][parent] - add(below))
                tree.fresh.append(tree.kinds[k - 1][parent] - tree.kinds[k])
            else:
                tree.left.append(np.empty(0))
                tree.fresh.append(np.empty(0))
        return tree

    def code_lengths(self, grams: np.ndarray) -> np.ndarray:
        """The code length in bits of each window's last byte after its other bytes."""
        cost = np.zeros(len(grams))
        open_, above = np.ones(len(grams), dtype=bool), np.full(len(grams), -1)
        for k in range(ORDER, -1, -1):
            mask = np.uint32((1 << (8 * (k + 1))) - 1)
            context = (grams & mask) >> np.uint32(8)
            at = np.minimum(np.searchsorted(self.contexts[k], context), max(0, len(self.contexts[k]) - 1))
            known = open_ & (self.contexts[k][at] == context) if len(self.contexts[k]) else np.zeros(len(grams), bool)
            escaped = known & (above >= 0)
            total, kinds = np.zeros(len(grams)), np.zeros(len(grams))
            entered = known & ~escaped
            total[entered], kinds[entered] = self.total[k][at[entered]], self.kinds[k][at[entered]]
            if k < ORDER:
                total[escaped], kinds[escaped] = self.left[k + 1][above[escaped]], self.fresh[k + 1][above[escaped]]
            symbol = np.minimum(np.searchsorted(self.grams[k], grams & mask), max(0, len(self.grams[k]) - 1))
            hit = known & (self.grams[k][symbol] == (grams & mask)) if len(self.grams[k]) else known
            cost[hit] += np.log2(total[hit] + kinds[hit]) - np.log2(self.counts[k][symbol[hit]])
            miss = known & ~hit & (kinds > 0)
            cost[miss] += np.log2(total[miss] + kinds[miss]) - np.log2(kinds[miss])
            open_ &= ~hit
            above = np.where(known, at, -1)
        never = 256 - (self.kinds[0][0] if len(self.kinds[0]) else 0)
        cost[open_] += np.log2(max(never, 1))
        return cost


@dataclass
class Model:
    """Trees by language, in sorted order, and a table of the code lengths that scoring has met."""

    languages: list[str]
    trees: list[Tree]
    slot_bits: int = 21
    _keys: np.ndarray | None = None
    _values: np.ndarray | None = None

    def exact(self, grams: np.ndarray) -> np.ndarray:
        return np.stack([np.rint(t.code_lengths(grams) * BIT).astype(np.int32) for t in self.trees])

    def lengths(self, grams: np.ndarray) -> list[np.ndarray]:
        """Code lengths of each window by language; the table's size is fixed, so others are worked out again."""
        if self._keys is None:
            self.slot_bits = max(12, min(self.slot_bits, 24 - (len(self.languages) - 1).bit_length()))
            self._keys = np.full(1 << self.slot_bits, 0xFFFFFFFF, dtype=np.uint32)
            self._values = np.zeros((len(self.languages), 1 << self.slot_bits), dtype=np.int32)
        shift = np.uint32(32 - self.slot_bits)
        slot = (grams * np.uint32(0x9E3779B1)) >> shift
        off = np.flatnonzero(self._keys[slot] != grams)
        second = (grams[off] * np.uint32(0x85EBCA6B)) >> shift
        slot[off] = second
        off = off[self._keys[second] != grams[off]]
        if not len(off):
            return [v[slot] for v in self._values]
        new, inverse = np.unique(grams[off], return_inverse=True)
        values = self.exact(new)
        out = [v[slot] for v in self._values]
        for v, w in zip(out, values, strict=True):
            v[off] = w[inverse]
        first = (new * np.uint32(0x9E3779B1)) >> shift
        home = np.where(self._keys[first] == 0xFFFFFFFF, first, (new * np.uint32(0x85EBCA6B)) >> shift)
        # Of windows that fall on one slot the last stays; its key and values are written from the same index.
        _, last = np.unique(home[::-1], return_index=True)
        last = len(home) - 1 - last
        self._keys[home[last]], self._values[:, home[last]] = new[last], values[:, last]
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths (texts by languages), in units of 2**-16 bits."""
        sums = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        group, size = [], 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), PIECE):
                head = START if not at else np.frombuffer(text[at - ORDER : at], dtype=np.uint8)
                part = np.concatenate([head, np.frombuffer(text[at : at + PIECE], dtype=np.uint8)])
                group.append((i, part))
                size += len(part)
                if size >= PIECE:
                    self._add(group, sums)
                    group, size = [], 0
        self._add(group, sums)
        return sums

    def _add(self, group, sums) -> None:
        if not group:
            return
        ends = np.cumsum([len(p) for _, p in group])
        starts = ends - np.array([len(p) for _, p in group])
        values = self.lengths(windows(np.concatenate([p for _, p in group])))
        # window j ends at byte j + 3: a part's own windows are [start, end - 3)
        cuts = np.stack([starts, ends - ORDER], axis=1).ravel()
        rows = np.array([i for i, _ in group])
        for n, v in enumerate(values):
            np.add.at(sums[:, n], rows, np.add.reduceat(np.append(v, 0), cuts, dtype=np.int64)[::2])


def fit(labelled: DataFrame, lang_col: str, text_col: str, id_col: str, budget: int = BUDGET, most: int = MOST, longest: int = LONGEST) -> Model:
    """Fit trees on a sample of about ``budget`` bytes of each language's texts, and of about ``most`` bytes in all.

    A piece is chosen with a language's share of its bytes, so that what is expected of a language is its budget, and the driver
    holds the sample and one number a language.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h")).where("lang is not null and text <> ''")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if not totals:
        return Model([], [])
    own = min(budget, most // len(totals))
    shares = rows.sparkSession.createDataFrame([(lang, int(min(1.0, own / n) * (1 << 30))) for lang, n in totals.items()], "lang string, share long")
    # a text's first piece keeps the text's hash; only pieces that are chosen are cut
    rank = lambda part: F.pmod(F.when(part == 0, F.col("h")).otherwise(F.xxhash64(F.col("h"), part)), F.lit(1 << 30))
    parts = F.filter(F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / longest).cast("int")), lambda part: rank(part) < F.col("share"))
    known = F.broadcast(shares) if len(totals) <= HOT_KEYS else shares  # a row a language; beyond that Spark decides
    chosen = rows.join(known, "lang").select("lang", "text", F.explode(parts).alias("part"))
    picked = chosen.select("lang", F.substr("text", F.col("part") * longest + 1, F.lit(longest)).alias("text")).collect()
    texts: dict[str, set[str]] = {lang: set() for lang in totals}
    for r in picked:
        texts[r["lang"]].add(r["text"])
    if missed := [lang for lang, found in texts.items() if not found]:  # a language of which nothing was chosen gives one first piece
        first = rows.where(F.col("lang").isin(*missed)).groupBy("lang").agg(F.min_by(F.substr("text", F.lit(1), F.lit(longest)), F.struct(rank(F.lit(0)), "h")).alias("text"))
        for r in first.collect():
            texts[r["lang"]].add(r["text"])
    languages = sorted(texts)
    return Model(languages, [Tree.grow([t.encode("utf-8", "surrogatepass") for t in sorted(texts[x])]) for x in languages])


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score (its share of the posterior) and bits_per_byte."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [*keep, "lang_pred", "score", "bits_per_byte"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double", "bits_per_byte double"])

    own_text = text_col if text_col in keep else "__text__"

    def work(batches):
        own = shared.value  # a worker keeps its copy, and the code lengths it has met, between tasks
        for batch in sliced(batches):
            texts, letters = batch.column(own_text).to_pylist(), batch.column("__letter__").to_pylist()
            data = [t.encode("utf-8", "surrogatepass") if t and ok else b"" for t, ok in zip(texts, letters, strict=True)]
            n = len(data)
            pred, score, rate = [UNDETERMINED] * n, np.zeros(n), np.zeros(n)
            if own.languages and n:
                bits = own.score(data) / BIT
                best = bits.argmin(axis=1)
                least = bits[np.arange(n), best]
                share = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
                for i, t in enumerate(data):
                    if t:
                        pred[i], score[i], rate[i] = own.languages[best[i]], share[i], least[i] / len(t)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score), pa.array(rate)], names=names)

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    extra = [] if text_col in keep else [F.col(text_col).alias("__text__")]
    return docs.select(*keep, *extra, letter.alias("__letter__")).mapInArrow(work, schema)
