"""URL filter: explicit rules first, then host word segmentation and multinomial naive Bayes.

A rule is ``host/path-prefix`` with a verdict.  It fits its host and all subdomains where the URL's path starts with the
rule's path; of the rules that fit, the longest decides.

Other URLs are scored by multinomial naive Bayes on the words of host and path.  A host's names are split into words by
Viterbi under a unigram model, so that concatenated names give words that recur in others.

The unigram model counts every word of the table's whole page texts, and the words that URLs set apart: those of paths,
the parts of names with a hyphen, and names that several hosts share.  It has no cap and is never gathered: each distinct
name's substrings are joined with the counts, so a name is split from its own few counts.  A character that no word covers
costs more than any word.

Naive Bayes is fitted on the URLs that the rules decide, on a sample of about ``SAMPLE`` rows chosen by hash, a documented
bound; it is counted by word where the rows are, and the words of that sample are broadcast.

Defined results: a null URL, and one without ``://``, has empty host and path; a URL that no rule fits gets the naive
Bayes verdict, and ``allow`` where both verdicts score alike or nothing could be learned; null page texts have no words;
repeated rows are judged each; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, look_up, sliced

#: Rows that naive Bayes is fitted on, about.
SAMPLE = 100_000
#: Most rules that are tested one by one in the plan.
MOST_RULES = 2000
#: Longest word of a name: a fixed value, the longest label of a host.
LONGEST_WORD = 63
#: Hosts that must share a name for it to count as a word.
SHARED = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def first_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        own, _, prefix = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + prefix)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, rules[rule]).otherwise(verdict)
    return name, verdict


def split_name(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely split of a name into counted words; a character outside of them costs ten times the rarest word."""
    unknown = math.log(total + 1) + math.log(10.0)
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        choice = (best[end - 1] + unknown, end - 1)
        for start in range(max(0, end - LONGEST_WORD), end):
            if n := counts.get(name[start:end]):
                choice = min(choice, (best[start] + math.log((total + 1) / n), start))
        best.append(choice[0])
        back.append(choice[1])
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def path_tokens(path: str) -> list[str]:
    """Words of a path, with numbers made alike."""
    return ["p:" + ("#" if t.isdigit() else t) for t in re.findall(r"[^\W_]+", path.lower())]


def tokens_of(words: list[str] | None, path: str) -> list[str]:
    """Segmented words of the host, and words of the path."""
    return ["h:" + w for w in words or []] + path_tokens(path)


def page_words(text: Column) -> Column:
    """Lower-case runs of letters in a page's text, tags, scripts and styles left out."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return F.regexp_extract_all(plain, F.lit(r"(\p{L}+)"), F.lit(1))


def names_of(host: Column) -> Column:
    """A host's names: runs of letters, digits and underscores."""
    return F.filter(F.split(host, r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def lexicon(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs in texts (text) and, set apart, in rows (host, path)."""
    hosts = rows.select("host").distinct()
    labels = hosts.select("host", F.explode(F.split("host", r"\.")).alias("label"))
    parts = labels.where(F.col("label").contains("-")).select(F.explode(names_of(F.col("label"))).alias("word"))
    shared = labels.distinct().groupBy(F.col("label").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED)
    paths = rows.select(F.explode(F.regexp_extract_all(F.lower("path"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    words = texts.select(F.explode(page_words(F.col("text"))).alias("word"))
    counted = [x.groupBy("word").agg(F.count(F.lit(1)).alias("n")) for x in (words, paths, parts)]
    return counted[0].union(counted[1]).union(counted[2]).union(shared).groupBy("word").agg(F.sum("n").alias("n")).where("word <> ''")


def host_words(rows: DataFrame, words: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, hosts, words): each distinct host's segmented words in order, and how many rows have it."""
    hosts = scratch.table(rows.groupBy("host").agg(F.count(F.lit(1)).alias("hosts")), "hosts")
    placed = hosts.select("host", F.posexplode(names_of(F.col("host"))).alias("place", "name"))
    names = scratch.table(placed.select("name").distinct(), "names")
    size = F.char_length("name")
    starts = F.sequence(F.lit(1), size)
    spans = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), size - i + 1)), lambda k: F.substr("name", i, k)))
    pieces = names.select("name", F.explode(F.array_distinct(F.flatten(spans))).alias("word"))
    total = words.agg(F.sum("n")).first()[0] or 0
    known = pieces.join(words, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("counts"))  # a name's substrings at most
    known = names.join(known, "name", "left")

    def work(batches):
        for batch in sliced(batches):
            found = [split_name(r["name"], {c["word"]: c["n"] for c in r["counts"] or []}, total) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(found, pa.list_(pa.string()))], names=["name", "words"])

    split = known.mapInArrow(work, "name string, words array<string>")
    joined = placed.join(split, "name").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("parts"))  # a host's names
    whole = hosts.join(joined, "host", "left")
    return scratch.table(whole.select("host", "hosts", F.coalesce(F.flatten(F.transform("parts", lambda p: p["words"])), F.array().cast("array<string>")).alias("words")), "host_words")


class NaiveBayes:
    """Multinomial naive Bayes with add-one smoothing from (token, block, allow) counts and URLs by verdict; log-odds of
    block against allow."""

    def __init__(self, counts: list[tuple[str, int, int]], block: int, allow: int):
        total = [sum(c[k] for c in counts) + len(counts) for k in (1, 2)]
        self.odds = {t: math.log((b + 1) / total[0]) - math.log((a + 1) / total[1]) for t, b, a in counts} if block and allow else {}
        self.prior = math.log(block + 1) - math.log(allow + 1)

    def score(self, tokens: list[str]) -> float:
        return self.prior + sum(self.odds.get(t, 0.0) for t in tokens)


def judge_urls(pages: DataFrame, rules: dict[str, str], scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("__id__"), host.alias("host"), path.alias("path"))
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    rows = scratch.table(rows.withColumns({"rule": rule, "decided": verdict}), "rows")
    words = scratch.table(lexicon(rows, pages.select(F.col(html_col).alias("text"))), "lexicon")
    split = host_words(rows, words, scratch)
    rows = look_up(rows, split, "host", "hosts", rows.count())
    known = rows.where("decided is not null")
    share = min(1.0, sample / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("host", "path", "__id__"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def spread(batches):
        for batch in sliced(batches):
            tokens = [(t, d) for w, p, d in zip(batch.column("words").to_pylist(), batch.column("path").to_pylist(), batch.column("decided").to_pylist(), strict=True) for t in ["", *tokens_of(w, p)]]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in tokens], pa.string()), pa.array([d for _, d in tokens], pa.string())], names=["token", "decided"])

    counts = picked.select("words", "path", "decided").mapInArrow(spread, "token string, decided string").groupBy("token").agg(F.count_if(F.col("decided") == "block").alias("b"), F.count_if(F.col("decided") == "allow").alias("a")).collect()
    urls = next((r for r in counts if r["token"] == ""), None)  # one a URL
    bayes = NaiveBayes([(r["token"], r["b"], r["a"]) for r in counts if r["token"]], *((urls["b"], urls["a"]) if urls else (0, 0)))
    shared = pages.sparkSession.sparkContext.broadcast(bayes)
    kind = pages.schema[id_col].dataType.simpleString()

    def work(batches):
        bayes = shared.value
        for batch in sliced(batches):
            words, paths, known = (batch.column(c).to_pylist() for c in ("words", "path", "decided"))
            verdicts = [k or ("block" if bayes.score(tokens_of(w, p)) > 0 else "allow") for w, p, k in zip(words, paths, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("__id__", "host", "path", "rule")), pa.array(verdicts, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    return rows.select("__id__", "host", "path", "rule", "decided", "words").mapInArrow(work, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
