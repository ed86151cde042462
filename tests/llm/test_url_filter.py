"""URL rules, segmentation and naive Bayes against direct versions."""

import itertools
import math
import re
from collections import Counter, defaultdict

import pytest

from sheetwright.llm import url_filter
from sheetwright.llm.common import Scratch
from sheetwright.llm.queries import URL_RULES
from sheetwright.llm.url_filter import NaiveBayes, host_words, lexicon, path_tokens, split_name


def parts(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    return (lower(found[1]), found[2]) if found else ("", "")


def rule_of(url):
    host, path = parts(url)
    fits = [r for r in URL_RULES if ("." + host).endswith("." + r.split("/")[0]) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme/en/1", "http://a.Example.COM/en/71?x=/en/", "http://example.com/en/8", "http://notexample.com/en/7", "https://x.net/de/8", "https://www.example.net/de/8/1", "http://com/en/", "http://com/en",
    "a://b.org/es/#f", "a://b.org?/es/", "x://y://z.org/es/", "http://ÉX.org/es/1", "http://h.org/fr/9", "http://h.org", "http://host.net/fr/" + "long/" * 5000, "http://host.net/de/1", "http://host.net/de/1",
]


def judge_urls(frame, rules):
    return url_filter.judge_urls(frame, rules, Scratch(frame.sparkSession, "t"))


def test_rules_and_parts(spark):
    rows = [(i, u, f"<title>The shop {i}</title>", "clash") for i, u in enumerate(URLS)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    found = {r.page_id: r for r in judge_urls(frame, URL_RULES).collect()}
    assert len(found) == len(URLS)
    for i, url in enumerate(URLS):
        assert (found[i].host, found[i].path) == parts(url)
        assert found[i].rule == rule_of(url)
        assert found[i].verdict in ("allow", "block")
        if found[i].rule:
            assert found[i].verdict == URL_RULES[found[i].rule]
    assert judge_urls(frame.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in judge_urls(frame, {}).collect()} == {"allow"}


def named_pages(spark):
    rows = [(i, f"http://{'casino' if i % 2 else 'garden'}{w}.com/{i}", "<p class=x>casino garden win rose</p>") for i, w in enumerate(["win", "rose"] * 40)]
    rows += [(1000, "http://bestcasino.org/5", None), (1001, "http://bestgarden.org/5", None), (1002, "http://adult-best.org/", "<title lang=en>best</title>"), (1003, "http://other.org/", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_verdicts_follow_segmented_names(spark, monkeypatch):
    """Names that the rules never saw are judged by their words, and alike where names are not split."""
    rules = {"casinorose.com/": "block", "gardenwin.com/": "allow"}
    judged = lambda: {r.page_id: r.verdict for r in judge_urls(named_pages(spark), rules).collect()}
    found = judged()
    assert (found[1000], found[1001]) == ("block", "allow")
    monkeypatch.setattr(url_filter, "lexicon", lambda rows, texts: rows.selectExpr("host as word", "1L as n").limit(0))
    monkeypatch.setattr(url_filter, "split_name", lambda name, counts, total: [name])
    found = judged()
    assert found[1000] == found[1001]


def slow_verdicts(pages, rules, split=split_name):
    """The whole method, on one machine, with rules as (host, path prefix)."""
    urls = [(i, *parts(u)) for i, u, _ in pages]
    decided = {}
    for i, host, path in urls:
        fits = [r for r in rules if ("." + host).endswith("." + r.split("/")[0]) and path.startswith("/" + r.split("/", 1)[1])]
        decided[i] = rules[max(fits, key=len)] if fits else None
    counts = Counter()
    for _, _, text in pages:
        counts.update(re.findall(r"[^\W\d_]+", re.sub(r"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", (text or "").lower())))
    for _, _, path in urls:
        counts.update(re.findall(r"[^\W\d_]+", path.lower()))
    hosts = {h for _, h, _ in urls}
    labels = [(h, x) for h in hosts for x in h.split(".")]
    counts.update(w for _, x in labels if "-" in x for w in re.split(r"\W+", x) if w)
    holders = Counter(x for _, x in set(labels))
    counts.update({x: n for x, n in holders.items() if n >= 2 and x})
    total = sum(counts.values())
    words = {h: [w for x in re.split(r"\W+", h) if x for w in split(x, counts, total)] for h in hosts}
    tokens = {i: ["h:" + w for w in words[h]] + path_tokens(p) for i, h, p in urls}
    seen = defaultdict(Counter)
    for i, d in decided.items():
        if d:
            seen[d].update(tokens[i])
    known, n = set(seen["block"]) | set(seen["allow"]), Counter(decided.values())
    total = {d: sum(seen[d].values()) + len(known) for d in ("block", "allow")}
    out = {}
    for i in tokens:
        odds = math.log(n["block"] + 1) - math.log(n["allow"] + 1)
        if n["block"] and n["allow"]:
            odds += sum(math.log((seen["block"][t] + 1) / total["block"]) - math.log((seen["allow"][t] + 1) / total["allow"]) for t in tokens[i] if t in known)
        out[i] = decided[i] or ("block" if odds > 0 else "allow")
    return out, words


def test_verdicts_against_a_plain_version(spark):
    """The registered query's whole result on the table, and on a small fixture."""
    for frame, rules in ((spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), URL_RULES), (named_pages(spark), {"casinorose.com/": "block", "gardenwin.com/": "allow"})):
        rows = frame.select("page_id", "url", "html").collect()
        want, words = slow_verdicts([tuple(r) for r in rows], rules)
        assert {r.page_id: r.verdict for r in judge_urls(frame, rules).collect()} == want
        assert set(want.values()) == {"allow", "block"}
    assert words["adult-best.org"] == ["adult", "best", "org"] and words["bestcasino.org"] == ["best", "casino", "org"]


def test_names_of_the_table_are_split_into_words(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, path = url_filter.host_and_path(pages["url"])
    rows = pages.select(host.alias("host"), path.alias("path"))
    scratch = Scratch(spark, "t")
    found = {r.host: r.words for r in host_words(rows, lexicon(rows, pages.select(pages["html"].alias("text"))), scratch).collect()}
    for host, words in found.items():
        assert "".join(words) == re.sub(r"[^\w]", "", host)
        for part in host.split("."):
            if "-" in part:
                assert set(part.split("-")) <= set(words), (host, words)
        assert {"example"} <= set(words)


def test_segmentation_is_the_cheapest_split():
    counts = {"the": 50, "rapist": 3, "therapist": 2, "on": 9, "line": 9, "online": 1}
    total = sum(counts.values())
    cost = lambda w: math.log((total + 1) / counts[w]) if w in counts else math.log((total + 1) * 10) if len(w) == 1 else math.inf
    for name in ("therapist", "online", "theonline", "xonline", "", "qqq"):
        splits = [[name[i:j] for i, j in itertools.pairwise((0, *cut, len(name)))] for n in range(len(name)) for cut in itertools.combinations(range(1, len(name)), n)]
        price = lambda ws: sum(map(cost, ws))
        assert price(split_name(name, counts, total)) == pytest.approx(min(map(price, splits), default=0.0))
        assert "".join(split_name(name, counts, total)) == name


def test_naive_bayes():
    bayes = NaiveBayes([("a", 2, 0), ("b", 1, 1)], 2, 1)
    assert bayes.score(["a"]) == pytest.approx(math.log(3 / 2) + math.log(3 / 5) - math.log(1 / 3))
    assert NaiveBayes([("a", 1, 0)], 1, 0).score(["a"]) > 0
    assert NaiveBayes([], 0, 0).score(["a"]) == 0
    assert path_tokens("/Shop_12/a-77.html") == ["p:shop", "p:#", "p:a", "p:#", "p:html"]
