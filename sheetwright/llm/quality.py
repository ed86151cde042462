"""Quality rules: distribution divergence from language references, by DataFrame functions only.

Base rules count words, symbols, repeated lines and words in repeated five-word windows.  The method's rule compares two
histograms of a document with its language's reference by the Jensen-Shannon distance (base 2, 0 to 1): character
classes, and the language's ``COMMON`` most common words, in ``TIERS`` by rank, against all others.  References are the sums of the documents' own counts
over the whole table, and common words are those most frequent in all of it.

Short texts have histograms that say little, so each distance counts only from a least length on; below it the document
passes.  A text without any common word has the same word distance whatever its length; a document fails from ``FAR`` of
that of its language on.  A document of no known language is compared on character classes only, with the reference of all documents.

Words are runs of characters other than ASCII white space.  Five-word windows are compared by their 64-bit hash.
Defined results: a null text has no words and fails the base rules; repeated rows are judged each; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, Scratch, look_up

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: How many words of a language count as common, and the ranks that end their tiers.
COMMON = 512
TIERS = (4, 16, 64, 128, COMMON)
#: So many languages, those with the most documents, have their common words in the plan; the words of the others are joined to their documents.
NAMED = 64
#: Characters by class, the most frequent first; what none of them matches is the last class.  Classes do not overlap.
CLASSES = [r"\p{Ll}", r"[\x20\x09-\x0D]", r"\p{Lu}", r"[.,;:?'\"()-]", r"[0-9]"]
SYMBOLS = r"[#*$%&|<>]"
#: Least characters and words for the two distances to count, the class distance above which a document fails, and the
#: share of the distance of a text without common words.
LEAST_CHARS, LEAST_WORDS = 200, 50
MOST_CLASSES, FAR = 0.28, 0.6


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return let(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE)))


def repeated_words(words: Column) -> Column:
    """Words that lie in a five-word window found at least twice, the first time included."""
    n = F.size(words)
    both = lambda x, y: F.xxhash64(x, y)
    # hashes of two words, of four, and of five: each takes two arrays side by side, which is cheaper than five look-ups a word
    fours = let(F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), both), lambda twos: F.zip_with(F.slice(twos, 1, n - 3), F.slice(twos, 3, n - 3), both))
    fives = let(fours, lambda h: F.zip_with(F.slice(h, 1, n - 4), F.slice(words, WINDOW, n - 4), both))
    windows = F.when(n >= WINDOW, fives).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda e: e["i"]))
        steps = let(places, lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def base_features(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``__base__`` (n_words, word_chars, n_repeat_words) and n_dup_lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    made = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    return docs.withColumns({"__base__": made, "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))})


def character_counts(text: Column) -> Column:
    """(classes, n_symbols): the characters of each class, and how many symbols there are.

    Runs of one class after the other are taken out, so that each test meets the few characters that are left.
    """

    def rest(left: Column, counts: list[Column], symbols: Column | None) -> Column:
        if len(counts) == 2:  # neither letters nor white space are symbols
            symbols = F.regexp_count(left, F.lit(SYMBOLS)).cast("long")
        if len(counts) == len(CLASSES):
            return F.struct(F.array(*counts, F.char_length(left).cast("double")).alias("classes"), symbols.alias("n_symbols"))
        taken = F.regexp_replace(left, CLASSES[len(counts)] + "+", "")
        return let(taken, lambda t: rest(t, [*counts, (F.char_length(left) - F.char_length(t)).cast("double")], symbols))

    return rest(text, [], None)


def common_words(docs: DataFrame, text_col: str, lang_col: str, most: int = COMMON) -> DataFrame:
    """(lang, best): the most frequent words of each language over all documents; of equally frequent ones the first by the alphabet."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # Words are counted in each task before any is moved, and tested for letters once they are counted.
    counted = rows.select("lang", F.explode(words_of(F.lower("text"))).alias("word")).groupBy("lang", "word").count().where(F.col("word").rlike(r"^\p{L}+$"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))).where(F.col("r") <= most)
    listed = F.array_sort(F.collect_list(F.struct("r", "word")))  # at most ``most`` words
    return best.groupBy("lang").agg(F.transform(listed, lambda x: x["word"]).alias("best"))


def jensen_shannon(p: Column, q: Column) -> Column:
    """The distance between two arrays of counts of equal length; NULL where either sums to nothing."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    shares = F.zip_with(p, q, lambda a, b: F.struct((a / total(p)).alias("a"), (b / total(q)).alias("b")))
    terms = F.transform(shares, lambda s: part(s["a"], (s["a"] + s["b"]) / 2) + part(s["b"], (s["a"] + s["b"]) / 2))
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(total(terms) / 2, F.lit(0.0))))


def tier_counts(words: str, best: list[str]) -> str:
    """SQL of how many of an array's words are of each tier of ``best`` (letters only); sets are looked up by hash."""
    made, inner = "", words
    for k, end in reversed(list(enumerate(TIERS))):  # a tier's words are sought among those of the tier above
        named = ", ".join(f"'{w}'" for w in best[:end])
        made += f"element_at(transform(array(filter({inner}, x -> x in ({named}))), t{k} -> "
        inner = f"t{k}"
    counts = [f"cast(size(t{k}){f' - size(t{k - 1})' if k else ''} as double)" for k in range(len(TIERS))]
    return f"{made}array({', '.join(counts)})" + "), 1)" * len(TIERS)


def tiers_among(words: Column, best: Column) -> Column:
    """The same for a column of best words."""
    among = lambda named: F.size(F.filter(words, lambda w: F.array_contains(named, w)))
    upto = [among(F.slice(best, 1, end)) for end in TIERS]
    return F.array(*((n - upto[k - 1] if k else n).cast("double") for k, n in enumerate(upto)))


def histograms(docs: DataFrame, text_col: str, lang_col: str, words: dict[str, list[str]], best_col: str | None = None) -> DataFrame:
    """``docs`` with ``__classes__`` (characters by class), n_symbols and ``__found__`` (the language's common words by tier).

    ``words`` are the named languages' common words, in order; ``best_col`` has those of a document's language, if it is another one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counts = F.when(F.col(best_col).isNotNull(), tiers_among(F.col("__lower__"), F.col(best_col))) if best_col else F.lit(None).cast("array<double>")
    for lang, best in words.items():
        counts = F.when(F.col(lang_col) == lang, F.expr(tier_counts("__lower__", best))).otherwise(counts)
    docs = docs.withColumns({"__chars__": character_counts(text), "__lower__": words_of(F.lower(text))}).withColumn("__found__", counts).drop("__lower__")
    return docs.withColumns({"__classes__": F.col("__chars__.classes"), "n_symbols": F.col("__chars__.n_symbols")}).drop("__chars__")


def judge(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, the base counts, base_failed, kept, and the two distances."""
    common = scratch.table(common_words(docs, text_col, lang_col), "common")
    langs = docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count().join(common, "lang", "left_semi")
    top = [r["lang"] for r in langs.orderBy(F.desc("count"), "lang").limit(NAMED).collect()]
    words = {r["lang"]: r["best"] for r in common.where(F.col("lang").isin(*top)).collect()}
    rows = docs.select(F.col(id_col).alias("__id__"), F.col(text_col).alias("__text__"), F.col(lang_col).alias("__lang__"))
    named = F.col("__lang__").isin(*words) if words else F.lit(False)
    others = common.where(~F.col("lang").isin(*top)) if top else common
    best_col = None if others.isEmpty() else "__best__"
    if best_col:
        rows = rows.join(others.select(F.col("lang").alias("__lang__"), F.col("best").alias(best_col)), "__lang__", "left")
        named = named | F.col(best_col).isNotNull()
    lang = F.when(named, F.col("__lang__"))
    rows = histograms(base_features(rows, "__text__"), "__text__", "__lang__", words, best_col)
    rows = rows.select(
        F.col("__id__").alias("id"), lang.alias("lang"), "__base__.*", "n_symbols", "n_dup_lines", F.col("__classes__").alias("classes"), F.col("__found__").alias("found")
    )
    rows = scratch.table(rows, "features")
    n_classes, n_common = len(CLASSES) + 1, len(TIERS)
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n_classes)] + [F.sum(F.get("found", F.lit(i))).alias(f"w{i}") for i in range(n_common)]
    own = rows.groupBy("lang").agg(*sums, F.sum("n_words").cast("double").alias("w"), F.count(F.lit(1)).alias("n"))
    whole = own.agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(n_classes))).first()
    pooled = F.array(*(F.lit(x).cast("double") for x in whole))
    references = own.where("lang is not null").select(
        F.col("lang").alias("__lang__"),
        F.array(*(f"c{i}" for i in range(n_classes))).alias("ref_classes"),
        F.array_compact(F.array(*(f"w{i}" for i in range(n_common)))).cast("array<double>").alias("ref_found"),
        F.col("w").alias("ref_words"), "n",
    )
    # a language that holds many of the rows is looked up apart
    few = own.count() <= HOT_KEYS
    joined = rows.join(F.broadcast(references), F.col("lang") == F.col("__lang__"), "left") if few else look_up(rows, references.withColumnRenamed("__lang__", "lang"), "lang", "n", rows.count())
    rest = lambda found, n: F.concat(found, F.array(F.greatest(n - F.aggregate(found, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))
    chars = F.aggregate("classes", F.lit(0.0), lambda a, x: a + x)
    by_class = F.when(chars >= LEAST_CHARS, jensen_shannon(F.col("classes"), F.coalesce(F.col("ref_classes"), pooled)))
    by_word = F.when(F.col("n_words") >= LEAST_WORDS, jensen_shannon(rest(F.col("found"), F.col("n_words").cast("double")), rest(F.col("ref_found"), F.col("ref_words"))))
    none = jensen_shannon(rest(F.transform("ref_found", lambda x: F.lit(0.0)), F.lit(1.0)), rest(F.col("ref_found"), F.col("ref_words")))
    judged = joined.withColumns({"class_distance": by_class, "word_distance": by_word, "without": none})
    judged = judged.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    fits = (F.coalesce("class_distance", F.lit(0.0)) <= MOST_CLASSES) & (F.coalesce("word_distance", F.lit(0.0)) <= FAR * F.coalesce("without", F.lit(1.0)))
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fits).alias("kept"), "class_distance", "word_distance"
    )

