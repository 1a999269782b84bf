"""Quality rules: distribution divergence from language references.

A document's histograms of character classes and of common words are compared with those of its language by the
Jensen-Shannon distance (base 2, so 0 to 1). The references are measured on the table itself, over all documents
of each known language, each document counting once: the medians of the shares of character classes, which junk
in less than half of the documents doesn't move, and the means of the shares of common words. Documents of other
or no language are held against the references of all documents. Short documents are not judged by divergence, since a
few words say little about a distribution. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .text_stats import matches, with_counts, with_repeats, with_words

#: Common words by language (fixed values: articles, prepositions, pronouns and conjunctions of everyday use).
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf".split(),
    "en": "the of and to in a is that for it as was".split(),
    "es": "de la que el en y a los se del las un".split(),
    "fr": "de la le et les des en un du une que est".split(),
}
#: Words held against the histogram of documents of other or no language.
MIXED_WORDS = "the of and to der die und que el de la le".split()
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})
BINS = 1 + len(MIXED_WORDS)
#: Character classes counted one by one; letters of no case and of lower case are the rest.
CLASSES = {"upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "mark": "[.,;:!?'\"()\\-]+", "symbol": r"[^\p{L}\p{M}\p{N}.,;:!?'\"()\-]+"}
#: Documents of fewer words aren't judged by divergence.
MIN_WORDS = 60
#: A document is rejected if both distances are above the first pair, or that of characters alone is above the last.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MAX_CHAR_ALONE = 0.20, 0.22, 0.30
#: Columns that judge() adds, or replaces.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept")
#: Base rules.
BASE_MIN_WORDS, BASE_MAX_REPEAT_PERCENT = 10, 20


def by_language(lang: Column | None, values: dict[str, Column]) -> Column:
    """The value of a row's language, or that of "other"."""
    if lang is None:
        return values["other"]
    out = F.when(F.lit(False), values["other"])
    for k in COMMON_WORDS:
        out = out.when(lang == k, values[k])
    return out.otherwise(values["other"])


def with_histograms(df: DataFrame, lang: Column | None) -> DataFrame:
    """df of with_counts with ``_chars`` and ``_common``, histograms that add up to 1, or to 0 where nothing counts.

    ``_common`` has a share for each common word of the document's language, and one of all other words.
    """
    listed = by_language(lang, {k: F.array(*map(F.lit, v)) for k, v in (COMMON_WORDS | {"other": MIXED_WORDS}).items()})
    counts = F.array(*[matches(F.col("_letters"), c) for c in CLASSES.values()])
    # a listed word between two spaces of its own, so that each can be counted by what removing it saves
    spaced = F.concat(F.lit(" "), F.array_join(F.filter("_words", lambda w: w.isin(WORDS)), "  "), F.lit(" "))
    found = df.withColumns({"_class_counts": counts, "_listed_words": listed, "_spaced": spaced})
    found = found.withColumn("_spaced_length", F.length("_spaced"))
    times = F.transform("_listed_words", lambda w: (F.col("_spaced_length") - F.length(F.replace("_spaced", F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.length(w) + 2))
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    both = found.withColumns({"_chars": F.transform("_class_counts", lambda n: n / chars), "_common": F.transform(times, lambda n: n / words)})
    rest = lambda c, total: F.concat(F.col(c), F.array(F.when(total > 0, 1 - F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)))
    return both.withColumns({"_chars": rest("_chars", F.col("word_chars")), "_common": rest("_common", F.col("n_words"))}).drop("_class_counts", "_listed_words", "_spaced", "_spaced_length")


def measure(df: DataFrame) -> DataFrame:
    """df (``text``, and ``lang`` if there) with its counts and histograms; one pass over the texts."""
    lang = F.col("lang") if "lang" in df.columns else None
    counted = with_histograms(with_counts(with_words(df)), lang)
    keyed = counted.withColumn("_key", by_language(lang, {k: F.lit(k) for k in [*COMMON_WORDS, "other"]}))
    return with_repeats(keyed.drop("_letters", "_lines")).drop("_text", "_words")


def references(measured: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Reference histograms by language and of all documents (key "other"), over every document with a word.

    The common words of "other" are measured on documents of other or no language, and without any such document on
    nothing, so that they can't be judged. At most one row per known language and two more reach the driver.
    """
    sizes = (len(CLASSES) + 1, BINS)
    one = measured.where("n_words > 0").select("_key", *[F.get("_chars", F.lit(i)).alias(f"c{i}") for i in range(sizes[0])], *[F.get("_common", F.lit(i)).alias(f"w{i}") for i in range(sizes[1])])
    middle = [F.percentile_approx(f"c{i}", 0.5, 1000) for i in range(sizes[0])]
    mean = [F.avg(f"w{i}") for i in range(sizes[1])]
    rows = {r[0]: (scaled(r[1]), scaled(r[2])) for r in one.rollup("_key").agg(F.array(*middle), F.array(*mean)).collect()}
    nothing = ([0.0] * (sizes[0] - 1) + [1.0], [0.0] * (sizes[1] - 1) + [1.0])
    everything = rows.get(None, nothing)[0]
    out = {k: rows.get(k, (everything, nothing[1])) for k in COMMON_WORDS}
    return out | {"other": (everything, rows.get("other", nothing)[1])}


def scaled(values: list[float | None]) -> list[float]:
    total = sum(v or 0.0 for v in values)
    return [(v or 0.0) / total if total else 0.0 for v in values]


def distance(histogram: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    parts = F.zip_with(histogram, reference, lambda p, q: (term(p, (p + q) / 2) + term(q, (p + q) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def judge(df: DataFrame, keep_text: bool = True, refs: dict[str, tuple[list[float], list[float]]] | None = None) -> DataFrame:
    """df (``text``, and ``lang`` if there) with the counts of text_stats, ``char_distance``, ``word_distance``, ``base_failed``, ``kept``.

    A null text counts as empty, which fails the base rules; unknown and null languages use the reference of all
    documents; ids and further columns pass through (text only if keep_text), repeated rows alike. An empty table
    gives an empty result. The measures are written to the shared folder once, read for the references
    (refs: from references(), measured on df when not given), and read again for the verdicts.
    """
    row = F.struct(*[F.col(c) for c in df.columns if c not in RESULTS and (keep_text or c != "text")])  # whole, so that no name of it can clash
    made = materialise(measure(df.select(row.alias("_row"), *[c for c in ("text", "lang") if c in df.columns])).drop("text"), "measures")
    refs = refs or references(made)
    literal = lambda values: F.array(*[F.lit(float(v)) for v in values])
    pick = lambda i: by_language(F.col("_key"), {k: literal(v[i]) for k, v in refs.items()})
    judged = made.withColumns({"char_distance": distance(F.col("_chars"), pick(0)), "word_distance": distance(F.col("_common"), pick(1))})
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words"))
    both = (F.col("char_distance") > MAX_CHAR_DISTANCE) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    strange = (F.col("n_words") >= MIN_WORDS) & (both | (F.col("char_distance") > MAX_CHAR_ALONE))
    return judged.withColumns({"base_failed": failed, "kept": ~failed & ~strange}).select("_row.*", *RESULTS)
