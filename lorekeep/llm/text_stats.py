"""Statistics of whole texts as DataFrame expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that parts words, and the symbols that count as such (fixed by the contract of the rules).
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
REPEAT_WINDOW = 5


def matches(text: Column, char_class: str) -> Column:
    """Number of characters of a class."""
    return (F.length(text) - F.length(F.regexp_replace(text, char_class, ""))).cast("long")


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition) for conditions on computed columns.

    The optimizer moves a filter below the projections it stands on and so computes their expressions anew, word
    arrays included, for every use (seen on Spark 4.1). A condition that also reads a row number stays where it is.
    """
    return df.withColumn("_row_number", F.monotonically_increasing_id()).where((F.col("_row_number") >= 0) & condition).drop("_row_number")


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """df with ``_text`` (null: empty) and its arrays ``_words`` and ``_lines`` (lines that hold a word)."""
    clean = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    words = F.filter(F.split("_text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "")
    return clean.withColumns({"_words": words, "_lines": lines})


def with_counts(df: DataFrame) -> DataFrame:
    """df of with_words with ``n_words, word_chars, n_symbols, n_dup_lines`` and ``_letters`` (the words joined)."""
    joined = df.withColumn("_letters", F.array_join("_words", ""))
    return joined.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length("_letters").cast("long"),
        "n_symbols": matches(F.col("_letters"), SYMBOLS),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })


def with_repeats(df: DataFrame, window: int = REPEAT_WINDOW) -> DataFrame:
    """df of with_words with ``n_repeat_words``: words that lie in a window of words found twice or more in the text.

    Windows are told apart by 64-bit hashes, built by joining those of shorter windows. Texts that hold none twice
    are done then; the others sort theirs and add up what the repeated ones cover.
    """
    hashed = df.withColumn("_hash1", F.transform("_words", lambda w: F.xxhash64(w)))
    # doubling: a window of a + b words is one of a words and, a places on, one of b
    size = 1
    while size < window:
        more = min(size, window - size)
        other = F.col(f"_hash{more}")
        enough = F.size(other) > size
        joined = F.zip_with(F.slice(f"_hash{size}", F.lit(1), F.size(other) - size), F.slice(other, F.lit(size + 1), F.size(other) - size), lambda x, y: F.xxhash64(x, y))
        hashed = hashed.withColumn(f"_hash{size + more}", F.when(enough, joined).otherwise(F.array().cast("array<bigint>")))
        size += more
    last = f"_hash{window}"
    pairs = F.when(F.size(F.array_distinct(last)) < F.size(last), F.sort_array(F.transform(last, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    sorted_pairs = hashed.withColumn("_pairs", pairs)
    twice = F.filter("_pairs", lambda x, j: (x["h"] == F.get("_pairs", j - 1)["h"]) | (x["h"] == F.get("_pairs", j + 1)["h"]))
    placed = sorted_pairs.withColumn("_starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_starts", lambda x, j: F.least(F.lit(window), F.coalesce(F.get("_starts", j + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x)
    counted = placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return counted.drop("_pairs", "_starts", *[c for c in counted.columns if c.startswith("_hash")])
