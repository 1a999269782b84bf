"""Repair of words that lost a letter, by keys with one gap and evidence of the vocabulary.

Each word of the vocabulary has a key for each of its letters: itself without that letter. A word that stands nowhere
else and equals such a key may be that word. The words that it may be are held against each other by how many documents
have them; the strongest one wins if no other is as strong. No text is held against the vocabulary: words meet keys by
equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of a repaired word, documents that make a word one of the vocabulary, and documents up to which a word is suspect.
LETTERS, KNOWN_FROM, SUSPECT_UPTO = 6, 3, 1
WORD = r"(\p{L}+)"


def strengths(texts: DataFrame, text_col: str = "body") -> DataFrame:
    """``word, docs``: in how many rows each word stands, in lower case."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(WORD)))
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))


def repairs(vocabulary: DataFrame, letters: int = LETTERS, known_from: int = KNOWN_FROM, suspect_upto: int = SUSPECT_UPTO) -> DataFrame:
    """``word, repaired, docs``: suspect words of a vocabulary (``word, docs``) that exactly one strongest known word may be."""
    known = vocabulary.where((F.col("docs") >= known_from) & (F.length("word") >= letters))
    gaps = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word")))))
    keys = known.select(F.explode(gaps).alias("_key"), F.col("word").alias("repaired"), "docs")
    suspect = vocabulary.where((F.col("docs") <= suspect_upto) & (F.length("word") >= letters - 1)).select("word")
    met = suspect.join(keys, F.col("word") == F.col("_key"))
    best = met.groupBy("word").agg(F.max("docs").alias("docs"), F.max(F.struct("docs", "repaired")).alias("_a"), F.collect_list("docs").alias("_all"))  # a word has few keys it equals
    return best.where(F.size(F.filter("_all", lambda n: n == F.col("docs"))) == 1).select("word", F.col("_a.repaired").alias("repaired"), "docs")


def repaired(texts: DataFrame, id_col: str = "id", text_col: str = "body", **limits: int) -> tuple[DataFrame, DataFrame]:
    """texts with ``repaired`` in place of damaged words, and the words repaired: ``id, word, repaired, docs``.

    A repaired word keeps a capital at its beginning. Texts without damage aren't taken apart; null texts stay null.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(WORD)))
    table = repairs(strengths(texts, text_col), **limits)
    found = texts.select(F.col(id_col).alias("id"), F.explode(words).alias("word")).join(table, "word").select("id", "word", "repaired", "docs")
    fixes = found.groupBy(F.col("id").alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("word", "repaired"))).alias("_fixes"))  # of one text
    met = texts.join(fixes, F.col(id_col) == F.col("_id"), "left")

    def fixed(piece):
        new = F.try_element_at(F.col("_fixes"), F.lower(piece))
        capital = F.substring(piece, 1, 1) != F.lower(F.substring(piece, 1, 1))
        return F.coalesce(F.when(capital, F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))).otherwise(new), piece)

    pieces = F.regexp_extract_all(text_col, F.lit(r"(\p{L}+|[^\p{L}]+)"))
    out = F.when(F.col("_fixes").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(pieces, fixed), ""))
    return met.withColumn("repaired", out).drop("_id", "_fixes"), found
