"""Repairs of texts torn by extraction: hyphens, ligatures, log and list upkeep."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Presentation forms of ligatures and their letters (fixed values of the character standard).
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_WORD = re.compile(r"[^\W\d_]+")
_TORN = re.compile(r"([^\W\d_]+)-\s+([^\W\d_]+)")


def rejoined(text: str | None) -> str:
    """A text whose words torn by a hyphen are joined where the joined word stands elsewhere in it, until nothing changes."""
    text = text or ""
    while True:
        known = {w.lower() for w in _WORD.findall(text)}
        fixed = _TORN.sub(lambda m: m[1] + m[2] if (m[1] + m[2]).lower() in known else m[0], text)
        if fixed == text:
            return text
        text = fixed


def repair_texts(docs: DataFrame, text_col: str = "body") -> DataFrame:
    """docs with ``repaired``: ligatures resolved, torn words rejoined; a document at a time, without shuffle."""
    plain = F.col(text_col)
    for form, letters in LIGATURES.items():
        plain = F.replace(plain, F.lit(form), F.lit(letters))

    @F.pandas_udf("string")
    def join(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(rejoined)

    return docs.withColumn("repaired", F.when(plain.rlike(r"\p{L}-\s+\p{L}"), join(plain)).otherwise(plain))


def moved_block(text: Column, block: str, anchor: str, before: bool = True) -> Column:
    """A text with the first match of block (a regular expression) moved right before or behind the first match of anchor; unchanged where either is missing, or the anchor lies within the block."""
    cut = lambda x, at, n: F.concat(F.substring(x, F.lit(1), at - 1), F.substring(x, at + n, F.length(x)))
    piece = F.regexp_extract(text, f"({block})", 1)
    rest = cut(text, F.position(piece, text), F.length(piece))
    mark = F.regexp_extract(rest, f"({anchor})", 1)
    at = F.position(mark, rest) + (F.lit(0) if before else F.length(mark))
    moved = F.concat(F.substring(rest, F.lit(1), at - 1), piece, F.substring(rest, at, F.length(rest)))
    return F.when((piece == "") | (mark == ""), text).otherwise(moved)


def bold_headings(text: Column, level: int = 3) -> Column:
    """Lines of bold text that end without a full stop become headings of a level."""
    return F.regexp_replace(text, r"(?m)^\*\*([^*\n.]{2,80})\*\*[ \t]*$", "#" * level + " $1")


def repaired_names(names: DataFrame, contents: DataFrame, curated: DataFrame) -> DataFrame:
    """``name, repaired, how``: names (``name``) that curated titles (``name, repaired``) change, or that equal exactly one entry of a table of contents (``name``) but for spaces, case and marks."""
    from ..functions.text import norm_term

    despaced = lambda c: F.regexp_replace(norm_term(c), r"[\s­-]+", "")
    c = curated.groupBy("name").agg(F.min("repaired").alias("_curated"))
    toc = contents.select(F.col("name").alias("_toc"), despaced(F.col("name")).alias("_k")).distinct().groupBy("_k").agg(F.min("_toc").alias("_toc"), F.count("*").alias("n")).where("n = 1").drop("n")
    met = names.select("name").distinct().join(c, "name", "left").withColumn("_k", despaced(F.col("name"))).join(toc, "_k", "left")
    repaired = F.coalesce("_curated", "_toc")
    return met.where(repaired.isNotNull() & (repaired != F.col("name"))).select("name", repaired.alias("repaired"), F.when(F.col("_curated").isNotNull(), "curated").otherwise("contents").alias("how"))
