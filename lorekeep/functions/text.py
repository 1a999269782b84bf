"""Column expressions for names and terms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their base letters, by the rule of canonical decomposition.
_MARKED = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(unicodedata.normalize("NFD", chr(c))) > 1]
MARKED, BASES = ("".join(x) for x in zip(*_MARKED))
TOKEN = r"[\p{L}\p{N}]+"


def norm_term(c: Column) -> Column:
    """Trimmed, lower case, without combining marks; sharp s stays. Texts of ASCII alone have no marks to look for."""
    low = F.lower(F.trim(c))
    return F.when(F.octet_length(c) == F.length(c), low).otherwise(F.regexp_replace(F.translate(low, MARKED, BASES), r"\p{M}+", ""))


def tokens(c: Column) -> Column:
    """Normalised words of letters and digits; of null, none."""
    return F.coalesce(F.regexp_extract_all(norm_term(c), F.lit(f"({TOKEN})")), F.array().cast("array<string>"))


def sorted_letters(c: Column) -> Column:
    """Key that anagrams share; spaces don't count."""
    return F.array_join(F.array_sort(F.split(F.regexp_replace(F.lower(c), " ", ""), "")), "")


def core_name(c: Column) -> Column:
    """A name without a parenthesis of up to 40 characters at its end."""
    return F.trim(F.regexp_replace(c, r"\s*\([^()]{1,40}\)\s*$", ""))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence; a row of the table of prefixes is carried over a's letters."""
    left, right = F.split(a, ""), F.split(b, "")
    zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def row(before: Column, letter: Column) -> Column:
        cell = lambda done, j: F.concat(done, F.array(F.when(F.get(right, j) == letter, F.get(before, j) + 1).otherwise(F.greatest(F.get(before, j + 1), F.element_at(done, -1)))))
        return F.aggregate(F.sequence(F.lit(0), F.length(b) - 1), F.array(F.lit(0)), cell)

    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.element_at(F.aggregate(left, zero, row), -1))


def similarity(a: Column, b: Column) -> Column:
    """Indel similarity, 0 to 100: twice the common subsequence over both lengths."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * lcs_length(a, b) / total)


def may_reach(a: Column, b: Column, least: float) -> Column:
    """False only where the similarity is surely below least; cheap, for use before similarity()."""
    slack = (F.length(a) + F.length(b)) * (1 - least / 100)
    return (F.abs(F.length(a) - F.length(b)) <= slack) & (F.levenshtein(a, b) <= slack)


def citation(*parts: Column) -> Column:
    """Parts joined by a middle dot; nulls are left out."""
    return F.concat_ws(" · ", *parts)
