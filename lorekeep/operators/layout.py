"""Texts read from two columns in printing order: blocks and headings that were torn apart are put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The line above a block that names its kind: one line in italics.
KIND_LINE = r"_\p{Lu}[^_\n]{5,70}_[ \t]*"


def _sections(text: Column, levels: str) -> Column:
    """A text's sections, cut before every heading of these levels; text before the first is a section of its own."""
    return F.split(text, rf"(?m)(?=^#{levels}[ \t])")


def _when_set(c: Column, value: Column) -> Column:
    return F.when(c.isNotNull(), value)


def paired_blocks(docs: DataFrame, id_col: str, text_col: str, mark: str) -> DataFrame:
    """``id, text, moved``: texts whose level 4 headings stand at their own blocks again, and how many were moved.

    mark: a pattern that begins each block (``\\*\\*AC\\*\\*``). Where a heading was printed before the rest of the
    entry above, its block ends up in a later entry. The form is told by counts of blocks: a section with none, then
    one with exactly two, at most one whole section (one block) between them. The heading moves to the second block
    (before the line that names its kind; if the heading kept that line, it comes along), and what stood below it falls
    to the section above. All other counts stay as they are, and so do two blocks that begin on one line.

    A document is handled in its row, in time proportional to its length. Null texts stay null with nothing moved.
    """
    parts = docs.select(F.col(id_col).alias("id"), F.transform(_sections(F.col(text_col), "{4}"), lambda p: F.struct(p.alias("text"), F.when(F.startswith(p, F.lit("####")), F.size(F.regexp_extract_all(p, F.lit(mark), F.lit(0)))).otherwise(-1).alias("n"))).alias("s"))
    # where the second block of a section with two begins: what stands before it, and itself
    two = rf"(?s)^(.*?{mark}.*?\n)((?:{KIND_LINE}\n\s*)?[^\n]*?{mark}.*)$"
    cut = lambda p, g: F.regexp_extract(p["text"], two, g)
    parts = parts.withColumn("s", F.transform("s", lambda p: F.struct(p["text"].alias("text"), p["n"].alias("n"), F.when(p["n"] == 2, cut(p, 1)).alias("first"), F.when(p["n"] == 2, cut(p, 2)).alias("second"))))
    at = lambda i: F.get("s", i)
    whole = lambda i: at(i)["second"] != ""  # noqa: E731  has two blocks, the second on lines of its own
    parts = parts.withColumn("to", F.transform("s", lambda p, i: F.when(p["n"] == 0, F.when(whole(i + 1), i + 1).when((at(i + 1)["n"] == 1) & whole(i + 2), i + 2))))
    head = rf"(?s)^(####[^\n]*)\n*((?:{KIND_LINE}(?:\n+|$))?)(.*)$"
    taken = lambda p, g: F.regexp_extract(p["text"], head, g)
    named = lambda i: F.regexp_like(at(i)["second"], F.lit(rf"^{KIND_LINE}\n"))
    goes = F.transform(F.arrays_zip("s", "to"), lambda x: _when_set(x["to"], F.struct(F.concat(taken(x["s"], 1), F.when(named(x["to"]) | (taken(x["s"], 2) == ""), "\n\n").otherwise(F.concat(F.lit("\n\n"), F.rtrim(F.regexp_replace(taken(x["s"], 2), r"\n+$", "")), F.lit("\n\n")))).alias("head"), F.when(named(x["to"]), F.concat(taken(x["s"], 2), taken(x["s"], 3))).otherwise(taken(x["s"], 3)).alias("rest"))))
    parts = parts.withColumn("goes", goes)
    came = lambda i: F.when(F.get("to", i - 1) == i, F.get("goes", i - 1)["head"]).when(F.get("to", i - 2) == i, F.get("goes", i - 2)["head"])
    out = F.transform("s", lambda p, i: F.coalesce(F.get("goes", i)["rest"], F.concat(p["first"], came(i), p["second"]), p["text"]))
    return parts.select("id", F.array_join(out, "").alias("text"), F.coalesce(F.size(F.filter("to", lambda t: t.isNotNull())), F.lit(0)).alias("moved"))


def family_headings(docs: DataFrame, id_col: str, text_col: str, mark: str, chapter: str, least: int = 30) -> DataFrame:
    """``id, text, own, others``: texts whose level 3 headings stand directly before their first level 4 entry again.

    A block of more than ``least`` characters without a mark between such a heading and its first entry is the rest of
    another: where it names the family (the heading without a plural ending, from four letters on) it is the family's
    own and goes to the end of that first entry (counted as ``own``); else it belongs to the entry above and the
    heading moves below it (``others``). Nothing before the first match of ``chapter`` is touched, nor is anything in a
    text without one: elsewhere such headings may have text of their own. Null texts stay null.
    """
    start = F.regexp_instr(F.col(text_col), F.lit(rf"(?m)^(?:{chapter})"))
    parts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"), start.alias("_at")).withColumn("_before", F.when(F.col("_at") > 0, F.substring("_t", F.lit(1), F.col("_at") - 1)).otherwise(F.col("_t")))
    parts = parts.withColumn("s", _sections(F.when(F.col("_at") > 0, F.expr("substring(_t, _at)")).otherwise(F.when(F.col("_t").isNotNull(), "")), "{3,4}"))
    three = r"(?s)^(###[ \t][^\n]*)\n*(.*)$"
    at = lambda i: F.get("s", i)

    def kind(p: Column, i: Column) -> Column:
        block = F.regexp_extract(p, three, 2)
        title = F.regexp_replace(F.regexp_extract(p, r"^###[ \t]+([^\n]*)", 1), r"</?\w+>|\*", "")
        stem = F.regexp_replace(F.trim(title), r"(?:en|n|s)$", "")
        torn = (F.length(F.regexp_replace(block, r"^\s+|\s+$", "")) > least) & ~F.regexp_like(block, F.lit(mark)) & F.startswith(at(i + 1), F.lit("####"))
        return F.when(torn, F.when((F.length(stem) >= 4) & F.contains(block, stem), "own").otherwise("other"))

    parts = parts.withColumn("kind", F.transform("s", kind))

    def piece(p: Column, i: Column) -> Column:
        head, block = F.regexp_extract(p, three, 1), F.regexp_extract(p, three, 2)
        after = F.when(F.get("kind", i - 1) == "own", F.concat(F.regexp_replace(p, r"\s+$", ""), F.lit("\n\n"), F.regexp_replace(F.regexp_extract(at(i - 1), three, 2), r"\s+$", ""), F.lit("\n\n")))
        return F.when(F.get("kind", i) == "own", F.concat(head, F.lit("\n\n"))).when(F.get("kind", i) == "other", F.concat(block, head, F.lit("\n\n"))).otherwise(F.coalesce(after, p))

    n = lambda k: F.coalesce(F.size(F.filter("kind", lambda x: x == k)), F.lit(0))
    return parts.select("id", F.concat("_before", F.array_join(F.transform("s", piece), "")).alias("text"), n("own").alias("own"), n("other").alias("others"))
