"""Documents of named cells: fragments are joined, fields are read by their types, sections are taken apart, and nothing is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a sentence begins that is no head of a paragraph (fixed values).
SENTENCE_STARTS = (
    "You ", "Your", "The ", "This ", "That ", "If ", "When", "While ", "Once ", "As ", "At ", "On ", "In ", "To ", "For ", "A ", "An ", "It ", "They ", "Each ", "Whenever ", "Immediately ", "After ", "Before ", "Choose ",
)

#: Words of a checked and of an empty box.
CHECKED, EMPTY = ("yes", "true", "on", "x", "1", "•"), ("no", "false", "off", "0")

FORMS = ("text", "whole", "number", "flag", "list")

#: A feature's line: a star, its name, a dot, its source and maybe a page of at most nine digits.
FEATURE = r"[ \t]*\*[ \t]*+([^\n•]*[^\n•\s])[ \t]*•[ \t]*([^\s•]+)(?:[ \t]+([0-9]{1,9}))?[ \t]*"
#: A line with all below it up to the next feature's line. Nothing is tried twice: what ``.*`` leaves is a line's end.
PIECE = rf"(?m).*(?:(?s:.)(?!^{FEATURE}$).*)*+(?s:.)?+"
SECTION = r"===[ \t]*+([^=\n]*[^=\s])[ \t]*==="
#: The characters of \s in a pattern.
BLANKS = " \t\n\x0b\f\r"


def joined(fragments: Column) -> Column:
    """Fragments of one text as one: a blank where neither side has white space, a blank line where a sentence ends and a short head with a full stop follows. No fragment is changed; empty and null ones count for nothing."""
    kept = F.filter(fragments, lambda f: f != "")

    def with_gap(f: Column, i: Column) -> Column:
        before = F.get(kept, i - 1)
        head = F.regexp_like(f, F.lit(r"^[A-Z][^.!?:\n]{1,42}\.\s")) & ~F.regexp_like(f, F.lit("^(?:" + "|".join(SENTENCE_STARTS) + ")"))
        gap = F.when(before.isNull() | F.regexp_like(before, F.lit(r"\s$")) | F.regexp_like(f, F.lit(r"^\s")), "").when(F.regexp_like(before, F.lit(r"[.!?]$")) & head, "\n\n").otherwise(" ")
        return F.concat(gap, f)

    return F.array_join(F.transform(kept, with_gap), "")


def typed_fields(cells: DataFrame, field_map: DataFrame) -> DataFrame:
    """``doc_id, path, form, text, whole, number, flag, items, names``: cells (``doc_id, name, value``) read by a map (``name, path, form, place``).

    Cells of one path of form "text" are joined in order of place, name and value. "whole" and "number" allow commas
    between thousands, "flag" the words of a box, "list" parts between commas, semicolons and line ends. ``names`` are the
    cells that a row came from. What the map doesn't name, what doesn't read as its form, and several cells of one path
    of another form than "text" come out one by one, unchanged, as form "rest" with path ``rest.<name>``: every cell is
    in one row. Null and blank values are rest too, except as fragments beside others. Rows without doc_id or name are
    left out. A map that gives a name twice, or a path two forms, or an unknown form, is an error.
    """
    m = field_map.agg(F.count("*") - F.countDistinct("name"), F.countDistinct("path", "form") - F.countDistinct("path"), F.count_if(~F.coalesce(F.col("form").isin(*FORMS), F.lit(False)))).first()
    if any(m):
        raise ValueError("a name or path is mapped twice, or a form is unknown")
    met = cells.where("doc_id is not null and name is not null").select("doc_id", "name", "value").join(field_map.select("name", "path", "form", "place"), "name", "left")
    met = met.withColumn("form", F.coalesce("form", F.lit("rest"))).withColumn("path", F.coalesce("path", F.concat(F.lit("rest."), "name")))
    # a document has few cells of one path
    one = met.groupBy("doc_id", "path", "form").agg(F.array_sort(F.collect_list(F.struct("place", "name", "value"))).alias("c"))
    single = F.when(F.size("c") == 1, F.trim(F.col("c")[0]["value"]))
    one = one.withColumn("_text", joined(F.transform("c", lambda x: x["value"]))).withColumn("_v", single).withColumn("_n", F.regexp_replace("_v", r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", ""))
    form = lambda name, c: F.when(F.col("form") == name, c)
    word = F.lower("_v")
    items = F.filter(F.transform(F.split("_v", "[,;\n]"), lambda x: F.trim(x)), lambda x: x != "")
    one = one.select(
        "doc_id", "path", "form", "c", form("text", F.when(F.trim("_text") != "", F.col("_text"))).alias("text"), form("whole", F.when(F.regexp_like("_n", F.lit("^[+-]?[0-9]{1,18}$")), F.col("_n").try_cast("long"))).alias("whole"),
        form("number", F.when(F.regexp_like("_n", F.lit(r"^[+-]?[0-9]{1,300}(?:\.[0-9]{1,300})?$")), F.col("_n").try_cast("double"))).alias("number"), form("flag", F.when(word.isin(*CHECKED), True).when(word.isin(*EMPTY), False)).alias("flag"), form("list", F.when(F.size(items) > 0, items)).alias("items"),
    )
    read = F.coalesce(F.col("text").isNotNull() | F.col("whole").isNotNull() | F.col("number").isNotNull() | F.col("flag").isNotNull() | F.col("items").isNotNull(), F.lit(False))
    row = lambda path, f, text, names: F.struct(path.alias("path"), f.alias("form"), text.alias("text"), *[F.when(f != "rest", F.col(c)).alias(c) for c in ("whole", "number", "flag", "items")], names.alias("names"))
    whole = F.array(row(F.col("path"), F.col("form"), F.col("text"), F.transform("c", lambda x: x["name"])))
    rest = F.transform("c", lambda x: row(F.concat(F.lit("rest."), x["name"]), F.lit("rest"), x["value"], F.array(x["name"])))
    return one.select("doc_id", F.inline(F.when(read, whole).otherwise(rest)))


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, section, place, name, source, page, actions, body``: the features of texts in sections (``=== TITLE ===``).

    A feature begins at its line (FEATURE); lines with a bar below it are its actions, all others its body, whose blank
    lines stay (at most one in a row). Text before the first feature of a section, or before the first section (title
    ""), is a row without a name, so that no line is lost but blank ones. place counts the rows of a text. Null and blank
    texts have none. A text is handled in its row, in time proportional to its length.
    """
    t = F.col(text_col)
    titles = F.concat(F.array(F.lit("")), F.regexp_extract_all(t, F.lit(SECTION), F.lit(1)))
    cut = F.flatten(F.zip_with(F.split(t, SECTION), titles, lambda b, title: F.transform(F.regexp_extract_all(b, F.lit(PIECE), F.lit(0)), lambda p: F.struct(title.alias("section"), p.alias("p")))))
    # exploded as it is cut: of a named column, Spark would ask first whether it is empty, and cut each text twice
    parts = docs.select(F.col(id_col).alias("id"), F.posexplode(F.filter(cut, lambda x: F.ltrim(x["p"], F.lit(BLANKS)) != "")).alias("place", "x")).select("id", "place", "x.section", "x.p")
    # one match of a piece gives its head and its lines; the mark tells whether there was one, as no head begins with it
    lines = F.split(F.regexp_replace("p", rf"^{FEATURE}(?:\n|$)", "•\n$1\n$2\n$3\n"), "\n")
    read = parts.select("id", "section", "place", "p", lines.alias("l")).withColumn("head", F.when(~F.startswith("p", F.lit("•")) & (F.col("l")[0] == "•"), F.slice("l", 2, 3)))
    read = read.select("id", "section", "place", F.col("head")[0].alias("name"), F.col("head")[1].alias("source"), F.nullif(F.col("head")[2], F.lit("")).try_cast("int").alias("page"), F.when(F.col("head").isNotNull(), F.slice("l", F.lit(5), F.size("l"))).otherwise(F.col("l")).alias("lines"))
    bar = lambda line: F.startswith(F.ltrim(line), F.lit("|"))
    named = F.col("name").isNotNull()
    actions = F.transform(F.when(named, F.filter("lines", bar)).otherwise(F.array().cast("array<string>")), lambda line: F.rtrim(F.ltrim(line, F.lit(BLANKS + "|")), F.lit(BLANKS)))
    body = F.trim(F.array_join(F.when(named, F.filter("lines", lambda line: ~bar(line))).otherwise(F.col("lines")), "\n"), F.lit(BLANKS))
    return read.select("id", "section", "place", "name", "source", "page", actions.alias("actions"), F.regexp_replace(body, r"\n(?:[ \t]*\n){2,}+", "\n\n").alias("body"))
