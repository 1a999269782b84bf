"""Option lists, sections and their relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import core_name, norm_term


def option_list(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """``category, key, lead_id, name, sources``: one row per category and folded name, led by the best source, sorted by name when shown."""
    rows = entries.join(sources, "source_key").select("category", norm_term(core_name(F.col("name"))).alias("key"), "id", "name", "source_key", F.coalesce("priority", F.lit(100)).alias("priority")).where("key <> ''")
    lead = rows.groupBy("category", "key").agg(F.min(F.struct("priority", "id", "name")).alias("m"), F.array_join(F.array_sort(F.collect_set("source_key")), ",").alias("sources"))
    return lead.select("category", "key", F.col("m.id").alias("lead_id"), F.col("m.name").alias("name"), "sources")


def source_buckets(sources: DataFrame) -> DataFrame:
    """``source_key, bucket``: revisions, main sources and the rest, by kind and priority."""
    return sources.select("source_key", F.when(F.col("kind").isNotNull(), "revision").when(F.col("priority") < 10, "main").otherwise("other").alias("bucket"))


def with_children(sections: DataFrame) -> DataFrame:
    """sections (``id, path, name, body``) with ``whole``: the body, and those of the direct children in order of id. All children of a section meet in one row, as the text that it shows does; sections with more than a row can hold don't fit this form."""
    own = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws(" > ", "path", "name"))
    children = sections.select(F.col("path").alias("_parent"), F.struct("id", F.concat(F.lit("## "), F.col("name"), F.lit("\n"), F.col("body")).alias("t")).alias("c")).where("_parent <> ''").groupBy("_parent").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x["t"]), "\n").alias("below"))
    return sections.withColumn("_own", own).join(children, F.col("_own") == F.col("_parent"), "left").select("id", "path", "name", F.concat_ws("\n", "body", "below").alias("whole"))


def quoted_relations(entries: DataFrame) -> DataFrame:
    """``id, related_id``: entries that a text names after "See also" in quotes, where the name is unambiguous."""
    quoted = entries.select("id", F.explode(F.regexp_extract_all("body", F.lit(r'(?i)see also[^.\n]*?"([^"\n]+)"'))).alias("q")).select("id", norm_term(F.col("q")).alias("key")).distinct()
    named = entries.select(norm_term(F.col("name")).alias("key"), F.col("id").alias("related_id")).groupBy("key").agg(F.min("related_id").alias("related_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    return quoted.join(named, "key").where("id <> related_id").select("id", "related_id")


def sub_headings(entries: DataFrame) -> DataFrame:
    """``id, key``: folded names of the headings and bold leads inside a body."""
    found = F.concat(F.regexp_extract_all("body", F.lit(r"(?m)^#{2,6}\s+(.+?)\s*$")), F.regexp_extract_all("body", F.lit(r"(?m)^\*\*([^*\n]+?)[.:]?\*\*")))
    return entries.select("id", F.explode(F.array_distinct(found)).alias("h")).select("id", norm_term(F.col("h")).alias("key")).where("key <> ''").distinct()


def table_cells(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, row, column, value``: cells of the Markdown table rows of a text; the first row of a table names the columns."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).where(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^[\s|:-]+$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    w = Window.partitionBy("id").orderBy("pos")
    # rows of one table follow one another but for the rule below its head
    marked = lines.withColumn("new", (F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(-9)) > 2).cast("int")).withColumn("t", F.sum("new").over(w))
    v = Window.partitionBy("id", "t").orderBy("pos")
    rows = marked.select("id", "t", "pos", cells.alias("cells"), F.row_number().over(v).alias("row"), F.first(cells).over(v).alias("head")).where("row > 1")
    return rows.select("id", "t", (F.col("row") - 1).alias("row"), F.explode(F.arrays_zip(F.col("head").alias("c"), F.col("cells").alias("v"))).alias("x")).select("id", F.col("t").cast("int").alias("table"), "row", F.col("x.c").alias("column"), F.col("x.v").alias("value"))


def level_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, level, column, value``: cells of the table of levels of each text: of the tables whose first column holds whole numbers from 1 to 20 alone, the longest, the first of equals.

    A text's tables are told apart within its row: nothing is shuffled, joined or sent to the driver.
    """
    lines = F.transform(F.split(text_col, "\n"), lambda line, i: F.struct(i.alias("pos"), line.alias("line")))
    rows = docs.select(F.col(id_col).alias("id"), F.filter(lines, lambda r: r["line"].rlike(r"^\s*\|.*\|\s*$") & ~r["line"].rlike(r"^[\s|:-]+$")).alias("_r"))
    at = F.when(F.size("_r") > 0, F.sequence(F.lit(1), F.size("_r"))).otherwise(F.array().cast("array<int>"))
    # rows of one table follow one another but for the rule below its head
    begins = rows.withColumn("_s", F.filter(at, lambda i: (i == 1) | (F.get("_r", i - 1)["pos"] - F.get("_r", i - 2)["pos"] > 2)))
    below = F.transform("_s", lambda s, j: F.struct(F.get("_r", s - 1)["line"].alias("head"), F.slice("_r", s + 1, F.coalesce(F.get("_s", j + 1), F.size("_r") + 1) - s - 1)["line"].alias("lines")))
    name = lambda line: F.trim(F.split_part(line, F.lit("|"), F.lit(2)))
    level = lambda line: F.when(F.regexp_like(name(line), F.lit("^[0-9]{1,2}$")), name(line).cast("int"))
    good = F.filter(below, lambda t: (F.size(t["lines"]) > 0) & F.forall(t["lines"], lambda line: F.coalesce(level(line).between(1, 20), F.lit(False))))
    best = begins.select("id", good.alias("_t")).select("id", F.get("_t", F.array_min(F.transform("_t", lambda t, i: F.struct(-F.size(t["lines"]), i.alias("i"))))["i"]).alias("t"))
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    each = best.select("id", F.col("t.head").alias("head"), F.explode("t.lines").alias("line"))
    zipped = F.arrays_zip(cells(F.col("head")).alias("c"), cells(F.col("line")).alias("v"))
    return each.select("id", level(F.col("line")).alias("level"), F.explode(zipped).alias("x")).select("id", "level", F.col("x.c").alias("column"), F.col("x.v").alias("value"))
