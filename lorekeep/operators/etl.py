"""Document ETL: cleaning, HTML to Markdown, heading chunks, fragments, replacement by source, upserts."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import tokens
from ..functions.text import norm_term
from .components import _checkpointed, endless_chains

SHRINK_LIMIT, GROW_LIMIT = 0.5, 3.0


def cleaned(column):
    """Line breaks of markup become line feeds, soft hyphens go, no-break spaces and runs of spaces become one space."""
    breaks = F.regexp_replace(column, r"(?i)<br\s*/?>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(breaks, "­", ""), " ", " "), "[ \\t]+", " "))


def _composed(batches):
    """Rows (``id, text``) with their texts composed, a slice at a time."""
    for pdf in batches:
        for at in range(0, len(pdf), SLICE):
            some = pdf.iloc[at : at + SLICE]
            yield some.assign(text=some["text"].map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)))


@lru_cache
def _may_compose() -> str:
    """A class of all characters that composing may change: marks, parts of Hangul syllables, and those that aren't in that form alone."""
    odd = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (0x1100 <= c < 0x1200 or unicodedata.category(chr(c))[0] == "M" or not unicodedata.is_normalized("NFC", chr(c)))]
    starts = [c for i, c in enumerate(odd) if not i or odd[i - 1] < c - 1]
    ends = [c for i, c in enumerate(odd) if i + 1 == len(odd) or odd[i + 1] > c + 1]
    # the first is U+0300: Latin letters are passed without a look at the ranges
    return f"[\\x{{{odd[0]:x}}}-\\x{{10ffff}}&&[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]]"


#: Texts that a task's Python makes rows of at once; Spark's batches are larger.
SLICE = 256
#: What a converter puts around text that it read in pictures (a fixed value).
PICTURE_MARKS = "<!-- (?:Start|End) of picture text -->"


def composed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text``: texts with letters and their marks composed (NFC), no marks around text of pictures, no soft hyphens, spaces for no-break spaces and markup's line breaks. Nothing else changes; null stays null.

    Only texts that hold a mark or a letter that composes are sent to Python: the rest, most of a corpus, stays as it is.
    """
    odd = F.regexp_like(text_col, F.lit(_may_compose()))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(odd, F.lit(False)).alias("_odd"))
    composed = rows.where("_odd").select("id", "text")
    text = composed.mapInPandas(_composed, composed.schema).unionByName(rows.where("not _odd").select("id", "text"))
    plain = F.translate("text", "\u00a0\u00ad", " ")
    return text.select("id", F.regexp_replace(F.regexp_replace(plain, r"(?i)<br\s*/?>", " "), PICTURE_MARKS, "").alias("text"))


def merge_fragments(lines: DataFrame, least: int) -> DataFrame:
    """lines (``doc_id, pos, text``) with fragments (shorter than least characters) joined to what they follow: ``doc_id, pos, text, parts``."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    starts = lines.withColumn("start", ((F.length("text") >= least) | (F.col("pos") == F.min("pos").over(Window.partitionBy("doc_id")))).cast("int"))
    islands = starts.withColumn("island", F.sum("start").over(w))
    joined = islands.groupBy("doc_id", "island").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"), F.count("*").alias("parts"))
    return joined.select("doc_id", "pos", "text", "parts")


#: Elements whose text isn't kept, those that hold further ones, and those that part blocks.
_UNSHOWN, _ACTIVE = frozenset(("script", "style", "noscript", "iframe", "object", "template")), frozenset(("form", "button"))
_BLOCKS = frozenset("p div ul ol table section article header footer nav aside blockquote main figure figcaption dl dt dd pre hr address body html".split())
_ATTRIBUTE = re.compile(r"""\b(href|alt)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").strip() for m in _ATTRIBUTE.finditer(text)}


def markdown_of(page: str | None, base: str = "") -> str:
    """Markdown of an HTML page: active parts and their handlers dropped; headings, emphasis, lists, quotes and tables kept, images as their alternative text.

    Links keep their address if it is one of the web, or begins with "/" (base is put before it; without a base only
    the text stays); other addresses go and the text stays. Reading takes linear time, however broken the page is.
    """
    out: list[str] = []
    links: list[tuple[int, str]] = []
    row: list[str] | None = None
    rows = active = 0

    def text_since(at: int) -> str:
        found = re.sub(r"\s+", " ", "".join(out[at:])).strip()
        del out[at:]
        return found

    cell_at = -1

    def end_cell() -> None:
        nonlocal cell_at
        if cell_at >= 0 and row is not None:
            row.append(text_since(cell_at).replace("|", "\\|"))
        cell_at = -1

    def end_row() -> None:
        nonlocal row, rows
        end_cell()
        if row:
            out.append("\n| " + " | ".join(row) + " |")
            if not rows:
                out.append("\n|" + "---|" * len(row))
            rows += 1
        row = None

    for end, name, attributes in tokens(page or "", _UNSHOWN):
        if name in _ACTIVE:
            active = max(0, active + (-1 if end else 1))
        elif active:
            continue
        elif attributes is None:
            out.append(re.sub(r"\s+", " ", html.unescape(end)))
        elif name == "a":
            while links and (end or links):
                at, href = links.pop()
                if end or href:
                    text = text_since(at)
                    out.append(f"[{text}]({href})" if href and text else text)
                break
            if not end:
                href = _attributes(attributes).get("href", "")
                href = href if re.match("https?://", href, re.I) else base + href if base and href.startswith("/") else ""
                links.append((len(out), href))
        elif name == "img" and not end:
            out.append(_attributes(attributes).get("alt", ""))
        elif re.fullmatch("h[1-6]", name):
            out.append("\n\n" if end else "\n\n" + "#" * int(name[1]) + " ")
        elif name in ("b", "strong", "i", "em"):
            out.append("**" if name in ("b", "strong") else "*")
        elif name == "br":
            out.append("\n")
        elif name == "li" and not end:
            out.append("\n- ")
        elif name in ("td", "th"):
            end_cell()
            if not end:
                row = [] if row is None else row
                cell_at = len(out)
        elif name == "tr":
            end_row()
        elif name in _BLOCKS and cell_at < 0:
            if name == "table":
                end_row()
                rows = 0
            out.append("\n\n")
    end_row()
    lines = [re.sub(r"[ \t\xa0]+", " ", x).strip() for x in "".join(out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_to_markdown(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with ``markdown`` in place of the html."""
    kept = [f for f in pages.schema if f.name not in (html_col, "markdown")]

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), SLICE):
                some = pdf.iloc[at : at + SLICE]
                yield some.drop(columns="_html").assign(markdown=some["_html"].map(markdown_of))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "markdown string"])
    return pages.select(*[f.name for f in kept], F.col(html_col).alias("_html")).mapInPandas(run, schema)


#: What a chunk counts as by the breadcrumb where it stands: (pattern, level down to which it is split, category).
SplitRule = tuple[str, int, str | None]


def rule_for(breadcrumb: str, rules: tuple[SplitRule, ...], split_level: int) -> tuple[int, str | None]:
    """Level and category of the first rule whose pattern is found in a breadcrumb."""
    return next(((level, category) for pattern, level, category in rules if re.search(pattern, breadcrumb, re.I)), (split_level, None))


def chunk_headings(text: str | None, split_level: int = 2, least: int = 1, rules: tuple[SplitRule, ...] = (), rejected: list[str] | None = None) -> list[dict]:
    """Sections of a Markdown text down to a heading level: name, breadcrumb, page, category and body.

    Deeper headings stay in the body; ``<!-- page n -->`` lines carry the page forward; sections with a shorter body are
    left out, and named in rejected. Lines of bold text alone count as headings below the last one ("pseudo-headings")
    where a rule splits deeper than level 6.
    """
    out: list[dict] = []
    stack: list[tuple[int, str]] = []
    page, current = None, None

    def close() -> None:
        if current is not None:
            body = "\n".join(current.pop("lines")).strip()
            if len(body) >= least:
                out.append(current | {"body": body})
            elif rejected is not None:
                rejected.append(current["name"])

    for line in (text or "").split("\n"):
        if m := re.fullmatch(r"\s*<!--\s*page\s+(\d+)\s*-->\s*", line):
            page = int(m[1])
            continue
        m = re.match(r"(#{1,6})\s+(.*\S)", line) or re.fullmatch(r"(\*\*)([^*]+?)[.:]?\*\*\s*", line)
        level = 0 if m is None else 7 if m[1] == "**" else len(m[1])
        above = [x for x in stack if x[0] < level]
        breadcrumb = " > ".join(n for _, n in above)
        deepest, category = rule_for(breadcrumb, rules, split_level) if m else (0, None)
        if m and level <= deepest:
            close()
            stack = above
            current = {"name": m[2].strip("* "), "breadcrumb": breadcrumb, "page": page, "category": category, "lines": []}
            stack.append((level, current["name"]))
        elif current is not None:
            current["lines"].append(line)
    close()
    return out


def chunks(docs: DataFrame, id_col: str, text_col: str, split_level: int = 2, least: int = 1, rules: tuple[SplitRule, ...] = ()) -> DataFrame:
    """``id, place, name, breadcrumb, page, category, body`` of all sections; a document at a time, without shuffle."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), SLICE):
                some = pdf.iloc[at : at + SLICE]
                rows = [{"id": i, "place": n} | c for i, t in zip(some["id"], some["text"]) for n, c in enumerate(chunk_headings(t, split_level, least, rules))]
                frame = pd.DataFrame(rows, columns=["id", "place", "name", "breadcrumb", "page", "category", "body"])
                yield frame.astype({"page": "Int64"})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, place int, name string, breadcrumb string, page long, category string, body string")


def split_entries(docs: DataFrame, id_col: str, text_col: str, rules: tuple[SplitRule, ...] = (), share: float = 0.6) -> DataFrame:
    """``id, place, name, body``: the sections of each entry, or the entry itself (name null) where it has one at most or they hold less than a share of its text."""
    parts = chunks(docs, id_col, text_col, 4, 1, rules)
    sizes = parts.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("held"))
    whole = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    judged = whole.join(sizes, "id", "left").withColumn("split", F.coalesce((F.col("n") > 1) & (F.col("held") >= share * F.length("text")), F.lit(False)))
    kept = parts.join(judged.where("split").select("id"), "id", "left_semi").select("id", "place", "name", "body")
    return kept.unionByName(judged.where("not split").select("id", F.lit(0).alias("place"), F.lit(None).cast("string").alias("name"), F.col("text").alias("body")))


def import_report(docs: DataFrame, parts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``reason, n``: what an import left out: documents without text, documents without a section, headings that gave no section (their body is too short or too deep)."""
    text = F.coalesce(F.trim(text_col), F.lit(""))
    empty = docs.where(text == "").agg(F.count("*").alias("n")).select(F.lit("empty").alias("reason"), "n")
    unsplit = docs.where(text != "").join(parts.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti").agg(F.count("*").alias("n")).select(F.lit("no section").alias("reason"), "n")
    headings = docs.select(F.coalesce(F.sum(F.regexp_count(F.col(text_col), F.lit(r"(?m)^#{1,6}\s+\S"))), F.lit(0)).alias("h"))
    dropped = headings.crossJoin(parts.agg(F.count("*").alias("c"))).select(F.lit("dropped heading").alias("reason"), F.greatest(F.col("h") - F.col("c"), F.lit(0)).alias("n"))  # one row each
    return empty.unionByName(unsplit).unionByName(dropped)


def merge_sections(parts: DataFrame, same_name: str | None = None, alone: tuple[str, str] | None = None, fragment: tuple[str, str, str] | None = None) -> DataFrame:
    """``id, place, name, breadcrumb, body``: sections (``id, place, name, breadcrumb, body``) with fragments joined to the section before, their names as bold lines.

    A section is a fragment, below breadcrumbs that match a pattern as the one before does: by same_name, where it has
    the folded name of the one before; by alone (breadcrumbs, bodies), where its body doesn't begin as those that stand
    alone; by fragment (breadcrumbs, names, bodies), where its name or body begins as fragments do. The first section of
    a document is none.
    """
    w = Window.partitionBy("id").orderBy("place")
    rows = parts.withColumns({"_before": F.lag("name").over(w), "_path": F.lag("breadcrumb").over(w), "_first": F.row_number().over(w) == 1})
    inside = lambda p: F.regexp_like("breadcrumb", F.lit(p)) & F.regexp_like("_path", F.lit(p))
    joined = F.lit(False)
    if same_name is not None:
        joined = joined | inside(same_name) & (norm_term(F.col("name")) == norm_term(F.col("_before")))
    if alone is not None:
        joined = joined | inside(alone[0]) & ~F.regexp_like("body", F.lit(f"^(?:{alone[1]})"))
    if fragment is not None:
        joined = joined | inside(fragment[0]) & (F.regexp_like("name", F.lit(f"^(?:{fragment[1]})")) | F.regexp_like("body", F.lit(f"^(?:{fragment[2]})")))
    islands = rows.withColumn("_s", F.when(F.col("_first") | ~F.coalesce(joined, F.lit(False)), 1).otherwise(0)).withColumn("_i", F.sum("_s").over(w))
    text = F.when(F.col("_s") == 1, F.col("body")).otherwise(F.concat(F.lit("**"), F.col("name"), F.lit("**\n\n"), F.col("body")))
    return islands.groupBy("id", "_i").agg(F.min(F.struct("place", "name", "breadcrumb")).alias("m"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("body")).select("id", "m.place", "m.name", "m.breadcrumb", "body")


def guarded_replace(old: DataFrame, new: DataFrame, source_key: str, shrink: float = SHRINK_LIMIT, grow: float = GROW_LIMIT) -> DataFrame:
    """old with all rows of a source replaced by those of new. Raises ValueError where new has no rows, or too few or many against old."""
    before = old.where(F.col("source_key") == source_key).count()
    after = new.where(F.col("source_key") == source_key).count()
    if not after or before and not shrink * before <= after <= grow * before:
        raise ValueError(f"{source_key}: {after} rows would replace {before}")
    return old.where(F.col("source_key").isNull() | (F.col("source_key") != source_key)).unionByName(new.where(F.col("source_key") == source_key))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_empty: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows in place of those of the same keys; columns of keep_if_empty keep the old value where the new is null or empty."""
    values = [c for c in old.columns if c not in keys]
    both = old.withColumn("_o", F.lit(True)).join(new.select(*keys, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_n")), keys, "full")
    pick = lambda c: F.when(F.col("_n") & (F.nullif(F.col(f"_{c}").cast("string"), F.lit("")).isNotNull() if c in keep_if_empty else F.lit(True)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*keys, *map(pick, values))


def parent_chain(nodes: DataFrame, keep: Callable = _checkpointed) -> DataFrame:
    """``id, breadcrumb``: names from the root down to each node's parent (nodes: ``id, parent_id, name``; ids are distinct).

    A missing parent ends the chain, and one without a name isn't named. Each round joins the known parts of chains
    with one another and so doubles them: a depth of 1,000 takes ten rounds. Raises ValueError where parents form a
    cycle, which is looked for by ids alone before any name is carried.
    """
    if not endless_chains(nodes.select(F.col("id").alias("node"), F.col("parent_id").alias("up")), keep).isEmpty():
        raise ValueError("parents form a cycle")
    named = nodes.select("id", F.col("parent_id").alias("next"), F.when(F.col("name").isNull(), F.array().cast("array<string>")).otherwise(F.array("name")).alias("own"), F.array().cast("array<string>").alias("above"))
    at = keep(named, "chains")
    while not at.where("next is not null").isEmpty():
        over = at.select(F.col("id").alias("_id"), F.col("next").alias("_next"), F.col("own").alias("_own"), F.col("above").alias("_above"))
        met = at.join(over, F.col("next") == F.col("_id"), "left")
        none = F.array().cast("array<string>")
        at = keep(met.select("id", F.col("_next").alias("next"), "own", F.concat(F.coalesce("_above", none), F.coalesce("_own", none), "above").alias("above")), "chains")
    return at.select("id", F.array_join("above", " > ").alias("breadcrumb"))


def split_text(text: str | None, limit: int) -> list[str]:
    """Parts of at most limit characters, cut at paragraphs, else at lines, else at words, else anywhere; open code fences are closed and opened again."""
    out, rest, fence = [], (text or "").strip(), ""
    while rest:
        room = limit - len(fence) - 8
        if len(rest) + len(fence) <= limit:
            part, rest = rest, ""
        else:
            cut = next((at for mark in ("\n\n", "\n", " ") if (at := rest.rfind(mark, 1, room)) > 0), room)
            part, rest = rest[:cut].rstrip(), rest[cut:].lstrip("\n ")
        part = fence + part
        marks = re.findall(r"^```\w*", part, re.M)
        fence = f"{marks[-1]}\n" if len(marks) % 2 else ""
        out.append(part + ("\n```" if fence and rest else ""))
    return out


def cleaned_by_source(docs: DataFrame, rules: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """docs (``source_key, body``) with ``body`` after the regular expressions of its source, in their order; and ``changed``."""
    out = F.col("body")
    for source, pairs in rules.items():
        text = F.col("body")
        for pattern, replacement in pairs:
            text = F.regexp_replace(text, pattern, replacement)
        out = F.when(F.col("source_key") == source, text).otherwise(out)
    return docs.withColumn("_clean", out).withColumn("changed", ~F.col("_clean").eqNullSafe(F.col("body"))).withColumn("body", F.col("_clean")).drop("_clean")
