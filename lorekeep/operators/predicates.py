"""Predicates and labels of entries, sources and terms, as column expressions; and checks of parameters on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_term

#: Editions by the names that users give them.
EDITIONS = {"5.5e": "2024", "5.5": "2024", "5e": "2014", "5.0": "2014"}
LANGUAGES = {"de": "German", "en": "English", "es": "Spanish", "fr": "French", "zh": "Chinese"}

# Headings that open chapters and aren't options, breadcrumb ends that hold options, words that may be short.
CHAPTERS = (
    "species", "species descriptions", "backgrounds", "background descriptions", "feats", "feat descriptions", "classes", "class descriptions", "character classes", "subclasses", "spells", "spell descriptions",
    "magic items", "items", "equipment", "monsters", "creatures", "character creation", "character origins", "origin feats", "general feats", "fighting style feats", "epic boon feats",
)
OPTION_PARENTS = {
    "species": ("Beschreibungen der Spezies", "Species Descriptions", "Character Species", "Species", "Races"),
    "background": ("Beschreibungen der Hintergründe", "Background", "Backgrounds", "Background Descriptions"),
    "feat": ("Origin Feats", "General Feats", "Fighting Style Feats", "Epic Boon Feats", "Dragonmark Feats", "Epic Boon Feat", "Dark Gifts", "Herkunftstalente", "Allgemeine Talente", "Kampfstil-Talente", "Epische-Gabe-Talente"),
}
SHORT_WORDS = ("der", "die", "das", "des", "dem", "den", "im", "am", "zu", "zum", "zur", "vom", "von", "und", "mit", "auf", "aus")
TERM_CHARS, TERM_WORDS = 60, 8
#: First priorities of the bands of sources, ascending; a band ends where the next begins (fixed values).
BANDS = (10, 20, 40, 60, 70, 80, 100)
REVISIONS = ("errata", "ruling")


def edition_name(asked: str) -> str:
    """The edition that a name stands for."""
    name = asked.strip()
    return EDITIONS.get(name.lower(), name)


def edition(asked: str | None, known: set[str]) -> str | None:
    """The edition that a name stands for; None means all. Raises ValueError for one that isn't known."""
    if asked is None:
        return None
    name = edition_name(asked)
    if name not in known:
        raise ValueError(f"edition {asked!r}; known are {', '.join(sorted(known))}")
    return name


def checked(what: str, asked: str | None, known: set) -> str | None:
    """asked, if it is None or known. Raises ValueError otherwise."""
    if asked is not None and asked not in known:
        raise ValueError(f"{what} {asked!r}; known are {', '.join(sorted(map(str, known)))}")
    return asked


def edition_of(asked: Column) -> Column:
    """The same for a column, without the check."""
    names = F.create_map(*[F.lit(x) for pair in EDITIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(asked))), F.trim(asked))


def below(path: Column, body: Column, wanted: Column) -> Column:
    """Whether an entry stands at a breadcrumb: by its path, or where that is null by its body's first line."""
    return F.when(path.isNotNull(), path == wanted).otherwise(F.startswith(body, F.concat(F.lit("*Context: "), wanted, F.lit("*"))))


def path_of(body: Column, own_line: bool = False) -> Column:
    """The breadcrumb that a body states: at its very beginning, or (the stricter form) as a line of its own anywhere."""
    found = F.regexp_extract(body, r"(?m)^\*Context:\s*(.+?)\*\s*$" if own_line else r"^\*Context:\s*(.+?)\*", 1)
    return F.nullif(F.trim(found), F.lit(""))


def is_option(path: Column, category: str) -> Column:
    """Whether an entry can be chosen: its breadcrumb is missing or ends in a heading that holds options of the category."""
    last = F.trim(F.substring_index(path, " > ", -1))
    return path.isNull() | (path == "") | F.lower(last).isin(*[p.lower() for p in OPTION_PARENTS[category]])


def is_chapter(name: Column) -> Column:
    """Whether a name is but a chapter's heading."""
    n = F.lower(F.trim(name))
    return F.coalesce(n.isin(*CHAPTERS) | F.regexp_like(n, F.lit(r"^(?:chapter|ch\.)\s*[0-9]+\b")), F.lit(False))


def implausible(scores: Column, saves: Column) -> Column:
    """Why a record's figures (maps of ability to number) can't be: "score" beyond 1 to 30, "save" more than 9 from its score's modifier; else null."""
    bad = F.exists(F.map_values(scores), lambda v: v.isNull() | ~v.between(1, 30))
    far = F.exists(F.map_entries(saves), lambda e: F.coalesce(F.abs(e["value"] - F.floor((F.try_element_at(scores, e["key"]) - 10) / 2)) > 9, F.lit(False)))
    return F.when(bad, "score").when(far, "save")


def is_clean(name: Column) -> Column:
    """Whether a name has no fragment of one or two letters, small words and figures apart."""
    words = F.transform(F.split(F.replace(name, F.lit("-"), F.lit(" ")), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[.,;:()'’`]+|[.,;:()'’`]+$", "")))
    fine = lambda w: (w == "") | (F.length(w) > 2) | w.isin(*SHORT_WORDS) | F.regexp_like(w, F.lit("[0-9]"))
    return F.coalesce((F.length(name) > 0) & F.forall(words, fine), F.lit(False))


def is_term(text: Column) -> Column:
    """Whether a text is short enough to be a term rather than prose."""
    t = F.trim(text)
    return F.coalesce((t != "") & (F.length(t) <= TERM_CHARS) & (F.size(F.split(t, r"\s+")) <= TERM_WORDS), F.lit(False))


def is_derived(origin: Column, marks: tuple[str, ...]) -> Column:
    """Whether an origin holds one of the marks that derived rows carry."""
    return F.coalesce(F.greatest(*[F.contains(origin, F.lit(m)) for m in (*marks, marks[0])]), F.lit(False))


def language_name(code: Column) -> Column:
    """A language's name, its code where that isn't known."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), code)


def rules_label(code: Column, edition_name: Column) -> Column:
    """Language and edition of a source as one label."""
    return F.concat_ws(", ", language_name(code), F.concat(edition_name, F.lit(" rules")))


def band(lang: Column, edition_name: Column, origin: Column, kind: Column, licence: Column) -> Column:
    """The first priority of the band where a source of its class is expected."""
    free = F.startswith(F.upper(F.coalesce(licence, F.lit(""))), F.lit("CC-BY"))
    local = F.when(~edition_name.eqNullSafe(F.lit("2024")), 80).when((kind == "setting") | free, 20).otherwise(10)
    return F.when(kind.isin(*REVISIONS), 70).when(lang == "de", local).when(origin == "open", 60).otherwise(40)


def band_end(start: Column) -> Column:
    """The first priority that is beyond a band."""
    nexts = F.create_map(*[F.lit(x) for pair in zip(BANDS, BANDS[1:]) for x in pair])
    return F.coalesce(F.try_element_at(nexts, start), start + 10)


def out_of_band(sources: DataFrame) -> DataFrame:
    """``source_key, priority, expected``: sources (``source_key, priority, lang, edition, origin, kind, licence``) whose priority lies outside the band of their class."""
    placed = sources.withColumn("expected", band(*map(F.col, ("lang", "edition", "origin", "kind", "licence"))))
    return placed.where(~((F.col("priority") >= F.col("expected")) & (F.col("priority") < band_end(F.col("expected"))))).select("source_key", "priority", "expected")


def edition_from(category: Column, released: Column) -> Column:
    """Edition of a book by the name of its category, else 2014 where it was released before 2024; null where that leaves it open."""
    c = F.lower(F.coalesce(category, F.lit("")))
    year = F.nullif(F.regexp_extract(released, r"\b((?:19|20)[0-9]{2})\b", 1), F.lit("")).cast("int")
    return F.when(F.contains(c, F.lit("5.5e")) | F.contains(c, F.lit("2024")), "2024").when(F.contains(c, F.lit("2014")) | F.startswith(c, F.lit("5e ")) | F.contains(c, F.lit(" 5e ")), "2014").when(year < 2024, "2014")


def book_config(books: DataFrame, overrides: DataFrame) -> DataFrame:
    """books (``book_id`` and values) with the curated value in place of each that overrides (``book_id`` and some of the values) have."""
    values = [c for c in overrides.columns if c != "book_id"]
    curated = overrides.select("book_id", *[F.col(c).alias(f"_{c}") for c in values])
    met = books.join(curated, "book_id", "left")
    return met.select(*[F.coalesce(f"_{c}", c).alias(c) if c in values else F.col(c) for c in books.columns])


def catalogue_decisions(owned: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``book_id, decision, edition``: what becomes of each owned id by the catalogue (``book_id, title, category``).

    "unknown" ids, "premade" packs and "playtest" books are skipped; adventures are taken and marked "setting"; the
    rest are "rules". An edition that isn't clear stays null.
    """
    met = owned.select("book_id").distinct().join(catalogue.withColumn("_known", F.lit(True)), "book_id", "left")
    c = F.lower(F.coalesce("category", F.lit("")))
    has = lambda *words: F.greatest(*[F.contains(c, F.lit(w)) for w in (*words, words[0])])
    decision = F.when(F.col("_known").isNull(), "unknown").when(has("premade", "pregen"), "premade").when(has("playtest"), "playtest").when(has("adventure", "campaign"), "setting").otherwise("rules")
    return met.select("book_id", decision.alias("decision"), F.when(decision.isin("setting", "rules"), edition_from(F.col("category"), F.lit(None).cast("string"))).alias("edition"))


def document_key(record: Column) -> Column:
    """Key of the document of a JSON record: ``document`` is an object with ``key``, or the key itself."""
    return F.coalesce(F.get_json_object(record, "$.document.key"), F.get_json_object(record, "$.document"))


def relevance(score: Column) -> Column:
    """Whether a hit's name fits the question, or its text alone mentions it."""
    return F.when(score >= 90, "name").otherwise("text only")


def thread_title(question: Column, limit: int = 100, empty: str = "Question") -> Column:
    """A question in one line of at most limit characters, cut with an ellipsis."""
    one = F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", " "))
    one = F.when(one == "", empty).otherwise(one)
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.substring(one, 1, limit - 1), F.lit("…")))


def marked_kinds(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """hits (``query_id, source_key``) with ``kind`` of their source, and ``of_kind``: how many hits of the query are of that kind (null: none of any)."""
    from pyspark.sql import Window

    met = hits.join(sources.select("source_key", "kind"), "source_key", "left")
    return met.withColumn("of_kind", F.when(F.col("kind").isNotNull(), F.count("*").over(Window.partitionBy("query_id", "kind"))))


def untranslated(hits: DataFrame) -> DataFrame:
    """``query_id, n, example``: of each query's hits (``query_id, name, shown``), how many are shown under their original name, and the first of these."""
    return hits.where(F.col("shown").eqNullSafe(F.col("name"))).groupBy("query_id").agg(F.count("*").alias("n"), F.min("name").alias("example"))


def entry_by_id(entries: DataFrame, sources: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked_id, found, entries' columns``: entries by id (asked: ``id, category``) with their source; found is "ok", "missing", or "other category"."""
    met = asked.select(F.col("id").alias("asked_id"), F.col("category").alias("asked_category")).join(entries.join(sources, "source_key", "left"), F.col("asked_id") == F.col("id"), "left")
    found = F.when(F.col("id").isNull(), "missing").when(F.col("asked_category").isNotNull() & (F.col("asked_category") != F.col("category")), "other category").otherwise("ok")
    return met.withColumn("found", found)


def of_category(entries: DataFrame, sources: DataFrame, category, edition_name: str = "2024") -> DataFrame:
    """``place, id, name, source_key, priority``: entries of a category and edition, revisions left out, by priority of their source and id."""
    from pyspark.sql import Window

    met = entries.where((F.col("category") == category) & (F.col("edition") == edition_name)).join(sources.where("kind is null"), "source_key")
    order = Window.partitionBy("source_key").orderBy("id")
    return met.withColumn("place", F.row_number().over(order)).select("place", "id", "name", "source_key", F.coalesce("priority", F.lit(100)).alias("priority"))
