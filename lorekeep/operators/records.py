"""Nested records of many kinds, whose keys vary, as Markdown by a table of formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A value's forms: one value with its unit; a flag, whose label stands alone where it is true; values or names of a list;
#: keys and values of an object; named paragraphs.
FORMS = ("value", "flag", "list", "pairs", "paragraphs")


def _text(v: Column) -> Column:
    """A scalar as text; null for anything else and for blank text."""
    t = F.trim(F.try_variant_get(v, "$", "string"))
    return F.when((t != "") & ~F.schema_of_variant(v).rlike("^(?:OBJECT|ARRAY|BOOLEAN)"), t)


def _shown(form: str, label: str, unit: str | None, v: Column) -> Column:
    """A field's line from its variant value, null where it has none of the form; a scalar stands for a list, an object or a paragraph."""
    after = lambda t: F.concat(t, F.lit(unit or ""))
    if form == "flag":
        return F.when(F.try_variant_get(v, "$", "boolean"), F.lit(f"**{label}**"))
    named = lambda x: F.coalesce(_text(x), F.trim(F.try_variant_get(x, "$.name", "string")))
    if form == "list":
        many = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), named), lambda t: t.isNotNull() & (t != ""))
        text = F.when(F.size(many) > 0, F.array_join(many, ", "))
    elif form == "pairs":
        entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        pairs = F.array_sort(F.filter(F.transform(entries, lambda e: F.concat(e["key"], F.lit(" "), after(_text(e["value"])))), lambda t: t.isNotNull()))
        text = F.when(F.size(pairs) > 0, F.array_join(pairs, ", "))
        return F.concat(F.lit(f"**{label}:** "), F.coalesce(text, after(_text(v))))
    elif form == "paragraphs":
        part = lambda x: F.concat(F.lit("***"), F.trim(F.try_variant_get(x, "$.name", "string")), F.lit(".*** "), F.coalesce(F.trim(F.try_variant_get(x, "$.desc", "string")), F.lit("")))
        many = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(F.rtrim(part(x)), _text(x))), lambda t: t.isNotNull())
        text = F.coalesce(F.when(F.size(many) > 0, F.array_join(many, "\n\n")), _text(v))
        return F.concat(F.lit(f"\n## {label}\n\n"), text)
    else:
        text = None
    whole = _text(v) if text is None else F.coalesce(text, _text(v))
    return F.concat(F.lit(f"**{label}:** "), after(whole))


def formatted_records(records: DataFrame, formats: DataFrame) -> DataFrame:
    """``id, kind, body, problem``: records (``id, kind, record``, JSON text) as Markdown.

    formats: ``kind, place, label, path, form, unit``, a table of one row for each field of a kind, at most a few hundred
    in all; path is a JSON path (``$.speed.walk``), form one of FORMS. A kind's lines stand in order of place; fields that
    a record lacks, or holds as null, blank or in a form that doesn't fit, leave no line. problem is "unreadable" for what
    isn't JSON (null text too), "unknown kind" for a kind without formats, else null; such records have an empty body.

    Records are parsed once as VARIANT, so keys may differ from record to record without a schema.
    """
    kinds: dict[str, list] = {}
    for r in sorted(formats.collect(), key=lambda r: (r["kind"], r["place"], r["label"])):
        if r["form"] not in FORMS:
            raise ValueError(f"unknown form {r['form']}")
        kinds.setdefault(r["kind"], []).append(r)
    read = records.select("id", "kind", F.try_parse_json("record").alias("_v"))
    body = F.when(F.lit(False), F.lit(""))
    for kind, fields in kinds.items():
        lines = [_shown(r["form"], r["label"], r["unit"], F.try_variant_get("_v", r["path"], "variant")) for r in fields]
        body = body.when(F.col("kind") == kind, F.ltrim(F.regexp_replace(F.concat_ws("\n", *lines), r"^\n+", "")))
    known = F.coalesce(F.col("kind").isin(*kinds), F.lit(False)) if kinds else F.lit(False)
    problem = F.when(F.col("_v").isNull(), "unreadable").when(~known, "unknown kind")
    return read.select("id", "kind", F.when(problem.isNull(), F.coalesce(body, F.lit(""))).otherwise("").alias("body"), problem.alias("problem"))
