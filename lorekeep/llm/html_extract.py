"""HTML extraction by tag-path ratios.

A page is cut into blocks of text; each lies at the end of a path of tags from the root. Text length and
punctuation are summed by path and divided by the number of its blocks: prose has long, punctuated blocks, menus
have many short ones. Both ratios are smoothed over neighbouring blocks, fused, and the paths above a share of the
best are content. The element that holds the content is then read whole, without the parts that its tags or roles
name as something else.

Words in classes and ids are priors: a path below an element that they mark has its ratio lowered, never set to
nothing, so prose that nothing on the page rivals is content whatever its classes say.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import tokens

#: Elements whose text is never shown.
UNSHOWN = frozenset("script style noscript template iframe svg math textarea select object title".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，！？、]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags whose opening ends an open one of the given names, and how far out that reaches.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements and roles that hold no article. Forms, fieldsets and headers are only marked: pages stand in them whole.
ASIDE_TAGS, MARKED_TAGS = frozenset("nav footer aside head dialog menu button".split()), frozenset("form fieldset header".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Names of parts that are no article: a class or id is one if it ends with it, or begins with it and ends as a holder.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay newsletter subscribe signup "
    "sidebar widget widgets related recommended share sharing social breadcrumb breadcrumbs pagination pager menu nav navbar navigation topbar toolbar masthead header footer "
    "comment comments respond reply replies disqus login banner notice alert side aside search skip legal copyright".split()
)
HOLDERS = frozenset(
    "area articles bar block body box buttons card column container content feed foot form group head holder inner item items layer left links list menu message module outer "
    "overlay panel popup pane posts region results right row section sidebar slot stories strip top bottom text unit widget wrap wrapper".split()
)
#: Words that make a class the state of something else, or a part of the article.
STATES_BEFORE, STATES_AFTER = frozenset("has no not with without is hide show show hides shows js".split()), frozenset("open opened closed collapsed enabled disabled free active visible hidden on off less layout".split())
MAIN_TAGS, MAIN_WORDS = frozenset(("article", "main")), frozenset("article main content post entry story".split())
#: What a mark leaves of a ratio, and the share of a page's prose that a marked element must hold, with the title, to be a page's frame.
MARKED, FRAME = 0.1, 0.9
#: Characters from which a block with punctuation counts as prose, and the share of it that the parts named as main must hold.
PROSE, MAIN_SHARE = 40, 0.5
#: Share of the best path's score from which a path is content, and weight of a block's neighbours in smoothing.
SHARE, NEIGHBOUR = 0.25, 0.25


@lru_cache(maxsize=10_000)
def reading(name: str) -> tuple[bool, bool]:
    """Whether one class or id marks a part that is no article, and whether it names the article."""
    words = [w for w in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w and not w.isdigit()]
    if not words or words[0] in STATES_BEFORE or words[-1] in STATES_AFTER:
        return False, False
    named = words[-1] in ASIDE_WORDS or words[0] in ASIDE_WORDS and words[-1] in HOLDERS
    of_article = words[-1] in ("header", "banner", "side") and bool(MAIN_WORDS & set(words[:-1]))
    return named and not of_article, words[-1] in MAIN_WORDS and not named


class Element:
    """An open or closed element; elements are numbered in page order and hold those up to ``last``."""

    __slots__ = ("tag", "parent", "path", "aside", "marked", "main", "number", "last")

    def __init__(self, tag: str, parent: Element | None, attributes: str, number: int, paths: dict[tuple[int, str, bool], int]):
        self.tag, self.parent, self.number, self.last = tag, parent, number, number
        aside, main, label, named = tag in ASIDE_TAGS, tag in MAIN_TAGS, tag, False
        inside = parent is not None and parent.main
        if attributes:
            for name, *values in ATTRIBUTE.findall(attributes):
                value, name = values[0] or values[1] or values[2], name.lower()
                if name == "role":
                    aside, main = aside or value.lower() in ASIDE_ROLES, main or value.lower() in ("main", "article")
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    aside = True
                elif name != "aria-hidden" and tag not in ("html", "body"):
                    read = [reading(x) for x in value.split()]
                    named, main = named or any(r[0] for r in read), main or any(r[1] for r in read)
                    label += "." + value.lower().replace(" ", ".") if name == "class" else ""
        self.aside = aside or (parent is not None and parent.aside)
        self.marked = named and tag not in MAIN_TAGS or tag in MARKED_TAGS and not (tag == "header" and inside)
        self.main = inside or main
        self.path = paths.setdefault((parent.path if parent is not None else -1, label, self.marked), len(paths))


Block = tuple[Element, str, int]


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order: the element that holds them, the text, and characters of it in links."""
    paths: dict[tuple[int, str, bool], int] = {}
    root = Element("", None, "", 0, paths)
    at, out, text, linked, in_link, made = root, [], [], 0, 0, 0
    opened: dict[str, list[Element]] = {}

    def close() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((at, joined, min(linked, len(joined))))
            text.clear()
        linked = 0

    def leave(to: Element) -> None:
        """Close the open elements below to."""
        nonlocal at
        while at is not to:
            at.last = made
            opened[at.tag].pop()
            at = at.parent

    def ended_by(name: str) -> Element | None:
        """The open element that a new one of this name ends: the innermost within the nearest limit, of rows the outermost."""
        ended, limits = ENDS[name]
        limit = max((opened[t][-1].number for t in limits if opened.get(t)), default=0)
        within = []
        for t in ended:
            held = opened.get(t)
            if held and held[-1].number > limit:
                within.append(held[bisect_right(held, limit, key=lambda e: e.number)] if name == "tr" else held[-1])
        return (min if name == "tr" else max)(within, key=lambda e: e.number, default=None)

    for end, name, attributes in tokens(page, UNSHOWN):
        if attributes is None:
            text.append(end)
            if in_link:
                linked += len(end)
        elif name == "br":
            text.append(" ")
        elif name in INLINE:
            if name == "a":
                in_link = 0 if end else 1
        elif end:
            close()
            if opened.get(name):
                leave(opened[name][-1].parent)
            in_link = 0
        else:
            close()
            if at.tag == "p" or at.tag in HEADINGS and name in HEADINGS:
                leave(at.parent)
            if name in ENDS and (gone := ended_by(name)) is not None:
                leave(gone.parent)
            if name not in VOID and not attributes.endswith("/"):
                made += 1
                at = Element(name, at, attributes, made, paths)
                opened.setdefault(name, []).append(at)
    close()
    leave(root)
    root.last = made
    return out


def priors(found: list[Block]) -> list[float]:
    """What marks leave of each block's ratio.

    A marked element that holds nearly all prose of the page and its title is the page's frame; its mark doesn't count.
    """
    numbers = [e.number for e, _, _ in found]
    running = np.concatenate([[0], np.cumsum([len(t) - n if len(t) >= PROSE and PUNCTUATION.search(t) else 0 for _, t, n in found])])
    headings = [e for e, _, _ in found if e.tag in HEADINGS]
    title = min(headings, key=lambda e: (e.tag, e.number), default=None)
    order = np.argsort(numbers, kind="stable")
    ranked = np.array(numbers)[order]
    mass = np.concatenate([[0], np.cumsum(np.diff(running)[order])])
    known: dict[int, float] = {}

    def left(e: Element | None) -> float:
        """Of an element, the share that marks on it and around it leave; parents first, without recursion."""
        way = []
        while e is not None and e.number not in known:
            way.append(e)
            e = e.parent
        share = known[e.number] if e is not None else 1.0
        for x in reversed(way):
            if x.marked:
                held = mass[np.searchsorted(ranked, x.last, side="right")] - mass[np.searchsorted(ranked, x.number)]
                frame = title is not None and x.number <= title.number <= x.last and held >= FRAME * mass[-1]
                share *= 1.0 if frame else MARKED
            known[x.number] = share
        return share

    return [left(e) for e, _, _ in found]


def path_scores(found: list[Block], prior: list[float]) -> dict[int, float]:
    """Fused, smoothed ratio of every path, lowered by what marks leave of it."""
    total: dict[int, list[float]] = {}
    for element, text, linked in found:
        sums = total.setdefault(element.path, [0, 0, 0, 0])
        for i, v in enumerate((len(text), len(PUNCTUATION.findall(text)), linked, 1)):
            sums[i] += v
    ratio = {p: (chars / n) * (1 + marks / n) * (1 - links / max(1, chars)) for p, (chars, marks, links, n) in total.items()}
    own = np.array([ratio[e.path] * x for (e, _, _), x in zip(found, prior)])
    around = np.concatenate([[0.0], own, [0.0]])
    smooth = NEIGHBOUR * (around[:-2] + around[2:]) + (1 - 2 * NEIGHBOUR) * own
    fused: dict[int, list[float]] = {}
    for (element, _, _), value in zip(found, np.sqrt(smooth * np.maximum(own, 1e-9)).tolist()):
        fused.setdefault(element.path, []).append(value)
    return {p: sum(v) / len(v) for p, v in fused.items()}


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line feeds; "" where there is none."""
    found = [b for b in blocks(page or "") if not b[0].aside]
    if not found:
        return ""
    prior = priors(found)
    most = max(prior)
    prose = [len(t) - n if p == most and len(t) >= PROSE and PUNCTUATION.search(t) else 0 for (_, t, n), p in zip(found, prior)]
    in_main = sum(x for (e, _, _), x in zip(found, prose) if e.main)
    if any(e.main for e, _, _ in found) and in_main >= MAIN_SHARE * sum(prose):
        found = [b for b in found if b[0].main]
        prior = priors(found)
    scores = path_scores(found, prior)
    least = SHARE * max(scores.values())
    content = [scores[e.path] >= least for e, _, _ in found]
    chosen = [e for (e, _, _), good in zip(found, content) if good]
    holder, last = min(chosen, key=lambda e: e.number), max(e.number for e in chosen)
    while holder.last < last:
        holder = holder.parent
    whole = holder.tag not in ("", "html", "body")
    if whole and not re.fullmatch("article|main|div|section|td", holder.tag) and holder.parent is not None and holder.parent.tag not in ("", "html", "body"):
        holder = holder.parent  # a lone paragraph's heading stands beside it
    shown = []
    for i, ((e, text, _), good) in enumerate(zip(found, content)):
        plain = prior[i] == 1.0
        inside = whole and holder.number <= e.number <= holder.last
        # a title stays with the text that follows it at once, whatever holds it
        title = e.tag == "h1" and i + 1 < len(found) and content[i + 1] and not any(x.tag == "h1" for x in chosen)
        if good or plain and (inside or not whole and e.tag in HEADINGS) or title:
            shown.append(text)
    return "\n".join(shown)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with ``text`` and ``n_chars`` (code points) in place of the html; a page at a time, without shuffle.

    A null page is empty and has the text "". White space within a block becomes one space, character references are
    decoded, and nothing is capped. Repeated rows and further columns pass through; columns named text or n_chars
    are replaced.
    """
    kept = [f for f in pages.schema if f.name not in (html_col, "text", "n_chars")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string", "n_chars long"])

    def run(batches):
        for pdf in batches:
            texts = [main_text(x) for x in pdf.pop("_html")]
            yield pdf.assign(text=pd.Series(texts, index=pdf.index, dtype=object), n_chars=pd.Series(map(len, texts), index=pdf.index, dtype="int64"))

    return pages.select(*[f.name for f in kept], F.col(html_col).alias("_html")).mapInPandas(run, schema)
