"""Tags and texts of HTML, whatever state it is in."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: The start of a tag, and what may end it.
TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
TAG_MARK = re.compile("[>\"']")


def tokens(page: str, unshown: frozenset[str]) -> Iterator[tuple[str, str, str | None]]:
    """Tags and texts in page order: ("", name, attributes), ("/", name, "") or (text, "", None). Comments, declarations and unshown elements with what they hold are left out.

    In linear time: what isn't closed is looked for once. Where the quotes in a tag never end, tags from there on end
    at the next ">"; without one, "<" is text.
    """
    at, size = 0, len(page)
    quoted, missing = True, set()

    def tag_end(start: int) -> int:
        nonlocal quoted
        i = start
        while quoted:
            mark = TAG_MARK.search(page, i)
            if mark is None:
                break
            if mark[0] == ">":
                return mark.start()
            i = -1 if mark[0] in missing else page.find(mark[0], mark.end()) + 1
            if i <= 0:
                missing.add(mark[0])
                return page.find(">", start)
        quoted = False
        return page.find(">", start)

    while at < size:
        start = page.find("<", at)
        if start < 0 or "end" in missing:
            hidden = re.search("<[!?]", page[at:]) if start >= 0 else None
            yield page[at : at + hidden.start() if hidden else size], "", None
            return
        if start > at:
            yield page[at:start], "", None
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            continue
        tag = TAG.match(page, start + 1)
        end = tag_end(tag.end()) if tag else -1
        if end < 0:
            if tag:
                missing.add("end")  # no ">" is left
            yield "<", "", None
            at = start + 1
            continue
        name, attributes, at = tag[2].lower(), page[tag.end() : end], end + 1
        if name in unshown and not tag[1]:
            if not attributes.endswith("/"):
                closed = re.compile(f"</{name}\\s*>", re.I).search(page, at)
                at = size if closed is None else closed.end()
            continue
        yield tag[1], name, attributes
