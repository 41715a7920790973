"""Block trees of web pages, for the main-text extractor.

A page becomes a list of nodes in page order, parents first: block elements, and
runs of text (inline markup dissolved) as leaves.  Missing end tags are implied
as browsers do for paragraphs, headings, list items and table cells.  Scripts,
styles, comments, controls and other content that is never text is left out.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|([^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|data-keep)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_NAME = re.compile(r"[a-z]+")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Content up to the end tag is never text of the page.
SKIPPED = frozenset("script style title textarea select button noscript template iframe svg math object audio video canvas head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first kind ends where one of it begins, unless one of the second kind stands between.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
_WALLS = frozenset(["table", "td", "th"])


@dataclass
class Page:
    """Nodes of a page; a leaf has a text, an element has none."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[frozenset[str]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    keep: list[bool] = field(default_factory=list)

    def add(self, parent: int, tag: str, names: frozenset[str], text: str | None, linked: int, keep: bool) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        self.keep.append(keep)
        return len(self.parent) - 1


_NONE: frozenset[str] = frozenset()


def _attributes(source: str) -> tuple[frozenset[str], str | None]:
    """Words of class, id and role, and the training mark ``data-keep``."""
    if "=" not in source:
        return _NONE, None
    names, mark = set(), None
    for name, value in _ATTRIBUTE.findall(source):
        if name == "data-keep":
            mark = value.strip("\"'")
        else:
            names.update(_NAME.findall(value.lower()))
    return frozenset(names), mark


def parse(source: str) -> Page:
    """The nodes of a page; the first is the page itself."""
    page = Page()
    page.add(-1, "page", _NONE, None, 0, False)
    stack, links, pieces, linked, inline = [0], 0, [], 0, _NONE

    def flush() -> None:
        nonlocal pieces, linked, inline
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.add(stack[-1], "text", inline, text, min(linked, len(text)), page.keep[stack[-1]])
        pieces, linked, inline = [], 0, _NONE

    def close(upto: int) -> None:
        nonlocal links
        del stack[upto:]
        links = 0

    position, end = 0, len(source)
    while position < end:
        found = _TOKEN.match(source, position)
        position = found.end()
        text = found[7]
        if text is not None:
            if "&" in text:
                text = html.unescape(text)
            pieces.append(text)
            if links:
                linked += len(text)
            continue
        tag = found[2] or found[5]
        if tag is None:
            continue  # a comment or declaration
        tag, closing = tag.lower(), found[1] or found[4]
        if tag in BLOCKS:
            flush()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    open_tag = page.tag[stack[k]]
                    if open_tag == tag or (tag in HEADINGS and open_tag in HEADINGS):
                        close(k)
                        break
                    if open_tag in _WALLS and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html"):
                        break
                continue
            top = page.tag[stack[-1]]
            if top == "p" or (tag in HEADINGS and top in HEADINGS):
                close(len(stack) - 1)
            if tag in _IMPLIED:
                ended, walls = _IMPLIED[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if page.tag[stack[k]] in ended:
                        close(k)
                        break
                    if page.tag[stack[k]] in walls:
                        break
            if tag == "hr":
                continue
            names, mark = _attributes(found[3] or found[6] or "")
            kept = page.keep[stack[-1]] if mark is None else mark == "1"
            stack.append(page.add(stack[-1], tag, names, None, 0, kept))
        elif tag in SKIPPED:
            if not closing and not (found[3] or found[6] or "").endswith("/"):
                position = _behind(source, tag, position)
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            pieces.append(" ")
        elif not closing and "=" in (found[3] or ""):
            inline |= _attributes(found[3])[0]
    flush()
    return page


_ENDS: dict[str, re.Pattern] = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in SKIPPED}
_BODY = re.compile(r"</head(?=[\s/>])[^>]*(?:>|\Z)|(?=<body[\s>])", re.I)


def _behind(source: str, tag: str, position: int) -> int:
    """Where the content of a skipped element ends; a head may lack its end tag."""
    found = (_BODY if tag == "head" else _ENDS[tag]).search(source, position)
    if found:
        return found.end()
    return position if tag == "head" else len(source)
