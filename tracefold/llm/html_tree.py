"""A forgiving HTML reader for the extraction of main texts: one pass over a page, linear in its length."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
SPACE = re.compile(r"\s+")

#: HTML's void, raw-text and block elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag ends if it is open, unless one of the second has opened since.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "table", "td")),
    "dt": (("dt", "dd"), ("dl", "table")),
    "dd": (("dt", "dd"), ("dl", "table")),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
}
#: End tags that don't reach out of these elements.
INNER, SCOPE = set("p b i span li".split()), ("article", "table", "td")


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    in_article: bool
    children: list = field(default_factory=list)  # elements and texts


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(text)}


class _Marks:
    """Next places of single characters in a page; one that doesn't come again is not looked for again."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def next(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose name ends at ``at``, outside quoted values; -1 if there is none."""
        page = self.page
        while True:
            end = self.next(">", at)
            if end < 0:
                return -1
            eq = page.find("=", at, end)
            while eq >= 0:
                value = eq + 1
                while value < end and page[value].isspace():
                    value += 1
                if value < end and page[value] in "\"'":
                    close = self.next(page[value], value + 1)
                    if close > end:  # the > stands in a quoted value
                        at = close + 1
                        break
                    if close < 0:
                        return end
                    value = close + 1
                eq = page.find("=", max(value, eq + 1), end)
            else:
                return end


def parts(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page: kinds ``<``, ``>``, ``text``; raw elements come without content."""
    marks, at, end = _Marks(page), 0, len(page)
    while at < end:
        lt = marks.next("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        at = lt
        if page.startswith("<!--", at):
            close = page.find("-->", at + 2)
            at = end if close < 0 else close + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            close = marks.next(">", at)
            at = end if close < 0 else close + 1
            continue
        closing = page[at + 1 : at + 2] == "/"
        m = NAME.match(page, at + 1 + closing)
        stop = marks.tag_end(m.end()) if m else -1
        if stop < 0:  # no tag: the sign itself is text
            if m and ">" in marks.gone:  # nor will any other be one
                yield "text", page[at:], ""
                return
            yield "text", "<", ""
            at += 1
            continue
        tag = m[0].lower()
        yield ">" if closing else "<", tag, page[m.end() : stop]
        at = stop + 1
        if not closing and tag == "xmp":  # its content is text as it stands
            close = page.find("</xmp", at)
            yield "text", html.escape(page[at : close if close >= 0 else end], quote=False), ""
            at = close if close >= 0 else end
        if not closing and tag in RAW:  # its content is no markup
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end


def parse(page: str) -> Element:
    """The tree of a page; an end tag closes the nearest open element of its name, or nothing."""
    root = Element("#root", {}, False)
    stack = [root]
    open_: dict[str, list[int]] = {}  # places in the stack by tag
    blocks: list[int] = []  # of block elements other than p

    def nearest(tag: str) -> int:
        places = open_.get(tag)
        return places[-1] if places else 0

    def cut(to: int) -> None:
        while len(stack) > to:
            tag = stack.pop().tag
            open_[tag].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()

    for kind, tag, rest in parts(page):
        if kind == "text":
            stack[-1].children.append(tag)
            continue
        if kind == ">":
            place = nearest(tag)
            if place and not (tag in INNER and max(map(nearest, SCOPE)) > place):
                cut(place)
            continue
        if tag in BLOCK and nearest("p") > (blocks[-1] if blocks else 0):
            cut(nearest("p"))
        if tag in CLOSES:
            ended, since = CLOSES[tag]
            place = max(map(nearest, ended))
            if place > max(map(nearest, since)):
                cut(place)
        element = Element(tag, attributes(rest) if rest.strip() else {}, bool(nearest("article") or nearest("main")))
        stack[-1].children.append(element)
        if tag not in VOID and tag not in RAW and not rest.rstrip().endswith("/"):
            open_.setdefault(tag, []).append(len(stack))
            if tag in BLOCK and tag != "p":
                blocks.append(len(stack))
            stack.append(element)
    return root
