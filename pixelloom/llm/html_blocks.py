"""HTML to leaf blocks: text between block boundaries, with its ancestors and link share."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# HTML elements that begin and end blocks, elements without content, and elements whose content is not text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title template iframe".split())
#: What an opening tag closes if it is open nearest, up to a fence.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TEXT = re.compile(r"[^<]+|<")
_REMARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>", re.S)
#: A tag: quoted values may hold anything; those that may not hold ``<``, for pages with a quote that never ends; up to the next ``>``.
_TAG, _SHORT, _PLAIN = (re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:_-]*)(" + body + ")>", re.S) for body in (r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""", r"""(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+""", "[^>]*"))
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|aria-label|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s"'/]|$)""", re.I | re.S)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_NAME = re.compile(r"</?[A-Za-z]")


class Element:
    """An open element: its tag, attributes and parent, so that blocks share the path to them. ``features`` is for whoever reads it."""

    __slots__ = ("tag", "attributes", "parent", "features")

    def __init__(self, tag: str, attributes: str, parent: "Element | None") -> None:
        self.tag, self.attributes, self.parent, self.features = tag, attributes, parent, None


@dataclass
class Block:
    """Text of a leaf block, the innermost of its open elements (nothing if there is none), and its share of characters in links."""

    text: str
    path: Element | tuple
    linked: float


class _Open:
    """The open elements, and for each tag the depths at which it is open: nearest ones are found without a search."""

    def __init__(self) -> None:
        self.path: list[Element] = []
        self.depths: dict[str, list[int]] = {}

    def nearest(self, tags) -> int:
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=-1)

    def push(self, tag: str, attributes: str) -> None:
        self.depths.setdefault(tag, []).append(len(self.path))
        self.path.append(Element(tag, attributes, self.path[-1] if self.path else None))

    def close(self, depth: int) -> None:
        while len(self.path) > depth:
            self.depths[self.path.pop().tag].pop()


class _Tags:
    """Tokens of a page, each character looked at a bounded number of times.

    A quote that never ends is looked for once, then quotes reach to the next ``<``; behind the last ``>`` everything is text.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last, self.patterns = page, page.rfind(">"), (_TAG, _PLAIN)
        self.absent: set[str] = set()

    def at(self, at: int) -> re.Match:
        """The token that begins at a place: a remark, a tag or text."""
        page = self.page
        if page[at] != "<":
            return _TEXT.match(page, at)
        if page.startswith("<!--", at):
            return _REMARK.match(page, at)
        if at > self.last:
            return _TEXT.match(page, at)
        if page.startswith(("<!", "<?"), at):
            return _REMARK.match(page, at)
        if not page[at + 1 : at + 2].isalpha() and not page.startswith("</", at):
            return _TEXT.match(page, at)
        for pattern in self.patterns:
            if m := pattern.match(page, at):
                return m
            if pattern is _TAG and _NAME.match(page, at):
                self.patterns = (_SHORT, _PLAIN)
        return _TEXT.match(page, at)

    def find(self, what: str, at: int) -> int:
        """Where ``what`` is next, in either case, as a word; -1 if nowhere. What was not found is not looked for again."""
        if what in self.absent:
            return -1
        found = re.compile(what + r"\b", re.I).search(self.page, at)
        if found is None:
            self.absent.add(what)
            return -1
        return found.start()


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order. ``head`` and raw elements give none. Time and memory are linear in the page, however its tags are nested or broken."""
    out: list[Block] = []
    open_, tags = _Open(), _Tags(page)
    parts: list[str] = []
    linked, links, at, n = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = _SPACE.sub(" ", html.unescape(raw) if "&" in raw else raw).strip(" ")
            if text:
                out.append(Block(text, open_.path[-1] if open_.path else (), min(1.0, linked / max(1, len(raw)))))
            parts.clear()
        linked = 0

    while at < n:
        m = tags.at(at)
        at = m.end()
        if m.re is _TEXT:
            parts.append(m[0])
            if links:
                linked += len(m[0])
            continue
        if m.re is _REMARK:
            continue
        closing, name, attributes = m[1], m[2].lower(), m[3]
        if name in RAW or name == "head":
            if not closing and not attributes.endswith("/"):
                end = tags.find("</" + name, at)
                if name == "head":  # a head without an end gives way to the body
                    body = tags.find("<body", at)
                    end = body if body >= 0 and not 0 <= end < body else end
                    at = at if end < 0 else end
                else:
                    at = n if end < 0 else end
            continue
        if closing:
            if name in BLOCK:
                flush()
                if (depth := open_.nearest((name,))) >= 0:
                    open_.close(depth)
                    links = 0
            elif name == "a":
                links = 0
            continue
        if name in BLOCK:
            flush()
            if name not in ("label", "button", "option", "select", "textarea", "legend"):
                if open_.path and open_.path[-1].tag == "p":
                    open_.close(len(open_.path) - 1)
            if name in CLOSES:
                what, fence = CLOSES[name]
                depth = open_.nearest(what)
                if depth > open_.nearest(fence):
                    open_.close(depth)
            links = 0
            if name not in VOID:
                open_.push(name, attributes)
        elif name == "a":
            links = 1
        elif name == "br":
            parts.append(" ")
    flush()
    return out


def attribute_words(attributes: str) -> list[str]:
    """Words of class, id, role and label, and ``hidden`` for hidden elements."""
    words = []
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            words.append("hidden")
        elif name != "style":
            words += re.findall("[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    return words
