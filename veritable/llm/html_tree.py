"""HTML as a tree of blocks: block elements, and runs of text between their borders.

Inline elements make no node; a run knows how much of it is linked. Scripts, styles, titles, comments
and what only controls a page (buttons, selections, templates) have no text. Markup may be broken: end
tags may be missing, left over or crossed, a tag may be cut off by the end.
"""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre
    search section summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements whose text is none of the page's.
MUTE = frozenset("noscript template svg object canvas audio video select button datalist map applet".split())
#: A start tag ends an open element of these kinds, up to one of the others.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}

# Quotes hold back the end of a tag only behind an equals sign and if they are closed.
_ATTRIBUTES = r"""((?:[^>"'=]++|=\s*(?:"[^"]*"|'[^']*')?|["'])*+)>"""
_TAG = re.compile(
    r"<!--(?:(-?>|.*?--!?>)|.*\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(script|style|title|textarea|iframe|xmp|noembed|noframes)(?=[\s/>])"
    + _ATTRIBUTES
    + r"(?:(.*?</\3(?=[\s/>])[^>]*>)|.*\Z)|<([a-zA-Z][^\s/>]*)"
    + _ATTRIBUTES,
    re.DOTALL | re.IGNORECASE,
)
_CUT_OFF = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label|data-testid|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
_HUMP = re.compile(r"([a-z])([A-Z])")
_LETTERS = re.compile(r"[a-z]+")


def tokens(attributes: str) -> list[str]:
    """Words in the names that an element carries, singular where that is a final s."""
    found = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = html.unescape("".join(values))
        name = name.lower()
        if name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            found.append("hidden")
        elif name != "style":
            plain = _LETTERS.findall(_HUMP.sub(r"\1 \2", value).lower())
            found += [w[:-1] if len(w) > 2 and w.endswith("s") else w for w in plain]
    return found


class Tree:
    """Nodes of one page in document order; `parent` -1 is the root's."""

    def __init__(self, page: str):
        self.parent, self.depth, self.tag, self.names, self.end = [-1], [0], ["#root"], [[]], [0]
        self.text: list[str] = [""]
        self.linked = [0]
        self._stack = [("#root", 0)]  # (tag, node, or -1 of an inline element)
        self._open: dict[str, int] = {}
        self._blocks = [0]
        self._run: list[str] = []
        self._links = self._mute = self._linked = 0
        self._read(page)

    def _read(self, page: str) -> None:
        # What stands behind the last ">" holds no whole tag.
        whole, at, lost = page.rfind(">") + 1, 0, False
        for match in _TAG.finditer(page, 0, whole):
            if match.start() > at:
                self._say(page[at : match.start()])
            at = match.end()
            comment, closed, raw, _, ended, opened, attributes = match.groups()
            lost = (raw and ended is None) or (match[0].startswith("<!--") and comment is None)
            if opened:
                self._start(opened.lower(), attributes)
            elif closed:
                self._stop(closed.lower())
        rest = page[at:]
        cut = _CUT_OFF.search(rest)
        if not lost:  # a script or comment that never ends takes the rest
            self._say(rest[: cut.start()] if cut else rest)
        self._flush()
        while self._stack:
            self._pop()

    def _say(self, text: str) -> None:
        if text and not self._mute:
            text = html.unescape(text) if "&" in text else text
            self._run.append(text)
            if self._links:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._run:
            text = " ".join("".join(self._run).split())
            if text:
                self._add("#text", [], text, min(self._linked, len(text)))
                self.end[-1] = len(self.parent)
            self._run = []
        self._linked = 0

    def _add(self, tag: str, names: list[str], text: str = "", linked: int = 0) -> int:
        self.parent.append(self._blocks[-1])
        self.depth.append(self.depth[self._blocks[-1]] + 1)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        self.end.append(0)
        return len(self.parent) - 1

    def _pop(self) -> str:
        tag, node = self._stack.pop()
        if node >= 0:
            self._flush()
            self._blocks.pop()
            self.end[node] = len(self.parent)
        self._links -= tag == "a"
        self._mute -= tag in MUTE
        self._open[tag] = self._open.get(tag, 0) - 1
        return tag

    def _pop_to(self, kinds: set[str], borders: set[str]) -> None:
        """Close the innermost element of these kinds that stands inside the borders."""
        if not any(self._open.get(k, 0) > 0 for k in kinds):
            return
        for tag, _ in reversed(self._stack):
            if tag in kinds:
                while self._pop() not in kinds:
                    pass
                return
            if tag in borders:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag == "br" and not self._mute:
                self._run.append(" ")
            elif tag == "hr":
                self._flush()
            return
        block = tag in BLOCK or "-" in tag
        if tag in ("html", "body") and self._open.get(tag, 0) > 0:
            return
        if block:
            if tag in ENDS:
                self._pop_to(*ENDS[tag])
            elif tag not in ("html", "body"):
                self._pop_to({"p"}, {"td", "th", "caption", "button", "object"})
            self._flush()
            node = self._add(tag, tokens(attributes) if attributes and not self._mute else [])
            self._blocks.append(node)
        self._stack.append((tag, node if block else -1))
        self._open[tag] = self._open.get(tag, 0) + 1
        self._links += tag == "a"
        self._mute += tag in MUTE

    def _stop(self, tag: str) -> None:
        if tag == "br" and not self._mute:
            self._run.append(" ")
        if self._open.get(tag, 0) <= 0 or tag in ("html", "body"):
            return  # what follows the end of the body still belongs to it
        if tag in BLOCK or "-" in tag or tag in MUTE:
            while self._pop() != tag:
                pass
            return
        for other, node in reversed(self._stack):
            if other == tag:
                while self._pop() != tag:
                    pass
                return
            if node >= 0:
                return  # an inline element does not end across the border of a block
