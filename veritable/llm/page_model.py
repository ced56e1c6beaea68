"""A tree-structured graphical model of pages: which blocks are main text.

Every node of a page's tree (`html_tree.Tree`) is a variable, main text or not. A node has a potential
from its own features, a parent and a child have one together by the kind of the child. Messages go up
from the leaves and down from the root, level by level over all pages of a batch at once, and give the
exact marginal of every node. Both kinds of potential are learned together from labelled pages, by the
gradient of the likelihood, which the same messages give.

A labelled page is HTML in which the character MARK stands before each block of main text.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable

import numpy as np

from veritable.llm.html_tree import Tree

MARK = ""

_GROUPS = {
    "#text": 1, "p": 2, "pre": 2, "blockquote": 2, "h1": 3, "h2": 3, "h3": 3, "h4": 3, "h5": 3, "h6": 3, "ul": 4, "ol": 4, "li": 4, "dl": 4,
    "dt": 4, "dd": 4, "table": 5, "tbody": 5, "thead": 5, "tr": 5, "td": 5, "th": 5, "div": 6, "section": 6, "article": 7, "main": 7,
    "nav": 8, "aside": 8, "footer": 8, "header": 8, "form": 8, "menu": 8, "dialog": 8,
}
_N_GROUPS = 9
# Names that pages give to the parts beside their main text, by the part, and the elements they stand on.
PARTS = {
    "menu": ("nav nav div ul", "menu nav navbar navigation topnav breadcrumb links tabs toc sitemap pager pagination mainmenu submenu dropdown skip"),
    "header": ("header header div", "header masthead top topbar siteheader site logo branding banner hero"),
    "footer": ("footer footer div", "footer foot bottom colophon copyright legal credits siteinfo contentinfo"),
    "sidebar": ("aside aside div section", "sidebar side rail widget related popular trending recommended archive tag category complementary more latest"),
    "notice": ("div div section aside dialog p", "cookie consent gdpr notice alert warning modal popup overlay newsletter subscribe signup paywall disclaimer toast announcement privacy message dialog"),
    "advert": ("div div aside section ins figure p", "ad advert advertisement sponsor sponsored promo promotion adsense banner commercial partner dfp adslot adbox"),
    "form": ("form form form div", "form search login contact newsletter register comment signup poll survey"),
    "comments": ("section section div ol ul aside", "comment reply response discussion disqus review feedback respond thread commentlist user guestbook reader"),
    "share": ("div ul section", "share social follow author meta byline print toolbar action rating tag"),
}
MAIN = ("article article article main section div div td", "content article post entry story main text body page storybody articlebody single hentry")

_KINDS: dict[str, list[str]] = {}
for _part, (_, _listed) in {**PARTS, "main": MAIN}.items():
    for _name in _listed.split():
        _KINDS.setdefault(_name, []).append(_part)


def kinds(name: str) -> list[str]:
    """The parts of a page that a name speaks of: by itself, or by the longest listed one that it starts with."""
    for k in range(len(name), 3, -1):
        if name[:k] in _KINDS:
            return _KINDS[name[:k]]
    return _KINDS.get(name, [])


_REGIONS = frozenset("article main nav aside footer header form menu dialog".split())
_STOPS = re.compile(r"[.!?,;:…。、]")
_ENDING = tuple(".!?…:;\"'”»)。")


def _bucket(x: np.ndarray) -> np.ndarray:
    """0 for 0, then one bucket for each doubling, up to 12."""
    return np.minimum(np.frexp(np.asarray(x, dtype=np.float64))[1], 12)


class Forest:
    """The trees of several pages as arrays, with the features of each node as names."""

    def __init__(self, trees: list[Tree]):
        sizes = np.array([len(t.parent) for t in trees], dtype=np.int64)
        self.first = np.cumsum(sizes) - sizes
        shift = np.repeat(self.first, sizes)
        self.parent = np.concatenate([np.array(t.parent) for t in trees]) + shift
        self.parent[self.first] = -1
        self.end = np.concatenate([np.array(t.end) for t in trees]) + shift
        depth = np.concatenate([np.array(t.depth) for t in trees])
        self.tags = [tag for t in trees for tag in t.tag]
        self.names = [names for t in trees for names in t.names]
        self.text = [text for t in trees for text in t.text]
        self.linked = np.array([n for t in trees for n in t.linked], dtype=np.int64)
        self.group = np.array([_GROUPS.get(tag, 0) for tag in self.tags])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1)))
        self.page = np.repeat(np.arange(len(trees)), sizes)
        self.is_text = np.array([tag == "#text" for tag in self.tags], dtype=bool)

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sums over the subtree of each node, itself included."""
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[self.end] - sums[np.arange(len(values))]

    def features(self) -> tuple[np.ndarray, list[str]]:
        """Pairs of a node's number and the name of a feature that it has."""
        n = len(self.tags)
        size = np.array([len(t) for t in self.text], dtype=np.int64)
        stops = np.array([len(_STOPS.findall(t)) for t in self.text], dtype=np.int64)
        all_size, all_stops, all_linked = self.below(size), self.below(stops), self.below(self.linked)
        whole = np.maximum(all_size[self.first][self.page], 1)
        before = np.cumsum(size) - size
        place = (before - before[self.first][self.page] + all_size / 2) / whole
        share = np.ceil(np.log2(np.maximum(all_size / whole, 1e-9))).clip(-6, 0).astype(int)
        dense = np.ceil(4 * all_linked / np.maximum(all_size, 1)).astype(int)
        rate = _bucket(1000 * all_stops / np.maximum(all_size, 1))
        width = _bucket(all_size)
        landmark = np.array([tag in ("article", "main") for tag in self.tags])
        several = self.below(landmark.astype(np.int64))[self.first][self.page]
        under = [""] * n  # the innermost landmark or aside around a node
        around: list[frozenset] = [frozenset()] * n  # names of the elements around it
        for i in range(n):
            if self.parent[i] >= 0:
                upper = self.tags[self.parent[i]]
                under[i] = upper if upper in _REGIONS else under[self.parent[i]]
                names_of = self.names[self.parent[i]]
                around[i] = around[self.parent[i]].union(names_of) if names_of else around[self.parent[i]]
        nodes, names = [], []
        for i in range(n):
            if self.is_text[i]:
                text, upper = self.text[i], self.tags[self.parent[i]] if self.parent[i] >= 0 else "#root"
                mine = [
                    "text", f"text size {width[i]}", f"text links {dense[i]}", f"text stops {min(int(stops[i]), 4)}",
                    f"text in {upper}", f"text place {int(5 * place[i])}",
                ]
                mine += [f"name in {w}" for w in around[i]]
                mine += {f"kind in {k}" for w in around[i] for k in kinds(w)}
                if text.endswith(_ENDING):
                    mine.append("text ends")
                if "©" in text[:200]:
                    mine.append("text copyright")
            else:
                mine = [
                    f"tag {self.tags[i]}", f"size {width[i]}", f"share {share[i]}", f"links {dense[i]}", f"stops {rate[i]}",
                    *{f"name {w}" for w in self.names[i]}, *{f"kind {k}" for w in self.names[i] for k in kinds(w)},
                ]
            mine.append(f"under {under[i]} of {min(int(several[i]), 2)}")
            nodes += [i] * len(mine)
            names += mine
        return np.array(nodes, dtype=np.int64), names


def messages(forest: Forest, own: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of y = 1 of every node, and of (y of parent, y of node) of every node with a parent.

    `own`: log potential of y = 1 against 0; `edge`: log potentials by group of the child, parent's y, child's y.
    """
    n = len(own)
    up = np.zeros((n, 2))
    up[:, 1] = own
    sent = np.zeros((n, 2))  # to the parent, by the parent's y
    for level in forest.levels[:0:-1]:
        sent[level] = np.logaddexp.reduce(edge[forest.group[level]] + up[level][:, None, :], axis=2)
        np.add.at(up, forest.parent[level], sent[level])
    belief = up.copy()
    pair = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        rest = belief[forest.parent[level]] - sent[level]
        joint = rest[:, :, None] + edge[forest.group[level]]
        belief[level] += np.logaddexp.reduce(joint, axis=1)
        joint += up[level][:, None, :]
        joint -= np.logaddexp.reduce(joint.reshape(len(level), 4), axis=1)[:, None, None]
        pair[level] = np.exp(joint)
    high = belief[:, 1] - belief[:, 0]
    return 0.5 * (1 + np.tanh(high / 2)), pair


class PageModel:
    """Learned potentials."""

    def __init__(self, weights: dict[str, float], edge: np.ndarray):
        self.weights, self.edge = weights, edge

    def own(self, forest: Forest) -> np.ndarray:
        nodes, names = forest.features()
        values = np.array([self.weight(f) for f in names], dtype=np.float64)
        return np.bincount(nodes, values, minlength=len(forest.tags))

    def weight(self, feature: str) -> float:
        found = self.weights.get(feature)
        if found is None and feature.startswith("name "):
            # A name that was never met counts as the longest known one that it starts with.
            before, word = feature.rsplit(" ", 1)
            for k in range(len(word) - 1, 3, -1):
                if f"{before} {word[:k]}" in self.weights:
                    return self.weights[f"{before} {word[:k]}"]
        return found or 0.0

    def marginals(self, forest: Forest) -> np.ndarray:
        return messages(forest, self.own(forest), self.edge)[0]

    def main_texts(self, pages: list[str]) -> list[str]:
        """The blocks of each page whose marginal is at least one half, in page order, joined by spaces."""
        if not pages:
            return []
        forest = Forest([Tree(p) for p in pages])
        chosen = np.flatnonzero(forest.is_text & (self.marginals(forest) >= 0.5))
        found = [[] for _ in pages]
        for i, page in zip(chosen.tolist(), forest.page[chosen].tolist(), strict=True):
            found[page].append(forest.text[i])
        return [" ".join(f) for f in found]


def labels(forest: Forest) -> np.ndarray:
    """y of every node: of a run, whether it holds the mark; of an element, whether most of its text does.

    The marks are taken off the texts. An element without text is as its parent.
    """
    marked = np.array([MARK in t for t in forest.text], dtype=bool)
    forest.text = [t.replace(MARK, "").strip() if m else t for t, m in zip(forest.text, marked, strict=True)]
    size = np.array([len(t) for t in forest.text], dtype=np.int64)
    good, whole = forest.below(size * marked), forest.below(size)
    y = np.where(forest.is_text, marked, 2 * good >= np.maximum(whole, 1))
    for level in forest.levels[1:]:
        empty = level[(whole[level] == 0)]
        y[empty] = y[forest.parent[empty]]
    return y.astype(np.int64)


def fit(pages: Iterable[str], rounds: int = 100, penalty: float = 0.001, rate: float = 0.2) -> PageModel:
    """Potentials of greatest penalised likelihood of labelled pages, by gradient steps."""
    forest = Forest([Tree(p) for p in pages])
    y = labels(forest)
    nodes, names = forest.features()
    known = {name: i for i, name in enumerate(sorted(set(names)))}
    which = np.array([known[name] for name in names])
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((_N_GROUPS, 2, 2))
    np.add.at(seen, (forest.group[child], y[forest.parent[child]], y[child]), 1)
    split = len(known)
    x = np.zeros(split + seen.size)
    first, second = np.zeros_like(x), np.zeros_like(x)
    scale = max(len(forest.first), 1)
    for step in range(1, rounds + 1):
        own = np.bincount(nodes, x[:split][which], minlength=len(y))
        p, pair = messages(forest, own, x[split:].reshape(seen.shape))
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.group[child], pair[child])
        slope = np.concatenate([np.bincount(which, (y - p)[nodes], minlength=split), (seen - expected).reshape(-1)])
        slope = slope / scale - penalty * x
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        x += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return PageModel({name: float(x[i]) for name, i in known.items()}, x[split:].reshape(seen.shape))


# ------------------------------------------------------------------------- labelled pages


def self_labelled(page: str) -> str | None:
    """A page that names its main text by one <article> or <main>, with marks; None for others."""
    names = re.findall(r"<(article|main)[\s>]", page, re.IGNORECASE)
    if len(names) != 1 or MARK in page:
        return None
    tree = Tree(page)
    inside, out = [], []
    for i, tag in enumerate(tree.tag):
        upper = inside[tree.parent[i]] if i else False
        inside.append(tag in ("article", "main") or (upper and tag not in ("nav", "aside", "footer", "form", "menu", "dialog")))
        if tag == "#text" and inside[i]:
            out.append(i)
    return _marked(page, tree, out)


def _marked(page: str, tree: Tree, chosen: list[int]) -> str:
    """The tree written as HTML again, with the mark before the chosen runs."""
    parts: list[str] = []
    open_: list[int] = []
    marked = set(chosen)
    for i in range(1, len(tree.tag)):
        while open_ and tree.end[open_[-1]] <= i:
            parts.append(f"</{tree.tag[open_.pop()]}>")
        if tree.tag[i] == "#text":
            linked = 2 * tree.linked[i] > len(tree.text[i])
            text = html.escape(tree.text[i])
            parts.append((MARK if i in marked else "") + (f"<a>{text}</a>" if linked else text))
            parts.append("<hr>")
        else:
            names = f' class="{" ".join(tree.names[i])}"' if tree.names[i] else ""
            parts.append(f"<{tree.tag[i]}{names}>")
            open_.append(i)
    return "".join(parts)


FRAMES = ("div div section", "wrapper container page row col layout site inner outer wrap grid main content")


class _Writer:
    """Random pages with marks, of many layouts."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.vocabulary = ["".join(self.rng.choices("abcdefghilmnoprstuéü", k=1 + i % 10)) for i in range(2000)]

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.rng.choices(self.vocabulary, k=self.rng.randint(lo, hi)))

    def sentences(self, lo: int, hi: int) -> str:
        return " ".join(self.words(2, 18).capitalize() + self.rng.choice("....!?") for _ in range(self.rng.randint(lo, hi)))

    def link(self) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.words(1, 4)}</a>'

    def wrap(self, inner: str, tags: str, names: str, named: float = 0.8) -> str:
        rng = self.rng
        tag = rng.choice(tags.split())
        mine = rng.sample(names.split(), rng.choice([1, 1, 2]))
        how = rng.random()
        name = f' class="{" ".join(mine)}"' if how < 0.5 else f' id="{mine[0]}"' if how < 0.7 else f' class="{"-".join(mine)}-{rng.choice(["box", "area", "1", "block", "inner"])}"'
        bare = tag not in ("div", "section", "p", "ul", "ol", "td", "figure", "ins")
        return f"<{tag}{name if rng.random() < (0.5 if bare else named) else ''}>{inner}</{tag}>"

    def aside(self, part: str) -> str:
        rng = self.rng
        tags, names = PARTS[part]
        items = "".join(f"<li>{self.link()}</li>" for _ in range(rng.randint(2, 9)))
        loose = rng.choice([" ", " | ", ""]).join(self.link() for _ in range(rng.randint(1, 6)))
        short, long = self.words(1, 8), self.sentences(1, 4)
        inner = {
            "menu": [f"<ul>{items}</ul>", items, loose],
            "header": [f"<h1>{self.words(1, 3)}</h1>", f"<div>{self.link()}</div><p>{short}</p>", f"<h2>{short}</h2><ul>{items}</ul>", short],
            "footer": [f"&copy; {short}", f"<p>&copy; 2020 {short}</p><p>{loose}</p>", f"<ul>{items}</ul>", f"&copy; {self.words(1, 2)} &middot; {long}", long],
            "sidebar": [f"<h3>{short}</h3><ul>{items}</ul>", f"<p>{long}</p>", f"<h2>{short}</h2><p>{long}</p><p>{self.link()}</p>", long],
            "notice": [long, f"<p>{long}</p><button>OK</button>", f"<p>{long} {self.link()}</p>", f"<h4>{short}</h4><div>{long}</div>"],
            "advert": [long, short, f"<p>{long}</p>", f"{short} {self.link()}", f"<a href='x'>{short}</a>"],
            "form": [f"<label>{short}</label><input name=q><button>{short}</button>", f"<p>{long}</p><label>{short}</label><input><textarea>x</textarea>", f"<fieldset><legend>{short}</legend>{short}<select><option>a</select></fieldset>"],
            "comments": ["".join(self.comment() for _ in range(rng.randint(1, 6))), f"<h3>{rng.randint(1, 90)} {short}</h3>" + "".join(self.comment() for _ in range(rng.randint(1, 4)))],
            "share": [loose, f"<p>{short}</p>", f"<li>{self.link()}</li><li>{self.link()}</li>", f"<span>{short}</span> {self.link()}"],
        }[part]
        if part == "form":
            tags = "form" if rng.random() < 0.8 else tags
        return self.wrap(rng.choice(inner), tags, names, 1.0)

    def comment(self) -> str:
        body = f"<p>{self.sentences(1, 5)}</p>" * self.rng.choice([1, 1, 2])
        tags = self.rng.choice(["div", "article", "li", "p"])
        return self.wrap(f"<b>{self.words(1, 2)}</b>" + (self.sentences(1, 5) if tags == "p" else body), tags, "comment reply response reader user commentbody")

    def block(self) -> str:
        rng, text = self.rng, self.sentences(1, 7)
        if rng.random() < 0.3:
            text = text.replace(" ", f" {self.link()} ", 1)
        if rng.random() < 0.1:
            text = f"<b>{text}<br>"
        kinds = [f"<p>{MARK}{text}</p>"] * 12 + [f"<p>{MARK}{self.words(1, 2).capitalize()}.</p>"] * 2 + [
            f"<h2>{MARK}{self.words(1, 8)}</h2>", f"<h3>{MARK}{self.words(1, 5)}</h3>", f"<blockquote>{MARK}{text}</blockquote>",
            f"<blockquote><p>{MARK}{text}</p></blockquote>", f"<pre>{MARK}{text}</pre>", f"<div>{MARK}{text}</div>",
            "<ul>" + "".join(f"<li>{MARK}{self.sentences(1, 1)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>",
            "<ol>" + "".join(f"<li>{MARK}{self.words(1, 9)}</li>" for _ in range(rng.randint(2, 6))) + "</ol>",
            "<table>" + "".join(f"<tr><td>{MARK}{self.words(1, 4)}</td><td>{MARK}{rng.randint(1, 999)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>",
            f"<figure><img src=x><figcaption>{MARK}{self.words(3, 9)}.</figcaption></figure>", f"<p>{MARK}{text}",
        ]
        return rng.choice(kinds)

    def page(self) -> str:
        rng = self.rng
        title = self.words(2, 10).capitalize()
        head = rng.choice([f"<h1>{MARK}{title}</h1>"] * 6 + [f"<header><h1>{MARK}{title}</h1></header>", f"<h2>{MARK}{title}</h2>", ""])
        body = [self.block() for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 25]))]
        inside = ["advert", "advert", "share", "sidebar", "notice", "form"]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            body.insert(rng.randint(0, len(body)), self.aside(rng.choice(inside)))
        if rng.random() < 0.15:
            body.append(self.aside("comments"))
        text = head + "".join(body)
        main = text if rng.random() < 0.12 else self.wrap(text, *MAIN)
        if rng.random() < 0.2:
            main = self.wrap(main, "div section main", "content main post entry article")
        before = [self.aside(p) for p in ("header", "menu", "notice", "advert", "form", "sidebar") if rng.random() < 0.45]
        after = [self.aside(p) for p in ("comments", "share", "sidebar", "advert", "form", "notice", "footer") if rng.random() < 0.45]
        rng.shuffle(before)
        parts = [*before, main, *after]
        if rng.random() < 0.3:
            k = len(before)
            parts[k : k + 2] = [self.wrap("".join(parts[k : k + 2]), *FRAMES)]
        whole = "".join(parts)
        whole = self.wrap(whole, *FRAMES) if rng.random() < 0.4 else whole
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{whole}</body></html>"


def written_pages(n: int, seed: int = 11) -> list[str]:
    """Labelled pages of many layouts, of invented words."""
    writer = _Writer(seed)
    return [writer.page() for _ in range(n)]
