"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a binary variable: content or not. A potential on each variable comes from the element's
own features (tag, class and id words, share of linked text, length, punctuation); a potential on each parent-child
edge says how likely content is below content, or below a page frame, for the child's kind of tag. Sum-product
messages go from the leaves to the root and back, and give each element's content marginal exactly, as the graph is
a tree. Both potentials are trained on labelled pages, which this module composes from templates of the common
page designs (no labelled web page is among the tables).

Inline elements belong to their block. Blocks with a marginal of a half or more are written in page order.
Null or empty pages, and pages without content, give an empty text. Broken markup is read as browsers mostly do:
unknown end tags are ignored, a paragraph ends where a block starts, and what is open at the end is closed.
Repeated rows each keep their row; an empty table gives an empty table; other columns are passed on, and those called like the
results are replaced. There are no ties: each page is read on its own, whole, whatever its length and depth.
A head ends at the first text or element that can't stand in one; self-closing elements of SVG and MathML are closed at once.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import mapped, slices, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title textarea select option button svg math iframe object canvas datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
#: Tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Tags that end an open element of the same group, up to the tag that holds the group.
GROUPS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Elements that can stand in a head, and those that start foreign content.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
FOREIGN = frozenset({"svg", "math"})
SPACES = re.compile(r"[\s ]+")

#: Words in class, id or role that speak for a kind of element (fixed lists, one kind a line).
KINDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar pagination pager toc tabs skip",
    "head": "header masthead banner logo branding hero-nav",
    "foot": "footer foot copyright legal colophon bottom",
    "side": "sidebar aside side widget related recommended recommendations more trending popular complementary rail",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted banner-ad teaser",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter paywall disclaimer banner-notice toast",
    "form": "form search login signup register contact",
    "comment": "comment comments commentlist reply replies discussion disqus respond feedback reviews",
    "share": "share sharing social follow tags tag-list meta byline author-box",
    "content": "article content post entry story main body text articlebody post-body entry-content page-content maincontent",
}
_KIND_OF = {word: kind for kind, words in KINDS.items() for word in words.split()}
TAGS = "body html div section article main header footer nav aside form ul ol li p h1 h2 h3 blockquote pre table tr td figure figcaption dl dt dd fieldset".split()
FEATURES = [f"tag {x}" for x in TAGS] + [f"kind {x}" for x in KINDS] + ["linked", "half linked", "short", "long", "sentence", "copyright", "empty", "bias"]
#: Share of an even distribution in those of the edges, so that none is nearly certain.
SMOOTH = 0.04
_AT = {x: i for i, x in enumerate(FEATURES)}
_SENTENCE, _NAME = re.compile(r"[.!?…:;]['\")»”]?$"), re.compile(r"[A-Za-z][a-z]*|[0-9]+")


class Node:
    __slots__ = ("tag", "kinds", "parent", "parts", "children", "size", "linked")

    def __init__(self, tag: str, kinds: frozenset, parent: Node | None):
        self.tag, self.kinds, self.parent = tag, kinds, parent
        self.parts: list = []  # texts, None for a break, and child nodes, in order
        self.children: list[Node] = []
        self.size = self.linked = 0


def kinds_of(attrs: list) -> frozenset:
    found = set()
    for name, value in attrs:
        if value and name in ("class", "id", "role"):
            for word in value.lower().split():
                for x in (word, *re.split(r"[-_]+", word)):
                    if x in _KIND_OF:
                        found.add(_KIND_OF[x])
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            found.add("notice")
    return frozenset(found)


class Tree(HTMLParser):
    """Builds the tree of block elements; comments, declarations and hidden elements leave nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", frozenset(), None)
        self.open: list[tuple[str, Node]] = [("html", self.root)]
        self.hidden = 0  # how many hidden elements are open
        self.links = 0
        self.foreign = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD:
            self._leave_head()
        if tag in ("html", "body"):
            self.open[0][1].kinds |= kinds_of(attrs)
            return
        if tag in VOID:
            if not self.hidden and tag in ("br", "hr"):
                self.open[-1][1].parts.append(None)
            return
        if tag in ENDS_P:
            self._end("p", ENDS_P - {"p"})
        if tag in GROUPS:
            ends, within = GROUPS[tag]
            for x in ends:
                self._end(x, within)
        here = self.open[-1][1]
        self.foreign += tag in FOREIGN
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "a":
            self.links += 1
        elif tag not in INLINE and not self.hidden:
            child = Node(tag, kinds_of(attrs), here)
            here.children.append(child)
            here.parts.append(child)
            here = child
        self.open.append((tag, here))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.foreign and self.open[-1][0] == tag and tag not in VOID:
            self._end(tag, frozenset())

    def _leave_head(self) -> None:
        if self.open[-1][0] == "head":
            self._end("head", frozenset())

    def handle_endtag(self, tag: str) -> None:
        self._end(tag, frozenset())

    def _end(self, tag: str, within: frozenset | set) -> None:
        """Close the innermost open element of that tag, and what is open in it; none beyond one of ``within``."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                for x, _ in self.open[at:]:
                    self.hidden -= x in HIDDEN
                    self.links -= x == "a"
                    self.foreign -= x in FOREIGN
                del self.open[at:]
                return
            if self.open[at][0] in within:
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._leave_head()
        if self.hidden or not data:
            return
        node = self.open[-1][1]
        node.parts.append(data)
        n = len(data.strip())
        node.size += n
        if self.links:
            node.linked += n


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def in_order(root: Node) -> list[Node]:
    """Parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


def features(nodes: list[Node]) -> np.ndarray:
    x = np.zeros((len(nodes), len(FEATURES)))
    sizes = {id(n): [n.size, n.linked] for n in nodes}
    for n in reversed(nodes):
        if n.parent is not None:
            own, up = sizes[id(n)], sizes[id(n.parent)]
            up[0] += own[0]
            up[1] += own[1]
    for row, n in zip(x, nodes, strict=True):
        size, linked = sizes[id(n)]
        if (at := _AT.get(f"tag {n.tag}")) is not None:
            row[at] = 1
        for kind in n.kinds:
            row[_AT[f"kind {kind}"]] = 1
        share = linked / size if size else 0.0
        row[_AT["linked"]], row[_AT["half linked"]] = share, share > 0.5
        row[_AT["short"]], row[_AT["long"]] = size < 25, size >= 80
        text = next((p for p in reversed(n.parts) if isinstance(p, str) and p.strip()), "").rstrip()
        row[_AT["sentence"]] = bool(_SENTENCE.search(text))
        row[_AT["copyright"]] = "©" in text or any(isinstance(p, str) and "©" in p for p in n.parts)
        row[_AT["empty"]], row[_AT["bias"]] = size == 0, 1
    return x


def tempers(nodes: list[Node]) -> np.ndarray:
    """A factor of each node's potential: n children of one parent, tag and kinds speak like the square root of n, not like n witnesses."""
    many: dict[tuple, int] = {}
    keys = [(id(n.parent), n.tag, n.kinds) for n in nodes]
    for key in keys:
        many[key] = many.get(key, 0) + 1
    return np.array([many[key] ** -0.5 for key in keys])


class Model:
    """weights: of the features. edges: log P(child | parent) by kind of child tag; [kind][parent][child]."""

    def __init__(self, weights: np.ndarray, edges: dict[str, np.ndarray], root: float):
        self.weights, self.edges, self.root = weights, edges, root

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """P(content) of each node, by sum-product messages up and down the tree."""
        place = {id(n): k for k, n in enumerate(nodes)}
        own = features(nodes) @ self.weights * tempers(nodes)
        belief = np.stack([np.zeros(len(nodes)), own], axis=1).tolist()  # log potentials, and messages from below
        other = self.edges["other"]
        up: list = [None] * len(nodes)
        edge = [self.edges.get(n.tag, other) for n in nodes]
        for k in range(len(nodes) - 1, 0, -1):
            (a, b), e = belief[k], edge[k]
            m0, m1 = _plus(e[0][0] + a, e[0][1] + b), _plus(e[1][0] + a, e[1][1] + b)
            up[k] = (m0, m1)
            above = belief[place[id(nodes[k].parent)]]
            above[0] += m0
            above[1] += m1
        belief[0][1] += self.root
        out = np.zeros(len(nodes))
        for k, n in enumerate(nodes):
            if k:
                a, b = belief[place[id(n.parent)]]
                a, b = a - up[k][0], b - up[k][1]  # what the parent believes without this child
                e = edge[k]
                d0, d1 = _plus(a + e[0][0], b + e[1][0]), _plus(a + e[0][1], b + e[1][1])
                belief[k][0] += d0
                belief[k][1] += d1
            low, high = belief[k]
            out[k] = 1 / (1 + np.exp(min(60.0, max(-60.0, low - high))))
            top = max(low, high)
            belief[k][0], belief[k][1] = low - top, high - top
        return out


def _plus(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return max(a, b) + float(np.log1p(np.exp(-abs(a - b))))


def train(pages: list[tuple[str, str]], steps: int = 25) -> Model:
    """A model of (html, mark): in the html, the text of content blocks starts with the mark."""
    xs, ys, pairs, roots = [], [], {}, [1.0, 1.0]
    for html, mark in pages:
        nodes = in_order(parse(html))
        label = {}
        for n in reversed(nodes):
            own = [p for p in n.parts if isinstance(p, str) and p.strip()]
            below = [label[id(c)] for c in n.children]
            label[id(n)] = int(any(p.lstrip().startswith(mark) for p in own) if own else bool(below) and sum(below) * 2 > len(below))
        xs.append(features(nodes))
        ys.extend(label[id(n)] for n in nodes)
        roots[label[id(nodes[0])]] += 1
        for n in nodes[1:]:
            for kind in {n.tag, "other"}:
                pairs.setdefault(kind, np.ones((2, 2)))[label[id(n.parent)], label[id(n)]] += 1
    x, y = np.vstack(xs), np.array(ys, float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.5 * np.eye(len(w)), x.T @ (y - p) - 0.5 * w)
    prior = np.log(y.mean() / (1 - y.mean()))
    w[_AT["bias"]] -= prior  # the prior is in the edges
    edges = {k: np.log((1 - SMOOTH) * v / v.sum(axis=1, keepdims=True) + SMOOTH / 2).tolist() for k, v in pairs.items()}
    return Model(w, edges, float(np.log(roots[1] / roots[0])))


# --- labelled pages ------------------------------------------------------------------------------

_MARK = "⁣"  # an invisible separator starts the text of content blocks


def labelled_pages(many: int = 240, seed: int = 11) -> list[tuple[str, str]]:
    """Pages of varied design, made of random words, in which content blocks are marked."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(low, high)))

    def sentences(low: int, high: int) -> str:
        return " ".join(words(4, 16).capitalize() + rng.choice(".....?!") for _ in range(rng.randint(low, high)))

    def short() -> str:
        return words(1, 4).capitalize() + rng.choice(["", ".", ".", "!"])

    def notes(low: int, high: int) -> str:  # of clutter, which ends like a sentence or not
        text = sentences(low, high)
        return text[:-1] if rng.random() < 0.4 else text

    def tag(name: str, inner: str, *names: str) -> str:
        given = [x for x in names if x]
        return f"<{name}{f' {rng.choice(("class", "class", "id"))}="{rng.choice(given)}"' if given else ''}>{inner}</{name}>"

    def links(n: int) -> str:
        return tag("ul", "".join(tag("li", f'<a href="/x">{words(1, 3)}</a>') for _ in range(n)), *rng.choice([[], ["menu"]]))

    def clutter(text: str) -> str:
        return rng.choice([lambda: tag("p", text), lambda: text, lambda: tag("p", text) + tag("p", notes(1, 3)), lambda: "".join(tag("p", short()) for _ in range(rng.randint(1, 4))), lambda: tag("h3", words(1, 4)) + tag("p", text)])()

    def paragraph() -> str:
        text = sentences(1, 6)
        if rng.random() < 0.25:
            text += f' <a href="/y">{words(1, 3)}</a> {sentences(1, 1)}'
        if rng.random() < 0.2:
            text = f"<b>{text}"
        if rng.random() < 0.25:
            text = rng.choice([words(1, 6), short(), short()])
        return f"<p>{_MARK}{text}</p>"

    def content() -> str:
        blocks = [f"<h1>{_MARK}{words(3, 10)}</h1>"] if rng.random() < 0.85 else []
        if rng.random() < 0.15:
            blocks = [tag("header", blocks[0], *rng.choice([[], ["entry-header", "article-header"]]))] if blocks else []
        terse = rng.random() < 0.25  # an article of short sentences
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.72:
                blocks.append(f"<p>{_MARK}{short()}</p>" * rng.choice([1, 1, 1, 4]) if terse else paragraph())
            elif kind < 0.8:
                blocks.append(f"<h{rng.choice('23')}>{_MARK}{words(2, 7)}</h2>")
            elif kind < 0.86:
                blocks.append(tag(rng.choice(["ul", "ol"]), "".join(f"<li>{_MARK}{rng.choice([words(2, 9), sentences(1, 2)])}</li>" for _ in range(rng.choice([2, 3, 4, 6, 20])))))
            elif kind < 0.9:
                blocks.append(f"<blockquote>{_MARK}{sentences(1, 3)}</blockquote>")
            elif kind < 0.93:
                blocks.append(f"<pre>{_MARK}{words(5, 30)}</pre>")
            elif kind < 0.95:
                blocks.append("<table>" + "".join(f"<tr><td>{_MARK}{words(1, 3)}</td><td>{_MARK}{words(1, 3)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>")
            elif kind < 0.97:
                blocks.append(f"<figure><img src='x'><figcaption>{_MARK}{sentences(1, 1)}</figcaption></figure>")
            else:
                blocks.append(tag("div", clutter(notes(1, 2)), "ad", "ads", "advert", "promo", "sponsored", "ad-slot"))
        inner = "".join(blocks)
        if rng.random() < 0.2:
            inner = f"<div>{inner}</div>"
        return rng.choice([lambda: f"<article>{inner}</article>", lambda: f"<main>{inner}</main>", lambda: f"<main><article>{inner}</article></main>", lambda: tag("div", inner, "content", "article", "post", "entry-content", "main", "story", "post-body"), lambda: tag("section", inner, "content", "article", "")])()

    pages = []
    for _ in range(many):
        before, after = [], []
        if rng.random() < 0.85:
            before.append(rng.choice([lambda: tag("nav", links(rng.randint(2, 8))), lambda: tag("div", links(rng.randint(2, 8)), "nav", "menu", "navbar", "breadcrumb"), lambda: tag("header", tag("div", words(1, 3), "logo", "brand") + links(rng.randint(2, 6)))])())
        for chance, make in (
            (0.3, lambda: tag("header", rng.choice([words(1, 4), tag("p", words(2, 8)), tag("h2", words(1, 4))]), "", "site-header", "masthead", "banner")),
            (0.6, lambda: tag("div", clutter(notes(1, 3)), "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-banner")),
            (0.35, lambda: tag(rng.choice(["div", "section"]), clutter(notes(1, 3)), "cookie", "notice", "consent", "cookie-notice", "alert", "newsletter", "popup")),
            (0.3, lambda: tag("form", rng.choice([words(1, 4), tag("p", notes(1, 2)), f"<label>{words(1, 2)}</label><input>"]), "", "search", "login")),
        ):
            if rng.random() < chance:
                (before if rng.random() < 0.65 else after).append(make())
        if rng.random() < 0.4:
            side = rng.choice([lambda: tag("aside", links(4) + clutter(notes(1, 3))), lambda: tag("aside", clutter(notes(1, 4))), lambda: tag("div", tag("h3", words(1, 3)) + rng.choice([links(5), clutter(notes(1, 3))]), "sidebar", "related", "widget", "recommended")])()
            (before if rng.random() < 0.3 else after).append(side)
        if rng.random() < 0.4:
            one = lambda: tag(rng.choice(["div", "li", "article", "p"]), rng.choice([sentences(1, 4), tag("p", notes(1, 4))]), "", "comment", "reply")
            after.append(tag(rng.choice(["div", "section", "section"]), tag("h3", words(1, 3)) + "".join(one() for _ in range(rng.randint(1, 5))), "comments", "comment-list", "discussion", "replies", "responses comments"))
        if rng.random() < 0.3:
            after.append(tag("div", words(1, 5), "share", "social", "tags"))
        if rng.random() < 0.9:
            foot = rng.choice([f"&copy; {words(1, 3)}", f"&copy; {words(1, 2)} &middot; {notes(1, 2)}", tag("p", notes(1, 3)), links(4) + tag("p", f"&copy; {words(2, 5)}")])
            after.append(rng.choice([lambda: tag("footer", foot), lambda: tag("footer", foot), lambda: tag("div", foot, "footer", "site-footer", "copyright", "legal")])())
        rng.shuffle(before)
        middle = "".join(before) + content() + "".join(after)
        if rng.random() < 0.3:
            middle = tag("div", middle, "", "wrapper", "container", "page")
        pages.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{middle}</body></html>", _MARK))
    return pages


@cache
def default_model() -> Model:
    return train(labelled_pages())


# --- extraction ----------------------------------------------------------------------------------


def blocks_of(html: str, model: Model) -> list[str]:
    """The texts of the content blocks, in page order."""
    nodes = in_order(parse(html))
    keep = {id(n): p >= 0.5 for n, p in zip(nodes, model.marginals(nodes), strict=True)}
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACES.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list = [nodes[0]]
    while todo:
        item = todo.pop()
        if isinstance(item, Node):
            flush()
            todo.append(flush)
            wanted = keep[id(item)]
            todo.extend(p if isinstance(p, Node) else ("" if not wanted else " " if p is None else p) for p in reversed(item.parts))
        elif callable(item):
            item()
        else:
            run.append(item)
    return out


def main_text(html: str | None, model: Model) -> str:
    return "\n\n".join(blocks_of(html, model)) if html else ""


def extracted(pages: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """The rows without the html, with (text, n_chars); columns of those names are replaced."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, html_col):
                texts = [main_text(x, own) for x in part.column(html_col).to_pylist()]
                kept = [part.column(c) for c in others]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*others, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "text string", "n_chars long"])
    return pages.select(*others, html_col).transform(mapped, run, schema)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
