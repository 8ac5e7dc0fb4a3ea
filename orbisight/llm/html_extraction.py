"""Main-text extraction with a tree-structured graphical model over the DOM.

Every element that can carry its own decision is a node with a binary label (content or not).  A logistic unary
potential looks at the element alone; a 2x2 table couples each node with its parent.  Sum-product messages go up
from the leaves and down from the root, and the text of a node is kept if its content marginal exceeds one half.
Both potentials are fitted to labelled pages: either pages the caller labels, or the seeded ones made here.

Edge cases: null or empty html gives an empty text; markup that never closes is closed at the end of the page;
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
from bisect import bisect_right
from collections.abc import Generator, Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ._common import by_place, place, rows_by_arrow

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_STOP = re.compile("[\"'>]")
_NAMES = re.compile(r"(?:class|id|role|aria-label)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=]|$)|display\s*+:\s*+none|aria-hidden\s*+=\s*+[\"']?true", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Their text is no text of the page; that of formulas, drawings and fall-backs is.
RAW = {"script", "style", "textarea", "title", "template", "iframe", "noembed", "select"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "col", "area", "base", "embed", "source", "track", "param"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mrow msub msup mfrac msqrt mtext semantics noscript object canvas svg g text tspan".split())
CLOSES_P = set("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"ul", "ol", "dl", "table", "menu", "body", "article", "section", "div", "main", "select"}
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "fieldset"}
MAIN = {"article", "main"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption"}
AGAINST = set(
    "nav navbar navigation menu menubar header masthead footer foot sidebar side aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "alert popup modal overlay comment comments commentlist reply replies respond discussion disqus form login signup subscribe newsletter share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager "
    "widget toolbar search copyright legal tags skip toc contentinfo complementary dialog".split()
)
FOR = set("article content main post entry story body text blog page prose".split())


class Node:
    __slots__ = ("children", "features", "link", "names", "own", "parent", "runs", "tag", "total", "weak")

    def __init__(self, tag: str, parent: int, names: frozenset[str] = frozenset(), weak: bool = False):
        self.tag, self.parent, self.names, self.weak = tag, parent, names, weak
        self.own = self.total = self.link = 0
        self.children: list[int] = []


def tokens(page: str) -> Generator[tuple[str, str, bool, str], str | None, None]:
    """Text (text, "", False, "") and tags ("", name, closing, attributes) in page order, in time linear in the page.

    A tag ends at the first ``>`` outside of quotes; where a quote never closes, at the first one of all.  After a script and
    its like, the caller sends the name, and everything up to the closing tag is skipped.
    """
    at, said, size, last = 0, 0, len(page), page.rfind(">")
    unclosed: dict[str, int] = {}  # from where on a quote has no partner
    lost = -1  # tags that begin before this are known to reach a quote that never closes
    while True:
        at = page.find("<", at)
        if at < 0 or at > last and not page.startswith("<!--", at):
            break
        start, name, closing, attributes = at, "", False, ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            at = page.find(">", at) + 1
        else:
            closing = page.startswith("/", at + 1)
            found = _NAME.match(page, at + 1 + closing)
            if found is None:
                at += 1
                continue
            name, here = found[0].lower(), found.end()
            end = -1
            while start >= lost:
                stop = _STOP.search(page, here)
                if stop is None:
                    break
                if stop[0] == ">":
                    end = stop.start()
                    break
                mark = stop[0]
                partner = -1 if stop.start() >= unclosed.get(mark, size) else page.find(mark, stop.end())
                if partner < 0:
                    unclosed[mark] = min(unclosed.get(mark, size), stop.start())
                    lost = stop.start()
                    break
                here = partner + 1
            if end < 0:
                end = page.find(">", found.end())
            attributes, at = page[found.end() : end], end + 1
        if start > said:
            yield page[said:start], "", False, ""
        said = at
        if name:
            raw = yield "", name, closing, attributes
            if raw:
                close = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.I).search(page, at)
                end = page.find(">", close.end()) if close else -1
                said = at = size if end < 0 else end + 1
                yield "", "", False, ""
    if said < size:
        yield page[said:], "", False, ""


class Open:
    """The open elements, with the places of each name, so that no step walks the stack."""

    def __init__(self) -> None:
        self.names, self.owners = ["#root"], [0]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]  # places of elements that aren't inline

    def add(self, name: str, owner: int) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name not in INLINE:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.owners.append(owner)

    def last(self, names: Iterable[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def first_after(self, names: Iterable[str], fence: int) -> int:
        """The outermost of these names inside the fence."""
        found = [p[k] for n in names if (p := self.places.get(n)) and (k := bisect_right(p, fence)) < len(p)]
        return min(found, default=0)

    def shut(self, at: int) -> None:
        while len(self.names) > at:
            name = self.names.pop()
            self.owners.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The nodes, parents first, and the runs of text (node, text); a run with node -1 parts two blocks."""
    nodes, runs, stack = [Node("#root", -1)], [], Open()
    found = tokens(page)
    token = next(found, None)
    while token is not None:
        raw, tag, closing, attributes = token
        skip = None
        if raw:
            text = _html.unescape(raw) if "&" in raw else raw
            k, n = stack.owners[-1], len(text.strip())
            runs.append((k, text))
            nodes[k].own += n
            if stack.places.get("a"):
                nodes[k].link += n
        elif tag:
            if tag not in INLINE:
                runs.append((-1, ""))
            if closing:
                at = stack.last((tag,))
                if at and not (tag in INLINE and at < stack.blocks[-1]):
                    stack.shut(at)
            elif tag in RAW:
                skip = None if attributes.endswith("/") else tag
            elif tag not in VOID:
                shut = stack.blocks[-1] if tag in CLOSES_P and stack.names[stack.blocks[-1]] == "p" else 0
                if tag in SIBLINGS:
                    fence = stack.last(FENCES - SIBLINGS[tag])
                    at = stack.first_after(SIBLINGS[tag], fence) if tag == "tr" else stack.last(SIBLINGS[tag])
                    shut = at if at > fence else shut
                if shut:
                    stack.shut(shut)
                names = frozenset(w.lower() for x in _NAMES.findall(attributes) for w in _PIECES.findall("".join(x)))
                if attributes and _HIDDEN.search(attributes):
                    names |= {"popup"}
                if tag in INLINE and not names & AGAINST:
                    stack.add(tag, stack.owners[-1])
                else:
                    nodes.append(Node(tag, stack.owners[-1], names, tag in INLINE))
                    nodes[stack.owners[-1]].children.append(len(nodes) - 1)
                    stack.add(tag, len(nodes) - 1)
        try:
            token = found.send(skip)
        except StopIteration:
            token = None
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        node.total += node.own
        if node.parent >= 0:
            nodes[node.parent].total += node.total
            nodes[node.parent].link += node.link
    return nodes, runs


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node: the element itself, and whether the page has a main element that it lies outside of."""
    main = [n.tag in MAIN or bool(n.names & FOR) and not n.names & AGAINST and n.tag not in CHROME and n.tag not in ("#root", "html", "body") for n in nodes]
    within, above = list(main), list(main)
    for k in range(1, len(nodes)):
        within[k] = within[k] or within[nodes[k].parent]
    for k in range(len(nodes) - 1, 0, -1):
        above[nodes[k].parent] = above[nodes[k].parent] or above[k]
    return np.array(
        [
            (
                1.0, bool(n.names & AGAINST), main[k], n.tag in CHROME, n.tag in MAIN, n.tag in PROSE, n.tag in PROSE and n.own > 0,
                n.tag in ("div", "section", "table", "tbody", "tr", "ul", "ol", "dl", "center"), n.tag in ("#root", "html", "body"),
                n.own > 0, n.link / n.total if n.total else 0.0, above[0] and not (within[k] or above[k]),
            )
            for k, n in enumerate(nodes)
        ],
        dtype=float,
    )


def marginals(nodes: list[Node], unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """P(content) of every node by sum-product on the tree; unary holds log odds, pair log potentials [parent, child]."""
    n, table = len(nodes), np.exp(pair).tolist()
    own = [(1.0 / (1.0 + o), o / (1.0 + o)) for o in np.exp(np.clip(unary, -30, 30)).tolist()]
    up, sent = [list(x) for x in own], [(1.0, 1.0)] * n
    for k in range(n - 1, 0, -1):
        a, b = up[k]
        m0, m1 = a * table[0][0] + b * table[0][1], a * table[1][0] + b * table[1][1]
        sent[k] = (m0 / (m0 + m1), m1 / (m0 + m1))
        mine = up[nodes[k].parent]
        mine[0], mine[1] = mine[0] * sent[k][0], mine[1] * sent[k][1]
        total = mine[0] + mine[1]
        mine[0], mine[1] = mine[0] / total, mine[1] / total
    belief, out = [tuple(up[0])] * n, np.empty(n)
    out[0] = up[0][1] / (up[0][0] + up[0][1])
    for k in range(1, n):
        b = belief[nodes[k].parent]
        c0, c1 = b[0] / max(sent[k][0], 1e-300), b[1] / max(sent[k][1], 1e-300)
        d0, d1 = c0 * table[0][0] + c1 * table[1][0], c0 * table[0][1] + c1 * table[1][1]
        x0, x1 = up[k][0] * d0, up[k][1] * d1
        belief[k] = (x0 / (x0 + x1), x1 / (x0 + x1))
        out[k] = belief[k][1]
    return out


def extract(page: str | None, model: tuple[np.ndarray, np.ndarray]) -> str:
    """The main text of one page: blocks in page order, one space between words."""
    if not page:
        return ""
    nodes, runs = parse(page)
    content = marginals(nodes, features(nodes) @ model[0], model[1]) > 0.5
    return " ".join("".join(" " if k < 0 else text if content[k] else "" for k, text in runs).split())


def fit(pages: list[tuple[list[Node], list[bool]]], rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Unary weights by logistic regression and coupling by smoothed label pairs, both from labelled pages."""
    x = np.concatenate([features(nodes) for nodes, _ in pages])
    y = np.concatenate([np.array(labels, float) for _, labels in pages])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - y) + 1.0 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    pairs = np.ones((2, 2))
    for nodes, labels in pages:
        for k in range(1, len(nodes)):
            pairs[int(labels[nodes[k].parent]), int(labels[k])] += 1
    joint = pairs / pairs.sum()
    return w, np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True))


def labelled_page(rng: random.Random) -> tuple[list[Node], list[bool]]:
    """A made page with true labels; content carries a mark that never reaches the features."""
    word = lambda: "".join(rng.choice(("ba", "co", "di", "lu", "me", "ra", "so", "ti")) for _ in range(rng.randint(1, 3)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    good = lambda tag, text: f"<{tag}>\x01{text}</{tag}>"
    name = lambda *options: rng.choice(("class", "id")) + f'="{rng.choice(options)}"'

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{say(1, 3)}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>"

    def chrome() -> str:
        return rng.choice(
            (
                lambda: f"<nav>{links()}</nav>", lambda: f"<header><h1>{say(1, 4)}</h1>{links()}</header>", lambda: f"<footer>{say(3, 30)}</footer>", lambda: f"<aside><p>{say(3, 40)}</p></aside>",
                lambda: f"<div {name('sidebar', 'side widget')}><h3>{say(1, 3)}</h3>{links()}<p>{say(3, 30)}</p></div>", lambda: f"<div {name('ad', 'advert', 'ads banner', 'sponsored')}>{say(3, 25)}</div>",
                lambda: f"<div {name('cookie-notice', 'notice', 'consent', 'popup')}><p>{say(5, 30)}</p><button>{say(1, 2)}</button></div>",
                lambda: f"<section {name('comments', 'discussion', 'comment-list')}><h2>{say(1, 2)}</h2>" + "".join(f'<div class="comment"><p>{say(4, 60)}</p><p>{say(4, 30)}</p></div>' for _ in range(rng.randint(1, 4))) + "</section>",
                lambda: f"<form><label>{say(1, 3)}</label><input><p>{say(2, 12)}</p><button>{say(1, 1)}</button></form>", lambda: f"<div {name('share', 'related', 'breadcrumbs', 'menu')}>{links()}</div>", lambda: f"<ul {name('menu', 'nav', 'social')}><li>{say(1, 2)}<li>{say(1, 3)}</ul>",
            )
        )()

    def block() -> str:
        return rng.choices(
            (
                lambda: good("p", say(1, rng.choice((4, 20, 120)))), lambda: good(rng.choice(("h2", "h3")), say(1, 8)), lambda: "<ul>\x01" + "".join(good("li", say(1, 20)) for _ in range(rng.randint(2, 5))) + "</ul>", lambda: "<blockquote>\x01" + good("p", say(3, 50)) + "</blockquote>", lambda: good("pre", say(2, 30)),
                lambda: "<table>\x01" + "".join("<tr>\x01" + good("td", say(1, 4)) + good("td", say(1, 4)) + "</tr>" for _ in range(3)) + "</table>", lambda: "<div>\x01" + good("p", say(1, 80)) + "</div>", lambda: f'<p>\x01{say(1, 30)} <a href="/x">{say(1, 4)}</a> {say(0, 30)}</p>', lambda: "<figure>\x01" + good("figcaption", say(2, 12)) + "</figure>",
                chrome,
            ),
            (14, 2, 1, 1, 1, 1, 1, 2, 1, 9),
        )[0]()

    inside = good("h1", say(2, 12)) + "".join(block() for _ in range(rng.randint(1, 12)))
    start, end = rng.choice(
        (("<article>", "</article>"),) * 4 + (("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post-body">', "</div>"), ('<div class="entry">', "</div>"), ("<div>", "</div>"), ("<div>", "</div>"), ("<div><div>", "</div></div>")) + (("", ""),) * 4
    )
    page = "<html><body>" + "".join(chrome() for _ in range(rng.randint(0, 4))) + start.replace(">", ">\x01") + inside + end + "".join(chrome() for _ in range(rng.randint(0, 4))) + "</body></html>"
    marked = [m.start() for m in re.finditer("\x01", page)]
    nodes, runs = parse(page)
    truth = [False] * len(nodes)
    for k, text in runs:
        if "\x01" in text:
            truth[k] = True
            nodes[k].own -= 1
            up = k
            while up >= 0:
                nodes[up].total -= 1
                up = nodes[up].parent
    assert marked
    for k, node in enumerate(nodes):  # what holds the whole page may hold content: its bad children tell by themselves
        if node.tag in ("#root", "html", "body"):
            truth[k] = True
    return nodes, truth


@lru_cache(maxsize=4)
def trained(seed: int = 7, pages: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """The model fitted to ``pages`` seeded labelled pages."""
    rng = random.Random(seed)
    return fit([labelled_page(rng) for _ in range(pages)])


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row; one narrow pass, no shuffle, the model is a few dozen numbers."""
    model = model or trained()
    of = lambda name: F.col(place(pages, name))
    source = by_place(pages).select(of(page_id).cast("long").alias("page_id"), of(url).cast("string").alias("url"), of(html).cast("string").alias("html"))

    def make(page_id: list, url: list, html: list) -> dict:
        text = [extract(x, model) for x in html]
        return {"page_id": page_id, "url": url, "text": text, "n_chars": [len(x) for x in text]}

    return rows_by_arrow(source, "page_id long, url string, text string, n_chars long", make)
