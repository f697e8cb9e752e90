"""Main text of web pages by a tree-structured graphical model of the page's elements.

A page is read into a tree of elements, kept in page order. Each element is content or not. Its own
features (tag, words of class, id and role, text and link lengths, place) give a unary potential,
and each parent-child pair a pairwise one. One upward and one downward sum-product pass give the
marginals; a text block is kept when its marginal reaches one half. The weights are fitted by
maximum likelihood on labelled pages: ``labelled_pages`` writes as many as are asked for, of varied
layout, and ``fit`` also takes others.

Result for odd input: null or empty html gives empty text; unclosed and stray tags are mended as
browsers do for block elements; very long pages are read whole; repeated rows give repeated
results. Extra columns are ignored. A page takes time in proportion to its length.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import arrow_map

SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: A comment (to its end or the page's), a declaration, or the start of a tag. All parts are possessive: no text is read twice.
TOKEN = re.compile(r"<!--|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)")
#: Inside a tag: its end, or the quote that opens a value.
IN_TAG = re.compile(r">|=[\x20\t\n\r\f]*+([\"'])")
ATTRIBUTE = re.compile(r"([^\s=\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
ZEROS = re.compile(r"&#([xX]?)0++(?=[0-9a-fA-F])")
BEYOND = re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{7,}+);?")

# Fixed values of the HTML standard.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
    "var", "wbr", "input", "button",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "td", "th", "blockquote"}

GOOD_NAME = re.compile(r"article|content|main|post|entry|story|body|text|prose|markdown", re.I)
NAME_PARTS = re.compile(r"[^\W_]++")
BAD_WORDS = set(
    "ad ads banner menu breadcrumb breadcrumbs head header masthead related share social comment comments disqus reply replies respond cookie cookies consent "
    "gdpr notice alert popup modal overlay newsletter signup login search form copyright legal tag tags meta byline author pager pagination skip toolbar tab tabs hidden paywall".split()
)
BAD_STARTS = ("advert", "sponsor", "promo", "nav", "foot", "side", "widget", "recommend", "subscri")


def named_badly(name: str) -> bool:
    """Whether a class, id or role has a word that menus, adverts, comments and the like go by."""
    return any(w in BAD_WORDS or w.startswith(BAD_STARTS) for w in NAME_PARTS.findall(name.lower()))


TAG_CLASSES = {
    "article": 0, "main": 1, "section": 2, "div": 3, "p": 4, "h1": 5, "h2": 6, "h3": 6, "h4": 6, "h5": 6, "h6": 6, "li": 7, "ul": 8, "ol": 8, "dl": 8,
    "nav": 9, "footer": 10, "header": 11, "aside": 12, "form": 13, "fieldset": 13, "blockquote": 14, "pre": 14, "td": 15, "th": 15, "tr": 15, "table": 15, "tbody": 15,
    "figure": 16, "figcaption": 16, "body": 17, "html": 17, "dialog": 18, "menu": 9, "dt": 7, "dd": 7, "head": 19,
}
N_TAGS = 21
N_FEATURES = N_TAGS + 9
N_EDGE = 4


class Node:
    __slots__ = ("hidden", "link", "name", "parent", "parts", "tag", "text")

    def __init__(self, tag: str, parent: int, name: str):
        self.tag, self.parent, self.name = tag, parent, name
        self.parts: list[str] = []
        self.link, self.text = 0, ""


def unescaped(text: str) -> str:
    """Text with its character references decoded; numbers of any length."""
    if "&#" in text:
        text = BEYOND.sub("\ufffd", ZEROS.sub(r"&#\1", text))
    return html.unescape(text)


class Tags:
    """Finds the ends of tags, going through the page once.

    A quote opens a value only after an equals sign, and only if the same quote comes again. If a
    tag has no end that way, quotes mean nothing from there on.
    """

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.last = {q: page.rfind(q) for q in "\"'"}

    def end(self, start: int) -> int:
        """Place of the ``>`` of the tag whose name ends at ``start``; -1 if the page has none."""
        at = start
        while self.quotes:
            m = IN_TAG.search(self.page, at)
            if m is None:
                self.quotes = False
            elif m[1] is None:
                return m.start()
            else:
                at = m.end() if m.end() > self.last[m[1]] else self.page.index(m[1], m.end()) + 1
        return self.page.find(">", start)


class Open:
    """The open elements, with the places of each tag's: closing looks at none that it doesn't close."""

    def __init__(self):
        self.stack, self.tags, self.at, self.scopes = [0], ["html"], {}, []

    def push(self, node: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)
        self.tags.append(tag)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.stack.pop()
            tag = self.tags.pop()
            self.at[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of these tags, 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


def parse(page: str) -> list[tuple[Node, bool]]:
    """Nodes in page order; a node is an element, or a run of inline text (True) below one.

    Time is linear in the page's length, whatever it holds.
    """
    nodes: list[tuple[Node, bool]] = [(Node("html", -1, ""), False)]
    opened, tags = Open(), Tags(page)
    run = -1  # the open run of text
    links, at = 0, 0

    def text(raw: str) -> None:
        nonlocal run
        if not raw:
            return
        if run < 0:
            if SPACE.fullmatch(raw):
                return
            nodes.append((Node("#text", opened.stack[-1], ""), True))
            run = len(nodes) - 1
        node = nodes[run][0]
        node.parts.append(raw)
        if links:
            node.link += len(raw)

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                close = page.find("-->", at)
                at = end if close < 0 else close + 3
            continue
        close = tags.end(at)
        if close < 0:  # no tag ends any more
            text(page[m.start() :])
            break
        inside, at = page[at:close], close + 1
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE and tag not in VOID:
                run = -1
                place = opened.last(tag)
                if place and (tag != "p" or place == len(opened.stack) - 1):
                    opened.cut(place)
                    links = 0
            continue
        closed = inside.rstrip().endswith("/")
        if tag in RAW:
            if not closed:
                over = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*+>?", re.I).search(page, at)
                at = over.end() if over else end
            if tag not in ("noscript", "textarea", "select"):
                continue
            run = -1
            continue
        if tag in INLINE:
            if tag == "a":
                links = 1
            elif tag in ("br", "input", "button", "img"):
                text(" ")
            continue
        run = -1
        if tag in VOID:
            continue
        if tag in CLOSES_P and opened.tags[-1] == "p":
            opened.cut(len(opened.stack) - 1)
            links = 0
        if tag in SAME_CLOSES:
            place = opened.last(*SAME_CLOSES[tag])
            # A scope opened inside the item keeps the item open; a row ends with its cells.
            scope = opened.last("table") if tag == "tr" else opened.scopes[-1] if opened.scopes else 0
            if place and place >= scope:
                opened.cut(place)
        name = " ".join(
            (a[1] or a[2] or a[3]) for a in (x.groups() for x in ATTRIBUTE.finditer(inside)) if a[0].lower() in ("class", "id", "role", "itemprop", "aria-label") and (a[1] or a[2] or a[3])
        ) if inside.strip() else ""
        nodes.append((Node(tag, opened.stack[-1], name), False))
        if not closed:
            opened.push(len(nodes) - 1, tag)
    for node, is_text in nodes:
        if is_text:
            node.text = SPACE.sub(" ", unescaped("".join(node.parts))).strip(" ")
            node.parts = []
    return nodes


def features(nodes: list[tuple[Node, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Unary features of each node and the parent of each."""
    n = len(nodes)
    parent = np.array([x.parent for x, _ in nodes])
    length = np.array([len(x.text) for x, _ in nodes], float)
    link = np.array([x.link for x, _ in nodes], float)
    link = np.minimum(link, np.where(np.array([t for _, t in nodes]), length, 0))
    under, under_link = length.copy(), link.copy()
    for k in range(n - 1, 0, -1):
        under[parent[k]] += under[k]
        under_link[parent[k]] += under_link[k]
    x = np.zeros((n, N_FEATURES))
    for k, (node, is_text) in enumerate(nodes):
        x[k, N_TAGS - 1 if is_text else TAG_CLASSES.get(node.tag, 18)] = 1
        if node.name:
            good, bad = bool(GOOD_NAME.search(node.name)), named_badly(node.name)
            x[k, N_TAGS] = good and not bad
            x[k, N_TAGS + 1] = bad
        if is_text:
            x[k, N_TAGS + 6] = node.text[-1:] in ".!?:;…。\"'”»"
    share = under_link / np.maximum(under, 1)
    x[:, N_TAGS + 2] = share
    x[:, N_TAGS + 3] = np.log1p(under) / 10
    x[:, N_TAGS + 4] = share > 0.5
    x[:, N_TAGS + 5] = under / max(1.0, under[0])
    x[:, N_TAGS + 7] = under == 0
    x[:, N_TAGS + 8] = 1
    return x, parent


def passes(unary: np.ndarray, parent: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the nodes ``(n, 2)`` and of the edges to their parents ``(n, 2, 2)``.

    Sum-product, upward from the leaves and then downward, on potentials scaled against overflow.
    ``edge[p, c]`` is the log potential of a parent in state p with a child in state c.
    """
    n = len(unary)
    e = np.exp(edge - edge.max()).tolist()
    (e00, e01), (e10, e11) = e
    shifted = np.exp(unary - unary.max(1, keepdims=True))
    up0, up1 = shifted[:, 0].tolist(), shifted[:, 1].tolist()
    par = parent.tolist()
    msg = [(1.0, 1.0)] * n
    for k in range(n - 1, 0, -1):
        a, b = up0[k], up1[k]
        m0, m1 = e00 * a + e01 * b, e10 * a + e11 * b
        s = m0 + m1
        m0, m1 = m0 / s, m1 / s
        msg[k] = (m0, m1)
        p = par[k]
        x, y = up0[p] * m0, up1[p] * m1
        s = x + y
        up0[p], up1[p] = x / s, y / s
    node = np.zeros((n, 2))
    pair = np.zeros((n, 2, 2))
    s = up0[0] + up1[0]
    belief = [(up0[0] / s, up1[0] / s)] + [(0.0, 0.0)] * (n - 1)
    for k in range(1, n):
        b0, b1 = belief[par[k]]
        m0, m1 = msg[k]
        a, b = up0[k], up1[k]
        t0, t1 = b0 / m0, b1 / m1
        p00, p01, p10, p11 = t0 * e00 * a, t0 * e01 * b, t1 * e10 * a, t1 * e11 * b
        s = p00 + p01 + p10 + p11
        pair[k] = ((p00 / s, p01 / s), (p10 / s, p11 / s))
        belief[k] = ((p00 + p10) / s, (p01 + p11) / s)
    node[:] = belief
    return node, pair


class Model:
    """Weights of the unary features and the four parent-child potentials."""

    def __init__(self, weights: np.ndarray, edge: np.ndarray):
        self.weights, self.edge = weights, edge

    def marginals(self, nodes: list[tuple[Node, bool]]) -> np.ndarray:
        x, parent = features(nodes)
        unary = np.zeros((len(nodes), 2))
        unary[:, 1] = x @ self.weights
        return passes(unary, parent, self.edge)[0][:, 1]

    def text(self, page: str | None) -> str:
        nodes = parse(page or "")
        if not any(t and x.text for x, t in nodes):
            return ""
        content = self.marginals(nodes)
        return "\n".join(x.text for (x, is_text), m in zip(nodes, content, strict=True) if is_text and x.text and m >= 0.5)


def fit(pages: list[tuple[str, str]], rounds: int = 100, rate: float = 0.2, ridge: float = 2e-4) -> Model:
    """Maximum likelihood on ``(html, main text)`` pairs, by Adam over whole-set gradients.

    A text run is content if its text is a line of the main text; an element is content if more
    than half of the text below it is.
    """
    data = []
    for page, main in pages:
        nodes = parse(page)
        lines = set(main.split("\n"))
        x, parent = features(nodes)
        good = np.array([len(n.text) if t and n.text in lines else 0 for n, t in nodes], float)
        total = np.array([len(n.text) if t else 0 for n, t in nodes], float)
        for k in range(len(nodes) - 1, 0, -1):
            good[parent[k]] += good[k]
            total[parent[k]] += total[k]
        data.append((x, parent, (2 * good > total).astype(int)))
    theta = np.zeros(N_FEATURES + N_EDGE)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        gradient = -ridge * theta * len(data)
        weights, edge = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        for x, parent, y in data:
            unary = np.zeros((len(y), 2))
            unary[:, 1] = x @ weights
            node, pair = passes(unary, parent, edge)
            gradient[:N_FEATURES] += x.T @ (y - node[:, 1])
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[parent[1:]], y[1:]), 1)
            gradient[N_FEATURES:] += (seen - pair[1:].sum(0)).ravel()
        gradient /= len(data)
        m1 = 0.9 * m1 + 0.1 * gradient
        m2 = 0.99 * m2 + 0.01 * gradient**2
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8) * min(1, 4 * (1 - step / (rounds + 1)))
    return Model(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, str]]:
    """``n`` made-up pages of varied layout with their main text."""
    r = random.Random(seed)
    sounds = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()

    def word() -> str:
        return "".join(r.choice(sounds) for _ in range(r.randint(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(r.randint(low, high)))

    def sentence(low: int = 1, high: int = 22) -> str:
        return words(low, high).capitalize() + r.choice("......!?")

    def prose() -> str:
        return " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5, 8))))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(k))

    def box(kind: str, inside: str) -> str:
        tag = r.choice(("div", "div", "div", "section", "aside"))
        return f'<{tag} {r.choice(("class", "class", "id"))}="{kind}">{inside}</{tag}>'

    def small() -> str:
        return r.choice((sentence(3, 14), f"<p>{prose()}</p>", f"<span>{sentence(2, 6)}</span>", f"<h3>{words(1, 4)}</h3><p>{sentence()}</p>"))

    def junk() -> str:
        return r.choice((
            lambda: box(r.choice(("ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo")), small()),
            lambda: box(r.choice(("share", "social-share", "share-buttons")), f"<ul>{links(3)}</ul>"),
            lambda: box(r.choice(("newsletter", "signup", "subscribe")), f'<p>{sentence()}</p><form action="/x"><label>{words(1, 3)}</label><input name="q"><button>{word()}</button></form>'),
            lambda: f'<aside class="{r.choice(("related", "sidebar", "widget", "promo"))}"><h3>{words(1, 4)}</h3><ul>{links(r.randint(2, 5))}</ul></aside>',
            lambda: f"<form><p>{sentence()}</p><label>{words(1, 3)}</label> <button>{word()}</button></form>",
            lambda: box(r.choice(("notice", "alert", "cookie-notice")), small()),
        ))()

    def comments() -> str:
        one = r.choice(("comment", "comment-body", "reply"))
        inside = "".join(f'<div class="{one}"><p class="author">{words(1, 2)}</p><p>{prose()}</p></div>' for _ in range(r.randint(1, 5)))
        return r.choice((f'<section id="comments"><h2>{words(1, 2)}</h2>{inside}</section>', f'<div class="comments">{inside}</div>', f'<ol class="comment-list">{inside}</ol>'))

    out = []
    for _ in range(n):
        main: list[str] = []
        body: list[str] = []

        def add(tag: str, text: str, close: bool = True, main: list[str] = main, body: list[str] = body) -> None:
            main.append(text)
            shown = html.escape(text)
            if tag == "p" and r.random() < 0.25:
                first, _, rest = shown.partition(" ")
                shown = r.choice((f"<b>{shown}", f"<em>{first}</em> {rest}", f'<a href="/{word()}">{first}</a> {rest}', f"{first}\n  {rest}"))
            body.append(f"<{tag}>{shown}" + r.choice(("", "<br>")) * (not close) + f"</{tag}>" * close)

        title = words(2, 10).capitalize()
        headed = r.random() < 0.8
        if headed:
            add("h1", title)
        for _ in range(r.choice((1, 1, 2, 3, 5, 9, 15))):
            kind = r.random()
            if kind < 0.75:
                text = prose()
                if r.random() < 0.2:
                    text = " ".join(w + r.choice(("%%%", "***", "&&&", "###", "$$$")) for w in text.split())
                add("p", text, r.random() < 0.85)
            elif kind < 0.83:
                add(r.choice(("h2", "h3")), words(1, 6).capitalize())
            elif kind < 0.89:
                items = [sentence(2, 9) for _ in range(r.randint(2, 5))]
                main.extend(items)
                body.append("<ul>" + "".join(f"<li>{html.escape(i)}</li>" for i in items) + "</ul>")
            elif kind < 0.93:
                text = prose()
                main.append(text)
                body.append(f"<blockquote><p>{html.escape(text)}</p></blockquote>")
            elif kind < 0.95:
                cells = [[words(1, 3) for _ in range(2)] for _ in range(r.randint(1, 3))]
                main.extend(c for row in cells for c in row)
                body.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in cells) + "</table>")
            else:
                body.append(junk())
        content = "".join(body)
        if headed and r.random() < 0.2:
            first = body[0]
            content = f"<header>{first}</header>" + "".join(body[1:])
        holder = r.choice(("article", "article", "article", "main", "mainarticle", "div", "section", "plain", "role"))
        name = r.choice(("content", "main-content", "post", "post-body", "entry-content", "article-body", "story"))
        content = {
            "article": f"<article>{content}</article>", "main": f"<main>{content}</main>", "mainarticle": f"<main><article>{content}</article></main>",
            "div": f'<div id="{name}">{content}</div>', "section": f'<section class="{name}">{content}</section>',
            "plain": f"<div>{content}</div>", "role": f'<div role="main">{content}</div>',
        }[holder]
        menu = r.choice((
            f"<nav><ul>{links(r.randint(2, 9))}</ul></nav>", f'<div class="menu"><ul>{links(4)}</ul></div>', f'<ul class="nav">{links(5)}</ul>',
            "<nav>" + " | ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(4)) + "</nav>",
        ))
        head = r.choice((menu, f"<header>{menu}</header>", f'<header><p>{words(1, 5)}</p>{menu}</header>', f'<div id="header"><p class="tagline">{sentence(2, 8)}</p>{menu}</div>', menu + f"<header><h2>{words(1, 3)}</h2></header>"))
        foot = r.choice((
            f"<footer>&copy; {word()}.example.com &middot; {sentence()}</footer>", f"<footer><p>&copy; {words(1, 3)}</p><ul>{links(4)}</ul></footer>",
            f'<div class="footer"><p>{prose()}</p></div>', f'<div id="footer">{sentence()}</div>', f"<footer><p>{prose()}</p></footer>",
        ))
        before = "".join(junk() for _ in range(r.choice((0, 1, 1, 2))))
        after = (comments() if r.random() < 0.4 else "") + "".join(junk() for _ in range(r.choice((0, 0, 1, 2))))
        if r.random() < 0.3:
            after += f'<aside class="sidebar"><h3>{words(1, 3)}</h3><p>{prose()}</p><ul>{links(3)}</ul></aside>'
        parts = [head, f"<!-- {word()} -->", before, content, after, foot]
        if r.random() < 0.2:
            content = parts.pop(3)
            parts.insert(3, f'<div class="{r.choice(("wrapper", "container", "page", "row"))}">{content}{parts.pop(3)}</div>')
        script = '<script>var t="</p>";track(0);</script>' if r.random() < 0.6 else ""
        out.append((
            f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>p{{margin:0}}</style>{script}</head><body>'
            + "".join(parts) + ("</body></html>" if r.random() < 0.9 else ""),
            "\n".join(main),
        ))
    return out


@lru_cache
def trained(pages: int = 400, rounds: int = 100) -> Model:
    """The model fitted on ``pages`` made-up labelled pages."""
    return fit(labelled_pages(pages), rounds)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text`` of each row of ``pages (page_id, url, html)``; no shuffle."""
    model = model or trained()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return arrow_map(rows, run, "page_id long, url string, text string")
