"""Main text of web pages by a tree-structured graphical model.

Block elements of a page are the nodes of a tree; each is content or not. A node's features (tag, words in its class
and id, link density, length, place) give a unary potential, parent and child are coupled by a potential that
depends on the child's kind, and sum-product messages, upward from the leaves and downward from the root, give each
node's content marginal. The weights maximise the likelihood of labelled pages (`TRAINING_PAGES` pages of
html_pages, a fixed bound) by exact gradients from the same marginals. Text in nodes with a marginal over one half
is the page's text, in page order.

Pages are parsed one by one, but messages pass through all pages of a batch together, level by level.

Defined cases: null html gives an empty text; a page without markup is one block;
repeated rows are treated each for itself; null ids and urls pass through; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import html_pages

TRAINING_PAGES = 300

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*+)")
#: What follows a tag's name up to its end; a ">" inside quotes is not the end.
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Elements whose inside is not looked at. Without their end, the first ones run to the end of the page.
_RAW = {"script", "style", "iframe", "textarea", "title", "noscript", "xmp"}
_SKIPPED = _RAW | {"template", "svg", "select", "button", "head"}
_ENDS = {n: re.compile(f"</{n}(?=[\\s/>])" + "|<body(?=[\\s>])" * (n == "head"), re.I) for n in _SKIPPED}
#: Elements nested deeper are put beside their parent.
MOST_DEPTH = 512
_GROUPS = {
    "root": ("html", "body"), "nav": ("nav",), "header": ("header",), "footer": ("footer", "address"), "aside": ("aside",),
    "form": ("form", "fieldset", "dialog"), "p": ("p",), "heading": ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), "li": ("li", "dt", "dd"),
    "list": ("ul", "ol", "dl", "menu"), "div": ("div", "center"), "section": ("section", "details", "summary"), "article": ("article", "main"),
    "table": ("table", "tbody", "thead", "tfoot", "tr", "caption"), "cell": ("td", "th"), "quote": ("blockquote", "pre"), "figure": ("figure", "figcaption"),
}
_TAG = {t: i for i, (_, tags) in enumerate(_GROUPS.items()) for t in tags}
_KINDS = {
    "content": "content article post entry story text body main articlebody prose",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toolbar pagination pager tabs topnav submenu",
    "header": "header masthead topbar logo branding brand",
    "footer": "footer copyright legal bottom foot colophon",
    "side": "sidebar aside widget related rail recommended recommendations popular trending sidecolumn more",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adslot adsense",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe subscription announcement paywall toast",
    "comment": "comment comments reply replies respond discussion disqus reader readers",
    "form": "form search login signup signin register contact feedback",
    "share": "share sharing social follow tweet",
}
_KIND = {w: i for i, words in enumerate(_KINDS.values()) for w in words.split()}
_VALUE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_SPACES = re.compile(r"\s+")
_attribute_memory: dict[str, int] = {}


def _kinds_of(attributes: str) -> int:
    """Bits of the kinds that class, id and role name, and one more where the element is hidden."""
    got = _attribute_memory.get(attributes)
    if got is None:
        got = 0
        for m in _VALUE.finditer(attributes):
            for w in _PIECE.findall(m[1] or m[2] or m[3] or ""):
                k = _KIND.get(w.lower())
                if k is not None:
                    got |= 1 << k
        if _HIDDEN.search(attributes):
            got |= 1 << len(_KINDS)
        if len(_attribute_memory) < 50_000:
            _attribute_memory[attributes] = got
    return got


class Tree:
    """Block elements of one page: parallel lists, node 0 is the page itself."""

    __slots__ = ("parent", "depth", "tag", "kinds", "chars", "words", "links", "segments")

    def __init__(self):
        self.parent, self.depth, self.tag, self.kinds = [-1], [0], [_TAG["html"]], [0]
        self.chars, self.words, self.links = [0], [0], [0]
        self.segments: list[tuple[int, str]] = []


def tags_of(page: str) -> Iterator[tuple[str, str | None, bool, str]]:
    """(text before, tag name, whether it closes, attributes) in page order; comments, declarations and the inside of
    skipped elements are left out. Each character is passed over a bounded number of times, whatever is left open:
    where an end was once not found, it is not looked for again."""
    at, n = 0, len(page)
    last_end = page.rfind(">")
    quotes, missing, text = True, set(), []
    while at < n:
        i = page.find("<", at)
        if i < 0 or i > last_end and not page.startswith("<!--", i):
            text.append(page[at:])
            break
        text.append(page[at:i])
        if page.startswith(("<!", "<?"), i):
            comment = page.startswith("<!--", i)
            end = page.find("-->" if comment else ">", i + 2)
            if end < 0:
                break
            at = end + (3 if comment else 1)
            continue
        m = _NAME.match(page, i + 1)
        if m is None:
            text.append("<")
            at = i + 1
            continue
        name, closing = m[1].lower(), page[i + 1] == "/"
        rest = _REST.match(page, m.end()) if quotes else None
        if rest is None:
            # A quote that is never closed: from here on the next ">" ends a tag.
            quotes = False
            at = page.find(">", m.end()) + 1
            attributes = page[m.end() : at - 1]
        else:
            attributes, at = rest[1], rest.end()
        if name in _SKIPPED and not closing and name not in missing:
            end = _ENDS[name].search(page, at)
            if end is not None:
                close = page.find(">", end.end())
                at = end.start() if page.startswith(("<b", "<B"), end.start()) else n if close < 0 else close + 1
                continue
            missing.add(name)
            if name in _RAW:
                break
        yield "".join(text), name, closing, attributes
        text = []
    if text:
        yield "".join(text), None, False, ""


def parse(page: str) -> Tree:
    t = Tree()
    parent, depth, tags, kinds, chars, words, links, segments = (getattr(t, s) for s in Tree.__slots__)
    stack: list[tuple[int, str]] = [(0, "")]
    open_: dict[str, int] = {}  # how many elements of a name are on the stack
    node, buffer, linked, in_link = 0, [], 0, False

    def flush():
        nonlocal linked
        if buffer:
            text = "".join(buffer)
            if "&" in text:
                text = _html.unescape(text)
            text = " ".join(text.split())
            if text:
                segments.append((node, text))
                chars[node] += len(text)
                words[node] += text.count(" ") + 1
                links[node] += min(linked, len(text))
            buffer.clear()
        linked = 0

    for text, name, closing, attributes in tags_of(page):
        if text:
            buffer.append(text)
            if in_link:
                linked += len(text)
        if name is None:
            continue
        group = _TAG.get(name)
        if group is None:
            if name == "a":
                in_link = not closing
            elif name in _VOID:
                buffer.append(" ")
            continue
        flush()
        in_link = False
        if closing:
            if open_.get(name):
                while True:
                    gone = stack.pop()[1]
                    open_[gone] -= 1
                    if gone == name:
                        break
            node = stack[-1][0]
            continue
        top = stack[-1][1]
        if top == "p" or (top == name and name in ("li", "tr", "td", "th", "dt", "dd")) or (top in ("td", "th") and name in ("td", "th", "tr")):
            open_[stack.pop()[1]] -= 1
            if name == "tr" and stack[-1][1] == "tr":
                open_[stack.pop()[1]] -= 1
        if name == "li" and any(n == "li" for _, n in stack[-3:]) and not any(n in ("ul", "ol", "menu") for _, n in stack[-2:]):
            while stack[-1][1] not in ("ul", "ol", "menu") and len(stack) > 1:
                open_[stack.pop()[1]] -= 1
        up = stack[-1][0]
        if depth[up] >= MOST_DEPTH:
            up = parent[up]
        node = len(parent)
        parent.append(up)
        depth.append(depth[up] + 1)
        tags.append(group)
        kinds.append(_kinds_of(attributes) if attributes else 0)
        for c in (chars, words, links):
            c.append(0)
        stack.append((node, name))
        open_[name] = open_.get(name, 0) + 1
    flush()
    return t


N_KINDS = len(_KINDS) + 1
N_FEATURES = 1 + len(_GROUPS) + N_KINDS + 11


class Forest:
    """The trees of several pages side by side, with their features."""

    def __init__(self, trees: list[Tree]):
        sizes = np.array([len(t.parent) for t in trees], np.int64)
        first = np.cumsum(sizes) - sizes
        self.first = first
        get = lambda name: np.fromiter((x for t in trees for x in getattr(t, name)), np.int64, int(sizes.sum()))
        page = np.repeat(np.arange(len(trees)), sizes)
        self.parent = np.where(get("parent") < 0, -1, get("parent") + first[page])
        self.depth, self.tag = get("depth"), get("tag")
        kinds, chars, words, links = (get(x) for x in ("kinds", "chars", "words", "links"))
        order = np.argsort(self.depth, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(self.depth[order]) > 0]) if len(order) else np.empty(0, np.int64)
        self.levels = np.split(order, edge[1:]) if len(order) else []
        under, under_links = chars.astype(float), links.astype(float)
        for level in self.levels[:0:-1]:
            np.add.at(under, self.parent[level], under[level])
            np.add.at(under_links, self.parent[level], under_links[level])
        n = len(page)
        whole = np.maximum(under[first[page]], 1)
        f = np.zeros((n, N_FEATURES))
        f[:, 0] = 1
        f[np.arange(n), 1 + self.tag] = 1
        at = 1 + len(_GROUPS)
        for k in range(N_KINDS):
            f[:, at + k] = kinds >> k & 1
        at += N_KINDS
        has = chars > 0
        place = (np.arange(n) - first[page]) / sizes[page]
        f[:, at : at + 11] = np.c_[
            has, np.log1p(words) / 5, has & (words < 4), has & (words > 20), links / np.maximum(chars, 1), under_links / np.maximum(under, 1),
            under / whole, (under / whole) > 0.5, place, np.minimum(self.depth, 20) / 10, under == 0,
        ]
        self.features = f


#: Couplings: for each kind of child, four log potentials by (parent, child).
N_WEIGHTS = N_FEATURES + 4 * len(_GROUPS)


def marginals(forest: Forest, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product: P(node is content), and P(parent state, child state) of each node but the roots."""
    n = len(forest.parent)
    pair = weights[N_FEATURES:].reshape(-1, 2, 2)
    unary = np.zeros((n, 2))
    unary[:, 1] = forest.features @ weights[:N_FEATURES]
    psi = pair[forest.tag]
    inward, up = unary.copy(), np.zeros((n, 2))
    for level in forest.levels[:0:-1]:
        s = psi[level] + inward[level][:, None, :]
        up[level] = np.logaddexp(s[:, :, 0], s[:, :, 1])
        np.add.at(inward, forest.parent[level], up[level])
    belief = inward.copy()
    joint = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        p = forest.parent[level]
        cavity = belief[p] - up[level]
        s = cavity[:, :, None] + psi[level] + inward[level][:, None, :]
        s -= s.max(axis=(1, 2), keepdims=True)
        e = np.exp(s)
        joint[level] = e / e.sum(axis=(1, 2), keepdims=True)
        s0, s1 = cavity[:, 0, None] + psi[level][:, 0, :], cavity[:, 1, None] + psi[level][:, 1, :]
        belief[level] = inward[level] + np.logaddexp(s0, s1)
        belief[level] -= belief[level].max(axis=1, keepdims=True)
    d = belief[:, 1] - belief[:, 0]
    return 1 / (1 + np.exp(-np.clip(d, -50, 50))), joint


def train(pages: list[tuple[str, list[int]]], steps: int = 160, rate: float = 0.1, ridge: float = 2e-3) -> np.ndarray:
    """Weights of highest likelihood of the labelled pages (Adam on exact gradients)."""
    trees = [parse(p) for p, _ in pages]
    y = np.array([v for t, (_, labels) in zip(trees, pages) for v in [1, *labels]])
    forest = Forest(trees)
    assert len(y) == len(forest.parent), "labels must name every block element"
    kids = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((len(_GROUPS), 2, 2))
    np.add.at(seen, (forest.tag[kids], y[forest.parent[kids]], y[kids]), 1)
    w, m, v = np.zeros(N_WEIGHTS), np.zeros(N_WEIGHTS), np.zeros(N_WEIGHTS)
    for step in range(1, steps + 1):
        p, joint = marginals(forest, w)
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.tag[kids], joint[kids])
        g = np.r_[forest.features.T @ (y - p), (seen - expected).ravel()] / len(pages) - ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


_trained: dict = {}


def default_weights() -> np.ndarray:
    """Trained once a driver process on the labelled pages; a few hundred numbers."""
    if "w" not in _trained:
        _trained["w"] = train(html_pages.labelled_pages(TRAINING_PAGES))
    return _trained["w"]


def extract_texts(pages: list[str | None], weights: np.ndarray) -> list[str]:
    trees = [parse(p or "") for p in pages]
    if not trees:
        return []
    forest = Forest(trees)
    keep = marginals(forest, weights)[0] > 0.5
    return [" ".join(s for node, s in t.segments if keep[at + node]) for t, at in zip(trees, forest.first.tolist())]


def _rows(weights: np.ndarray, most_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import tokens

        for b in batches:
            pages = b.column(2).to_pylist()
            for s, e in tokens.groups(pages, most_chars):
                texts = extract_texts(pages[s:e], weights)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[s:e], b.column(1)[s:e], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return run


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars. One pass, no shuffle."""
    lean = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in lean.schema.fields}
    w = default_weights() if weights is None else weights
    return lean.mapInArrow(_rows(w, 1_500_000), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
