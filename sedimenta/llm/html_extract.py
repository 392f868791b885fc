"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded so that the labels of a page agree.

A page is parsed into a tree (implied ends, unclosed tags, raw-text elements), in time that follows its length. Each
element has features of its subtree (text, link text, tags, punctuation, density, controls), its tag, its class, id and
role tokens and its ancestors', its depth, its place among its siblings and beside the largest of them, and its place
beside the page's first heading and its article or main element. Trees boosted on generated pages of many templates, of
which some have telling class names, some have neutral ones and some have none, give the probability that an element
holds main text. The decoding maximises the likelihood of the page's labels under one rule: under a dropped element all
is dropped. So no kept element has a dropped ancestor.

The trees are kept in MODEL, which `python -m sedimenta.llm.html_training` makes.

The text of kept elements is cut into blocks at block-level tags. Character references are decoded, white space inside a
block becomes one space, blocks are trimmed and joined by one line feed; empty blocks go.

Null and empty pages have empty text. Pages without tags are one block of text. Very long pages are parsed whole; elements
nested deeper than DEPTH are siblings, as in browsers, and lose no text. After QUOTES tags whose quotes never close, the
quotes of a page's tags are ignored. Rows that repeat give equal rows. Only the named columns are read.
"""

from __future__ import annotations

import json
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by how the parser treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("caption tbody td tfoot th thead tr option body html title legend".split())
IMPLIED = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select", "datalist"})}
NEVER = frozenset("head script style noscript template iframe object svg canvas button select option textarea input audio video map noembed noframes".split())
TAGS = "nav header footer aside form article main section div p ul ol li table td a h1 h2 h3 blockquote pre figure span body".split()
NEGATIVE = frozenset("nav navigation navbar menu header masthead topbar footer foot bottom sidebar side aside rail ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert warning comment comments reply replies respond discussion disqus share sharing social related recommended recommend newsletter subscribe subscription signup login form search breadcrumb breadcrumbs pagination pager widget popup modal overlay copyright legal skip toolbar tags meta".split())
POSITIVE = frozenset("article content main post entry story body text page blog prose document reader detail".split())

#: The file of the trees, beside this module.
MODEL = "html_model.json"
DEPTH, QUOTES = 512, 16

_OPEN = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""([^\s=/"'][^\s=/]*+)\s*+(?:=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_WORDS = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """A parsed page: arrays over elements, and its texts in order with the element and block of each."""

    __slots__ = ("tags", "parents", "tokens", "hidden", "texts", "owners", "blocks", "once")

    def __init__(self, html: str):
        self.tags, self.parents, self.tokens, self.hidden = ["#root"], [-1], [()], [False]
        self.texts: list[str] = []
        self.owners: list[int] = []
        self.blocks: list[int] = []
        self.once: set[str] = set()
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack, block, at, begin, n = [0], 0, 0, 0, len(html)
        tags, open_names, last, quotes = self.tags, Counter(), html.rfind(">"), 0
        no_data = False  # whether no CDATA section ends from here on

        def text(piece: str) -> None:
            if piece and not piece.isspace():
                self.texts.append(unescape(piece) if "&" in piece else piece)
                self.owners.append(stack[-1])
                self.blocks.append(block)
            elif piece:
                space()

        def space() -> None:
            if self.texts and self.blocks[-1] == block and not self.texts[-1][-1:].isspace():
                self.texts.append(" ")
                self.owners.append(self.owners[-1])
                self.blocks.append(block)

        def close(names: tuple[str, ...] | list[str], stops: set[str] | frozenset[str] = frozenset()) -> None:
            if not any(open_names[x] for x in names):
                return
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in names:
                    open_names.subtract(tags[i] for i in stack[k:])
                    del stack[k:]
                    return
                if tags[stack[k]] in stops:
                    return

        while (lt := html.find("<", at)) >= 0:
            at = lt + 1  # where to go on if this isn't a tag
            kind = html[at : at + 1]
            if kind == "!" and html.startswith("!--", at):
                text(html[begin:lt])
                end = html.find("-->", lt + 4)
                begin = at = n if end < 0 else end + 3
                continue
            if lt > last:
                continue
            if kind in ("!", "?"):
                text(html[begin:lt])
                if not no_data and html.startswith("![CDATA[", at):
                    if (end := html.find("]]>", lt + 9)) >= 0:
                        text(html[lt + 9 : end])
                        begin = at = end + 3
                        continue
                    no_data = True
                begin = at = html.find(">", lt) + 1
                continue
            if not (m := _NAME.match(html, lt)):
                continue
            text(html[begin:lt])
            name, attributes = m[1].lower(), ""
            if kind == "/":
                begin = at = html.find(">", m.end()) + 1
                block += name in BLOCK
                close((name,))
                continue
            if quotes < QUOTES and (m := _OPEN.match(html, lt)):
                attributes, begin = m[2], m.end()
            else:
                quotes += 1
                end = html.find(">", lt)
                attributes, begin = html[min(lt + 1 + len(name), end) : end], end + 1
            at = begin
            if name in BLOCK:
                block += 1
                if name in CLOSES_P:
                    close(("p",), _SCOPE)
                if name in IMPLIED:
                    close(IMPLIED[name][0].split(), IMPLIED[name][1])
            if name == "br":
                space()
                continue
            if name in ("html", "body"):
                if name in self.once:
                    continue
                self.once.add(name)
            tokens, hidden = (), False
            if attributes and "=" in attributes or "hidden" in attributes.lower():
                found = []
                for a in _ATTRIBUTE.finditer(attributes):
                    key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if key in ("class", "id", "role"):
                        found += _WORDS.findall(_HUMP.sub(" ", value).lower())
                    elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                        hidden = True
                tokens = tuple(found)
            if len(stack) > DEPTH and name not in VOID:
                open_names[tags[stack.pop()]] -= 1
            tags.append(name)
            self.parents.append(stack[-1])
            self.tokens.append(tokens)
            self.hidden.append(hidden)
            if name in VOID:
                continue
            stack.append(len(tags) - 1)
            if name in RAW:
                stop = _raw_end(name).search(html, at)
                end = html.find(">", stop.end()) if stop else -1
                if name == "title":
                    text(html[at : stop.start() if end >= 0 else n])
                begin = at = end + 1 if end >= 0 else n
                stack.pop()
                block += name in BLOCK
            else:
                open_names[name] += 1
        text(html[begin:])


_SCOPE = frozenset("article aside body div section main td th table button li blockquote header footer nav form fieldset figure #root dd dl ul ol".split())


@lru_cache(maxsize=32)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}", re.I)


FEATURES = 36 + len(TAGS)
CONTROLS = frozenset("button input label select textarea form".split())
_TAG = {x: i for i, x in enumerate(TAGS)}


def features(*pages: Page) -> np.ndarray:
    """A row of features for every element of pages, one page after another.

    Elements are in document order, so a subtree is a run of them.
    """
    sizes = np.array([len(p.tags) for p in pages])
    roots = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    tags = [t for p in pages for t in p.tags]
    tokens = [t for p in pages for t in p.tokens]
    root = np.repeat(roots, sizes)
    up = np.concatenate([np.array(p.parents) for p in pages]) + root
    up[roots] = roots
    parents, first = up.tolist(), roots.tolist()
    size = [1] * n
    depth, negative, positive, above_negative, above_positive, place, siblings, inside = ([0] * n for _ in range(8))
    linked = [False] * n
    for i in range(n - 1, 0, -1):
        if (p := parents[i]) != i:
            size[p] += size[i]
    for i in range(n):
        p, name = parents[i], tags[i]
        if p == i:
            continue
        depth[i] = depth[p] + 1
        linked[i] = linked[p] or name == "a"
        place[i] = siblings[p]
        siblings[p] += 1
        above_negative[i] = above_negative[p] + negative[p]
        above_positive[i] = above_positive[p] + positive[p]
        negative[i], positive[i] = name in NEGATIVE, name in POSITIVE and name != "body"
        for w in tokens[i]:
            negative[i] += w in NEGATIVE
            positive[i] += w in POSITIVE
        inside[i] = inside[p] + (name in ("article", "main"))
    own = np.zeros((n, 4))
    texts = [t for p in pages for t in p.texts]
    if texts:
        owners = np.concatenate([np.array(p.owners, int) + r for p, r in zip(pages, first, strict=True)])
        lengths = np.array([len(t) for t in texts], float)
        for k, x in enumerate((lengths, lengths * np.array(linked)[owners], [t.count(",") + t.count(".") for t in texts], ["©" in t for t in texts])):
            own[:, k] = np.bincount(owners, x, n)
    known = np.array([_TAG.get(x, -1) for x in tags])
    kinds = np.array([(x == "p", x == "li", x in CONTROLS, x == "h1", x in ("article", "main")) for x in tags], float)
    sums = np.concatenate([np.zeros((1, 9)), np.cumsum(np.concatenate([own, kinds], 1), 0)])
    at, count = np.arange(n), np.array(size)
    text, link, points, rights, paragraphs, items, controls, h1s, mains = (sums[at + count] - sums[at]).T
    place, siblings, own = np.array(place), np.array(siblings), own[:, 0]
    below = np.flatnonzero(up != at)
    largest = np.zeros(n)
    np.maximum.at(largest, up[below], text[below])
    beside = text / np.maximum(largest[up], 1)
    beside[roots] = 1
    where = np.full(n, n)
    most = below[text[below] >= largest[up[below]]]
    np.minimum.at(where, up[most], place[most])
    side = np.sign(place - where[up])
    side[roots] = 0
    chain, late, early = beside.tolist(), (side > 0).tolist(), (side < 0).tolist()
    for i in below.tolist():
        p = parents[i]
        if chain[p] < chain[i]:
            chain[i] = chain[p]
        late[i] = late[i] or late[p]
        early[i] = early[i] or early[p]
    chain = np.array(chain)
    h1 = np.full(n, -1)
    heads = np.flatnonzero(known == _TAG["h1"])[::-1]
    h1[root[heads]] = heads  # the first of each page
    h1 = h1[root]
    out = np.zeros((n, FEATURES))
    columns = (
        np.log1p(text), link / np.maximum(text, 1), np.log1p(text / count), points / np.maximum(text, 1) * 100, text / np.maximum(text[root], 1), text / np.maximum(text[up], 1), paragraphs, items, np.log1p(own), depth,
        np.array(negative) > 0, np.array(positive) > 0, np.array(above_negative) > 0, np.array(above_positive) > 0, place, siblings[up], place / np.maximum(siblings[up], 1), link[up] / np.maximum(text[up], 1), np.log1p(text[up] / count[up]), siblings,
        beside, side, chain, late, early, inside, mains[root], rights > 0, controls, h1s, np.log1p(text / np.maximum(paragraphs, 1)),
        np.where(h1 < 0, 0, np.where(at > h1, 2, np.where(at + count > h1, 1, -1))), np.array(inside)[up], chain[up], np.log1p(largest[up]), known[up],
    )
    for k, column in enumerate(columns):
        out[:, k] = column
    some = np.flatnonzero(known >= 0)
    out[some, len(columns) + known[some]] = 1
    return out


class Boosted:
    """Gradient-boosted regression trees on log-odds, over binned features."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 24, least: float = 3.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        n, width = binned.shape
        flat = binned + np.arange(width) * self.bins
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        f = np.full(n, self.base)
        self.feature, self.cut, self.value = [], [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(2**self.depth, int), np.full(2**self.depth, self.bins)
            node = np.ones(n, int)
            for level in range(self.depth):
                for k in range(2**level, 2 ** (level + 1)):
                    rows = np.flatnonzero(node == k)
                    if len(rows) < 10:
                        continue
                    sg = np.bincount(flat[rows].ravel(), np.repeat(g[rows], width), width * self.bins).reshape(width, -1).cumsum(1)
                    sh = np.bincount(flat[rows].ravel(), np.repeat(h[rows], width), width * self.bins).reshape(width, -1).cumsum(1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                    gain[(sh < self.least) | (th - sh < self.least)] = 0
                    best = int(gain.argmax())
                    if gain.flat[best] > 1e-6:
                        feature[k], cut[k] = divmod(best, self.bins)
                node = 2 * node + (binned[np.arange(n), feature[node]] > cut[node])
            leaf = node - 2**self.depth
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            f += value[leaf]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        n, width = x.shape
        binned = self._bin(x).astype(np.int32).ravel()
        out, rows = np.full(n, self.base), np.arange(n) * width
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = (binned[rows + feature[1]] > cut[1]) + 2
            for _ in range(self.depth - 1):
                node = 2 * node + (binned[rows + feature[node]] > cut[node])
            out += value[node - 2**self.depth]
        return out


def decode(page: Page, log_odds: np.ndarray) -> list[bool]:
    """The likeliest labels of which no kept element has a dropped ancestor; some elements are never kept."""
    n = len(page.tags)
    kept_gain = np.clip(log_odds, -12, 12).tolist()  # of keeping an element rather than dropping it, below choices included
    for i in range(n - 1, 0, -1):
        if page.tags[i] in NEVER or page.hidden[i]:
            kept_gain[i] = -1e9
        elif kept_gain[i] > 0:
            kept_gain[page.parents[i]] += kept_gain[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[page.parents[i]] and kept_gain[i] > 0
    return kept


def render(page: Page, kept: list[bool]) -> str:
    out: list[str] = []
    last, parts = -1, []
    for piece, owner, block in zip(page.texts, page.owners, page.blocks, strict=True):
        if block != last:
            if parts and (joined := " ".join("".join(parts).split())):
                out.append(joined)
            last, parts = block, []
        if kept[owner]:
            parts.append(piece)
    if parts and (joined := " ".join("".join(parts).split())):
        out.append(joined)
    return "\n".join(out)


@lru_cache(maxsize=1)
def trained() -> Boosted:
    """The model of MODEL."""
    made, kept = Boosted(), json.loads(pkgutil.get_data(__package__, MODEL))
    made.depth, made.bins, made.base = kept["depth"], kept["bins"], kept["base"]
    made.cuts = [np.array(c) for c in kept["cuts"]]
    made.feature, made.cut, made.value = ([np.array(x) for x in kept[name]] for name in ("feature", "cut", "value"))
    return made


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    """Main text of each page; the trees see the elements of all pages at once."""
    parsed = [Page(h or "") for h in pages]
    if not parsed:
        return []
    ends = np.cumsum([len(p.tags) for p in parsed])
    return [render(p, decode(p, o)) for p, o in zip(parsed, np.split(model.log_odds(features(*parsed)), ends[:-1]), strict=True)]


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every row; no shuffle. The model, of fixed size, is broadcast."""
    model = pages.sparkSession.sparkContext.broadcast(trained())
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                texts = extract(part.column(2).to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars long")
