"""Main content of web pages by gradient-boosted trees over DOM nodes.

Every element gets features of its subtree (text, links, markup and their densities), its attributes'
tokens, its depth and its siblings.  What a token of a class or id says about content is learnt from
the pages trained on, like the trees.  Boosted regression trees on histograms give the probability
that an element is (part of) the content.  Decoding is hierarchical: for each element the best of
"keep all of it", "drop all of it" and "decide for its children" is found bottom-up, so no kept
element lies in a dropped one.

The model is trained here, on a bounded sample of pages: those of the sample that mark up
their content (article, main, role=main), and invented ones of several layouts.  What marks the content is
hidden from the features: article and main look like div, and of the attributes only class and id are read.

Pages are read in one pass, in time that grows with their length alone, however broken.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE = re.compile(r"=\s*([\"'])")
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
TOKEN = re.compile(r"[a-z]+")
SKIP = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "noscript", "svg", "template", "iframe", "title")}
NO_ELEMENT = frozenset(("html", "body", "head", "meta", "link", "base"))  # may be left out, or hold no text: the root stands for them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html"}
REPEATS = frozenset(("li", "dt", "dd", "tr", "td", "th"))  # closed by the next of its kind
KINDS = ["p", "div", "section", "ul", "ol", "li", "a", "nav", "header", "footer", "aside", "form", "table", "h1", "h2", "h3", "pre", "blockquote"]
KIND = {t: i + 1 for i, t in enumerate(KINDS)}
KIND |= dict.fromkeys(("article", "main"), KIND["div"])
SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: str
    parent: int
    depth: int
    text: list | None = None  # (position, text) of its own
    in_link: bool = False
    block: int = 0  # the block element that it is (in)


def scan(source: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in order; comments, declarations and the content of SKIP are left out.

    A tag that nothing closes is text; a quote that nothing closes is no quote; an element of SKIP without end tag loses its tag alone.
    """
    n, at, begun = len(source), 0, 0
    find = source.find
    none_left: set[str] = set()  # marks that don't come again

    def after(mark: str, start: int) -> int:
        if mark in none_left:
            return -1
        i = find(mark, start)
        if i < 0:
            none_left.add(mark)
        return i

    def tag_end(start: int) -> int:
        gt = first = after(">", start)
        while gt >= 0 and (q := QUOTE.search(source, start, gt)):
            close = after(q[1], q.end())
            if close < 0:
                return first
            start = close + 1
            if gt < start:
                gt = after(">", start)
        return first if gt < 0 else gt

    while (lt := find("<", at)) >= 0:
        mark = source[lt + 1 : lt + 2]
        end, found = -1, None
        if mark == "!" and source.startswith("<!--", lt):
            end = after("-->", lt + 4)
            end = lt + 4 if end < 0 else end + 3
        elif mark in ("!", "?") and mark:
            end = after(">", lt + 1) + 1
        elif (m := NAME.match(source, lt + 2 if mark == "/" else lt + 1)) is not None:
            gt = after(">", m.end()) if mark == "/" else tag_end(m.end())
            if gt >= 0:
                end = gt + 1
                found = ("close", m.group().lower(), "") if mark == "/" else ("open", m.group().lower(), source[m.end() : gt])
        if end <= 0:
            at = lt + 1
            continue
        if lt > begun:
            yield "text", source[begun:lt], ""
        at = begun = end
        if found is None:
            continue
        kind, name, attrs = found
        if kind == "open" and name in SKIP:
            if not attrs.endswith("/") and name not in none_left:
                m = SKIP[name].search(source, at)
                if m:
                    at = begun = m.end()
                else:
                    none_left.add(name)
        elif name not in NO_ELEMENT and name not in SKIP:
            yield found
    if n > begun:
        yield "text", source[begun:], ""


def parse(source: str) -> list[Node]:
    """Elements in document order; unclosed and misnested tags are mended."""
    nodes = [Node("#root", "", -1, 0, text=[])]
    stack, is_open = [0], Counter()

    def close(to: int) -> None:
        while len(stack) > to:
            is_open[nodes[stack.pop()].tag] -= 1

    order = 0
    for kind, name, attrs in scan(source):
        if kind == "text":
            if not name.isspace():
                order += 1
                nodes[stack[-1]].text.append((order, name))
            continue
        if kind == "close":
            if is_open[name] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    open_ = nodes[stack[i]].tag
                    if open_ == name:
                        close(i)
                        break
                    if open_ in BLOCK and name not in BLOCK:
                        break
            continue
        if name in CLOSES_P and (is_open["p"] > 0 or (name in REPEATS and is_open[name] > 0)):
            for i in range(len(stack) - 1, 0, -1):
                open_ = nodes[stack[i]].tag
                if open_ == "p" or (open_ == name and name in REPEATS):
                    close(i)
                    break
                if open_ in BLOCK:
                    break
        up = stack[-1]
        nodes.append(Node(name, attrs, up, len(stack), [], name == "a" or nodes[up].in_link, len(nodes) if name in BLOCK else nodes[up].block))
        if name not in VOID and not attrs.endswith("/"):
            stack.append(len(nodes) - 1)
            is_open[name] += 1
    return nodes


FEATURES = 22


def tokens_of(x: Node) -> list[str]:
    """The words of its class and id."""
    return TOKEN.findall(" ".join(a or b or c for a, b, c in ATTRIBUTE.findall(x.attrs)).lower()) if x.attrs else []


def features(nodes: list[Node], evidence: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """One row of numbers for each node; the letters of text in each subtree."""
    n = len(nodes)
    own, link, tags, words, stops, para = (np.zeros(n) for _ in range(6))
    up = np.array([x.parent for x in nodes])
    for i, x in enumerate(nodes):
        for _, t in x.text:
            c = len(t) - t.count(" ")
            own[i] += c
            words[i] += t.count(" ") + 1
            stops[i] += t.count(",") + t.count(". ") + t.endswith(".")
            if x.in_link:
                link[i] += c
        tags[i] = 1
        para[i] = x.tag in ("p", "pre", "blockquote")
    total = np.stack([own, link, tags, words, stops, para])
    for i in range(n - 1, 0, -1):
        total[:, up[i]] += total[:, i]
    text, link, tags, words, stops, para = total
    sums, kids, most = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(1, n):
        sums[up[i]] += text[i]
        kids[up[i]] += 1
        most[up[i]] = max(most[up[i]], text[i])
    index = np.zeros(n)
    seen = np.zeros(n)
    for i in range(1, n):
        index[i] = seen[up[i]]
        seen[up[i]] += 1
    out = np.zeros((n, FEATURES))
    whole = max(1.0, text[0])
    for i, x in enumerate(nodes):
        out[i, 0] = KIND.get(x.tag, 0)
        out[i, 1] = x.depth
        for t in tokens_of(x):
            e = evidence.get(t, 0.0)
            out[i, 13 if e > 0 else 14] += e
        if i:
            out[i, 15] = KIND.get(nodes[x.parent].tag, 0)
            out[i, 20] = out[x.parent, 20] + out[i, 13]
            out[i, 21] = out[x.parent, 21] + out[i, 14]
    out[:, 2] = np.log1p(text)
    out[:, 3] = np.log1p(own)
    out[:, 4] = link / np.maximum(text, 1)
    out[:, 5] = text / tags
    out[:, 6] = text / whole
    out[:, 7] = np.log1p(words)
    out[:, 8] = stops / np.maximum(words, 1)
    out[:, 9] = np.log1p(para)
    out[:, 10] = kids
    p = np.maximum(up, 0)
    out[:, 11] = text / np.maximum(sums[p], 1)
    out[:, 12] = (most[p] > text).astype(float)
    out[:, 16] = index
    out[:, 17] = index / np.maximum(kids[p] - 1, 1)
    out[:, 18] = kids[p]
    out[:, 19] = link[p] / np.maximum(text[p], 1)
    return out, own


def learnt_tokens(pages: list[tuple[list[Node], np.ndarray]], least: int = 3) -> dict[str, float]:
    """Log-odds that an element whose class or id has the token is content, of tokens in ``least`` pages or more."""
    yes, no, on = Counter(), Counter(), Counter()
    for nodes, y in pages:
        here: set[str] = set()
        for x, label in zip(nodes, y):
            for t in set(tokens_of(x)):
                (yes if label else no)[t] += 1
                here.add(t)
        on.update(here)
    return {t: round(math.log((yes[t] + 0.5) / (no[t] + 0.5)), 4) for t, k in on.items() if k >= least}


class Boosted:
    """Gradient-boosted depth-limited trees for a yes-no target, on binned features."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, least: int = 20):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature (-1: leaf), bin, value; children of i at 2i+1, 2i+2
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        self.base = math.log(share / (1 - share))
        f = np.full(len(y), self.base)
        size = 2 ** (self.depth + 1) - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (y - p), weight * p * (1 - p)
            feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
            at = np.zeros(len(y), dtype=np.int64)
            for node in range(size):
                mine = np.flatnonzero(at == node)
                if not len(mine):
                    continue
                gs, hs = g[mine].sum(), h[mine].sum()
                value[node] = gs / (hs + 1.0)
                if node >= size // 2 or len(mine) < 2 * self.least:
                    continue
                best = (1e-6, -1, 0)
                for j in range(x.shape[1]):
                    k = len(self.edges[j]) + 1
                    gl, hl, c = (np.cumsum(np.bincount(b[mine, j], w, k))[:-1] for w in (g[mine], h[mine], None))
                    if not len(gl):
                        continue
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(c < self.least) | (len(mine) - c < self.least)] = 0
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (gain[i], j, i)
                if best[1] >= 0:
                    feature[node], cut[node] = best[1], best[2]
                    at[mine] = 2 * node + 1 + (b[mine, best[1]] > best[2])
            self.nodes.append((feature, cut, value))
            f += self.rate * self._values(self.nodes[-1], b)
        return self

    def _values(self, tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(b), dtype=np.int64)
        rows = np.arange(len(b))
        for _ in range(self.depth):
            split = feature[at]
            go = split >= 0
            right = b[rows, np.maximum(split, 0)] > cut[at]
            at = np.where(go, 2 * at + 1 + right, at)
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        f = np.full(len(x), self.base)
        for t in self.nodes:
            f += self.rate * self._values(t, b)
        return 1 / (1 + np.exp(-f))


def decode(nodes: list[Node], probability: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """kept, for each node: the labelling of greatest likelihood in which a node is wholly kept, wholly dropped or mixed.

    A text counts at the node that holds it, weighted by its letters; a mixed node pays for its undecided text by its own probability.
    """
    n = len(nodes)
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    weight = np.log1p(letters)
    yes, no = weight * np.log(p), weight * np.log(1 - p)
    keep, drop = yes.copy(), no.copy()
    mixed = np.maximum(yes, no) - 0.5  # a small price, so that whole subtrees are preferred
    best = np.zeros(n)
    for i in range(n - 1, -1, -1):
        best[i] = max(keep[i], drop[i], mixed[i])
        if i:
            up = nodes[i].parent
            keep[up] += keep[i]
            drop[up] += drop[i]
            mixed[up] += best[i]
    kept = np.zeros(n, dtype=bool)
    state = np.zeros(n, dtype=np.int8)  # 1 kept, 2 dropped, 0 mixed
    for i in range(n):
        above = state[nodes[i].parent] if i else 0
        if above:
            state[i] = above
        elif mixed[i] <= max(keep[i], drop[i]):
            state[i] = 1 if keep[i] >= drop[i] else 2
        kept[i] = state[i] == 1 or (state[i] == 0 and yes[i] > no[i])
    return kept


def kept_text(nodes: list[Node], kept: np.ndarray) -> str:
    pieces: list[tuple[int, int, str]] = []
    for i, x in enumerate(nodes):
        if kept[i]:
            pieces += [(order, x.block, t) for order, t in x.text]
    pieces.sort(key=lambda t: t[0])
    out: list[list[str]] = []
    last = -1
    for _, block, t in pieces:
        t = SPACE.sub(" ", html.unescape(t))
        if out and block == last:
            out[-1].append(t)
        else:
            out.append([t])
        last = block
    return "\n".join(s for s in (SPACE.sub(" ", "".join(t)).strip() for t in out) if s)


def marked(nodes: list[Node]) -> np.ndarray | None:
    """1 for nodes under markup that names the content, 0 for others; None where nothing does."""
    y = np.zeros(len(nodes))
    found = False
    for i, x in enumerate(nodes):
        mine = x.tag in ("article", "main") or re.search(r"role\s*=\s*[\"']?main|itemprop\s*=\s*[\"']?articleBody", x.attrs or "") is not None
        found |= mine
        y[i] = 1.0 if mine or (i and y[x.parent]) else 0.0
    return y if found else None


CONTENT_NAMES = ["", "", ' class="post-content"', ' id="content"', ' class="entry"', ' class="article-body"', ' class="story text"', ' id="main"', ' class="page-body"', ' class="main-text col"']
OTHER_NAMES = ["related", "sidebar", "comments", "share", "social-links", "promo box", "newsletter subscribe", "cookie-banner", "widget", "author-meta", "breadcrumbs", "tags"]


def invented_pages(n: int, seed: int = 7) -> list[str]:
    """Pages of several layouts whose content is marked (by role alone); the words mean nothing."""
    rng = np.random.default_rng(seed)
    syllables = "ka lo mi tra ven dor est qui mon ser pla ti ro an ul".split()

    def sentence(lo: int, hi: int) -> str:
        k = int(rng.integers(lo, hi))
        return " ".join("".join(rng.choice(syllables, int(rng.integers(1, 4)))) for _ in range(k)).capitalize() + "."

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{sentence(1, 4)[:-1]}</a></li>' for i in range(k))

    def other(tag: str, inner: str) -> str:
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def paragraph() -> str:
        body = " ".join(sentence(5, 25) for _ in range(int(rng.integers(1, 7))))
        kind = rng.random()
        if kind < 0.1:
            body = f"<b>{body[:30]}</b>{body[30:]}"
        elif kind < 0.2:
            body = f"<b>{body}<br>"
        if rng.random() < 0.2:
            body += f' <a href="#">{sentence(2, 5)}</a>'
        kind = rng.random()
        if kind < 0.06:
            return f"<ul>{''.join(f'<li>{sentence(4, 14)}</li>' for _ in range(4))}</ul>"
        if kind < 0.1:
            return f"<blockquote>{body}</blockquote>"
        if kind < 0.14:
            return f"<h2>{sentence(2, 7)}</h2>"
        return f"<p>{body}" if kind < 0.3 else f"<p>{body}</p>"

    pages = []
    for _ in range(n):
        wrap = str(rng.choice(["article", "main", "div", "section", "td"]))
        title = f"<h1>{sentence(3, 9)}</h1>"
        content = f'<{wrap}{rng.choice(CONTENT_NAMES)} role="main">{title}{"".join(paragraph() for _ in range(int(rng.integers(1, 14))))}</{wrap}>'
        nav = str(rng.choice(["nav", 'div class="menu"', "header", "div", 'ul class="nav"']))
        before = [other(nav, links(int(rng.integers(2, 12))) if nav.startswith("ul") else f"<ul>{links(int(rng.integers(2, 12)))}</ul>")]
        if rng.random() < 0.7:
            before.append(other(str(rng.choice(['div class="ad"', "aside", 'div class="promo"', 'div id="banner"', "div"])), sentence(3, 16)))
        side = other(f'div class="{rng.choice(OTHER_NAMES)}"', f"<ul>{links(int(rng.integers(2, 9)))}</ul>{'<p>' + sentence(3, 12) + '</p>' if rng.random() < 0.5 else ''}") if rng.random() < 0.5 else ""
        after = [f"<form>{sentence(2, 6)}<input name=q></form>"] if rng.random() < 0.2 else []
        foot = str(rng.choice(["footer", 'div class="footer"', "div"]))
        after.append(other(foot, f"&copy; site.example &middot; {sentence(2, 14)} {links(2) if rng.random() < 0.5 else ''}"))
        middle = f"<table><tr><td>{side}{links(3)}</td>{content}</tr></table>" if wrap == "td" else content + side
        for _ in range(int(rng.integers(0, 4))):
            middle = f"<div{rng.choice(['', ' id=wrapper', ' class=row', ' class=container', ' class=page'])}>{middle}</div>"
        pages.append(f"<html><head><title>t</title></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>")
    return pages


@dataclass
class Model:
    """Trees, and what the tokens of attributes say."""

    trees: Boosted
    evidence: dict[str, float]

    def features(self, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
        return features(nodes, self.evidence)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.trees.predict(x)


def train(sources: list[str]) -> Model:
    """Tokens for the features of each half of the pages are learnt from the other half, so that the trees trust them no more than they should."""
    pages = [(nodes, y) for nodes in map(parse, sources) if (y := marked(nodes)) is not None]
    halves = [learnt_tokens(pages[1::2]), learnt_tokens(pages[::2])]
    xs, ys, ws = [], [], []
    for i, (nodes, y) in enumerate(pages):
        x, own = features(nodes, halves[i % 2])
        use = own > 0
        xs.append(x[use]), ys.append(y[use]), ws.append(np.log1p(own[use]))
    return Model(Boosted().fit(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws)), learnt_tokens(pages))


def _emit(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                pages = [parse(s.as_py()) if s.is_valid else None for s in b.column(1)[lo : lo + 64]]
                made = [model.features(p) for p in pages if p is not None]
                p = model.predict(np.concatenate([x for x, _ in made])) if made else np.zeros(0)
                texts, kept_n, all_n, at = [], [], [], 0
                made_it = iter(made)
                for nodes in pages:
                    if nodes is None:
                        texts.append(None), kept_n.append(None), all_n.append(None)
                        continue
                    _, own = next(made_it)
                    kept = decode(nodes, p[at : at + len(nodes)], own)
                    at += len(nodes)
                    texts.append(kept_text(nodes, kept)), kept_n.append(int(kept[1:].sum())), all_n.append(len(nodes) - 1)
                ids = b.column(0).slice(lo, len(pages))
                yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array(kept_n, pa.int64()), pa.array(all_n, pa.int64())], ["page_id", "content", "n_kept", "n_nodes"])

    return run


def trained_on(pages: DataFrame, sample: int = 200, invented: int = 200) -> Model:
    """A model trained on ``invented`` pages and at most ``sample`` of pages (those of the least hash of page_id).

    Rows with a null page or page_id, and pages whose content isn't marked, teach nothing; an empty table leaves the invented ones; pages are read whole.
    """
    some = pages.select("page_id", F.col("html").cast("string").alias("html")).where("html is not null and page_id is not null")
    ids = some.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).withColumnRenamed("page_id", "__id__").distinct()
    texts = some.join(F.broadcast(ids), F.col("page_id") == F.col("__id__")).orderBy("page_id", "html").limit(sample).select("html")
    return train([r[0] for r in texts.collect()] + invented_pages(invented))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, content, n_kept, n_nodes): the text of the elements kept, one line for each block, and how many were kept of how many.

    pages needs page_id and html.  A null page has null content, an empty one "" (and no nodes);
    null ids and repeated rows are kept as they are; broken markup is mended (see ``scan``); a page of any length is read whole,
    in time that grows with its length; other columns are ignored; an empty table gives an empty result.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    model = model or trained_on(pages)
    slim = pages.select("page_id", F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(_emit(model), f"page_id {kind}, content string, n_kept long, n_nodes long")
