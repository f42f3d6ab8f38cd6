"""Main text of web pages by gradient-boosted trees over DOM nodes with hierarchical decoding.

A page becomes a tree of block elements and runs of text (inline elements are
part of their run). Each node has features of its subtree (text, link and tag
density), its attribute tokens and those of its ancestors, its depth, its
place among its siblings and theirs. Boosted trees give the log-odds that a
node belongs to the article. Decoding then picks the best choice for the whole
tree in which a dropped node has no kept descendant: bottom up, each node is
worth either the sum of dropping its subtree or its own log-odds and the best
of each child.

The trees are fitted on the driver on TRAINING_PAGES generated pages of known
labels (documented bound; the pages vary containers, order, attribute names and
text), so the model has a fixed size and goes to executors by broadcast.

Defined results: a null or empty page gives the empty text. Scripts, styles,
forms and other elements without readable text never count. Unclosed and
misnested tags are read as browsers read them in the common cases (a block
closes an open paragraph, the first element of the body an open head, and a
parent's end tag what is open in it); an unknown declaration is a comment up to
its >. Text outside any element is a run of the root. Deep, wide and very long
pages are read whole, in time about in proportion to their nodes. Nodes of equal
worth either way (ties) are kept.
Repeated rows get equal results; other columns are kept, those named like an
output are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TRAINING_PAGES, TREES, DEPTH, RATE, BINS = 400, 60, 4, 0.2, 24

# Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head noscript template svg iframe form button select textarea option object canvas audio video math".split())
#: What can stand in a head without ending it; silent elements that only their own end tag ends; those whose <x/> is closed.
HEAD = frozenset("head html base basefont bgsound link meta title noscript noframes style script template".split())
SEALED = frozenset("script style template iframe object textarea".split())
FOREIGN = frozenset(("svg", "math"))
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li td th tr dd dt body".split())
GROUPS = {
    "content": "content article post entry main story text body blog page",
    "menu": "nav menu navigation breadcrumb breadcrumbs toolbar tabs pagination pager skip toc",
    "advert": "ad ads advert advertisement adbox banner sponsor sponsored promo promotion outbrain taboola",
    "frame": "header footer masthead copyright colophon topbar logo site bottom legal",
    "side": "sidebar side aside widget rail related recommended more popular trending secondary",
    "notice": "cookie cookies consent notice gdpr popup modal overlay newsletter subscribe alert paywall signup login",
    "comment": "comment comments discussion disqus reply replies respond feedback reviews",
    "share": "share social sharing follow like tags meta byline author buttons tools print",
}
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "ul", "li", "table", "td", "nav", "aside", "header", "footer", "blockquote", "pre", "body", "#text"]
_WORDS = {w: i for i, ws in enumerate(GROUPS.values()) for w in ws.split()}
_TOKEN = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "depth", "groups", "linked", "parent", "parts", "tag")

    def __init__(self, tag: str, parent: Node | None, groups: int = 0):
        self.tag, self.parent, self.groups = tag, parent, groups
        self.children: list[Node] = []
        self.parts: list[str] = []
        self.linked = 0
        self.depth = parent.depth + 1 if parent else 0


def attribute_groups(attrs) -> int:
    """Which groups of words the class, id and role of an element name, as bits."""
    bits = 0
    for name, value in attrs:
        if value and name in ("class", "id", "role", "itemprop"):
            for word in _TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                if word in _WORDS:
                    bits |= 1 << _WORDS[word]
    return bits


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", None)
        self.open: list[tuple[str, Node]] = [("#root", self.root)]
        #: How many elements of each name are open, so that looking for one that isn't costs nothing.
        self.names: Counter[str] = Counter()
        self.silent = 0
        self.links = 0

    def handle_starttag(self, tag, attrs):
        if self.silent and (self.open[-1][0] == "head" and tag not in HEAD or tag == "body"):
            self.end("head")
        if self.silent:
            if tag not in VOID and tag not in ("head", "html", "body"):
                self.enter(tag, self.open[-1][1])
                self.silent += tag in SILENT
                self.links += tag == "a"
            return
        if tag in SILENT:
            if tag == "head" or tag not in VOID:
                self.enter(tag, self.open[-1][1])
                self.silent = 1
            return
        if tag in INLINE:
            if tag == "br":
                self.text(" ")
            elif tag not in VOID:
                self.enter(tag, self.open[-1][1])
                self.links += tag == "a"
            return
        if tag in CLOSES_P:
            self.end("p", {"table", "td", "th", "article", "section", "div", "body", "blockquote", "li"})
        if tag == "li":
            self.end("li", {"ul", "ol", "menu"})
        elif tag in ("td", "th"):
            self.end("td", {"tr", "table"})
            self.end("th", {"tr", "table"})
        elif tag == "tr":
            self.end("tr", {"table"})
        elif tag in ("dd", "dt"):
            self.end("dd", {"dl"})
            self.end("dt", {"dl"})
        if tag in VOID:
            return
        parent = self.open[-1][1]
        node = Node(tag, parent, attribute_groups(attrs))
        parent.children.append(node)
        self.enter(tag, node)

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag not in SILENT and not (self.silent and any(self.names[name] for name in FOREIGN)):
            self.handle_starttag(tag, attrs)

    def enter(self, tag, node):
        self.open.append((tag, node))
        self.names[tag] += 1

    def end(self, tag, stop=frozenset()):
        if not self.names[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if name == tag:
                for gone, _ in self.open[k:]:
                    self.silent -= gone in SILENT
                    self.links -= gone == "a"
                    self.names[gone] -= 1
                del self.open[k:]
                return
            if name in stop:
                return

    def handle_endtag(self, tag):
        self.end(tag, SEALED if self.silent else frozenset())

    def parse_marked_section(self, i, report=1):
        """Browsers read any <![ up to the next > as a comment."""
        return self.parse_bogus_comment(i)

    def text(self, data):
        parent = self.open[-1][1]
        last = parent.children[-1] if parent.children else None
        if last is None or last.tag != "#text":
            if not data.strip():
                return
            last = Node("#text", parent)
            parent.children.append(last)
        last.parts.append(data)
        if self.links > 0:
            last.linked += len(data)

    def handle_data(self, data):
        if self.silent and self.open[-1][0] == "head" and data.strip():
            self.end("head")
        if not self.silent:
            self.text(data)


def parse(html: str | None) -> list[Node]:
    """All nodes of a page, parents before children, in page order."""
    reader = _Reader()
    try:
        reader.feed(html or "")
        reader.close()
    except AssertionError:  # a malformed declaration: what follows it can't be told from text
        pass
    out, stack = [], [reader.root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """One row of figures a node."""
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    parent = [-1 if x.parent is None else index[id(x.parent)] for x in nodes]
    text, linked, count, paras, stops = [0.0] * n, [0.0] * n, [1.0] * n, [0.0] * n, [0.0] * n
    above, place, line = [0] * n, [0.0] * n, 0.0
    kinds, alike = [0] * n, [Counter(y.tag for y in x.children) for x in nodes]
    for i, x in enumerate(nodes):
        above[i] = x.groups | (above[parent[i]] if i else 0)
        kinds[i] = _KIND.get(x.tag, 0) | (kinds[parent[i]] if i else 0)
        if x.tag == "#text":
            s = "".join(x.parts)
            text[i], linked[i], stops[i] = len(s), x.linked, s.count(".") + s.count(",")
        place[i] = line
        line += text[i]
        paras[i] = x.tag == "p"
    total = max(line, 1.0)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        text[p] += text[i]
        linked[p] += linked[i]
        count[p] += count[i]
        paras[p] += paras[i]
        stops[p] += stops[i]
    rows = []
    for i, x in enumerate(nodes):
        p = parent[i]
        family = len(nodes[p].children) if i else 1
        same = alike[p][x.tag] if i else 1
        rows.append(
            [
                math.log1p(text[i]),
                text[i] / count[i],
                linked[i] / max(text[i], 1.0),
                stops[i] / max(text[i], 1.0),
                text[i] / total,
                text[i] / max(text[p], 1.0) if i else 1.0,
                math.log1p(paras[i]),
                math.log1p(count[i]),
                x.depth,
                place[i] / total,
                family,
                same / family,
                math.log1p(paras[p]) if i else 0.0,
                linked[p] / max(text[p], 1.0) if i else 0.0,
                TAGS.index(x.tag) if x.tag in TAGS else -1,
                (TAGS.index(nodes[p].tag) if nodes[p].tag in TAGS else -1) if i else -1,
                *((x.groups >> k) & 1 for k in range(len(GROUPS))),
                *((above[i] >> k) & 1 for k in range(len(GROUPS))),
                *((kinds[i] >> k) & 1 for k in range(len(_KINDS))),
            ]
        )
    return np.array(rows, np.float32)


#: An element itself or one above it is of each of these kinds.
_KINDS = (("article", "main"), ("nav", "menu"), ("aside",), ("footer",), ("header",), ("ul", "ol", "li"), ("table", "td"))
_KIND = {tag: 1 << k for k, tags in enumerate(_KINDS) for tag in tags}


class Boosted:
    """Trees fitted to the logistic loss on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self.bins(x)
        self.base = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        score = np.full(len(y), self.base)
        self.trees = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            tree = self.grow(binned, g, h)
            self.trees.append(tree)
            score += self.walk(tree, binned)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], 1).astype(np.uint8)

    @staticmethod
    def grow(binned, g, h):
        """Arrays of a complete tree: split feature (-1: leaf), split bin, value."""
        size = 2 ** (DEPTH + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        where = {0: np.arange(len(g))}
        for node in range(size):
            at = where.pop(node, None)
            if at is None:
                continue
            gs, hs = g[at].sum(), h[at].sum()
            value[node] = RATE * gs / (hs + 1.0)
            if node >= 2**DEPTH - 1 or len(at) < 20:
                continue
            best = (1e-3, -1, 0)
            for f in range(binned.shape[1]):
                b = binned[at, f]
                gl, hl = np.cumsum(np.bincount(b, g[at], BINS))[:-1], np.cumsum(np.bincount(b, h[at], BINS))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < 1) | (hs - hl < 1)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] >= 0:
                feature[node], cut[node] = best[1], best[2]
                left = binned[at, best[1]] <= best[2]
                where[2 * node + 1], where[2 * node + 2] = at[left], at[~left]
        return feature, cut, value

    @staticmethod
    def walk(tree, binned):
        feature, cut, value = tree
        at = np.zeros(len(binned), int)
        line = np.arange(len(binned))
        for _ in range(DEPTH):
            f = feature[at]
            go = f >= 0
            right = binned[line, np.maximum(f, 0)] > cut[at]
            at = np.where(go, 2 * at + 1 + right, at)
        return value[at]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned = self.bins(x)
        return self.base + sum(self.walk(t, binned) for t in self.trees)


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the best choice without a kept node under a dropped one."""
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    weight = np.array([1.0 + math.log1p(sum(map(len, x.parts))) for x in nodes])
    worth = np.clip(odds, -8, 8) * weight
    drop, keep = -worth, worth.copy()
    for i in range(n - 1, 0, -1):
        p = index[id(nodes[i].parent)]
        drop[p] += drop[i]
        keep[p] += max(drop[i], keep[i])
    kept = np.zeros(n, bool)
    for i, x in enumerate(nodes):
        kept[i] = keep[i] >= drop[i] and (i == 0 or kept[index[id(x.parent)]])
    return kept


def blocks(nodes: list[Node], kept: np.ndarray) -> str:
    """Kept runs in page order, white space folded, joined by an empty line."""
    runs = (_SPACE.sub(" ", "".join(x.parts)).strip() for x, k in zip(nodes, kept, strict=True) if k and x.parts)
    return "\n\n".join(r for r in runs if r)


# ---- generated training pages ----

_CONTENT = ["article", "article.post", "main", "div.content", "div#main-content", "div.post-body", "section.entry", "div.story", "div.article-text", "section", "div", "td"]
_BOILER = {
    "menu": ["nav", "nav.menu", "div.nav", "ul.menu", "div#navigation", "div.breadcrumbs", "header nav"],
    "advert": ["div.ad", "div.ads", "div#banner", "aside.sponsored", "div.promo", "section.advertisement", "p.ad"],
    "frame": ["header", "footer", "div.header", "div#footer", "div.masthead", "div.copyright", "footer.site-footer"],
    "side": ["aside", "aside.sidebar", "div.sidebar", "div.widget", "div.related", "section.popular", "div#secondary"],
    "notice": ["div.cookie-notice", "div#consent", "div.notice", "div.newsletter", "section.subscribe", "div.popup", "p.alert"],
    "comment": ["section.comments", "div#comments", "div.comment-list", "ol.comments", "div.discussion"],
    "share": ["div.share", "div.social", "ul.tags", "div.meta", "p.byline"],
}


def _tagged(kind: str, inner: str) -> str:
    for part in reversed(kind.split(" ")):
        m = re.fullmatch(r"(\w+)(?:([.#])([\w-]+))?", part)
        attr = f' {"class" if m[2] == "." else "id"}="{m[3]}"' if m[2] else ""
        inner = f"<{m[1]}{attr}>{inner}</{m[1]}>"
    return inner


def training_page(r: random.Random) -> str:
    """A page and the words that belong to its article: those start with ``k``, all others with ``d``."""

    def words(mark, least, most):
        ws = [mark + "".join(r.choice("aeiourstnlé") for _ in range(r.randint(1, 9))) + ("," if r.random() < 0.08 else "") for _ in range(r.randint(least, most))]
        return " ".join(ws) + r.choice([".", ".", ".", "!"])

    def boiler(group):
        kind = r.choice(_BOILER[group])
        if group in ("menu", "side") or kind.startswith(("ul", "ol")) and group != "comment":
            link = lambda: f'<a href="/x">{words("d", 1, 3)}</a>'
            inner = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8)))
            inner = inner if kind.startswith(("ul", "ol")) else f"<ul>{inner}</ul>" if r.random() < 0.7 else re.sub("</?li>", " ", inner)
            if group == "side" and r.random() < 0.5:
                inner = f"<h3>{words('d', 1, 4)}</h3><p>{words('d', 5, 30)}</p>" + inner
        elif group == "comment":
            item = "li" if kind.startswith("ol") else r.choice(["div", "p", "article", 'div class="comment"'])
            inner = "".join(f"<{item}>{words('d', 4, 40)}</{item.split()[0]}>" for _ in range(r.randint(1, 5)))
            inner = (f"<h3>{words('d', 1, 2)}</h3>" if r.random() < 0.5 and item != "li" else "") + inner
        else:
            inner = words("d", 3, 25)
            if r.random() < 0.4:
                inner = f"<p>{inner}</p>" + (f'<a href="#">{words("d", 1, 3)}</a>' if r.random() < 0.5 else "")
        return _tagged(kind, inner)

    def paragraph():
        body = words("k", 1 if r.random() < 0.15 else 8, 120)
        x = r.random()
        if x < 0.1:
            return f"<p><b>{body}<br>"
        if x < 0.2:
            body = body.replace(" ", ' <a href="/y">k</a> ', 1)
        if x < 0.3:
            return "<ul>" + "".join(f"<li>{words('k', 3, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if x < 0.36:
            return f"<h2>{words('k', 1, 6)}</h2>"
        if x < 0.4:
            return f"<blockquote><p>{body}</p></blockquote>"
        if x < 0.46:
            return f"<div>{body}</div>"
        return f"<p>{body}</p>"

    inside = [f"<h1>{words('k', 1, 9)}</h1>"] if r.random() < 0.85 else []
    inside += [paragraph() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 15, 25]))]
    for group in ("advert", "share", "side", "comment", "notice"):
        if r.random() < 0.2:
            inside.insert(r.randint(1, len(inside)) if group != "comment" else len(inside), boiler(group))
    kind = r.choice(_CONTENT) if r.random() < 0.6 else "article"
    content = _tagged("table tr td" if kind == "td" else kind, "".join(inside))
    before = [boiler(g) for g in ("frame", "menu", "notice", "advert") if r.random() < 0.55]
    after = [boiler(g) for g in ("comment", "side", "advert", "notice", "menu", "frame") if r.random() < 0.4]
    r.shuffle(before)
    page = "".join([*before, content, *after])
    if r.random() < 0.4:
        page = _tagged(r.choice(["div.wrapper", "div#page", "div", "div.container"]), page)
    end = r.choice(["</body></html>", "", "</html>"])
    return f"<!DOCTYPE html><html><head><title>{words('d', 1, 6)}</title><style>p{{}}</style></head><body>{page}{end}"


def labels(nodes: list[Node]) -> np.ndarray:
    """Whether each node of a training page holds words of the article."""
    own = {id(x): sum(w.startswith("k") for w in "".join(x.parts).split()) > 0 for x in nodes}
    for x in reversed(nodes):
        if own[id(x)] and x.parent is not None:
            own[id(x.parent)] = True
    return np.array([own[id(x)] for x in nodes], float)


_FITTED: list[Boosted] = []


def fitted() -> Boosted:
    """The model; the same for each call."""
    if not _FITTED:
        r = random.Random(20)
        pages = [parse(training_page(r)) for _ in range(TRAINING_PAGES)]
        _FITTED.append(Boosted(np.concatenate([features(p) for p in pages]), np.concatenate([labels(p) for p in pages])))
    return _FITTED[0]


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with ``text`` and ``n_chars``, the article of the whole page."""
    shared = pages.sparkSession.sparkContext.broadcast(fitted())
    rest = pages.drop("text", "n_chars") if html not in ("text", "n_chars") else pages
    schema = T.StructType([*rest.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    at = rest.columns.index(html)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = []
            for first in range(0, len(batch), 200):
                trees = [parse(h.as_py()) for h in batch.column(at).slice(first, 200)]
                odds = model.log_odds(np.concatenate([features(t) for t in trees]))
                k = 0
                for t in trees:
                    texts.append(blocks(t, decode(t, odds[k : k + len(t)])))
                    k += len(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return rest.mapInArrow(run, schema)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).drop("html")
