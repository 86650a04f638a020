"""HTML extraction by a tree-structured graphical model over the DOM.

Every block element of a page carries a binary variable: main content or not. Its own features give it a unary
potential, and every parent-child edge a potential that depends on the child's kind. Sum-product messages upward and
downward give exact marginals; the model is fitted by their gradient to labelled pages, which page_sample() writes.
"""

from __future__ import annotations

import math
import pickle
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of the HTML standard, and words that authors give such sections as class or id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template title iframe object svg canvas audio video select button textarea datalist".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
CLOSES_P = BLOCKS - {"html", "body"}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tr"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "thead": {"table"}}
APART = frozenset("ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation navigate sidebar side rail aside footer foot colophon header masthead topbar breadcrumb breadcrumbs pagination pager comment comments respond reply replies disqus cookie cookies consent notice alert gdpr popup modal overlay share sharing social related recommended widget form login search newsletter subscribe signup copyright legal tags toolbar skip".split())
MAIN = frozenset("article content post entry story main body text page hentry blog news prose markdown document".split())

_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")


class Node:
    """A block element: tag, words of its class, id and role, children, and runs of text in between."""

    __slots__ = ("tag", "names", "parent", "children", "runs", "chars", "linked")

    def __init__(self, tag: str, names: frozenset[str], parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.children: list[Node] = []
        self.runs: list[list[str]] = []
        self.chars = self.linked = 0


class _Builder(HTMLParser):
    """Builds block elements and their runs. ``order`` holds (node, run) in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", frozenset(), None)
        self.open: list[tuple[str, Node | None]] = [("html", self.root)]
        self.node, self.run = self.root, None
        self.order: list[tuple[Node, list[str]]] = []
        self.hidden: list[str] = []
        self.inside = 0  # blocks that were opened in a hidden element
        self.count = Counter({"html": 1})  # open elements by tag
        self.links = 0

    def _close(self, to: int) -> None:
        """Close the open elements from place ``to`` on."""
        for tag, node in self.open[to:]:
            self.count[tag] -= 1
            if tag == "a":
                self.links -= 1
            if node is not None:
                self.run = None
        del self.open[to:]
        self.node = next(n for _, n in reversed(self.open) if n is not None)

    def handle_starttag(self, tag, attrs):
        if self.hidden == ["head"] and tag not in IN_HEAD:
            self.hidden.clear()  # neither its end tag nor that of the body's start need be written
        if self.hidden:
            if tag == self.hidden[-1] or self.hidden == ["head"] and tag in HIDDEN:
                self.hidden.append(tag)
            self.inside += tag in BLOCKS
            return
        if tag in HIDDEN:
            self.hidden.append(tag)
            self.inside = 0
            return
        if tag in VOID:
            if tag in ("br", "hr") and self.run is not None:
                self.run.append(" ")
                if tag == "hr":
                    self.run = None
            return
        if tag in ("html", "body") and self.count[tag]:
            return
        if tag in CLOSES_P and self.node.tag == "p":
            self._close(next(i for i in range(len(self.open) - 1, 0, -1) if self.open[i][1] is self.node))
        closes = SAME_CLOSES.get(tag)
        if closes and any(self.count[t] for t in closes):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] in SCOPES.get(tag, ()):
                    break
                if self.open[i][0] in closes:
                    self._close(i)
        if tag not in BLOCKS:
            if tag == "a":
                self.links += 1
            self.count[tag] += 1
            self.open.append((tag, None))
            return
        names = frozenset(w for k, v in attrs if k in ("class", "id", "role") and v for w in _NAME.findall(v.lower()))
        node = Node(tag, names, self.node)
        self.node.children.append(node)
        self.count[tag] += 1
        self.open.append((tag, node))
        self.node, self.run = node, None

    def handle_startendtag(self, tag, attrs):
        if tag != "svg":  # of the hidden elements the only one that may close itself
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
                return
            if tag not in BLOCKS:
                return
            self.inside -= 1
            if self.inside >= 0 or not self.count[tag] or self.hidden[0] == "head":
                return
            self.hidden.clear()  # a block around a hidden element that was not closed
        if tag == "br" and self.run is not None:
            self.run.append(" ")
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] == tag), 0) if self.count[tag] else 0
        if at and (tag in BLOCKS or not any(n is not None for _, n in self.open[at + 1 :])):
            if tag in ("body", "html"):
                return
            self._close(at)
        elif at:  # an inline element around blocks: it ends, they stay open
            if tag == "a":
                self.links -= 1
            self.count[tag] -= 1
            del self.open[at]

    def handle_data(self, data):
        if self.hidden or not data:
            return
        if self.run is None:
            if not data.strip():
                return
            self.run = []
            self.node.runs.append(self.run)
            self.order.append((self.node, self.run))
        self.run.append(data)
        n = len(data.strip())
        self.node.chars += n
        if self.links > 0:
            self.node.linked += n


def parse(html: str) -> tuple[list[Node], list[tuple[Node, list[str]]]]:
    """Block elements in page order (parents before children), and runs of text with their elements."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    nodes, stack = [], [builder.root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(reversed(node.children))
    return nodes, builder.order


def edge_kind(node: Node) -> int:
    """Kind of the edge to a node's parent: 0 plain, 1 set apart by its tag or names, 2 named as content."""
    if node.tag in ("nav", "header", "footer", "aside", "form", "menu", "dialog") or node.names & APART:
        return 1
    if node.tag in ("article", "main") or node.names & MAIN:
        return 2
    return 0


def features(node: Node) -> tuple[str, ...]:
    """Names of a node's features: tag, names, length of its own text, share of text in links."""
    total = linked = 0
    for c in (node, *node.children):
        total += c.chars
        linked += c.linked
    share = linked / total if total else 0.0
    out = ["bias", f"tag:{node.tag}", f"kind:{edge_kind(node)}", f"chars:{min(int(math.log2(node.chars + 1)), 10)}", f"links:{int(share * 4)}", f"parent:{node.parent.tag if node.parent else '-'}"]
    if node.names & APART:
        out.append("apart")
    if node.names & MAIN:
        out.append("main")
    return tuple(out)


class Model:
    """Unary weights by feature and a 2 x 2 table for each kind of edge (parent's value, child's value)."""

    def __init__(self):
        self.unary: dict[str, float] = {}
        self.pair = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(3)]

    def infer(self, nodes: list[Node]) -> tuple[list[float], list[tuple[int, int, int, list[list[float]]]], list[tuple[str, ...]]]:
        """Marginals by one upward and one downward pass; of every edge its (parent, child, kind, joint marginal)."""
        place = {id(n): i for i, n in enumerate(nodes)}
        seen = [features(n) for n in nodes]
        get = self.unary.get
        belief = [sum(get(f, 0.0) for f in fs) for fs in seen]
        up, kinds, parents = [0.0] * len(nodes), [edge_kind(n) for n in nodes], [place[id(n.parent)] if n.parent is not None else -1 for n in nodes]
        exp, log = math.exp, math.log
        for i in range(len(nodes) - 1, 0, -1):
            w, b = self.pair[kinds[i]], max(-30.0, min(30.0, belief[i]))
            e = exp(b)
            up[i] = log((exp(w[1][1]) * e + exp(w[1][0])) / (exp(w[0][1]) * e + exp(w[0][0])))
            belief[parents[i]] += up[i]
        edges, total = [], list(belief)
        for i in range(1, len(nodes)):
            w, q = self.pair[kinds[i]], max(-30.0, min(30.0, total[parents[i]] - up[i]))
            e, own = exp(q), max(-30.0, min(30.0, belief[i]))
            total[i] = belief[i] + log((exp(w[1][1]) * e + exp(w[0][1])) / (exp(w[1][0]) * e + exp(w[0][0])))
            joint = [[exp(w[a][b] + a * q + b * own) for b in (0, 1)] for a in (0, 1)]
            z = sum(map(sum, joint))
            edges.append((parents[i], i, kinds[i], [[x / z for x in row] for row in joint]))
        return [1 / (1 + exp(-max(-30.0, min(30.0, t)))) for t in total], edges, seen


def train(pages: list[tuple[str, list[bool]]], epochs: int = 25, rate: float = 0.25) -> Model:
    """Fit by the likelihood's gradient: what is observed less what the marginals expect. Labels follow parse()'s nodes."""
    model, draw = Model(), random.Random(5)
    parsed = [(parse(html)[0], labels) for html, labels in pages]
    squares: dict = {}

    def step(key, table, index, g):
        squares[key] = squares.get(key, 1e-3) + g * g
        table[index] = (table.get(index, 0.0) if isinstance(table, dict) else table[index]) * (1 - 1e-5) + rate * g / math.sqrt(squares[key])

    for _ in range(epochs):
        draw.shuffle(parsed)
        for nodes, labels in parsed:
            marginals, edges, seen = model.infer(nodes)
            grads: dict[str, float] = {}
            for m, y, fs in zip(marginals, labels, seen, strict=True):
                for f in fs:
                    grads[f] = grads.get(f, 0.0) + y - m
            for f, g in grads.items():
                step(f, model.unary, f, g)
            tables: dict = {}
            for p, c, kind, joint in edges:
                for a in (0, 1):
                    for b in (0, 1):
                        tables[kind, a, b] = tables.get((kind, a, b), 0.0) + (labels[p] == a and labels[c] == b) - joint[a][b]
            for (kind, a, b), g in tables.items():
                step((kind, a, b), model.pair[kind][a], b, g)
    return model


def page_sample(count: int = 240, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Labelled pages of many layouts, each section written with its label."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("aeioubcdfglmnprst") for _ in range(draw.randint(2, 9)))
    text = lambda a, b: " ".join(word() for _ in range(draw.randint(a, b)))
    named = lambda *names: draw.choice(["class", "id"]) + f'="{draw.choice(names)}"'

    def links(n, label):
        tag = draw.choice(["ul", "div", "ol"])
        items = "".join(f'<li><a href="/{word()}">{text(1, 3)}</a></li>' if tag != "div" else f'<a href="/{word()}">{text(1, 3)}</a> ' for _ in range(n))
        return f"<{tag}>{items}</{tag}>", [label] * (1 + (n if tag != "div" else 0))

    def section(open_, n=None, prose=0.4):
        out, labels = [open_], [False]
        for _ in range(n or draw.randint(1, 3)):
            if draw.random() < prose:
                out.append(f"<p>{text(1, 60)}</p>")
                labels.append(False)
            elif draw.random() < 0.5:
                part, more = links(draw.randint(1, 6), False)
                out.append(part)
                labels += more
            else:
                out.append(text(1, 25))
        return "".join(out), labels

    def boiler(kind):
        return {
            "nav": lambda: section(draw.choice([f"<nav {named('menu', 'top')}>", "<nav>", f"<div {named('nav', 'menu', 'navigation', 'navbar', 'breadcrumbs')}>"]), 1, 0.05),
            "ad": lambda: section(f"<{draw.choice(['div', 'aside'])} {named('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo')}>", 1, 0.6),
            "side": lambda: section(draw.choice(["<aside>", f"<div {named('sidebar', 'side', 'widget', 'related')}>", f"<aside {named('sidebar', 'rail')}>"])),
            "notice": lambda: section(f"<div {named('cookie-notice', 'notice', 'alert', 'consent', 'popup')}>", 1, 0.7),
            "header": lambda: section(draw.choice(["<header>", f"<div {named('header', 'masthead', 'topbar')}>"])),
            "footer": lambda: section(draw.choice(["<footer>", f"<div {named('footer', 'colophon', 'copyright')}>"])),
            "form": lambda: section(draw.choice(["<form>", f"<div {named('newsletter', 'search', 'login', 'signup')}>"]), 1, 0.6),
            "comments": lambda: section(draw.choice([f"<section {named('comments', 'replies')}>", f"<div {named('comments', 'respond', 'disqus')}>"]), draw.randint(1, 6), 0.9),
        }[kind]()

    def closed(part):
        html, labels = part
        return html + f"</{re.match(r'<(\w+)', html)[1]}>", labels

    def article():
        out, labels = [], []
        if draw.random() < 0.85:
            out.append(f"<h1>{text(1, 12)}</h1>")
            labels.append(True)
        for _ in range(draw.choice([1, 2, 3, 4, 6, 9, 14])):
            x = draw.random()
            if x < 0.72:
                link = f' <a href="/{word()}">{text(1, 3)}</a> ' if draw.random() < 0.2 else ""
                broken = draw.random() < 0.15
                out.append(f"<p>{'<b>' if broken else ''}{text(1, draw.choice([2, 8, 40, 120]))}{link}{text(1, 10)}{'<br>' if broken else draw.choice(['</p>', '</p>', '</p>', ''])}")
                labels.append(True)
            elif x < 0.8:
                n = draw.randint(1, 5)
                out.append("<ul>" + "".join(f"<li>{text(1, 15)}</li>" for _ in range(n)) + "</ul>")
                labels += [True] * (n + 1)
            elif x < 0.9:
                tag = draw.choice(["h2", "h3", "blockquote", "pre", "div"])
                out.append(f"<{tag}>{text(1, 20)}</{tag}>")
                labels.append(True)
            else:
                html, more = closed(boiler(draw.choice(["ad", "side", "form", "ad", "notice"])))
                out.append(html)
                labels += more
        if draw.random() < 0.15:
            html, more = closed(boiler("comments"))
            out.append(html)
            labels += more
        return "".join(out), labels

    pages = []
    for _ in range(count):
        body, labels = ["<body>"], [False, False]

        def put(part, body=body, labels=labels):
            body.append(part[0])
            labels += part[1]

        for kind in ("notice", "header", "nav", "ad", "side"):
            if draw.random() < 0.5:
                put(closed(boiler(kind)))
        wrap = draw.random() < 0.4
        if wrap:
            body.append(draw.choice(["<div>", f"<div {named('page', 'wrapper', 'container')}>", "<section>"]))
            tag = re.match(r"<(\w+)", body[-1])[1]
            labels.append(False)
        open_ = draw.choice(["<article>", "<article>", "<main>", f"<div {named('content', 'post', 'entry-content', 'article', 'story', 'main')}>", f"<article {named('post', 'hentry')}>"])
        inner, more = article()
        put((f"{open_}{inner}</{re.match(r'<(\w+)', open_)[1]}>", [True, *more]))
        for kind in ("side", "comments", "ad", "form"):
            if draw.random() < 0.3:
                put(closed(boiler(kind)))
        if wrap:
            body.append(f"</{tag}>")
        for kind in ("comments", "footer"):
            if draw.random() < 0.6:
                put(closed(boiler(kind)))
        html = f"<!DOCTYPE html><html><head><title>{text(1, 5)}</title><script>x='</p>'</script></head>{''.join(body)}</body></html>"
        if len(parse(html)[0]) == len(labels):
            pages.append((html, labels))
    return pages


def main_text(html: str, model: Model) -> str:
    """Blocks whose element is content, in page order, joined by two newlines."""
    nodes, order = parse(html)
    if not order:
        return ""
    marginals = dict(zip(map(id, nodes), model.infer(nodes)[0], strict=True))
    blocks = (_SPACE.sub(" ", "".join(run)).strip() for node, run in order if marginals[id(node)] >= 0.5)
    return "\n\n".join(b for b in blocks if b)


@lru_cache(maxsize=1)
def _model(blob: bytes) -> Model:
    return pickle.loads(blob)


def extract_main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Main text of every whole page: page_id, url, text (empty if none), n_chars (its code points).

    Null and empty pages have an empty text; null, tied and repeated ids are carried as they are; other columns are
    ignored; an empty table gives no rows. No shuffle; memory is bounded by one Arrow batch.
    """
    model = model or train(page_sample())
    blob = pages.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    kinds = pages.schema["page_id"].dataType.simpleString(), pages.schema["url"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(blob.value)
        for batch in batches:
            texts = [main_text(x.as_py() or "", own) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
