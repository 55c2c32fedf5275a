"""HTML extraction: a tree-structured graphical model over DOM blocks, with sum-product messages up and down the tree."""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_batches

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder mstyle semantics object".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_PARTS = ("table", "td", "th", "section", "article", "aside", "nav", "main", "header", "footer", "blockquote", "form", "fieldset", "details", "figure", "button")
# An element that starts closes an open one of these, up to the nearest of its scope.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", *_PARTS)), "dt": (("dt", "dd"), ("dl", *_PARTS)), "dd": (("dt", "dd"), ("dl", *_PARTS)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
NEVER = frozenset("head button input select option textarea canvas audio video datalist annotation annotation-xml".split())

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^"'>]++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+(?:>|\Z)""", re.S
)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    chars: int = 0
    link_chars: int = 0
    stops: int = 0
    content: int | None = None  # the label of a training page


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node("#root", -1)])
    texts: list[tuple[int, int, str]] = field(default_factory=list)  # block, node, decoded text


class _Open:
    """The open elements and the node of each, with the places of every tag among them: a step doesn't depend on the depth."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("#root", 0)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.never = 0

    def push(self, tag: str, node: int) -> None:
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, node))
        self.never += tag in NEVER

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, tags: tuple[str, ...], scope: tuple[str, ...] = ()) -> bool:
        """Closes the nearest open element of ``tags``, and what is in it, unless one of ``scope`` is nearer."""
        at = self._last(tags)
        if not at or self._last(scope) > at:
            return False
        while len(self.stack) > at:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            self.never -= tag in NEVER
        return True


def parse(source: str) -> Page:
    """Blocks of a page in page order. Block elements, and inline ones that have a class, id or role, are nodes.

    Time is in proportion to the length, however deep elements nest or however many are left open.
    """
    page = Page()
    open_, block, at = _Open(), 0, 0
    nodes, stack = page.nodes, open_.stack

    def put(raw: str) -> None:
        if open_.never:
            if not open_.places["head"] or not raw.strip():
                return
            open_.close(("head",))  # text ends a head that was left open
            if open_.never:
                return
        s = html.unescape(raw)
        node = nodes[stack[-1][1]]
        n = len(s) - s.count(" ")
        node.chars += n
        node.stops += s.count(".") + s.count(",")
        if any(t == "a" for t, _ in stack[-4:]):
            node.link_chars += n
        page.texts.append((block, stack[-1][1], s))

    size = len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        if not m:
            put(source[at:])
            break
        if m.start() > at:
            put(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            block += 1
        if m[1]:
            open_.close((tag,), ("table", "td", "th") if tag in ("p", "li") or tag in INLINE else ())
            continue
        if tag not in IN_HEAD and open_.places["head"]:
            open_.close(("head",))
        if tag in RAW:
            end = _raw_end(tag).search(source, at)
            at = end.start() if end else size
            if tag == "title" and end is None:
                at = m.end()
            open_.push(tag, stack[-1][1])
            continue
        if tag in CLOSES_P:
            open_.close(("p",), ("table", "td", "th", "button"))
        if tag in ENDS:
            while open_.close(*ENDS[tag]):
                pass
        names = tuple(p for x in _NAMED.finditer(m[3]) for p in _PART.findall((x[1] or x[2] or x[3] or "").lower())) if m[3] else ()
        if tag in VOID:
            if tag == "br":
                page.texts.append((block, stack[-1][1], " "))
            continue
        if tag in INLINE and not names:
            open_.push(tag, stack[-1][1])
        else:
            nodes.append(Node(tag, stack[-1][1], names))
            open_.push(tag, len(nodes) - 1)
        if m[3].rstrip().endswith("/") and tag in INLINE:
            open_.close((tag,))
    return page


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


def features(page: Page) -> list[list[str]]:
    below = [n.chars for n in page.nodes]
    links = [n.link_chars for n in page.nodes]
    for i in range(len(page.nodes) - 1, 0, -1):
        below[page.nodes[i].parent] += below[i]
        links[page.nodes[i].parent] += links[i]
    out = []
    for i, n in enumerate(page.nodes):
        if n.tag in ("#root", "html", "body", "head"):
            out.append(["tag=" + n.tag])
            continue
        f = ["bias", "tag=" + n.tag, f"own={min(n.chars, 4000).bit_length()}", f"below={min(below[i], 4000).bit_length()}"]
        f += ["name=" + x for x in dict.fromkeys(n.names)]
        f += [f"in={n.tag}<{page.nodes[n.parent].tag}", f"share={4 * below[i] // max(below[0], 1)}"]
        f.append(f"links={4 * links[i] // max(below[i], 1)}")
        f.append(f"stops={min(n.stops, 3)}" if n.chars else "bare")
        out.append(f)
    return out


State = dict[str, float]


def _edge(n: Node) -> str:
    return "text" if n.tag in ("p", "h1", "h2", "h3", "li", "td", "blockquote", "pre", "#root") else "part"


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(page: Page, own: list[float], w: State) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """Chance of content for each node, and of each (parent, child) pair of states, by sum-product on the tree.

    Messages are differences of logs. Upward, a child tells its parent what its subtree says; downward, a parent tells a
    child what all the rest says.
    """
    nodes = page.nodes
    n = len(nodes)
    e = [tuple(w.get(f"{_edge(x)}{a}{b}", 0.0) for a in (0, 1) for b in (0, 1)) for x in nodes]
    inside, up = list(own), [0.0] * n
    for i in range(n - 1, 0, -1):
        e00, e01, e10, e11 = e[i]
        up[i] = _log_sum(e10, e11 + inside[i]) - _log_sum(e00, e01 + inside[i])
        inside[nodes[i].parent] += up[i]
    total, pairs = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * n
    total[0] = inside[0]
    for i in range(1, n):
        rest = total[nodes[i].parent] - up[i]
        e00, e01, e10, e11 = e[i]
        total[i] = inside[i] + _log_sum(e01, e11 + rest) - _log_sum(e00, e10 + rest)
        logs = (e00, e01 + inside[i], e10 + rest, e11 + rest + inside[i])
        top = max(logs)
        p = [math.exp(x - top) for x in logs]
        s = sum(p)
        pairs[i] = tuple(x / s for x in p)
    return [1 / (1 + math.exp(-max(-50.0, min(50.0, x)))) for x in total], pairs


def unary(fs: list[list[str]], w: State) -> list[float]:
    get = w.get
    return [sum(get(x, 0.0) for x in f) for f in fs]


# ---- labelled pages ---------------------------------------------------------------------------------------------------

_CONTENT = ["article", "main", "content", "post", "entry", "story", "text", "body", "page"]
_KINDS = {
    "nav": (["nav", "ul", "div", "menu"], ["nav", "menu", "navbar", "navigation", "topnav", "links"]),
    "header": (["header", "div"], ["header", "masthead", "top", "branding", "site"]),
    "footer": (["footer", "div"], ["footer", "bottom", "copyright", "legal"]),
    "side": (["aside", "div", "section"], ["sidebar", "side", "widget", "related", "recommended", "popular", "trending"]),
    "notice": (["div", "section", "aside"], ["notice", "cookie", "consent", "banner", "alert", "gdpr", "modal", "popup", "overlay", "message"]),
    "ad": (["div", "aside", "section", "ins"], ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion"]),
    "form": (["form", "div", "section"], ["newsletter", "subscribe", "signup", "login", "search", "form"]),
    "comments": (["section", "div", "ol"], ["comments", "comment", "discussion", "replies", "responses", "disqus", "thread"]),
    "share": (["div", "ul"], ["share", "social", "tools", "breadcrumb", "breadcrumbs", "tags", "pagination", "pager", "meta"]),
}


def training_page(r: random.Random) -> Page:
    """An invented page whose blocks are labelled: content in one part of it, other kinds around and inside that part."""
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(1, 9)))
    words = lambda a, b: " ".join(word() + r.choice(["", "", "", "", ",", "."]) for _ in range(r.randint(a, b)))

    def tag(name: str, inner: str, label: int, names: list[str] | None = None) -> str:
        return f'<{name} data-y="{label}"{" class=" + chr(34) + " ".join(names) + chr(34) if names else ""}>{inner}</{name}>'

    def other(kind: str, depth: int = 0) -> str:
        tags, names = _KINDS[kind]
        name = r.choice(tags)
        plain = name in ("nav", "header", "footer", "aside", "form", "menu") and r.random() < 0.6
        own = None if plain else r.sample(names, r.randint(1, min(2, len(names))))
        style = r.random()
        if kind == "nav" or kind in ("share", "footer", "side") and style < 0.5:
            items = "".join(tag("li", f'<a href="/{word()}">{words(1, 4)}</a>', 0) for _ in range(r.randint(2, 8)))
            inner = items if name in ("ul", "ol", "menu") else tag("ul", items, 0)
        elif kind == "comments":
            one = lambda: tag(r.choice(["div", "li", "div", "li", "article"]), tag("p", words(4, 60), 0), 0, r.choice([None, ["comment"], ["reply"]]))
            inner = tag("h3", words(1, 3), 0) + "".join(one() for _ in range(r.randint(1, 5)))
        elif style < 0.3:
            inner = words(2, 40)
        else:
            inner = "".join(tag(r.choice(["p", "div", "span", "h3", "h4"]), words(2, 30), 0) for _ in range(r.randint(1, 3)))
        if kind == "header" and r.random() < 0.4 and not depth:
            inner += other("nav", 1)
        return tag(name, inner, 0, own)

    def part() -> str:
        x = r.random()
        if x < 0.72:
            return tag("p", ("<b>" if r.random() < 0.1 else "") + words(1, long), 1)
        if x < 0.8:
            return tag(r.choice(["h2", "h3", "h4"]), words(1, 8), 1)
        if x < 0.87:
            return tag(r.choice(["ul", "ol"]), "".join(tag("li", words(1, 20), 1) for _ in range(r.randint(1, 5))), 1)
        if x < 0.93:
            return tag(r.choice(["blockquote", "pre", "figure", "div", "section"]), tag("p", words(1, long), 1) if r.random() < 0.6 else words(1, long), 1)
        return tag("table", tag("tr", "".join(tag("td", words(1, 6), 1) for _ in range(3)), 1), 1)

    long = r.choice([6, 25, 90, 90])  # some pages have little text
    inner = tag("h1", words(1, 9), 1) if r.random() < 0.85 else ""
    if r.random() < 0.2:
        inner = tag("header", inner, 1)
    for _ in range(r.randint(1, r.choice([2, 12]))):
        inner += part()
        if r.random() < 0.12:
            inner += other(r.choice(["ad", "side", "share", "form", "notice", "nav"]))
    if r.random() < 0.2:
        inner += other(r.choice(["comments", "share", "footer"]))
    x = r.random()
    main = tag("article", inner, 1, r.sample(_CONTENT, 1) if r.random() < 0.4 else None) if x < 0.5 else tag("main", inner, 1) if x < 0.65 else tag("div", inner, 1, r.sample(_CONTENT, r.randint(1, 2)))
    if r.random() < 0.4:
        main = tag(r.choice(["div", "main", "section"]), main, 1, r.choice([None, ["content"], ["wrap"], ["main"]]))
    pick = lambda ks, p: "".join(other(k) for k in ks if r.random() < p)
    body = pick(["notice", "header", "nav", "ad", "share", "form", "side"], 0.45) + main + pick(["comments", "side", "ad", "share", "form", "notice", "footer"], 0.45)
    if r.random() < 0.1:
        body = main
    if r.random() < 0.05:
        body = tag("form", body, 0)  # some frameworks put a whole page in a form
    source = f'<html data-y="0"><head><title>{words(1, 5)}</title></head><body data-y="0">{body}</body></html>' if r.random() < 0.9 else r.choice([body, main])  # or a fragment
    page = parse(source)
    labels = iter([int(m[2]) for m in re.finditer(r'<([a-z0-9]+) data-y="(\d)"( class)?', source) if m[1] not in INLINE or m[3]])
    for n in page.nodes[1:]:
        n.content = 0 if n.tag == "head" else next(labels)
    page.nodes[0].content = 0
    return page


@lru_cache(maxsize=2)
def train(pages: int = 400, epochs: int = 6, seed: int = 7) -> State:
    """Weights by stochastic gradient ascent (Adagrad) on the likelihood of labelled pages: observed less expected counts."""
    r = random.Random(seed)
    data = [training_page(r) for _ in range(pages)]
    seen = [(p, features(p)) for p in data]
    w: State = defaultdict(float)
    square: State = defaultdict(lambda: 1e-6)
    for _ in range(epochs):
        r.shuffle(seen)
        for page, fs in seen:
            p, pairs = marginals(page, unary(fs, w), w)
            grad: State = defaultdict(float)
            for i, n in enumerate(page.nodes):
                for f in fs[i]:
                    grad[f] += n.content - p[i]
                if i:
                    k = _edge(n)
                    grad[f"{k}{page.nodes[n.parent].content}{n.content}"] += 1
                    for j, x in enumerate(pairs[i]):
                        grad[f"{k}{j >> 1}{j & 1}"] -= x
            for f, g in grad.items():
                g -= 1e-4 * w[f]
                square[f] += g * g
                w[f] += 0.3 * g / math.sqrt(square[f])
    return dict(w)


def main_text(source: str | None, w: State) -> str:
    """The blocks whose node is more likely content than not: white space is one space, blocks are joined by a line end."""
    if not source:
        return ""
    page = parse(source)
    p, _ = marginals(page, unary(features(page), w), w)
    out: list[str] = []
    block, held = -1, []
    for b, node, s in [*page.texts, (-2, 0, "")]:
        if b != block:
            if line := " ".join("".join(held).split()):
                out.append(line)
            block, held = b, []
        if b >= 0 and (p[node] >= 0.5):
            held.append(s)
    return "\n".join(out)


def extract_text(df: DataFrame, html_column: str = "html") -> DataFrame:
    """``df`` with ``text`` and ``n_chars`` (long; code points); columns of those names are replaced.

    The whole source is read; a null or empty one, or one without content, gives an empty text. Broken markup is read as
    browsers do where it matters (implied ends, unclosed quotes, comments and raw elements up to the end). Repeated rows
    give equal texts; no rows give no rows. Nothing is shuffled; the model (some hundred weights) is broadcast.
    """
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(train())
    own = [c for c in df.columns if c not in ("text", "n_chars")]
    d = df.select(*own, F.col(html_column).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), held.value) for x in b.column("__html")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*own, "text", "n_chars"])

    from pyspark.sql import types as T

    schema = T.StructType([*[f for f in d.schema if f.name != "__html"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return d.mapInArrow(run, schema)
