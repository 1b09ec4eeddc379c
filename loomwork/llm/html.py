"""Main text of pages by a tree-structured model of the DOM.

A page is read into a tree of block elements and text runs. Every node is
content or not; a node's potential is a linear function of its tag, attribute
words and text shape, and a 2 x 2 potential ties it to its parent. Sum-product
messages, leaves to root and back, give each text run's marginal; runs at one
half or more are the main text. The weights are trained by the conditional
likelihood of labelled pages, drawn from page templates with known content.

Defined results
* null or empty html, and pages without main text: empty text.
* a page cut off anywhere is read up to there; a tag cut off by the end or by
  another ``<`` outside quotes is markup without effect.
* scripts, styles, titles, comments and the like never give text.
* white space in a block becomes one space; ``br`` is white space; blocks are joined by newlines.
* ties (one half exactly) are content; repeated rows repeat; empty table: empty result.
* other columns pass through, but those named like the html or the text column, in any letter case, give way.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.names import others
from loomwork.session import ship

#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp template svg math head".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter nobr output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var video audio canvas object wbr".split()
)
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "body": frozenset(["head"]), "tbody": frozenset(["tbody", "thead", "tr", "td", "th"]),
}
SCOPES = frozenset("ul ol dl table select html body div section article".split())

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?][^>]*+(?:>|\Z)|<[/a-zA-Z][^<>]*+(?:(?=<)|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|itemprop|aria-label|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Tree:
    """Nodes in page order, parents first; ``text`` is None for elements."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, tag: str, parent: int, attrs: str = "", text: str | None = None, linked: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attrs.append(attrs)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


def parse(page: str) -> Tree:
    """The tree of block elements and text runs; inline elements only mark links.

    ``where`` has the open places of each tag and ``blocks`` those of all block
    elements, so that no tag looks through the stack: the cost is linear.
    """
    tree = Tree()
    root = tree.add("#root", -1)
    stack: list[tuple[str, int]] = [("#root", root)]  # open elements; inline ones have their block's node
    where: defaultdict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []
    run: list[str] = []
    links, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal links
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                tree.add("#text", stack[-1][1], text=text, linked=min(links, len(text)))
            run.clear()
        links = 0

    def put(text: str) -> None:
        nonlocal links
        if text:
            run.append(text)
            if in_link:
                links += len(text.strip())

    def pop_to(depth: int) -> None:
        nonlocal in_link
        if blocks and blocks[-1] >= depth:
            flush()
        while len(stack) > depth:
            tag, _ = stack.pop()
            if tag:
                where[tag].pop()
                in_link -= tag == "a"
        while blocks and blocks[-1] >= depth:
            blocks.pop()

    def push(tag: str, node: int) -> None:
        where[tag].append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append((tag, node))

    def last(tags: frozenset[str]) -> int:
        return max((where[t][-1] for t in tags if where[t]), default=0)

    size = len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if where[name]:
                pop_to(where[name][-1])
            elif name == "p":
                flush()
            continue
        if name in RAW and name != "head":
            if name not in INLINE and name in ("textarea", "iframe"):
                flush()
            if not m[3].endswith("/"):
                end = re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name in INLINE:
            if name in VOID:
                put(" ")
            elif not m[3].endswith("/"):
                if name == "a":
                    if in_link:  # a link ends the one before, not what lies within it
                        depth = where["a"].pop()
                        stack[depth] = ("", stack[depth][1])
                        in_link -= 1
                    in_link += 1
                push(name, stack[-1][1])
            continue
        flush()
        if name in CLOSES:
            depth = last(CLOSES[name])
            if depth and (name == "body" or depth > last(SCOPES)):
                pop_to(depth)
        if blocks and stack[blocks[-1]][0] == "p":  # a block ends an open paragraph
            pop_to(blocks[-1])
        node = tree.add(name, stack[-1][1], m[3])
        if name not in VOID and not m[3].endswith("/"):
            push(name, node)
    flush()
    return tree


def _bucket(n: int) -> str:
    return "1" if n < 2 else "3" if n < 4 else "8" if n < 9 else "20" if n < 21 else "60" if n < 61 else "long"


def node_features(tree: Tree, i: int) -> list[str]:
    """Names of a node's features; the first is its kind, which also picks its edge potential."""
    tag, text = tree.tag[i], tree.text[i]
    if text is None:
        out = ["tag=" + tag]
        if tree.attrs[i]:
            for m in _ATTR.finditer(tree.attrs[i]):
                key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDE.search(value)):
                    out.append("hidden")
                elif key not in ("style", "aria-hidden"):
                    out += ["attr=" + w for w in set(_WORD.findall(value))]
        return out
    words, n = text.count(" ") + 1, len(text)
    share = tree.linked[i] / n
    link = "0" if share == 0 else "some" if share < 0.5 else "most"
    out = ["#text", "in=" + tree.tag[tree.parent[i]], "words=" + _bucket(words), "link=" + link]
    out.append("stop" if text[-1] in ".!?:;…\"'»”)" else "nostop")
    if "©" in text[:40] or "copyright" in text[:40].lower():
        out.append("copyright")
    return out


@dataclass
class Model:
    unary: dict[str, float]
    edge: dict[str, tuple[float, float, float, float]]  # by child's kind: log potential of (parent, child) 00, 01, 10, 11


_NO_EDGE = (0.0, 0.0, 0.0, 0.0)


def marginals(parent: list[int], unary: list[float], edge: list[tuple[float, float, float, float]]) -> tuple[list[float], list[tuple]]:
    """P(content) of each node of one tree, and of each edge's four (parent, child) states.

    ``unary`` are log odds; ``edge[i]`` ties node i to its parent. Messages are
    log odds too: first from the leaves up, then from the root down.
    """
    n = len(parent)
    belief = list(unary)  # own potential and messages from below
    up = [0.0] * n
    for i in range(n - 1, 0, -1):
        a, b, c, d = edge[i]
        o = min(30.0, max(-30.0, belief[i]))
        x = exp(o)
        up[i] = m = log((exp(c) + exp(d) * x) / (exp(a) + exp(b) * x))
        belief[parent[i]] += m
    full = list(belief)
    pairs: list[tuple] = [()] * n
    for i in range(1, n):
        p = parent[i]
        a, b, c, d = edge[i]
        rest = min(30.0, max(-30.0, full[p] - up[i]))  # the parent without this child
        y, x = exp(rest), exp(min(30.0, max(-30.0, belief[i])))
        s00, s01, s10, s11 = exp(a), exp(b) * x, exp(c) * y, exp(d) * x * y
        z = s00 + s01 + s10 + s11
        pairs[i] = (s00 / z, s01 / z, s10 / z, s11 / z)
        full[i] = belief[i] + log((exp(b) + exp(d) * y) / (exp(a) + exp(c) * y))
    return [1 / (1 + exp(-min(30.0, max(-30.0, o)))) for o in full], pairs


def potentials(tree: Tree, model: Model) -> tuple[list[float], list[tuple]]:
    unary, edge = [], []
    for i in range(len(tree.tag)):
        f = node_features(tree, i)
        unary.append(sum(model.unary.get(x, 0.0) for x in f))
        edge.append(model.edge.get(f[0]) or model.edge.get("*", _NO_EDGE))
    return unary, edge


def main_text(page: str, model: Model) -> str:
    tree = parse(page)
    p, _ = marginals(tree.parent, *potentials(tree, model))
    return "\n".join(t for t, x in zip(tree.text, p, strict=True) if t is not None and x >= 0.5)


# Labelled pages -------------------------------------------------------------

#: Attribute words of page furniture and of articles, as pages use them.
FURNITURE = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topbar toolbar pagination pager tabs skip",
    "header": "header masthead site banner top logo branding hero",
    "footer": "footer foot colophon copyright legal bottom",
    "aside": "aside sidebar side rail widget related recommended popular trending more",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promoted promotion dfp",
    "notice": "notice alert cookie cookies consent gdpr message warning banner popup modal overlay paywall subscribe newsletter signup",
    "comments": "comments comment reply replies discussion disqus respond responses thread",
    "form": "form search login register contact signup",
    "share": "share sharing social follow tools meta byline tags",
}
CONTENT = "article main content post entry story body text page prose primary single copy maincontent"


def sample_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and its main text's blocks."""
    kept: list[str] = []
    syllables = [a + b for a in "bcdfglmnprstv" for b in ("a", "e", "i", "o", "un", "er")]

    def words(low: int, high: int) -> str:
        made = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(low, high))]
        return " ".join(made).capitalize() + rng.choice([".", ".", ".", "!", "?", "", ":"])

    def keep(text: str) -> str:
        kept.append(text)
        return text

    def attrs(pool: str, tag: str = "") -> str:
        if rng.random() < (0.35 if tag in ("nav", "header", "footer", "aside", "article", "main", "form") else 0):
            return ""
        some = pool.split()
        name = rng.choice(some)
        if rng.random() < 0.4:
            name += rng.choice(["-", "_", " "]) + rng.choice(["box", "wrap", "inner", "list", "item", "main1", "x", "area", rng.choice(some)])
        return f' {rng.choice(["class", "class", "id", "role"])}="{name}"'

    def links(low: int, high: int) -> str:
        items = [f'<a href="/{rng.random()}">{words(1, 4)}</a>' for _ in range(rng.randint(low, high))]
        if rng.random() < 0.5:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return rng.choice([" ", " | ", "<br>"]).join(items)

    def furniture(kind: str) -> str:
        tag = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div"], "form": ["form"], "comments": ["section", "div", "ol"]}.get(kind, ["div", "section", "p"])
        tag = rng.choice(tag)
        a = attrs(FURNITURE[kind], tag)
        if tag == "ul":
            return f"<ul{a}>" + "".join(f'<li><a href="/">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 7))) + "</ul>"
        if kind == "nav":
            body = links(2, 9)
        elif kind == "header":
            body = rng.choice(["", f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 9)}</p>", f"<a href='/'>{words(1, 3)}</a>"]) + rng.choice(["", links(2, 5)]) or words(1, 4)
        elif kind == "footer":
            body = rng.choice(["&copy; 2020 ", "&copy; ", "Copyright ", "", ""]) + words(2, 12) + rng.choice(["", links(2, 5), f"<p>{words(3, 20)}</p>", " &middot; " + words(4, 30)])
        elif kind == "aside":
            body = rng.choice(["", f"<h3>{words(1, 4)}</h3>"]) + rng.choice([links(2, 6), f"<p>{words(4, 40)}</p>", f"<p>{words(4, 30)}</p><p>{words(4, 30)}</p>"])
        elif kind == "comments":
            inner = rng.choice(["div", "li", "article"])
            body = rng.choice(["", f"<h3>{words(1, 4)}</h3>"]) + "".join(f"<{inner}{attrs(FURNITURE['comments'])}>" + rng.choice([f"<b>{words(1, 2)}</b> ", f"<cite>{words(1, 2)}</cite>", ""]) + f"<p>{words(3, 60)}</p></{inner}>" for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            body = rng.choice([f"<label>{words(1, 4)}</label><input name=q>", f"<p>{words(3, 20)}</p><input><button>{words(1, 2)}</button>", f"<select><option>{words(1, 2)}<option>{words(1, 2)}</select><button>{words(1, 2)}</button>"])
        elif kind == "share":
            body = rng.choice([links(2, 5), words(1, 5), f"<span>{words(1, 3)}</span> <time>{words(1, 3)}</time>"])
        else:
            body = words(3, 45) if tag == "p" or rng.random() < 0.5 else f"<p>{words(3, 45)}</p>" + rng.choice(["", f"<button>{words(1, 2)}</button>", links(1, 2)])
        return f"<{tag}{a}{' hidden' if rng.random() < 0.04 else ''}>{body}</{tag}>"

    def paragraph() -> str:
        text = keep(words(*rng.choice([(1, 6), (5, 30), (20, 120)])))
        shape = rng.random()
        if shape < 0.15 and " " in text:
            first, rest = text.split(" ", 1)
            return rng.choice([f"<p><a href='/'>{first}</a> {rest}</p>", f"<p><b>{first}</b> {rest}</p>", f"<p>{first}<br>{rest}</p>"])
        if shape < 0.25:
            return f"<p><b>{text}<br>"
        return f"<p>{text}" + ("" if shape < 0.35 else "</p>")

    def block() -> str:
        kind = rng.random()
        if kind < 0.62:
            return paragraph()
        if kind < 0.72:
            level = rng.randint(2, 4)
            return f"<h{level}>{keep(words(1, 9))}</h{level}>"
        if kind < 0.80:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{keep(words(2, 25))}</li>" for _ in range(rng.randint(1, 5))) + f"</{tag}>"
        if kind < 0.85:
            return f"<blockquote>{keep(words(5, 40))}</blockquote>"
        if kind < 0.89:
            return f"<pre>{keep(words(3, 30))}</pre>"
        if kind < 0.93:
            return "<table>" + "".join(f"<tr><td>{keep(words(1, 5))}</td><td>{keep(words(1, 9))}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if kind < 0.96:
            return f"<figure><img src=x><figcaption>{keep(words(3, 15))}</figcaption></figure>"
        return f"<div>{keep(words(8, 60))}</div>"

    def article() -> str:
        tag = rng.choice(["article", "article", "main", "div", "section"])
        inner = rng.random() < 0.3
        out = f"<{tag}{attrs(CONTENT, tag)}>" + (f"<div{attrs(CONTENT)}>" if inner else "")
        if rng.random() < 0.85:
            out += f"<h1>{keep(words(2, 12))}</h1>"
        if rng.random() < 0.2:
            out += furniture("share")
        for _ in range(rng.randint(0 if rng.random() < 0.05 else 1, 12)):
            out += block()
            if rng.random() < 0.08:
                out += furniture(rng.choice(["ad", "aside", "notice", "form", "share", "nav"]))
        if inner:
            out += "</div>"
        if rng.random() < 0.2:
            out += furniture(rng.choice(["comments", "share", "aside", "form"]))
        return out + f"</{tag}>"

    top = [furniture(k) for k in ("nav", "header", "notice", "ad", "form") if rng.random() < (0.7 if k == "nav" else 0.35)]
    rng.shuffle(top)
    page = "<!DOCTYPE html><html><head><title>" + words(2, 8) + "</title><style>p{margin:0}</style></head><body>" + "".join(top)
    wrap = rng.random() < 0.4
    page += f"<div{attrs('wrap wrapper container page site layout row')}>" if wrap else ""
    page += article() + ("<!-- " + words(1, 3) + " -->" if rng.random() < 0.3 else "")
    for k in ("aside", "comments", "ad", "form"):
        if rng.random() < 0.35:
            page += furniture(k)
    page += "</div>" if wrap else ""
    if rng.random() < 0.85:
        page += furniture("footer")
    if rng.random() < 0.85:
        page += "</body></html>"
    return page, [" ".join(x.split()) for x in kept]


def label(tree: Tree, kept: list[str]) -> list[int]:
    """A run is content if it is the next kept block; an element if it holds content."""
    y, k = [0] * len(tree.tag), 0
    for i, text in enumerate(tree.text):
        if text is not None and k < len(kept) and text == kept[k]:
            y[i] = 1
            k += 1
    for i in range(len(y) - 1, 0, -1):
        if y[i]:
            y[tree.parent[i]] = 1
    return y


@lru_cache(maxsize=2)
def train(pages: int = 300, rounds: int = 25, seed: int = 5, decay: float = 0.02) -> Model:
    """Adagrad on the conditional likelihood of ``pages`` drawn pages, unless labelled pages are given to ``fit``."""
    rng = random.Random(seed)
    return fit([sample_page(rng) for _ in range(pages)], rounds=rounds, decay=decay, seed=seed)


def fit(labelled: list[tuple[str, list[str]]], *, rounds: int = 25, decay: float = 0.02, seed: int = 5) -> Model:
    rng = random.Random(seed)
    names: dict[str, int] = {}
    kinds: dict[str, int] = {"*": 0}
    data = []
    for page, kept in labelled:
        tree = parse(page)
        feats = [node_features(tree, i) for i in range(len(tree.tag))]
        ids = [[names.setdefault(x, len(names)) for x in f] for f in feats]
        data.append((tree.parent, ids, [kinds.setdefault(f[0], len(kinds)) for f in feats], label(tree, kept)))
    w, e = [0.0] * len(names), [[0.3, -0.3, -0.3, 0.3] for _ in kinds]
    gw, ge = [1e-6] * len(names), [[1e-6] * 4 for _ in kinds]
    order = list(range(len(data)))
    for _ in range(rounds):
        rng.shuffle(order)
        for start in range(0, len(order), 20):
            dw: dict[int, float] = {}
            de: dict[int, list[float]] = {}
            for at in order[start : start + 20]:
                parent, ids, kind, y = data[at]
                p, pairs = marginals(parent, [sum(w[f] for f in x) for x in ids], [tuple(e[k]) for k in kind])
                for i, fs in enumerate(ids):
                    over = y[i] - p[i]
                    for f in fs:
                        dw[f] = dw.get(f, 0.0) + over
                    if i:
                        for k in (kind[i], 0):
                            g = de.setdefault(k, [0.0] * 4)
                            for s in range(4):
                                g[s] -= pairs[i][s]
                            g[2 * y[parent[i]] + y[i]] += 1
            for f, g in dw.items():
                g -= decay * w[f]
                gw[f] += g * g
                w[f] += 0.3 * g / gw[f] ** 0.5
            for k, gs in de.items():
                for s in range(4):
                    g = gs[s] - decay * e[k][s]
                    ge[k][s] += g * g
                    e[k][s] += 0.3 * g / ge[k][s] ** 0.5
    return Model({x: w[i] for x, i in names.items()}, {x: tuple(e[i]) for x, i in kinds.items()})


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html", text_col: str = "text", *, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but the html by default) and the main text."""
    keep = others(pages.columns if keep is None else keep, html_col, text_col)
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField(text_col, T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                made = [main_text(x.as_py() or "", own) for x in batch.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(made, pa.string())], names=schema.names)

    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("__lw_html")).mapInArrow(each, schema)
