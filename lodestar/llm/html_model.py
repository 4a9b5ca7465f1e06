"""Pages as trees, the tree-structured model over them, and its labelled pages."""

from __future__ import annotations

import html
import math
import random
import re
from dataclasses import dataclass, field

import numpy as np

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>|<[/!?a-zA-Z][^<>]*\Z",
    re.S,
)
MARK = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Za-z]+")
#: Elements that don't end a block; their text is their block's. Parts of formulas are among them.
INLINE = frozenset(
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts none mstyle mspace mpadded mphantom menclose merror maction semantics "
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never a page's text.
SILENT = frozenset("script style template noscript svg iframe select textarea button title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: What a head holds; any other element or text ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta noscript script style template title".split())
#: Elements that end an open svg unless they stand where it holds html.
ENDS_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
SVG_HTML = frozenset("foreignobject desc title".split())
#: Silent elements that may lack an end tag, with the elements that don't end them then.
UNCLOSED = {"button": frozenset(), "select": frozenset("option optgroup hr".split())}
#: Elements that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table".split())


@dataclass
class Tree:
    """Nodes in page order: parents stand before children. segments: (node, text) in page order."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    marks: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])
    segments: list[tuple[int, str]] = field(default_factory=list)


def parse(page: str) -> Tree:
    """The block elements of a page as a tree; inline elements belong to their block."""
    tree = Tree()
    stack, in_link, at = [0], 0, 0
    # silent: the open silent element; inner: what is open inside it; closed: whether its end tag comes next
    silent, inner, closed = "", [], True
    in_head = False
    closers: dict[str, re.Pattern] = {}

    def text(raw: str) -> None:
        nonlocal in_head
        if in_head and not silent:
            if raw.isspace():
                return
            in_head = False
        if not silent and raw:
            if "&" in raw:
                raw = html.unescape(raw)
            tree.segments.append((stack[-1], raw))
            if in_link:
                tree.linked[stack[-1]] += len(raw)

    def pop_to(tag: str, stops: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            name = tree.tag[stack[k]]
            if name == tag:
                del stack[k:]
                return
            if name in stops:
                return

    while m := TAG.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        empty = (rest or "").endswith("/")
        foreign = silent == "svg" or "svg" in inner or "math" in inner
        if name in RAW and not closing and not empty and (not foreign or name in ("script", "style")):
            end = closers.get(name) or closers.setdefault(name, re.compile(rf"</{name}\b[^>]*>|\Z", re.I))
            at = end.search(page, at).end()
            continue
        if silent:
            if closing:
                if name in inner:
                    del inner[len(inner) - 1 - inner[::-1].index(name) :]
                    continue
                if name == silent:
                    silent = ""
                    continue
                if name == "a":
                    in_link = 0
                if not any(tree.tag[i] == name for i in stack):
                    continue
                silent = ""  # an enclosing element closes
            else:
                if silent == "svg":
                    ends = name in ENDS_SVG and not SVG_HTML.intersection(inner)
                else:
                    ends = not closed and not foreign and "template" not in inner and name not in INLINE | VOID | UNCLOSED[silent]
                if not ends:
                    if name not in VOID and not (empty and foreign):
                        inner.append(name)
                    continue
                silent = ""
            inner = []
        if in_head and (name in ("head", "body", "html", "br") if closing else name not in IN_HEAD):
            in_head = False
        if name == "head":
            in_head = not closing and len(tree.tag) <= 2
            continue
        if name in SILENT:
            if not closing and not empty:
                silent, inner, closed = name, [], True
                if name in UNCLOSED:
                    own = closers.get(name) or closers.setdefault(name, re.compile(rf"<(/?){name}\b", re.I))
                    following = own.search(page, at)
                    closed = following is not None and following[1] == "/"
            continue
        if in_head:
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            continue
        tree.segments.append((stack[-1], " "))
        if name in VOID:
            continue
        if closing:
            pop_to(name, frozenset())
            continue
        if name in ENDS_P:
            pop_to("p", frozenset(("td", "th", "li", "div", "article", "section", "main", "body")))
        for other in SAME_ENDS.get(name, ()):
            pop_to(other, SCOPES)
        tree.parent.append(stack[-1])
        tree.tag.append(name)
        tree.marks.append(" ".join(x for g in MARK.findall(rest) for x in g[1:] if x) if rest else "")
        tree.linked.append(0)
        stack.append(len(tree.tag) - 1)
    text(page[at:])
    return tree


def _size(n: int) -> int:
    return n.bit_length()


def node_features(tree: Tree) -> list[list[str]]:
    """Features of each node, from its element, its marks and its own and its descendants' text."""
    n = len(tree.tag)
    own, ends, commas = [0] * n, [0] * n, [0] * n
    for node, raw in tree.segments:
        if raw != " ":
            own[node] += len(raw)
            ends[node] += raw.count(". ") + raw.rstrip().endswith((".", "!", "?", "…", "。"))
            commas[node] += raw.count(",")
    below, linked, depth = own[:], tree.linked[:], [0] * n
    for i in range(n - 1, 0, -1):
        below[tree.parent[i]] += below[i]
        linked[tree.parent[i]] += linked[i]
    whole = max(1, below[0])
    out = []
    for i in range(n):
        up = tree.parent[i]
        if i:
            depth[i] = depth[up] + 1
        density = 0 if not linked[i] else 1 + int(3 * linked[i] / max(1, below[i]))
        f = [
            "t=" + tree.tag[i],
            "u=" + (tree.tag[up] if i else ""),
            f"own={_size(own[i])}",
            f"all={_size(below[i])}",
            f"link={density}",
            f"part={int(4 * below[i] / whole)}",
            f"ends={min(4, ends[i])}",
            f"commas={min(3, commas[i])}",
            f"depth={min(8, depth[i])}",
        ]
        if tree.marks[i]:
            f += ["m=" + x.lower() for x in PART.findall(tree.marks[i])]
        out.append(f)
    return out


@dataclass
class Model:
    """weights of features; pair[a][b]: log potential of a parent in state a and a child in b."""

    weights: dict[str, float]
    pair: list[list[float]]


def _ratio(x: float, a: float, b: float, c: float, d: float) -> float:
    """log((e^a + e^(b+x)) / (e^c + e^(d+x)))"""
    if x > 0:
        return math.log((math.exp(a - x) + math.exp(b)) / (math.exp(c - x) + math.exp(d)))
    return math.log((math.exp(a) + math.exp(b + x)) / (math.exp(c) + math.exp(d + x)))


def messages(parent: list[int], unary: list[float], pair: list[list[float]]):
    """Sum-product: log-odds gathered from below, messages up, log-odds from above, and full log-odds."""
    n = len(parent)
    (p00, p01), (p10, p11) = pair
    below, up, above, full = unary[:], [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        up[i] = m = _ratio(below[i], p10, p11, p00, p01)
        below[parent[i]] += m
    full[0] = below[0]
    for i in range(1, n):
        above[i] = d = full[parent[i]] - up[i]
        full[i] = below[i] + _ratio(d, p01, p11, p00, p10)
    return below, up, above, full


def unaries(model: Model, feats: list[list[str]]) -> list[float]:
    w = model.weights
    return [sum([w[f] for f in fs if f in w]) for fs in feats]


def content_marginals(model: Model, tree: Tree) -> list[float]:
    """Each node's probability of being content."""
    full = messages(tree.parent, unaries(model, node_features(tree)), model.pair)[3]
    return [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in full]


def main_text(model: Model, page: str | None) -> str:
    """The text of the nodes that are content, blocks in page order."""
    if not page:
        return ""
    tree = parse(page)
    kept = [p >= 0.5 for p in content_marginals(model, tree)]
    return " ".join("".join([raw if kept[node] else " " for node, raw in tree.segments]).split())


def fit(pages: list[tuple[Tree, list[int]]], steps: int = 80, ridge: float = 0.05) -> Model:
    """Gradient ascent on the likelihood of all nodes' labels; expectations by sum-product."""
    names: dict[str, int] = {}
    rows, cols, y, parent, offset = [], [], [], [], 0
    spans = []
    for tree, labels in pages:
        for i, fs in enumerate(node_features(tree)):
            for f in fs:
                rows.append(offset + i)
                cols.append(names.setdefault(f, len(names)))
        spans.append((offset, tree.parent))
        parent += [offset + p if p >= 0 else -1 for p in tree.parent]
        y += labels
        offset += len(labels)
    rows, cols, y, parent = (np.array(x, np.int64) for x in (rows, cols, y, parent))
    child = np.flatnonzero(parent >= 0)
    want = np.bincount(2 * y[parent[child]] + y[child], minlength=4)
    theta = np.zeros(len(names) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        pair = theta[-4:].reshape(2, 2).tolist()
        unary = np.bincount(rows, theta[:-4][cols], len(y)).tolist()
        below, above, full = [], [], []
        for at, up in spans:
            b, _, a, f = messages(up, unary[at : at + len(up)], pair)
            below += b
            above += a
            full += f
        p = 1 / (1 + np.exp(-np.clip(np.array(full), -500, 500)))
        d, u = np.array(above)[child], np.array(below)[child]
        joint = np.stack([np.zeros_like(d), u, d, d + u]) + theta[-4:, None]
        joint = np.exp(joint - joint.max(0))
        expected = (joint / joint.sum(0)).sum(1)
        grad = np.concatenate([np.bincount(cols, (y - p)[rows], len(names)), want - expected]) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model({f: float(theta[i]) for f, i in names.items()}, theta[-4:].reshape(2, 2).tolist())


#: Marks that pages put on their parts, by kind of part.
PART_MARKS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar pagination pager",
    "header": "header masthead banner branding logo site",
    "footer": "footer copyright bottom colophon legal",
    "side": "sidebar aside related widget recommended trending popular more side rail",
    "notice": "notice cookie consent alert gdpr message warning popup modal newsletter subscribe",
    "advert": "ad ads advert advertisement sponsor sponsored promo promoted banner",
    "form": "form search login signup contact",
    "comments": "comments comment reply replies discussion responses disqus thread",
    "share": "share social follow tags meta byline",
}
CONTENT_MARKS = "article content post main entry story body text page single"


def labelled_pages(count: int = 400, seed: int = 5) -> list[tuple[Tree, list[int]]]:
    """Pages put together at random with the label of each part: 1 for the article's nodes.

    Layouts vary in wrapping elements, marks, order and presence of parts, in
    lengths of text, and in whether pages are well formed or break off.
    """
    rng = random.Random(seed)

    def words(n: int) -> str:
        out = []
        for _ in range(n):
            w = "".join(rng.choice("abcdefghilmnoprstuvéöñ") for _ in range(rng.randint(2, 9)))
            out.append(w + rng.choice(["", "", "", "", "", ",", ".", " &amp;"]))
        return " ".join(out).capitalize()

    def sentence(low: int, high: int) -> str:
        return words(rng.randint(low, high)) + rng.choice([".", ".", ".", "!", ""])

    def links(n: int) -> str:
        items = [f'<a href="/x{i}">{words(rng.randint(1, 3))}</a>' for i in range(n)]
        if rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return rng.choice([" | ", " "]).join(items)

    def mark(kind: str, always: float = 0.8) -> str:
        if rng.random() > always:
            return ""
        pool = PART_MARKS.get(kind, CONTENT_MARKS).split()
        return f' {rng.choice(["class", "class", "id"])}="{" ".join(rng.sample(pool, rng.choice([1, 1, 2])))}"'

    def part(kind: str) -> str:
        tags = {"menu": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"],
                "side": ["aside", "aside", "div", "section"], "form": ["form"], "comments": ["section", "div", "div"]}
        tag = rng.choice(tags.get(kind, ["div", "div", "section", "p"]))
        named = tag in ("nav", "header", "footer", "aside", "form")
        m = mark(kind, 0.4 if named else 1.0)
        if kind == "menu":
            inner = links(rng.randint(3, 9))
        elif kind == "header":
            inner = f"<div>{words(rng.randint(1, 4))}</div>" + (links(3) if rng.random() < 0.5 else "") + rng.choice(["", f"<h2>{words(3)}</h2>", f"<p>{sentence(3, 8)}</p>"])
        elif kind == "footer":
            inner = rng.choice([f"&copy; {words(2)} &middot; {sentence(3, 12)}", f"<p>{sentence(4, 14)}</p>", links(4) + words(4)])
        elif kind == "side":
            inner = rng.choice(["", f"<h3>{words(2)}</h3>"]) + rng.choice([links(5), f"<p>{sentence(8, 30)}</p>", f"<div>{sentence(5, 15)}</div>" * 2])
        elif kind == "form":
            inner = f'<label>{words(2)}</label><input name="q"><p>{sentence(2, 8)}</p><button>{words(1)}</button>'
        elif kind == "comments":
            inner = rng.choice(["", f"<h3>{words(2)}</h3>"]) + "".join(
                f'<div{mark("comments", 0.7)}>' + rng.choice([f"<p>{sentence(5, 40)}</p>", f"<b>{words(1)}</b> {sentence(5, 40)}"]) + "</div>" for _ in range(rng.randint(1, 5)))
        elif kind == "share":
            inner = links(rng.randint(2, 5)) if rng.random() < 0.6 else words(rng.randint(2, 5))
        else:
            inner = rng.choice([sentence(3, 15), f"<p>{sentence(3, 25)}</p>", f'{sentence(3, 10)} <a href="/ok">{words(1)}</a>'])
        return f"<{tag}{m}>{inner}</{tag}>"

    def article() -> str:
        blocks = [f"<h1>{sentence(3, 14)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
            roll = rng.random()
            if roll < 0.72:
                body = sentence(1, 90)
                if rng.random() < 0.2:
                    body += f' <a href="/y">{words(2)}</a> {sentence(2, 20)}'
                blocks.append(rng.choice([f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<p><b>{body}<br>"]))
            elif roll < 0.8:
                blocks.append(f"<h{rng.choice('234')}>{words(rng.randint(1, 8))}</h2>".replace("</h2>", "</h2>"))
            elif roll < 0.86:
                blocks.append(rng.choice(["<ul>", "<ol>"]) + "".join(f"<li>{sentence(2, 25)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif roll < 0.9:
                blocks.append(f"<blockquote><p>{sentence(5, 40)}</p></blockquote>")
            elif roll < 0.94:
                blocks.append(f"<pre>{words(rng.randint(3, 30))}</pre>")
            elif roll < 0.97:
                blocks.append(f"<table><tr><td>{words(2)}</td><td>{sentence(2, 9)}</td></tr></table>")
            else:
                blocks.append(f"<div>{sentence(10, 60)}</div>")
        inside = [k for k in ("advert", "share", "side", "notice", "comments") if rng.random() < 0.12]
        for k in inside:
            blocks.insert(len(blocks) if k == "comments" else rng.randint(1, len(blocks)), f"<!--0-->{part(k)}<!--1-->")
        return "\n".join(blocks) if rng.random() < 0.3 else "".join(blocks)

    pages = []
    for _ in range(count):
        before = [part(k) for k in ("header", "menu", "notice", "advert", "form", "menu") if rng.random() < 0.45]
        after = [part(k) for k in ("share", "side", "comments", "advert", "form", "notice", "footer") if rng.random() < 0.45]
        rng.shuffle(before)
        wrap = rng.choice(["article", "article", "article", "main", "div", "div", "section", "none"])
        inner = article()
        if wrap == "none":
            core = f"<!--1-->{inner}<!--0-->"
        else:
            core = f"<!--1--><{wrap}{mark('content', 0.5 if wrap in ('article', 'main') else 1.0)}>{inner}</{wrap}><!--0-->"
        if rng.random() < 0.3:
            core = f"<{(t := rng.choice(['main', 'div']))}{mark('content', 0.5)}>{core}</{t}>"
        if rng.random() < 0.3:
            core = f'<div class="{rng.choice(["container", "wrapper", "row", "layout"])}">{core}{"".join(after)}</div>'
            after = [part("footer")] if rng.random() < 0.6 else []
        end = "</body></html>" if rng.random() < 0.85 else ""
        page = f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style></head><body>{''.join(before)}{core}{''.join(after)}{end}"
        pages.append(_labelled(page))
    return pages


def _labelled(page: str) -> tuple[Tree, list[int]]:
    """Labels by the page's <!--1--> and <!--0--> marks: a node's is the one that stands when it opens."""
    state = 0
    marked = []
    for piece in re.split(r"(<!--[01]-->)", page):
        if piece in ("<!--0-->", "<!--1-->"):
            state = int(piece[4])
        else:
            marked.append(re.sub(r"<([a-zA-Z][a-zA-Z0-9]*)", rf'<\1 itemprop="label{state}"', piece))
    tree = parse("".join(marked))
    labels = [int("label" in m and "label1" in m.split()) for m in tree.marks]
    tree.marks = [" ".join(x for x in m.split() if x not in ("label0", "label1")) for m in tree.marks]
    return tree, labels
