"""Main text of web pages by a tree-structured graphical model over DOM nodes.

The page is parsed leniently into its tree of block elements; inline markup belongs to the block around it, but an inline
element with a class, id or role is a node of its own inside that block. Each node has a hidden label, content or not.
Parent-child potentials tie a node's label to its parent's (a table each for containers, for elements that hold prose and
for inline nodes), node potentials to what the element shows: its tag, words of class, id and role, length and link share
of its own text, its share in the whole text of the page, and a copyright sign. Sum-product messages go up from the leaves and down from
the root, which on a tree gives exact marginals; the text of every node whose content marginal is at least one half is
kept, block by block in page order.

All potentials are counts with smoothing over labelled pages. There are no labelled pages in the tables, so
``labelled_pages`` makes a fixed number of them by rule (many layouts, languages and class names); pass pages of your own
to ``fit`` instead.

Defined results: null, empty and textless pages give an empty text; elements that are never shown (head, script, style,
template, form controls ...) hold no text; unclosed and crossed tags, tags cut off by the end and unknown references
are read as browsers do; repeated rows are extracted alike; extra columns are ignored. White space, also from
references, is Unicode white space; a line-break element counts as white space. A page takes time linear in its length.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML standard: elements that open a block, hold no markup, never close, or are never shown.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg select object video audio canvas button head".split())
#: Of these, the ones that hold no markup at all: they do not nest, and an unclosed one takes the rest of the page.
SWALLOWS = frozenset("script style textarea title xmp iframe noframes".split())
FOREIGN = frozenset(("svg",))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
SPLITS = frozenset(("br", "img", "input", "wbr"))
#: Elements that an opening of the same group ends, up to the element that bounds the search.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-label|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: A slash that ends a value without quotes belongs to the value.
_OPEN_VALUE = re.compile(r"=\s*[^\s\"'>][^\s\"'>]*/\Z")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Bounds of the classes of a node's share in the text of the page.
PARTS = (0.0, 0.05, 0.2, 0.5, 0.8)


@dataclass(slots=True)
class Node:
    tag: str
    names: tuple[str, ...]
    parent: int
    inline: bool = False
    within: bool = False  # in an article or main element
    letters: int = 0
    linked: int = 0
    part: int = 0  # class of its share in all letters of the page that are in no link
    signed: bool = False  # whether a short text of its own has a copyright sign


#: A block's text: parts in order, each with the node that it belongs to.
Run = list[tuple[int, str]]


def _names(attributes: str) -> tuple[str, ...]:
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        name = m[1].lower()
        if name == "style":
            if "display:none" in value.replace(" ", "").lower():
                out.append("hidden")
        elif name == "hidden":
            out.append("hidden")
        else:
            out += [w.lower() for w in _WORD.findall(value)]
    return tuple(dict.fromkeys(out))


_names_of: dict[str, tuple[str, ...]] = {"": ()}


def _closes_itself(tag: str, attributes: str) -> bool:
    return tag in FOREIGN and attributes.endswith("/") and not _OPEN_VALUE.search(attributes)


def _raw_ends(html: str, tag: str, at: int) -> dict[int, int]:
    """For the place after each opening tag of this name from ``at`` on, the place after its end tag; unclosed ones are left out."""
    ends, waiting = {}, []
    for x in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.I).finditer(html, at):
        if not x[1]:
            if not _closes_itself(tag, x[2]):
                waiting.append(x.end())
        elif waiting:
            ends[waiting.pop()] = x.end()
    return ends


def parse(html: str) -> tuple[list[Node], list[Run]]:
    """Nodes in page order, the root first and parents before children, and the runs of text between bounds of blocks."""
    nodes, runs = [Node("html", (), -1)], []
    stack: list[tuple[str, int]] = []  # open elements, each with the node it belongs to
    depths: dict[str, list[int]] = {}  # where in the stack the open elements of each name are
    blocks: list[int] = []  # where in the stack the open blocks are
    run: Run = []
    raw_ends: dict[str, dict[int, int]] = {}
    links, at, end = 0, 0, len(html)

    def flush() -> None:
        if run:
            if any(not x.isspace() for _, x in run):
                runs.append(run.copy())
            run.clear()

    def add(raw: str) -> None:
        own = stack[-1][1] if stack else 0
        text = unescape(raw) if "&" in raw else raw
        n = len(text) - text.count(" ")
        node = nodes[own]
        while True:  # an inline node's letters count for the block around it, too
            node.letters += n
            if links:
                node.linked += n
            if n < 200 and ("©" in text or "opyright" in text):
                node.signed = True
            if not node.inline:
                break
            node = nodes[node.parent]
        run.append((own, text))

    def push(tag: str, node: int) -> None:
        depths.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))

    def pop_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            tag, _ = stack.pop()
            depths[tag].pop()
            links -= tag == "a"
        while blocks and blocks[-1] >= depth:
            blocks.pop()

    def last(tags) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=-1)

    def close(tags, bounds) -> None:
        depth = last(tags)
        if depth >= 0 and depth > last(bounds):
            flush()
            pop_to(depth)

    while at < end:
        m = _MARKUP.search(html, at)
        if not m:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m.end() == end and not m[0].endswith(">"):
            break  # a tag cut off by the end of the page is dropped
        if m[1]:
            depth = last((tag,))
            if tag in BLOCKS:
                if depth >= 0:
                    flush()
                    pop_to(depth)
            elif depth > (blocks[-1] if blocks else -1):  # an inline end does not end a block
                pop_to(depth)
            continue
        if tag in RAW:
            if tag in SWALLOWS:
                x = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = x.end() if x else end
            elif not _closes_itself(tag, m[3]):
                # content up to its own end tag, nested ones of the same name counted; that of an unclosed one is read on
                if tag not in raw_ends:
                    raw_ends[tag] = _raw_ends(html, tag, m.start())
                at = raw_ends[tag].get(at, at)
            run.append((stack[-1][1] if stack else 0, " "))
            continue
        if tag in VOID:
            if tag == "hr":
                close(("p",), BLOCKS - {"p"})
                flush()
            elif tag in SPLITS:
                run.append((stack[-1][1] if stack else 0, " "))
            continue
        if tag in CLOSES_P:
            close(("p",), ("td", "th", "table", "body", "article", "section", "div", "li", "blockquote"))
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        block = tag in BLOCKS
        if block:
            flush()
            if tag == "html" and not stack and len(nodes) == 1:
                continue
        key = m[3].strip(" /\n\t")
        names = _names_of.get(key)
        if names is None:
            names = _names(key)
            if len(_names_of) < 50_000:
                _names_of[key] = names
        own = stack[-1][1] if stack else 0
        if block:
            blocks.append(len(stack))
            while nodes[own].inline:
                own = nodes[own].parent
        if block or names:
            nodes.append(Node(tag, names, own, not block, nodes[own].within or nodes[own].tag in ("article", "main")))
            own = len(nodes) - 1
        links += tag == "a"
        push(tag, own)
    flush()
    free = [0 if n.inline else n.letters - n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        free[nodes[i].parent] += free[i]
    for node, n in zip(nodes, free, strict=True):
        node.part = bisect_right(PARTS, n / free[0]) if n and not node.inline else 0
    return nodes, runs


def _size(n: int) -> int:
    return min(6, 1 + int(math.log2(1 + n)) // 2) if n else 0


def _kind(node: Node) -> int:
    return INLINE if node.inline else CONTAINER if node.tag in CONTAINERS else TEXTUAL


def _shown(node: Node) -> tuple[int, int, int, bool]:
    """Kind, classes of the length and the link share of a node's own text, copyright sign."""
    if node.inline:
        return INLINE, 0, 0, node.signed
    share = node.linked / node.letters if node.letters else 0.0
    return _kind(node), _size(node.letters), (1 + (share > 0.3) + (share > 0.8)) if node.letters else 0, node.signed


@dataclass
class TreeModel:
    """Log-odds of node potentials and the parent-child tables."""

    tags: dict[tuple[str, bool, bool], float]  # by whether it is inline, and whether it is in an article or main element
    names: dict[str, float]
    shown: dict[tuple, float]
    part: dict[tuple[int, int], float]  # by kind and class of the share
    root: float
    pair: dict[tuple[int, int, int], float]  # log of P(child label | parent label), by the kind of the child

    def evidence(self, node: Node) -> float:
        named, kind = sum(self.names.get(w, 0.0) for w in node.names), _kind(node)
        other = self.tags.get((node.tag, node.inline, node.within), 0.0) + self.shown.get(_shown(node), 0.0) + self.part.get((kind, node.part), 0.0)
        # tag, length and share of an element of prose say much the same, and counts take them for independent
        return named + other * (0.5 if kind == TEXTUAL else 1.0)


CONTAINER, TEXTUAL, INLINE = 0, 1, 2
CONTAINERS = frozenset("html body div section article main center header footer aside nav form table tbody tr td ul ol menu dl hgroup details fieldset".split())


def _odds(good: float, bad: float, good_all: float, bad_all: float, smooth: float, cap: float) -> float:
    x = math.log((good + smooth) / (good_all + 2 * smooth)) - math.log((bad + smooth) / (bad_all + 2 * smooth))
    return max(-cap, min(cap, x))


def labels_of(nodes: list[Node]) -> list[int]:
    """Labels of a marked page: those of the marks; else, around marked content, whether most of the letters in no link are
    content; else those of the nearest mark above, and no content without one."""
    marks = [0 if "zzboilerplate" in n.names else 1 if "zzcontent" in n.names else None for n in nodes]
    holds = [m == 1 for m in marks]
    for i in range(len(nodes) - 1, 0, -1):
        holds[nodes[i].parent] |= holds[i]
    plain: list[int] = []  # by the marks alone
    for node, mark in zip(nodes, marks, strict=True):
        plain.append(mark if mark is not None else plain[node.parent] if node.parent >= 0 else 0)
    free = [0 if n.inline else n.letters - n.linked for n in nodes]
    good = [f * label for f, label in zip(free, plain, strict=True)]
    for i in range(len(nodes) - 1, 0, -1):
        free[nodes[i].parent] += free[i]
        good[nodes[i].parent] += good[i]
    return [mark if mark is not None else int(2 * g > f) if h else own for mark, h, g, f, own in zip(marks, holds, good, free, plain, strict=True)]


def marked(page: str, marker: str = "data-content") -> str:
    """The page with its marks as roles, which the parser keeps."""
    return page.replace(f" {marker}", ' role="zzcontent"').replace(" data-boilerplate", ' role="zzboilerplate"')


def fit(pages: list[str], marker: str = "data-content") -> TreeModel:
    """The model of pages whose content elements carry the marker attribute, as those inside them do unless a
    ``data-boilerplate`` element is between."""
    tags, names, shown, part, pair, total = *(defaultdict(Counter) for _ in range(4)), Counter(), Counter()
    for page in pages:
        nodes, _ = parse(marked(page, marker))
        labels = labels_of(nodes)
        for node, own in zip(nodes, labels, strict=True):
            kind = _kind(node)
            real = [w for w in node.names if not w.startswith("zz")]
            if node.inline and not real:
                continue  # a node only by its mark
            total[own] += 1
            tags[(node.tag, node.inline, node.within)][own] += 1
            for w in real:
                names[w][own] += 1
            shown[_shown(node)][own] += 1
            part[(kind, node.part)][own] += 1
            if node.parent >= 0:
                pair[(kind, labels[node.parent], own)] += 1
    odds = lambda table, smooth, cap: {k: _odds(c[1], c[0], total[1], total[0], smooth, cap) for k, c in table.items()}
    log_pair = {(k, p, c): math.log((pair[(k, p, c)] + 1) / (pair[(k, p, 0)] + pair[(k, p, 1)] + 2)) for k in (CONTAINER, TEXTUAL, INLINE) for p in (0, 1) for c in (0, 1)}
    return TreeModel(odds(tags, 2, 6), odds(names, 1, 6), odds(shown, 10, 2), odds(part, 10, 2), math.log(0.8 / 0.2), log_pair)


def _message(x: float, a: float, b: float, c: float, d: float) -> float:
    """Log-odds that a neighbour with log-odds x sends through the table (a, b; c, d) of logs."""
    up = max(a + x, b) + math.log1p(math.exp(-abs(a + x - b)))
    low = max(c + x, d) + math.log1p(math.exp(-abs(c + x - d)))
    return up - low


def marginals(model: TreeModel, nodes: list[Node]) -> list[float]:
    """Content marginal of every node, by one upward and one downward pass."""
    tables = {k: [model.pair[(k, p, c)] for p, c in ((1, 1), (1, 0), (0, 1), (0, 0))] for k in (CONTAINER, TEXTUAL, INLINE)}
    kinds = [_kind(n) for n in nodes]
    belief = [model.evidence(n) for n in nodes]
    sent = [0.0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        sent[i] = _message(belief[i], *tables[kinds[i]])
        belief[nodes[i].parent] += sent[i]
    belief[0] += model.root
    for i in range(1, len(nodes)):
        above = belief[nodes[i].parent] - sent[i]
        yes, no, rise, stay = tables[kinds[i]]
        belief[i] += _message(above, yes, rise, no, stay)
    return [1 / (1 + math.exp(-max(-500.0, min(500.0, b)))) for b in belief]


def main_text(model: TreeModel, html: str | None) -> str:
    if not html:
        return ""
    nodes, runs = parse(html)
    kept = [p >= 0.5 for p in marginals(model, nodes)]
    texts = (" ".join("".join(x for node, x in run if kept[node]).split()) for run in runs)
    return "\n".join(t for t in texts if t)


#: Class names of content and of the rest, as web pages commonly have them.
CONTENT_NAMES = "article post entry content story body text main prose blog markdown news page single"
OTHER_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar pagination pager toc links tabs skip",
    "header": "header masthead banner logo branding site top hero",
    "footer": "footer copyright legal bottom colophon imprint",
    "aside": "sidebar aside widget related recommended popular trending teaser rail secondary",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp outbrain taboola",
    "notice": "cookie consent notice gdpr alert modal popup overlay banner privacy toast paywall",
    "form": "form search subscribe newsletter signup login contact",
    "share": "share social sharing follow buttons tools meta byline tags tagcloud",
    "comments": "comment comments reply replies disqus discussion respond thread reader responses",
}


#: Class names of inline elements that belong to the text.
INLINE_NAMES = "highlight term note math code quote name date abbr small caps lang ref mark nowrap dropcap".split()


def labelled_pages(n: int = 1200, seed: int = 11) -> list[str]:
    """Pages made by rule, their content elements marked; the same for every seed."""
    rng = random.Random(seed)
    syllables = "an er the on ing tion ment re la le der sch ich que os ado ra th ou en eau heit lich ción y de".split()

    def words(a: int, b: int, link: float = 0.0, spans: float = 0.0) -> str:
        out = []
        for _ in range(rng.randint(a, b)):
            w = "".join(rng.choices(syllables, k=rng.randint(1, 4))) + rng.choice(["", "", "", "", ",", ".", "%%%", "!!"])
            r = rng.random()
            if r < link:
                w = f"<a href=/x>{w}</a>"
            elif r < link + 0.03:
                w = f"<b>{w}</b>"
            elif r < link + 0.03 + spans:
                w = rng.choice([f'<span class="{rng.choice(INLINE_NAMES)}">{w}</span>', f'<em class="{rng.choice(INLINE_NAMES)}">{w}</em>', f'<span class="{"".join(rng.choices(syllables, k=2))}">{w}</span>', f'<a class="{rng.choice(["link", "ref", "external"])}" href=/x>{w}</a>', f"<span{name('ad')} data-boilerplate>{w}</span>", f"<span{name('share')} data-boilerplate>{w}</span>"])
            out.append(w)
        return " ".join(out)

    def name(kind: str) -> str:
        own = rng.sample((CONTENT_NAMES if kind == "content" else OTHER_NAMES[kind]).split(), rng.randint(1, 2))
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(["-", " ", "_"]).join(own)}"'

    def list_of(k: int, link: float) -> str:
        items = [words(1, 5, link) for _ in range(k)]
        if link == 1.0 and rng.random() < 0.3:
            items = [x.replace("<a ", f'<a class="{rng.choice(["nav-link", "menu-item", "link", "item", "active"])}" ') for x in items]
        return f"<{(t := rng.choice(['ul', 'ul', 'ol']))}>" + "".join(f"<li>{x}</li>" for x in items) + f"</{t}>"

    def other(kind: str, bare_div: bool = False) -> str:
        tag = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "form": ["form", "form", "div"], "comments": ["section", "div", "ol"]}.get(kind, ["div", "div", "aside", "section", "p"])
        own = "div" if bare_div else rng.choice(tag)
        bare = bare_div or (own in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6)
        inner = {
            "nav": lambda: rng.choice([list_of(rng.randint(3, 8), 1.0), words(3, 8, 1.0), " | ".join(words(1, 2, 1.0) for _ in range(4))]),
            "header": lambda: rng.choice([f"<h{(h := rng.choice([1, 1, 2, 3]))}>{words(1, 4)}</h{h}>", f"<p>{words(2, 8)}</p>", f"<a href=/>{words(1, 2)}</a>"]) + (f"<nav>{list_of(4, 1)}</nav>" if rng.random() < 0.4 else ""),
            "footer": lambda: rng.choice([f"&copy; {words(3, 12, 0.2)}", f"<p>&copy; {words(4, 20)}</p>" + list_of(3, 1), f"<p>Copyright {words(2, 9)}</p>", words(2, 6, 0.9)]),
            "aside": lambda: rng.choice([f"<h{(h := rng.choice([2, 3, 4]))}>{words(1, 4)}</h{h}>" + list_of(rng.randint(2, 6), 0.9), f"<p>{words(5, 40, 0.1)}</p>"]),
            "ad": lambda: rng.choice([words(3, 15), f"<p>{words(3, 20)}</p>"]),
            "notice": lambda: rng.choice([words(6, 30), f"<p>{words(6, 30)}</p>"]),
            "form": lambda: f"<p>{words(3, 12)}</p><label>{words(1, 2)}</label><input name=q><button>{words(1, 1)}</button>",
            "share": lambda: rng.choice([words(1, 6, 0.8), list_of(4, 1)]),
            "comments": lambda: f"<h3>{words(1, 3)}</h3>" + "".join(f"<{(t := rng.choice(['div', 'li', 'article', 'p']))}{name('comments') if rng.random() < 0.6 else ''}>" + (words(3, 40) if t == "p" else f"<p>{words(3, 60)}</p>") + f"</{t}>" for _ in range(rng.randint(1, 5))),
        }[kind]()
        return f"<{own}{'' if bare else name(kind)} data-boilerplate>{inner}</{own}>"

    def block() -> str:
        kind = rng.random()
        if kind < 0.7:
            return f"<p>{words(1, 3) if rng.random() < 0.15 else words(8, 90, rng.choice([0, 0, 0.05, 0.5]), rng.choice([0, 0, 0.08]))}" + rng.choice(["</p>", "</p>", ""])
        if kind < 0.8:
            return f"<h{rng.randint(2, 4)}>{words(1, 8)}</h{2}>".replace("</h2>", "") + "</h2></h3></h4>"
        if kind < 0.87:
            return list_of(rng.randint(2, 6), rng.choice([0, 0, 0.2]))
        if kind < 0.9:
            return f"<blockquote><p>{words(5, 40)}</p></blockquote>"
        if kind < 0.93:
            return f"<pre>{words(3, 30)}</pre>"
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 6)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<div>{words(5, 50)}</div>" if rng.random() < 0.5 else f"<figure><figcaption>{words(2, 12)}</figcaption></figure>"

    def title(own: str = "") -> str:
        head = f"<h1>{words(1, 10)}</h1>"
        return rng.choice([head, head, head, f"<header>{head}</header>" if own in ("article", "main") else head, f'<div class="{rng.choice(["post-header", "entry-header", "article-header", "headline", "title"])}">{head}</div>', ""])

    def around(names: str, chance: float, bare_div: bool = False) -> list[str]:
        return [other(k, bare_div) for k in names.split() if rng.random() < chance]

    def classic(inside: list[str]) -> str:
        own = rng.choice(["article", "article", "main", "div", "section"])
        bare = own in ("article", "main") and rng.random() < 0.6
        body = f"<{own}{'' if bare else name('content')} data-content>" + title(own) + "".join(inside) + f"</{own}>"
        before, after = around("nav header ad notice share form", 0.45), around("footer aside comments ad share notice form nav", 0.4)
        rng.shuffle(before)
        rng.shuffle(after)
        wrapped = "".join(before) + body + "".join(after)
        return f'<div class="{rng.choice(["wrapper", "container", "page", "layout", "row"])}">{wrapped}</div>' if rng.random() < 0.3 else wrapped

    def bare(inside: list[str]) -> str:
        own = rng.choice(["article", "main", "div", "section"])
        return f"<{own} data-content>{title(own)}{''.join(inside)}</{own}>"

    def open_body(inside: list[str]) -> str:
        # prose right in the body, boxes of other things between
        return "".join(around("nav header", 0.5)) + title() + "".join(inside) + "".join(around("footer ad aside", 0.4))

    def soup(inside: list[str]) -> str:
        depth = rng.randint(1, 3)
        body = "<div data-content>" + "<div>" * (depth - 1) + title() + "".join(inside) + "</div>" * depth
        whole = "".join(around("nav header share", 0.6, True)) + body + "".join(around("footer nav share", 0.6, True))
        return f"<div>{whole}</div>" if rng.random() < 0.5 else whole

    def listed(inside: list[str]) -> str:
        return f"<{(t := rng.choice(['ul', 'ol', 'div']))} data-boilerplate>" + (list_of(5, 1.0) if t == "div" else "".join(f"<li>{words(1, 3, 1.0)}</li>" for _ in range(5))) + f"</{t}>" + title() + "".join(inside)

    def tabled(inside: list[str]) -> str:
        cells = [f"<td data-boilerplate>{list_of(4, 1.0)}</td>", f"<td data-content>{title()}{''.join(inside)}</td>"]
        if rng.random() < 0.3:
            cells.append(f"<td data-boilerplate>{words(3, 9, 0.8)}</td>")
        return "<table><tr>" + "".join(cells) + "</tr></table>"

    def nested(inside: list[str]) -> str:
        return f"<div{name('content')} data-content><div{name('content') if rng.random() < 0.5 else ''}><section>{title()}{''.join(inside)}</section></div></div>" + "".join(around("footer comments aside", 0.4))

    kinds = [classic] * 6 + [bare, open_body, soup, soup, listed, tabled, nested]
    out = []
    for i in range(n):
        make = kinds[i % len(kinds)]
        inside = [block() for _ in range(rng.randint(1, 12))]
        if make in (classic, nested, bare):
            for kind in ("ad", "share", "aside", "comments", "form", "notice"):
                if rng.random() < (0.15 if make is classic else 0.06):
                    inside.insert(rng.randint(0, len(inside)), other(kind))
        body = "<body data-content>" if make in (open_body, listed) else "<body>"
        head = f"<html><head><title>{words(1, 5)}</title></head>" if rng.random() < 0.8 else ""
        out.append(f"{head}{body}{make(inside)}</body>" + ("</html>" if head else ""))
    return out


def extract(pages: DataFrame, model: TreeModel, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text of every row; a narrow stage."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                texts = [main_text(shared.value, x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = dict(own.dtypes)
    return own.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
