"""Main-text extraction by a tree-structured graphical model of the DOM.

Every block-level element has a hidden label: content or not. Its tag, the words of its class, id and role, the length of its
text and the share of that text within links give a node potential; each parent and child share a pairwise potential. Since
the graph is a tree, one upward and one downward pass of sum-product messages give the exact marginals, and the text of
elements whose marginal reaches one half is kept. Both potentials are counted on labelled pages.

The labelled pages are drawn here, from rules for how sites frame an article (``labelled_page``); their number is a parameter
of ``train``. Text in inline elements belongs to the block element around it, that of formulas too. Scripts, styles and other raw
elements hold no text; one that closes itself (<svg/>), or has no end and isn't script-like, is empty. Null and empty html: empty text. Pages are
read whole; repeated rows give repeated results; nothing is shuffled; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
NAMES = re.compile(r"""\b(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD, SPACE = re.compile(r"[a-z]+"), re.compile(r"\s+")
#: Fixed lists of the HTML standard.
RAW = frozenset("script style noscript template title textarea svg iframe object select canvas head".split())
#: Raw elements whose text is no markup: a '/' at the end of the opening tag does not close them.
UNPARSED = frozenset("script style noscript title textarea iframe".split())
#: The end tag of each raw element; ASCII letters only, so that no other letter folds to one of them.
END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I | re.A) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: The elements of MathML and the shapes of SVG: their text belongs to the block around the formula or the drawing without an end.
INLINE |= frozenset("circle clippath defs ellipse g line lineargradient path polygon polyline radialgradient rect stop symbol textpath tspan use".split())
INLINE |= frozenset("math semantics annotation annotation-xml maction menclose merror mfenced mfrac mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none".split())
#: What an opening tag ends, if such an element is open within the same list, table or block.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_P = INLINE | VOID - {"hr"}
SCOPE = frozenset("ul ol dl table body html div section article main aside nav header footer form".split())


@dataclass
class Node:
    tag: str
    parent: int
    names: str = ""
    label: int | None = None
    #: Characters in the element, and those of them in links; children add theirs.
    chars: int = 0
    linked: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: Stretches of text: the node that owns each, and its parts.
    blocks: list[tuple[int, list[str]]] = field(default_factory=list)


def parse(source: str, labelled: bool = True) -> Page:
    """Block elements of a page in document order, and its text by block; labelled: data-label is our training mark."""
    page = Page([Node("html", -1)])
    nodes, blocks, stack, at, links, fresh = page.nodes, page.blocks, [0], 0, 0, True
    unended: set[str] = set()

    def text(raw: str) -> None:
        nonlocal fresh
        if fresh or not blocks:
            if not raw.strip():
                return
            blocks.append((stack[-1], []))
            fresh = False
        blocks[-1][1].append(raw)
        n = len(raw.strip())
        nodes[stack[-1]].chars += n
        if links:
            nodes[stack[-1]].linked += n

    while m := TAG.search(source, at):
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        close, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if close else 1
        if tag in RAW and tag != "head":
            empty = bool(rest) and rest.endswith("/")
            if not close and not (empty and tag not in UNPARSED):
                end = None if tag in unended else END[tag].search(source, at)
                if end:
                    at = end.start()
                else:  # an element without an end holds the rest only where the rest is no markup
                    unended.add(tag)
                    at = len(source) if tag in UNPARSED and not empty else at
            continue
        if tag == "br" and not fresh:
            text(" ")
        if tag in INLINE or tag in VOID - {"hr"}:
            continue
        fresh, links = True, 0
        if tag == "hr":
            continue
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
                if nodes[stack[k]].tag in SCOPE and tag not in SCOPE:
                    break
            continue
        if nodes[stack[-1]].tag == "p":
            stack.pop()
        if tag in ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag in ENDS[tag]:
                    del stack[k:]
                    break
                if nodes[stack[k]].tag in SCOPE:
                    break
        node = Node(tag, stack[-1])
        if rest:
            for a in NAMES.findall(rest):
                value = a[1] or a[2] or a[3]
                if a[0].lower() == "data-label":
                    node.label = int(value) if labelled else None
                else:
                    node.names += " " + value.lower()
        if tag in ("html", "body") and len(nodes) > 1 and any(nodes[k].tag == tag for k in stack):
            continue
        nodes.append(node)
        stack.append(len(nodes) - 1)
    if at < len(source):
        text(source[at:])
    for n in reversed(nodes[1:]):
        nodes[n.parent].chars += n.chars
        nodes[n.parent].linked += n.linked
    return page


#: Elements that hold a stretch of text; the others hold elements. Children of either kind have an edge potential of their own.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot pre blockquote figcaption caption".split())


def observed(n: Node) -> list[str]:
    """The observations of a node potential. The size of a single paragraph or item says little, that of a section much."""
    share = 0 if not n.linked else 1 + min(3, 4 * n.linked // max(1, n.chars))
    found = [f"tag {n.tag}", f"links {share}", *(f"name {w}" for w in set(WORD.findall(n.names)))]
    return found if n.tag in FLOW else [*found, f"size {0 if not n.chars else 1 + min(4, n.chars.bit_length() // 2)}"]


@dataclass
class Model:
    #: Log-likelihood ratio (content to not) of each observation.
    node: dict[str, float]
    #: P(child's label | parent's label), for children that hold elements and those that hold text.
    edge: list[list[list[float]]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Log-odds of content for every node, given all observations of the page."""
        edges = [self.edge[n.tag in FLOW] for n in nodes]
        own = [max(-30.0, min(30.0, sum(self.node.get(f, 0.0) for f in observed(n)))) for n in nodes]
        message = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # upward
            (p00, p01), (p10, p11) = edges[i]
            r = math.exp(max(-60.0, min(60.0, own[i])))
            message[i] = math.log((p11 * r + p10) / (p01 * r + p00))
            own[nodes[i].parent] += message[i]
        belief = own[:]
        for i in range(1, len(nodes)):  # downward
            (p00, p01), (p10, p11) = edges[i]
            rest = math.exp(max(-60.0, min(60.0, belief[nodes[i].parent] - message[i])))
            belief[i] = own[i] + math.log((p11 * rest + p01) / (p10 * rest + p00))
        return belief

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = parse(source, labelled=False)
        belief = self.marginals(page.nodes)
        kept = (SPACE.sub(" ", entities.unescape("".join(parts))).strip() for owner, parts in page.blocks if belief[owner] >= 0)
        return "\n".join(t for t in kept if t)


#: Names that sites give to elements, by what they frame. Fixed values.
CONTENT_NAMES = "article content post entry main story text body page single blog news detail".split()
WRAPPER_NAMES = "wrapper container page site layout row col inner outer wrap grid".split()
OTHER_NAMES = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs pagination pager toc tabs".split(),
    "header": "header masthead topbar banner branding logo top".split(),
    "footer": "footer bottom copyright legal colophon credits".split(),
    "aside": "sidebar aside widget related recommended popular trending rail tags".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion dfp commercial".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal newsletter subscribe signup paywall".split(),
    "form": "form search login contact subscribe".split(),
    "comments": "comments comment replies reply discussion disqus respond feedback".split(),
    "share": "share social sharing buttons toolbar".split(),
}


def labelled_page(rng: random.Random) -> str:
    """A page whose block elements carry data-label: 1 in the article and around it, 0 elsewhere."""
    words = lambda a, b: " ".join("".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b)))
    link = lambda a, b: f'<a href="/x">{words(a, b)}</a>'

    def el(tag: str, label: int, inside: str, names: str = "") -> str:
        attr = rng.choice(("class", "id")) if names else ""
        return f'<{tag}{f" {attr}={chr(34)}{names}{chr(34)}" if names else ""} data-label="{label}">{inside}</{tag}>'

    def name(kind: str) -> str:
        return "-".join(rng.sample(OTHER_NAMES[kind], rng.randint(1, 2)))

    def listed(label: int, linked: bool, n: int) -> str:
        return el(rng.choice(("ul", "ol")), label, "".join(el("li", label, link(1, 3) if linked else words(3, 25)) for _ in range(n)))

    def other(kind: str) -> str:
        para = lambda a, b: el("p", 0, words(a, b))
        inside = {
            "nav": lambda: listed(0, True, rng.randint(3, 8)) if rng.random() < 0.8 else link(1, 2) + " | " + link(1, 2),
            "header": lambda: rng.choice((el("h1", 0, link(1, 3)), el("div", 0, words(1, 4)), el("p", 0, words(1, 6)))) + rng.choice(("", listed(0, True, 4))),
            "footer": lambda: rng.choice(("&copy; " + words(2, 10), para(3, 20), para(3, 15) + listed(0, True, 4))),
            "aside": lambda: el(rng.choice(("h2", "h3")), 0, words(1, 3)) + rng.choice((listed(0, True, 5), para(5, 40), el("div", 0, words(5, 30)))),
            "ad": lambda: rng.choice((words(3, 25), para(4, 25), link(3, 10))),
            "notice": lambda: rng.choice((para(5, 30), words(5, 30))) + rng.choice(("", "<button>OK</button>", link(1, 2))),
            "form": lambda: "<label>" + words(1, 3) + '</label><input name="q">' + rng.choice(("", el("p", 0, words(2, 12)))) + el("button", 0, words(1, 2)),
            "comments": lambda: el("h3", 0, words(1, 2)) + "".join(el(rng.choice(("div", "li", "div", "p")), 0, rng.choice((words(5, 80), para(5, 80), el("p", 0, link(1, 2)) + para(5, 60))), rng.choice(("", name("comments")))) for _ in range(rng.randint(1, 5))),
            "share": lambda: listed(0, True, 4) if rng.random() < 0.5 else link(1, 1) + link(1, 1),
        }[kind]()
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        if kind == "form":
            return el("form", 0, inside, rng.choice(("", name(kind))))
        bare = own != "div" and own != "section" and rng.random() < 0.6
        return el(own if bare or rng.random() < 0.4 else rng.choice(("div", "section")), 0, inside, "" if bare else name(kind))

    def article() -> str:
        parts = [el("h1", 1, words(2, 12))] if rng.random() < 0.8 else []
        for _ in range(rng.randint(2, 14)):
            parts.append(rng.choices((
                lambda: el("p", 1, words(2, 120)), lambda: el("p", 1, f"<b>{words(2, 12)}</b>"), lambda: el("p", 1, words(5, 50) + " " + link(1, 5) + " " + words(3, 40)), lambda: el(rng.choice(("h2", "h3")), 1, words(1, 8)),
                lambda: listed(1, rng.random() < 0.15, rng.randint(2, 6)), lambda: el("blockquote", 1, rng.choice((words(5, 40), el("p", 1, words(5, 40))))), lambda: el("pre", 1, words(5, 40)),
                lambda: el("table", 1, "".join(el("tr", 1, "".join(el(rng.choice(("td", "th")), 1, words(1, 6)) for _ in range(3))) for _ in range(3))), lambda: el("figure", 1, '<img src="a">' + el("figcaption", 1, words(3, 12))),
                lambda: el(rng.choice(("div", "section")), 1, el("h2", 1, words(1, 6)) + el("p", 1, words(10, 80))),
            ), (40, 4, 8, 8, 5, 4, 2, 2, 3, 5))[0]())
        for _ in range(rng.choice((0, 0, 0, 1, 2))):
            parts.insert(rng.randint(0, len(parts)), other(rng.choice(("ad", "share", "aside", "notice", "form"))))
        if rng.random() < 0.1:
            parts.append(other("comments"))
        tag = rng.choices(("article", "main", "div", "section"), (50, 15, 25, 10))[0]
        named = "" if tag in ("article", "main") and rng.random() < 0.6 else "-".join(rng.sample(CONTENT_NAMES, rng.randint(1, 2)))
        return el(tag, 1, "".join(parts), named)

    middle = article()
    for _ in range(rng.choice((0, 0, 1, 2))):
        beside = [other(rng.choice(("aside", "ad", "nav"))) for _ in range(rng.randint(0, 1))]
        middle = el(rng.choice(("div", "div", "main")), 1, middle + "".join(beside), rng.choice(("", rng.choice(WRAPPER_NAMES))))
    before = [other(k) for k in ("notice", "header", "nav", "ad", "form") if rng.random() < 0.5]
    after = [other(k) for k in ("aside", "ad", "comments", "form", "footer", "footer") if rng.random() < 0.45]
    return f'<html data-label="1"><body data-label="1">{"".join(before)}{middle}{"".join(after)}</body></html>'


def train(n_pages: int = 600, seed: int = 11, smoothing: float = 0.5) -> Model:
    """Count both potentials on n_pages labelled pages."""
    rng = random.Random(seed)
    seen, edge = [Counter(), Counter()], [[[smoothing, smoothing], [smoothing, smoothing]] for _ in range(2)]
    total = [0, 0]
    for _ in range(n_pages):
        nodes = parse(labelled_page(rng)).nodes
        for n in nodes[1:]:
            if n.label is None:  # as the element around it
                n.label = 1 if nodes[n.parent].label is None else nodes[n.parent].label
            label = n.label
            seen[label].update(observed(n))
            total[label] += 1
            up = nodes[n.parent].label
            edge[n.tag in FLOW][1 if up is None else up][label] += 1
    ratio = {f: math.log((seen[1][f] + smoothing) / (total[1] + 2 * smoothing)) - math.log((seen[0][f] + smoothing) / (total[0] + 2 * smoothing)) for f in seen[0] | seen[1]}
    return Model(ratio, [[[x / sum(row) for x in row] for row in kind] for kind in edge])


def extract_text(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars of the main text of each row of pages(page_id, url, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": [model.extract(h) for h in pdf["html"]]})

    found = pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
