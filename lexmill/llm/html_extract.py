"""Main text of web pages by minimum-cut labelling of blocks.

A page is cut into blocks (the text of one block-level element between its children). A
linear classifier on features of the block and its ancestors gives each a score (its log
odds; the weights were fitted by logistic regression, see fit_weights); positive scores are
capacities from the source (content), negative ones to the sink (boilerplate). Smoothness
edges join neighbours in page order, more strongly the nearer they are in the tree, and
each block with the next one under the same parent. The minimum cut then labels all blocks
at once: a short line among paragraphs stays, a lone long line in a menu goes.

Pages are independent, so this is one narrow pass over the table.
"""

from __future__ import annotations

import html
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm.cluster import small_batches

#: element names of the HTML standard by their part here (fixed values)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style title textarea noscript template svg math iframe object canvas audio video select button datalist map".split())
RAW = ("script", "style", "title", "textarea", "noscript", "iframe", "template", "svg")
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd", ("dl",)), "dt": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr",)), "th": ("th", ("tr",)), "option": ("option", ("select",))}

#: words in class, id and role that speak for or against an element
CONTENT_WORDS = frozenset("article articles content post entry story main body text prose hentry".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup paywall "
    "social share sharing related recommended recommendations sidebar side aside widget widgets "
    "menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer foot bottom copyright legal disclaimer "
    "comment comments commentlist reply replies disqus respond login register search form toolbar pagination pager tags taglist skip hidden byline meta".split()
)
#: parts of a name that make it one of a layout or a state, which says nothing about the text below
LAYOUT_WORDS = frozenset("has no not with without wrap wrapper wrapping layout fixed sticky page on off open closed enabled disabled active container grid row col columns".split())
OTHER_TAGS = frozenset("nav footer aside form menu dialog".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg(?=[\s/>])(?:[^>\"'=/]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']*+)|\"[^\"]*+\"|'[^']*+'|/(?!>))*+/>"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<[a-zA-Z/][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")


class _Element:
    __slots__ = ("tag", "parent", "depth", "silent", "article", "link", "inline", "open_p", "whole", "part", "good", "hidden", "core", "words", "heads", "own", "outer", "above")

    def __init__(self, tag: str, attrs: str, parent: "_Element | None"):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.silent = tag in SILENT or bool(parent and parent.silent)
        self.link = tag == "a" or bool(parent and parent.link)
        self.inline = tag not in BLOCKS
        # the open paragraph that a block element would end: reached through inline elements alone
        self.open_p = self if tag == "p" else parent.open_p if parent and self.inline else None
        self.whole = self.part = self.good = self.hidden = False
        if attrs and not attrs.isspace() and tag not in ("a", "html", "body", "meta", "img"):
            self.whole, self.part, self.good, self.hidden = _named(attrs)
        mine = tag in ("article", "main") and not (self.whole or self.part)
        self.article = mine or bool(parent and parent.article)
        self.core, self.words, self.heads = mine, 0, int(tag == "h1")  # of the element with all below it, once the page is read
        # evidence of the element on its own text, on what lies below it, and that of it and all above it on what lies below
        self.own = self.outer = self.above = frozenset()


_names: dict[str, tuple[bool, bool, bool, bool]] = {}


def _named(attrs: str) -> tuple[bool, bool, bool, bool]:
    """Whether a whole name in class, id or role speaks against the element, a part of one does, one speaks for it, and whether it is hidden."""
    found = _names.get(attrs)
    if found is None:
        whole = part = good = hidden = False
        for name, *values in _NAMED.findall(attrs):
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
            elif name in ("class", "id", "role"):
                for token in value.split():
                    parts = set(_WORD.findall(token))
                    if parts & LAYOUT_WORDS:
                        continue
                    if token in OTHER_WORDS:
                        whole = True
                    elif parts & OTHER_WORDS:
                        part = True
                    elif parts & CONTENT_WORDS:
                        good = True
        found = whole, part, good, hidden
        if len(_names) < 10_000:
            _names[attrs] = found
    return found


class Block:
    __slots__ = ("element", "pieces", "link_chars", "text", "score")

    def __init__(self, element: _Element):
        self.element, self.pieces, self.link_chars = element, [], 0


def blocks_of(page: str) -> list[Block]:
    """The blocks with text of a page, in page order; tags that are never closed end where their parent or the page does."""
    top = here = _Element("#page", "", None)
    elements = [top]
    found: list[Block] = []
    block: Block | None = None
    at = 0
    for m in _TOKEN.finditer(page):
        a, b = m.span()
        if a > at and here.tag == "head" and not page[at:a].isspace():  # text ends an open head
            here = here.parent
        if a > at and not here.silent:
            text = page[at:a]
            if block is None:
                owner = here
                while owner.inline and owner.parent is not None:
                    owner = owner.parent
                block = Block(owner)
                found.append(block)
            block.pieces.append(text)
            if here.link:
                block.link_chars += len(text)
        at = b
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            x = here
            while x is not top and x.tag != tag:
                x = x.parent
            if x is not top:
                here = x.parent
            if tag in BLOCKS:
                block = None
            continue
        if here.tag == "head" and tag not in IN_HEAD and tag != "body":  # as does an element that cannot be in one
            here = here.parent
        if tag in BLOCKS:
            block = None
            if here.open_p is not None:  # a block ends an open paragraph
                here = here.open_p.parent
        elif tag == "br" and block is not None:
            block.pieces.append(" ")
        if tag in CLOSES:
            own, stops = CLOSES[tag]
            x = here
            while x is not top and x.tag not in stops:
                if x.tag == own or own in ("td", "th") and x.tag in ("td", "th") or own in ("dd", "dt") and x.tag in ("dd", "dt"):
                    here = x.parent
                    break
                x = x.parent
        if tag == "body" and here.silent:
            here = top
        if tag in VOID:
            continue
        attrs = m["attrs"]
        if not attrs.endswith("/") or tag in BLOCKS or tag == "a":
            here = _Element(tag, attrs, here)
            elements.append(here)
    if at < len(page) and here.tag == "head" and not page[at:].isspace():
        here = here.parent
    if at < len(page) and not here.silent:
        if block is None:
            owner = here
            while owner.inline and owner.parent is not None:
                owner = owner.parent
            block = Block(owner)
            found.append(block)
        block.pieces.append(page[at:])
        if here.link:
            block.link_chars += len(page) - at
    out = []
    for x in found:
        raw = "".join(x.pieces)
        x.text = " ".join(html.unescape(raw).split())
        if x.text:
            out.append(x)
            if 2 * x.link_chars < len(raw):
                x.element.words += x.text.count(" ") + 1
    for e in reversed(elements[1:]):  # children come after their parents
        e.parent.core |= e.core
        e.parent.words += e.words
        e.parent.heads += e.heads
    for e in elements:
        e.own = _evidence(e)
        # what holds the article says nothing about it
        wraps = e.core or e.heads and 2 * e.words >= top.words
        e.outer = e.own & _ALWAYS if wraps else e.own
        e.above = e.outer | e.parent.above if e.parent else e.outer
    return out


_ALWAYS = frozenset(("good_name", "hidden"))
_evidences: dict[tuple, frozenset] = {}


def _evidence(e: _Element) -> frozenset:
    """The features that an element's tag and names speak for."""
    key = e.tag in OTHER_TAGS, e.tag == "header", e.article, e.whole, e.part, e.good, e.hidden
    if key not in _evidences:
        named = {"other_tag": key[0], "inner_header": key[1] and e.article, "header": key[1] and not e.article, "whole_name": e.whole, "part_name": e.part, "good_name": e.good, "hidden": e.hidden}
        _evidences[key] = frozenset(name for name, is_so in named.items() if is_so)
    return _evidences[key]


FEATURES = ("one", "words", "stop", "text_tag", "links", "article", "other_tag", "header", "inner_header", "whole_name", "part_name", "good_name", "hidden")
#: what one would expect of them: where the fit starts, and what it is drawn to
PRIOR = (-0.6, 1.0, 0.4, 0.8, -4.0, 4.0, -8.0, -6.0, -2.0, -8.0, -8.0, 2.0, -8.0)
#: fitted by fit_weights on the blocks of generated pages of two dozen templates (tests/llm/page_templates.py)
WEIGHTS = (-0.16, 1.21, 0.42, 1.17, -4.0, 3.92, -8.14, -6.0, -2.0, -8.04, -8.01, 2.22, -8.0)
NEAR = 12


def features(block: Block) -> list[float]:
    """What the classifier looks at, in the order of FEATURES.

    An ancestor's tag or name counts less the farther it is above the block, down to half
    its weight NEAR steps up and beyond, where it is looked up in what all ancestors have in
    common. It does not count if the article itself lies below it: an article or main
    element that is not named like a comment, or a first heading with half of the page's running words.
    """
    e, text = block.element, block.text
    n = text.count(" ") + 1
    share = min(1.0, block.link_chars / len(text))
    found = dict.fromkeys(FEATURES, 0.0)
    found["one"] = 1.0
    found["words"] = min(n, 40) / 20
    found["stop"] = float(text[-1] in ".!?…\"'»”)")
    found["text_tag"] = float(e.tag in ("p", "pre", "blockquote", "h1", "h2", "h3"))
    found["links"] = share if share > 0.3 else 0.0
    found["article"] = float(e.article)
    weigh = lambda names, w: found.update({name: max(found[name], 1.0 if name == "hidden" else w) for name in names})
    weigh(e.own, 1.0)
    x, steps = e.parent, 1
    while x is not None and x.above and steps < NEAR:
        weigh(x.outer, 1 - steps / (2 * NEAR))
        x, steps = x.parent, steps + 1
    if x is not None:
        weigh(x.above, 0.5)
    return [found[name] for name in FEATURES]


def score(block: Block) -> float:
    """Log odds that a block is content."""
    return sum(w * f for w, f in zip(WEIGHTS, features(block), strict=True))


def fit_weights(rows: list[list[float]], content: list[bool], prior: tuple[float, ...] = PRIOR, steps: int = 60, ridge: float = 0.01) -> list[float]:
    """Weights of a logistic regression on feature rows and labels, drawn to a prior by a ridge (Newton steps)."""
    x, y, start = np.array(rows, float), np.array(content, float), np.array(prior)
    w = start.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) / len(x) - ridge * (w - start)
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(x.shape[1])
        w += np.linalg.solve(curve, slope)
    return w.tolist()


def _distance(a: _Element, b: _Element) -> int:
    """Steps between two elements in the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: |score| for each block against its score, w for each edge that is cut.

    Shortest augmenting paths in phases; source and sink are kept as the blocks' own spare
    capacities. Of several least cuts the one with the fewest content blocks.
    """
    n = len(scores)
    supply, demand = [max(s, 0.0) for s in scores], [max(-s, 0.0) for s in scores]
    to, cap, out = [], [], [[] for _ in range(n)]
    for i, j, w in edges:
        out[i].append(len(to))
        out[j].append(len(to) + 1)
        to += (j, i)
        cap += (w, w)
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if supply[i] > tiny)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            reached = reached or demand[i] > tiny
            for e in out[i]:
                j = to[e]
                if cap[e] > tiny and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for s in range(n):
            while supply[s] > tiny and level[s] == 0:
                path, i = [], s
                while demand[i] <= tiny:
                    while turn[i] < len(out[i]):
                        e = out[i][turn[i]]
                        if cap[e] > tiny and level[to[e]] == level[i] + 1:
                            break
                        turn[i] += 1
                    if turn[i] == len(out[i]):
                        if not path:
                            break
                        e = path.pop()
                        i = to[e ^ 1]
                        turn[i] += 1
                    else:
                        path.append(e)
                        i = to[e]
                if demand[i] <= tiny:
                    break
                flow = min([supply[s], demand[i], *(cap[e] for e in path)])
                supply[s] -= flow
                demand[i] -= flow
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow


def smoothness(blocks: list[Block], near: float = 1.0, sibling: float = 0.5) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, near / (1 + _distance(blocks[i - 1].element, b.element))))
        parent = b.element.parent or b.element
        if (k := last.get(id(parent))) is not None and k != i - 1:
            edges.append((k, i, sibling))
        last[id(parent)] = i
    return edges


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by one \\n; null and pages without content give an empty text."""
    if not page:
        return ""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    kept = minimum_cut([score(b) for b in blocks], smoothness(blocks))
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages (page_id, url, html).

    Null or empty html, and pages that are all boilerplate: empty text. Null ids and urls
    pass through; repeated rows are read once each; other columns are ignored. An empty
    table gives no rows. Pages cut off in a tag, comment or script end there.
    """
    small_batches(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
