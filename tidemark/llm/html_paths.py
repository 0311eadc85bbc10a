"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its root-to-leaf tag path. Per path, the characters and the
punctuation of its nodes are added up and divided by their number; both ratios are smoothed along
the page with a Gaussian, fused by their product and averaged per path. A path is content if that
reaches a share of the spread over the page. Paths through menus, headers, footers, sidebars, forms
and the like never compete: those of such tags and roles, and of elements whose class or id is such a name
as a whole (``sidebar``, ``site-footer``, ``comment-list``). Names that merely hold such a word, as state and
layout classes do (``has-sidebar``, ``overflow-hidden``, ``comments-open``), only halve a path's score; one
with a word of content besides (``post-share``) rules out unless most of the text stands inside. On
an element that holds an article or main element no name counts but that of readers' remarks. Paths
inside an article or main element weigh more. The selected nodes mark a region, the smallest section that holds
them all; what stands in it and was not ruled out, such as a heading or a one-word paragraph, belongs
to the text. Where that is the whole body, lists, tables and the like beside selected paragraphs do,
unless most of their text is links.

Character references are decoded, white space inside a block becomes one space, and blocks are joined
by one space. Null and empty pages, and pages without content, give an empty text; so does an empty
table give no rows. Paths of equal score are selected together. Unclosed tags, comments and quotes end with
the page; dropped elements that are not closed end with their parent, scripts, styles, titles and text
fields aside. Rows are independent: repeated rows and very long or deeply nested pages need no rule (a
page is one task's work, linear in its length), and other columns do not matter.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.bpe_trie import slices

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؛؟।]")
_WORDS = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select xmp".split())
#: Those whose content is no markup, and those that can stand in one of their kind.
PLAIN, NESTED = frozenset("script style textarea title".split()), frozenset("svg math object template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An opening tag on the left ends an open element on the right.
CLOSES = {t: {t} for t in ("li", "option", "tr", "tbody", "thead", "tfoot")} | {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SECTIONS = frozenset("article main section div td body".split())
BOILER_TAGS = frozenset("nav footer aside form button label fieldset dialog menu head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies
    copyright dialog disclaimer disqus footer form gdpr header hidden login menu modal nav navbar navigation newsletter notice notices
    pager pagination popup promo promotion recommended related reply replies respond search share sharing sidebar signup social sponsor
    sponsored subscribe subscription toolbar topbar widget""".split()
)
REMARKS = frozenset("comment comments disqus reply replies respond".split())
CONTENT_WORDS = frozenset("article content entry post story text".split())
#: Words that may stand beside those in the name of such an element.
NEUTRAL_WORDS = frozenset(
    """site page global main primary secondary top bottom left right inner outer box bar block area list item items section container wrapper wrap
    region panel group buttons button icons links link posts thread row col column the and""".split()
)
_STATES = frozenset("has no is not with without js can overflow show open closed enabled disabled active visible count layout".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that belong to the paragraphs they stand beside.
BESIDE = frozenset("ul ol dl table pre blockquote figure p".split())

#: Gaussian over neighbouring text nodes, and the share of the spread that a content path reaches.
SIGMA, RADIUS, SHARE = 1.0, 2, 0.4
_KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]


class Element:
    """``path`` is a number that elements of one tag path share; ``named``: see :func:`_name_kind`."""

    __slots__ = ("tag", "path", "parent", "depth", "barred", "named", "weight", "heading", "holds", "out", "doubt", "inside", "block", "linked", "mixed", "most")

    def __init__(self, tag: str, label: str, parent: Element | None, barred: bool, named: int, weight: float, paths: dict[tuple[int, str], int]):
        self.tag, self.parent = tag, parent
        self.path = paths.setdefault((parent.path if parent else -1, label), len(paths))
        self.depth = parent.depth + 1 if parent else 0
        self.barred = barred or (parent is not None and parent.barred)
        self.named = named
        self.weight = max(weight, parent.weight) if parent else weight
        self.heading = tag in _HEADINGS or (parent is not None and parent.heading)
        inline = tag in INLINE and parent is not None
        self.block: Element = parent.block if inline else self
        self.linked = tag == "a" or (inline and parent.linked)
        self.mixed: Element | None = self if named == MIXED else parent.mixed if parent else None
        self.most = False  # with a mixed name: most of the page's text stands inside
        self.holds = False  # an article or a main element stands inside
        self.out: bool | None = None
        self.doubt = 0
        self.inside: bool | None = None


NOTHING, HOLDS_WORD, MIXED, DROPPED, REMARK = range(5)


def _name_kind(named: str) -> int:
    """What the names in a class or id say: readers' remarks, another dropped element, one beside a word of content, or just a name that holds such a word."""
    kind = NOTHING
    for name in named.split():
        words = _WORDS.findall(name)
        if bad := BOILER_WORDS.intersection(words):
            others = set(words) - BOILER_WORDS - NEUTRAL_WORDS
            if others & _STATES or others - CONTENT_WORDS or (others and bad == {"header"}):
                kind = max(kind, HOLDS_WORD)
            else:
                kind = max(kind, REMARK if bad & REMARKS else MIXED if others else DROPPED)
    return kind


def _element(tag: str, attributes: str, parent: Element, paths: dict[tuple[int, str], int]) -> Element:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes or "hidden" in attributes else {}
    role = found.get("role", "").lower()
    named = f"{found.get('class', '')} {found.get('id', '')}".lower()
    inside = parent.weight > 1
    out = tag in BOILER_TAGS or (tag == "header" and not inside) or role in BOILER_ROLES or "hidden" in found
    out = out or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
    main = tag in ("article", "main") or role in ("article", "main")
    kind = NOTHING if tag in ("html", "body", "main") else _name_kind(named)
    if main and kind < DROPPED:
        kind = NOTHING
    weight = 4.0 if tag == "article" or found.get("itemprop", "").lower() == "articlebody" else 2.0 if tag == "main" or role == "main" else 1.0
    words = sorted(set(_WORDS.findall(named)))
    e = Element(tag, f"{tag}.{'.'.join(words)}" if words else tag, parent, out, kind, weight, paths)
    if main and not out and not kind:
        up = parent
        while up is not None and not up.holds:
            up.holds = True
            up = up.parent
    return e


def _resolve(e: Element) -> None:
    """Set ``out`` (ruled out) and ``doubt`` (names around that hold a dropped word) of ``e`` and what is above it."""
    chain = []
    while e is not None and e.out is None:
        chain.append(e)
        e = e.parent
    for x in reversed(chain):
        up = x.parent
        counts = not x.holds
        x.out = x.barred or (up is not None and up.out) or x.named == REMARK or (counts and (x.named == DROPPED or (x.named == MIXED and not x.most)))
        x.doubt = (up.doubt if up is not None else 0) + (counts and x.named in (HOLDS_WORD, MIXED))


def _closed(attributes: str) -> bool:
    """Whether a start tag closes itself; a slash that ends a value without quotes belongs to the value."""
    return attributes.rstrip().endswith("/") and not re.search(r"=\s*[^\s\"'=]+\Z", attributes)


def _plain_end(page: str, tag: str, at: int) -> int:
    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
    return close.end() if close else len(page)


def _raw_end(page: str, tag: str, at: int, around: set[str]) -> int:
    """Where the element ``tag``, whose start tag ends at ``at``, ends: with its closing tag, or before that of an element ``around`` it."""
    if tag in PLAIN:
        return _plain_end(page, tag, at)
    inside: list[str] = []
    held: dict[str, int] = {}
    while m := _TOKEN.search(page, at):
        at = m.end()
        if m[2] is None:
            continue
        t = m[2].lower()
        if not m[1]:
            if t in PLAIN:
                if not (tag in ("svg", "math") and _closed(m[3])):
                    at = _plain_end(page, t, at)
            elif t not in VOID and not _closed(m[3]) and (t != tag or tag in NESTED):
                inside.append(t)
                held[t] = held.get(t, 0) + 1
        elif held.get(t):
            while True:
                last = inside.pop()
                held[last] -= 1
                if last == t:
                    break
        elif t == tag:
            return at
        elif t in around:
            return m.start()
    return len(page)


def text_nodes(page: str) -> list[tuple[Element, str, int]]:
    """(element, raw text, block) of every text node outside raw elements; a block ends at any tag that is not inline."""
    paths: dict[tuple[int, str], int] = {}
    root = Element("", "", None, False, 0, 1.0, paths)
    stack, nodes, at, block = [root], [], 0, 0
    opened: dict[str, int] = {}

    def cut(i: int) -> None:
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]

    while True:
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            nodes.append((stack[-1], page[at:end], block))
        if not m:
            return nodes
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            block += 1
        if m[1]:
            if opened.get(tag):
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                cut(i)
            continue
        if tag in RAW:
            if not (tag in ("svg", "math") and _closed(m[3])):
                at = _raw_end(page, tag, at, {t for t, n in opened.items() if n})
            continue
        closes = CLOSES.get(tag) or (("p",) if tag in ENDS_P else ())
        if any(opened.get(t) for t in closes):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    cut(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", *SECTIONS):
                    break
        if tag not in VOID and not m[3].rstrip().endswith("/") or tag in SECTIONS:
            stack.append(_element(tag, m[3], stack[-1], paths))
            opened[tag] = opened.get(tag, 0) + 1


def _smooth(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - RADIUS), min(len(values), i + RADIUS + 1)
        k = _KERNEL[lo - i + RADIUS : hi - i + RADIUS]
        out.append(sum(a * b for a, b in zip(k, values[lo:hi])) / sum(k))
    return out


def path_scores(nodes: list[tuple[Element, int, int]]) -> dict[int, float]:
    """Score of each path, from (element, characters, punctuation) of the text nodes in page order."""
    total: dict[int, list[float]] = {}
    for e, chars, marks in nodes:
        t = total.setdefault(e.path, [0, 0, 0])
        t[0] += 1
        t[1] += chars
        t[2] += marks
    lengths = _smooth([total[e.path][1] / total[e.path][0] for e, _, _ in nodes])
    marks = _smooth([total[e.path][2] / total[e.path][0] for e, _, _ in nodes])
    sums: dict[int, float] = {}
    for (e, _, _), a, b in zip(nodes, lengths, marks):
        sums[e.path] = sums.get(e.path, 0.0) + a * (1 + b) * e.weight / (1 << min(e.doubt, 8))
    return {p: s / total[p][0] for p, s in sums.items()}


def _region(elements: list[Element]) -> Element:
    """The smallest section around all of the elements."""
    top = elements[0]
    below = {id(top)}  # elements known to stand in ``top`` or in what it was before
    for e in elements[1:]:
        while id(e) not in below:
            below.add(id(e))
            if e.depth <= top.depth:
                top = top.parent
                below.add(id(top))
                if e is top:
                    break
            if e.depth > top.depth:
                e = e.parent
    while top.parent is not None and top.tag not in SECTIONS:
        top = top.parent
    return top


def _within(e: Element, region: Element) -> bool:
    chain = []
    while e is not None and e.inside is None and e is not region:
        chain.append(e)
        e = e.parent
    known = e is region or (e is not None and e.inside)
    for x in chain:
        x.inside = known
    return known


def _beside(chosen: list[Element], kept: list[tuple[Element, str, int]]) -> set[int]:
    """Lists, tables and the like (by id) whose parent also holds a selected paragraph, and that are not mostly links."""
    parents = {id(e.block.parent) for e in chosen if e.block.parent is not None}
    home: dict[int, int | None] = {}
    chars: dict[int, list[int]] = {}
    for e, t, _ in kept:
        chain, found = [], None
        up: Element | None = e
        while up is not None:
            if id(up) in home:
                found = home[id(up)]
                break
            chain.append(up)
            if up.parent is not None and id(up.parent) in parents and up.tag in BESIDE:
                found = id(up)
                break
            up = up.parent
        for x in chain:
            home[id(x)] = found
        if found is not None:
            c = chars.setdefault(found, [0, 0])
            c[0] += len(t.strip())
            c[1] += len(t.strip()) if e.linked else 0
    good = {f for f, (n, linked) in chars.items() if 2 * linked <= n}
    return {x for x, f in home.items() if f in good}


def _weigh(nodes: list[tuple[Element, str, int]]) -> None:
    """Set ``most`` of the elements with mixed names."""
    chars: dict[Element, int] = {}
    total = 0
    for e, t, _ in nodes:
        n = 0 if e.barred else len(t.strip())
        total += n
        if e.mixed:
            chars[e.mixed] = chars.get(e.mixed, 0) + n
    for x in sorted(chars, key=lambda x: -x.depth):
        up = x.parent.mixed
        while up is not None and up not in chars:  # holds no text of its own
            chars[up] = 0
            up = up.parent.mixed
    for x in sorted(chars, key=lambda x: -x.depth):
        x.most = 2 * chars[x] > total
        if x.parent.mixed:
            chars[x.parent.mixed] += chars[x]


def main_text(page: str | None) -> str:
    if not page or page.isspace():
        return ""
    nodes = [(e, entities.unescape(t) if "&" in t else t, b) for e, t, b in text_nodes(page)]
    _weigh(nodes)
    for e, _, _ in nodes:
        _resolve(e)
    kept = [x for x in nodes if not x[0].out]
    full = [(e, len(t), len(_PUNCTUATION.findall(t))) for e, t, _ in kept if not t.isspace()]
    if not full:
        return ""
    scores = path_scores(full)
    mean = sum(scores.values()) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores.values()) / len(scores))
    least = SHARE * (spread if spread > 0 else mean)
    chosen = {p for p, s in scores.items() if s >= least}
    selected = [e for e, _, _ in full if e.path in chosen]
    region = _region(selected)
    whole = region.tag not in ("", "body")
    beside = set() if whole else _beside(selected, kept)
    out, last = [], None
    for e, t, block in kept:
        if _within(e, region) and (whole or e.path in chosen or e.heading or id(e) in beside):
            if last is not None and block != last:
                out.append(" ")
            out.append(t)
            last = block
    return " ".join("".join(out).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in slices(batch.column(2)):
                texts = [main_text(p) for p in some]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=[id_col, url_col, "text", "n_chars"],
                )

    src = pages.select(id_col, url_col, html_col)
    kinds = [f.dataType.simpleString() for f in src.schema]
    return src.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint")
