"""Main text of HTML pages by a minimum cut.

A page becomes blocks: runs of text between block-level tags, references decoded and
white space folded.  A linear classifier over a block's containers (tag, role, class
and id of its ancestors), link share, length and punctuation gives its log-odds of
being content; positive ones are capacities from the source, negative ones to the sink.
Neighbours in page order, and neighbours under one parent, are joined by smoothness
edges whose capacity falls with the tree distance of the two.  The minimum cut, found by
maximum flow, separates content from boilerplate, and the content blocks are the text.

A container that names itself (``nav``, ``class="sidebar"``) outweighs any smoothness;
one whose name merely has such a word in it (``class="side-effects"``) is weak evidence.
Where containers say little, length, links and the cut decide.  Of containers that hold the
page's largest article, or nearly all its words, those that only wrap (header, form, modal)
don't count, comments, asides and footers do.

Blocks whose terminal capacity outweighs all their edges are labelled first and folded
into their neighbours, which leaves the cut the same.  Time and memory are linear in the
page up to the flow, however deep its tags are nested.  Null, empty and text-free pages
have an empty text.  A page's text depends on its html alone, so repeated rows agree.
Other columns pass unchanged; those named text or n_chars are replaced.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# a quote opens a value only where the value begins
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?+|'([^']*+)'?+|([^\s>]++)))?+")
NAMED = re.compile(r"class|id|role|style|hidden", re.I)

#: Whose contents are no text of the page, up to their end tag.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "annotation", "annotation-xml", "canvas", "object", "select", "button", "audio", "video"}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "picture", "map", "area", "source", "embed", "param", "track"}
#: Formulas stay in the line of text.
INLINE |= {"math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "mfenced", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr", "mtd", "maction", "semantics"}
#: Start tags that end an open element of the given kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: How surely a container's own name says boilerplate: it may wrap the article, it may be a theme's word, or it never holds the article.
SOFT, NAME, HARD = 1, 2, 3
BAD_TAGS = {"nav": HARD, "footer": HARD, "aside": HARD, "menu": HARD, "form": SOFT, "dialog": SOFT, "header": SOFT}
BAD_ROLES = {"navigation": HARD, "banner": SOFT, "contentinfo": HARD, "complementary": HARD, "search": SOFT, "dialog": SOFT, "alert": NAME, "alertdialog": NAME, "menu": HARD, "menubar": HARD, "form": SOFT}
GOOD_TAGS = {"article": 1.5, "main": 1.2}
BAD_WORDS = {w: k for k, words in ((HARD, "comment comments commentlist commentform disqus reply replies respond"), (NAME, "nav navs navbar navigation navmenu topnav subnav menu menus submenu sidebar sidebars side aside footer footers foot topbar masthead banner banners ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot promo promos promotion sponsor sponsors sponsored cookie cookies consent gdpr notice notices notification notifications alert alerts newsletter newsletters subscribe subscription signup share sharing social related recommend recommended recommendations breadcrumb breadcrumbs widget widgets toolbar pagination pager copyright legal disclaimer skip skiplink"), (SOFT, "header modal overlay popup popups form search searchbox searchform login dialog hidden")) for w in words.split()}
GOOD_WORDS = set("article articles content post entry story main maincontent bodytext articlebody text".split())
#: Words that say where or how large a thing is, or what it belongs to.
PLAIN = GOOD_WORDS | set("site page top bottom left right center middle inner outer global primary secondary tertiary upper lower box boxes wrap wrapper container area section block blocks list lists item items link links bar bars col column columns row rows panel group holder module unit slot body title head heading fixed sticky mobile desktop small large big mini first last region zone posts entries stories news blog user users reader readers info icon icons button buttons btn js is ui fluid default layout policy message messages feed tray stack the of by and".split())
#: Names with these speak of something else's presence.
ABOUT = {"has", "with", "no", "without", "not"}
OWN = {"entry", "post", "article", "story"}
OWN_PARTS = {"header", "head", "title", "body", "text", "content"}
SURE, DOUBT = -6.0, -0.4
STOCK = re.compile(r"^\s*(?:©|\(c\)\s|copyright\b)|all rights reserved|(?:we|site) uses? cookies", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Text, words, share of them that is linked, number of the element that holds it.
Block = tuple[str, int, float, int]


class _Element:
    __slots__ = ("tag", "up", "depth", "kind", "doubt", "good", "own", "words", "bad", "gain", "inside")

    def __init__(self, tag: str, up: int, depth: int, kind: int = 0, doubt: bool = False, good: float = 0.0, own: bool = False):
        self.tag, self.up, self.depth, self.kind, self.doubt, self.good, self.own = tag, up, depth, kind, doubt, good, own
        self.words, self.bad, self.gain, self.inside = 0, 0.0, 0.0, False


def _name(token: str) -> tuple[int, bool, float]:
    """Of a class or id: how surely it is boilerplate's, whether it may be, and how much it speaks for content."""
    words = PARTS.findall(CAMEL.sub(" ", token).lower())
    if not words or ABOUT.intersection(words):
        return 0, False, 0.0
    if len(words) == 2 and words[0] in OWN and words[1] in OWN_PARTS:
        return 0, False, 1.0
    kind = max(BAD_WORDS.get(w, 0) for w in words)
    if kind:
        return (kind, False, 0.0) if all(w in BAD_WORDS or w in PLAIN or len(w) < 2 for w in words) else (0, True, 0.0)
    return 0, False, 0.8 if GOOD_WORDS.intersection(words) else 0.0


def _element(tag: str, attrs: str, up: int, depth: int) -> _Element:
    kind, good, doubt = BAD_TAGS.get(tag, 0), GOOD_TAGS.get(tag, 0.0), False
    own = tag in GOOD_TAGS
    if attrs and tag not in ("html", "body") and NAMED.search(attrs):
        seen = set()
        for key, a, b, c in ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key in seen:
                continue
            seen.add(key)
            if key in ("class", "id"):
                for token in value.split():
                    k, d, g = _name(token)
                    kind, doubt, good = max(kind, k), doubt or d, max(good, g)
            elif key == "role":
                role = value.strip().lower()
                kind = max(kind, BAD_ROLES.get(role, 0))
                if role in ("main", "article"):
                    good, own = max(good, 1.2), True
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDDEN.search(value.lower())):
                kind = max(kind, SOFT)
    # of an article's many class names one that may be boilerplate's says nothing
    return _Element(tag, up, depth, kind, doubt and not own, good, own and not kind)


def blocks(html: str) -> tuple[list[Block], list[_Element]]:
    """Blocks in page order, and the block-level elements, each after its parent."""
    out: list[Block] = []
    root = _Element("", 0, 0)
    elements, stack = [root], [0]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = total = 0
    link_from = 0  # the depth of the stack where the open link began; 0 without one

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                n = text.count(" ") + 1
                elements[stack[-1]].words += n
                out.append((text, n, linked / max(total, 1), stack[-1]))
        linked = total = 0

    def close(k: int) -> None:
        nonlocal link_from
        for e in stack[k:]:
            opened[elements[e].tag] -= 1
        del stack[k:]
        if link_from > k:
            link_from = 0

    def say(raw: str) -> None:
        nonlocal linked, total
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        n = len(text.strip())
        total += n
        if link_from:
            linked += n

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                link_from = 0
            if tag in INLINE:
                continue
            flush()
            if opened[tag]:
                k = next(k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].tag == tag)
                close(k)
            continue
        if tag in RAW:
            if tag not in ("svg", "button", "annotation", "annotation-xml"):
                flush()
            if not m[3].endswith("/"):
                e = RAW_END[tag].search(html, at)
                at = e.end() if e else end
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                link_from = len(stack)
            continue
        flush()
        if tag in ENDS and any(opened[t] for t in ENDS[tag]):
            for k in range(len(stack) - 1, 0, -1):
                now = elements[stack[k]].tag
                if now in SCOPE.get(tag, ()):
                    break
                if now in ENDS[tag]:
                    close(k)
                    break
        now = elements[stack[-1]].tag
        if now == "p" or now in HEADINGS and tag in HEADINGS:  # an open paragraph ends where a block begins
            close(len(stack) - 1)
        if tag not in VOID and not m[3].endswith("/"):
            elements.append(_element(tag, m[3], stack[-1], len(stack)))
            stack.append(len(elements) - 1)
            opened[tag] += 1
    flush()
    return out, elements


def _inherit(elements: list[_Element]) -> None:
    """Words of whole subtrees, then what each element's containers say of what is in it."""
    for e in reversed(elements[1:]):
        elements[e.up].words += e.words
    page = max(1, elements[0].words)
    shut = [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        shut[k] = shut[e.up] or e.kind == HARD
    largest = max((k for k, e in enumerate(elements) if e.own and not shut[k]), key=lambda k: elements[k].words, default=0)
    holds = set()
    k = largest
    while k:
        holds.add(k)
        k = elements[k].up
    half = largest and elements[largest].words >= 0.5 * page
    for k, e in enumerate(elements[1:], 1):
        up = elements[e.up]
        e.bad, e.gain, e.inside = up.bad, max(up.gain, e.good), up.inside or e.tag in GOOD_TAGS
        kind = e.kind
        if kind == SOFT and (k in holds or e.words >= 0.7 * page or e.tag == "header" and up.inside):
            kind = 0
        elif kind == NAME and k in holds and half:
            kind = 0
        if kind:
            e.bad = SURE
        elif e.doubt:
            e.bad = min(e.bad, DOUBT)


def log_odds(found: list[Block], elements: list[_Element]) -> list[float]:
    _inherit(elements)
    odds = []
    for text, n, link, at in found:
        e = elements[at]
        score = 0.3 + e.bad + e.gain + min(2.0, 0.6 * log1p(n) - 1.2)
        score += 0.6 if text[-1] in ".!?…。»”\"" else 0.0
        score -= 2.5 * link if link > 0.3 else 0.0
        score += 0.6 if e.tag in HEADINGS else -0.2 if e.tag in ("td", "th") else 0.0
        if n < 40 and STOCK.search(text):  # an article can have such a line of its own
            score -= 1.0 if e.gain >= 1.2 else 3.0
        odds.append(score)
    return odds


def edges(found: list[Block], elements: list[_Element]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours in page order and between neighbours under one parent.

    What stands in a container that is surely boilerplate says little of what is around it: it is
    passed over, and the blocks before and after it are neighbours.
    """
    out: list[tuple[int, int, float]] = []
    before: dict[bool, int] = {}
    under: dict[tuple[int, bool], int] = {}

    def apart(a: int, b: int) -> int:
        n = 0
        while a != b:
            if elements[a].depth >= elements[b].depth:
                a = elements[a].up
            else:
                b = elements[b].up
            n += 1
        return n

    for i, block in enumerate(found):
        sure = elements[block[3]].bad == SURE
        if i and before.get(sure) != i - 1:
            out.append((i - 1, i, 0.2 / (1.0 + 0.5 * apart(found[i - 1][3], block[3]))))
        if (j := before.get(sure)) is not None:
            # in page order all paths of either kind pass an element twice at most
            out.append((j, i, 1.5 / (1.0 + 0.5 * apart(found[j][3], block[3]))))
        before[sure] = i
        parent = elements[block[3]].up, sure
        if (k := under.get(parent)) is not None and k != j:
            out.append((k, i, 0.3))
        under[parent] = i
    return out


def min_cut(unary: list[float], pairs: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the capacity cut: True on the source's side."""
    n = len(unary)
    u = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in pairs:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(u[i]) < sum(near[i].values()):
            continue
        label[i] = u[i] >= 0
        for j, w in near[i].items():
            u[j] += w if label[i] else -w
            del near[j][i]
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return [bool(x) for x in label]

    # Dinic's algorithm on what is left; nodes s and t come last
    num = {i: k for k, i in enumerate(rest)}
    s, t = len(rest), len(rest) + 1
    graph: list[list[int]] = [[] for _ in range(t + 1)]
    to: list[int] = []
    cap: list[float] = []

    def link(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        cap.append(there)
        graph[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in rest:
        if u[i] > 0:
            link(s, num[i], u[i], 0.0)
        elif u[i] < 0:
            link(num[i], t, -u[i], 0.0)
        for j, w in near[i].items():
            if i < j:
                link(num[i], num[j], w, w)
    eps = 1e-9
    while True:
        level = [-1] * (t + 1)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            break
        at = [0] * (t + 1)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= eps)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(graph[a]):
                e = graph[a][at[a]]
                if cap[e] > eps and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(graph[a]):
                path.append(graph[a][at[a]])
                a = to[path[-1]]
            elif path:
                level[a] = -1
                a = to[path.pop() ^ 1]
            else:
                break
    # nodes the sink can't be reached from are content, so ties go to content
    reach = {t}
    queue = deque([t])
    while queue:
        b = queue.popleft()
        for e in graph[b]:
            if cap[e ^ 1] > eps and to[e] not in reach:
                reach.add(to[e])
                queue.append(to[e])
    for i in rest:
        label[i] = num[i] not in reach
    return [bool(x) for x in label]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found, elements = blocks(html)
    odds = log_odds(found, elements)
    keep = min_cut(odds, edges(found, elements))
    return "\n\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", rows: int = 512) -> DataFrame:
    """The rows of pages with ``text`` and ``n_chars`` in place of the html; columns of these names are replaced."""
    kept = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]
    out = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                texts = [main_text(h) for h in part.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string()).cast(kinds.field("text").type), pa.array([len(x) for x in texts], pa.int64())], names=kinds.names)

    return pages.mapInArrow(run, out)
