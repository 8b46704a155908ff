"""Main text of web pages by consensus paths of their hosts.

Pass one scores the containers of each page by the text of their blocks and lets the page
vote for the generalised path (tags with classes, digits removed) of its best one.  Votes
are counted per host and path; pass two takes the text of the elements on the host's winning
path, or of the page's own best container where the page has no such element.

Words in class or id ("sidebar", "comments") are evidence, not a verdict: an element with one
is left out if it holds at most half of the page's running text; one that holds more, and
no heading of the first level, counts for less in the scores, and the host's votes decide.  Names that state something about the
page ("has-sidebar", "comments-open") are no evidence.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>\"[^\"]*\"|'[^']*'|[^'\">])*+|[^>]*+)>",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I | re.S)
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object".split())
CONTAINER = frozenset("article main section div td body blockquote figure".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = CONTAINER | HEADING | frozenset(
    "p ul ol li dl dt dd pre table thead tbody tr form fieldset nav header footer aside address hr figcaption details summary".split()
)
#: Elements and roles that hold no article text.
OUTSIDE = frozenset("nav footer aside form button select fieldset dialog menu label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Elements that take all up to their end tag, or else to the end of the page, as their text.
SWALLOW = frozenset("script style title textarea iframe".split())
#: Words that, in a class or id, speak about the page or its layout.
STATES = frozenset("has no non with without is open closed enabled disabled allowed".split())
#: What blocks in a marked element of much text are worth in the scores.
DOUBT = 0.1
#: Words in class or id that mark what is mostly not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notification popup modal overlay newsletter subscribe subscription paywall sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead toolbar comment comments disqus reply replies share sharing social related "
    "recommended recommendations widget pagination pager login signup search skip".split()
)
#: Blocks that a block of the same kind closes, up to the list or table that holds them.
CLOSES = {"li": ("li", {"ul", "ol"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}


@dataclass
class Element:
    tag: str
    path: str
    parent: int
    outside: bool
    marked: bool
    in_article: bool
    in_header: bool


@dataclass
class Block:
    text: str
    owner: int
    linked: int


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _marks(attrs: str) -> tuple[str, bool, bool]:
    """Generalised class of a tag, whether its class or id marks it, and whether its other
    attributes put it outside the article."""
    classes, marked, outside = "", False, False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key in ("class", "id"):
            for one in value.split():
                words = {w.lower() for w in _TOKEN.findall(one)}
                marked |= not words.isdisjoint(MARKS) and words.isdisjoint(STATES)
            if key == "class":
                classes = ".".join(sorted({re.sub(r"\d+", "", c.lower()) for c in value.split()} - {""}))
        elif key == "role":
            outside |= value.lower() in ROLES
        elif key == "style":
            outside |= "display:none" in value.replace(" ", "").lower()
        else:
            outside |= value.lower() != "false"
    return classes, marked, outside


def parse(source: str) -> Page:
    """Elements and text blocks of a page; tolerates unclosed and stray tags."""
    page = Page()
    page.elements.append(Element("html", "", -1, False, False, False, False))
    stack = [0]
    parts: list[str] = []
    linked = 0
    links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = _SPACE.sub(" ", html.unescape(raw) if "&" in raw else raw).strip()
            if text:
                page.blocks.append(Block(text, stack[-1], linked))
            parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            links -= page.elements[stack.pop()].tag == "a"

    def close(names: str, barrier: set[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = page.elements[stack[depth]].tag
            if tag in names.split():
                flush()
                return pop_to(depth)
            if tag in barrier:
                return None

    def add(text: str) -> None:
        nonlocal linked
        if text and not page.elements[stack[-1]].outside:
            parts.append(text)
            linked += len(text) if links else 0

    at, end = 0, len(source)
    while at < end:
        m = _TAG.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if page.elements[stack[depth]].tag == name:
                    if name in BLOCK:
                        flush()
                    pop_to(depth)
                    break
            continue
        if name in RAW:
            if not m["attrs"].endswith("/"):
                stop = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                at = stop.end() if stop else end if name in SWALLOW else at
            continue
        if name in CLOSES:
            close(*CLOSES[name])
        if name in BLOCK:
            flush()
            close("p", CONTAINER | {"table", "ul", "ol", "button"})
        if name in VOID or m["attrs"].endswith("/"):
            add(" " if name in ("br", "wbr", "hr", "img") else "")
            continue
        if name == "td" or name == "th":
            add(" ")
        up = page.elements[stack[-1]]
        classes, marked, outside = _marks(m["attrs"]) if m["attrs"] else ("", False, False)
        outside = (outside and name not in ("html", "body", "main")) or up.outside or name in OUTSIDE
        marked = marked and name not in ("html", "body", "main")
        in_article = up.in_article or name in ("article", "main")
        outside |= name == "header" and not in_article
        path = f"{up.path}>{name}{'.' + classes if classes else ''}" if name in CONTAINER else up.path
        page.elements.append(Element(name, path, stack[-1], outside, marked, in_article, up.in_header or name == "header"))
        stack.append(len(page.elements) - 1)
        links += name == "a"
    flush()
    _leave_out(page)
    return page


def _running(b: Block) -> int:
    """How much of a block reads as text rather than as a list of links."""
    return max(0, len(b.text) - 2 * b.linked)


def _leave_out(page: Page) -> None:
    """Drop the blocks in marked elements that hold at most half of the page's running text;
    of the others, those with a heading of the first level are marked no more."""
    held, titled = [0] * len(page.elements), [False] * len(page.elements)
    for b in page.blocks:
        held[b.owner] += _running(b)
        titled[b.owner] |= page.elements[b.owner].tag == "h1"
    for i in range(len(held) - 1, 0, -1):  # parents come before their children
        held[page.elements[i].parent] += held[i]
        titled[page.elements[i].parent] |= titled[i]
    for i, e in enumerate(page.elements[1:], 1):
        e.outside |= page.elements[e.parent].outside or (e.marked and 2 * held[i] <= held[0])
        e.marked &= not (e.outside or titled[i])
    page.blocks = [b for b in page.blocks if not page.elements[b.owner].outside]


def _marked_below(page: Page, at: int, root: int) -> bool:
    """Whether a marked element stands between an element and one above it."""
    while at > root:
        if page.elements[at].marked:
            return True
        at = page.elements[at].parent
    return False


def best_container(page: Page) -> int | None:
    """The element whose blocks hold most running text, with half for blocks one level down."""
    scores: dict[int, float] = {}
    for b in page.blocks:
        worth = float(_running(b))
        if page.elements[b.owner].tag in HEADING:
            worth *= 0.1
        if _marked_below(page, b.owner, 0):
            worth *= DOUBT
        share, at, level = 1.0, b.owner, 0
        while at > 0 and level < 2:
            if page.elements[at].tag in CONTAINER:
                bonus = 1.5 if page.elements[at].tag in ("article", "main") else 1.0
                scores[at] = scores.get(at, 0.0) + worth * share * bonus
                share, level = share / 2, level + 1
            at = page.elements[at].parent
    if not scores:
        return 0 if page.blocks else None
    return max(scores, key=lambda e: (scores[e], -e))


def text_of(page: Page, roots: set[int]) -> str:
    """Blocks at or under the roots, in page order; those in marked elements under a root
    only if it has no other running text."""
    found: list[tuple[Block, bool]] = []
    for b in page.blocks:
        at, owner = b.owner, page.elements[b.owner]
        if owner.in_header and owner.tag not in HEADING:
            continue
        while at > 0 and at not in roots:
            at = page.elements[at].parent
        if at in roots:
            found.append((b, _marked_below(page, b.owner, at)))
    rest = any(_running(b) and page.elements[b.owner].tag not in HEADING for b, marked in found if not marked)
    return "\n\n".join(b.text for b, marked in found if not (marked and rest))


def host_of(url: str | None) -> str | None:
    m = _HOST.match(url.strip()) if url else None
    return m[1].lower() if m else None


def vote(source: str, url: str | None) -> tuple[str, str] | None:
    """Host and path that a page votes for."""
    host = host_of(url)
    if host is None:
        return None
    page = parse(source)
    best = best_container(page)
    return (host, page.elements[best].path) if best else None


def extract(source: str, path: str | None) -> str:
    """The page's text on ``path``, or in its own best container."""
    page = parse(source)
    roots = {i for i, e in enumerate(page.elements) if e.path == path and e.tag in CONTAINER} if path else set()
    if roots:
        text = text_of(page, roots)
        if text:
            return text
    best = best_container(page)
    return "" if best is None else text_of(page, {best})


def _votes(batches):
    for batch in batches:
        found = [v for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if h and (v := vote(h, u))]
        hosts, paths = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], names=["host", "path"])


def _texts(names: list[str]):
    def run(batches):
        for batch in batches:
            *kept, sources, paths = batch.columns
            texts = [extract(h, p) if h else "" for h, p in zip(sources.to_pylist(), paths.to_pylist())]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[*names, "text"])

    return run


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``html_col`` replaced by ``text``, the main text; other columns stay.

    Null and empty html, and pages without text, give the empty string.  Pages without a
    host in their url have no consensus and use their own best container.  Equal votes go
    to the path that sorts last.  Repeated rows vote and are extracted each.  A column named
    ``text`` or starting with ``__`` is replaced.
    """
    votes = pages.select(F.col(url_col).cast("string"), F.col(html_col)).mapInArrow(lean(_votes), "host string, path string")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"))
    winners = counted.groupBy("host").agg(F.max(F.struct("n", "path"))["path"].alias("__path"))
    host = F.lower(F.regexp_extract(F.trim(F.col(url_col)), _HOST.pattern.replace("^", "^(?i)", 1), 1))
    kept = [c for c in pages.columns if c not in (html_col, "text") and not c.startswith("__")]
    given = pages.select(*kept, F.col(html_col).alias("__html"), host.alias("__of"))
    winners = materialize(winners, "host-paths")  # then its size is known when the join is planned
    joined = given.join(winners.withColumnRenamed("host", "__host"), F.col("__of") == F.col("__host"), "left")
    joined = joined.select(*kept, "__html", "__path")
    schema = pages.select(*kept).schema.add("text", "string")
    return joined.mapInArrow(lean(_texts(kept)), schema)
