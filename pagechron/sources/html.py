"""Pages to rows of the few nodes that can hold a date: the one pass in Python."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .scratch import prepare

#: Characters of a page that are read.
MAX_HTML = 10 * 1024 * 1024

# Elements by what they mean here, and bounds of the walk.
TEXT_TAGS = frozenset("p span div li small em strong b i time abbr address figcaption td dd label a h1 h2 h3 h4 h5 h6".split())
INLINE_TAGS = frozenset("time span b strong em".split())
QUOTED_TAGS = frozenset("blockquote code pre samp kbd".split())
TITLED_TAGS = frozenset("abbr time span".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"})}
CONTEXT_DEPTH, QUOTE_DEPTH, NEAR_CHARS, NEAR_VISITS = 24, 16, 400, 4_000
MAYBE_DATE = re.compile("[0-9٠-٩۰-۹०-९๐-๙０-９]{4}|[年년]")
# Class and id words of page furniture, and of marks for a date.
FURNITURE = (
    "related recent popular trending sidebar widget nav menu comment reply breadcrumb pagination newsletter promo advert teaser "
    "card-list post-list archive-list logo masthead banner brand current clock today"
).split()
MARKERS = (
    "byline dateline post-meta entry-meta article-meta published publish-date posted-on posted pubdate last-updated lastmod updated submitted created "
    "publication post-date entry-date date datum erstellt veroffentlicht author autor fecha parution subline info meta footer time publish created-post post-detail field-content"
).split()
PUBLICATION_MARKERS = frozenset("byline dateline published publication publish-date posted-on posted pubdate entry-date post-date".split())
MODIFICATION_MARKERS = frozenset("last-updated lastmod updated".split())
DATE_BLOCK_MARKERS = PUBLICATION_MARKERS | MODIFICATION_MARKERS | frozenset("date datum time fecha parution dateline post-meta".split())
_FURNITURE = re.compile(f"({'|'.join(FURNITURE)})([-_]|$)", re.I)
_MARKER = re.compile(rf"(?:^|[-_\s])({'|'.join(MARKERS)})(?=[-_\s]|$)", re.I)
_CAMEL = re.compile("(?<=[a-z0-9])(?=[A-Z])")
# JSON-LD types that are the page's content, and its date keys.
CONTENT_TYPES = frozenset("report question answer webpageelement creativework blog podcastepisode newsletter".split())
LD_KEYS = ("datePublished", "dateCreated", "dateModified", "uploadDate")
LD_DEPTH = 12
# Date literals in scripts, the key before them, and how much is scanned.
_LITERAL = re.compile(r"""["'](\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?)["']""", re.A)
_KEY_BEFORE = re.compile(r"""([A-Za-z_][A-Za-z0-9_]{2,30})["']?\s*[:=]\s*$""")
_ANY_LITERAL = re.compile(r"""["']\d{4}-\d{2}-\d{2}""", re.A)
_DATA_TYPES = re.compile("ld\\+json|importmap|speculationrules", re.I)
KEY_LOOKBACK, MAX_SCRIPT = 64, 512_000


class Node:
    """An element: children are nodes and strings."""

    __slots__ = ("attrs", "kids", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []

    def ancestors(self, most: int) -> Iterator[Node]:
        """The element itself and what it lies in, innermost first."""
        node = self
        while node is not None and node.tag and most > 0:
            yield node
            node, most = node.up, most - 1

    def strings(self) -> Iterator[str | None]:
        """Its text in order; None for each other step of the walk, so that callers can bound it."""
        stack = [iter(self.kids)]
        while stack:
            kid = next(stack[-1], None)
            if kid is None:
                stack.pop()
                yield None
            elif isinstance(kid, str):
                yield kid
            else:
                stack.append(iter(kid.kids))
                yield None

    def text(self) -> str:
        return "".join(s for s in self.strings() if s)

    def near(self) -> str:
        parts, size = [], 0
        for visits, s in enumerate(self.strings(), 1):
            if s:
                parts.append(s)
                size += len(s)
            if size >= NEAR_CHARS or visits >= NEAR_VISITS:
                break
        return "".join(parts)[:NEAR_CHARS]

    def direct(self) -> str:
        """Its own text, with that of inline children."""
        return "".join(k if isinstance(k, str) else k.text() if k.tag in INLINE_TAGS else "" for k in self.kids)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._end({"p"}, {"button", "table", "td", "th", "li", "div", "section", "article", "body"})
        if tag in SAME_ENDS:
            self._end(*SAME_ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.kids.append(node)
        if tag not in VOID_TAGS:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._end({tag}, set())

    def _end(self, tags: set[str], within: set[str]) -> None:
        node = self.at
        while node.tag:
            if node.tag in tags:
                self.at = node.up
                return
            if node.tag in within:
                return
            node = node.up

    def handle_data(self, data):
        self.at.kids.append(data)


def parse_html(html: str) -> Node:
    """A lenient tree; unclosed and stray tags never fail."""
    builder = _Builder()
    builder.feed(html[:MAX_HTML])
    builder.close()
    return builder.root


def elements(root: Node) -> Iterator[Node]:
    stack = [iter(root.kids)]
    while stack:
        kid = next(stack[-1], None)
        if kid is None:
            stack.pop()
        elif not isinstance(kid, str):
            yield kid
            stack.append(iter(kid.kids))


def context(node: Node) -> tuple[bool, bool, str | None]:
    """May a date here be the page's, is it marked as one, and by which word.

    The nearest of furniture and mark decides, the mark if both are at one
    element; page-level headers, footers and asides need a mark or an article.
    """
    article = edge = False
    marked = banned = None
    marker = None
    for depth, el in enumerate(node.ancestors(CONTEXT_DEPTH)):
        article |= el.tag in ("article", "main")
        edge |= el.tag in ("header", "footer", "aside")
        if el.tag == "nav":
            banned = depth if banned is None else min(banned, depth)
        tokens = [_CAMEL.sub("-", t).lower() for t in f"{el.attrs.get('class', '')} {el.attrs.get('id', '')}".split()]
        kept = [t for t in tokens if not _FURNITURE.match(t)]
        if len(kept) < len(tokens) and banned is None:
            banned = depth
        if marked is None and (words := [w.lower() for t in kept for w in _MARKER.findall(t)]):
            telling = [w for w in words if w in PUBLICATION_MARKERS | MODIFICATION_MARKERS] or [w for w in words if w in DATE_BLOCK_MARKERS] or words
            marked, marker = depth, telling[0]
    if banned is not None and (marked is None or marked > banned):
        return False, False, None
    if edge and not article and marked is None:
        return False, False, None
    return True, marked is not None, marker


def borrowed(node: Node, host: str | None) -> bool:
    """Is it quoted, or inside a link to another site?"""
    for el in node.ancestors(QUOTE_DEPTH):
        if el.tag in QUOTED_TAGS:
            return True
        href = el.attrs.get("href", "") if el.tag == "a" and host else ""
        if re.match("https?://", href, re.I):
            try:
                if (urlsplit(href).hostname or "") != host:
                    return True
            except ValueError:
                pass
    return False


def _ld_nodes(value, depth: int = 0) -> Iterator[dict]:
    if depth > LD_DEPTH:
        return
    if isinstance(value, list):
        for item in value:
            yield from _ld_nodes(item, depth + 1)
    elif isinstance(value, dict):
        yield value
        for key, item in value.items():
            if not key.startswith("@") or key == "@graph":
                yield from _ld_nodes(item, depth + 1)


def _ld_date(raw) -> str | None:
    if isinstance(raw, dict):
        raw = raw.get("@value")
    elif isinstance(raw, list):
        raw = next((x for x in raw if isinstance(x, str)), None)
    return raw if isinstance(raw, str) and raw else None


def _no_constant(name: str):
    raise ValueError(name)


def ld_dates(raw: str) -> Iterator[tuple[str, str, str, bool]]:
    """key, date string, first type and whether it is content, for every typed node of a JSON-LD block."""
    try:
        data = json.loads(raw, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return
    for node in _ld_nodes(data):
        types = node.get("@type")
        types = [t.lower() for t in (types if isinstance(types, list) else [types]) if isinstance(t, str)]
        if not types:
            continue
        content = any(t.endswith(("article", "posting")) or t in CONTENT_TYPES for t in types)
        for key in LD_KEYS:
            if date := _ld_date(node.get(key)):
                yield key, date, types[0], content


def script_dates(text: str) -> Iterator[tuple[str, str]]:
    """key and date literal of every assignment of a date in a script."""
    for m in _LITERAL.finditer(text):
        if key := _KEY_BEFORE.search(text[max(0, m.start() - KEY_LOOKBACK) : m.start()]):
            yield key[1], m[1]


NODES = pa.schema(
    [
        ("kind", pa.string()), ("seq", pa.int32()), ("sub", pa.int32()), ("tag", pa.string()), ("key", pa.string()), ("raw", pa.string()), ("text", pa.string()), ("title", pa.string()),
        ("near", pa.string()), ("usable", pa.bool_()), ("strong", pa.bool_()), ("marker", pa.string()), ("borrowed", pa.bool_()), ("flag", pa.bool_()),
    ]
)
NODES_SQL = "kind string, seq int, sub int, tag string, key string, raw string, text string, title string, near string, usable boolean, strong boolean, marker string, borrowed boolean, flag boolean"


def page_nodes(html: str | None, host: str | None, with_text: bool) -> Iterator[dict]:
    """The page itself first (key: its language), then in its order what can hold a date."""
    root = parse_html(html or "")
    top = next((e for e in elements(root) if e.tag == "html"), None)
    yield {"kind": "page", "seq": -1, "sub": 0, "key": top.attrs.get("lang") if top else None}
    budget = MAX_SCRIPT
    for seq, el in enumerate(elements(root)):
        a = el.attrs
        if el.tag == "meta":
            key = next((a[k] for k in ("property", "name", "itemprop") if k in a), "").strip().lower()
            if key:
                yield {"kind": "meta", "seq": seq, "sub": 0, "key": key, "raw": a.get("content"), "text": a.get("content", a.get("value"))}
        elif el.tag == "link":
            yield {"kind": "link", "seq": seq, "sub": 0, "key": a.get("rel", "").lower(), "raw": a.get("href"), "text": a.get("type", "").lower()}
        elif el.tag == "script":
            kind = a.get("type", "")
            if kind == "application/ld+json":
                for sub, (key, date, first, content) in enumerate(ld_dates(el.text().strip())):
                    yield {"kind": "jsonld", "seq": seq, "sub": sub, "key": key, "raw": date, "text": first, "flag": content}
            elif with_text and budget > 0 and not _DATA_TYPES.search(kind):
                text = el.text()[:budget]
                if _ANY_LITERAL.search(text):
                    budget -= len(text)
                    for sub, (key, date) in enumerate(script_dates(text)):
                        yield {"kind": "inline", "seq": seq, "sub": sub, "key": key, "raw": date.replace(" ", "T")}
        if el.tag == "time" and ("datetime" in a or "pubdate" in a):
            usable, strong, marker = context(el)
            if usable:
                label = a.get("aria-label", a.get("title", ""))[:NEAR_CHARS]
                near = f"{label} {el.up.near() if el.up.tag else ''} {el.near()}"[:NEAR_CHARS]
                yield {"kind": "time", "seq": seq, "sub": 0, "raw": a.get("datetime"), "text": el.text(), "near": near, "key": a.get("itemprop", "").lower(), "flag": "pubdate" in a, "strong": strong, "marker": marker}
        if with_text and el.tag in TEXT_TAGS:
            own, title = el.direct(), a.get("title")
            if MAYBE_DATE.search(own) or (el.tag in TITLED_TAGS and title and MAYBE_DATE.search(title)):
                usable, strong, marker = context(el)
                if usable:
                    yield {"kind": "text", "seq": seq, "sub": 0, "tag": el.tag, "text": own, "title": title, "usable": usable, "strong": strong, "marker": marker, "borrowed": borrowed(el, host)}


def nodes(pages: DataFrame, with_text: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Node rows of (page_id, url): a page that can't be parsed still has its own row."""
    prepare(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("lang", pa.string()), *NODES])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, html, host in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {"page_id": page_id, "url": url, "host": host}
                try:
                    found = list(page_nodes(html, host, with_text))
                except (RecursionError, AssertionError):
                    found = [{"kind": "page", "seq": -1, "sub": 0}]
                rows += [own | {"lang": found[0].get("key")} | n for n in found]
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.substring(F.col(html_col), 1, MAX_HTML).alias("html"), urls.host_of(F.col(url_col)).alias("host"))
    return src.mapInArrow(read, "page_id long, url string, host string, lang string, " + NODES_SQL)
