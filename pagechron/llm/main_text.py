"""Main text of web pages: blocks labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# HTML's elements by what they mean for a page's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INVISIBLE = frozenset("script style noscript template head title iframe object svg canvas audio video map textarea select option optgroup datalist button input xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNBROKEN = INLINE | INVISIBLE | (VOID - {"hr"}) | {"picture"}
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd".split())
BOILERPLATE_TAGS = frozenset("nav footer aside menu".split())
WRAPPER_TAGS = frozenset("form dialog fieldset".split())  # furniture, but some sites put whole pages in them
CONTENT_TAGS = frozenset("article main".split())
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus footer "
    "gdpr header hidden legal login masthead menu modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination paywall popup popular promo promoted promotion "
    "recommended related reply replies respond search share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe taboola tags toolbar topbar trending widget".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry entrytext main post postbody story text".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
CONTENT_ROLES = frozenset("main article".split())

# Words that only say where or in what shape a thing is, beside one of the above in a name.
SHAPE_WORDS = frozenset(
    "area articles bar block body bottom box btn button buttons container content float form global group inner item items left link links list main outer page panel posts primary right row "
    "secondary section site stories text the thread top unit user wrap wrapper".split()
)
DISCUSSION_WORDS = frozenset("comment comments commentlist discussion disqus reply replies respond".split())
#: Costs are integers. What an element's tag or role, or its name, adds to a label's cost for the text in it.
TAGGED, NAMED, MAIN, CONTENT = 400, 220, 300, 60
#: What calling a bare block boilerplate costs more on a page that has nothing else.
ONLY = 120
#: Characters of sentences that make a wrapper around nearly all of a page's text the page itself.
WRAPPED_TEXT = 80
_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|!--(.*?)(?:-->|--!>|$)|([!?/])[^>]*>?)""", re.S)
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass
class Block:
    """Text without a block-level tag inside, and what stands around it."""

    text: str
    depth: int  #: open elements around it
    shared: int  #: of these, those that also stand around the block before
    parent: int  #: number of the element around its own
    linked: int  #: characters inside links
    tag: str
    prior: int  #: what the nearest telling element says: a cost of calling it boilerplate, or, below 0, content
    by: int = 0  #: number of that element
    heading: bool = False


@dataclass
class _Open:
    tag: str
    number: int
    prior: int
    by: int  #: number of the element that the prior is of
    firm: bool  #: may no article inside it be the page's
    hidden: bool
    inline: bool = field(default=False)


def _boilerplate_name(tokens: list[str]) -> tuple[bool, bool]:
    """Is a class or id one of page furniture, as a whole; and is it of a discussion?"""
    named = talk = False
    for token in tokens:
        words = _WORD.findall(_CAMEL.sub(" ", token).lower())
        if any(w in BOILERPLATE_WORDS for w in words) and all(w in BOILERPLATE_WORDS or w in SHAPE_WORDS for w in words):
            named, talk = True, talk or any(w in DISCUSSION_WORDS for w in words)
    return named, talk


def _telling(tag: str, attributes: str, number: int, above: _Open | None) -> _Open:
    """What an element says about its text, the nearest that says anything deciding, and whether its text is shown."""
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))
    role, tokens = found.get("role", "").lower(), [t for k in ("class", "id") for t in found.get(k, "").split()]
    prior, by, firm = (above.prior, above.by, above.firm) if above else (0, 0, False)
    main = tag in CONTENT_TAGS or role in CONTENT_ROLES or found.get("itemprop", "").lower() == "articlebody"
    named, talk = _boilerplate_name(tokens) if tokens and tag not in ("html", "body", "main") else (False, False)
    if tag in BOILERPLATE_TAGS:
        prior, by, firm = -TAGGED, 0, True
    elif tag in WRAPPER_TAGS or role in BOILERPLATE_ROLES and tag not in ("html", "body", "main"):
        prior, by = -TAGGED, 0 if firm else number
    elif talk or named and not (main and prior <= 0):
        prior, by, firm = -NAMED, number, firm or talk
    elif tag == "header":
        prior, by = (prior, by) if prior > 0 else (-TAGGED, 0)
    elif main:
        prior, by = (prior, by) if firm else (MAIN, 0)
    elif prior >= 0 and tag not in ("html", "body") and any(w in CONTENT_WORDS for t in tokens for w in _WORD.findall(_CAMEL.sub(" ", t).lower())):
        prior, by = max(prior, CONTENT), 0
    return _Open(tag, number, prior, by, firm, hidden)


def blocks(html: str | None) -> list[Block]:
    """All visible blocks of a page, in its order; bad markup never fails."""
    out: list[Block] = []
    stack: list[_Open] = []
    outer: list[_Open] = []  # those of the stack that are no inline elements
    is_open: Counter = Counter()
    parts: list[tuple[str, bool]] = []
    count = at = low = 0
    html = html or ""

    def text(piece: str) -> None:
        if piece and not (stack and stack[-1].hidden):
            parts.append((unescape(piece) if "&" in piece else piece, is_open["a"] > 0))

    def close() -> None:
        nonlocal low
        if not parts:
            return
        whole = " ".join("".join(p for p, _ in parts).split())
        if whole:
            tag, top = (outer[-1].tag if outer else ""), (stack[-1] if stack else None)
            parent = outer[-2].number if len(outer) > 1 else 0
            linked = sum(len(" ".join(p.split())) for p, inside in parts if inside)
            out.append(Block(whole, len(outer), low, parent, linked, tag, top.prior if top else 0, top.by if top else 0, tag[:1] == "h" and tag[1:].isdigit()))
            low = len(outer)
        parts.clear()

    def pop(to: int) -> None:
        nonlocal low
        gone = stack[to:]
        if any(not o.inline for o in gone):
            close()
        del stack[to:]
        for o in gone:
            is_open[o.tag] -= 1
            if not o.inline:
                outer.pop()
        low = min(low, len(outer))

    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            break
        text(html[at:start])
        m = _TAG.match(html, start) or _BROKEN.match(html, start)
        if not m:  # a bare "<"
            text("<")
            at = start + 1
            continue
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if is_open[name] <= 0:
                if name not in UNBROKEN:
                    close()
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == name:
                    pop(k)
                    break
                if stack[k].tag in ("table", "td", "th") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if name == "br":
            text(" ")
            continue
        if name in CLOSES_P and is_open["p"] > 0:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p":
                    pop(k)
                    break
                if not stack[k].inline:
                    break
        if name in ENDS and any(is_open[t] > 0 for t in ENDS[name][0]):
            same, ends = ENDS[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in same:
                    pop(k)
                    break
                if stack[k].tag in ends:
                    break
        inline = name in UNBROKEN
        if not inline:
            close()
        if name in VOID or m[3].endswith("/") and name in ("path", "use", "circle"):
            continue
        count += 1
        now = _telling(name, m[3], count, stack[-1] if stack else None)
        now.inline, own_hidden = inline, now.hidden
        now.hidden = own_hidden or name in INVISIBLE or bool(stack and stack[-1].hidden)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            if name not in INVISIBLE:
                text(html[at : end.start() if end else len(html)])
            at = end.end() if end else len(html)
            continue
        if name == "body":  # ends whatever the head left open
            while stack and stack[-1].tag != "html":
                pop(len(stack) - 1)
            now.hidden = own_hidden and bool(re.search(r"\bhidden\b", m[3]))
        stack.append(now)
        is_open[name] += 1
        if not inline:
            outer.append(now)
    close()
    return out


def _sentences(b: Block) -> int:
    """Characters of running text: a block of some length that ends as a sentence does and isn't mostly links."""
    return len(b.text) if len(b.text) >= 40 and 10 * b.linked <= 3 * len(b.text) and re.search(r"[.!?…。]\W*$", b.text) else 0


def trusted(found: list[Block]) -> list[Block]:
    """The blocks, without the word of an element that would make a page boilerplate though nothing else is its article.

    A name is not believed about most of a page's text; a form, dialog, fieldset
    or role not about nearly all of what nothing else is said of, if that holds
    running text.
    """
    if any(b.prior > 0 for b in found):
        return found
    size, told, named = Counter(), Counter(), set()
    for b in found:
        own = b.by if b.prior < 0 else -1
        size[own] += len(b.text)
        told[own] += _sentences(b)
        if b.prior == -NAMED:
            named.add(own)
    total = sum(size.values())
    doubted = {k for k, n in size.items() if k > 0 and (2 * n > total if k in named else n >= 4 * size[-1] and told[k] >= WRAPPED_TEXT)}
    return [replace(b, prior=0) if b.prior < 0 and b.by in doubted else b for b in found]


def costs(block: Block) -> tuple[int, int]:
    """What it costs to call the block boilerplate, and to call it content."""
    n = len(block.text)
    keep, drop = max(0, block.prior), max(0, -block.prior)
    density = block.linked / n
    drop += int(80 * density) if density > 0.3 else 0
    keep += min(80, n // 4)
    keep += 20 if block.tag in ("p", "blockquote", "pre", "figcaption") else 0
    keep += 10 if block.heading else 0
    keep += 20 if re.search(r"[.!?…。]\W*$", block.text) else 0
    drop += 30 if n < 25 and not block.heading else 0
    drop += 25 if block.tag in ("li", "td", "th", "dt", "dd") and n < 40 else 0
    drop += 60 if re.match(r"\s*(?:©|\(c\)|copyright\b)", block.text, re.I) else 0
    return keep, drop


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness: neighbours in the page, the more the more of their elements they share,
    and blocks with one parent."""
    out, last = [], {}
    for k, b in enumerate(found):
        if k:
            apart = found[k - 1].depth + b.depth - 2 * b.shared
            out.append((k - 1, k, 40 if apart <= 2 else 20 if apart <= 4 else 8))
        if b.parent in last and last[b.parent] != k - 1:
            out.append((last[b.parent], k, 15))
        last[b.parent] = k
    return out


def min_cut(keep: list[int], drop: list[int], pairs: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least total cost: True (source side) is content.

    A node costs ``keep`` if cut from the source, ``drop`` if cut from the sink, a
    pair its weight if cut apart. Maximum flow by blocking flows over levels: as
    supply and demand lie near each other, few levels are needed, and the work
    is about proportional to the page.
    """
    n = len(keep)
    left = [k - d for k, d in zip(keep, drop, strict=True)]  # over 0: from the source, under 0: to the sink
    to: list[int] = []
    room: list[int] = []
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b, w in pairs:  # an edge and its reverse are neighbours in the lists
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += (b, a)
        room += (w, w)

    def levels() -> list[int]:
        level, queue = [-1] * n, [k for k in range(n) if left[k] > 0]
        for k in queue:
            level[k] = 0
        for k in queue:  # grows while it is walked
            for e in near[k]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[k] + 1
                    queue.append(to[e])
        return level

    while True:
        level = levels()
        if not any(level[k] >= 0 and left[k] < 0 for k in range(n)):
            return [x >= 0 for x in level]
        tried = [0] * n
        for start in range(n):
            if left[start] <= 0:
                continue
            path, k = [], start  # edges walked from start
            while left[start] > 0:
                if left[k] < 0:
                    flow = min(left[start], -left[k], *(room[e] for e in path))
                    left[start] -= flow
                    left[k] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, k = [], start
                    continue
                while tried[k] < len(near[k]):
                    e = near[k][tried[k]]
                    if room[e] > 0 and level[to[e]] == level[k] + 1:
                        break
                    tried[k] += 1
                if tried[k] < len(near[k]):
                    path.append(near[k][tried[k]])
                    k = to[path[-1]]
                elif path:
                    k = to[path.pop() ^ 1]
                    tried[k] += 1
                else:
                    break


def main_text(html: str | None) -> str:
    """The page's content blocks, in page order, joined by line feeds."""
    found = trusted(blocks(html))
    if not found:
        return ""
    priced = [costs(b) for b in found]
    content = min_cut([k for k, _ in priced], [d for _, d in priced], edges(found))
    if not any(content) and any(b.prior == 0 for b in found):  # short texts, but all there is
        priced = [(k + ONLY if b.prior == 0 and 2 * b.linked <= len(b.text) else k, d) for b, (k, d) in zip(found, priced, strict=True)]
        content = min_cut([k for k, _ in priced], [d for _, d in priced], edges(found))
    return "\n".join(b.text for b, c in zip(found, content, strict=True) if c)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row, from its whole html.

    Null and empty html, and pages of boilerplate alone, give an empty text; null
    ids and URLs are kept; repeated rows repeat; an empty table gives no rows;
    other columns are ignored.
    """
    prepare(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
