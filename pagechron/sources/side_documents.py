"""Feeds, sitemaps and response headers, as tables joined to pages: no network."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import detect_day_first, parse_date, to_instant_ms
from ..functions.guard import is_safe_fetch_target, resolve_url
from ..functions.text import let
from ..functions.urls import host_of, normal_path, path_of
from ..operators.extract import FEED, HEADERS, SITEMAP
from .scratch import prepare, stage

# Where feeds and sitemaps are looked for, and how many are read.
FEED_PATHS = ("/index.xml", "/feed.xml")
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml")
MAX_FETCHES = 3
BUILD_STAMP_ENTRIES = 10
#: A Last-Modified so close to the time of serving tells nothing.
SERVE_WINDOW_MS = 300_000
#: A body longer than this is cut.
MAX_BODY = 5 * 1024 * 1024


def capped(body: Column, content_length: Column | None = None, cap: int = MAX_BODY) -> Column:
    """The body's first bytes; null where it declares more than the cap."""
    cut = F.substring(body, 1, cap)
    return cut if content_length is None else F.when(F.coalesce(content_length, F.lit(0)) <= cap, cut)


def _declares_entities(text: str) -> bool:
    """Does anything before the root element declare an entity? The same characters later on are text."""
    root = re.search("<[A-Za-z_]", text)
    return "<!ENTITY" in text[: root.start() if root else None]


def parse_xml(text: str | None) -> ElementTree.Element | None:
    """The root element, or None for what is no XML; entities are never expanded."""
    if not text or _declares_entities(text):
        return None
    try:
        return ElementTree.fromstring(text.strip().encode("utf-8", "replace"))
    except (ElementTree.ParseError, ValueError, LookupError):
        return None


_STRAY = re.compile(r"(<!\[CDATA\[.*?\]\]>)|&(?!(?:#[0-9]+|#x[0-9A-Fa-f]+|amp|lt|gt|quot|apos);)", re.S)


def elements(text: str | None, names: tuple[str, ...]) -> list[ElementTree.Element]:
    """The complete elements of these names, as they begin, up to the first fault or the text's end.

    A bare & or an unknown entity stands for itself; entities are never expanded.
    """
    if not text or _declares_entities(text):
        return []
    parser, begun, ended = ElementTree.XMLPullParser(("start", "end")), [], set()
    try:
        parser.feed(_STRAY.sub(lambda m: m[1] or "&amp;", text.strip()).encode("utf-8", "replace"))
        for kind, el in parser.read_events():
            if _name(el) in names:
                if kind == "start":
                    begun.append(el)
                else:
                    ended.add(id(el))
    except (ElementTree.ParseError, ValueError, LookupError):
        pass
    return [el for el in begun if id(el) in ended]


def _name(el: ElementTree.Element) -> str:
    return re.sub("^.*[}:]", "", el.tag).lower() if isinstance(el.tag, str) else ""


def _child(el: ElementTree.Element, name: str) -> str | None:
    return next((t for c in el if _name(c) == name and (t := "".join(c.itertext()).strip())), None)


def feed_entries(documents: DataFrame) -> DataFrame:
    """feed_url, entry (Atom entries first), is_atom, links, published, pubdate, updated of (url, body)."""
    prepare(documents.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                all_ = elements(body, ("entry", "item"))
                entries = [(True, e) for e in all_ if _name(e) == "entry"] + [(False, e) for e in all_ if _name(e) == "item"]
                for k, (atom, e) in enumerate(entries):
                    links = [c.get("href") or (c.text or "").strip() for c in e.iter() if _name(c) == "link" and c.get("rel") in (None, "", "alternate")]
                    guid = _child(e, "guid")
                    links += [guid] if guid and guid.startswith("http") else []
                    rows.append({"feed_url": url, "entry": k, "is_atom": atom, "links": [x for x in links if x], "published": _child(e, "published"), "pubdate": _child(e, "pubdate"), "updated": _child(e, "updated")})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("feed_url", pa.string()), ("entry", pa.int32()), ("is_atom", pa.bool_()), ("links", pa.list_(pa.string())), ("published", pa.string()), ("pubdate", pa.string()), ("updated", pa.string())])
    return documents.select("url", "body").mapInArrow(read, "feed_url string, entry int, is_atom boolean, links array<string>, published string, pubdate string, updated string")


def sitemap_entries(documents: DataFrame) -> DataFrame:
    """sitemap_url, ord, kind (url or sitemap), loc and lastmod of (url, body)."""
    prepare(documents.sparkSession)
    schema = pa.schema([("sitemap_url", pa.string()), ("ord", pa.int32()), ("kind", pa.string()), ("loc", pa.string()), ("lastmod", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, e in enumerate(elements(body, ("url", "sitemap"))):
                    rows.append({"sitemap_url": url, "ord": k, "kind": _name(e), "loc": _child(e, "loc"), "lastmod": _child(e, "lastmod")})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return documents.select("url", "body").mapInArrow(read, "sitemap_url string, ord int, kind string, loc string, lastmod string")


def build_stamped(entries: DataFrame) -> DataFrame:
    """Sitemaps of many entries whose every date is the same: the build's, not the pages'."""
    urls = entries.filter("kind = 'url'").groupBy("sitemap_url").agg(F.count("*").alias("entries"), F.count_distinct("lastmod").alias("dates"))
    return urls.select("sitemap_url", "entries", ((F.col("entries") >= BUILD_STAMP_ENTRIES) & (F.col("dates") == 1)).alias("stamped"))


def page_links(node_rows: DataFrame) -> DataFrame:
    """page_id, url, lang, ord, rel, type and target (absolute) of every link element that may matter here, and a row for each page."""
    telling = (F.col("kind") == "link") & F.col("key").rlike("canonical|alternate|sitemap")
    rows = node_rows.filter((F.col("kind") == "page") | telling)
    link = F.col("kind") == "link"
    return rows.select("page_id", "url", "lang", F.col("seq").alias("ord"), F.when(link, F.col("key")).alias("rel"), F.when(link, F.col("text")).alias("type"), resolve_url(F.col("url"), F.when(link, F.col("raw"))).alias("target"))


def _origin(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", 0)


def _known(links: DataFrame) -> DataFrame:
    """One row per page: canonical, feeds and sitemaps (declared, safe, in order), hint."""
    has = lambda word: F.array_contains(F.split("rel", "\\s+"), F.lit(word))
    rows = links.withColumn("safe", F.coalesce(is_safe_fetch_target(F.col("target")), F.lit(False)))
    pick = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond & F.col("target").isNotNull(), F.struct("ord", "target")))), lambda x: x["target"])
    feed = has("alternate") & F.col("type").isin("application/rss+xml", "application/atom+xml") & F.col("safe")
    known = rows.groupBy("page_id", "url").agg(F.first("lang").alias("lang"), pick(F.col("rel") == "canonical").alias("canonical"), pick(feed).alias("feeds"), pick(has("sitemap") & F.col("safe")).alias("sitemaps"))
    return known.select("page_id", "url", F.get("canonical", F.lit(0)).alias("canonical"), "feeds", "sitemaps", detect_day_first(F.col("lang"), host_of(F.col("url"))).alias("hint"))


def _link_path(link: Column) -> Column:
    return normal_path(F.coalesce(path_of(link), F.regexp_extract(link, "^/[^?#]*", 0)))


def _matches(wanted: DataFrame, links: DataFrame, document: str) -> DataFrame:
    """Rows of ``links`` (document, link, path, ...) beside the pages that want that document and that they speak of.

    By the same path or by the canonical URL: two equality joins, each within the
    document, so that a path which all sites have joins no site with another's.
    """
    by_path = wanted.join(links, [document, "path"]).drop("path")
    by_name = wanted.drop("path").join(links.drop("path").withColumn("canonical", F.col("link")), [document, "canonical"])
    return by_path.unionByName(by_name)


_COLUMNS = ["page_id", "url", "stage", "seq", "sub", "value", "precision", "field", "source", "confidence", "note"]


def feed_candidates(known: DataFrame, entries: DataFrame) -> DataFrame:
    """Of each page's first feed that tells, the dates of the first entry that is the page."""
    declared = F.size("feeds") > 0
    probes = F.array(*(F.concat(_origin(F.col("url")), F.lit(p)) for p in FEED_PATHS))
    path = normal_path(path_of(F.col("url")))
    wanted = known.select("page_id", "url", "canonical", "hint", path.alias("path"), declared.alias("declared"), F.posexplode(F.when(declared, F.col("feeds")).otherwise(probes)).alias("feed", "feed_url"))
    links = entries.withColumn("link", F.explode("links")).drop("links").withColumn("path", _link_path(F.col("link")))
    hits = _matches(wanted, links, "feed_url").dropDuplicates(["page_id", "url", "feed_url", "entry"])
    probed = F.when(F.col("declared"), "").otherwise(" (probed)")
    note = F.concat(F.when(F.col("is_atom"), "Atom").otherwise("RSS"), F.lit(" feed entry"), probed)
    dates = F.array(*(F.struct(F.lit(k).alias("sub"), F.lit(f).alias("field"), parse_date(F.col(c), F.col("hint")).alias("date")) for k, (c, f) in enumerate([("published", "published"), ("pubdate", "published"), ("updated", "modified")])))
    hits = hits.withColumn("dates", F.filter(dates, lambda d: d["date"].isNotNull())).filter(F.size("dates") > 0)
    first = F.row_number().over(Window.partitionBy("page_id", "url").orderBy("feed", "entry"))
    hits = hits.withColumn("note", note).withColumn("_first", first).filter("_first = 1")
    only = F.col("is_atom") & (F.size("dates") == 1) & (F.get("dates", F.lit(0))["field"] == "modified")
    rows = hits.select("page_id", "url", only.alias("only"), "is_atom", "note", F.explode("dates").alias("d"))
    return rows.select(
        "page_id", "url", F.lit(FEED).alias("stage"), F.lit(0).alias("seq"), F.col("d.sub").alias("sub"), F.col("d.date.value").alias("value"), F.col("d.date.precision").alias("precision"),
        F.when(F.col("only"), "published").otherwise(F.col("d.field")).alias("field"), F.when(F.col("is_atom"), "atom-feed").otherwise("rss-feed").alias("source"), F.lit("declared").alias("confidence"),
        F.when(F.col("only"), F.concat("note", F.lit(" (only <updated> present)"))).otherwise(F.col("note")).alias("note"),
    )


def _affinity(child: Column, page: Column) -> Column:
    """Leading characters that two paths share."""
    size = F.least(F.length(child), F.length(page))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), F.lit(0), lambda n, k: F.when((n == k - 1) & (k <= size) & (F.substr(child, k, F.lit(1)) == F.substr(page, k, F.lit(1))), k).otherwise(n))


def sitemap_candidates(known: DataFrame, entries: DataFrame) -> DataFrame:
    """The page's date in the first sitemap that has it, of at most MAX_FETCHES read.

    An index's children go to the front of what is still to be read, those whose
    path is most like the page's first; each read is one equality join.
    """
    stamped = build_stamped(entries).filter("stamped").select("sitemap_url")
    urls = entries.filter("kind = 'url' AND loc IS NOT NULL AND lastmod IS NOT NULL").join(stamped, "sitemap_url", "left_anti")
    urls = stage(urls.select("sitemap_url", "ord", F.col("loc").alias("link"), "lastmod", _link_path(F.col("loc")).alias("path")), "sitemap-urls")
    child = resolve_url(F.col("sitemap_url"), F.col("loc"))
    children = entries.filter("kind = 'sitemap' AND loc IS NOT NULL").filter(~F.col("loc").rlike("(?i)\\.gz(?:\\?|$)")).withColumn("child", child)
    children = children.filter(is_safe_fetch_target(F.col("child"))).groupBy("sitemap_url").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "child"))), lambda x: x["child"]).alias("children"))
    children = stage(children, "sitemap-children")
    known_paths = F.array(*(F.concat(_origin(F.col("url")), F.lit(p)) for p in SITEMAP_PATHS))
    state = known.select("page_id", "url", "canonical", "hint", normal_path(path_of(F.col("url"))).alias("path"), F.array_distinct(F.when(F.size("sitemaps") > 0, F.col("sitemaps")).otherwise(known_paths)).alias("queue"), F.array().cast("array<string>").alias("seen"), F.lit(None).cast("struct<value:string,precision:string>").alias("date"), F.lit(None).cast("string").alias("at"))
    page = F.col("path")
    for turn in range(MAX_FETCHES):
        # each turn's queues are written once: the next turn joins them twice
        state = stage(state.withColumn("sitemap_url", F.when(F.col("date").isNull(), F.get("queue", F.lit(0)))), f"sitemap-queue-{turn}")
        asked = state.filter("sitemap_url IS NOT NULL").select("page_id", "url", "canonical", "hint", "path", "sitemap_url")
        told = _matches(asked, urls, "sitemap_url").withColumn("_date", parse_date(F.col("lastmod"), F.col("hint"))).filter("_date IS NOT NULL")
        told = told.groupBy("page_id", "url").agg(F.min_by("_date", "ord").alias("_date"))
        state = state.join(told, ["page_id", "url"], "left").join(children, "sitemap_url", "left")
        seen = F.when(F.col("sitemap_url").isNotNull(), F.array_append("seen", F.col("sitemap_url"))).otherwise(F.col("seen"))
        ranked = F.transform(F.coalesce("children", F.array().cast("array<string>")), lambda c, k: F.struct((-_affinity(normal_path(path_of(c)), page)).alias("a"), k.alias("k"), c.alias("c")))
        front = F.transform(F.array_sort(ranked), lambda x: x["c"])
        queue = F.array_except(F.array_distinct(F.concat(front, F.slice("queue", 2, 1_000_000))), seen)
        state = state.select("page_id", "url", "canonical", "hint", "path", queue.alias("queue"), seen.alias("seen"), F.coalesce("date", "_date").alias("date"), F.coalesce("at", F.when(F.col("_date").isNotNull(), F.col("sitemap_url"))).alias("at"))
    name = F.concat(host_of(F.col("at")), F.lit("/"), F.element_at(F.split("at", "/"), -1))
    return state.filter("date IS NOT NULL").select(
        "page_id", "url", F.lit(SITEMAP).alias("stage"), F.lit(0).alias("seq"), F.lit(0).alias("sub"), F.col("date.value").alias("value"), F.col("date.precision").alias("precision"),
        F.lit("modified").alias("field"), F.lit("sitemap").alias("source"), F.lit("derived").alias("confidence"), F.concat(F.lit("<lastmod> in "), name).alias("note"),
    )


def last_modified(headers: Column, now: Column) -> Column:
    """Struct of value and precision from a page's response headers, or null.

    Dropped with cookies, with a Cache-Control against storing, and within five
    minutes of serving. Headers and dates are read once, and no date where
    another header settles it.
    """
    at = lambda date: let(date["value"], to_instant_ms)

    def told(low: Column) -> Column:
        get = lambda k: F.try_element_at(low, F.lit(k))
        fresh = F.coalesce(get("cache-control").rlike("(?i)(?<![A-Za-z0-9_])(?:no-store|no-cache|max-age=0)(?![A-Za-z0-9_])"), F.lit(False))
        served = lambda: F.coalesce(at(parse_date(get("date"))), F.unix_millis(now.cast("timestamp")))
        kept = lambda date: F.when(date.isNotNull() & (F.abs(at(date) - served()) >= SERVE_WINDOW_MS), date)
        return F.when(get("set-cookie").isNull() & ~fresh, let(parse_date(get("last-modified")), kept))

    return let(F.transform_keys(headers, lambda k, _: F.lower(k)), told)


def header_candidates(pages: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    # dealt for the join before headers are read, in a number of tasks that stays; a generated column, so that each is read once
    spark = documents.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    headers = documents.filter("url IS NOT NULL AND headers IS NOT NULL").select("url", "headers").repartition(tasks, "url")
    dates = headers.select("url", F.explode(F.array(last_modified(F.col("headers"), now))).alias("date")).filter("date IS NOT NULL")
    found = pages.select("page_id", "url").join(dates, "url")
    return found.select(
        "page_id", "url", F.lit(HEADERS).alias("stage"), F.lit(0).alias("seq"), F.lit(0).alias("sub"), F.col("date.value").alias("value"), F.col("date.precision").alias("precision"),
        F.lit("modified").alias("field"), F.lit("http-last-modified").alias("source"), F.lit("inferred").alias("confidence"), F.lit("Last-Modified response header").alias("note"),
    )


def side_candidates(pages: DataFrame, node_rows: DataFrame, rows: DataFrame, options, now: Column) -> DataFrame:
    """``rows`` with the candidates of feeds, of sitemaps where no update is declared, and of headers if asked for."""
    documents = options.documents
    known = stage(_known(page_links(node_rows)), "page-links")
    out = rows.unionByName(feed_candidates(known, stage(feed_entries(documents), "feed-entries")))
    if options.sitemap:
        out = stage(out, "candidates")
        declared = out.filter("field = 'modified' AND confidence = 'declared'").select("page_id").distinct()
        out = out.unionByName(sitemap_candidates(known.join(declared, "page_id", "left_anti"), stage(sitemap_entries(documents), "sitemap-entries")))
    if options.http_headers:
        out = out.unionByName(header_candidates(pages, documents, now))
    return out
