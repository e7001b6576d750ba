"""Signal extractors: node rows to candidates, as one plan of Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import months
from ..functions.dates import date_value, detect_day_first, precision_of, prepared
from ..functions.labels import folded_field, pattern
from ..functions.text import collapse, fold, trim
from ..functions.urls import image_path_day, url_slug
from ..sources.html import DATE_BLOCK_MARKERS, MAYBE_DATE, MODIFICATION_MARKERS, PUBLICATION_MARKERS, TITLED_TAGS, nodes
from ..types import MODES, at_least

#: Places of the extractors in a page's list of candidates.
JSONLD, META, TIME, SLUG, IMAGE, INLINE, VISIBLE, BARE, SCAN, FEED, SITEMAP, HEADERS = range(12)

# Meta keys by source, tier and field.
META_KEYS = [
    ("opengraph", "declared", "published", "article:published_time og:published_time og:article:published_time"),
    ("opengraph", "declared", "modified", "article:modified_time og:updated_time og:modified_time og:article:modified_time"),
    ("itemprop", "declared", "published", "datepublished"),
    ("itemprop", "declared", "modified", "datemodified"),
    ("dublin-core", "derived", "published", "dc.date.issued dcterms.issued dc.date.created dc.date.publication dc.created dc:created dcterms.created"),
    ("dublin-core", "derived", "modified", "dc.date.modified dcterms.modified dc.modified"),
    ("dublin-core", "derived", "unknown", "dc.date dc:date dcterms.date"),
    ("citation", "derived", "published", "citation_publication_date citation_date"),
    ("parsely", "derived", "published", "parsely-pub-date"),
    ("sailthru", "derived", "published", "sailthru.date"),
    ("meta-date", "derived", "unknown", "date"),
    (
        "meta-date",
        "derived",
        "published",
        "pubdate publishdate publisheddate publication_date publish-date publish_date publish_time published-date published_date published_time date_published date_created datecreated "
        "dateposted article.created article.published article_date_original content_create_date originalpublicationdate displaydate doc_date field-name-post-date gentime release_date rbpubdate pdate ptime",
    ),
    ("meta-date", "derived", "modified", "last-modified lastmod lastmodified lastdate modified modified_time modificationdate updated_time revision_date utime"),
]
# vendors' keys with a colon, the modified ones first.
VENDOR_MODIFIED = "(?i)(?:^|[:._-])(modified|modified_?at|modified_?(?:date|time)|moddate|modificationdate|date_?modified|updated|updated_?at|updated_?(?:date|time)|revision_?date|lastmod)$"
VENDOR_PUBLISHED = (
    "(?i)(?:^|[:._-])(published?|publication|published_?at|publish(?:ed)?_?(?:date|time)|publishtime|date_?published|uploaded|upload_?date|created_?at|release_?date|pubdate|date)$"
)
IMAGE_KEYS = ("og:image", "og:image:url", "og:image:secure_url", "twitter:image", "twitter:image:src")
# Keys of dates in inline scripts.
INLINE_KEYS = [
    ("^post_?date(_?gmt)?$", "published", "wordpress"),
    ("^post_?modified(_?gmt)?$", "modified", "wordpress"),
    ("^date_?gmt$", "published", "wordpress"),
    ("^modified_?gmt$", "modified", "wordpress"),
    ("^(date_?published|published_?date|published_?at|publish_?date|first_?published_?at)$", "published", "inline-state"),
    ("^(date_?modified|modified_?date|modified_?at|updated_?at)$", "modified", "inline-state"),
]
# Text that holds digits but no date; what may stand between a label and its date.
NOT_A_DATE = (
    "^\\d{1,2}:\\d{2}(?:[ :]|$)|(?=[0-9+A-Zfhsv$€¥£¢₽₱฿₹#®™])(?:[$€¥£¢₽₱฿₹#]|(?<![A-Za-z0-9_])[A-Z]{3}\\d|(?<!\\d)(?:\\+\\d{2}|\\d{5,})\\D|(?<![A-Za-z0-9_])(?:ftps?|https?|sftp)://"
    "|(?<![A-Za-z0-9_])IBAN(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])[A-Z]{2}\\d{2}[A-Z0-9]{10,}|(?<![A-Za-z0-9_])v\\d+\\.\\d+(?:\\.\\d+)?(?![A-Za-z0-9_])"
    "|(?<![A-Za-z0-9_])\\d+\\.\\d+\\.\\d+\\.\\d+(?![A-Za-z0-9_])|®|™)"
)
GAP = "[\\s:：、,，—–\\-]{0,4}(?:on|il|am|le|el|em|op|the|v|dnia)?[\\s:：、,，—–\\-]{0,4}"
TRAILING_GAP = "[^<>]{0,48}?"
PADDING = (
    "(?<![a-z0-9_])(montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag|monday|tuesday|wednesday|thursday|friday|saturday|sunday|lunedi|martedi|mercoledi|giovedi|venerdi|sabato|domenica"
    "|lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche)(?![a-z0-9_])|(?<![a-z0-9_])\\d{1,2}[:.]\\d{2}\\s*(uhr|am|pm|h)?(?![a-z0-9_])|(?<![a-z0-9_])um(?![a-z0-9_])|(?<![a-z0-9_])bis(?![a-z0-9_])"
)
VISIBLE_CHARS, BARE_CHARS, SCAN_CHARS, SHORT_CHARS, DATE_RATIO, BARE_MOST, TIME_RUN = 600, 120, 400, 32, 0.45, 6, 5

RAW = "array<struct<stage:int,sub:int,raw:string,field:string,source:string,confidence:string,note:string>>"


def _raw(stage: int, sub, raw: Column, field, source, confidence, note) -> Column:
    lit = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    sub = F.lit(sub) if isinstance(sub, int) else sub
    return F.struct(
        F.lit(stage).alias("stage"), sub.alias("sub"), raw.alias("raw"), lit(field).alias("field"), lit(source).alias("source"), lit(confidence).alias("confidence"), lit(note).alias("note"),
    )


def meta_rule(key: Column) -> Column:
    """Struct of source, confidence and field for a meta element's key, or null."""
    rule = lambda s, c, f: F.struct(F.lit(s).alias("source"), F.lit(c).alias("confidence"), F.lit(f).alias("field"))
    out = None
    for source, tier, field, keys in META_KEYS:
        test = key.isin(*keys.split())
        out = F.when(test, rule(source, tier, field)) if out is None else out.when(test, rule(source, tier, field))
    vendor = F.contains(key, F.lit(":"))
    return out.when(vendor & key.rlike(VENDOR_MODIFIED), rule("meta-date", "derived", "modified")).when(vendor & key.rlike(VENDOR_PUBLISHED), rule("meta-date", "derived", "published"))


def inline_rule(key: Column) -> Column:
    """Struct of field and source for a key in an inline script, or null."""
    out = None
    for test, field, source in INLINE_KEYS:
        rule = F.struct(F.lit(field).alias("field"), F.lit(source).alias("source"))
        out = F.when(key.rlike("(?i)" + test), rule) if out is None else out.when(key.rlike("(?i)" + test), rule)
    return out


def _time_rows() -> Column:
    near = F.col("near_field")
    field = (
        F.when(F.col("key") == "datemodified", "modified")
        .when(F.col("key") == "datepublished", "published")
        .when(near != "unknown", near)
        .when(F.col("flag") | F.coalesce(F.col("marker").isin(*PUBLICATION_MARKERS), F.lit(False)), "published")
        .otherwise("unknown")
    )
    note = F.when(F.col("apart"), F.concat(F.lit('<time> text is labelled a publication date, disagreeing with its datetime="'), F.left("attr", F.lit(10)), F.lit('"')))
    note = note.when(F.col("strong"), "<time> in byline markup").otherwise("<time> in article context")
    return F.array(_raw(TIME, 0, F.when(F.col("apart"), F.col("own")).otherwise(F.coalesce("attr", "own")), field, "time-tag", "derived", note))


def _time_columns(n: DataFrame) -> DataFrame:
    """attr and own (its two date strings), near_field and apart: its text is a published date other than its attribute's."""
    is_time, blank = F.col("kind") == "time", F.lit("")
    n = n.withColumns(
        {
            "attr": F.when(is_time, F.nullif(trim(F.col("raw")), blank)),
            "own": F.when(is_time, F.nullif(trim(F.col("text")), blank)),
            "near_folded": F.when(is_time, fold(F.col("near"))),
        }
    )
    n = n.withColumns({"near_field": F.when(is_time, folded_field(F.col("near_folded"))), "own_folded": fold(F.col("own"))})
    day = lambda c: F.left(date_value(prepared(F.col(c)), F.col("hint")), F.lit(10))
    published = F.when(F.col("key") == "datemodified", False).when(F.col("key") == "datepublished", True).when(F.col("near_field") == "modified", False)
    published = published.when((F.col("near_field") == "published") | F.col("flag") | F.coalesce(F.col("marker").isin(*PUBLICATION_MARKERS), F.lit(False)), True).otherwise(False)
    apart = F.when(is_time & published & (folded_field(F.col("own_folded")) == "published"), day("attr") != day("own"))
    return n.withColumn("apart", F.coalesce(apart, F.lit(False)))


def _text_columns(n: DataFrame) -> DataFrame:
    """What the text extractors need, each worked out once: first dates and labelled dates of texts that may hold any.

    ``date`` is the first date of the text and ``bare_date`` that of the short
    text (an element's title where that holds a date); the four label columns
    hold a label with its date, before or after it.
    """
    body, text = months.date_body(), F.col("kind") == "text"
    n = n.withColumn("plain", F.when(text, collapse(F.col("text"))))
    n = n.withColumn("folded", fold(F.col("plain")))
    n = n.withColumn("near_digits", months.near_digits(F.col("folded")))
    maybe = text & F.col("text").rlike(MAYBE_DATE.pattern)
    titled = text & F.col("title").rlike(MAYBE_DATE.pattern)
    n = _found(n, {"date": (maybe, "near_digits", body), "title_date": (titled, "title", f"(?iu){body}")})
    # where neither the text nor the title holds a date, nothing more is asked
    usable = F.coalesce(F.col("date").isNotNull() | F.col("title_date").isNotNull(), F.lit(False)) & maybe & ~F.col("text").rlike(NOT_A_DATE)
    n = n.withColumn("usable", usable).withColumn("date", F.when(F.col("usable"), F.col("date")))
    instead = F.col("title_date").isNotNull() & F.col("tag").isin(*TITLED_TAGS)
    n = n.withColumn("instead", F.coalesce(instead, F.lit(False)))
    n = n.withColumn("flat", F.when(F.col("instead"), collapse(F.col("title"))).otherwise(F.col("plain")))
    n = n.withColumn("bare_text", F.when(F.col("instead"), fold(F.col("flat"))).otherwise(F.col("folded")))
    fit = F.when(F.col("instead"), ~F.col("title").rlike(NOT_A_DATE)).otherwise(F.col("usable")) & (F.length("flat") <= BARE_CHARS) & ~F.col("borrowed")
    visible = F.col("date").isNotNull() & (F.length("plain") <= VISIBLE_CHARS) & ~F.col("borrowed")
    n = n.withColumns({"fit": fit, "visible": F.coalesce(visible, F.lit(False))})
    n = _found(n, {"bare_date": (F.col("fit") & F.col("instead"), "bare_text", body), **{k: (F.col("visible") & F.col("strong") if trails else F.col("visible"), "folded", p) for k, _, p, trails in _labels()}})
    return n.withColumn("bare_date", F.when(F.col("instead"), F.col("bare_date")).otherwise(F.when(F.col("fit"), F.col("date"))))


def _found(n: DataFrame, wanted: dict[str, tuple[Column, str, str]]) -> DataFrame:
    """By name: the first match of a pattern in a column where the condition holds, else null."""
    n = n.withColumns({k: F.when(ok, F.regexp_extract(c, p, 0)) for k, (ok, c, p) in wanted.items()})
    return n.withColumns({k: F.nullif(F.col(k), F.lit("")) for k in wanted})


def _labels() -> list[tuple[str, str, str, bool]]:
    """Column, field and pattern of labelled dates, and whether the label trails."""
    body = months.date_body()
    before = [(f"{k}_before", k, f"(?:{pattern(k)}){GAP}({body})", False) for k in ("modified", "published")]
    return before + [(f"{k}_after", k, f"({body}){TRAILING_GAP}(?:{pattern(k)})", True) for k in ("modified", "published")]


def _text_rows(mode: str) -> Column:
    marker, strong = F.col("marker"), F.col("strong")
    in_block = F.coalesce(marker.isin(*DATE_BLOCK_MARKERS), F.lit(False))
    labelled = F.col("modified_before").isNotNull() | F.col("published_before").isNotNull()
    may_mark = F.col("usable") & (F.length("plain") <= VISIBLE_CHARS) & ~F.col("borrowed") & in_block & ~labelled
    ours = F.when(marker.isin(*MODIFICATION_MARKERS), "modified").when(marker.isin(*PUBLICATION_MARKERS), "published").otherwise("unknown")
    rows = [_raw(VISIBLE, 0, F.when(may_mark, F.coalesce("date", "title_date")), ours, "marked-date", "derived", F.concat(F.lit('date in markup marked "'), marker, F.lit('"')))]
    for sub, (name, field, p, _) in enumerate(_labels(), 1):
        said = F.concat(F.lit('text: "'), F.left(F.trim(name), F.lit(60)), F.lit('"'))
        rows.append(_raw(VISIBLE, sub, F.when(F.col(name).isNotNull(), F.regexp_extract(name, p, 1)), field, "visible-text", "inferred", said))

    # unlabelled: the title of a small element that holds a date stands for its text
    date, bare_text = F.col("bare_date"), F.col("bare_text")
    byline = strong & ~F.coalesce(marker == "footer", F.lit(False))
    measured = F.greatest(F.lit(1), F.length(F.trim(F.regexp_replace(F.regexp_replace(bare_text, PADDING, ""), "\\s+", " "))))
    enough = byline | (F.length(bare_text) <= SHORT_CHARS) | (F.length(date) / measured >= DATE_RATIO)
    where = F.when(byline, "unlabelled date in byline markup: ").otherwise("unlabelled date in text: ")
    rows.append(_raw(BARE, 0, F.when(date.isNotNull() & enough, date), "unknown", "text-date", "inferred", F.concat(where, F.lit('"'), F.trim(date), F.lit('"'))))
    if mode != "extensive":
        return F.array(*rows)
    every = F.transform(F.regexp_extract_all("near_digits", F.lit(months.date_body()), F.lit(0)), lambda d, k: _raw(SCAN, k.cast("int"), d, "unknown", "page-scan", "inferred", None))
    return F.concat(F.array(*rows).cast(RAW), F.when(F.col("date").isNotNull() & (F.length("plain") <= SCAN_CHARS), every).otherwise(F.array().cast(RAW)))


def raw_candidates(page_nodes: DataFrame, mode: str = "standard", day_first: str | None = None) -> DataFrame:
    """Rows of date strings with what they would mean, before they are parsed and gated.

    Values used more than once are columns of their own, so that they stay in
    generated code and no expression is repeated.
    """
    hint = F.lit(day_first) if day_first else detect_day_first(F.col("lang"), F.col("host"))
    kind, key, content = F.col("kind"), F.col("key"), F.col("flag")
    n = page_nodes.withColumns(
        {"hint": hint, "rule": F.when(kind == "meta", meta_rule(key)), "script": F.when(kind == "inline", inline_rule(key)), "slug": F.when(kind == "page", url_slug(F.col("url")))}
    )
    n = _time_columns(n)
    if mode != "fast":
        n = _text_columns(n)
    ld_field = F.when(key == "dateModified", "modified").otherwise("published")
    ld_note = F.concat(F.lit("schema.org "), key, F.lit(" on "), F.col("text"), F.when(content, "").otherwise(" (container type)"))
    ld = F.array(_raw(JSONLD, F.col("sub"), F.col("raw"), ld_field, F.when(content, "jsonld").otherwise("jsonld-container"), "declared", ld_note))
    rule, named = F.col("rule"), F.concat(F.lit("<meta> "), key)
    image = F.when(key.isin(*IMAGE_KEYS), image_path_day(F.col("text")))
    meta = F.array(
        _raw(META, 0, F.when(rule.isNotNull(), trim(F.col("raw"))), rule["field"], rule["source"], rule["confidence"], named),
        _raw(IMAGE, 0, image, "published", "image-path", "inferred", F.concat(F.lit("upload path of "), named)),
    )
    script, slug = F.col("script"), F.col("slug")
    inline = F.array(_raw(INLINE, F.col("sub"), F.when(script.isNotNull(), F.col("raw")), script["field"], script["source"], "derived", F.concat(F.lit("inline script "), key)))
    # a page without candidates keeps a row of its own, with nothing in it
    own = F.struct(*(F.lit(None).alias(k) for k in ("stage", "sub", "raw", "field", "source", "confidence", "note")))
    page = F.array(_raw(SLUG, 0, slug["value"], "published", "url-slug", "inferred", slug["note"]), own)
    found = F.when(kind == "jsonld", ld.cast(RAW)).when(kind == "meta", meta.cast(RAW)).when(kind == "time", _time_rows().cast(RAW)).when(kind == "page", page.cast(RAW))
    if mode != "fast":
        found = found.when(kind == "inline", inline.cast(RAW)).when(kind == "text", _text_rows(mode).cast(RAW))
    rows = n.select("page_id", "url", "seq", "hint", F.inline(F.coalesce(found, F.array().cast(RAW))))
    return rows.filter("stage IS NULL OR (raw IS NOT NULL AND raw <> '')")


def extract(pages: DataFrame, mode: str = "standard", day_first: str | None = None, min_confidence: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", node_rows: DataFrame | None = None) -> DataFrame:
    """Candidate rows of every page, with ``stage``, ``seq`` and ``sub`` for their order.

    Each page also has one row with a null value, so none is lost. The nodes that
    can hold a date are shuffled once, by page, and everything after keeps to
    that; the html never is shuffled. Modes: fast reads metadata, the
    URL and times; standard adds scripts and text, unlabelled dates only where
    nothing is labelled; extensive always adds those and, where nothing at all
    is found, the date the page shows most often. ``node_rows`` are the pages' own,
    where they have been read already.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    read = node_rows if node_rows is not None else nodes(pages, mode != "fast", id_col, url_col, html_col)
    found = read.filter("kind <> 'link'").repartition("page_id")
    raw = raw_candidates(found, mode, day_first)
    # a generated column: the filter below stays above it, so each string is parsed once
    ready = raw.withColumn("raw", prepared(F.col("raw")))
    parsed = ready.select("*", F.explode(F.array(date_value(F.col("raw"), F.col("hint")))).alias("value"))
    rows = parsed.filter(F.col("stage").isNull() | F.col("value").isNotNull())
    rows = rows.select("page_id", "url", "stage", "seq", "sub", "value", precision_of(F.col("value")).alias("precision"), "field", "source", "confidence", "note")

    page, stage = Window.partitionBy("page_id", "url"), F.col("stage")
    by = lambda *cols: Window.partitionBy("page_id", "url", "stage", *cols).orderBy("seq", "sub")
    if mode != "fast":
        rows = _distinct_texts(rows, by)
    nth = F.row_number().over(by())
    rows = rows.withColumn("_nth", nth).filter(stage.isNull() | ((stage != BARE) | (F.col("_nth") <= BARE_MOST)) & ((stage != IMAGE) | (F.col("_nth") == 1)))

    unlabelled = F.sum(((stage == TIME) & (F.col("field") == "unknown")).cast("int")).over(page)
    listing = (stage == TIME) & (F.col("field") == "unknown") & (unlabelled > TIME_RUN)
    run = F.concat(F.lit("<time> in a run of "), unlabelled.cast("string"), F.lit(" unlabelled ones — a listing, not this page's date"))
    rows = rows.withColumns({"confidence": F.when(listing, "inferred").otherwise(F.col("confidence")), "note": F.when(listing, run).otherwise(F.col("note"))})
    if mode == "standard":
        told = F.max(F.coalesce((stage < BARE) & (F.col("field") != "unknown"), F.lit(False))).over(page)
        rows = rows.withColumn("_told", told).filter(stage.isNull() | (stage != BARE) | ~F.col("_told"))
    if mode == "extensive":
        rows = _most_frequent(rows, page)
    if min_confidence:
        rows = rows.filter(F.col("value").isNull() | at_least(F.col("confidence"), min_confidence))
    return rows.select("page_id", "url", "stage", "seq", "sub", "value", "precision", "field", "source", "confidence", "note")


def _distinct_texts(rows: DataFrame, by) -> DataFrame:
    """One row to a value and field of scripts and of either kind of text.

    A marked date speaks for its element: labels after dates there are dropped,
    unless the marked date only repeats an earlier one.
    """
    stage, marked = F.col("stage"), (F.col("stage") == VISIBLE) & (F.col("sub") == 0)
    element = Window.partitionBy("page_id", "url", "stage", "seq")
    rows = rows.withColumn("_after", F.coalesce(F.max(marked).over(element) & ~marked, F.lit(False)))
    rows = rows.withColumn("_first", F.row_number().over(by("field", "value", "_after")))
    rows = rows.withColumn("_emitted", F.max(marked & (F.col("_first") == 1)).over(element)).filter(stage.isNull() | (stage != VISIBLE) | ~F.col("_after") | ~F.col("_emitted"))
    rows = rows.withColumn("_once", F.row_number().over(by("field", "value")))
    return rows.filter(stage.isNull() | ~stage.isin(INLINE, VISIBLE, BARE) | (F.col("_once") == 1)).drop("_after", "_first", "_emitted", "_once")


def _most_frequent(rows: DataFrame, page) -> DataFrame:
    """Of the page scan's dates the most frequent (ties: the least), where a page has nothing else."""
    stage = F.col("stage")
    other = F.max(F.coalesce(stage < SCAN, F.lit(False))).over(page)
    value = Window.partitionBy("page_id", "url", "stage", "value")
    rows = rows.withColumns({"_other": other, "_n": F.count("*").over(value), "_k": F.row_number().over(value.orderBy("seq", "sub"))})
    rows = rows.filter(stage.isNull() | (stage != SCAN) | (~F.col("_other") & (F.col("_k") == 1)))
    place = F.row_number().over(Window.partitionBy("page_id", "url", "stage").orderBy(F.desc("_n"), "value"))
    kinds = F.count("*").over(Window.partitionBy("page_id", "url", "stage"))
    often = F.concat(F.lit("the date this page renders most often ("), F.col("_n").cast("string"), F.lit("×, of "), kinds.cast("string"), F.lit(" distinct)"))
    note = F.when(stage == SCAN, F.when(kinds == 1, "the only date rendered anywhere on the page").otherwise(often)).otherwise(F.col("note"))
    rows = rows.withColumns({"note": note, "_place": place})
    return rows.filter(stage.isNull() | (stage != SCAN) | (F.col("_place") == 1))
