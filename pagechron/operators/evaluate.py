"""The evaluation suite: labels, splits, judging, tallies, calibration, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import days_in
from ..functions.text import let
from ..functions.urls import host_of, path_of, split_of
from ..sources.scratch import stage
from ..types import choose, rank_candidate

# Paths that label nothing, and how late a capture may be.
PAGINATION = "(?i)/(page|comment-page)/\\d+/?$"
FEED_LIKE = "(?i)/(feed|rss|atom|amp|print|comments|trackback|embed|attachment)/?$"
NOT_A_SLUG = "(?i)^(index|page|all|archive|amp)(\\.\\w+)?$"
MAX_PATH, MAX_LAG = 240, 30
# Classes of sources that fail independently of each other.
SOURCE_CLASS = {
    "jsonld": "cms", "opengraph": "cms", "itemprop": "cms", "dublin-core": "cms", "sailthru": "cms", "parsely": "cms", "meta-date": "cms", "citation": "cms", "wordpress": "cms", "feed": "cms",
    "url-slug": "url", "image-path": "url", "visible-text": "text", "marked-date": "text", "text-date": "text", "time-tag": "text", "http-last-modified": "server", "sitemap": "server",
}
# Languages of country domains.
TLD_LANG = {
    "de": "de", "at": "de", "ch": "de", "fr": "fr", "it": "it", "es": "es", "nl": "nl", "pl": "pl", "pt": "pt", "br": "pt",
    "dk": "da", "se": "sv", "no": "no", "fi": "fi", "cz": "cs", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko",
}


def _real(y: Column, m: Column, d: Column, last_year: Column) -> Column:
    return y.between(1995, last_year) & m.between(1, 12) & (d >= 1) & (d <= days_in(y, m))


def permalink_label(url: Column, allow_month: bool = False, last_year: Column | None = None) -> Column:
    """Struct of published, precision and evidence that a permalink itself states, or null."""
    last = last_year if last_year is not None else F.year(F.current_date())
    path = path_of(url)
    clean = ~F.contains(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?")) & ~path.rlike("[<>\"'&]|%25|%22") & (F.length(path) <= MAX_PATH) & ~path.rlike(PAGINATION) & ~path.rlike(FEED_LIKE)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    slug_ok = lambda s: s.isNotNull() & ~s.rlike(NOT_A_SLUG) & ~s.rlike("^\\d+$")
    label = lambda v, p, e: F.struct(v.alias("published"), F.lit(p).alias("precision"), e.alias("evidence"))

    def read(parts: Column) -> Column:
        part = lambda k: F.get(parts, k)
        num = lambda x: x.try_cast("int")
        at = F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0)))
        shape = lambda k: part(k).rlike("^\\d{4}$") & part(k + 1).rlike("^\\d{1,2}$")

        def day(k: Column) -> Column:
            y, m, d = num(part(k)), num(part(k + 1)), num(part(k + 2))
            ok = shape(k) & part(k + 2).rlike("^\\d{1,2}$") & _real(y, m, d, last) & slug_ok(part(k + 3))
            return F.when(ok, label(F.concat_ws("-", part(k), two(m), two(d)), "day", F.concat(F.lit("/"), F.concat_ws("/", part(k), part(k + 1), part(k + 2), part(k + 3)))))

        def joined(k: Column) -> Column:
            p = "^(\\d{4})-(\\d{2})-(\\d{2})([-_.].+)?$"
            y, m, d = (num(F.regexp_extract(part(k), p, n)) for n in (1, 2, 3))
            alone = (F.regexp_extract(part(k), p, 4) == "") & (k == F.size(parts) - 1)
            ok = part(k).rlike(p) & _real(y, m, d, last) & ~alone
            return F.when(ok, label(F.left(part(k), F.lit(10)), "day", F.concat(F.lit("/"), part(k))))

        def month(k: Column) -> Column:
            y, m = num(part(k)), num(part(k + 1))
            ok = shape(k) & _real(y, m, F.lit(1), last) & slug_ok(part(k + 2))
            return F.when(ok, label(F.concat_ws("-", part(k), two(m)), "month", F.concat(F.lit("/"), F.concat_ws("/", part(k), part(k + 1), part(k + 2)))))

        first = lambda f: F.get(F.filter(F.transform(at, f), lambda x: x.isNotNull()), F.lit(0))
        found = [first(day), first(joined)] + ([first(month)] if allow_month else [])
        return F.coalesce(*found)

    return F.when(clean, let(F.filter(F.split(path, "/"), lambda s: s != ""), read))


def snapshot_day(snapshot: Column) -> Column:
    return F.concat_ws("-", F.substring(snapshot, 1, 4), F.substring(snapshot, 5, 2), F.substring(snapshot, 7, 2))


def label_precedes_capture(published: Column, snapshot: Column) -> Column:
    """Is the label, one day of slack allowed, not after its capture?"""
    return F.date_format(F.date_sub(F.rpad(published, 10, "-01").try_cast("date"), 1), "yyyy-MM-dd") <= snapshot_day(snapshot)


def capture_lag_days(published: Column, snapshot: Column) -> Column:
    return F.datediff(snapshot_day(snapshot).try_cast("date"), F.rpad(published, 10, "-01").try_cast("date")).cast("bigint")


def lag_bucket(days: Column) -> Column:
    return F.when(days <= 1, "lag 0-1d").when(days <= 7, "lag 2-7d").when(days <= 30, "lag 8-30d").when(days <= 365, "lag 31-365d").otherwise("lag >1y")


def scored_entries(entries: DataFrame, split: str = "dev", max_lag: int = MAX_LAG, answerable_only: bool = True) -> DataFrame:
    """Entries (fetched, published, host, capture_lag_days, label_in_page) that a score counts."""
    rows = entries.filter("fetched AND published IS NOT NULL").filter(F.col("capture_lag_days") <= max_lag)
    if split != "all":
        rows = rows.filter(split_of(F.col("host")) == split)
    return rows.filter(F.coalesce("label_in_page", F.lit(True))) if answerable_only else rows


def judge(label: Column, found: Column, tolerance_days: int = 0) -> Column:
    """exact, partial (right but coarser), wrong or missed, by what both state."""
    width = F.least(F.length(label), F.length(found))
    same = F.left(label, width) == F.left(found, width)
    near = (F.length(label) == 10) & (F.length(found) >= 10) & (F.abs(F.datediff(F.left(found, F.lit(10)).try_cast("date"), label.try_cast("date"))) <= tolerance_days) if tolerance_days else F.lit(False)
    return (
        F.when(found.isNull(), "missed")
        .when(~same, F.when(F.coalesce(near, F.lit(False)), "exact").otherwise("wrong"))
        .when(F.length(found) >= F.length(label), "exact")
        .otherwise("partial")
    )


def _tallies() -> list[Column]:
    n = {k: F.count_if(F.col("verdict") == k).cast("bigint") for k in ("exact", "partial", "wrong", "missed")}
    answered, total = n["exact"] + n["partial"] + n["wrong"], F.count("*").cast("bigint")
    return [total.alias("n"), *(v.alias(k) for k, v in n.items()), F.try_divide(n["exact"], answered).alias("precision"), F.try_divide(n["exact"], total).alias("accuracy")]


def tally(judged: DataFrame, *keys: str) -> DataFrame:
    """Verdicts counted, with precision and accuracy, by the given columns."""
    return judged.groupBy(*keys).agg(*_tallies())


def strata(judged: DataFrame, keys: list[str]) -> DataFrame:
    """One pass for the whole and for each stratum: GROUPING SETS ((), (k1), (k2), ...)."""
    sets = [[], *([F.col(k)] for k in keys)]
    which = F.coalesce(*(F.when(F.grouping(k) == 0, F.lit(k)) for k in keys), F.lit("overall"))
    name = F.coalesce(*(F.when(F.grouping(k) == 0, F.coalesce(F.col(k).cast("string"), F.lit("unknown"))) for k in keys), F.lit("all"))
    out = judged.groupingSets(sets, *(F.col(k) for k in keys)).agg(which.alias("stratum"), name.alias("name"), *_tallies())
    return out.drop(*keys)


def worst_hosts(judged: DataFrame, most: int = 15) -> DataFrame:
    bad = F.count_if(F.col("verdict").isin("wrong", "missed")).cast("bigint")
    return judged.groupBy("host").agg(bad.alias("bad"), F.count("*").alias("n")).filter("bad > 0").orderBy(F.desc("bad"), "host").limit(most)


def winners(judged: DataFrame) -> DataFrame:
    """Exact answers by their source."""
    return judged.filter("verdict = 'exact'").groupBy("source").agg(F.count("*").alias("n"))


def strict_lenient(judged: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall, accuracy and F1 with a coarser right answer as wrong, and as right."""
    base = judged.groupBy(*keys).agg(*(F.count_if(F.col("verdict") == k).alias(k) for k in ("exact", "partial", "wrong", "missed")))

    def rates(name: str, hits: Column, misses: Column) -> list[Column]:
        p, r = F.coalesce(F.try_divide(hits, hits + misses), F.lit(0.0)), F.coalesce(F.try_divide(hits, hits + F.col("missed")), F.lit(0.0))
        a = F.coalesce(F.try_divide(hits, hits + misses + F.col("missed")), F.lit(0.0))
        return [p.alias(f"{name}_precision"), r.alias(f"{name}_recall"), a.alias(f"{name}_accuracy"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias(f"{name}_f1")]

    return base.select(*keys, *rates("strict", F.col("exact"), F.col("wrong") + F.col("partial")), *rates("lenient", F.col("exact") + F.col("partial"), F.col("wrong")))


def outcome(expected: Column, actual: Column) -> Column:
    """tp, fp, fn or tn of one field."""
    return F.when(expected.isNull(), F.when(actual.isNull(), "tn").otherwise("fp")).when(actual.isNull(), "fn").when(actual == expected, "tp").otherwise("fp")


def outcome_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts and rates of outcomes, true negatives included."""
    n = {k: F.count_if(F.col("outcome") == k).cast("bigint") for k in ("tp", "fp", "fn", "tn")}
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = rate(n["tp"], n["tp"] + n["fp"]), rate(n["tp"], n["tp"] + n["fn"])
    return rows.groupBy(*keys).agg(*(v.alias(k) for k, v in n.items()), p.alias("precision"), r.alias("recall"), rate(n["tp"] + n["tn"], F.count("*")).alias("accuracy"), rate(2 * p * r, p + r).alias("f1"))


def calibration(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Per tier: of the pages' top candidates in each field, how many are right.

    candidates: page_id, seq and a candidate's columns; truth: page_id, published, modified (days or null).
    """
    rank = rank_candidate(F.col("confidence"), F.col("source"), F.col("precision"))
    first = F.row_number().over(Window.partitionBy("page_id", "confidence", "field").orderBy(F.desc("_rank"), "seq"))
    top = candidates.filter("field != 'unknown'").withColumn("_rank", rank).withColumn("_first", first).filter("_first = 1")
    known = truth.select("page_id", F.expr("stack(2, 'published', published, 'modified', modified) AS (field, truth)")).filter("truth IS NOT NULL")
    return top.join(known, ["page_id", "field"]).groupBy("confidence").agg(F.count_if(F.left(F.col("value"), F.lit(10)) == F.col("truth")).cast("bigint").alias("correct"), F.count("*").alias("total"))


def agreement(candidates: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per page: sources, and independent classes of them, that give the winner's day.

    candidates: page_id, value, field, source; resolved: page_id, value (the winner's), label.
    """
    day = F.left(F.col("value"), F.lit(10))
    won = resolved.select("page_id", day.alias("day"), "label")
    rows = candidates.filter("field != 'modified'").withColumn("day", day).join(won, ["page_id", "day"])
    kind = F.coalesce(choose(F.col("source"), SOURCE_CLASS), F.lit("other"))
    return rows.groupBy("page_id").agg(F.count_distinct("source").alias("sources"), F.count_distinct(kind).alias("classes"), F.first(F.col("day") == F.col("label")).alias("right"))


def agreement_table(pages: DataFrame, by: str) -> DataFrame:
    right = F.count_if(F.col("right")).cast("bigint")
    return pages.groupBy(F.col(by).cast("bigint").alias(by)).agg(F.count("*").alias("n"), right.alias("right"), (right / F.count("*")).alias("accuracy"))


def corrected(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """Rows (file, gold, ...) held against corrected answers; a null correction makes any answer wrong."""
    fixes = corrections.select("file", F.col("corrected").alias("_fix"), F.lit(True).alias("_has"))
    joined = rows.join(fixes, "file", "left")
    gold = F.when(F.col("_has"), F.col("_fix")).otherwise(F.col("gold"))
    verdict = F.when(F.col("_has") & F.col("_fix").isNull(), F.when(F.col("found").isNull(), "exact").otherwise("wrong")).otherwise(judge(gold, F.col("found")))
    return joined.withColumn("verdict", verdict).withColumn("gold", gold).drop("_fix", "_has")


def leaderboard(rows: DataFrame) -> DataFrame:
    """Tools by exact answers; mean and median time a page. rows: tool, file, gold, found, ms."""
    judged = rows.withColumn("verdict", judge(F.col("gold"), F.col("found"))) if "verdict" not in rows.columns else rows
    return judged.groupBy("tool").agg(*_tallies(), F.avg("ms").alias("ms_per_page"), F.median("ms").alias("median_ms")).orderBy(F.desc("exact"), "tool")


def head_to_head(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pages that only one of two tools, both or neither gets exactly right."""
    right = judge(F.col("gold"), F.col("found")) == "exact"
    side = lambda tool: rows.filter(F.col("tool") == tool).select("file", right.alias(f"{tool}_right"))
    both = side(a).join(side(b), "file", "full")
    x, y = (F.coalesce(F.col(f"{t}_right"), F.lit(False)) for t in (a, b))
    return both.agg(*(F.count_if(c).cast("bigint").alias(k) for k, c in (("both", x & y), ("only_first", x & ~y), ("only_second", ~x & y), ("neither", ~x & ~y))))


def disagreements(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pages where two tools differ, by whose answer the gold date is."""
    side = lambda tool: rows.filter(F.col("tool") == tool).select("file", "gold", F.col("found").alias(f"{tool}_found"))
    both = side(a).join(side(b).drop("gold"), "file").filter(~F.col(f"{a}_found").eqNullSafe(F.col(f"{b}_found")))
    is_gold = lambda tool: F.coalesce(F.left(F.col(f"{tool}_found"), F.lit(10)) == F.col("gold"), F.lit(False))
    return both.withColumn("bucket", F.when(is_gold(a), a).when(is_gold(b), b).otherwise("neither"))


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Same answer, different answer, different number of candidates, of (page_id, published, modified, n)."""
    rows = a.alias("a").join(b.alias("b"), "page_id", "full")
    same = F.col("a.published").eqNullSafe(F.col("b.published")) & F.col("a.modified").eqNullSafe(F.col("b.modified"))
    count = F.col("a.n").eqNullSafe(F.col("b.n"))
    return rows.agg(F.count_if(same & count).cast("bigint").alias("same"), F.count_if(~same).cast("bigint").alias("different_answer"), F.count_if(same & ~count).cast("bigint").alias("different_candidates"))


def triage(gold: Column, chosen: Column, values: Column) -> Column:
    """right, or why not: ranking (found but lost), wrong, missing."""
    has = F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.left(v, F.lit(10)) == gold)
    return F.when(F.left(chosen, F.lit(10)) == gold, "right").when(has, "ranking").when(chosen.isNotNull(), "wrong").otherwise("missing")


def split_gap(judged: DataFrame) -> DataFrame:
    """Accuracy of both splits and their difference."""
    hit = (F.col("verdict") == "exact").cast("double")
    side = lambda s: F.avg(F.when(split_of(F.col("host")) == s, hit))
    return judged.agg(side("dev").alias("dev"), side("test").alias("test"), (side("dev") - side("test")).alias("gap"))


def stride(rows: DataFrame, order: str, want: int, phase: float = 0.0, key: str | None = None) -> DataFrame:
    """Every n-th row of each key in order, ``want`` in all: a sampling operator.

    Without a key, rows are ranked in ranges of the order, each range by itself,
    beginning where the ranges before it end.
    """
    if key:
        own = Window.partitionBy(key)
        ranked = rows.withColumns({"_k": F.row_number().over(own.orderBy(order)) - 1, "_n": F.count("*").over(own)})
    else:
        ranges = stage(rows.repartitionByRange(order).withColumn("_pid", F.spark_partition_id()), "ranges")
        # one row to a range
        totals, before, starts = sorted(map(tuple, ranges.groupBy("_pid").count().collect())), 0, []
        for pid, n in totals:
            starts.append((pid, before))
            before += n
        place = F.row_number().over(Window.partitionBy("_pid").orderBy(order)) - 1
        ranked = ranges.withColumn("_k", place).join(F.broadcast(rows.sparkSession.createDataFrame(starts, "_pid int, _start long")), "_pid")
        ranked = ranked.withColumns({"_k": F.col("_k") + F.col("_start"), "_n": F.lit(before).cast("long")}).drop("_pid", "_start")
    step = F.col("_n") / F.lit(want)
    picks = F.transform(F.sequence(F.lit(0), F.lit(want - 1)), lambda i: F.floor((i + phase) * step) % F.col("_n"))
    return ranked.filter((F.col("_n") <= want) | F.array_contains(picks, F.col("_k").cast("bigint"))).drop("_k", "_n")


def quota(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most so many rows of each key, in order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_k") <= most).drop("_k")


def harvest_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("era").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"))


def renderings(day: Column, names: Column) -> Column:
    """Written forms of a day (YYYY-MM-DD) with given month names: numeric, named, CJK and in other digits."""
    parts = let(day, lambda x: F.struct(*(F.split_part(x, F.lit("-"), F.lit(k)).alias(name) for k, name in enumerate("ymd", 1))))
    bare = lambda x: x.try_cast("int").cast("string")
    in_digits = lambda forms, first: F.transform(forms, lambda f: F.translate(f, "0123456789", "".join(chr(first + k) for k in range(10))))
    plain = lambda p: let(F.struct(bare(p["m"]).alias("m"), bare(p["d"]).alias("d")), lambda n: _written(p["y"], p["m"], p["d"], n["m"], n["d"], names))
    # parts and forms are worked out once, however often they are used
    return let(let(parts, plain), lambda forms: F.array_distinct(F.concat(forms, *(in_digits(forms, first) for first in (0x0660, 0x06F0, 0x0966)))))


def _written(y: Column, m: Column, d: Column, mn: Column, dn: Column, names: Column) -> Column:
    numeric = [F.concat_ws(s, *p) for s, p in [("-", (y, m, d)), ("/", (y, m, d)), (".", (y, m, d)), ("", (y, m, d)), ("-", (d, m, y)), ("/", (d, m, y)), (".", (d, m, y)), ("/", (m, d, y)), ("-", (m, d, y)), ("/", (dn, mn, y)), ("/", (mn, dn, y)), (".", (dn, mn, y)), (".", (y, mn, dn)), ("/", (y, mn, dn)), ("-", (y, mn, dn))]]
    cjk = [F.concat(y, F.lit("年"), a, F.lit("月"), b, F.lit("日")) for a, b in ((mn, dn), (m, d))] + [F.concat(y, F.lit("년 "), mn, F.lit("월 "), dn, F.lit("일"))]
    named = lambda n: F.array(F.concat_ws(" ", n, F.concat(dn, F.lit(",")), y), F.concat_ws(" ", n, dn, y), F.concat_ws(" ", n, F.concat(d, F.lit(",")), y), F.concat_ws(" ", dn, n, y), F.concat_ws(" ", d, n, y), F.concat(dn, F.lit(". "), n, F.lit(" "), y), F.concat(dn, F.lit("."), n, F.lit(" "), y), F.concat_ws(" ", n, y))
    return F.concat(F.array(*numeric, *cjk), F.flatten(F.transform(names, named)))


def appears_in(text: Column, form: Column) -> Column:
    """Does the form stand in the text, not inside a longer number?

    Only a form that the text holds at all is made a pattern, as each form is another one to compile.
    """
    digit = "[0-9٠-٩۰-۹]"
    quoted = F.regexp_replace(form, "([\\\\.\\[\\]{}()*+?^$|/-])", "\\\\$1")
    return F.contains(text, form) & F.regexp_like(text, F.concat(F.lit(f"(?<!{digit})"), quoted, F.lit(f"(?!{digit})")))


def detect_lang(html: Column, tld: Column) -> Column:
    """The page's language: its html element, its og:locale, its domain."""
    own = F.nullif(F.lower(F.regexp_extract(html, "(?i)<html[^>]*\\slang\\s*=\\s*[\"']?([a-zA-Z]{2,3})(?:[-_][a-zA-Z]+)?", 1)), F.lit(""))
    og = F.nullif(F.lower(F.regexp_extract(html, "(?i)property\\s*=\\s*[\"']og:locale[\"'][^>]*content\\s*=\\s*[\"']([a-zA-Z]{2,3})", 1)), F.lit(""))
    return F.coalesce(own, og, choose(tld, TLD_LANG), F.lit("unknown"))


def verify_snapshot(html: Column, sha256: Column) -> Column:
    return F.when(html.isNull(), "missing").when(F.sha2(html, 256) == sha256, "ok").otherwise("changed")


def neutralise_declared(html: Column) -> Column:
    """The html with whole days blanked, as in ``neutralise``, in canonical links and og:url."""
    tag = "(?is)(<(?:link\\b(?=[^>]*rel\\s*=\\s*[\"']?canonical)|meta\\b(?=[^>]*(?:property|name)\\s*=\\s*[\"']?og:url))[^>]*?)"
    slashed = F.regexp_replace(html, tag + "/(?:19|20)\\d{2}/\\d{1,2}/\\d{1,2}(?=[/?#\"'\\s>])", "$1/yr/mo/dy")
    return F.regexp_replace(slashed, tag + "/(?:19|20)\\d{2}-\\d{2}-\\d{2}", "$1/yr-mo-dy")


# Search engines by host; a bare label stands before one or two short labels of any country.
ENGINES = {"google": "google", "bing": "bing.com", "duckduckgo": "duckduckgo.com", "hackernews": "news.ycombinator.com", "reddit": "old.reddit.com"}


def search_engine(host: Column) -> Column:
    """Id of the search engine a host belongs to, or null."""
    name = F.regexp_replace(F.lower(host), "\\.$", "")
    labels = F.split(name, "\\.")

    def is_at(pattern: str) -> Column:
        if "." in pattern:
            return (name == pattern) | name.endswith("." + pattern)
        at = F.array_position(labels, pattern)
        rest = F.slice(labels, at.cast("int") + 1, 10)
        return (at > 0) & F.size(rest).between(1, 2) & F.forall(rest, lambda x: x.rlike("^[a-z]{2,4}$"))

    return F.coalesce(*(F.when(is_at(p), engine) for engine, p in ENGINES.items()))


def result_hosts(links: DataFrame) -> DataFrame:
    """Result links (results_url, ord, url) to other hosts than the results page's own."""
    return links.filter(F.col("url").rlike("(?i)^https?:") & (host_of(F.col("url")) != host_of(F.col("results_url"))))
