"""Candidates to a published and modified date and at most one conflict.

Everything is a column over a page's own array of candidates, in order: no
shuffle, no join with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import DAY_MS, implausible_at, to_instant_ms
from ..functions.text import let
from ..types import CANDIDATE, CANDIDATE_FIELDS, CONFLICT, confidence_rank, precision_rank, rank_candidate

# Bounds of conflicts in days, and of zone offsets in minutes.
DISAGREEMENT_DAYS = 30
STALE_DAYS = 365
PREDATED_DAYS = 365
PREDATED_COUNT = 3
MIN_OFFSET, MAX_OFFSET = -720, 840


def collect_candidates(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per page with its candidates as an array in the given order."""
    item = F.struct(*order, F.struct(*CANDIDATE_FIELDS).alias("c"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), item))), lambda x: x["c"]).alias("candidates"))


def _plain(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(*(c[k].alias(k) for k in CANDIDATE_FIELDS)))


def _plain_always(c: Column) -> Column:
    return F.struct(*(c[k].alias(k) for k in CANDIDATE_FIELDS))


def best(items: Column) -> Column:
    """Highest rank; of equal ones the first."""
    return F.array_max(F.transform(items, lambda c: F.struct(c["rank"], (-c["pos"]).alias("first"), c.alias("c"))))["c"]


def _shift(day: Column, days: int) -> Column:
    return F.date_format(F.date_add(day.try_cast("date"), days), "yyyy-MM-dd")


def _noted(note: Column, extra: Column) -> Column:
    return F.when(note.isNotNull() & (note != ""), F.concat(note, F.lit(" — "), extra)).otherwise(extra)


def _around(p: Column) -> Column:
    """The days beside a UTC minute's own that the same instant may have elsewhere; null for other values."""
    utc = (p["precision"] == "minute") & p["value"].rlike("T\\d{2}:\\d{2}(Z|\\+00:00)$")
    minutes = F.pmod(F.floor(p["ms"] / 60_000), F.lit(1440))
    day = F.left(p["value"], F.lit(10))
    earlier = F.when(minutes + MIN_OFFSET < 0, _shift(day, -1))
    later = F.when(minutes + MAX_OFFSET >= 1440, _shift(day, 1))
    return F.when(utc, F.array_compact(F.array(earlier, later)))


def _teller(p: Column, around: Column, usable: Column) -> Column:
    """The first candidate that tells the site's own zone or day of p."""
    beside = lambda d: F.array_contains(around, d)

    def tells(c: Column) -> Column:
        offset = (c["ms"] - p["ms"]) / 60_000
        local = (c["precision"] == "minute") & c["value"].rlike("T\\d{2}:\\d{2}$")
        zone = local & (offset != 0) & (offset % 15 == 0) & offset.between(MIN_OFFSET, MAX_OFFSET) & beside(F.left(c["value"], F.lit(10)))
        return (c["field"] != "modified") & (zone | ((c["precision"] == "day") & (c["field"] == "published") & beside(c["value"])))

    return F.when(F.size(around) > 0, F.get(F.filter(usable, tells), F.lit(0)))


def _localised(p: Column, by: Column) -> Column:
    """The published candidate in the site's own zone or day, where ``by`` tells it."""
    offset = (by["ms"] - p["ms"]) / 60_000
    o = F.abs(offset).cast("int")
    sign = F.when(offset < 0, "-").otherwise("+")
    there = F.concat(by["value"], sign, F.lpad(F.floor(o / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((o % 60).cast("string"), 2, "0"))
    whole = by["precision"] == "day"
    note = F.when(whole, F.concat(F.lit("day taken from "), by["source"], F.lit(", which the page states and UTC would shift"))).otherwise(
        F.concat(F.lit("rendered in the site's own zone, per "), by["source"])
    )
    moved = F.struct(
        F.when(whole, by["value"]).otherwise(there).alias("value"),
        F.when(whole, "day").otherwise("minute").alias("precision"),
        *(p[k].alias(k) for k in ("field", "source", "confidence")),
        _noted(p["note"], note).alias("note"),
    )
    return F.when(by.isNotNull(), moved).otherwise(_plain(p))


def _ends(group: Column) -> Column:
    """The earliest and the latest declared candidate of one field."""
    declared = F.filter(group, lambda c: c["confidence"] == "declared")
    end = lambda c, place: F.struct(c["ms"], place, c["source"], c["value"])
    points = F.transform(declared, lambda c: F.struct(end(c, c["pos"]).alias("low"), end(c, (-c["pos"]).alias("pos")).alias("high")))
    return F.struct(F.array_min(points["low"]).alias("low"), F.array_max(points["high"]).alias("high"))


def _disagreement(ends: Column) -> Column:
    low, high = ends["low"], ends["high"]
    gap = (high["ms"] - low["ms"]) / DAY_MS
    said = lambda c: F.struct(c["source"].alias("source"), c["value"].alias("value"))
    detail = F.concat(low["source"], F.lit(" says "), low["value"], F.lit(", "), high["source"], F.lit(" says "), high["value"], F.lit(" for the same field."))
    return F.when(gap > DISAGREEMENT_DAYS, _conflict("declared-disagreement", gap, detail, earlier=said(low), later=said(high)))


def _conflict(kind: str, gap: Column, detail: Column, **more: Column) -> Column:
    kinds = {"earlier": "struct<source:string,value:string>", "later": "struct<source:string,value:string>", "declared": "string", "older_count": "int", "oldest": "string", "archived": "string"}
    rest = (more.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items())
    return F.struct(F.lit(kind).alias("kind"), F.floor(gap + 0.5).cast("bigint").alias("gap_days"), detail.alias("detail"), *rest).cast(CONFLICT)


def _older(published: Column, usable: Column) -> Column:
    """How many days, and the oldest, that evidence better than inferred names a year or more before the declared one."""
    at = published["ms"]
    older = F.filter(usable, lambda c: (c["confidence"] != "inferred") & ((at - c["ms"]) / DAY_MS > PREDATED_DAYS))
    points = F.transform(older, lambda c: F.struct(c["ms"], c["pos"], c["value"], F.left(c["value"], F.lit(10)).alias("day")))
    both = let(points, lambda x: F.struct(F.size(F.array_distinct(x["day"])).alias("days"), F.array_min(x).alias("oldest")))
    return F.when(published["confidence"] == "declared", both)


def _predated(published: Column, older: Column) -> Column:
    days, oldest = older["days"], older["oldest"]
    said, first = F.left(published["value"], F.lit(10)), F.left(oldest["value"], F.lit(10))
    detail = F.concat(F.lit("Declares "), said, F.lit(", but carries "), days.cast("string"), F.lit(" dated elements from before then, back to "), first, F.lit(". The declared date is likely a republication, not when this was written."))
    return F.when(days >= PREDATED_COUNT, _conflict("predated-content", (published["ms"] - oldest["ms"]) / DAY_MS, detail, declared=said, older_count=days, oldest=first))


def _usable(candidates: Column, now_ms: Column) -> Column:
    """The plausible candidates with their instant, rank and place."""
    given = F.coalesce(candidates, F.array().cast(f"array<{CANDIDATE}>"))
    placed = F.transform(
        given,
        lambda c, k: F.struct(*(c[f].alias(f) for f in CANDIDATE_FIELDS), to_instant_ms(c["value"]).alias("ms"), rank_candidate(c["confidence"], c["source"], c["precision"]).alias("rank"), k.alias("pos")),
    )
    return F.filter(placed, lambda c: implausible_at(c["ms"], c["precision"], now_ms).isNull())


def _earliest(p: Column, published: Column) -> Column:
    """A declared answer gives way to earlier declared ones, each within 30 days of the one before it."""
    sharp = F.filter(published, lambda c: (c["confidence"] == "declared") & (precision_rank(c["precision"]) >= precision_rank(p["precision"])))
    earlier = F.aggregate(sharp, p, lambda a, c: F.when((c["ms"] < a["ms"]) & (a["ms"] - c["ms"] <= DISAGREEMENT_DAYS * DAY_MS), c).otherwise(a))
    return F.when(p["confidence"] == "declared", earlier).otherwise(p)


def _promoted(p: Column, m: Column, u: Column) -> Column:
    """The best unlabelled candidate where nothing is published or it outranks what is; never after the update."""
    outranks = (u["rank"] > p["rank"]) & (confidence_rank(u["confidence"]) > confidence_rank(p["confidence"])) & (precision_rank(u["precision"]) >= precision_rank(p["precision"]))
    promote = u.isNotNull() & (p.isNull() | outranks) & (m.isNull() | (u["ms"] <= m["ms"]))
    note = F.when(u["note"].isNotNull() & (u["note"] != ""), F.concat(u["note"], F.lit(" (unlabelled, read as published)"))).otherwise("unlabelled, read as published")
    return F.when(promote, u.withField("field", F.lit("published")).withField("note", note)).otherwise(p)


def _stale(f: Column, m: Column, archived: Column) -> Column:
    gap = (to_instant_ms(archived) - f["ms"]) / DAY_MS
    detail = F.concat(F.lit("Page declares "), f["value"], F.lit(" and shows no update, but the archive records a change on "), F.left(archived, F.lit(10)), F.lit("."))
    return F.when(m.isNull() & (gap > STALE_DAYS), _conflict("stale-declaration", gap, detail, declared=f["value"], archived=F.left(archived, F.lit(10))))


def resolve(pages: DataFrame, now: Column, archive_last_edit: Column | None = None, candidates: str = "candidates") -> DataFrame:
    """Add published, modified and conflict; ``candidates`` keeps the plausible ones.

    ``now`` and ``archive_last_edit`` may differ from page to page. Each
    intermediate value is a column, so none is worked out twice.
    """
    archived = archive_last_edit.cast("string") if archive_last_edit is not None else F.lit(None).cast("string")
    u, group = F.col("_usable"), lambda field: F.filter("_usable", lambda c: c["field"] == field)
    rows = pages.withColumns({"_usable": _usable(F.col(candidates), F.unix_millis(now.cast("timestamp"))), "_archived": archived})
    rows = rows.withColumns({f"_{k}": group(k) for k in ("published", "modified", "unknown")})
    rows = rows.withColumns({"_p": best(F.col("_published")), "_m": best(F.col("_modified")), "_u": best(F.col("_unknown")), "_ends_p": _ends(F.col("_published")), "_ends_m": _ends(F.col("_modified"))})
    rows = rows.withColumn("_p", _earliest(F.col("_p"), F.col("_published")))
    rows = rows.withColumn("_p", _promoted(F.col("_p"), F.col("_m"), F.col("_u")))
    rows = rows.withColumn("_around", _around(F.col("_p")))
    rows = rows.withColumn("_by", _teller(F.col("_p"), F.col("_around"), u))
    rows = rows.withColumn("_final", _localised(F.col("_p"), F.col("_by")))
    rows = rows.withColumn("_final", F.when(F.col("_final").isNotNull(), F.col("_final").withField("ms", to_instant_ms(F.col("_final.value")))))
    rows = rows.withColumn("_older", _older(F.col("_final"), u))
    final, m = F.col("_final"), F.col("_m")
    conflict = F.coalesce(_disagreement(F.col("_ends_p")), _disagreement(F.col("_ends_m")), _predated(final, F.col("_older")), _stale(final, m, F.col("_archived")))
    answer = F.struct(_plain(final).alias("published"), _plain(m).alias("modified"), conflict.alias("conflict"), F.transform(u, _plain_always).alias("candidates"))
    # a generated column: filters on the answer stay above it and nothing is worked out twice
    rows = rows.select(*[c for c in pages.columns if c != candidates], F.explode(F.array(answer)).alias("_answer"))
    return rows.select(*[c for c in pages.columns if c != candidates], F.col("_answer.candidates").alias(candidates), "_answer.published", "_answer.modified", "_answer.conflict")


def archive_lookup(captures: DataFrame, url: str = "url", stamp: str = "ts", digest: str = "digest", limit: int = 300) -> DataFrame:
    """Per URL: first capture, last change of content, and whether the list was cut short.

    Captures whose content equals the one before are dropped; at most ``limit``
    changes count; a single one is no edit.
    """
    order = Window.partitionBy(url).orderBy(stamp)
    changes = captures.withColumn("_was", F.lag(digest).over(order)).filter(F.col("_was").isNull() | (F.col("_was") != F.col(digest)))
    changes = changes.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit)
    iso = F.date_format(F.try_to_timestamp(F.col(stamp), F.lit("yyyyMMddHHmmss")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return changes.groupBy(url).agg(
        F.min(iso).alias("first_capture"), F.when(F.count(iso) > 1, F.max(iso)).alias("last_edit"), (F.count("*") >= limit).alias("truncated"), F.count("*").alias("changes")
    )
