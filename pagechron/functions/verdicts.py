"""Verdicts and wording over a resolved page, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import at_least, choose, confidence_rank
from .dates import DAY_MS, to_instant_ms, to_interval_ms
from .text import let

# How far back older evidence counts, and average days of a month and a year.
EVIDENCE_DAYS = 30
MONTH, YEAR = 30.44, 365.25
# What each tier means, in words.
TIER = {
    "declared": "declared by the site in machine-readable metadata",
    "derived": "derived from structured but weaker markup",
    "inferred": "inferred from the URL, prose, or a transport header",
}
# Sources whose name is not their label with hyphens for spaces.
SOURCE_LABELS = {"jsonld": "JSON-LD", "jsonld-container": "JSON-LD (page node)", "opengraph": "Open Graph", "url-slug": "URL", "http-last-modified": "Last-Modified header"}


def _round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def staleness(published: Column, modified: Column, max_age_days: int, now: Column, basis: str = "either", min_confidence: str | None = None) -> Column:
    """Struct of stale (null: can't be told), reason, age_days, max_age_days, basis and used."""
    ok = lambda c: c.isNotNull() & (at_least(c["confidence"], min_confidence) if min_confidence else F.lit(True))
    use_m = ok(modified) if basis != "published" else F.lit(False)
    use_p = ok(published) if basis != "modified" else F.lit(False)
    used = F.when(use_m, modified).when(use_p, published)
    span = to_interval_ms(used["value"], used["precision"])
    now_ms = F.unix_millis(now.cast("timestamp"))
    least, most = (now_ms - (span["end_ms"] - 1)) / DAY_MS, (now_ms - span["start_ms"]) / DAY_MS
    known = span.isNotNull()
    reason = F.when(~known | used.isNull(), "no-date").when(most <= max_age_days, "fresh").when(least > max_age_days, "stale").otherwise("imprecise")
    return F.struct(
        F.when(reason == "fresh", False).when(reason == "stale", True).alias("stale"),
        reason.alias("reason"),
        F.when(known, F.floor(least).cast("bigint")).alias("age_days"),
        F.when(known, F.floor(most).cast("bigint")).alias("max_age_days"),
        F.when(known, F.when(use_m, "modified").otherwise("published")).alias("basis"),
        F.when(known, used).alias("used"),
    )


def is_stale(verdict: Column, when_unknown: bool = True) -> Column:
    return F.coalesce(verdict["stale"], F.lit(when_unknown))


def days_old(value: Column, now: Column) -> Column:
    return (F.unix_millis(now.cast("timestamp")) - to_instant_ms(value)) / DAY_MS


def compact_age(value: Column, now: Column) -> Column:
    """Age in a few characters: an arrow for the future, then d, mo, y."""
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return let(
        days_old(value, now),
        lambda d: F.when(d < -1, "→").when(d < 30, text(F.greatest(F.lit(1), _round(d)), "d")).when(d < 365, text(_round(d / MONTH), "mo")).when(d.isNotNull(), text(_round(d / YEAR), "y")),
    )


def relative_age(value: Column, precision: Column, now: Column) -> Column:
    """Age in English words; coarse dates of 45 days or more are "about"."""
    def ago(n: Column, unit: str, last: str) -> Column:
        return F.when(n == 0, {"day": "today", "month": "this month", "year": "this year"}[unit]).when(n == 1, last).otherwise(F.concat(n.cast("string"), F.lit(f" {unit}s ago")))

    def words(d: Column) -> Column:
        phrase = (
            F.when(d < 1, "today")
            .when(d < 45, ago(_round(d), "day", "yesterday"))
            .when(d < 550, ago(_round(d / MONTH), "month", "last month"))
            .otherwise(ago(_round(d / YEAR), "year", "last year"))
        )
        about = precision.isin("year", "month") & (d >= 45)
        return F.when(d < -1, "in the future").when(d.isNotNull(), F.when(about, F.concat(F.lit("about "), phrase)).otherwise(phrase))

    return let(days_old(value, now), words)


def span_label(days: Column) -> Column:
    unit = lambda n, name: F.concat(n.cast("string"), F.lit(" " + name), F.when(n == 1, "").otherwise("s"))
    return F.when(days >= 365, unit(_round(days / YEAR), "year")).when(days >= 45, unit(_round(days / MONTH), "month")).otherwise(unit(F.greatest(F.lit(1), _round(days)), "day"))


def display(value: Column, precision: Column, style: str = "absolute") -> Column:
    """The date in English at its own precision; style iso leaves it as it is."""
    if style == "iso":
        return value
    at = F.timestamp_millis(to_instant_ms(value))
    fmt = lambda f: F.date_format(at, f)
    shown = F.when(precision == "year", value).when(precision == "month", fmt("MMMM yyyy")).when(precision == "day", fmt("MMMM d, yyyy")).otherwise(fmt("MMMM d, yyyy, h:mm a"))
    return F.coalesce(shown, value)


def spread(published: Column, modified: Column, candidates: Column) -> Column:
    """Distinct days of a page's candidates on an axis from 0 to 1, or null.

    A day is its first candidate's place and its strongest candidate (of equal
    ones the first); null with fewer than two days or no distance between them.
    """
    item = lambda c, k: F.struct(c.alias("c"), to_instant_ms(c["value"]).alias("ms"), k.alias("k"), F.left(c["value"], F.lit(10)).alias("day"))
    role = lambda c: F.when(c.eqNullSafe(published), "published").when(c.eqNullSafe(modified), "modified").otherwise("other")

    def placed(dated: Column) -> Column:
        def point(day: Column) -> Column:
            own = F.filter(dated, lambda x: x["day"] == day)
            first = F.array_min(F.transform(own, lambda x: F.struct(x["k"], x["ms"])))
            top = F.array_max(F.transform(own, lambda x: F.struct(confidence_rank(x["c"]["confidence"]).alias("tier"), (-x["k"]).alias("first"), x["c"].alias("c"))))["c"]
            return F.struct(first["ms"].alias("ms"), first["k"].alias("k"), day.alias("day"), top.alias("c"), F.size(own).alias("count"))

        def axis(points: Column) -> Column:
            low, high = F.element_at(points, 1)["ms"], F.element_at(points, -1)["ms"]
            span = (high - low) / DAY_MS
            shown = F.transform(points, lambda x: F.struct(x["c"].alias("candidate"), ((x["ms"] - low) / (high - low)).alias("x"), role(x["c"]).alias("role"), x["count"].alias("count")))
            ends = lambda k: F.left(F.element_at(points, k)["c"]["value"], F.lit(10))
            out = F.struct(shown.alias("points"), ends(1).alias("from"), ends(-1).alias("to"), _round(span).alias("span_days"), span_label(span).alias("span_label"), F.size(points).alias("total"))
            return F.when(high > low, out)

        days = F.array_distinct(F.transform(dated, lambda x: x["day"]))
        return F.when((F.size(dated) >= 2) & (F.size(days) >= 2), let(F.array_sort(F.transform(days, point)), axis))

    return let(F.filter(F.transform(candidates, item), lambda x: x["ms"].isNotNull()), placed)


def oldest_counter_evidence(published: Column, modified: Column, conflict: Column, candidates: Column) -> Column:
    """Of a page in conflict, the oldest candidate not inferred that lies 30 days or more before its date."""
    said = F.coalesce(published, modified)
    at = to_instant_ms(said["value"])
    older = F.filter(candidates, lambda c: (c["confidence"] != "inferred") & ((at - to_instant_ms(c["value"])) / DAY_MS >= EVIDENCE_DAYS))
    first = F.array_min(F.transform(older, lambda c, k: F.struct(to_instant_ms(c["value"]).alias("ms"), k.alias("k"), c.alias("c"))))
    return F.when(conflict.isNotNull(), first["c"])


def source_label(source: Column) -> Column:
    return F.coalesce(choose(source, SOURCE_LABELS), F.regexp_replace(source, "[-_]", " "))


def tier_text(confidence: Column) -> Column:
    return choose(confidence, TIER)


def describe(c: Column) -> Column:
    """A candidate in a sentence's words."""
    coarse = F.when(c["precision"] == "year", " — the page gave only a year, so the month and day are unknown").when(c["precision"] == "month", " — the page gave only a month, so the day is unknown").otherwise("")
    return F.concat(c["value"], F.lit(" ("), tier_text(c["confidence"]), F.lit("; source: "), c["source"], F.lit(")"), coarse)


def freshness_headline(verdict: Column, max_age_days: int, min_confidence: str | None = None) -> Column:
    n, a, b = str(max_age_days), verdict["age_days"].cast("string"), verdict["max_age_days"].cast("string")
    at = f' at the required "{min_confidence}" confidence' if min_confidence else ""
    r = verdict["reason"]
    by = F.concat(F.lit(f"-day threshold (basis: "), verdict["basis"], F.lit(" date)."))
    return (
        F.when(r == "fresh", F.concat(F.lit("FRESH — about "), a, F.lit(f" days old, within the {n}"), by))
        .when(r == "stale", F.concat(F.lit("STALE — about "), a, F.lit(f" days old, beyond the {n}"), by))
        .when(
            r == "imprecise",
            F.concat(
                F.lit(f"UNDETERMINED — the page dated itself too coarsely to place against a {n}-day threshold. It is between "), a, F.lit(" and "), b,
                F.lit(" days old, and the threshold falls inside that range. Do not report it as either current or outdated."),
            ),
        )
        .otherwise(f"UNDETERMINED — the page states no date this tool can find{at}. Its age is unknown; absence of a date is not evidence that it is recent.")
    )


def page_text(url: Column, published: Column, modified: Column, conflict: Column) -> Column:
    """The page's dates in prose, a warning first where it contradicts itself."""
    warning = (
        F.when(conflict["kind"] == "stale-declaration", "WARNING — this page appears to have been rewritten since the date it claims.")
        .when(conflict["kind"] == "declared-disagreement", "WARNING — this page contradicts itself about when it was published.")
        .when(conflict.isNotNull(), "WARNING — this page carries content older than the publication date it declares, so that date is probably a republication stamp.")
    )
    alert = F.concat(warning, F.lit("\n"), conflict["detail"], F.lit(" (gap: "), conflict["gap_days"].cast("string"), F.lit(" days)\n"))
    said = F.coalesce(F.concat(F.lit("Published: "), describe(published)), F.lit("Published: not stated. The page carries no publication date this tool can find — treat its age as unknown rather than recent."))
    changed = F.coalesce(F.concat(F.lit("Last modified: "), describe(modified)), F.lit("Last modified: not stated."))
    return F.concat_ws("\n", alert, F.concat(F.lit("Page: "), url), said, changed)
