"""What a page's dates are called where they are shown: chips, badges, notices and readouts, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import choose
from .verdicts import compact_age, display, oldest_counter_evidence, relative_age, source_label

# The words of tiers, fields and conflicts, and which conflicts are loud.
TIER_WORDS = {"declared": "stated by the site", "derived": "from page markup", "inferred": "inferred"}
FIELD_WORDS = {"published": "published", "modified": "updated", "unknown": "unlabelled"}
CONFLICT_HEADINGS = {
    "declared-disagreement": "This page contradicts itself",
    "predated-content": "This page is probably older than it says",
    "stale-declaration": "This page may have changed since it says",
}
CONFLICT_TONES = {"declared-disagreement": "alert", "predated-content": "alert", "stale-declaration": "notice"}
BADGE_COLOURS = {"declared": "#0f766e", "derived": "#c2410c", "inferred": "#6b7280"}
ALERT_COLOUR, UNKNOWN_COLOUR = "#b3261e", "#4b5563"
NO_DATE, FROM_ADDRESS = "No date found", "inferred from the link address"
EMPTY = "No date found. That is sometimes the correct answer — this page may genuinely not state when it was written."
NOTICES = {"none": "No date found for this link.", "unreachable": "Could not read that page.", "denied": "Permission to read that site was declined."}
#: Distinct days that make an axis worth its space.
WORTHWHILE_DAYS = 3


def tier_word(confidence: Column) -> Column:
    return choose(confidence, TIER_WORDS)


def field_word(field: Column) -> Column:
    return choose(field, FIELD_WORDS)


def conflict_heading(kind: Column) -> Column:
    return choose(kind, CONFLICT_HEADINGS)


def conflict_tone(kind: Column) -> Column:
    return choose(kind, CONFLICT_TONES)


def conflict_detail(conflict: Column) -> Column:
    """The sentence under the heading, from the conflict's facts, with sources by their labels."""
    c, lit = conflict, F.lit
    return (
        F.when(c["kind"] == "declared-disagreement", F.concat(source_label(c["earlier"]["source"]), lit(" says "), c["earlier"]["value"], lit(", while "), source_label(c["later"]["source"]), lit(" says "), c["later"]["value"], lit(" for the same field.")))
        .when(
            c["kind"] == "predated-content",
            F.concat(lit("Declares "), c["declared"], lit(", but carries "), c["older_count"].cast("string"), lit(" dated elements from before then, back to "), c["oldest"], lit(". The declared date is likely a republication, not when this was written.")),
        )
        .when(c["kind"] == "stale-declaration", F.concat(lit("The page declares "), c["declared"], lit(" and shows no update, but the archive records a change on "), c["archived"], lit(".")))
    )


def provenance(c: Column) -> Column:
    return F.concat(tier_word(c["confidence"]), F.lit(", "), source_label(c["source"]))


def _label(published: Column) -> Column:
    return F.when(published.isNotNull(), "Published").otherwise("Last modified")


def _shown(c: Column, style: str) -> Column:
    return display(c["value"], c["precision"], "iso" if style == "iso" else "absolute")


def chip(published: Column, modified: Column, conflict: Column, tier: Column, now: Column, style: str = "relative") -> Column:
    """Struct of text, tone and title beside a link, or null; a date from the URL alone (tier url) is inferred."""
    d, by_url = F.coalesce(published, modified), tier == "url"
    age = compact_age(d["value"], now)
    title = F.concat(_label(published), F.lit(": "), _shown(d, style), F.lit(" — "), F.when(by_url, FROM_ADDRESS).otherwise(provenance(d)))
    made = lambda text, tone, title: F.struct(text.alias("text"), tone.alias("tone"), title.alias("title"))
    alert = made(F.lit("!"), F.lit("alert"), F.lit(CONFLICT_HEADINGS["declared-disagreement"]))
    return F.when(conflict.isNotNull(), alert).when(age.isNotNull(), made(age, F.when(by_url, "inferred").otherwise(d["confidence"]), title))


def badge(published: Column, modified: Column, conflict: Column, now: Column) -> Column:
    """Struct of text, colour and title for a page: its age, "!" where it contradicts itself, "?" without a date."""
    d = F.coalesce(published, modified)
    age = compact_age(d["value"], now)
    made = lambda text, colour, title: F.struct(text.alias("text"), colour.alias("colour"), title.alias("title"))
    dated = made(age, choose(d["confidence"], BADGE_COLOURS), F.concat(d["value"], F.lit(" — "), provenance(d)))
    unknown = made(F.lit("?"), F.lit(UNKNOWN_COLOUR), F.lit(NO_DATE))
    return F.when(conflict.isNotNull(), made(F.lit("!"), F.lit(ALERT_COLOUR), conflict_heading(conflict["kind"]))).when(age.isNotNull(), dated).otherwise(unknown)


def toast(state: Column, published: Column, modified: Column, conflict: Column, tier: Column, host: Column, now: Column, style: str = "relative") -> Column:
    """Struct of heading, detail and tone for what checking a link came to (denied, unreachable, none or dated)."""
    d, c = F.coalesce(published, modified), chip(published, modified, conflict, tier, now, style)
    made = lambda heading, detail, tone: F.struct(heading.alias("heading"), detail.alias("detail"), tone.alias("tone"))
    heading = F.concat(_label(published), F.lit(": "), _shown(d, style))
    told = made(heading, F.concat(host, F.lit(" — "), F.when(tier == "url", FROM_ADDRESS).otherwise(provenance(d))), c["tone"])
    rest = made(F.coalesce(choose(state, NOTICES), F.lit(NOTICES["none"])), F.concat(F.lit("For "), host), F.lit("muted"))
    return F.when((state == "dated") & d.isNotNull() & c.isNotNull(), told).otherwise(rest)


def overlay(published: Column, modified: Column, conflict: Column, candidates: Column, now: Column, mode: str = "always", style: str = "absolute") -> Column:
    """Struct of a page's readout, or null by mode (never; conflict: only where the page contradicts itself)."""
    d, counter = F.coalesce(published, modified), oldest_counter_evidence(published, modified, conflict, candidates)
    ago = lambda c: F.coalesce(relative_age(c["value"], c["precision"], now), _shown(c, style))
    detail = F.concat(_label(published), F.lit(" "), _shown(d, style), F.lit(" — "), provenance(d))
    both = F.concat(F.lit("The page says "), ago(d), F.lit(", but the oldest date it carries is from "), ago(counter), F.lit(". "), detail)
    dated, against = d.isNotNull(), counter.isNotNull()
    out = F.struct(
        F.when(~dated, "no date").when(against, F.concat(F.lit("says "), ago(d))).otherwise(ago(d)).alias("age"),
        (~dated).alias("muted"),
        F.when(dated, detail).otherwise(EMPTY).alias("detail"),
        conflict_heading(conflict["kind"]).alias("conflict"),
        F.when(dated & against, F.concat(F.lit("oldest "), ago(counter))).alias("counter_age"),
        F.when(dated & against, F.concat(F.lit("Oldest date on the page: "), _shown(counter, style), F.lit(" — "), provenance(counter), F.lit("."))).alias("counter_detail"),
        F.coalesce(conflict_tone(conflict["kind"]), F.lit("normal")).alias("tone"),
        F.when(~dated, "no date").when(against, both).otherwise(F.concat(_label(published), F.lit(" "), ago(d), F.lit(". "), detail)).alias("label"),
    )
    if mode == "never":
        return F.when(F.lit(False), out)
    return F.when(conflict.isNotNull(), out) if mode == "conflict" else out


def is_spread_worth_showing(spread: Column, conflict: Column) -> Column:
    """Does an axis of days tell more than one clean date would?"""
    return F.coalesce(spread.isNotNull() & ((spread["total"] >= WORTHWHILE_DAYS) | conflict.isNotNull()), F.lit(False))
