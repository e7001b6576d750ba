"""Types and ranks of the date model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CANDIDATE = "struct<value:string,precision:string,field:string,source:string,confidence:string,note:string>"
CANDIDATE_FIELDS = ("value", "precision", "field", "source", "confidence", "note")
CONFLICT = (
    "struct<kind:string,gap_days:bigint,detail:string,earlier:struct<source:string,value:string>,"
    "later:struct<source:string,value:string>,declared:string,older_count:int,oldest:string,archived:string>"
)
MODES = ("fast", "standard", "extensive")

# The order of tiers and precisions, and of sources of one tier.
CONFIDENCE_RANK = {"declared": 3, "derived": 2, "inferred": 1}
PRECISION_RANK = {"minute": 4, "day": 3, "month": 2, "year": 1}
SOURCE_RANK = {
    "adapter": 100,
    "jsonld": 90,
    "atom-feed": 85,
    "opengraph": 80,
    "jsonld-container": 75,
    "itemprop": 70,
    "rss-feed": 65,
    "dublin-core": 60,
    "citation": 55,
    "parsely": 50,
    "sailthru": 50,
    "time-tag": 45,
    "marked-date": 42,
    "sitemap": 40,
    "meta-date": 35,
    "wordpress": 32,
    "inline-state": 31,
    "url-slug": 20,
    "image-path": 18,
    "visible-text": 15,
    "text-date": 12,
    "http-last-modified": 10,
    "page-scan": 5,
}
OTHER_SOURCE_RANK = 30


def choose(x: Column, table: dict[str, int], other: int | None = None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(x == k, v) if out is None else out.when(x == k, v)
    return out if other is None else out.otherwise(other)


def confidence_rank(x: Column) -> Column:
    return choose(x, CONFIDENCE_RANK)


def precision_rank(x: Column) -> Column:
    return choose(x, PRECISION_RANK)


def rank_candidate(confidence: Column, source: Column, precision: Column) -> Column:
    """Tier first, then source, then precision; 0 if the tier or precision is none of ours."""
    return F.coalesce(confidence_rank(confidence) * 10_000 + choose(source, SOURCE_RANK, OTHER_SOURCE_RANK) * 10 + precision_rank(precision), F.lit(0))


def at_least(confidence: Column, floor: str) -> Column:
    return F.coalesce(confidence_rank(confidence), F.lit(0)) >= CONFIDENCE_RANK.get(floor, 0)


def candidate(value, precision, field, source, confidence, note) -> Column:
    """A candidate struct; plain strings are literals."""
    parts = zip(CANDIDATE_FIELDS, (value, precision, field, source, confidence, note), strict=True)
    return F.struct(*((F.lit(v).cast("string") if v is None or isinstance(v, str) else v).alias(k) for k, v in parts))
