"""Answers of scripts in foreign pages: taken whole if every part is what it should be, else not at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import CANDIDATE, CANDIDATE_FIELDS, CONFIDENCE_RANK, PRECISION_RANK
from .urls import same_document

FIELDS = ("published", "modified", "unknown")


def _is(read: Column, path: str, kind: str) -> Column:
    """Is what lies there of that VARIANT type (STRING, ARRAY, OBJECT, VOID)?"""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(read, path, "variant")).startswith(kind), F.lit(False))


def _candidates(read: Column) -> Column:
    """The candidates as structs, or null where they are no array or one of them isn't a candidate.

    A candidate has a text as value, a known precision, field and tier, a source,
    and a note that is a text or missing; further keys are dropped.
    """
    each = F.try_variant_get(read, "$.candidates", "array<variant>")
    text = lambda c, k: _is(c, f"$.{k}", "STRING")
    value = lambda c, k: F.try_variant_get(c, f"$.{k}", "string")

    def fine(c: Column) -> Column:
        no_note = F.try_variant_get(c, "$.note", "variant").isNull() | F.coalesce(F.is_variant_null(F.try_variant_get(c, "$.note", "variant")), F.lit(False))
        known = value(c, "precision").isin(*PRECISION_RANK) & value(c, "field").isin(*FIELDS) & value(c, "confidence").isin(*CONFIDENCE_RANK)
        return F.coalesce(text(c, "value") & text(c, "source") & known & (text(c, "note") | no_note), F.lit(False))

    made = F.transform(each, lambda c: F.struct(*(F.when(text(c, k), value(c, k)).alias(k) for k in CANDIDATE_FIELDS)))
    return F.when(_is(read, "$.candidates", "ARRAY") & F.forall(each, fine), made.cast(f"array<{CANDIDATE}>"))


def accept_page_read(read: Column, expected_url: Column | None = None) -> Column:
    """Candidates of what a script in an open page answered (a VARIANT), or null.

    The answer must name the document it read, the expected one if there is one
    (fragments aside): a page may have moved on in between.
    """
    named = _is(read, "$.href", "STRING")
    if expected_url is not None:
        href = F.try_variant_get(read, "$.href", "string")
        named = named & (expected_url.isNull() | (expected_url == "") | F.coalesce(same_document(href, expected_url), F.lit(False)))
    return F.when(_is(read, "$", "OBJECT") & named, _candidates(read))


def accept_link_read(read: Column, expected_url: Column) -> Column:
    """Candidates of what a script that read a linked page answered, or null; it must echo exactly the URL asked for."""
    echoed = _is(read, "$.url", "STRING") & F.coalesce(F.try_variant_get(read, "$.url", "string") == expected_url, F.lit(False))
    return F.when(_is(read, "$", "OBJECT") & echoed, _candidates(read))
