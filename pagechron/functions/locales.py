"""Dates as a reader's language writes them, at their own precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import choose
from .verdicts import display, to_instant_ms

# Months in full, and how a month, a day and a minute are written ({M} month, {d} day, {y} year, {t} time).
MONTHS = {
    "de": ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
    "es": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    "it": ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"),
    "pt": ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"),
}
PATTERNS = {
    "de": ("{M} {y}", "{d}. {M} {y}", "{d}. {M} {y} um {t}"),
    "es": ("{M} de {y}", "{d} de {M} de {y}", "{d} de {M} de {y}, {t}"),
    "fr": ("{M} {y}", "{d} {M} {y}", "{d} {M} {y} à {t}"),
    "it": ("{M} {y}", "{d} {M} {y}", "{d} {M} {y} alle ore {t}"),
    "pt": ("{M} de {y}", "{d} de {M} de {y}", "{d} de {M} de {y} às {t}"),
}
LANGUAGES = ("en", *MONTHS)


def primary_language(tag: Column) -> Column:
    """The first part of a language tag (pt-BR, de_AT), in lower case."""
    return F.lower(F.regexp_extract(tag, "^\\s*([A-Za-z]{2,3})", 1))


def display_in(value: Column, precision: Column, lang: Column, style: str = "absolute") -> Column:
    """The date in a language (a tag; en where it is null or none of LANGUAGES), never finer than its precision; style iso leaves it as it is.

    The parts come from the instant in UTC; a value that is no date is shown as it is.
    """
    english = display(value, precision, style)
    if style == "iso":
        return english
    at, tag = F.timestamp_millis(to_instant_ms(value)), primary_language(lang)
    k = precision
    form = F.when(k == "month", choose(tag, {t: p[0] for t, p in PATTERNS.items()})).when(k == "day", choose(tag, {t: p[1] for t, p in PATTERNS.items()})).when(k != "year", choose(tag, {t: p[2] for t, p in PATTERNS.items()}))
    names = F.create_map(*(x for t, m in MONTHS.items() for x in (F.lit(t), F.array(*map(F.lit, m)))))
    month = F.element_at(F.try_element_at(names, tag), F.month(at))
    shown = form
    for name, part in (("{M}", month), ("{d}", F.dayofmonth(at).cast("string")), ("{y}", F.date_format(at, "yyyy")), ("{t}", F.date_format(at, "HH:mm"))):
        shown = F.replace(shown, F.lit(name), part)
    return F.coalesce(shown, english)
