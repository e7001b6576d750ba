"""Month names of many languages, from the JVM's locale data, and patterns over them."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import S, any_of, fold_str, let

# Languages whose full month names, inflected and standing alone, are read.
LANGUAGES = "en de de-AT nl sv da nb fi it fr es pt ro ca ru uk pl cs tr el hu id ar ar-SY he hi".split()
# Names besides these, by month. Abbreviations are read in few languages.
MORE = {
    1: "jan janv gen jaenner",
    2: "feb fevr फरवरी",
    3: "mar maerz mrz",
    4: "apr avr",
    5: "mag mayis",
    6: "jun giu",
    7: "jul juil lug",
    8: "aug",
    9: "sep sept set setiembre",
    10: "oct okt ott अक्टूबर",
    11: "nov kasim",
    12: "dec dez dic aralik",
}
# Spellings of the locale data that pages are not read by.
UNREAD = {"फ़रवरी", "अक्तूबर"}


@cache
def names() -> dict[str, int]:
    """Folded name to month number."""
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    style = jvm.java.time.format.TextStyle
    found = {}
    for tag in LANGUAGES:
        locale = jvm.java.util.Locale.forLanguageTag(tag)
        for month in range(1, 13):
            for kind in (style.FULL, style.FULL_STANDALONE):
                name = jvm.java.time.Month.of(month).getDisplayName(kind, locale)
                if name not in UNREAD and not re.match("de |d’", name):
                    found[fold_str(name)] = month
    found.update((fold_str(n), month) for month, more in MORE.items() for n in more.split())
    return found


@cache
def pattern() -> str:
    """Any month name, the longest first."""
    return any_of(list(names()))


@cache
def _table() -> str:
    """All names as one text, for the check that another JVM has the same."""
    return "|" + "|".join(f"{name}={month:02d}" for name, month in sorted(names().items()))


@cache
def _by_month() -> list[tuple[int, list[str]]]:
    return [(month, sorted(n for n, m in names().items() if m == month)) for month in range(1, 13)]


def number(name: Column) -> Column:
    """Month number of a folded name, a final dot allowed; looked up in a set for each month."""
    def read(key: Column) -> Column:
        out = F
        for month, known in _by_month():
            out = out.when(key.isin(*known), month)
        return out

    return let(F.trim(F.regexp_replace(name, "\\.$", "")), read)


#: Stands for a run of characters that are no date's.
LEFT_OUT = "\u0001"
# Suffixes of a day's number, and the written forms of a date.
ORDINAL = "(?:st|nd|rd|th|ers?|[eè]re|[eè]me|º|ª|°|e)?"
CJK = f"\\d{{4}}{S}*[年년]{S}*\\d{{1,2}}{S}*[月월]{S}*\\d{{1,2}}{S}*[日일]|\\d{{4}}{S}*[年년]{S}*\\d{{1,2}}{S}*[月월]"


@cache
def longest() -> int:
    return max(map(len, names()))


def near_digits(collapsed: Column) -> Column:
    """A text with single spaces without what is too far from any digit to be of a date: long runs of other characters cut to what a date may begin or end with.

    No date holds so long a run itself, and none can hold the mark that stands for what is left out.
    """
    before, after = longest() + 24, 8
    return F.regexp_replace(collapsed, f"(?:^|(?<=\\d\\D{{{after}}}))\\D+(?:\\z|(?=\\D{{{before}}}\\d))", LEFT_OUT)


@cache
def date_body() -> str:
    """Any date as pages write it, in rendered text.

    A name is only tried where a digit is in its reach: no further than the longest
    name, a dot and white space.
    """
    m = pattern()
    near = f"(?=\\D{{1,{longest() + 1}}}+{S}*+\\d)"
    digits = [
        CJK,
        f"\\d{{1,2}}{ORDINAL}\\.?{S}+(?:de{S}+)?(?:{m})\\.?{S}+(?:de{S}+|del{S}+|r\\.?{S}*)?\\d{{4}}",
        "\\d{4}-\\d{2}-\\d{2}",
        "\\d{4}[/.]\\d{1,2}[/.]\\d{1,2}",
        "\\d{1,2}[/.\\-]\\d{1,2}[/.\\-]\\d{4}",
    ]
    return f"(?=\\d)(?:{'|'.join(digits)})|{near}(?:{m})\\.?{S}+(?:\\d{{1,2}}{ORDINAL},?{S}+)?\\d{{4}}"
