"""Date strings to values of known precision, and values to instants, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import months
from .text import B, S, ascii_digits, fold, let, trim

DAY_MS = 86_400_000
# Languages and top-level domains that write the month first.
MONTH_FIRST_LANGS = ("en-us", "en-ph")
MONTH_FIRST_TLDS = ("us", "ph")
# Earliest year; how far ahead of now, and how close to it, a date may be.
EARLIEST_YEAR = 1995
FUTURE_MS = 48 * 3_600_000
RENDER_MS = 60_000

# What a value's day may be: a day of the calendar, of a year from 100 on.
_MONTH_DAY = "(?:(?:0[13578]|1[02])-(?:0[1-9]|[12]\\d|3[01])|(?:0[469]|11)-(?:0[1-9]|[12]\\d|30)|02-(?:0[1-9]|1\\d|2[0-8]))"
_LEAP_YEAR = "(?:\\d\\d(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
IS_DAY = f"(?!00)(?:\\d{{4}}-{_MONTH_DAY}|{_LEAP_YEAR}-02-29)"
IS_MONTH = "\\d{4}-(?:0[1-9]|1[0-2])"
_IS_MINUTE = f"{IS_DAY}T(?:[01]\\d|2[0-3]):[0-5]\\d(?:Z|[+-]\\d{{2}}:\\d{{2}})?"
#: Marks a text that a form was found in, and the name of a month in it.
FOUND, NAME = "\u0001", "\u0002"

_ISO = f"(\\d{{4}}-\\d{{2}}-\\d{{2}})[T ](\\d{{2}}:\\d{{2}})(?::\\d{{2}}(?:\\.\\d+)?)?{S}*(Z|[+-]\\d{{2}}:?\\d{{2}})?"
_RFC = f"(?:[A-Za-z]{{3}},{S}*)?(\\d{{1,2}}){S}+([A-Za-z]{{3,}}){S}+(\\d{{4}})(?:{S}+(\\d{{2}}:\\d{{2}})(?::\\d{{2}})?{S}*(GMT|UTC|Z|[+-]\\d{{4}}))?"
_CJK_DAY = f"(\\d{{4}}){S}*[年년]{S}*(\\d{{1,2}}){S}*[月월]{S}*(\\d{{1,2}}){S}*[日일]?"
_CJK_MONTH = f"(\\d{{4}}){S}*[年년]{S}*(\\d{{1,2}}){S}*[月월]"
_CJK_YEAR = f"(\\d{{4}}){S}*[年년]"
_NUMERIC = "^(\\d{1,2})[/.\\-](\\d{1,2})[/.\\-](\\d{4})$"
_OVER_12 = "(?:1[3-9]|[2-9]\\d)"


def days_in(year: Column, month: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def first_match(x: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group, or null: x is evaluated once and searched once."""
    return F.get(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), F.lit(0))


def rewritten(x: Column, pattern: str, into: Column | str, whole: bool = False) -> Column:
    """x as FOUND and ``into`` if the pattern is found in it (at its start if ``whole``); x that is rewritten or lacks it stays."""
    into = F.concat(F.lit(FOUND), into) if isinstance(into, Column) else F.lit(FOUND + into)
    return F.regexp_replace(x, f"^(?!{FOUND}){'' if whole else '[\\s\\S]*?'}(?:{pattern})[\\s\\S]*$", into)


def padded(x: Column) -> Column:
    """Single digits of months and days to two."""
    return F.regexp_replace(x, "-(\\d)(?!\\d)", "-0$1")


def numbered(x: Column) -> Column:
    """Names between NAME marks, every other part, to months' numbers."""
    named = lambda w: F.coalesce(F.lpad(months.number(F.lower(w)).cast("string"), 2, "0"), w)
    return F.array_join(F.transform(F.split(x, NAME), lambda w, k: F.when(k % 2 == 1, named(w)).otherwise(w)), "")


def found_value(x: Column, form: str) -> Column:
    """What a rewritten text says, if it has the form of a value; else null."""
    return first_match(x, f"^{FOUND}({form})$", 1)


def _iso(x: Column) -> Column:
    minute = F.regexp_replace(rewritten(x, _ISO, "$1T$2$3", whole=True), "([+-]\\d{2})(\\d{2})$", "$1:$2")
    year_first = padded(rewritten(x, "(\\d{4})([/.])(\\d{1,2})\\2(\\d{1,2})$", "$1-$3-$4", whole=True))
    return F.when(
        x.rlike("^\\d{4}"),
        F.coalesce(first_match(x, f"^(?:{IS_DAY}|{IS_MONTH}|\\d{{4}})$"), F.when(x.rlike("^\\d{4}-"), found_value(minute, _IS_MINUTE)), found_value(year_first, IS_DAY)),
    )


def _cjk(x: Column) -> Column:
    day, month = padded(rewritten(x, _CJK_DAY, "$1-$2-$3")), padded(rewritten(x, _CJK_MONTH, "$1-$2"))
    return F.when(x.rlike("[年년]"), F.coalesce(found_value(day, IS_DAY), found_value(month, IS_MONTH), first_match(x, _CJK_YEAR, 1)))


def _rfc2822(x: Column) -> Column:
    written = numbered(rewritten(x, _RFC, f"$3-{NAME}$2{NAME}-$1T$4$5", whole=True))
    zoned = F.regexp_replace(F.regexp_replace(written, "GMT$|UTC$", "Z"), "([+-]\\d{2})(\\d{2})$", "$1:$2")
    return F.when(x.rlike("^" + _RFC), found_value(padded(F.regexp_replace(F.regexp_replace(zoned, "-(\\d)T", "-0$1T"), "T$", "")), f"{IS_DAY}|{_IS_MINUTE}"))


def _numeric(x: Column, hint: Column) -> Column:
    day_first, month_first = "$3-$2-$1", "$3-$1-$2"
    order = (
        F.when(x.rlike(f"^{_OVER_12}\\D"), day_first)
        .when(x.rlike(f"^\\d{{1,2}}\\D{_OVER_12}\\D"), month_first)
        .when(hint == "day-first", day_first)
        .when((hint == "month-first") | x.rlike("^0?(\\d{1,2})\\D0?\\1\\D"), month_first)
        .otherwise("$3")
    )
    return F.when(x.rlike(_NUMERIC), found_value(padded(rewritten(x, _NUMERIC[1:], order, whole=True)), f"{IS_DAY}|\\d{{4}}"))


def _textual(x: Column) -> Column:
    m = months.pattern()
    clean = F.regexp_replace(fold(x), f"(?i)(\\d+)(?:st|nd|rd|th|ers?|ere|eme|e){B}", "$1")
    clean = F.regexp_replace(F.regexp_replace(clean, "(\\d+)[º°ª]", "$1"), ",", " ")
    out = rewritten(clean, f"(?iu){B}(\\d{{1,2}})\\.?{S}+(?:de{S}+)?({m})\\.?{S}+(?:de{S}+|del{S}+)?(\\d{{4}}){B}", f"$3-{NAME}$2{NAME}-$1")
    out = rewritten(out, f"(?iu){B}({m})\\.?{S}+(\\d{{1,2}}){S}+(\\d{{4}}){B}", f"$3-{NAME}$1{NAME}-$2")
    out = rewritten(out, f"(?iu){B}({m})\\.?{S}+(\\d{{4}}){B}", f"$2-{NAME}$1{NAME}")
    return F.when(x.rlike("\\p{L}[\\p{L}\\p{M}]"), found_value(padded(numbered(out)), f"{IS_DAY}|{IS_MONTH}"))


def prepared(raw: Column) -> Column:
    """A date string as ``date_value`` takes it."""
    return trim(ascii_digits(raw))


def date_value(x: Column, hint: Column) -> Column:
    """The value of a prepared date string, or null.

    Each form is found, rewritten and checked by patterns over one text, so that
    no intermediate value is worked out twice and all stays in generated code.
    """
    return F.when(x.rlike("\\d{4}"), F.coalesce(_iso(x), _cjk(x), _rfc2822(x), _numeric(x, hint), _textual(x)))


def precision_of(value: Column) -> Column:
    """year, month, day or minute, by the value's length."""
    size = F.length(value)
    return F.when(size == 4, "year").when(size == 7, "month").when(size == 10, "day").when(size > 10, "minute")


def parse_date(raw: Column, hint: Column | str = "unknown") -> Column:
    """Struct of value and precision, or null: what a date string says, no more.

    Tried in turn: ISO 8601 and near it, CJK, RFC 2822, all-numeric with the
    year last (``hint``: day-first, month-first or unknown), month names.
    """
    h = F.lit(hint) if isinstance(hint, str) else hint
    made = lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), precision_of(v).alias("precision")))
    return let(prepared(raw), lambda x: let(date_value(x, h), made))


def detect_day_first(lang: Column, host: Column) -> Column:
    """The page's own hint for all-numeric dates; its language before its domain."""
    known = F.nullif(F.lower(trim(lang)), F.lit(""))
    tld = F.nullif(F.lower(F.element_at(F.split(host, "\\."), -1)), F.lit(""))
    return (
        F.when(known.isin(*MONTH_FIRST_LANGS), "month-first")
        .when(known.isNotNull() & (known != "en"), "day-first")
        .when(tld.isin(*MONTH_FIRST_TLDS), "month-first")
        .when(F.length(tld) == 2, "day-first")
        .otherwise("unknown")
    )


_VALUE = "^\\d{4}(?:-\\d{2}(?:-\\d{2}(?:T\\d{2}:\\d{2}(?::\\d{2}(?:\\.\\d+)?)?(?:Z|[+-]\\d{2}:\\d{2})?)?)?)?$"


def to_instant_ms(value: Column) -> Column:
    """Epoch milliseconds of a value; partial values start their period, none but UTC is assumed."""
    size = F.length(value)
    rest = F.when(size == 4, "-01-01T00:00Z").when(size == 7, "-01T00:00Z").when(size == 10, "T00:00Z").when(value.rlike("(?:Z|[+-]\\d{2}:\\d{2})$"), "").otherwise("Z")
    full = F.regexp_replace(F.concat(value, rest), "(T\\d{2}:\\d{2})(?=[Z+-])", "$1:00")
    return F.when(value.rlike(_VALUE), F.unix_millis(full.try_cast("timestamp")))


def to_interval_ms(value: Column, precision: Column) -> Column:
    """Struct of start and end, in epoch milliseconds, of the half-open period a value covers."""
    def span(start: Column) -> Column:
        at = F.timestamp_millis(start)
        end = (
            F.when(precision == "year", F.unix_millis(at + F.expr("INTERVAL 1 YEAR")))
            .when(precision == "month", F.unix_millis(at + F.expr("INTERVAL 1 MONTH")))
            .when(precision == "day", start + DAY_MS)
            .when(precision == "minute", start + 60_000)
        )
        return F.when(start.isNotNull(), F.struct(start.alias("start_ms"), F.coalesce(end, start).alias("end_ms")))

    return let(to_instant_ms(value), span)


def implausible_at(at: Column, precision: Column, now_ms: Column) -> Column:
    """Why an instant, in epoch milliseconds, can't be the page's date, or null."""
    return (
        F.when(at.isNull(), "unparseable value")
        .when(F.year(F.timestamp_millis(at)) < EARLIEST_YEAR, f"before {EARLIEST_YEAR}")
        .when(at - now_ms > FUTURE_MS, "in the future")
        .when((precision == "minute") & (F.abs(at - now_ms) < RENDER_MS), "looks like a render timestamp")
    )


def implausible_reason(value: Column, precision: Column, now_ms: Column) -> Column:
    """Why a candidate can't be the page's date, or null."""
    return let(to_instant_ms(value), lambda at: implausible_at(at, precision, now_ms))
