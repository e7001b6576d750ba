"""URL parts, date-shaped paths and splits, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import months
from .dates import IS_DAY, IS_MONTH, NAME, days_in, found_value, numbered, padded, precision_of, rewritten
from .text import let, trim

# Years a URL path may name.
FIRST_YEAR, LAST_YEAR = 1995, 2100


def path_of(url: Column) -> Column:
    """The path, "/" if empty; null if the URL is none."""
    bare = F.regexp_extract(trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(trim(url).rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.when(bare == "", "/").otherwise(bare))


def host_of(url: Column) -> Column:
    """The host in lower case, without credentials and port."""
    host = F.lower(F.regexp_extract(trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:@]*)", 1))
    return F.nullif(host, F.lit(""))


def has_web_scheme(url: Column) -> Column:
    return F.coalesce(trim(url).rlike("(?i)^https?://[^/?#]"), F.lit(False))


def normal_path(path: Column) -> Column:
    """Lower case without final slashes; "/" if nothing is left."""
    bare = F.lower(F.regexp_replace(path, "/+$", ""))
    return F.when(bare == "", "/").otherwise(bare)


def url_slug(url: Column) -> Column:
    """Struct of value, precision and note for a date in the URL's path, or null."""
    full = "(?:^|/)(\\d{4})[/-](\\d{1,2})[/-](\\d{1,2})(?:[/-]|$)"
    named = f"(?iu)(?:^|/)(\\d{{4}})/({months.pattern()})/(\\d{{1,2}})(?:/|$)"
    monthly = "(?:^|/)(\\d{4})/(\\d{1,2})(?:/|$)"
    in_reach = "(?=199[5-9]|20\\d\\d|2100)"  # FIRST_YEAR to LAST_YEAR

    def read(path: Column) -> Column:
        day = found_value(padded(rewritten(path, full, "$1-$2-$3")), in_reach + IS_DAY)
        by_name = found_value(padded(numbered(rewritten(path, named, f"$1-{NAME}$2{NAME}-$3"))), in_reach + IS_DAY)
        month = found_value(padded(rewritten(path, monthly, "$1-$2")), in_reach + IS_MONTH)
        return F.when(path.rlike("\\d{4}"), F.coalesce(day, F.when(path.rlike("/\\d{4}/[^/0-9]"), by_name), month))

    def made(value: Column) -> Column:
        note = F.when(F.length(value) == 10, "date in URL path").otherwise("year and month in URL path")
        return F.when(value.isNotNull(), F.struct(value.alias("value"), precision_of(value).alias("precision"), note.alias("note")))

    return let(path_of(url), lambda path: let(read(path), made))


def image_path_day(url: Column) -> Column:
    """The day in an image's upload path, /YYYY/MM/DD/ with zeros, or null."""
    path = F.coalesce(path_of(url), F.regexp_extract(trim(url), "^[^?#]*", 0))
    dated = "/((?:19|20)\\d{2})/(0[1-9]|1[0-2])/(0[1-9]|[12]\\d|3[01])(?:/|$)"
    y, m, d = (F.regexp_extract(path, dated, k) for k in (1, 2, 3))
    ok = path.rlike(dated) & (d.try_cast("int") <= days_in(y.try_cast("int"), m.try_cast("int")))
    return F.when(ok, F.concat_ws("-", y, m, d))


def split_of(host: Column) -> Column:
    """test for a third of all hosts, by the first byte of their SHA-1; else dev."""
    first = F.conv(F.substring(F.sha1(host.cast("binary")), 1, 2), 16, 10).cast("int")
    return F.when(first % 3 == 0, "test").otherwise("dev")


def entry_id(url: Column) -> Column:
    return F.substring(F.sha1(url.cast("binary")), 1, 16)


def archive_url(snapshot: Column, url: Column) -> Column:
    return F.concat(F.lit("https://web.archive.org/web/"), snapshot, F.lit("id_/"), url)


def same_document(a: Column, b: Column) -> Column:
    """Equal but for the fragment."""
    return F.split_part(a, F.lit("#"), F.lit(1)) == F.split_part(b, F.lit("#"), F.lit(1))


def target_of(url: Column) -> Column:
    """The page a redirector's link leads to, by its url, uddg, u or q parameter, else the link itself."""
    def parameter(name: str) -> Column:
        found = F.try_url_decode(F.regexp_extract(url, f"[?&]{name}=([^&#]*)", 1))
        return F.when(has_web_scheme(found), found)

    return F.coalesce(*(parameter(k) for k in ("url", "uddg", "u", "q")), url)


def neutralise(url: Column) -> Column:
    """The URL with whole days in its path blanked; years and months alone stay."""
    slashed = F.regexp_replace(url, "/(?:19|20)\\d{2}/\\d{1,2}/\\d{1,2}(?=[/?#]|$)", "/yr/mo/dy")
    return F.regexp_replace(slashed, "/(?:19|20)\\d{2}-\\d{2}-\\d{2}", "/yr-mo-dy")


def normal_tool_day(found: Column) -> Column:
    """A tool's answer cut to its leading date, or null."""
    return F.nullif(F.regexp_extract(found, "^\\d{4}(?:-\\d{2}(?:-\\d{2})?)?", 0), F.lit(""))
