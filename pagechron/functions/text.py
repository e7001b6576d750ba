"""Text helpers as Columns: white space, digits, case folding."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a web page's scripts take for white space, inside a character class.
SPACES = "\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
S = f"[{SPACES}]"
#: A word boundary that knows ASCII letters, digits and _ only.
B = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Most texts; what other characters need is not asked of them.
ASCII = "^[\\x00-\\x7f]*$"
# First digit of each system besides ASCII's.
DIGIT_SYSTEMS = (0x0660, 0x06F0, 0x0966, 0x0E50, 0xFF10)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body uses it.

    This also keeps a large body out of generated code, whose methods are bounded.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^{S}+|{S}+$", "")


def collapse(x: Column) -> Column:
    """Runs of white space to one space, trimmed; most texts are that already."""
    is_so = x.rlike("^[ -~]*\\z") & ~F.contains(x, F.lit("  ")) & ~F.startswith(x, F.lit(" ")) & ~F.endswith(x, F.lit(" "))
    return F.when(is_so, x).otherwise(F.trim(F.regexp_replace(x, f"{S}+", " ")))


def ascii_digits(x: Column) -> Column:
    """Digits of other systems to ASCII."""
    digits = F.translate(x, "".join(chr(b + k) for b in DIGIT_SYSTEMS for k in range(10)), "0123456789" * len(DIGIT_SYSTEMS))
    return F.when(x.rlike(ASCII), x).otherwise(digits)


@cache
def _unmarked() -> tuple[str, str]:
    """Letters that decompose to one letter and marks of U+0300 to U+036F, and those letters."""
    pairs = []
    for point in range(0x80, 0x2000):
        apart = unicodedata.normalize("NFD", chr(point))
        bare = unicodedata.normalize("NFC", re.sub("[\u0300-\u036f]", "", apart))
        if bare != chr(point) and len(bare) == 1 and apart != chr(point):
            pairs.append((chr(point), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(x: Column) -> Column:
    """Lower case without diacritics; vowel signs of other scripts stay."""
    marked, bare = _unmarked()
    plain = F.lower(F.regexp_replace(F.translate(x, marked, bare), "[\\u0300-\\u036f]", ""))
    return F.when(x.rlike(ASCII), F.lower(x)).otherwise(plain)


def fold_str(x: str) -> str:
    """The same for a Python string, when a plan is built."""
    if x.isascii():
        return x.lower()
    return unicodedata.normalize("NFC", re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", x))).lower()


_FEW = 6


def any_of(words: list[str]) -> str:
    """A pattern of any of the words, longest first, as a tree: each place is tried once a letter, not once a word."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def write(at: dict) -> str:
        kept = {c: (re.escape(c) if c != " " else c) + write(below) for c, below in sorted(at.items()) if c}
        more = list(kept.values())
        if len(more) > _FEW:  # a wide choice is made in two steps
            firsts = list(kept)
            parts = [firsts[k : k + _FEW] for k in range(0, len(firsts), _FEW)]
            more = [f"(?=[{''.join(map(re.escape, part))}])(?:{'|'.join(kept[c] for c in part)})" for part in parts]
        if not more:
            return ""
        if len(more) == 1 and "" not in at:
            return more[0]
        return f"(?:{'|'.join(more)})" + ("?" if "" in at else "")

    return write(tree)
