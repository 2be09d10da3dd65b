"""Text expressions with the reference semantics of Unicode: blanks, words, case folding.

All expressions are null for null text. Blanks are the 29 white-space characters of Python's
``str.split`` (Java's Unicode ``\\s`` and U+001C to U+001F); word characters are letters, numbers
and the underscore.
"""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"(?U)[\s\x1c-\x1f]"


@cache
def fold_table() -> dict[str, str]:
    """Characters whose full case folding isn't their lower case, by rule from Python's tables."""
    out = {}
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        low = c.lower()
        if c == low and (f := c.casefold()) != c:
            out[c] = f
    return out


def casefold(text: Column) -> Column:
    """Full case folding. Only texts that hold one of the exceptional characters pay for more than ``lower``."""
    low = F.lower(text)
    table = fold_table()
    pattern = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in table) + "]"
    full = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(_map(), c), c)), "")
    return F.when(~low.rlike(r"[^\x00-\x7F]"), low).when(low.rlike(pattern), full).otherwise(low)


@cache
def _map_items() -> tuple:
    return tuple(x for kv in fold_table().items() for x in kv)


def _map() -> Column:
    return F.create_map(*[F.lit(x) for x in _map_items()])


def strip(text: Column) -> Column:
    """Text without outer blanks."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def is_blank(text: Column) -> Column:
    """Whether text has no character but blanks."""
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def words(text: Column) -> Column:
    """Blank-separated words; empty for blank text."""
    return F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")


def normalised(text: Column) -> Column:
    """Folded text whose runs of other characters than word characters are one space, trimmed."""
    return F.trim(F.regexp_replace(casefold(text), r"[^\p{L}\p{N}_]+", " "))


def has_phrase(page: Column, phrase: Column) -> Column:
    """Whether a normalised page holds a normalised phrase as whole words."""
    return F.contains(F.concat(F.lit(" "), page, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


# Formats of versions, commits, slugs, identifiers and checksums.
FORMATS = {
    "semver": r"(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-[0-9A-Za-z.-]+)?",
    "commit": r"(?:[a-f0-9]{40}|[a-f0-9]{64})",
    "slug": r"[a-z0-9]+(?:[._-][a-z0-9]+)*",
    "identifier": r"[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*",
    "sha256": r"[a-f0-9]{64}",
}


def matches_format(text: Column, name: str) -> Column:
    """Whether the whole text has the format; a final line break doesn't pass."""
    return text.rlike(f"^(?:{FORMATS[name]})\\z")
