"""One consistent form for text whose characters differ but look the same.

Two forms are made of every distinct non-ASCII value:

* ``text_norm``: what is seen. Default-ignorable characters are removed, every kind of space
  becomes the ordinary one (runs collapse, ends are trimmed), compatibility characters that
  look like their plain letter (full-width, half-width, font, presentation and no-break forms)
  are replaced, accents are composed, and look-alike letters of another alphabet among Latin
  letters of one token become the Latin letter, as do phonetic letters that look like a plain one.
  Raised and lowered figures, fractions and circled signs keep their form: they look different from
  plain figures.
* ``match_key``: ``text_norm`` fully case-folded, for comparisons that disregard case.

Making the form notes which of its steps found something to do: a value is plain if none of those
that make a text look like another did (see ``CHANGES``). Which letters look alike isn't listed here:
:func:`look_alikes` takes it from the confusable skeletons of the Unicode library that Spark ships.

Values are normalised in bulk: the distinct ones of a batch are one long string to the normaliser. Nulls
stay null; an empty or blank text becomes the empty string.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters of the Unicode property Default_Ignorable_Code_Point.
IGNORABLE = '\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff'
# Spaces other than U+0020 (White_Space property, and the braille blank).
SPACES = '\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2800'
# Accents that stand as characters of their own.
ACCENTS = '\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f'
# Full-width letters, digits and signs.
FULL_WIDTH = '\uff01-\uff5e\uffe0-\uffe6'
# Kinds of compatibility decomposition whose result looks different.
KEPT_FORMS = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>")

# First word of the names of letters of alphabets that are mixed with the Latin one.
ALPHABETS = frozenset({"ARMENIAN", "ARABIC", "CHEROKEE", "COPTIC", "CYRILLIC", "GEORGIAN", "GLAGOLITIC", "GOTHIC", "GREEK", "HEBREW", "LISU", "TIFINAGH"})
# Blocks of phonetic letters of the Latin alphabet.
PHONETIC = ((0x250, 0x2AF), (0x1D00, 0x1DBF), (0xA730, 0xA731))
#: Steps that make a value not plain.
CHANGES = ("ignorable", "space", "width", "accent", "alphabet")

_IGNORABLE = re.compile(f"[{IGNORABLE}]+")
_SPACES = re.compile(f"[ {SPACES}]+")
_OTHER_SPACE = re.compile(f"[{SPACES}]")
_ACCENT = re.compile(f"[{ACCENTS}]")
_WIDE = re.compile(f"[{FULL_WIDTH}]")
_LETTERS = re.compile("[^\x00-\u024f]")
#: For the JVM: whether a text needs more than ASCII case folding.
UNUSUAL = r"[^\x20-\x7E]"
#: Stands between values while they are normalised together.
_BETWEEN = "\x00"


@lru_cache(65536)
def script(char: str) -> str:
    """First word of a letter's Unicode name (``LATIN``, ``GREEK``, ...); empty for other characters."""
    if not char.isalpha():
        return ""
    name = unicodedata.name(char, "")
    if name.startswith(("FULLWIDTH", "HALFWIDTH")):
        name = name.partition(" ")[2]
    return name.partition(" ")[0]


def mixes_alphabets(text: str) -> bool:
    """Whether a Greek, Cyrillic or other alphabet's letter stands among Latin letters.
    Ideographs and syllables are no alphabet."""
    kinds = {script(c) for c in text}
    return "LATIN" in kinds and not kinds.isdisjoint(ALPHABETS)


def _phonetic(char: str) -> bool:
    return any(a <= ord(char) <= b for a, b in PHONETIC)


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letter to the Latin letter that looks the same, made once a session on the driver.

    Two letters look the same if their confusable skeletons are equal; of several Latin letters the one of the
    same case is taken, plain ones first. Letters that only resemble a figure, a sequence or another letter that isn't
    Latin have none. Phonetic letters of the Latin alphabet become plain ones, except for ``i`` and ``j``, whose dot
    is to be seen."""
    known = getattr(spark, "_quire_look_alikes", None)
    if known is None:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker
        checks = checker.Builder().setChecks(checker.CONFUSABLE).build()
        letters = [c for c in map(chr, range(0x20000)) if script(c) == "LATIN" or script(c) in ALPHABETS]
        skeletons = checks.getSkeleton("\n".join(letters)).split("\n")
        latin: dict = {}
        for c, form in zip(letters, skeletons, strict=True):  # in order of code points: plain letters come first
            if script(c) == "LATIN" and form[0].isalpha() and not unicodedata.decomposition(c).startswith("<"):
                latin.setdefault((form, unicodedata.category(c)), c)
                latin.setdefault(form, c)
        known = {}
        for c, form in zip(letters, skeletons, strict=True):
            to = latin.get((form, unicodedata.category(c)), latin.get(form))
            if to and to != c and (script(c) != "LATIN" or (_phonetic(c) and to.isascii() and to not in "ij")):
                known[c] = to
        spark._quire_look_alikes = known
    return known


class _Compatible(dict):
    """Code point to what is seen, for ``str.translate``; filled as characters come."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        kind = unicodedata.decomposition(char).partition(" ")[0]
        self[code] = seen = unicodedata.normalize("NFKC", char) if kind.startswith("<") and kind not in KEPT_FORMS else char
        return seen


_COMPATIBLE = _Compatible()


def forms_of(values: list[str], look: dict[str, str]) -> tuple[list[str], np.ndarray]:
    """``text_norm`` of every value, and by value and ``CHANGES`` whether the step found something."""
    if any(_BETWEEN in v for v in values):  # such values are normalised between their own pieces
        pieces = [v.split(_BETWEEN) for v in values]
        seen, steps = forms_of([p for own in pieces for p in own], look)
        ends = np.cumsum([len(p) for p in pieces])
        return [_BETWEEN.join(seen[b - len(p) : b]) for p, b in zip(pieces, ends)], np.array([steps[b - len(p) : b].any(0) for p, b in zip(pieces, ends)], bool).reshape(-1, len(CHANGES))
    found = np.zeros((len(values), len(CHANGES)), bool)
    if not values:
        return [], found

    def step(pattern: re.Pattern, name: str, texts: list[str], whole: str) -> None:
        if pattern.search(whole):
            found[:, CHANGES.index(name)] = [pattern.search(t) is not None for t in texts]

    whole = _BETWEEN.join(values)
    step(_IGNORABLE, "ignorable", values, whole)
    step(_OTHER_SPACE, "space", values, whole)
    step(_WIDE, "width", values, whole)
    step(_ACCENT, "accent", values, whole)
    # ignorables first: spaces on either side of one are one run
    whole = _SPACES.sub(" ", _IGNORABLE.sub("", whole))
    if not whole.isascii():
        whole = unicodedata.normalize("NFC", whole.translate(_COMPATIBLE))
    seen = whole.split(_BETWEEN)
    if _LETTERS.search(whole):
        mixed = [not t.isascii() and mixes_alphabets(t) for t in seen]
        # signs such as the micro sign are no letters of another alphabet, though their form is one
        found[:, CHANGES.index("alphabet")] = [not v.isascii() and mixes_alphabets(v) for v in values]
        seen = [t if t.isascii() else unicodedata.normalize("NFC", "".join(look.get(c, c) if m or script(c) == "LATIN" else c for c in t)) for t, m in zip(seen, mixed)]
    seen = [_SPACES.sub(" ", t).strip(" ") for t in seen]
    # of blank values only those with something invisible aren't plain
    found[[not t for t in seen], 1:] = False
    return seen, found


def keys_of(seen: list[str], look: dict[str, str]) -> list[str]:
    """``match_key`` of values of ``text_norm``: folded and brought into the one form again (folding can split characters)."""
    return forms_of([t.casefold() for t in seen], look)[0]


def visible_form(text: str | None, look: dict[str, str]) -> str | None:
    """The one form of texts that look the same; see the module."""
    return None if text is None else forms_of([text], look)[0][0]


def match_key(text: str | None, look: dict[str, str]) -> str | None:
    """:func:`visible_form` under full case folding."""
    return None if text is None else keys_of(forms_of([text], look)[0], look)[0]


def not_plain(text: str | None, look: dict[str, str]) -> bool:
    """Whether a step of ``CHANGES`` found something in a token. Null and blank ones count as plain."""
    return text is not None and bool(forms_of([text], look)[1].any())


def forms(text: Column, look: dict[str, str]) -> Column:
    """Struct ``text_norm, match_key, plain`` of a text; nulls for null. Every distinct value of a batch is
    normalised once, so a value that holds a third of the rows is neither shuffled nor done again and again."""

    @F.pandas_udf("text_norm string, match_key string, plain boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        codes, values = pd.factorize(texts)
        seen, steps = forms_of(list(values), look)
        known = pd.DataFrame({"text_norm": seen, "match_key": keys_of(seen, look), "plain": ~steps.any(1)}, dtype=object)
        return known.reindex(codes).reset_index(drop=True)  # code -1, a null, has no row

    return run(text)


def ascii_form(text: Column) -> Column:
    """``text_norm`` of printable ASCII, inside the JVM."""
    return F.trim(F.regexp_replace(text, " {2,}", " "))


def normalised(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with ``text_norm``, ``match_key`` and ``plain`` beside every row, in one scan without a shuffle.

    Printable ASCII is handled by built-in functions; only other values reach Python. Columns of those names in ``df``
    are replaced. A null text gives nulls and plain = true.
    """
    df = df.drop("text_norm", "match_key", "plain", "_form")
    text = F.col(column)
    unusual = F.coalesce(text.rlike(UNUSUAL), F.lit(False))
    rows = df.withColumn("_form", forms(F.when(unusual, text), look_alikes(df.sparkSession)))
    usual = lambda c, own: F.when(unusual, F.col(f"_form.{c}")).otherwise(own).alias(c)
    return rows.select(*df.columns, usual("text_norm", ascii_form(text)), usual("match_key", F.lower(ascii_form(text))), usual("plain", F.lit(True)))


def unusual_tokens(tokens: DataFrame) -> DataFrame:
    """``document_id, page_index, token_index`` of the non-blank tokens that aren't in plain
    form, each once however often its row was sent. Only values with other characters than printable ASCII are
    normalised; all others are plain."""
    keys = ["document_id", "page_index", "token_index"]
    few = tokens.where(F.col("text").rlike(UNUSUAL))
    return few.select(*keys, forms(F.col("text"), look_alikes(tokens.sparkSession)).alias("form")).where("NOT form.plain").select(*keys).distinct()
