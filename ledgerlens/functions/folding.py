"""Text forms for comparing: one definition, as Python functions and as Catalyst expressions.

The canonical form is NFKC with invisible characters out, dashes, spaces and digits
folded and white space single; the match form folds interchangeable letters and case
too. ``canonical_text`` and ``match_text`` are the definition; the columns give the same in
the JVM, where the Unicode library that Spark brings along composes and folds. Plain
ASCII text is only lower-cased.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that the folding rules name.
ARABIC_DIGITS = "".join(chr(c) for c in [*range(0x660, 0x66A), *range(0x6F0, 0x6FA)])
ASCII_DIGITS = "0123456789" * 2
ALEF_FAMILY, ALEF = "أإآ", "ا"
ALEF_MAKSURA, YEH = "ى", "ي"
TA_MARBUTA, HEH = "ة", "ه"
# Invisible characters, dashes, spaces and marks that the canonical form folds.
_INVISIBLE = dict.fromkeys([*range(0x200B, 0x2010), *range(0x2060, 0x2070), 0xFEFF])
_DASHES = dict.fromkeys([0x00AD, 0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2212], "-")
_SPACES = dict.fromkeys([0x00A0, 0x2002, 0x2003, 0x2007, 0x2008, 0x2009, 0x202F, 0x205F, 0x3000], " ")
_TATWEEL = {0x0640: None}
_MARKS = dict.fromkeys([*range(0x064B, 0x0653), 0x0670, *range(0x06D6, 0x06EE)])
_DIGITS = dict(zip(map(ord, ARABIC_DIGITS), ASCII_DIGITS, strict=True))
_LETTERS = {ord(c): ALEF for c in ALEF_FAMILY} | {ord(ALEF_MAKSURA): YEH, ord(TA_MARBUTA): HEH}
_FOLD = _INVISIBLE | _DASHES | _SPACES | _DIGITS | _TATWEEL


def _folded(text: str, marks: bool = True) -> str:
    return unicodedata.normalize("NFKC", text).translate(_FOLD | _MARKS if marks else _FOLD)


def canonical_text(text: str | None, marks: bool = True) -> str | None:
    """NFKC, invisible characters out, dashes, spaces and digits folded, white space single."""
    if text is not None and text.isascii():  # nothing to compose or fold
        return " ".join(text.split())
    return None if text is None else re.sub(r"\s+", " ", _folded(text, marks)).strip()


def _matched(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LETTERS).casefold()


def match_text(text: str | None) -> str | None:
    """The canonical form with interchangeable letters and case folded; for comparing only."""
    return None if text is None else _matched(canonical_text(text))


def _translation(table: dict[int, str | None]) -> tuple[str, str]:
    """(from, to) as ``translate`` takes them: what is dropped comes last."""
    kept = {k: v for k, v in table.items() if v is not None}
    return "".join(map(chr, [*kept, *(k for k in table if k not in kept)])), "".join(kept.values())


def _icu(kind: str, method: str, c: Column) -> Column:
    """A static method of the Unicode library that Spark brings along."""
    return F.reflect(F.lit(f"com.ibm.icu.{kind}"), F.lit(method), c, F.lit(True))


def _form(c: Column, match: bool) -> Column:
    folded = F.translate(_icu("text.Normalizer", "compose", c), *_translation(_FOLD | _MARKS))
    full = F.trim(F.regexp_replace(folded, r"(?U)[\s\x1C-\x1F]+", " "))
    if match:
        full = _icu("lang.UCharacter", "foldCase", F.translate(full, *_translation(_LETTERS)))
    plain = F.trim(F.regexp_replace(F.lower(c) if match else c, r"[ \t\n\x0B\f\r]+", " "))
    # Most values are one plain word, and most texts plain: one test settles each.
    word = F.when(~c.rlike(r"[^\x21-\x7E]"), F.lower(c) if match else c)
    return word.when(~c.rlike(r"[^\x09-\x0D\x20-\x7E]"), plain).when(c.isNotNull(), full)


def canonical(c: Column) -> Column:
    """``canonical_text`` of a column, in the JVM."""
    return _form(c, False)


def match_form(c: Column) -> Column:
    """``match_text`` of a column, in the JVM."""
    return _form(c, True)
