"""Case, accent and umlaut folding, as Python functions and as column expressions.

The fold keeps lengths: each character becomes one, so offsets into folded text hold for
the text itself.  It is one ``translate`` with a table built from the Unicode database.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that do not decompose, by the letter they fold to.
SPECIAL = {
    "a": "æ", "b": "ƀƃɓ", "c": "ƈɕ", "d": "ðđƌǆȡɖɗ", "f": "ƒﬀﬁﬂﬃﬄ", "g": "ǥȝɠ", "h": "ħɦ", "i": "ıĳɨ", "j": "ȷɟ",
    "k": "ĸƙ", "l": "łƚǉȴɫ", "n": "ŋƞǌȵɲ", "o": "øœ", "p": "ƥ", "s": "ßſﬅﬆ", "t": "þŧƭȶ", "u": "ʉ", "y": "ƴ", "z": "ƶʐ",
}
# Code points that count as a blank.
BLANKS = (
    0x0085, 0x00A0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x200B, 0x200C, 0x200D, 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF,
)
# Two-letter spellings of umlauts and ligatures.
ALIASES = {
    "Ä": "ae", "ä": "ae", "Ö": "oe", "ö": "oe", "Ü": "ue", "ü": "ue", "ß": "ss", "ẞ": "ss", "Æ": "ae", "æ": "ae",
    "Œ": "oe", "œ": "oe",
}
# Ranges of combining marks that are dropped.
MARKS = r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃰︠-︯]"

_SPECIAL_OF = {c: base for base, chars in SPECIAL.items() for c in chars}
#: Two-letter spellings and the letter that each may stand for.
CONTRACTIONS = re.compile("ae|oe|ue|ss")


def _fold_of(code: int) -> str:
    if code < 0x20 or code == 0x7F or code in BLANKS:
        return " "
    char = chr(code)
    lowered = char.lower()
    base = unicodedata.normalize("NFD", lowered if len(lowered) == 1 else char)[0]
    base = base.lower() if base.isascii() else base
    return _SPECIAL_OF.get(base, base)


@lru_cache(1)
def fold_table() -> dict[int, str]:
    """Characters that the fold changes: Latin, Greek and Cyrillic up to U+07FF, the Latin
    additions, the special letters and the blanks."""
    codes = [*range(0x800), *range(0x1E00, 0x1F00), *map(ord, _SPECIAL_OF), *BLANKS]
    return {c: f for c in codes if (f := _fold_of(c)) != chr(c)}


@lru_cache(1)
def _pairs() -> tuple[str, str]:
    table = fold_table()
    return "".join(map(chr, table)), "".join(table.values())


def fold(text: str) -> str:
    return text.translate(fold_table())


def alias_fold(text: str) -> str:
    """The fold with umlauts and ligatures spelt out."""
    return fold(re.sub("|".join(ALIASES), lambda m: ALIASES[m[0]], text))


def fold_field(text: str) -> str:
    """The fold for titles, paths, tags and properties: composed first, marks dropped."""
    return fold(re.sub(MARKS, "", unicodedata.normalize("NFC", text)))


def fold_column(c: Column) -> Column:
    source, target = _pairs()
    return F.translate(c, source, target)


def fold_field_column(c: Column) -> Column:
    """:func:`fold_field` without an UDF: dropping marks before folding composes alike."""
    return fold_column(F.regexp_replace(c, MARKS, ""))


def _shortened(seed: str) -> Iterator[str]:
    """A spelling with each choice of its two-letter spellings contracted, the first of them
    varying fastest; the spelling itself first, the full contraction last."""
    cuts = [m.start() + 1 for m in CONTRACTIONS.finditer(seed)]
    parts = [seed[a:b] for a, b in zip([0, *cuts], [*cuts, len(seed)])]
    for drops in itertools.product((False, True), repeat=len(cuts)):
        yield parts[0] + "".join(p[d:] for p, d in zip(parts[1:], reversed(drops)))


def variants(raw: str, most: int) -> list[str]:
    """Spellings that a term matches, the plain fold first.

    After it come the spelt-out form, each with all two-letter spellings contracted, and
    each with some of them contracted, up to ``most``.  Contracted forms keep at least three
    characters; of terms with over six places only the full contraction is tried.
    """
    composed = unicodedata.normalize("NFC", raw)
    seeds = [s for s in dict.fromkeys((fold(composed), alias_fold(composed))) if s]
    fully = [CONTRACTIONS.sub(lambda m: m[0][0], s) for s in seeds if CONTRACTIONS.search(s)]
    partly = (v for s in seeds if len(CONTRACTIONS.findall(s)) <= 6 for v in _shortened(s))
    spelt = (v for v in itertools.chain(seeds, fully, partly) if v in seeds or len(v) >= 3)
    return list(dict.fromkeys(spelt))[: max(1, most)]


def words(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall("[a-z0-9]+", text)))


def words_column(c: Column) -> Column:
    """Distinct words in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), 1))


def grams(text: str, n: int = 3) -> list[str]:
    return list(dict.fromkeys(text[i : i + n] for i in range(len(text) - n + 1)))


def solid_grams(text: str, n: int = 3) -> list[str]:
    """Grams without white space."""
    return [g for g in grams(text, n) if not re.search(r"[ \t\n\r\x0b\x0c]", g)]


def grams_column(c: Column, n: int = 3) -> Column:
    """Distinct grams of a text; empty for shorter ones.

    One pass of a pattern that takes no characters, in time linear in the text; looking up each
    gram by its offset would count the characters before it every time.  Places between the two
    halves of a character beyond U+FFFF are none.
    """
    each = F.regexp_extract_all(c, F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(" + "." * n + "))"), 1)
    return F.coalesce(F.array_distinct(each), F.array().cast("array<string>"))


def utf16_length(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2
