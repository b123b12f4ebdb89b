"""Tolerant parsing and text folding."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Column | str) -> Column:
    """NaN and infinities become NULL."""
    v = _c(value).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def parse_number(text: Column | str) -> Column:
    """Text to a finite double, else NULL."""
    return finite(_c(text).try_cast("double"))


def parse_integer(text: Column | str) -> Column:
    """Text to the nearest whole number (halves to even), else NULL."""
    return F.rint(parse_number(text)).cast("bigint")


def parse_boolean(text: Column | str) -> Column:
    t = F.lower(F.trim(_c(text).cast("string")))
    return F.when(t.isin("true", "1", "yes"), F.lit(True)).when(t.isin("false", "0", "no"), F.lit(False))


def parse_timestamp(text: Column | str) -> Column:
    return F.try_to_timestamp(_c(text))


@lru_cache(maxsize=1)
def _folding_tables() -> tuple[str, str, str]:
    """Compatibility decomposition without marks, from the Unicode rule itself.

    Characters that fold to one character become a ``translate`` pair; those that fold to
    several are listed as a regular expression class.
    """
    one_from, one_to, several = [], [], []
    for point in range(0x80, 0x10000):
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF:
            continue  # Hangul syllables and surrogates take the exact path below
        ch = chr(point)
        if unicodedata.combining(ch):
            continue
        folded = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)).upper()
        if folded == ch or not folded:
            continue
        if len(folded) == 1:
            one_from.append(ch)
            one_to.append(folded)
        else:
            several.append(point)
    several += range(0xAC00, 0xD7A4)
    several += range(0x10000, 0x110000)
    return "".join(one_from), "".join(one_to), _char_class(sorted(several))


def _char_class(points: list[int]) -> str:
    """Class of the given characters; the outer bound lets other characters fail at once."""
    spans: list[list[int]] = []
    for point in points:
        if spans and spans[-1][1] == point - 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    inner = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)
    return f"[\\x{{{points[0]:X}}}-\\x{{10FFFF}}&&[{inner}]]"


@lru_cache(maxsize=1)
def _mark_class() -> str:
    """Regular expression class of all characters with a combining class."""
    return _char_class([p for p in range(0x300, 0x20000) if unicodedata.combining(chr(p))]) + "+"


_PAGE = 64


@lru_cache(maxsize=1)
def _unfolded() -> tuple[str, str]:
    """Letters of all characters that unfold to several, by code point, from the Unicode rule.

    Pages of 64 code points that have such a character stand one after the other, each character with its letters or
    itself. The first list has, for every page, its number among them, or nothing.
    """
    found: dict[int, str] = {}
    for point in (*range(0x80, 0xD800), *range(0xE000, 0x30000)):
        ch = chr(point)
        letters = unicodedata.normalize("NFKD", ch)
        if letters != ch and (point > 0xFFFF or len(letters) > 1):
            bare = "".join(c for c in letters if not unicodedata.combining(c)).upper()
            if point > 0xFFFF or len(bare) > 1:
                found[point] = bare
    used = sorted({point // _PAGE for point in found})
    places = {page: str(i) for i, page in enumerate(used)}
    letters = [found.get(point, chr(point)) for page in used for point in range(page * _PAGE, (page + 1) * _PAGE)]
    return "\x01".join(places.get(page, "") for page in range(used[-1] + 1)), "\x01".join(letters)


def _decompose(text: Column, several: str) -> Column:
    """Characters of the class ``several`` spelled out: each is looked up by its code point, the stretches between stay whole."""
    pages, letters = (F.split(F.lit(x), "\x01") for x in _unfolded())
    parts = F.regexp_extract_all(text, F.lit(f"{several}|[^{several[1:]}+"), F.lit(0))

    def spelled(part: Column) -> Column:
        point = F.ascii(part)
        page = F.get(pages, F.shiftright(point, 6)).try_cast("int")
        return F.when(F.char_length(part) == 1, F.coalesce(F.get(letters, page * _PAGE + point % _PAGE), part)).otherwise(part)

    return F.concat_ws("", F.transform(parts, spelled))


def fold_text(text: Column | str) -> Column:
    """Upper case, no accents, single blanks; compatibility characters are spelled out.

    Expressions do all of it. Only texts with a character that unfolds to several (a ligature,
    an ellipsis) are taken apart, and only such characters are looked up.
    """
    one_from, one_to, several = _folding_tables()
    raw = _c(text)
    ascii_only = ~raw.rlike(r"[^\x00-\x7F]")
    whole = F.when(~ascii_only & raw.rlike(several), _decompose(raw, several)).otherwise(raw)
    plain = F.translate(F.upper(whole), one_from, one_to)
    unmarked = F.when(ascii_only, F.upper(raw)).otherwise(F.regexp_replace(plain, _mark_class(), ""))
    return F.trim(F.regexp_replace(unmarked, r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{2028}\x{2029}]+", " "))


def fold_name(text: str) -> str:
    """The same folding for one Python string, used for column headers."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(bare.upper().split())
