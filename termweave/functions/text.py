"""Column functions on text: normal forms, tokens, accents.

All offsets count code points. White space is Python's ``str.isspace`` set, written out, as
the regular expression dialects differ on it.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

#: Runs of white space other than one plain space; those need no change.
ODD_SPACE = r"[\t-\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]" + SPACE + "*| " + SPACE + "+"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def casefold(text: str | Column) -> Column:
    """Lower case, with the full foldings that ``lower`` leaves."""
    low = F.lower(col(text))
    return F.replace(F.translate(low, "ςſµ", "σsμ"), F.lit("ß"), F.lit("ss"))


def strip(text: str | Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(col(text), f"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: str | Column) -> Column:
    """Runs of white space as one space each, none at the ends."""
    return F.trim(F.regexp_replace(col(text), ODD_SPACE, " "))


def normalize_text(text: str | Column) -> Column:
    """Folded and squeezed."""
    return squeeze(casefold(text))


def split_list(value: str | Column) -> Column:
    """The non-empty parts of a '|'-separated list, stripped; null gives none."""
    parts = F.transform(F.split(F.coalesce(col(value), F.lit("")), r"\|"), strip)
    return F.filter(parts, lambda x: x != "")


@cache
def _accent_table() -> tuple[str, str]:
    """Code points that canonical decomposition turns into one base sign and marks."""
    source, target = [], []
    for point in [*range(0x80, 0xAC00), *range(0xF900, 0xFFFF), *range(0x10000, 0x12000)]:
        sign = chr(point)
        parts = unicodedata.normalize("NFD", sign)
        bare = "".join(p for p in parts if unicodedata.category(p) != "Mn")
        if parts != sign and len(bare) == 1:
            source.append(sign)
            target.append(bare)
    return "".join(source), "".join(target)


def strip_diacritics(text: str | Column) -> Column:
    """Folded, without accents; the Vietnamese d with stroke becomes d."""
    source, target = _accent_table()
    bare = F.regexp_replace(F.translate(casefold(text), source, target), r"\p{Mn}", "")
    return F.translate(bare, "đ", "d")


def words_of(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda x: x != "")


def search_tokens(text: str | Column) -> Column:
    """Tokens of the normal form, with '/' and '-' as breaks."""
    return words_of(F.translate(normalize_text(text), "/-", "  "))


def term_tokens(text: str | Column) -> Column:
    """Tokens of the normal form, broken at white space alone."""
    return words_of(normalize_text(text))


# Tokens of diagnosis names that say little, and tokens of body sites.
GENERIC_TOKENS = ["bao", "benh", "cap", "chung", "da", "dai", "day", "gan", "hoi", "man", "mo", "ruot", "te", "tu", "ung", "viem"]
SITE_TOKENS = ["bao", "buong", "dai", "duong", "gan", "giap", "kich", "mat", "nghien", "ruot", "ruou", "thich", "trung", "tuyen"]


def meaningful_tokens(text: str | Column) -> Column:
    """Distinct tokens that tell diagnoses apart: not generic and longer than a sign, or of
    a body site."""
    found = F.array_distinct(F.regexp_extract_all(strip_diacritics(text), F.lit("[a-z0-9]+"), F.lit(0)))
    site = F.array(*map(F.lit, SITE_TOKENS))
    generic = F.array(*map(F.lit, GENERIC_TOKENS))
    return F.filter(found, lambda t: (~F.array_contains(generic, t) & (F.length(t) > 1)) | F.array_contains(site, t))


def natural_order(name: str | Column) -> list[Column]:
    """Order of file names: by the first run of digits of the stem (none: 10**9), then name."""
    stem = F.regexp_replace(col(name), r"\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"\d+", 0)
    return [F.coalesce(digits.try_cast("decimal(38,0)"), F.lit(10**9)).alias("number"), col(name).alias("name")]


def contains_any(text: Column, needles: list[str]) -> Column:
    return text.rlike("|".join(f"\\Q{n}\\E" for n in needles))


def starts_with_any(text: Column, starts: list[str]) -> Column:
    return text.rlike("^(?:" + "|".join(f"\\Q{s}\\E" for s in starts) + ")")
