"""Text expressions used by cleaning, matching and the rule sets."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed at both ends of a cell (Spark's plain trim only knows the space).
BLANKS = " \t\n\r\f\x0b\u00a0"
SPACE = "[\\s\\u00a0]"

# Texts that stand for "no value" in source files.
NA_TEXTS = (
    "", "-", "n/a", "na", "nan", "null", "none", "<na>", "<nat>", "<null>",
    "inconnu", "non renseigné", "non renseigne", "aucun", "aucune",
    "aucune information", "aucune donnée", "aucune donnee",
    "aucune donnée renseignée", "aucune donnee renseignee",
)


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letter, derived from the Unicode decomposition rule."""
    accented, plain = [], []
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFKD", chr(code))
        base = "".join(ch for ch in parts if not unicodedata.combining(ch))
        if parts != chr(code) and len(base) == 1:
            accented.append(chr(code))
            plain.append(base)
    return "".join(accented), "".join(plain)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def strip_accents(col: Column) -> Column:
    """Base letters only; loose combining marks are dropped as well."""
    accented, plain = accent_table()
    return F.regexp_replace(F.translate(col, accented, plain), "[\\u0300-\\u036f]", "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def squeeze(col: Column) -> Column:
    """Collapse runs of white space to one space and strip the ends."""
    return strip(F.regexp_replace(col, SPACE + "+", " "))


def normalize_label(col: Column) -> Column:
    """Comparison key of a label: no accents, lower case, underscores as spaces, single spaces."""
    return squeeze(F.lower(F.replace(strip_accents(col.cast("string")), F.lit("_"), F.lit(" "))))


def blank(col: Column) -> Column:
    """True for null or white-space-only text."""
    return F.coalesce(strip(col.cast("string")) == "", F.lit(True))


def none_if_blank(col: Column) -> Column:
    return F.nullif(strip(col.cast("string")), F.lit(""))


def is_na_like(col: Column) -> Column:
    return F.coalesce(F.lower(strip(col.cast("string"))).isin(*NA_TEXTS), F.lit(True))


def clear_na_like(col: Column) -> Column:
    return F.when(~is_na_like(col), col)


def capitalize(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substr(col, F.lit(2))))


def title(col: Column) -> Column:
    """Every run of letters starts with a capital, whatever character precedes it (``l'eau`` gives ``L'Eau``)."""
    runs = F.regexp_extract_all(col, F.lit("(\\p{L}+|[^\\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, capitalize), "")


CASES = {"upper": F.upper, "lower": F.lower, "capitalize": capitalize, "title": title, "none": lambda c: c}


def normalize_case(col: Column, case: str = "title", remove_accents: bool = False) -> Column:
    """Hyphens and underscores to spaces, single spaces, optional accents off, then the chosen case."""
    if case not in CASES:
        raise ValueError(f"case must be one of {sorted(CASES)}")
    spaced = F.regexp_replace(F.regexp_replace(strip(col), "[-_]", " "), SPACE + "+", " ")
    if remove_accents:
        spaced = strip_accents(spaced)
    return CASES[case](spaced)


def map_labels(col: Column, mapping: Mapping[str, str]) -> Column:
    """Look the normalised text up in a fixed map; an unknown text is kept, stripped."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, normalize_label(col)), strip(col.cast("string")))


def contains_any(col: Column, markers: Iterable[str]) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(col, F.lit(marker))
    return found


def first_non_empty(*cols: Column) -> Column:
    """First stripped, non-empty text; an empty text when there is none."""
    return F.coalesce(*[none_if_blank(c) for c in cols], F.lit(""))


def between_markers(col: Column, before: str, after: str) -> Column:
    """Text between two literal markers; empty when either is missing."""
    start = F.locate(before, col)
    rest = F.substr(col, start + len(before))
    end = F.locate(after, rest) if after else F.lit(1)
    found = (start > 0) & (end > 0)
    return F.when(col.isNull() | ~found, F.lit("")).otherwise(F.substr(rest, F.lit(1), end - 1))


def _words(col: Column) -> Column:
    return F.filter(F.split(col, SPACE + "+"), lambda w: w != "")


def prefix(col: Column, length: int = 1, unit: str = "mot") -> Column:
    text = none_if_blank(col)
    if unit == "mot":
        return F.when(text.isNotNull(), F.array_join(F.slice(_words(text), 1, length), " "))
    if unit == "caractere":
        return F.substring(text, 1, length)
    raise ValueError("unit must be 'mot' or 'caractere'")


def suffix(col: Column, length: int = 1, unit: str = "mot") -> Column:
    text = none_if_blank(col)
    if unit == "mot":
        words = _words(text)
        start = F.greatest(F.size(words) - length, F.lit(0)) + 1
        return F.when(text.isNotNull(), F.array_join(F.slice(words, start, F.lit(length)), " "))
    if unit == "caractere":
        return F.right(text, F.lit(length))
    raise ValueError("unit must be 'mot' or 'caractere'")


# Trailing place kinds that are not part of a place name.
PLACE_KINDS = (
    "province",
    "zone de santé", "zone de sante",
    "aire de santé", "aire de sante",
    "centre de santé", "centre de sante",
    "dispensaire",
)


def generic_name(col: Column) -> Column:
    """Drop the first word and any trailing place kinds; null for texts of at most two words."""
    words = _words(strip(col))
    body = F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    kinds = "|".join(PLACE_KINDS)
    trimmed = strip(F.regexp_replace(body, f"(?iu)(?:(?:^| )(?:{kinds}))+$", ""))
    return F.when(F.size(words) > 2, F.nullif(trimmed, F.lit("")))


def duration_unit(col: Column, default: str = "mois", detect_years: bool = True) -> Column:
    """Unit of a duration text: ``ans``, ``mois`` or ``jours``."""
    text = F.lower(strip(col.cast("string")))
    unit = F.when(text.isNull() | text.rlike("^[0-9]+$"), F.lit(default))
    if detect_years:
        unit = unit.when(text.rlike("(?U)\\b(an|ans|année|années|a)\\b"), "ans")
    unit = unit.when(text.rlike("(?U)\\b(mois|moi|m)\\b"), "mois")
    unit = unit.when(text.rlike("(?U)\\b(jour|jours|jr|jrs|j)\\b"), "jours")
    for letter, name in (("a", "ans"), ("m", "mois"), ("j", "jours")):
        unit = unit.when(F.regexp_extract(text, "(?U)[0-9]+\\s*([amj])\\b", 1) == letter, name)
    return unit.otherwise(default)


def duration_number(col: Column) -> Column:
    return F.regexp_extract(col.cast("string"), "([0-9]+)", 1).try_cast("bigint")


def hyphens_to_spaces(col: Column) -> Column:
    """Hyphens to spaces, single spaces, and the Roman numerals I, II, III as digits."""
    text = squeeze(F.replace(col, F.lit("-"), F.lit(" ")))
    for roman, digit in (("I", "1"), ("II", "2"), ("III", "3")):
        text = F.regexp_replace(text, f"(?iU)\\b{roman}\\b", digit)
    return F.when(F.length(col) > 0, text)


def underscores_to_spaces(col: Column) -> Column:
    return F.when(~is_na_like(col), title(F.lower(strip(F.translate(strip(col), "_-", "  ")))))


def spaces_to_underscores(col: Column) -> Column:
    joined = F.regexp_replace(F.regexp_replace(strip(col), SPACE + "+", "_"), "_+", "_")
    words = F.filter(F.split(joined, "_"), lambda w: w != "")
    return F.when(~is_na_like(col), F.array_join(F.transform(words, capitalize), "_"))
