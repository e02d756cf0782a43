"""Fragments for the check SQL: exact sums and safe ratios."""

from __future__ import annotations

M = "DECIMAL(20,6)"


def m(x: str) -> str:
    return f"CAST({x} AS {M})"


def dsum(x: str, where: str | None = None) -> str:
    """Decimal sum, zero when empty."""
    flt = f" FILTER (WHERE {where})" if where else ""
    return f"coalesce(sum({m(x)}){flt}, CAST(0 AS {M}))"


def fsum(x: str, where: str | None = None) -> str:
    return f"CAST({dsum(x, where)} AS DOUBLE)"


def cnt(where: str) -> str:
    return f"count(*) FILTER (WHERE {where})"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def avg(x: str, where: str | None = None) -> str:
    flt = f" FILTER (WHERE {where})" if where else ""
    return div(f"sum({m(x)}){flt}", f"count({x}){flt}")


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


NA_LIST = ", ".join("'" + t.replace("'", "''") + "'" for t in (
    "", "-", "n/a", "na", "nan", "null", "none", "<na>", "<nat>", "<null>", "inconnu", "non renseigné",
    "non renseigne", "aucun", "aucune", "aucune information", "aucune donnée", "aucune donnee",
    "aucune donnée renseignée", "aucune donnee renseignee"))
BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '[\\s\\x{{00A0}}]+', ' ', 'g')")


def norm(x: str) -> str:
    return squeeze(f"lower(replace(strip_accents({x}), '_', ' '))")
