"""Table-level cleaning: missing values, case, types, replacements, column merges and schema harmonisation."""

from __future__ import annotations

import logging
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.functions import text as X
from comptoir.functions import values as V
from comptoir.operators.common import text_columns
from comptoir.sources.contracts import coalesce_named, header_key

log = logging.getLogger(__name__)

STRICT_NA = ("<na>", "<NA>", "NaN", "nan", "NAN", "None", "NONE", "none")  # fixed values


def targets(df: DataFrame, columns: str | Sequence[str] | None, text_only: bool = True) -> list[str]:
    """Requested columns that exist; all (text) columns when none are named."""
    if columns is None:
        return text_columns(df) if text_only else list(df.columns)
    wanted = [columns] if isinstance(columns, str) else list(dict.fromkeys(columns))
    absent = [c for c in wanted if c not in df.columns]
    if absent:
        log.warning("columns not found: %s", absent)
    return [c for c in wanted if c in df.columns]


def _rewrite(df: DataFrame, columns: Sequence[str], change) -> DataFrame:
    return df.withColumns({c: change(F.col(c)) for c in columns}) if columns else df


def clear_missing(df: DataFrame, columns: str | Sequence[str] | None = None) -> DataFrame:
    """Texts that stand for "no value" become null."""
    return _rewrite(df, targets(df, columns), X.clear_na_like)


def blank_strict_missing(df: DataFrame) -> DataFrame:
    """Only technical null markers are cleared; text columns end up empty instead of null, others untouched."""
    def change(c: Column) -> Column:
        stripped = X.strip(c)
        return F.when(stripped.isin(*STRICT_NA) | stripped.isNull(), "").otherwise(stripped)

    return _rewrite(df, text_columns(df), change)


def normalize_values(df: DataFrame, columns: str | Sequence[str], case: str = "title",
                     remove_accents: bool = False) -> DataFrame:
    return _rewrite(df, targets(df, columns), lambda c: X.normalize_case(c, case, remove_accents))


def title_values(df: DataFrame, columns: str | Sequence[str] | None = None) -> DataFrame:
    return _rewrite(df, targets(df, columns), lambda c: F.when(X.is_na_like(c), "").otherwise(X.title(X.strip(c))))


def capitalize_values(df: DataFrame, columns: str | Sequence[str] | None = None) -> DataFrame:
    return _rewrite(df, targets(df, columns), lambda c: F.when(X.is_na_like(c), "").otherwise(X.capitalize(X.strip(c))))


def uppercase_values(df: DataFrame, columns: str | Sequence[str] | None = None) -> DataFrame:
    return _rewrite(df, targets(df, columns), lambda c: F.when(~X.is_na_like(c), F.upper(X.strip(c))))


def clean_values(df: DataFrame, columns: str | Sequence[str] | None = None, case: str = "none",
                 remove_accents: bool = False, convert_types: bool = False) -> DataFrame:
    """Missing markers to null, spaces squeezed, optional accents off and case; optionally type the columns."""
    if case not in X.CASES:
        raise ValueError(f"case must be one of {sorted(X.CASES)}")
    names = targets(df, columns)

    def change(c: Column) -> Column:
        text = X.squeeze(X.clear_na_like(c))
        return X.CASES[case](X.strip_accents(text) if remove_accents else text)

    cleaned = _rewrite(df, names, change)
    return convert_columns(cleaned, names) if convert_types else cleaned


def convert_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns whose every value is a number, or else a date, take that type.

    A Spark column has one type, so the choice is made per column from one counting pass over the table.
    """
    if not columns:
        return df
    tried = V.parse_dates(df, {f"__d{i}": c for i, c in enumerate(columns)}, "fr")
    kinds = []
    for i, c in enumerate(columns):
        number = V.to_number(F.col(c))
        kinds += [F.count(F.col(c)).alias(f"n{i}"), F.count(number).alias(f"x{i}"),
                  F.count(F.when(number == F.rint(number), 1)).alias(f"i{i}"), F.count(f"__d{i}").alias(f"d{i}")]
    found = tried.agg(*kinds).first()
    numbers, dates = {}, []
    for i, c in enumerate(columns):
        present = found[f"n{i}"]
        if present and found[f"x{i}"] == present:
            number = V.to_number(F.col(c))
            numbers[c] = number.cast("bigint") if found[f"i{i}"] == present else number
        elif present and found[f"d{i}"] == present:
            dates.append(c)
    typed = df.withColumns(numbers) if numbers else df
    return V.parse_dates(typed, {c: c for c in dates}, "fr", "pandas_date") if dates else typed


def convert_dates(df: DataFrame, columns: str | Sequence[str], lang: str = "en", output: str = "datetime") -> DataFrame:
    return V.parse_dates(df, {c: c for c in targets(df, columns, text_only=False)}, lang, output)


def convert_times(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    return _rewrite(df, targets(df, columns, text_only=False), V.to_clock)


def convert_integers(df: DataFrame, columns: str | Sequence[str] | None = None, rounded: bool = True) -> DataFrame:
    convert = V.round_to_int if rounded else V.truncate_to_int
    return _rewrite(df, targets(df, columns, text_only=False), convert)


# --- replacement rules ----------------------------------------------------------------------------------------

class RuleConflict(ValueError):
    """Two replacement rules give one value different results."""


def check_rules(rules: DataFrame, by_variable: bool = False) -> DataFrame:
    """Reject empty or contradictory rules (columns ``original``, ``renamed`` and, if asked, ``variable``)."""
    keys = ["original", *(["variable"] if by_variable else [])]
    lacking = [c for c in (*keys, "renamed") if c not in rules.columns]
    if lacking:
        raise ValueError(f"replacement rules lack the columns {lacking}")
    clean = rules.select(*[X.strip(F.col(c)).alias(c) for c in (*keys, "renamed")])
    empty = clean.where(" OR ".join(f"coalesce({c}, '') = ''" for c in clean.columns))
    if not empty.isEmpty():
        raise ValueError("a replacement rule has an empty essential value")
    clash = clean.groupBy(*keys).agg(F.count_distinct("renamed").alias("n")).where("n > 1")
    if not clash.isEmpty():
        raise RuleConflict("contradictory replacement rules")
    return clean.distinct()


def replace_exact(df: DataFrame, rules: DataFrame, columns: str | Sequence[str] | None = None) -> DataFrame:
    """Replace whole cell values by an equi-join with the rule table, once per column."""
    out = df
    for c in targets(df, columns):
        table = rules.select(F.col("original").alias("__from"), F.col("renamed").alias("__to"))
        joined = out.join(table, out[c] == table["__from"], "left")
        out = joined.select(*[
            (F.coalesce(F.col("__to"), F.col(n)).alias(n) if n == c else F.col(n)) for n in df.columns])
    return out


def check_patterns(patterns: Sequence[str]) -> list[tuple[str, str]]:
    """Patterns that do not compile, with the reason."""
    bad = []
    for pattern in patterns:
        try:
            re.compile(pattern)
        except re.error as error:
            bad.append((pattern, str(error)))
    return bad


def replace_by_rules(df: DataFrame, criteria: Mapping[str, str],
                     rules: Sequence[tuple[str, str, str]], regex: bool = True,
                     lower_before: bool = True) -> DataFrame:
    """Rules ``(variable, original, renamed)`` applied to the columns of ``criteria`` (column to variable).

    Rules are few and known to the driver, so they become one chain of conditions per column. The first
    rule whose pattern covers the whole value wins; patterns that do not compile are left out.
    """
    changes = {}
    for column, variable in criteria.items():
        mine = [(o.strip(), r.strip()) for v, o, r in rules if v.strip().lower() == variable.strip().lower()]
        if column not in df.columns or not mine:
            continue
        value = X.strip(F.col(column).cast("string"))
        value = F.lower(value) if lower_before else value
        chain = F.when(value.isNull(), None)
        broken = {p for p, _ in check_patterns([o for o, _ in mine])} if regex else set()
        for original, renamed in mine:
            if regex and original not in broken:
                chain = chain.when(value.rlike(f"(?iu)^(?:{original})$"), renamed)
            elif not regex:
                chain = chain.when(value == (original.lower() if lower_before else original), renamed)
        changes[column] = chain.otherwise(value)
    return df.withColumns(changes) if changes else df


def clean_with_rules(df: DataFrame, rules: DataFrame | None = None, case: str = "none", remove_accents: bool = False,
                     convert_types: bool = False) -> DataFrame:
    """Replacements first, then the general cleaning of all text columns."""
    replaced = replace_exact(df, rules) if rules is not None else df
    return clean_values(replaced, None, case, remove_accents, convert_types)


# --- column merges --------------------------------------------------------------------------------------------

def indel_ratio(a: str, b: str) -> float:
    """2 x common subsequence over total length: 1 for equal texts."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            kept = row[j]
            row[j] = before + 1 if x == y else max(row[j], row[j - 1])
            before = kept
    return 2 * row[-1] / (len(a) + len(b))


def similar_names(columns: Sequence[str], threshold: float = 0.9) -> dict[str, list[str]]:
    """Groups of column names that resemble their first member."""
    groups: dict[str, list[str]] = {}
    taken: set[str] = set()
    for i, first in enumerate(columns):
        if first in taken:
            continue
        group = [first] + [c for c in columns[i + 1:] if c not in taken
                           and indel_ratio(first.lower(), c.lower()) >= threshold]
        if len(group) > 1:
            groups[first] = group
            taken.update(group)
    return groups


def merged(columns: Sequence[str], how: str = "concat", separator: str = " ") -> Column:
    """One value from several cells of a row: all non-blank texts joined, or the first non-blank one."""
    parts = [X.none_if_blank(F.col(c)) for c in columns]
    if how == "concat":
        return F.nullif(F.concat_ws(separator, *parts), F.lit(""))
    if how == "first_non_null":
        return F.coalesce(*[F.when(~X.blank(F.col(c)), F.col(c).cast("string")) for c in columns])
    raise ValueError("how must be 'concat' or 'first_non_null'")


def merge_columns(df: DataFrame, groups: Mapping[str, Sequence[str]] | None = None, how: str = "concat",
                  separator: str = " ", threshold: float = 0.9, drop: bool = True) -> DataFrame:
    """Merge given groups of columns, or groups found by the similarity of their names."""
    wanted = groups if groups is not None else similar_names(df.columns, threshold)
    present = {name: [c for c in cols if c in df.columns] for name, cols in wanted.items()}
    present = {name: cols for name, cols in present.items() if len(cols) >= 2}
    gone = {c for cols in present.values() for c in cols} if drop else set()
    kept = [F.col(c) for c in df.columns if c not in gone]
    return df.select(*kept, *[merged(cols, how, separator).alias(name) for name, cols in present.items()
                              if drop or name not in df.columns])


def transfer_values(df: DataFrame, mapping: Mapping[str, str], where: Column | None = None,
                    filter_column: str | None = None, filter_values: Sequence[object] | None = None,
                    normalize_filter: bool = False, overwrite: bool = False, move: bool = False,
                    ignore_missing: bool = False) -> DataFrame:
    """Copy (or move) source values into target columns on the selected rows, by default only into blanks."""
    if any(s == t for s, t in mapping.items()) or len(set(mapping.values())) != len(mapping):
        raise ValueError("each source needs its own, different target")
    lines = where if where is not None else F.lit(True)
    if where is None and filter_column is not None and filter_values is not None:
        if filter_column not in df.columns:
            if not ignore_missing:
                raise KeyError(f"filter column not found: {filter_column}")
            lines = F.lit(False)
        elif normalize_filter:
            wanted = [F.lower(X.strip_accents(X.strip(F.lit(str(v))))) for v in filter_values]
            lines = F.coalesce(F.lower(X.strip_accents(X.strip(F.col(filter_column).cast("string")))), F.lit("")).isin(*wanted)
        else:
            lines = F.col(filter_column).isin(*filter_values)
    out = df
    for source, target in mapping.items():
        if source not in out.columns:
            if ignore_missing:
                continue
            raise KeyError(f"source column not found: {source}")
        kind = df.schema[source].dataType
        current = F.col(target) if target in out.columns else F.lit(None).cast(kind)
        moved = F.coalesce(lines, F.lit(False)) & ~X.blank(F.col(source))
        if not overwrite:
            moved = moved & X.blank(current)
        changes = {target: F.when(moved, F.col(source)).otherwise(current)}
        if move:
            changes[source] = F.when(~moved, F.col(source))
        out = out.withColumns(changes)
    return out


def harmonize(df: DataFrame, reference: Sequence[str], aliases: Mapping[str, str] | None = None, default: object = None,
              keep_extra: bool = True, add_missing: bool = True, drop_empty_rows: bool = False,
              sort_extra: bool = False, merge: Mapping[str, object] | None = None) -> DataFrame:
    """Bring a table to a reference column list: aliases folded into their target, missing columns added."""
    if not reference:
        return df
    out = merge_columns(df, **merge) if merge else df
    known = {header_key(c): c for c in reference}

    def resolve(name: str) -> str:
        if name in out.columns:
            return name
        return known.get(header_key(name)) or next((c for c in out.columns if header_key(c) == header_key(name)), name)

    pairs = {resolve(s): resolve(t) for s, t in (aliases or {}).items()}
    names = [pairs.get(c, c) for c in out.columns]
    # Targets first, so that their own values win over those of an alias.
    order = sorted(range(len(names)), key=lambda i: (out.columns[i] != names[i], i))
    moved = out.select(*[out.columns[i] for i in order])
    out = coalesce_named(moved, [names[i] for i in order])
    wanted = list(dict.fromkeys(reference))
    head = [(F.col(c) if c in out.columns else F.lit(default).alias(c)) for c in wanted if add_missing or c in out.columns]
    extra = [c for c in out.columns if c not in wanted] if keep_extra else []
    result = out.select(*head, *(sorted(extra) if sort_extra else extra))
    return result.dropna(how="all") if drop_empty_rows else result


