"""Row filters: values, dates, ISO weeks, nulls, as-of cuts and yearly scopes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.functions import text as X
from comptoir.operators.common import has, stamp, text_columns


def filter_rows(df: DataFrame, filters: Mapping[str, Iterable[object] | None] | None = None,
                start: dt.date | None = None, end: dt.date | None = None,
                date_column: str = "date_demande") -> DataFrame:
    """Keep the listed values and the inclusive date range; an empty list or a missing column filters nothing."""
    out = df
    for column, values in (filters or {}).items():
        chosen = list(values or [])
        if chosen and column in df.columns:
            out = out.where(F.col(column).isin(*chosen))
    if date_column in df.columns and start is not None:
        out = out.where(F.col(date_column) >= F.lit(start))
    if date_column in df.columns and end is not None:
        out = out.where(F.col(date_column) < F.lit(end + dt.timedelta(days=1)))
    return out


def filter_select(df: DataFrame, condition: Column | str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    out = df.where(condition) if condition is not None else df
    return out.select(*[c for c in columns if c in df.columns]) if columns else out


def filter_first_date(df: DataFrame, columns: Sequence[str], year: int | None = None, keep: bool | str = False,
                      year_kind: str = "calendar", min_date: dt.date | None = None,
                      max_date: dt.date | None = None) -> DataFrame:
    """First non-null date in column order, cut to the day, inside the bounds and in the calendar or ISO year."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    day = F.to_date(F.coalesce(*[stamp(df, c) for c in present]))
    if min_date is not None:
        day = F.when(day >= F.lit(min_date), day)
    if max_date is not None:
        day = F.when(day <= F.lit(max_date), day)
    if year_kind not in ("calendar", "iso"):
        raise ValueError("year_kind must be 'calendar' or 'iso'")
    name = keep if isinstance(keep, str) else "Premiere_date"
    dated = df.withColumn(name, day)
    if year is None:
        out = dated.where(F.col(name).isNotNull())
    else:
        found = F.year(name) if year_kind == "calendar" else F.extract(F.lit("YEAROFWEEK"), F.col(name))
        out = dated.where(found == year)
    return out if keep else out.drop(name)


def _check_week(week: int) -> None:
    if not 1 <= int(week) <= 53:
        raise ValueError("an ISO week is between 1 and 53")


def filter_weeks(df: DataFrame, column: str, weeks: int | list | tuple | None, condition: Column | None = None,
                 columns: Sequence[str] | None = None, sort: Sequence[str] | None = None,
                 ascending: bool = True) -> DataFrame:
    """One week, a list of weeks, or an open or closed range ``(first, last)``; then subset and sort."""
    week = F.col(column).try_cast("int")
    out = df
    if isinstance(weeks, bool):
        raise TypeError("weeks must be an int, a list or a tuple")
    if isinstance(weeks, int):
        _check_week(weeks)
        out = out.where(week == weeks)
    elif isinstance(weeks, list):
        for w in weeks:
            _check_week(w)
        out = out.where(week.isin(*[int(w) for w in weeks]))
    elif isinstance(weeks, tuple):
        first, last = (weeks + (None,))[:2]
        for w in (first, last):
            if w is not None:
                _check_week(w)
        if first is not None:
            out = out.where(week >= first)
        if last is not None:
            out = out.where(week <= last)
    elif weeks is not None:
        raise TypeError("weeks must be an int, a list or a tuple")
    out = filter_select(out, condition, columns)
    keys = [c for c in sort or [] if c in out.columns]
    return out.orderBy(*keys, ascending=ascending) if keys else out


def filter_nulls(df: DataFrame, columns: Sequence[str], mode: str = "notnull") -> DataFrame:
    """``notnull``: all the columns filled; ``isnull``: at least one empty."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df.limit(0)
    if mode == "notnull":
        return df.dropna(how="any", subset=present)
    if mode == "isnull":
        condition = F.lit(False)
        for c in present:
            condition = condition | F.col(c).isNull()
        return df.where(condition)
    raise ValueError("mode must be 'notnull' or 'isnull'")


def filter_iso_window(df: DataFrame, first: int, last: int, year: int | None = None,
                      week_column: str = "Num_semaine_epid", year_column: str = "Annee_epid") -> DataFrame:
    _check_week(first), _check_week(last)
    if first > last:
        raise ValueError("the first week comes after the last")
    out = df.where(F.col(week_column).try_cast("int").between(first, last))
    return out if year is None else out.where(F.col(year_column).try_cast("int") == year)


def filter_iso_window_across_years(df: DataFrame, first_year: int, first_week: int, last_year: int, last_week: int,
                                   week_column: str = "Num_semaine_epid", year_column: str = "Annee_epid") -> DataFrame:
    """Rows of the first year from its week on, and of the last year up to its week."""
    _check_week(first_week), _check_week(last_week)
    if (first_year, first_week) > (last_year, last_week):
        raise ValueError("the window starts after it ends")
    week, year = F.col(week_column).try_cast("int"), F.col(year_column).try_cast("int")
    if first_year == last_year:
        return df.where((year == first_year) & week.between(first_week, last_week))
    return df.where(((year == first_year) & (week >= first_week)) | ((year == last_year) & (week <= last_week)))


def filter_completion(df: DataFrame, start: dt.datetime | dt.date | None = None, end: dt.datetime | dt.date | None = None,
                      column: str = "completion_time") -> DataFrame:
    """Inclusive date and time window; a bound without a time covers the whole day."""
    time = stamp(df, column)
    out = df
    if start is not None:
        out = out.where(time >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        if isinstance(end, dt.datetime):
            out = out.where(time <= F.lit(str(end)).cast("timestamp_ntz"))
        else:
            out = out.where(time < F.lit(end + dt.timedelta(days=1)).cast("timestamp_ntz"))
    return out


def filter_direction(df: DataFrame, directions: Sequence[str] = (), column: str = "sens_flux") -> DataFrame:
    return df.where(F.col(column).isin(*directions)) if directions else df


def _first_of(df: DataFrame, columns: Sequence[str]) -> Column:
    present = [stamp(df, c) for c in columns if c in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("timestamp_ntz")


def as_of(df: DataFrame, day: dt.date, columns: Sequence[str]) -> DataFrame:
    """Rows dated up to the day, and undated rows; the date is the first one available."""
    date = _first_of(df, columns)
    return df.where(date.isNull() | (date < F.lit(day + dt.timedelta(days=1)).cast("timestamp_ntz")))


def scope_years(df: DataFrame, first_year: int, last_year: int, columns: Sequence[str], stock: bool) -> DataFrame:
    """Flows strictly inside the years; stock positions created before their end, or undated."""
    date = _first_of(df, columns)
    before_end = date < F.lit(dt.date(last_year + 1, 1, 1)).cast("timestamp_ntz")
    if stock:
        return df.where(date.isNull() | before_end)
    return df.where((date >= F.lit(dt.date(first_year, 1, 1)).cast("timestamp_ntz")) & before_end)


def latest_complete_day(*dates: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Latest day of all sources; the day before it when the newest time stamp is earlier than 18:00."""
    bounds = None
    for df, columns in dates:
        date = _first_of(df, columns)
        one = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
        bounds = one if bounds is None else bounds.unionByName(one)
    whole = bounds.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    day = F.to_date("hi")
    early = (F.to_date("lo") < day) & (F.hour("hi") < 18)
    return whole.select(F.when(early, F.date_sub(day, 1)).otherwise(day).alias("jour"))


# --- compliance and table filters -----------------------------------------------------------------------------

# Element type label by line type.
ELEMENT_LABELS = {
    "REPORTING": "Reporting agrege", "MOUVEMENT_OPERATION": "Mouvement",
    "REMBOURSEMENT_ANTICIPE": "Remboursement anticipe", "ALERTE": "Alerte", "DECLARATION": "Declaration",
    "PROFIL_RISQUE": "Profil de risque", "BLACKLIST": "Sanction", "REACTIVATION_COMPTE": "Reactivation de compte",
    "CONTROLE_QUALITE": "Controle qualite", "SYNTHESE_FLUX": "Synthese des flux", "FRACTIONNEMENT": "Fractionnement",
    "COUVERTURE": "Couverture", "GROS_MOUVEMENT_AGREGE": "Gros mouvement agrege",
}


def fold(col: Column) -> Column:
    """Accents off, lower case, stripped; null becomes empty."""
    return F.coalesce(X.strip(F.lower(X.strip_accents(col.cast("string")))), F.lit(""))


def compliance_condition(df: DataFrame, analysis_prefix: str | None = None, line_type: str | None = None) -> Column:
    condition = F.lit(True)
    if analysis_prefix:
        column = next((c for c in ("analyse", "analyse_source") if c in df.columns), None)
        if column:
            condition = condition & F.coalesce(F.startswith(F.col(column), F.lit(analysis_prefix[:3])), F.lit(False))
    if line_type:
        if has(df, "type_element"):
            label = ELEMENT_LABELS.get(line_type.upper(), line_type)
            condition = condition & (fold(F.col("type_element")) == fold(F.lit(label)))
        elif has(df, "type_ligne"):
            condition = condition & F.coalesce(F.upper("type_ligne") == line_type.upper(), F.lit(False))
    return condition


def compliance_subset(df: DataFrame, analysis_prefix: str | None = None, line_type: str | None = None) -> DataFrame:
    return df.where(compliance_condition(df, analysis_prefix, line_type))


def filter_options(df: DataFrame, column: str, max_options: int | None = None) -> DataFrame:
    """Distinct non-empty texts in case-insensitive order: the choices a selection list shows; all of them without ``max_options``."""
    value = X.none_if_blank(F.col(column)).alias("valeur")
    options = df.select(value).where(F.col("valeur").isNotNull()).distinct().orderBy(F.lower("valeur"), "valeur")
    return options if max_options is None else options.limit(max_options)


def pick_filter_columns(df: DataFrame, preferred: Sequence[str] = (), max_columns: int | None = None,
                        max_unique: int | None = None) -> list[str]:
    """Preferred columns, then text columns with two values or more; ``max_unique`` values and ``max_columns`` columns at most where given.

    One pass finds the columns of one value (least equals greatest) and estimates the others' values with mergeable sketches of 2 %
    error. Only columns estimated at twice ``max_unique`` or less are counted exactly, unfolded to (column, value), so few values a column
    leave the map side.
    """
    chosen = [c for c in dict.fromkeys(preferred) if c in df.columns]
    rest = [c for c in text_columns(df) if c not in chosen]
    if rest and (max_columns is None or len(chosen) < max_columns):
        values = df.select(*[X.none_if_blank(F.col(c)).alias(f"v{i}") for i, c in enumerate(rest)])
        facts = values.agg(*[f for i in range(len(rest)) for f in (
            (F.min(f"v{i}") != F.max(f"v{i}")).alias(f"m{i}"), F.approx_count_distinct(f"v{i}", 0.02).alias(f"n{i}"))]).first()
        several = [i for i in range(len(rest)) if facts[f"m{i}"]]
        if max_unique is not None:
            several = [i for i in several if facts[f"n{i}"] <= 2 * max_unique + 10]
            cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v")) for i in several])
            exact = values.select(F.inline(cells)).where("v IS NOT NULL").distinct().groupBy("i").count().collect() if several else []
            several = sorted(r["i"] for r in exact if r["count"] <= max_unique)
        chosen += [rest[i] for i in several]
    return chosen[:max_columns]


def filter_texts(df: DataFrame, selections: Mapping[str, Sequence[object]]) -> DataFrame:
    """Keep rows whose stripped text is one of the selected values; an empty selection keeps all."""
    out = df
    for column, values in selections.items():
        if values and column in df.columns:
            out = out.where(X.strip(F.col(column).cast("string")).isin(*[str(v).strip() for v in values]))
    return out
