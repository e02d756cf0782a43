"""Typed values out of free text: numbers, flags, dates, times, phone numbers and e-mail addresses."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.functions.text import clear_na_like, let, squeeze, strip, strip_accents

NUMBER = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"
TRUE_TEXTS = ("1", "true", "vrai", "oui")  # fixed values


def to_number(col: Column) -> Column:
    """``1 234,5`` to 1234.5; null for anything that is not a number."""
    text = F.replace(F.regexp_replace(col.cast("string"), "[ \\u00a0]", ""), F.lit(","), F.lit("."))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_flag(col: Column) -> Column:
    """True for a fixed list of texts; anything else, null included, is false."""
    return F.coalesce(F.lower(strip(col.cast("string"))).isin(*TRUE_TEXTS), F.lit(False))


def truncate_to_int(col: Column) -> Column:
    number = col.try_cast("double")
    return F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).try_cast("bigint")


def round_to_int(col: Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.rint(col.try_cast("double")).try_cast("bigint")


# French month names after accents are removed.
MONTHS_FR = {
    "janvier": 1, "janv": 1, "fevrier": 2, "fevr": 2, "fev": 2, "mars": 3, "avril": 4, "avr": 4, "mai": 5,
    "juin": 6, "juillet": 7, "juil": 7, "aout": 8, "septembre": 9, "sept": 9, "octobre": 10, "novembre": 11,
    "decembre": 12,
}
MONTHS_EN = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5,
    "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "october": 10,
    "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
EXCEL_EPOCH = dt.date(1899, 12, 30)


def _full_year(token: Column, reference_year: int) -> Column:
    """Two digits pivot at 68; three digits lost one, and the nearest possible year is taken."""
    number = token.try_cast("int")
    repaired: dict[int, int] = {}
    for year in range(1900, 2101):
        text = str(year)
        for short in {text[:i] + text[i + 1:] for i in range(4)}:
            best = repaired.get(int(short)) if len(short) == 3 else None
            if best is None or abs(year - reference_year) < abs(best - reference_year):
                if len(short) == 3 and short[0] != "0":
                    repaired[int(short)] = year
    lost = F.create_map(*[F.lit(x) for pair in sorted(repaired.items()) for x in pair])
    return (
        F.when(F.length(token) == 2, F.when(number <= 68, number + 2000).otherwise(number + 1900))
        .when(F.length(token) == 3, F.coalesce(F.try_element_at(lost, number), number + 2000))
        .otherwise(number)
    )


def _stamp(year: Column, month: Column, day: Column, clock: list[Column]) -> Column:
    hour, minute, second = [F.coalesce(c, F.lit(0)) for c in clock]
    made = F.try_make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(16,6)"))
    return F.when(year.between(1678, 2261), made)


NUMERIC_DATE = "^([0-9]{1,4})[./-]([0-9]{1,2})[./-]([0-9]{1,4})(?:[ t]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?$"
CLOCK_TAIL = "(?:[ t]+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?$"


def parse_dates(df: DataFrame, columns: Mapping[str, str], lang: str = "en", output: str = "datetime",
                reference_year: int | None = None) -> DataFrame:
    """Heterogeneous dates to timestamps, for each ``target: source`` of ``columns``.

    Reads day- or month-first numbers, ISO, spreadsheet serials and French or English month names.
    ``lang="all"`` accepts both orders and leaves a date null when day and month could be swapped. The work is
    done in stages, so that each pattern is matched once per cell.
    """
    if lang not in ("fr", "en", "all"):
        raise ValueError("lang must be 'fr', 'en' or 'all'")
    if output not in ("datetime", "pandas_date", "date"):
        raise ValueError("output must be 'datetime', 'pandas_date' or 'date'")
    reference_year = reference_year or dt.date.today().year
    months = {**MONTHS_EN, **MONTHS_FR}
    names = "|".join(sorted(months, key=len, reverse=True))
    lookup = F.create_map(*[F.lit(x) for pair in months.items() for x in pair])
    day_name = f"^(?:[a-z]+\\.? )?([0-9]{{1,2}})[ -]({names})\\.?,?[ -]([0-9]{{2,4}}){CLOCK_TAIL}"
    name_day = f"^({names})\\.? ([0-9]{{1,2}})(?:st|nd|rd|th)?,? ([0-9]{{4}}){CLOCK_TAIL}"

    out = df
    for i, (target, source) in enumerate(columns.items()):
        def c(name: str) -> Column:
            return F.col(f"__{i}{name}")

        def add(frame: DataFrame, **exprs: Column) -> DataFrame:
            return frame.withColumns({f"__{i}{k}": v for k, v in exprs.items()})

        out = add(out, raw=clear_na_like(strip(F.col(source).cast("string"))))
        out = add(out, text=F.regexp_replace(squeeze(F.lower(strip_accents(c("raw")))), "\\b1er\\b", "1"))
        pattern = (F.when(c("text").rlike(NUMERIC_DATE), 1).when(c("text").rlike(day_name), 2)
                   .when(c("text").rlike(name_day), 3))
        out = add(out, kind=pattern)
        chosen = {n: (F.when(c("kind") == 1, F.regexp_extract(c("text"), NUMERIC_DATE, n))
                      .when(c("kind") == 2, F.regexp_extract(c("text"), day_name, n))
                      .when(c("kind") == 3, F.regexp_extract(c("text"), name_day, n))) for n in range(1, 7)}
        out = add(out, **{f"g{n}": chosen[n] for n in chosen})
        year = F.when((c("kind") == 1) & (F.length(c("g1")) >= 3) & (F.length(c("g3")) <= 2), c("g1")).otherwise(c("g3"))
        out = add(
            out, y=_full_year(year, reference_year), a=c("g1").try_cast("int"), b=c("g2").try_cast("int"),
            d=c("g3").try_cast("int"), first=(F.length(c("g1")) >= 3) & (F.length(c("g3")) <= 2),
            m=F.try_element_at(lookup, F.when(c("kind") == 2, c("g2")).otherwise(c("g1"))),
            **{f"t{n}": F.nullif(c(f"g{n}"), F.lit("")).try_cast("int") for n in (4, 5, 6)})
        clock = [c("t4"), c("t5"), c("t6")]
        out = add(out, dm=F.when(c("kind") == 1, _stamp(c("y"), c("b"), c("a"), clock)),
                  md=F.when(c("kind") == 1, _stamp(c("y"), c("a"), c("b"), clock)),
                  ymd=F.when(c("first"), _stamp(c("y"), c("b"), c("d"), clock)),
                  named=_stamp(c("y"), c("m"), F.when(c("kind") == 2, c("a")).otherwise(c("b")), clock),
                  serial=F.when(c("raw").rlike(NUMBER), c("raw").try_cast("double")))
        if lang == "fr":
            ordered = F.coalesce(c("dm"), c("md"))
        elif lang == "en":
            ordered = F.coalesce(c("md"), c("dm"))
        else:
            ordered = (F.when((c("a") > 12) & (c("b") <= 12), c("dm")).when((c("b") > 12) & (c("a") <= 12), c("md")))
        from_serial = F.lit(EXCEL_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=F.round(c("serial") * 86400, 6))
        general = F.when(c("raw").rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), F.try_to_timestamp(c("raw")).cast("timestamp_ntz"))
        stamp = (F.when(c("serial").between(20000, 80000), from_serial)
                 .when(c("kind") == 1, F.when(c("first"), c("ymd")).otherwise(ordered))
                 .when(c("kind").isNotNull(), c("named")).otherwise(general))
        day = F.to_date(stamp)
        value = {"datetime": stamp, "date": day, "pandas_date": day.cast("timestamp_ntz")}[output]
        out = out.withColumn(f"__out{i}", value)
    targets = list(columns)
    kept = [F.col(f"__out{targets.index(n)}").alias(n) if n in columns else F.col(n) for n in df.columns]
    extra = [F.col(f"__out{i}").alias(n) for i, n in enumerate(targets) if n not in df.columns]
    return out.select(*kept, *extra)


def to_clock(col: Column) -> Column:
    """``8h30``, ``0830`` or ``08:30:15`` to ``HH:MM:SS``; null when it is not a time of day."""
    text = F.regexp_replace(F.replace(F.lower(strip(col.cast("string"))), F.lit("h"), F.lit(":")), "[^0-9:]", "")
    four = F.lpad(text, 4, "0")
    text = F.when(text.rlike("^[0-9]{3,4}$"), F.concat_ws(":", F.left(four, F.lit(2)), F.right(four, F.lit(2))))\
        .otherwise(text)
    text = F.when(text.rlike("^[0-9]{1,2}:[0-9]{2}$"), F.concat(text, F.lit(":00"))).otherwise(text)
    parts = [F.regexp_extract(text, "^([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})$", i).try_cast("int") for i in (1, 2, 3)]
    valid = (parts[0] <= 23) & (parts[1] <= 59) & (parts[2] <= 59)
    return F.when(valid, F.format_string("%02d:%02d:%02d", *parts))


def phone_numbers(col: Column, country_code: str = "243", add_prefix: bool = False,
                  max_numbers: int | None = None) -> Column:
    """Every valid number of a cell, in order, without repeats: 9 digits, or ``+<country><9 digits>``."""
    text = F.regexp_replace(F.replace(strip(col.cast("string")), F.lit(" "), F.lit(" ")),
                            "(?U)(?<!\\w)[oO](?=[0-9])", "0")
    runs = F.regexp_extract_all(text, F.lit("(\\+?[0-9]{7,15})"), F.lit(1))

    def local(run: Column) -> Column:
        digits = F.replace(run, F.lit("+"), F.lit(""))
        return (
            F.when(F.startswith(digits, F.lit(country_code)) & (F.length(digits) == 12),
                   F.substr(digits, F.lit(len(country_code) + 1)))
            .when(F.startswith(digits, F.lit("0")) & (F.length(digits) == 10), F.substr(digits, F.lit(2)))
            .when(F.length(digits) == 9, digits)
        )

    numbers = F.array_compact(F.transform(runs, local))
    if add_prefix:
        numbers = F.transform(numbers, lambda n: F.concat(F.lit("+" + country_code), n))
    numbers = F.array_distinct(numbers)
    if max_numbers is not None:
        numbers = F.slice(numbers, 1, max_numbers)
    possible = col.cast("string").rlike("[0-9]{7}")
    return F.when(possible, let(numbers, lambda found: F.when(F.size(found) > 0, found)))


def _as_mode(values: Column, mode: str, separator: str) -> Column:
    if mode == "list":
        return values
    if mode == "join":
        return F.array_join(values, separator)
    if mode == "first":
        return F.try_element_at(values, F.lit(1))
    raise ValueError("return_mode must be 'first', 'join' or 'list'")


def clean_phone(col: Column, country_code: str = "243", add_prefix: bool = False, return_mode: str = "first",
                separator: str = "; ", max_numbers: int | None = None) -> Column:
    return _as_mode(phone_numbers(col, country_code, add_prefix, max_numbers), return_mode, separator)


def phone_key(col: Column, country_code: str = "243") -> Column:
    """Join key of a phone: country code followed by the nine local digits."""
    return F.concat(F.lit(country_code), clean_phone(col, country_code))


# Frequent typing errors, applied in this order.
EMAIL_REPAIRS = (
    ("\\s*@\\s*", "@"),
    ("\\s*\\.\\s*", "."),
    ("\\s*,\\s*", ","),
    (",com\\b", ".com"),
    ("@gmail\\.co\\b", "@gmail.com"),
    ("gma\\s*il\\.com\\b", "gmail.com"),
    ("gamil\\.com\\b", "gmail.com"),
    ("gamail\\.com\\b", "gmail.com"),
    ("gmqil\\.com\\b", "gmail.com"),
    ("ygmail\\.com\\b", "gmail.com"),
)
# Domain completion, only on request.
EMAIL_COMPLETIONS = (
    ("@?\\s*com\\s+gmail\\b", "@gmail.com"),
    ("@\\s*gmail\\b", "@gmail.com"),
    ("@gmail\\b(?!\\.)", "@gmail.com"),
)
EMAIL = "([a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,})"
REPEATED_TLD = "(\\.[a-z]{2,})(?:\\1)+\\b"


def email_addresses(col: Column, complete_domain: bool = False, max_emails: int | None = None) -> Column:
    text = F.lower(strip(col.cast("string")))
    text = F.regexp_replace(text, "[<>]", " ")
    text = F.regexp_replace(text, "\\s+ou\\s+", " ")
    text = squeeze(F.regexp_replace(text, "[;/]", " "))
    for pattern, fix in EMAIL_REPAIRS + (EMAIL_COMPLETIONS if complete_domain else ()):
        text = F.regexp_replace(text, pattern, fix)
    text = F.regexp_replace(text, REPEATED_TLD, "$1")
    text = F.regexp_replace(text, "[\\s)\\]}>,;]+$", "")
    found = F.regexp_extract_all(text, F.lit(EMAIL), F.lit(1))
    cleaned = F.transform(found, lambda e: F.regexp_replace(F.btrim(e, F.lit(".,;:")), REPEATED_TLD, "$1"))
    emails = F.array_distinct(F.filter(cleaned, lambda e: e != ""))
    if max_emails is not None:
        emails = F.slice(emails, 1, max_emails)
    # Texts that cannot hold an address skip the whole chain.
    possible = F.contains(col.cast("string"), F.lit("@"))
    if complete_domain:
        possible = possible | F.contains(F.lower(col.cast("string")), F.lit("gmail"))
    return F.when(possible, let(emails, lambda found: F.when(F.size(found) > 0, found)))


def clean_email(col: Column, return_mode: str = "first", separator: str = "; ", complete_domain: bool = False,
                max_emails: int | None = None) -> Column:
    return _as_mode(email_addresses(col, complete_domain, max_emails), return_mode, separator)


def days_between(later: Column, earlier: Column) -> Column:
    """Whole 24-hour blocks from ``earlier`` to ``later``, rounded down."""
    micros = F.timestamp_diff("MICROSECOND", earlier, later)
    return F.floor(micros / F.lit(86_400_000_000)).cast("int")
