"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)


def has(df: DataFrame, *columns: str) -> bool:
    return set(columns) <= set(df.columns)


def first_existing(df: DataFrame, candidates: Iterable[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def empty(df: DataFrame, schema: str) -> DataFrame:
    """No rows, fixed columns: what an operator returns when its inputs lack the columns it needs."""
    return df.sparkSession.createDataFrame([], schema)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def number(df: DataFrame, column: str) -> Column:
    """The column as a double; text is parsed, unreadable text becomes null."""
    from comptoir.functions.values import to_number

    if isinstance(df.schema[column].dataType, NUMERIC):
        return F.col(column).cast("double")
    return to_number(F.col(column))


def number_or_zero(df: DataFrame, column: str) -> Column:
    return F.coalesce(number(df, column), F.lit(0.0)) if column in df.columns else F.lit(0.0)


def stamp(df: DataFrame, column: str) -> Column:
    """The column as a timestamp; text that is no date becomes null."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.try_to_timestamp(F.col(column)).cast("timestamp_ntz")
    return F.col(column).cast("timestamp_ntz")


def month_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def row_total(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery; the scan behind it reads no column."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def nested_when(pairs: Sequence[tuple[Column, object]], default: object = None) -> Column:
    expr = F.when(F.lit(False), None)
    for condition, value in pairs:
        expr = expr.when(condition, value)
    return expr.otherwise(default) if default is not None else expr
