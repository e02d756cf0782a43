"""Equi-joins of several tables, comparison of two tables by key, and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.functions.text import none_if_blank


def join_all(tables: Sequence[DataFrame], on: Sequence[str], how: str = "inner",
             suffixes: tuple[str, str] = ("_gauche", "_droite"), with_source: bool = False) -> DataFrame:
    """Join tables one after the other; columns found on both sides get a suffix."""
    if len(tables) < 2:
        raise ValueError("at least two tables are needed")
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError("how must be inner, left, right or outer")
    frames = [t.withColumn("Source", F.lit(f"df_{i}")) for i, t in enumerate(tables)] if with_source else list(tables)
    keys = list(on)
    out = frames[0]
    for right in frames[1:]:
        shared = [c for c in out.columns if c in right.columns and c not in keys]
        left = out.select(*[F.col(c).alias(c + suffixes[0]) if c in shared else F.col(c) for c in out.columns])
        right = right.select(*[F.col(c).alias(c + suffixes[1]) if c in shared else F.col(c) for c in right.columns])
        out = left.join(right, keys, how)
    return out


def comparison_key(columns: Sequence[str], clean: bool = True) -> Column:
    """Composite text key; cleaning drops spaces, hyphens and underscores and ignores case. Null if a part is missing."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        text = F.upper(F.regexp_replace(text, "[-_\\s]+", "")) if clean else text
        parts.append(none_if_blank(text))
    present = F.lit(True)
    for p in parts:
        present = present & p.isNotNull()
    return F.when(present, F.concat_ws("||", *parts))


def compare_values(left: DataFrame, left_columns: Sequence[str], right: DataFrame, right_columns: Sequence[str],
                   clean: bool = True) -> DataFrame:
    """Distinct keys of both tables: common, only in the first, only in the second."""
    a = left.select(comparison_key(left_columns, clean).alias("cle")).where("cle IS NOT NULL").distinct()
    b = right.select(comparison_key(right_columns, clean).alias("cle")).where("cle IS NOT NULL").distinct()
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "cle", "full_outer")
    where = (F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), "commun")
             .when(F.col("l").isNotNull(), "premier seulement").otherwise("second seulement"))
    return both.select("cle", where.alias("presence"))


def common_values(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def missing_values(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of the first table without a partner in the second."""
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def compare_tables(left: DataFrame, right: DataFrame, on: Sequence[str], left_columns: Sequence[str] | None = None,
                   right_columns: Sequence[str] | None = None, clean: bool = True, left_suffix: str = "_df_1",
                   right_suffix: str = "_df_2") -> DataFrame:
    """Matching rows of two tables on a (composite) key, with chosen columns of each side."""
    a_cols = list(left_columns or [c for c in left.columns if c not in on])
    b_cols = list(right_columns or [c for c in right.columns if c not in on])
    a = left.select(comparison_key(on, clean).alias("__key"), *on, *[F.col(c).alias(c + left_suffix) for c in a_cols])
    b = right.select(comparison_key(on, clean).alias("__key"), *[F.col(c).alias(c + right_suffix) for c in b_cols])
    # Keys are never null here: a missing part matches nothing.
    return a.where(F.col("__key").isNotNull()).join(b.where(F.col("__key").isNotNull()), "__key").drop("__key")


def comparison_summary(left: DataFrame, right: DataFrame, on: Sequence[str], clean: bool = True) -> DataFrame:
    """Row counts, distinct common keys and keys of one side only."""
    presence = compare_values(left, on, right, on, clean)
    counts = presence.agg(*[
        F.count(F.when(F.col("presence") == p, 1)).alias(n) for p, n in (
            ("commun", "nb_cles_communes"), ("premier seulement", "nb_cles_uniques_1"), ("second seulement", "nb_cles_uniques_2"))])
    return counts.select("*", left.agg(F.count("*").alias("n")).scalar().alias("nb_lignes_1"),
                         right.agg(F.count("*").alias("n")).scalar().alias("nb_lignes_2"))


def rows_by_presence(left: DataFrame, right: DataFrame, on: Sequence[str], clean: bool = True) -> DataFrame:
    """Every row of both tables marked as common or as belonging to one side only."""
    def side(df: DataFrame, other: DataFrame, label: str) -> DataFrame:
        keyed = df.withColumn("__key", comparison_key(on, clean)).where("__key IS NOT NULL")
        keys = other.select(comparison_key(on, clean).alias("__key")).where("__key IS NOT NULL").distinct().withColumn("__in", F.lit(True))
        mark = F.when(F.col("__in"), "commun").otherwise(label)
        return keyed.join(keys, "__key", "left").select(*[F.col(c).cast("string").alias(c) for c in on], mark.alias("presence"))

    return side(left, right, "premier seulement").unionByName(side(right, left, "second seulement"))


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing on one side is null there."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def branch_dimension(tables: Sequence[DataFrame], column: str = "agence") -> DataFrame:
    """Distinct non-blank branch names of several facts."""
    names = union_all([t.select(column).distinct() for t in tables])
    return names.where(none_if_blank(F.col(column)).isNotNull()).distinct()


def calendar(df: DataFrame, column: str) -> DataFrame:
    """One row per day between the first and the last date of the column, with its usual attributes."""
    bounds = df.agg(F.min(F.to_date(column)).alias("a"), F.max(F.to_date(column)).alias("b"))
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("jour"))
    return days.select(
        "jour", F.year("jour").alias("annee"), F.month("jour").alias("mois"), F.quarter("jour").alias("trimestre"),
        F.date_format("jour", "yyyy-MM").alias("periode"))


def resample(df: DataFrame, date: str, keys: Sequence[str], value: str, frequency: str, stock: bool = False) -> DataFrame:
    """Daily, weekly (Monday) or monthly sums; means for stock-like indicators."""
    from comptoir.functions.money import mean, total

    unit = {"D": "day", "W": "week", "M": "month"}[frequency]
    period = F.to_date(F.date_trunc(unit, F.col(date)))
    measure = mean(value) if stock else total(value)
    return df.groupBy(*keys, period.alias("periode")).agg(measure.alias(value))
