"""Rule evaluation: a rule is a condition and a label; a row carries the labels of the rules it meets, in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[Column, str]
REASON = "motif_alerte"


def reasons(rules: Sequence[Rule], separator: str = "; ") -> Column:
    """Labels of the met rules joined in rule order; null when none is met. A null condition is not met."""
    if not rules:
        return F.lit(None).cast("string")
    marked = F.array(*[F.when(condition, F.lit(label)) for condition, label in rules])
    return F.nullif(F.array_join(marked, separator), F.lit(""))


def any_of(rules: Sequence[Rule]) -> Column:
    met = F.lit(False)
    for condition, _ in rules:
        met = met | F.coalesce(condition, F.lit(False))
    return met


def watchlist(df: DataFrame, rules: Sequence[Rule], name: str = REASON) -> DataFrame:
    return df.withColumn(name, reasons(rules)).where(F.col(name).isNotNull())


def reason_counts(watched: DataFrame, name: str = REASON, top_n: int | None = None) -> DataFrame:
    """How often each label occurs in a watchlist; with ``top_n`` the most frequent ones."""
    labels = watched.select(F.explode(F.split(name, "; ")).alias(name)).where(F.btrim(F.col(name)) != "")
    counts = labels.groupBy(name).agg(F.count("*").alias("nombre_lignes"))
    return counts.orderBy(F.desc("nombre_lignes"), name).limit(top_n) if top_n else counts


def rule_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Number of rows per rule, zero included, from one pass."""
    from comptoir.operators.quality import unfold

    wide = df.agg(*[F.count(F.when(c, 1)).alias(f"r{i}") for i, (c, _) in enumerate(rules)])
    return unfold(wide, [[("controle", F.lit(label)), ("valeur", F.col(f"r{i}"))] for i, (_, label) in enumerate(rules)])
