"""Compliance table: indicators by reporting line, alert figures, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.functions import labels as L
from comptoir.functions.money import count_if, exact_sum, total
from comptoir.operators.common import first_existing, has, number_or_zero
from comptoir.operators.filters import compliance_condition

SURVEILLANCE = ("Alerte", "Declaration", "Profil de risque", "Reactivation de compte", "Fractionnement", "Gros mouvement agrege")
DEPOSIT_TYPES, WITHDRAWAL_TYPES = ("DEPO", "MOB_DEPO", "DDAT"), ("RETR", "MOB_RETR", "RDAT")


def reporting_sums(df: DataFrame) -> DataFrame:
    """Sum of the reported numbers per reporting line."""
    line = first_existing(df, ("ligne_reporting", "ligne_excel"))
    rows = df.where(compliance_condition(df, "149_", "REPORTING") & F.col(line).isNotNull())
    return rows.groupBy(F.col(line).alias("ligne")).agg(total(number_or_zero(df, "nombre")).alias("nombre"))


def reported(df: DataFrame, line: int) -> Column:
    """Smallest reported number of a line inside the reporting rows, 0 when absent, as a conditional aggregate."""
    column = first_existing(df, ("ligne_reporting", "ligne_excel"))
    if column is None or not has(df, "nombre"):
        return F.lit(0.0)
    here = compliance_condition(df, "149_", "REPORTING") & (F.col(column) == line)
    return F.coalesce(F.min(F.when(here, F.col("nombre").cast("double"))), F.lit(0.0))


def alert_figures(df: DataFrame) -> DataFrame:
    """Alerts, treated, to review, structuring, large movements, clients and currencies in one pass.

    Where the detail rows are absent the reported line stands in.
    """
    alert = compliance_condition(df, "150_", "ALERTE")
    split = compliance_condition(df, "039_", "FRACTIONNEMENT")
    large = compliance_condition(df, "057_", "GROS_MOUVEMENT_AGREGE")
    review = first_existing(df, ("statut_revue", "statut_revue_conformite"))
    treated = alert & F.contains(F.upper(F.col(review)), F.lit("TRAIT")) if review else F.lit(False)
    flagged = alert & F.contains(F.lower(F.col("indicateurs")), F.lit("fractionnement")) if has(df, "indicateurs") else F.lit(False)
    client = first_existing(df, ("code_client", "client_id"))
    raw = df.agg(
        count_if(alert).alias("a"), reported(df, 144).alias("a_r"), count_if(treated).alias("t"), reported(df, 145).alias("t_r"),
        count_if(split).alias("s"), count_if(flagged).alias("s_i"), count_if(large).alias("g_rows"), exact_sum(number_or_zero(df, "nombre"), large).alias("g"),
        (F.count_distinct(F.when(alert | split, F.col(client))) if client else F.lit(0).cast("bigint")).alias("c"),
        (F.count_distinct(F.when(alert | split | large, F.col("devise"))) if has(df, "devise") else F.lit(0).cast("bigint")).alias("d"))
    alerts = F.when(F.col("a") > 0, F.col("a")).otherwise(F.col("a_r").cast("bigint"))
    done = F.col("t") if review else F.col("t_r").cast("bigint")
    structured = F.when(F.col("s") > 0, F.col("s")).otherwise(F.col("s_i"))
    return raw.select(
        alerts.alias("alertes"), done.alias("traitees"), (F.greatest(alerts - done, F.lit(0)) + structured + F.col("g_rows")).alias("a_revoir"),
        structured.alias("fractionnements"), F.col("g").cast("bigint").alias("gros_mouvements"), F.col("c").alias("clients_concernes"), F.col("d").alias("devises"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    label = F.coalesce(F.col(column).cast("string"), F.lit(L.MISSING))
    return df.groupBy(label.alias(column)).agg(F.count("*").alias("nombre_lignes"))


def compliance_measures(df: DataFrame) -> DataFrame:
    """Counts by element type, coverage, severity and review state, distinct clients watched."""
    kind, cover = F.col("type_element"), F.col("statut_couverture")
    watched = kind.isin(*SURVEILLANCE)
    return df.agg(
        F.count("*").alias("lignes"), F.count_distinct("analyse").alias("analyses"), F.coalesce(F.sum("nombre"), F.lit(0)).alias("nombre_declare"),
        count_if(kind == "Controle qualite").alias("controles_qualite"), count_if(kind == "Alerte").alias("alertes"),
        count_if(kind == "Declaration").alias("declarations"), count_if(kind == "Profil de risque").alias("profils_risque"),
        count_if(kind == "Reactivation de compte").alias("reactivations"), count_if(cover == "NON_COUVERT").alias("non_couverts"),
        count_if(cover == "PARTIEL").alias("partiels"), count_if(cover == "COUVERT").alias("couverts"),
        count_if(F.col("severite") == "CRITIQUE").alias("critiques"), count_if(F.col("severite").isNotNull()).alias("lignes_severite"),
        count_if(watched).alias("cas_surveillance"), count_if(watched & (F.col("statut_revue") == "A_REVOIR")).alias("dossiers_a_revoir"),
        F.count_distinct(F.when(watched, F.col("code_client"))).alias("clients_surveilles"))


def net_collection(df: DataFrame) -> DataFrame:
    """Deposits, withdrawals and their difference per currency, from the movement rows."""
    moved = F.col("type_element") == "Mouvement"
    ins = exact_sum("montant", moved & F.col("type_operation").isin(*DEPOSIT_TYPES))
    outs = exact_sum("montant", moved & F.col("type_operation").isin(*WITHDRAWAL_TYPES))
    return df.where(F.col("devise").isNotNull()).groupBy("devise").agg(
        ins.cast("double").alias("montant_depots"), outs.cast("double").alias("montant_retraits"), (ins - outs).cast("double").alias("collecte_nette"))
