"""Credit and savings portfolio aggregates: series, distributions, arrears, exposure, concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.functions import labels as L
from comptoir.functions.money import MONEY, count_if, exact_sum, mean, ratio, total
from comptoir.functions.values import days_between
from comptoir.operators.common import (
    empty, first_existing, has, month_start, month_text, number, number_or_zero, row_total, stamp,
)

# Date column to use per control cycle, first one present.
CYCLE_DATES = {
    "conformite": ("date_evenement", "date_alerte", "date_declaration", "date_operation", "date_debut"),
    "credit": ("date_demande", "date_decision"),
    "likelemba": ("date_demande", "date_decision"),
    "epargne": ("date_operation", "date_demande"),
    "operations_depot_retrait": ("date_operation",),
    "crm_clients": ("date_operation",),
    "caisse": ("date_operation",),
    "tresorerie": ("date_operation",),
    "comptable": ("date_operation",),
    "money_provider": ("date_operation",),
    "rh_admin": ("date_entree", "date_operation"),
    "si": ("date_activation", "date_revocation"),
    "continuite": ("date_sauvegarde",),
}
ANY_DATES = ("date_demande", "date_operation", "date_decision", "date_entree", "date_activation", "date_revocation",
             "date_sauvegarde")
CYCLE_AMOUNTS = ("montant_demande", "montant_operation", "montant_accorde", "montant_debit", "montant_credit", "salaire")


def cycle_date(df: DataFrame, cycle: str | None = None) -> str | None:
    return first_existing(df, (*CYCLE_DATES.get(cycle or "", ()), *ANY_DATES))


def delayed(df: DataFrame) -> Column:
    """Late files: by repayment status where there is one, else by days of delay."""
    if has(df, "statut_remboursement"):
        return F.coalesce(F.col("statut_remboursement") == "En retard", F.lit(False))
    if has(df, "retard_jours"):
        return F.coalesce(F.col("retard_jours") > 0, F.lit(False))
    return F.lit(False)


def risk_is(df: DataFrame, level: str) -> Column:
    if not has(df, "niveau_risque_calcule"):
        return F.lit(False)
    return F.coalesce(F.col("niveau_risque_calcule") == level, F.lit(False))


# --- series ---------------------------------------------------------------------------------------------------

def monthly_series(df: DataFrame) -> DataFrame:
    if not has(df, "date_demande"):
        return empty(df, "mois_demande string, nombre_dossiers bigint, montant_demande_total double")
    date = stamp(df, "date_demande")
    return (
        df.where(date.isNotNull()).groupBy(month_text(date).alias("mois_demande"))
        .agg(F.count("*").alias("nombre_dossiers"), total("montant_demande").alias("montant_demande_total"))
    )


def period_series(df: DataFrame, date_column: str, amount_column: str | None = None) -> DataFrame:
    if not has(df, date_column):
        return empty(df, "periode string, nombre_lignes bigint, montant_total double")
    date = stamp(df, date_column)
    amount = total(number(df, amount_column)) if amount_column and has(df, amount_column) \
        else F.first(F.lit(None).cast("double"))
    return (
        df.where(date.isNotNull()).groupBy(month_text(date).alias("periode"))
        .agg(F.count("*").alias("nombre_lignes"), amount.alias("montant_total"))
    )


def cycle_period_series(df: DataFrame, cycle: str | None = None) -> DataFrame:
    date_column = cycle_date(df, cycle)
    if date_column is None:
        return empty(df, "periode string, nombre_lignes bigint, montant_total double")
    return period_series(df, date_column, first_existing(df, CYCLE_AMOUNTS))


def monthly_requests(df: DataFrame, by_currency: bool = True) -> DataFrame:
    """Requests per month and currency: number, amount asked, amount granted."""
    date_column = "date_demande" if has(df, "date_demande") else cycle_date(df, "credit")
    if date_column is None:
        return empty(df, "mois date, nombre_demandes bigint, montant_demande double, montant_accorde double")
    date = stamp(df, date_column)
    keys = [month_start(date).alias("mois")]
    if by_currency and has(df, "devise"):
        keys.append(L.or_missing(F.col("devise")).alias("devise"))
    amounts = [
        (total(number(df, c)) if has(df, c) else F.count("*").cast("double")).alias(c)
        for c in ("montant_demande", "montant_accorde")
    ]
    return df.where(date.isNotNull()).groupBy(*keys).agg(F.count("*").alias("nombre_demandes"), *amounts)


# --- one-row metrics ------------------------------------------------------------------------------------------

def summary_measures(df: DataFrame) -> list[Column]:
    none = F.first(F.lit(None).cast("double"))
    approved = F.col("statut_dossier").isin(*L.APPROVED) if has(df, "statut_dossier") else F.lit(False)
    rows = F.count("*")
    return [
        rows.alias("nombre_dossiers"),
        (F.count_distinct("client_id") if has(df, "client_id") else F.first(F.lit(None).cast("bigint")))
        .alias("nombre_clients"),
        (total("montant_demande") if has(df, "montant_demande") else none).alias("montant_demande_total"),
        (total("montant_accorde") if has(df, "montant_accorde") else none).alias("montant_accorde_total"),
        ratio(count_if(approved), rows).alias("taux_approbation"),
        ratio(count_if(delayed(df)), rows).alias("taux_retard"),
        (mean("retard_jours") if has(df, "retard_jours") else none).alias("retard_moyen_jours"),
        (mean("taux_endettement") if has(df, "taux_endettement") else none).alias("taux_endettement_moyen"),
    ]


def summary_metrics(df: DataFrame) -> DataFrame:
    """Files, clients, amounts, approval and delay rates, mean delay and debt ratio, in one pass."""
    return df.agg(*summary_measures(df))


def top_label(df: DataFrame, column: str) -> Column:
    """Most frequent label as a scalar subquery; ties go to the first label in alphabetical order."""
    if not has(df, column):
        return F.lit(L.MISSING)
    counts = df.groupBy(L.or_missing(F.col(column)).alias("label")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "label").limit(1).select("label").scalar()


def operational_snapshot(df: DataFrame) -> DataFrame:
    """Summary metrics with risk, capacity and delay counts and the leading label of four dimensions."""
    delay = F.coalesce(F.col("retard_jours"), F.lit(0)) if has(df, "retard_jours") else F.lit(0)
    capacity = F.coalesce(F.col("capacite_remboursement"), F.lit(0.0)) if has(df, "capacite_remboursement") else F.lit(0.0)
    incomplete = (F.col("revenu_mensuel").isNull() | F.col("charge_mensuelle").isNull()) \
        if has(df, "revenu_mensuel", "charge_mensuelle") else F.lit(False)
    figures = df.agg(
        *summary_measures(df),
        count_if(risk_is(df, "Élevé")).alias("high_risk_count"),
        count_if(risk_is(df, "Moyen")).alias("medium_risk_count"),
        count_if(capacity < 0).alias("negative_capacity_count"),
        count_if(incomplete).alias("incomplete_financial_count"),
        count_if(delayed(df)).alias("delayed_count"),
        count_if(delay > 30).alias("overdue_30_count"),
        (mean("montant_demande") if has(df, "montant_demande") else F.first(F.lit(None).cast("double")))
        .alias("montant_moyen_demande"),
    )
    return figures.select(
        "*",
        top_label(df, "agence").alias("top_agence"), top_label(df, "type_produit").alias("top_produit"),
        top_label(df, "agent_credit").alias("top_agent"), top_label(df, "statut_dossier").alias("top_statut"),
    )


# --- grouped sums and distributions ---------------------------------------------------------------------------

def ranked(grouped: DataFrame, top_n: int | None, *order: Column | str) -> DataFrame:
    """All rows, or the first ``top_n`` in the given order."""
    return grouped if top_n is None else grouped.orderBy(*order).limit(top_n)


def grouped_amounts(df: DataFrame, group: str, amount: str = "montant_demande", top_n: int = 10) -> DataFrame:
    if not has(df, group, amount):
        return empty(df, f"`{group}` string, `{amount}` double")
    sums = df.where(F.col(group).isNotNull()).groupBy(group).agg(exact_sum(amount).alias(amount))
    return sums.orderBy(F.desc(amount), group).limit(top_n).withColumn(amount, F.col(amount).cast("double"))


def grouped_sum(df: DataFrame, groups: Sequence[str], value: str, top_n: int = 10,
                min_categories: int = 1) -> DataFrame:
    """Largest sums by cleaned labels, zero values left out; empty when too few categories remain."""
    if not has(df, *groups, value):
        return empty(df, ", ".join([*(f"`{g}` string" for g in groups), f"`{value}` double"]))
    rows = df.select(*[L.or_missing(F.col(g)).alias(g) for g in groups], number_or_zero(df, value).alias(value))
    sums = rows.where(F.col(value) != 0).groupBy(*groups).agg(exact_sum(value).alias(value))
    top = sums.orderBy(F.desc(value), *groups).limit(top_n)
    if min_categories > 1:
        categories = top.agg(F.count_distinct(groups[0]).alias("n")).scalar()
        top = top.where(categories >= min_categories)
    return top.withColumn(value, F.col(value).cast("double"))


def label_counts(df: DataFrame, column: str, name: str = "nombre_dossiers") -> DataFrame:
    """Number of rows per raw value, nulls kept as a group."""
    if not has(df, column):
        return empty(df, f"`{column}` string, {name} bigint")
    return df.groupBy(column).agg(F.count("*").alias(name))


def risk_distribution(df: DataFrame) -> DataFrame:
    return label_counts(df, "niveau_risque_calcule")


def status_distribution(df: DataFrame) -> DataFrame:
    return label_counts(df, "statut_dossier")


def shares(df: DataFrame, label: Column, name: str, whole: DataFrame, count: str = "nombre_lignes",
           share: str = "part_lignes") -> DataFrame:
    counts = df.groupBy(label.alias(name)).agg(F.count("*").alias(count))
    return counts.withColumn(share, F.col(count).cast("double") / row_total(whole))


def frequency_table(df: DataFrame, column: str, top_n: int | None = None) -> DataFrame:
    if not has(df, column):
        return empty(df, f"`{column}` string, nombre_lignes bigint, part_lignes double")
    result = shares(df, L.or_missing(F.col(column)), column, df)
    return result if top_n is None else result.orderBy(F.desc("nombre_lignes"), column).limit(top_n)


def in_order(df: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    """Rows in a fixed business order; the table is small, one row per label."""
    return df.orderBy(L.order_of(F.col(column), order), column)


def sex_distribution(df: DataFrame) -> DataFrame:
    if not has(df, "sexe"):
        return empty(df, "sexe string, nombre_lignes bigint, part_lignes double")
    label = L.or_missing(F.col("sexe"))
    shown = F.when(label.isin("Non renseigne", "Non renseigné"), "Inconnu").otherwise(label)
    return in_order(shares(df, shown, "sexe", df), "sexe", ("Masculin", "Féminin", "Inconnu"))


def status_flow(df: DataFrame) -> DataFrame:
    if not has(df, "statut_dossier"):
        return empty(df, "statut_dossier string, nombre_dossiers bigint")
    label = F.coalesce(F.col("statut_dossier"), F.lit(L.MISSING))
    counts = df.groupBy(label.alias("statut_dossier")).agg(F.count("*").alias("nombre_dossiers"))
    return in_order(counts, "statut_dossier", L.STATUS_FLOW)


def age_bands(df: DataFrame) -> DataFrame:
    if not has(df, "age"):
        return empty(df, "tranche_age string, nombre_lignes bigint, part_lignes double")
    return in_order(shares(df, L.age_band(number(df, "age")), "tranche_age", df), "tranche_age", L.AGE_BANDS)


def age_sex_pyramid(df: DataFrame) -> DataFrame:
    if not has(df, "age", "sexe"):
        return empty(df, "tranche_age string, `Masculin` bigint, `Féminin` bigint")
    band = L.age_band(number(df, "age")).alias("tranche_age")
    sides = [count_if(F.col("sexe") == s).alias(s) for s in ("Masculin", "Féminin")]
    return in_order(df.groupBy(band).agg(*sides), "tranche_age", L.AGE_BANDS)


# --- savings snapshot -----------------------------------------------------------------------------------------

def inactivity_days(df: DataFrame, column: str = "date_operation") -> Column:
    """Whole days up to the latest date of the whole table."""
    date = stamp(df, column)
    latest = df.agg(F.max(date).alias("latest")).scalar()
    return days_between(latest, date)


def dormancy(df: DataFrame) -> DataFrame:
    if not has(df, "date_operation"):
        return empty(df, "classe_inactivite string, nombre_lignes bigint, part_lignes double")
    known = df.where(stamp(df, "date_operation").isNotNull()).agg(F.count("*").alias("n")).scalar()
    bands = shares(df, L.inactivity_band(inactivity_days(df)), "classe_inactivite", df)
    return in_order(bands.where(known > 0), "classe_inactivite", L.INACTIVITY_BANDS)


def accounts_per_client(df: DataFrame) -> DataFrame:
    rows = df.where(F.col("client_id").isNotNull() & F.col("compte_id").isNotNull())
    return rows.groupBy("client_id").agg(F.count_distinct("compte_id").alias("nombre_comptes"))


def multi_account_classes(df: DataFrame) -> DataFrame:
    if not has(df, "client_id", "compte_id"):
        return empty(df, "classe_comptes string, nombre_clients bigint, part_clients double")
    n = F.col("nombre_comptes")
    label = (F.when(n <= 1, "1 compte").when(n == 2, "2 comptes").when(n <= 4, "3-4 comptes").otherwise("5+ comptes"))
    per_client = accounts_per_client(df)
    counts = per_client.groupBy(label.alias("classe_comptes")).agg(F.count("*").alias("nombre_clients"))
    share = F.col("nombre_clients").cast("double") / row_total(per_client)
    return in_order(counts.withColumn("part_clients", share), "classe_comptes",
                    ("1 compte", "2 comptes", "3-4 comptes", "5+ comptes"))


def multi_account_clients(df: DataFrame, top_n: int = 10) -> DataFrame:
    if not has(df, "client_id", "compte_id"):
        return empty(df, "client_id string, nom_client string, nombre_comptes bigint, solde_total double")
    rows = df.where(F.col("client_id").isNotNull() & F.col("compte_id").isNotNull())
    name = F.min(F.nullif(F.btrim(F.col("nom_client")), F.lit(""))) if has(df, "nom_client") \
        else F.first(F.lit(None).cast("string"))
    grouped = rows.groupBy("client_id").agg(
        name.alias("nom_client"), F.count_distinct("compte_id").alias("nombre_comptes"),
        exact_sum(number_or_zero(df, "solde_compte")).alias("solde_total"),
    )
    top = grouped.orderBy(F.desc("nombre_comptes"), F.desc("solde_total"), "client_id").limit(top_n)
    return top.withColumn("solde_total", F.col("solde_total").cast("double"))


def product_concentration(df: DataFrame, top_n: int | None = None) -> DataFrame:
    if not has(df, "type_produit", "solde_compte"):
        return empty(df, "type_produit string, nombre_comptes bigint, solde_total double, part_solde double")
    rows = df.where(F.col("type_produit").isNotNull())
    balance = number_or_zero(df, "solde_compte")
    whole = rows.agg(exact_sum(balance).alias("s")).scalar()
    grouped = rows.groupBy("type_produit").agg(F.count("*").alias("nombre_comptes"), exact_sum(balance).alias("solde_total"))
    top = ranked(grouped, top_n, F.desc("solde_total"), "type_produit")
    return top.select(
        "type_produit", "nombre_comptes", F.col("solde_total").cast("double"),
        F.coalesce(ratio(F.col("solde_total"), whole), F.lit(0.0)).alias("part_solde"),
    )


def agent_portfolio(df: DataFrame, top_n: int | None = None) -> DataFrame:
    if not has(df, "agent_credit"):
        return empty(df, "agent_credit string, nombre_comptes bigint, nombre_clients bigint, solde_total double, "
                         "solde_moyen double")
    clients = F.count_distinct("client_id") if has(df, "client_id") else F.count("*")
    grouped = df.where(F.col("agent_credit").isNotNull()).groupBy("agent_credit").agg(
        F.count("*").alias("nombre_comptes"), clients.alias("nombre_clients"),
        exact_sum(number_or_zero(df, "solde_compte")).alias("solde_total"),
    )
    top = ranked(grouped, top_n, F.desc("solde_total"), F.desc("nombre_comptes"), "agent_credit")
    return top.select(
        "agent_credit", "nombre_comptes", "nombre_clients", F.col("solde_total").cast("double"),
        ratio(F.col("solde_total"), F.col("nombre_comptes")).alias("solde_moyen"),
    )


def phone_quality(df: DataFrame) -> DataFrame:
    if not has(df, "telephone"):
        return empty(df, "qualite_telephone string, nombre_lignes bigint, part_lignes double")
    table = shares(df, L.phone_quality(F.col("telephone")), "qualite_telephone", df)
    return in_order(table, "qualite_telephone", L.PHONE_QUALITIES)


KYC_FIELDS = ("telephone", "zone_geographique", "sexe", "categorie", "date_operation")
KYC_CLASSES = ("0 champ manquant", "1 champ manquant", "2 champs manquants", "3+ champs manquants")


def kyc_completeness(df: DataFrame) -> DataFrame:
    fields = [c for c in KYC_FIELDS if c in df.columns]
    if not fields:
        return empty(df, "classe_completude string, nombre_lignes bigint, part_lignes double")
    missing = sum((F.col(c).isNull().cast("int") for c in fields), F.lit(0))
    label = (F.when(missing == 0, KYC_CLASSES[0]).when(missing == 1, KYC_CLASSES[1])
             .when(missing == 2, KYC_CLASSES[2]).otherwise(KYC_CLASSES[3]))
    return in_order(shares(df, label, "classe_completude", df), "classe_completude", KYC_CLASSES)


def provenance_summary(df: DataFrame) -> DataFrame:
    if not has(df, "Provenance"):
        return empty(df, "`Provenance` string, nombre_lignes bigint, nombre_clients bigint, nombre_comptes bigint, "
                         "solde_total double")

    def distinct(column: str) -> Column:
        return F.count_distinct(column) if has(df, column) else F.count("*")

    return df.where(F.col("Provenance").isNotNull()).groupBy("Provenance").agg(
        F.count("*").alias("nombre_lignes"), distinct("client_id").alias("nombre_clients"),
        distinct("compte_id").alias("nombre_comptes"), total(number_or_zero(df, "solde_compte")).alias("solde_total"),
    )


# --- credit groups and arrears --------------------------------------------------------------------------------

def group_summary(df: DataFrame, group: str, top_n: int | None = None) -> DataFrame:
    if not has(df, group):
        return empty(df, f"`{group}` string, dossiers bigint, montant_demande_total double, "
                         "montant_accorde_total double, taux_retard double, risque_eleve bigint")
    grouped = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("dossiers"),
        exact_sum("montant_demande").alias("montant_demande_total"),
        total("montant_accorde").alias("montant_accorde_total"),
        ratio(count_if(delayed(df)), F.count("*")).alias("taux_retard"),
        count_if(risk_is(df, "Élevé")).alias("risque_eleve"),
    )
    top = ranked(grouped, top_n, F.desc("montant_demande_total"), F.desc("dossiers"), group)
    return top.withColumn("montant_demande_total", F.col("montant_demande_total").cast("double"))


def risk_group(df: DataFrame, group: str, top_n: int | None = None) -> DataFrame:
    if not has(df, group):
        return empty(df, f"`{group}` string, dossiers bigint, risque_eleve bigint, retard bigint, "
                         "montant_demande_total double, score_credit_moyen double")
    grouped = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("dossiers"),
        count_if(risk_is(df, "Élevé")).alias("risque_eleve"),
        count_if(delayed(df)).alias("retard"),
        exact_sum("montant_demande").alias("montant_demande_total"),
        mean("score_credit").alias("score_credit_moyen"),
    )
    top = ranked(grouped, top_n, F.desc("risque_eleve"), F.desc("retard"), F.desc("montant_demande_total"), group)
    return top.withColumn("montant_demande_total", F.col("montant_demande_total").cast("double"))


def activity(df: DataFrame, group: str, amounts: Sequence[str] = (), alert: Column | None = None,
             top_n: int | None = None) -> DataFrame:
    """Lines, amount and alerts per group; ``alert`` is a flag already present on the rows."""
    if not has(df, group):
        return empty(df, f"`{group}` string, lignes bigint, alertes bigint, montant_total double")
    present = [c for c in amounts if has(df, c)]
    value = sum((number_or_zero(df, c) for c in present), F.lit(0.0)) if present else None
    grouped = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("lignes"),
        (count_if(alert) if alert is not None else F.lit(0).cast("bigint")).alias("alertes"),
        (exact_sum(value) if present else F.lit(None).cast(MONEY)).alias("montant_total"),
    )
    order = [F.desc("montant_total")] if present else []
    top = ranked(grouped, top_n, *order, F.desc("alertes"), F.desc("lignes"), group)
    return top.withColumn("montant_total", F.col("montant_total").cast("double"))


def delay_bands(df: DataFrame) -> DataFrame:
    if not has(df, "retard_jours"):
        return empty(df, "classe_retard string, nombre_dossiers bigint")
    label = L.delay_band(number(df, "retard_jours"))
    counts = df.groupBy(label.alias("classe_retard")).agg(F.count("*").alias("nombre_dossiers"))
    return in_order(counts, "classe_retard", L.DELAY_BANDS)


def delay_amount_bands(df: DataFrame) -> DataFrame:
    if not has(df, "retard_jours"):
        return empty(df, "tranche_retard string, nombre_dossiers bigint, montant double")
    amount_column = first_existing(df, ("montant_impaye_estime", "solde_final"))
    label = L.delay_amount_band(number(df, "retard_jours"))
    measures = [F.count("*").alias("nombre_dossiers")]
    if amount_column:
        measures.append(total(number_or_zero(df, amount_column)).alias("montant"))
    grouped = df.where(label.isNotNull()).groupBy(label.alias("tranche_retard")).agg(*measures)
    return in_order(grouped, "tranche_retard", L.DELAY_AMOUNT_BANDS)


PAR_THRESHOLDS = (("PAR 1", 0), ("PAR 7", 7), ("PAR 30", 30), ("PAR 60", 60), ("PAR 90", 90))


def par_by_currency(df: DataFrame, thresholds: Sequence[tuple[str, int]] = PAR_THRESHOLDS,
                    inclusive: bool = False) -> DataFrame:
    """Portfolio at risk per currency: whole balance of the loans late by more than n days over total balance.

    One conditional aggregation per currency, unfolded to one row per threshold afterwards.
    ``inclusive`` switches the comparison to "at least n days".
    """
    if not has(df, "solde_final", "retard_jours"):
        return empty(df, "devise string, indicateur string, seuil_jours int, encours_total double, "
                         "montant_par double, taux_par double, credits_en_retard bigint")
    delay, balance = number_or_zero(df, "retard_jours"), number_or_zero(df, "solde_final")
    currency = L.or_missing(F.col("devise")) if has(df, "devise") else F.lit("Toutes devises")

    def late(days: int) -> Column:
        return (delay >= days) if inclusive else (delay > days)

    measures = [exact_sum(balance).alias("encours")]
    for i, (_, days) in enumerate(thresholds):
        measures += [exact_sum(balance, late(days)).alias(f"par{i}"), count_if(late(days)).alias(f"n{i}")]
    wide = df.groupBy(currency.alias("devise")).agg(*measures)
    lines = F.array(*[
        F.struct(F.lit(label).alias("indicateur"), F.lit(days).alias("seuil_jours"),
                 F.col(f"par{i}").alias("par"), F.col(f"n{i}").alias("n"))
        for i, (label, days) in enumerate(thresholds)
    ])
    return wide.select("devise", "encours", F.explode(lines).alias("l")).select(
        "devise", "l.indicateur", "l.seuil_jours", F.col("encours").cast("double").alias("encours_total"),
        F.col("l.par").cast("double").alias("montant_par"), ratio(F.col("l.par"), F.col("encours")).alias("taux_par"),
        F.col("l.n").alias("credits_en_retard"),
    )


def par_trend(df: DataFrame) -> DataFrame:
    """Monthly PAR rates recomputed from amounts, one row per month and indicator."""
    names = {"par_1_plus": "PAR 1+", "par_30_plus": "PAR 30+", "par_90_plus": "PAR 90+"}
    present = [c for c in names if has(df, c)]
    if not present or not has(df, "date_operation", "solde_final"):
        return empty(df, "periode date, indicateur string, taux double")
    date = stamp(df, "date_operation")
    wide = df.where(date.isNotNull()).groupBy(month_start(date).alias("periode")).agg(
        exact_sum(number_or_zero(df, "solde_final")).alias("encours"),
        *[exact_sum(number_or_zero(df, c)).alias(c) for c in present],
    )
    rates = wide.select("periode", *[(ratio(F.col(c), F.col("encours")) * 100).alias(names[c]) for c in present])
    return rates.unpivot(["periode"], [names[c] for c in present], "indicateur", "taux")


INITIAL_BANDS = ((1_000, "0-1000"), (5_000, "1001-5000"), (20_000, "5001-20000"), (100_000, "20001-100000"))


def initial_amount_band(amount: Column, bounds: Sequence[tuple[float, str]] = INITIAL_BANDS,
                        beyond: str = "100001+") -> Column:
    expr = F.when(amount.isNull(), L.MISSING)
    for limit, label in bounds:
        expr = expr.when(amount <= limit, label)
    return expr.otherwise(beyond)


PAR_AMOUNTS = ("par_1_plus", "par_30_plus", "par_90_plus")


def par_by_initial_band(df: DataFrame) -> DataFrame:
    """Balance and PAR by band of initial amount, with rates in percent."""
    sums = [c for c in (*PAR_AMOUNTS, "nb_clients", "nb_prets") if has(df, c)]
    grouped = df.groupBy("tranche_montant_initial").agg(
        total(number_or_zero(df, "solde_final")).alias("encours"),
        *[total(number_or_zero(df, c)).alias(c) for c in sums],
    )
    for column, rate in (("par_30_plus", "taux_par_30"), ("par_90_plus", "taux_par_90")):
        if column in sums:
            grouped = grouped.withColumn(rate, ratio(F.col(column), F.col("encours")) * 100)
    return grouped


def par_by_group(df: DataFrame, group: str, top_n: int | None = None) -> DataFrame:
    """Balance, PAR, arrears and provision of a branch or product, riskiest groups first."""
    provision = first_existing(df, ("mtt_provision", "provision_total"))
    measures = {"encours": "solde_final"}
    measures.update({c: c for c in ("par_30_plus", "par_90_plus") if has(df, c)})
    if has(df, "montant_operation"):
        measures["arrieres"] = "montant_operation"
    if provision:
        measures["provision"] = provision
    grouped = df.groupBy(group).agg(*[exact_sum(number_or_zero(df, c)).alias(n) for n, c in measures.items()])
    rates = []
    for column, rate in (("par_30_plus", "taux_par_30"), ("par_90_plus", "taux_par_90")):
        if column in measures:
            rates.append(ratio(F.col(column), F.col("encours")).alias(rate))
    sort = next(c for c in ("par_90_plus", "par_30_plus", "encours") if c in measures)
    top = ranked(grouped, top_n, F.desc(sort), group)
    return top.select(group, *[F.col(n).cast("double") for n in measures], *rates)


# --- savings report -------------------------------------------------------------------------------------------

# Order of the products in the report.
REPORT_ORDER = (
    "Compte courant Bwakisa Carte en USD", "Compte courant Ordinaire en USD", "Compte Epargne Ordinaire USD",
    "Compte Epargne Ordinaire Groupe USD", "Compte Salaire MILTEX USD", "Compte Courant Salaire Personnel IMF USD",
    "Compte Courant Payroll Clientèle USD", "Dépôts de garantie solidaire LISUNGI USD",
    "Dépôt de garantie Individuelle USD", "Compte POS USD", "DAT Individu", "DAT Société", "Totines USD",
    "Compte Epargne Ordinaire Individuelle Likelemba USD", "Compte courant Bwakisa Carte en CDF",
    "Compte Courant Ordinaire en CDF", "Compte Courant POS CDF", "Compte Epargne Ordinaire en CDF",
    "Compte Epargne Ordinaire Groupe CDF", "Dépôts de garantie Individuelle en CDF",
    "Dépôts de garantie solidaire LISUNGI CDF", "Totines CDF", "Compte Epargne Ordinaire Individuelle Likelemba CDF",
)


def report_lines(df: DataFrame) -> DataFrame:
    """Savings rows with their report product and currency: label first, then file currency, then USD."""
    fallback = F.nullif(F.col("source_currency"), F.lit("")) if has(df, "source_currency") else F.lit(None)
    owner = F.col("type_client") if has(df, "type_client") else F.lit(None).cast("string")
    return df.select(
        L.report_product(F.col("type_produit"), owner).alias("produits"),
        F.coalesce(L.label_currency(F.col("type_produit")), fallback, F.lit("USD")).alias("devise"),
        "compte_id", number_or_zero(df, "solde_compte").alias("solde"),
    )


def savings_report(df: DataFrame, rate: float) -> DataFrame:
    """Product lines with both currencies, totals converted at ``rate``, share of the whole, and a TOTAL line."""
    rate = float(rate) if rate > 0 else 1.0
    per_currency = report_lines(df).groupBy("produits", "devise").agg(
        F.count_distinct("compte_id").alias("comptes"), exact_sum("solde").alias("solde"))
    both = per_currency.rollup("produits").agg(
        F.grouping("produits").alias("is_total"), F.sum("comptes").alias("nbre_de_compte"),
        *[total("solde", F.col("devise") == c).alias(c) for c in ("CDF", "USD")],
    )
    lines = both.select(
        F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("produits")).alias("produits"),
        "nbre_de_compte", "CDF", "USD",
        (F.col("CDF") + F.col("USD") * rate).alias("total_general_cdf"),
        (F.col("USD") + F.col("CDF") / rate).alias("total_general_usd"),
    )
    whole = lines.where(F.col("produits") == "TOTAL").select("total_general_usd").scalar()
    return lines.withColumn("proportion", F.coalesce(ratio(F.col("total_general_usd"), whole), F.lit(0.0)))


def usable_deposits(report: DataFrame) -> DataFrame:
    """Deposits per regulatory family and the part of them that may be used."""
    family = L.regulatory_family(F.col("produits"))
    sums = report.where(F.col("produits") != "TOTAL").groupBy(family.alias("famille")).agg(
        total("total_general_usd").alias("total_general_usd"))
    return sums.select(
        "famille", "total_general_usd", L.usable_share(F.col("famille")).alias("norme"),
        (F.col("total_general_usd") * L.usable_share(F.col("famille"))).alias("montant_utilisable"),
    )


def savings_ratios(df: DataFrame, rate: float) -> DataFrame:
    """Mean deposit, share of term deposits, accounts per manager. Sums and distinct accounts are taken apart: a task keeps no sums by account."""
    rate = float(rate) if rate > 0 else 1.0
    agents = "agent_credit" if has(df, "agent_credit") else None
    lines = report_lines(df).withColumn("famille", L.regulatory_family(F.col("produits")))
    dat = F.col("produits").isin("DAT Individu", "DAT Société")
    groups = {"whole": F.lit(True), "dat": dat, **{f"f{i}": F.col("famille") == f for i, f in enumerate(L.USABLE_SHARE)}}
    sums = lines.agg(
        *[total("solde", where & (F.col("devise") == c)).alias(f"{name}_{c}")
          for name, where in groups.items() for c in ("USD", "CDF")])
    per_account = df.select("compte_id", (number_or_zero(df, "solde_compte") != 0).alias("filled")).groupBy("compte_id").agg(F.bool_or("filled").alias("filled"))
    counts = per_account.agg(F.count("compte_id").alias("accounts"), F.count(F.when(F.col("filled"), F.col("compte_id"))).alias("nonzero"))
    sums = sums.crossJoin(counts)

    def usd(name: str) -> Column:
        return F.col(f"{name}_USD") + F.col(f"{name}_CDF") / rate

    usable = F.lit(0.0)
    for i, share in enumerate(L.USABLE_SHARE.values()):
        usable = usable + usd(f"f{i}") * share
    managers = df.agg((F.count_distinct(agents) if agents else F.lit(0).cast("bigint")).alias("n")).scalar()
    return sums.select(
        usd("whole").alias("total_depots_usd"), usable.alias("montant_utilisable_usd"),
        (usd("whole") - usable).alias("reste_a_utiliser_usd"),
        F.coalesce(ratio(usd("whole"), F.col("accounts")), F.lit(0.0)).alias("depot_moyen_usd"),
        F.coalesce(ratio(usd("dat"), usd("whole")), F.lit(0.0)).alias("part_dat"),
        F.coalesce(ratio(F.col("nonzero"), managers), F.lit(0.0)).alias("comptes_par_gestionnaire"),
        F.col("accounts").alias("comptes_actifs"),
    )


def report_variation(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Line-by-line change between two savings reports; a product missing on one side counts as zero."""
    values = ("nbre_de_compte", "CDF", "USD", "total_general_cdf", "total_general_usd")
    before = previous.select("produits", *[F.col(v).alias(f"p_{v}") for v in values])
    both = current.select("produits", *values).join(before, "produits", "full_outer")

    def side(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0))

    change = [(side(v) - side(f"p_{v}")).alias(v) for v in values]
    return both.select(
        "produits", *change,
        F.coalesce(ratio(side("total_general_usd") - side("p_total_general_usd"), side("p_total_general_usd")),
                   F.lit(0.0)).alias("proportion"),
    )


# --- cross tables and top exposures ---------------------------------------------------------------------------

def cross_table(df: DataFrame, rows: str, columns: str, amount: str, values: Sequence[str]) -> DataFrame:
    """Sums of one dimension by the given values of another, zero where nothing was found."""
    cells = [total(amount, F.col(columns) == v).alias(v) for v in values]
    return df.where(F.col(rows).isNotNull()).groupBy(rows).agg(*cells)


def top_balances(df: DataFrame, groups: Sequence[str], top_n: int = 20) -> DataFrame:
    sums = df.groupBy(*groups).agg(exact_sum(number_or_zero(df, "solde_final")).alias("encours"))
    top = sums.orderBy(F.desc("encours"), *groups).limit(top_n)
    return top.withColumn("encours", F.col("encours").cast("double"))


def vintage_curve(df: DataFrame, group: str | None = None) -> DataFrame:
    """Mean PAR 30 on the initial amount, by age of the cohort and product."""
    rows = df.where(F.col("age_cohorte_mois").isNotNull() & F.col("par_30_sur_initial_pct").isNotNull())
    keys = ["age_cohorte_mois", *([group] if group else [])]
    return rows.groupBy(*keys).agg(mean("par_30_sur_initial_pct").alias("par_30_sur_initial_pct"))


def retention_trend(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Mean retention rates per month or branch, one row per rate."""
    names = {"retention_pct": "Rétention", "retention_90j_pct": "Rétention 90j"}
    present = [c for c in names if has(df, c)]
    means = df.where(key.isNotNull()).groupBy(key.alias(name)).agg(*[mean(c).alias(names[c]) for c in present])
    return means.unpivot([name], [names[c] for c in present], "indicateur", "taux")


def retention_cards(df: DataFrame) -> DataFrame:
    return df.agg(
        mean("retention_pct").alias("retention_moyenne"), mean("retention_90j_pct").alias("retention_90j_moyenne"),
        F.sum("nb_clients_arrives_echeance").alias("arrives_echeance"),
        mean("delai_moyen_renouvellement_jours").alias("delai_moyen_jours"),
    )


def repayment_counts(df: DataFrame) -> DataFrame:
    return label_counts(df, "statut_remboursement")


def mobile_operations_by_type(summary: DataFrame) -> DataFrame:
    return summary.groupBy("type_operation").agg(F.sum("nb_operations").alias("nb_operations"))
