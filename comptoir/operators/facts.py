"""Reporting measures over the credit, savings and client facts, by currency.

A filtered measure is a conditional aggregate; several measures of one fact share one pass.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.functions.money import count_if, exact_sum, mean, ratio, total
from comptoir.functions.text import contains_any
from comptoir.plans.ordered import match_null_safe

PAR_FLOORS = (1, 30, 90, 180)


def delay() -> Column:
    return F.coalesce(F.col("retard_jours"), F.lit(0))


def credit_base(loans: DataFrame) -> DataFrame:
    """Active loans, balance, provision and disbursed amount per currency."""
    return loans.groupBy("devise").agg(
        count_if(F.col("solde_final") > 0).alias("prets_actifs"), total("solde_final").alias("encours"), total("mtt_provision").alias("provision"),
        total("montant_accorde").alias("decaissements"), F.count("*").alias("prets_decaisses"))


def base_measures(loans: DataFrame, savings: DataFrame) -> DataFrame:
    saved = savings.groupBy(F.col("currency_code").alias("devise")).agg(total("balance").alias("epargne"))
    return credit_base(loans).join(saved, "devise", "full_outer")


def par_measures(loans: DataFrame, floors: tuple[int, ...] = PAR_FLOORS, strict: bool = False) -> DataFrame:
    """PAR amounts and rates per currency; ``strict`` compares with "more than", else with "at least"."""
    whole = exact_sum("solde_final")
    measures = [whole.cast("double").alias("encours")]
    for n in floors:
        part = exact_sum("solde_final", (delay() > n) if strict else (delay() >= n))
        measures += [part.cast("double").alias(f"par_{n}"), ratio(part, whole).alias(f"taux_par_{n}")]
    return loans.groupBy("devise").agg(*measures)


def savings_measures(accounts: DataFrame) -> DataFrame:
    """Clients, accounts, mean balances and the split into current, term and other savings per currency."""
    label = F.upper("type_produit")
    current = contains_any(label, ["COURANT", "ORDINAIRE"])
    term = F.contains(label, F.lit("DAT"))
    whole, cur, dat = exact_sum("solde_compte"), exact_sum("solde_compte", current), exact_sum("solde_compte", term)
    # Taken apart, a task keeps one narrow row per client or account; in one aggregation it would keep all sums beside each of them.
    sums = accounts.groupBy("devise").agg(whole.alias("whole"), cur.alias("cur"), dat.alias("dat"))
    clients, count = (accounts.groupBy("devise").agg(F.count_distinct(c).alias(name)) for c, name in (("client_id", "clients"), ("compte_id", "comptes")))
    joined = match_null_safe(match_null_safe(sums, clients, ["devise"], "inner"), count, ["devise"], "inner")
    whole, cur, dat = F.col("whole"), F.col("cur"), F.col("dat")
    return joined.select(
        "devise", "clients", "comptes", whole.cast("double").alias("epargne"), ratio(whole, F.col("comptes")).alias("solde_moyen"),
        ratio(whole, F.col("clients")).alias("solde_moyen_epargnant"), cur.cast("double").alias("encours_courant"), dat.cast("double").alias("encours_dat"),
        (whole - cur - dat).cast("double").alias("autres_epargnes"), ratio(dat, whole).alias("part_dat"))


def client_base(clients: DataFrame) -> DataFrame:
    """Distinct clients by state and their shares; flags are columns of the client fact."""
    def distinct(flag: str) -> Column:
        return F.count_distinct(F.when(F.col(flag), F.col("client_id")))

    counts = clients.agg(
        F.count_distinct("client_id").alias("clients"), distinct("client_actif").alias("clients_actifs"), distinct("avec_compte_ouvert").alias("clients_comptes_ouverts"),
        distinct("avec_compte_bloque").alias("clients_comptes_bloques"), distinct("avec_compte_dormant").alias("clients_comptes_dormants"),
        distinct("avec_credit").alias("clients_credit_a_rembourser"), distinct("avec_dat_echeance").alias("clients_dat_echeance"),
        total("montant_credit").alias("montant_credit_a_rembourser"), total("montant_dat_echeance").alias("montant_dat_echeance"))
    return counts.withColumns({
        "taux_clients_actifs": ratio(F.col("clients_actifs"), F.col("clients")), "part_dormants": ratio(F.col("clients_comptes_dormants"), F.col("clients")),
        "part_credit": ratio(F.col("clients_credit_a_rembourser"), F.col("clients_actifs"))})


def exposure_measures(loans: DataFrame) -> DataFrame:
    """Clients at risk, arrears and late loans per currency, with provision cover of the PAR 30."""
    late = delay() > 0
    par30 = exact_sum("solde_final", delay() >= 30)
    provision = exact_sum("mtt_provision")
    active = count_if(F.col("solde_final") > 0)
    late_loans = F.count_distinct(F.when(late & (F.col("solde_final") > 0), F.col("dossier_id")))
    return loans.groupBy("devise").agg(
        F.count_distinct(F.when(late & (F.col("solde_final") > 0), F.col("client_id"))).alias("clients_par"), total("montant_operation").alias("arrieres"),
        provision.cast("double").alias("provision"), late_loans.alias("credits_en_retard"), ratio(late_loans, active).alias("taux_credits_en_retard"),
        ratio(provision, par30).alias("taux_couverture_par30"))


def net_exposure(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("devise").agg(total("exposition_nette").alias("exposition_nette"))


def instalment_measures(schedule: DataFrame, day: dt.date) -> DataFrame:
    """Expected amounts after the day, and mean number of instalments left per loan."""
    ahead = F.col("date_echeance") > F.lit(day)
    per_loan = schedule.groupBy("loan_id").agg(count_if(ahead).alias("n"), exact_sum("attendu", ahead).alias("a"))
    return per_loan.agg(total("a").alias("echeances_futures"), mean("n").alias("echeances_restantes_moyennes"))


def loan_ratios(loans: DataFrame, savings: DataFrame) -> DataFrame:
    """Mean active and disbursed loan, and loans over deposits, per currency."""
    base = base_measures(loans, savings)
    return base.select(
        "devise", ratio(F.col("encours"), F.col("prets_actifs")).alias("montant_moyen_actif"), ratio(F.col("decaissements"), F.col("prets_decaisses")).alias("montant_moyen_decaisse"),
        ratio(F.col("encours"), F.col("epargne")).alias("ratio_credits_depots"))


def fact_totals(loans: DataFrame, band: Column) -> DataFrame:
    """Balance and PAR 30 by band of initial amount and by duration: what the trend pages add up."""
    par30 = delay() >= 30
    return loans.groupBy(band.alias("tranche"), F.col("duree_credit_mois").alias("duree")).agg(
        total("solde_final").alias("encours"), total("solde_final", par30).alias("par_30"), F.count_distinct("dossier_id").alias("prets"))


def period_bounds(df: DataFrame, column: str) -> DataFrame:
    """First and last date of the selection, and the last date as shown text."""
    return df.agg(F.min(F.to_date(column)).alias("date_debut"), F.max(F.to_date(column)).alias("date_fin"),
                  F.date_format(F.max(column), "dd/MM/yyyy").alias("derniere_date"))
