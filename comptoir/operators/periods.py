"""Analyses of a period from the event journal: finance, accounting, comparisons, regularity, alerts, statistics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.functions.money import MONEY, amount, count_if, exact_sum, ratio, total
from comptoir.functions.text import contains_any, none_if_blank
from comptoir.operators import positions as P
from comptoir.operators import wallet as W
from comptoir.operators.common import has, stamp

FREQUENCY = {"D": "day", "W": "week", "M": "month"}
FLOWS = {
    "montant_entrees": "montant_entree", "montant_sorties": "montant_sortie", "depots_epargne": "depot_epargne", "depots_dat": "depot_dat",
    "retraits": "retrait_epargne", "decaissements": "montant_decaisse", "remboursements_portefeuille": "remboursement_portefeuille",
    "remboursements_compte_ouvert": "remboursement_compte_ouvert",
}


# --- finance --------------------------------------------------------------------------------------------------

def flow_summary(journal: DataFrame, start: dt.date, end: dt.date, frequency: str | None = None) -> DataFrame:
    """Flows per currency over the period, or per day, week or month of it."""
    rows = journal.where(W.in_period(journal, start, end))
    keys: list = ["currency_code"]
    if frequency:
        keys.append(F.to_date(F.date_trunc(FREQUENCY[frequency], F.col("created_at"))).alias("periode"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("nombre_operations"), F.count_distinct("customer_id").alias("nombre_clients"),
        *[total(c).alias(n) for n, c in FLOWS.items()], total("montant_operation").alias("volume"))


def repayment_summary(journal: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    rows = journal.where(W.in_period(journal, start, end) & F.col("type_operation").isin(*W.REPAYMENTS))
    paid = exact_sum("remboursement_portefeuille") + exact_sum("remboursement_compte_ouvert")
    return rows.groupBy("currency_code", "origine_remboursement").agg(
        F.count("*").alias("nombre_remboursements"), paid.cast("double").alias("montant_rembourse"), total("principal_rembourse").alias("principal"),
        total("penalite_observee").alias("penalite"), count_if(~F.col("operation_symetrique")).alias("a_verifier"))


def new_credits(journal: DataFrame, loans: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Loans paid out in the journal against loan accounts created, per currency."""
    paid = journal.where(W.in_period(journal, start, end) & (F.col("type_operation") == W.DISBURSEMENT)).groupBy("currency_code").agg(
        F.count("*").alias("nombre_decaissements"), exact_sum("montant_decaisse").alias("a"))
    made = loans.where(W.in_period(loans, start, end)).groupBy("currency_code").agg(
        F.count("*").alias("nombre_comptes"), exact_sum("loan_amount").alias("b"))
    joined = paid.join(made, "currency_code", "full_outer")
    a, b = (F.coalesce(F.col(c), F.lit(0).cast(MONEY)) for c in ("a", "b"))
    return joined.select(
        "currency_code", F.coalesce("nombre_decaissements", F.lit(0)).alias("nombre_decaissements"), F.coalesce("nombre_comptes", F.lit(0)).alias("nombre_comptes"),
        a.cast("double").alias("montant_decaisse"), b.cast("double").alias("montant_initial_comptes"), (a - b).cast("double").alias("ecart"),
        F.when(F.abs(a - b) <= F.lit(0.01).cast(MONEY), "Conforme").otherwise("Ecart").alias("statut_rapprochement"))


# --- accounting -----------------------------------------------------------------------------------------------

def client_balance(ledger: DataFrame) -> DataFrame:
    """Auxiliary balance per customer and currency: movements and last balance of each position family."""
    account = F.upper("account_type")
    text = F.lower("description")
    open_, fixed, principal = account == W.OPEN, account == W.FIXED, account == W.PRINCIPAL
    moment = F.struct("created_at", "id")

    def last(where: Column) -> Column:
        return F.max_by(F.when(where, F.col("bal_after")), F.when(where, moment))

    keyed = ledger.withColumn("__e", W.event_key(ledger))
    return keyed.groupBy("customer_id", "currency_code").agg(
        F.count("*").alias("nombre_lignes"), F.count_distinct("__e").alias("nombre_operations"), total("dr").alias("total_debit"), total("cr").alias("total_credit"),
        total("cr", open_ & F.contains(text, F.lit("epargne depot"))).alias("depots_epargne"),
        total("dr", open_ & F.contains(text, F.lit("retrait vers m-pesa"))).alias("retraits_epargne"),
        last(open_).alias("solde_epargne_courante"), last(fixed).alias("solde_dat"), last(principal).alias("encours_principal"))


def account_balance(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("currency_code", "account_type").agg(
        F.count("*").alias("nombre_lignes"), F.count_distinct("customer_id").alias("nombre_clients"), total("dr").alias("total_debit"),
        total("cr").alias("total_credit"), (exact_sum("dr") - exact_sum("cr")).cast("double").alias("solde_mouvement"))


def symmetry_summary(journal: DataFrame) -> DataFrame:
    """Entries, operations and the share whose debit equals credit, per currency."""
    return journal.groupBy("currency_code").agg(
        F.sum("nombre_lignes").alias("ecritures"), F.count_distinct("customer_id").alias("clients"), F.count("*").alias("operations"),
        total("total_debit").alias("total_debit"), total("total_credit").alias("total_credit"), count_if(F.col("operation_symetrique")).alias("operations_symetriques"),
        (ratio(count_if(F.col("operation_symetrique")), F.count("*")) * 100).alias("taux_symetrie_pct"))


def balance_variation(ledger: DataFrame) -> DataFrame:
    """Share of entries whose balance changed by the size of the movement, per currency."""
    change = F.abs(F.col("bal_after") - F.col("bal_before"))
    move = F.abs(F.coalesce("dr", F.lit(0.0))) + F.abs(F.coalesce("cr", F.lit(0.0)))
    # A cent, with room for the rounding of the four doubles.
    fine = F.abs(change - move) < 0.015
    return ledger.groupBy("currency_code").agg(
        F.count("*").alias("ecritures"), count_if(fine).alias("variations_conformes"), (ratio(count_if(fine), F.count("*")) * 100).alias("taux_conforme_pct"))


def financial_products(ledger: DataFrame) -> DataFrame:
    """Interest, penalty and collection accounts, kept apart: they may be parts of one product."""
    account = F.upper("account_type")
    product = (account == W.INTEREST) | contains_any(account, ["PENALTY", "COLLECTION"])
    return ledger.where(product).groupBy("currency_code", "account_type").agg(F.count("*").alias("nombre_ecritures"), total("cr").alias("montant_observe"))


def receipt_match_rate(ledger: DataFrame, receipts: DataFrame) -> DataFrame:
    """Completed receipts whose number is a ledger reference, per currency; a proof rate, not an amount."""
    refs = ledger.select(none_if_blank(F.col("ref_no")).alias("receipt_no")).where("receipt_no IS NOT NULL").distinct().withColumn("hit", F.lit(1))
    done = receipts.where(F.col("statut") == "Completed") if has(receipts, "statut") else receipts
    joined = done.join(refs, "receipt_no", "left")
    return joined.groupBy("currency_code").agg(
        F.count("*").alias("recus_termines"), F.count("hit").alias("recus_retrouves"), (ratio(F.count("hit"), F.count("*")) * 100).alias("taux_pct"))


def filtered_balance(ledger: DataFrame, scope: DataFrame) -> DataFrame:
    """Account balance recomputed on the lines of the chosen customers and currencies only."""
    kept = ledger.join(scope.select("customer_id", "currency_code").distinct(), ["customer_id", "currency_code"], "left_semi")
    return account_balance(kept)


def tracking_pivot(ledger: DataFrame, start: dt.date, end: dt.date, balances: DataFrame | None = None) -> DataFrame:
    """Deposits and withdrawals per customer, currency and side: one column per day, total, balance and score."""
    text = F.lower("description")
    open_ = F.upper("account_type") == W.OPEN
    side = (F.when(open_ & F.contains(text, F.lit("epargne depot")), "Depot").when(open_ & F.contains(text, F.lit("retrait vers m-pesa")), "Retrait"))
    value = F.when(side == "Depot", F.col("cr")).otherwise(F.col("dr"))
    days = [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]
    rows = ledger.where(W.in_period(ledger, start, end)).select(
        "customer_id", "currency_code", side.alias("operation"), F.to_date("created_at").alias("jour"), value.alias("v"), W.event_key(ledger).alias("e"))
    rows = rows.where("operation IS NOT NULL")
    cells = [total("v", F.col("jour") == F.lit(d)).alias(d.strftime("%d/%m/%Y")) for d in days]
    wide = rows.groupBy("customer_id", "currency_code", "operation").agg(
        *cells, total("v").alias("total"), ratio(F.count_distinct("e"), F.lit(len(days))).alias("score"))
    net = rows.groupBy("customer_id", "currency_code").agg(
        (exact_sum("v", F.col("operation") == "Depot") - exact_sum("v", F.col("operation") == "Retrait")).cast("double").alias("net"))
    joined = wide.join(net, ["customer_id", "currency_code"], "left")
    if balances is not None:
        held = balances.groupBy("customer_id", "currency_code").agg(total("balance").alias("held"))
        joined = joined.join(held, ["customer_id", "currency_code"], "left")
        return joined.withColumn("solde", F.coalesce("held", "net")).drop("held", "net")
    return joined.withColumnRenamed("net", "solde")


def wallet_flows(journal: DataFrame) -> DataFrame:
    """Daily wallet entries and outputs per currency."""
    rows = journal.where("passe_par_portefeuille")
    return rows.groupBy(F.to_date("created_at").alias("jour"), "currency_code").agg(
        total("entree_portefeuille").alias("entrees"), total("sortie_portefeuille").alias("sorties"))


def operations_per_type(journal: DataFrame) -> DataFrame:
    return journal.groupBy("type_operation").agg(F.count("*").alias("nombre"))


# --- regularity, activity, alerts -----------------------------------------------------------------------------

def regular_deposits(journal: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Days with a deposit to the open account over the days of the period, per customer and currency."""
    days = (end - start).days + 1
    rows = journal.where(W.in_period(journal, start, end) & (F.col("depot_epargne") > 0))
    grouped = rows.groupBy("customer_id", "currency_code").agg(
        F.count("*").alias("nombre_depots"), total("depot_epargne").alias("montant_depots"), F.count_distinct(F.to_date("created_at")).alias("jours_avec_depot"))
    score = F.col("jours_avec_depot") * F.lit(100.0) / F.lit(days)
    label = F.when(score >= 70, "Très régulier").when(score >= 40, "Régulier").when(score >= 10, "Occasionnel").otherwise("Faible activité")
    return grouped.withColumns({"score_regularite_pct": score, "categorie_regularite": label})


def regularity_summary(clients: DataFrame) -> DataFrame:
    return clients.groupBy("currency_code", "categorie_regularite").agg(F.count("*").alias("clients"), total("montant_depots").alias("montant_depots"))


def unusual_against_baseline(journal: DataFrame, day: dt.date, current: int = 7, baseline: int = 90, multiple: float = 3.0) -> DataFrame:
    """Mean daily volume of the last days against that of the days before, per customer and currency, in one pass."""
    end = F.lit(day + dt.timedelta(days=1)).cast("timestamp_ntz")
    cut = F.lit(day + dt.timedelta(days=1 - current)).cast("timestamp_ntz")
    first = F.lit(day + dt.timedelta(days=1 - current - baseline)).cast("timestamp_ntz")
    date = stamp(journal, "created_at")
    now, before = (date >= cut) & (date < end), (date >= first) & (date < cut)
    grouped = journal.where((date >= first) & (date < end)).groupBy("customer_id", "currency_code").agg(
        exact_sum("montant_operation", now).alias("a"), exact_sum("montant_operation", before).alias("b"), count_if(now).alias("operations"))
    daily, base = F.col("a").cast("double") / current, F.col("b").cast("double") / baseline
    return grouped.where("operations > 0").select(
        "customer_id", "currency_code", "operations", F.col("a").cast("double").alias("volume_courant"), base.alias("moyenne_reference"),
        ratio(daily, base).alias("multiple"), F.when(F.col("b") == 0, "Sans historique").when(daily >= base * multiple, "Inhabituel").otherwise("Habituel").alias("lecture"))


THRESHOLDS = {"CDF": {"fractionnement": 14_000_000.0, "important": 28_000_000.0}, "USD": {"fractionnement": 5_000.0, "important": 10_000.0}}


def transaction_alerts(journal: DataFrame, start: dt.date, end: dt.date, thresholds: Mapping[str, Mapping[str, float]] = THRESHOLDS) -> DataFrame:
    """Large single operations, and days on which several smaller ones reach the structuring threshold."""
    def limit(kind: str) -> Column:
        table = F.create_map(*[x for c, t in thresholds.items() for x in (F.lit(c), F.lit(float(t[kind])))])
        return F.try_element_at(table, F.col("currency_code"))

    rows = journal.where(W.in_period(journal, start, end)).withColumn("v", F.col("montant_operation"))
    large = rows.where(F.col("v") >= limit("important")).groupBy("customer_id", "currency_code", F.to_date("created_at").alias("jour")).agg(
        F.lit("Transaction importante").alias("alerte"), F.count("*").alias("operations"), exact_sum("v").alias("s"))
    small = rows.where(F.col("v") < limit("fractionnement")).groupBy("customer_id", "currency_code", F.to_date("created_at").alias("jour")).agg(
        F.lit("Fractionnement potentiel").alias("alerte"), F.count("*").alias("operations"), exact_sum("v").alias("s"))
    small = small.where((F.col("operations") >= 2) & (F.col("s") >= limit("fractionnement")))
    return large.unionByName(small).withColumn("montant", F.col("s").cast("double")).drop("s")


def inactive_movements(journal: DataFrame, savings: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Operations of the period by customers whose accounts in the currency are all empty."""
    held = savings.groupBy("customer_id", "currency_code").agg(exact_sum("balance").alias("s"))
    empty = held.where(F.col("s") <= 0).select("customer_id", "currency_code")
    rows = journal.where(W.in_period(journal, start, end)).join(empty, ["customer_id", "currency_code"], "left_semi")
    return rows.groupBy("customer_id", "currency_code").agg(F.count("*").alias("operations"), total("montant_operation").alias("montant"))


def deposit_frequency(journal: DataFrame, start: dt.date, end: dt.date, least: int = 3) -> DataFrame:
    """Customers with at least so many deposits in a week."""
    rows = journal.where(W.in_period(journal, start, end) & (F.col("depot_epargne") > 0))
    weekly = rows.groupBy("customer_id", "currency_code", F.to_date(F.date_trunc("week", F.col("created_at"))).alias("semaine")).agg(
        F.count_distinct("event_key").alias("nombre_depots"), total("depot_epargne").alias("montant"))
    return weekly.where(F.col("nombre_depots") >= least)


# --- comparisons ----------------------------------------------------------------------------------------------

WINDOWS = {"7 jours glissants": 7, "15 jours glissants": 15, "30 jours glissants": 30}


def comparison_windows(end: dt.date, start: dt.date | None = None, mode: str = "7 jours glissants") -> dict[str, dt.date]:
    """Two consecutive windows of equal length: rolling days, or the chosen period and the one before it."""
    if mode in WINDOWS:
        length = WINDOWS[mode]
        first = end - dt.timedelta(days=length - 1)
    elif mode == "Période filtrée":
        if start is None or start > end:
            raise ValueError("the filtered period needs a start before its end")
        first, length = start, (end - start).days + 1
    else:
        raise ValueError(f"unknown comparison window: {mode}")
    return {"debut_courante": first, "fin_courante": end, "debut_precedente": first - dt.timedelta(days=length),
            "fin_precedente": first - dt.timedelta(days=1)}


def year_windows(start: dt.date, end: dt.date) -> dict[str, dt.date]:
    """The period and the same calendar dates one year earlier (29 February falls back to the 28th)."""
    def back(day: dt.date) -> dt.date:
        try:
            return day.replace(year=day.year - 1)
        except ValueError:
            return day.replace(year=day.year - 1, day=28)

    return {"debut_courante": start, "fin_courante": end, "debut_precedente": back(start), "fin_precedente": back(end)}


def growth(current: Column, previous: Column) -> Column:
    """Change in percent; null when there is nothing to compare with."""
    return ratio(current - previous, previous) * 100


def _both(df: DataFrame, w: Mapping[str, dt.date], column: str) -> tuple[Column, Column]:
    return (W.in_period(df, w["debut_courante"], w["fin_courante"], column), W.in_period(df, w["debut_precedente"], w["fin_precedente"], column))


def compare_periods(journal: DataFrame, loans: DataFrame, savings: DataFrame, windows: Mapping[str, dt.date]) -> DataFrame:
    """Clients, operations, volumes, repayments, deposits and new products in two windows.

    Each source is read once: both windows are conditional aggregates of the same pass. Counts are given overall
    (empty currency), amounts per currency.
    """
    now, before = _both(journal, windows, "created_at")
    l_now, l_before = _both(loans, windows, "created_at")
    s_now, s_before = _both(savings, windows, "date_approved")
    fixed = F.col("account_type") == W.FIXED

    def line(frame: DataFrame, key: str, current: str, previous: str, currency: bool) -> DataFrame:
        cur = F.col("currency_code") if currency else F.lit("")
        return frame.select(F.lit(key).alias("indicateur"), cur.alias("currency_code"), F.col(current).cast("double").alias("valeur_courante"),
                            F.col(previous).cast("double").alias("valeur_precedente"))

    overall = journal.where(now | before).agg(
        F.count_distinct(F.when(now, F.col("customer_id"))).alias("c1"), F.count_distinct(F.when(before, F.col("customer_id"))).alias("c2"),
        count_if(now).alias("o1"), count_if(before).alias("o2"))
    repaid = F.col("remboursement_portefeuille") + F.col("remboursement_compte_ouvert")
    revenue = F.col("interet_observe") + F.col("penalite_observee")
    money = journal.where(now | before).groupBy("currency_code").agg(*[m for n, v in (
        ("volume_transactions", F.col("montant_operation")), ("remboursements", repaid), ("depots_dat", F.col("depot_dat")), ("produits_observes", revenue))
        for m in (exact_sum(v, now).alias(f"{n}1"), exact_sum(v, before).alias(f"{n}2"))])
    credits = loans.where(l_now | l_before)
    made = credits.agg(count_if(l_now).alias("n1"), count_if(l_before).alias("n2"))
    lent = credits.groupBy("currency_code").agg(
        exact_sum("loan_amount", l_now).alias("m1"), exact_sum("loan_amount", l_before).alias("m2"),
        exact_sum(P.loan_balance(loans), l_now).alias("e1"), exact_sum(P.loan_balance(loans), l_before).alias("e2"))
    opened = savings.where(s_now | s_before)
    accounts = opened.agg(
        count_if(s_now & ~fixed).alias("o1"), count_if(s_before & ~fixed).alias("o2"), count_if(s_now & fixed).alias("d1"), count_if(s_before & fixed).alias("d2"))
    held = opened.groupBy("currency_code").agg(
        exact_sum("balance", s_now & ~fixed).alias("o1"), exact_sum("balance", s_before & ~fixed).alias("o2"),
        exact_sum("balance", s_now & fixed).alias("d1"), exact_sum("balance", s_before & fixed).alias("d2"))
    parts = [
        line(overall, "clients_actifs", "c1", "c2", False), line(overall, "operations", "o1", "o2", False),
        *[line(money, n, f"{n}1", f"{n}2", True) for n in ("volume_transactions", "remboursements", "depots_dat", "produits_observes")],
        line(made, "nouveaux_credits", "n1", "n2", False), line(lent, "montant_nouveaux_credits", "m1", "m2", True),
        line(lent, "encours_credits_crees", "e1", "e2", True), line(accounts, "nouveaux_comptes_ouverts", "o1", "o2", False),
        line(accounts, "nouveaux_dat", "d1", "d2", False), line(held, "encours_epargne_ouverte_creee", "o1", "o2", True),
        line(held, "encours_dat_cree", "d1", "d2", True),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    a, b = F.col("valeur_courante"), F.col("valeur_precedente")
    return out.withColumns({"ecart": a - b, "evolution_pct": growth(a, b),
                            "lecture": F.when((b == 0) & (a > 0), "Nouvelle activité").when(b == 0, "Sans activité").otherwise("Comparable")})


def coverage(df: DataFrame, windows: Mapping[str, dt.date], column: str = "created_at") -> DataFrame:
    """Whether the dates of a source reach over both windows: complete, partial or not calculable."""
    date = F.to_date(stamp(df, column))
    bounds = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    inside = (F.col("a") <= F.lit(windows["debut_precedente"])) & (F.col("b") >= F.lit(windows["fin_courante"]))
    return bounds.select("a", "b", F.when(F.col("a").isNull(), "Non calculable").when(inside, "Complete").otherwise("Partielle").alias("couverture"))


# --- statistics -----------------------------------------------------------------------------------------------

def statistics(journal: DataFrame, savings: DataFrame, loans: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """One line per block and indicator: what the composed reports say about the period, currencies apart."""
    flows = flow_summary(journal, start, end)
    portfolio = P.savings_portfolio(savings)
    credit = P.credit_portfolio(loans)
    regular = regularity_summary(regular_deposits(journal, start, end)).where(F.col("categorie_regularite") == "Très régulier")

    def lines(df: DataFrame, block: str, measures: Sequence[str], suffix: str | None = None) -> DataFrame:
        named = [F.struct((F.concat(F.lit(f"{m} "), F.col(suffix)) if suffix else F.lit(m)).alias("indicateur"), F.col(m).cast("double").alias("valeur"))
                 for m in measures]
        return df.select(F.lit(block).alias("bloc"), "currency_code", F.explode(F.array(*named)).alias("l")).select("bloc", "currency_code", "l.*")

    return (lines(flows, "Transactions", ["nombre_operations", "nombre_clients", "volume", "montant_entrees", "montant_sorties"])
            .unionByName(lines(portfolio, "Comptes", ["nombre_comptes", "encours_actuel"], "famille_epargne"))
            .unionByName(lines(credit, "Credits", ["nombre_credits", "emprunteurs", "encours_credit"]))
            .unionByName(lines(regular, "Clients", ["clients", "montant_depots"])))


def management_sources(sources: Mapping[str, DataFrame], amounts: Sequence[str]) -> DataFrame:
    """Which sources are loaded, with how many rows, and which of them supply amounts."""
    out = None
    for name, df in sources.items():
        part = df.agg(F.lit(name).alias("source"), F.count("*").alias("lignes"), F.lit(name in amounts).alias("intervient_dans_les_montants"))
        out = part if out is None else out.unionByName(part)
    return out
