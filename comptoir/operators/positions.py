"""Savings and loan positions: reconciliations, maturity, risk, concentration and the cockpits built on them.

Snapshots are stocks; flows come only from the event journal. Each side is aggregated to its key before any join,
so neither savings nor loans are multiplied.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.functions.money import MONEY, amount, count_if, exact_sum, ratio, total
from comptoir.functions.text import none_if_blank
from comptoir.operators import wallet as W
from comptoir.operators.common import has, stamp
from comptoir.operators.filters import as_of as rows_as_of
from comptoir.operators.rules import Rule, reasons
from comptoir.plans.ordered import accumulate, join_known, match_null_safe, partition_count, quantile_by

KEY = ("customer_id", "currency_code")


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def money_or_zero(column: str) -> Column:
    return F.coalesce(amount(column), zero())


def loan_balance(df: DataFrame) -> Column:
    """The balance where given, else the outstanding parts."""
    parts = [c for c in ("outstanding_principle", "outstanding_principal", "outstanding_interest", "outstanding_setup_fees", "outstanding_penalty_fees")
             if has(df, c)]
    rest = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in parts), F.lit(0.0))
    return F.coalesce(F.col("loan_balance"), rest) if has(df, "loan_balance") else rest


def open_accounts(savings: DataFrame) -> DataFrame:
    return savings.where(F.col("account_type") == W.OPEN)


def term_deposits(savings: DataFrame) -> DataFrame:
    return savings.where(F.col("account_type") == W.FIXED)


def dealt(savings: DataFrame, *columns: str) -> DataFrame:
    """These columns of the accounts, dealt out by number: what a task aggregates does not follow the size of a file's split."""
    kept = list(dict.fromkeys([*(["savings_id"] if has(savings, "savings_id") else []), *columns]))
    return savings.select(*kept).repartition(partition_count(savings), *kept)


# --- reconciliations ------------------------------------------------------------------------------------------

def link_loans(loans: DataFrame, savings: DataFrame) -> DataFrame:
    """Savings account of each loan: by identifier, else the only open account of the customer in the currency.

    Anything ambiguous is left for review; without any savings account nothing can be said.
    """
    by_id = dealt(savings, *KEY, "msisdn").groupBy(F.col("savings_id").alias("savings_account_id")).agg(
        F.count("*").alias("d_n"), F.min("customer_id").alias("d_customer"), F.min("currency_code").alias("d_cur"), F.min("msisdn").alias("d_phone"))
    by_key = dealt(open_accounts(savings), *KEY, "msisdn").groupBy(*KEY).agg(
        F.count("*").alias("c_n"), F.min("savings_id").alias("c_id"), F.min("msisdn").alias("c_phone"))
    # Most loans name no account.
    named = loans.select("loan_id", *KEY, "savings_account_id", *(["msisdn1"] if has(loans, "msisdn1") else []))
    joined = join_known(join_known(named, by_id, ["savings_account_id"]), by_key, KEY)
    any_savings = savings.agg(F.count("*").alias("n")).scalar() > 0
    direct_wanted = F.col("savings_account_id").isNotNull()
    direct = direct_wanted & (F.col("d_n") == 1)
    alone = ~direct_wanted & (F.col("c_n") == 1)
    phone = F.col("msisdn1") if has(loans, "msisdn1") else F.lit(None).cast("string")
    no = F.lit(False)

    def differs(a: Column, b: Column) -> Column:
        return F.coalesce(a != b, no)

    rules: list[Rule] = [
        (direct_wanted & F.col("d_n").isNull(), "Identifiant direct introuvable"),
        (direct_wanted & (F.col("d_n") > 1), "Plusieurs comptes pour l'identifiant direct"),
        (direct & differs(F.col("d_customer"), F.col("customer_id")), "Ecart de client"),
        (direct & differs(F.col("d_cur"), F.col("currency_code")), "Ecart de devise"),
        (direct & differs(F.col("d_phone"), phone), "Ecart de telephone"),
        (alone & differs(F.col("c_phone"), phone), "Ecart de telephone"),
        (~direct_wanted & F.col("c_n").isNull(), "Aucun compte courant"),
        (~direct_wanted & (F.col("c_n") > 1), "Plusieurs comptes courants"),
    ]
    reason = reasons(rules)
    status = F.when(~any_savings, "Non calculable").when(reason.isNotNull(), "A revoir").otherwise("Conforme")
    return joined.select(
        "loan_id", *KEY, F.when(direct, F.col("savings_account_id")).when(alone, F.col("c_id")).alias("savings_id_correspondant"),
        F.when(direct, "Identifiant direct").when(alone, "Client x devise").alias("methode_rapprochement"), direct.alias("liaison_directe"),
        status.alias("statut_controle"), F.when(any_savings, reason).alias("motif_controle"))


def client_positions(loans: DataFrame, savings: DataFrame) -> DataFrame:
    """Loans, open accounts and positive term deposits side by side per customer and currency."""
    lent = loans.groupBy(*KEY).agg(
        F.count("*").alias("nombre_credits"), exact_sum("loan_amount").alias("m"), exact_sum(loan_balance(loans)).alias("e"))
    opened = dealt(open_accounts(savings), *KEY, "balance").groupBy(*KEY).agg(F.count("*").alias("comptes_ouverts"), exact_sum("balance").alias("o"))
    blocked = dealt(term_deposits(savings).where("balance > 0"), *KEY, "balance").groupBy(*KEY).agg(
        F.count("*").alias("nombre_dat"), exact_sum("balance").alias("d"))
    joined = lent.join(opened, list(KEY), "full_outer").join(blocked, list(KEY), "full_outer")

    def value(c: str) -> Column:
        return F.coalesce(F.col(c), zero())

    return joined.select(
        *KEY, F.coalesce("nombre_credits", F.lit(0)).alias("nombre_credits"), F.coalesce("comptes_ouverts", F.lit(0)).alias("comptes_ouverts"),
        F.coalesce("nombre_dat", F.lit(0)).alias("nombre_dat"), value("m").cast("double").alias("montant_accorde"), value("e").cast("double").alias("encours_credit"),
        value("o").cast("double").alias("compte_ouvert"), value("d").cast("double").alias("dat_positif"), (value("o") + value("d")).cast("double").alias("epargne_totale"))


def link_summary(detail: DataFrame, clients: DataFrame) -> DataFrame:
    """Share of matched loans per currency, with each client's savings counted once."""
    linked = detail.groupBy("currency_code").agg(
        F.count("*").alias("nombre_credits"), count_if(F.col("savings_id_correspondant").isNotNull()).alias("rapproches"),
        count_if(F.col("statut_controle") == "A revoir").alias("a_revoir"))
    sums = clients.where("nombre_credits > 0").groupBy("currency_code").agg(
        total("encours_credit").alias("encours_credit"), total("compte_ouvert").alias("compte_ouvert_clients"), total("dat_positif").alias("dat_clients"))
    return linked.join(sums, "currency_code", "left").withColumn("taux_rapprochement_pct", ratio(F.col("rapproches"), F.col("nombre_credits")) * 100)


MASTER_KEY = ("customer_id", "currency_code", "date_approved", "maturity_date", "solde")


def reconcile_accounts(master: DataFrame, extract: DataFrame, keys: Sequence[str] = MASTER_KEY) -> DataFrame:
    """Full comparison of the master accounts with a summary extract; equal accounts are compared by number."""
    def side(df: DataFrame, name: str) -> DataFrame:
        cents = df.withColumn("solde", F.round(amount("balance"), 2))
        return cents.where("balance > 0").groupBy(*keys).agg(F.count("*").alias(name))

    a, b = side(master, "n_maitre"), side(extract, "n_extrait")
    text = [F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys]
    # A key column may be empty; its text form makes empty values meet.
    joined = a.withColumn("__k", F.concat_ws("|", *text)).join(
        b.withColumn("__k", F.concat_ws("|", *text)).select("__k", "n_extrait", *[F.col(k).alias(f"x_{k}") for k in keys]), "__k", "full_outer")
    m, x = F.coalesce("n_maitre", F.lit(0)), F.coalesce("n_extrait", F.lit(0))
    status = F.when(m == x, "Retrouve").when(x == 0, "Absent de l'extrait").when(m == 0, "Absent de la source maitre").otherwise("Nombre different")
    return joined.select(*[F.coalesce(F.col(k), F.col(f"x_{k}")).alias(k) for k in keys], m.alias("n_maitre"), x.alias("n_extrait"), status.alias("statut"))


def reconciliation_status(compared: DataFrame, with_extract: bool = True) -> DataFrame:
    counts = compared.agg(F.count("*").alias("cles"), count_if(F.col("statut") == "Retrouve").alias("retrouvees"),
                          F.coalesce(F.sum("n_maitre"), F.lit(0)).alias("comptes_maitre"), F.coalesce(F.sum("n_extrait"), F.lit(0)).alias("comptes_extrait"))
    status = F.when(F.lit(not with_extract), "Source autonome").when(F.col("cles") == F.col("retrouvees"), "Concordance exacte").otherwise("Ecarts a analyser")
    return counts.withColumn("statut_rapprochement", status)


def active_loans(loans: DataFrame) -> DataFrame:
    return loans.where(loan_balance(loans) > 0)


def deposits_without_loan(savings: DataFrame, loans: DataFrame) -> DataFrame:
    """Positive term deposits of customers without an active loan in the same currency."""
    return term_deposits(savings).where("balance > 0").join(active_loans(loans).select(*KEY).distinct(), list(KEY), "left_anti")


def savings_without_loan(savings: DataFrame, loans: DataFrame, quantile: float = 0.90) -> DataFrame:
    """Customers whose savings reach the given percentile of their currency, without an active loan."""
    held = savings.where("balance > 0").groupBy(*KEY).agg(total("balance").alias("epargne"))
    limit = quantile_by(held, ["currency_code"], "epargne", quantile, "seuil")
    strong = held.join(limit, "currency_code").where("epargne >= seuil")
    return strong.join(active_loans(loans).select(*KEY).distinct(), list(KEY), "left_anti")


# --- term deposits --------------------------------------------------------------------------------------------

MATURITY_BANDS = ("Echu", "Aujourd'hui", "0 a 7 jours", "8 a 30 jours", "31 a 60 jours", "61 a 90 jours", "Plus de 90 jours", "Non renseignee")
TERM_RATE = 11.0


def maturity_band(days: Column) -> Column:
    return (F.when(days.isNull(), MATURITY_BANDS[7]).when(days < 0, MATURITY_BANDS[0]).when(days == 0, MATURITY_BANDS[1])
            .when(days <= 7, MATURITY_BANDS[2]).when(days <= 30, MATURITY_BANDS[3]).when(days <= 60, MATURITY_BANDS[4])
            .when(days <= 90, MATURITY_BANDS[5]).otherwise(MATURITY_BANDS[6]))


def deposit_maturity(savings: DataFrame, day: dt.date, rate: float = TERM_RATE, horizon: int = 30) -> DataFrame:
    """Positive term deposits with days left, band and simple interest at maturity; rate 0 switches the estimate off."""
    left = F.datediff("maturity_date", F.lit(day))
    term = F.datediff("maturity_date", "date_approved")
    interest = F.col("balance") * F.lit(rate / 100) * term / F.lit(365) if rate > 0 else F.lit(None).cast("double")
    return term_deposits(savings).where("balance > 0").select(
        "savings_id", *KEY, "balance", "date_approved", "maturity_date", term.alias("duree_contractuelle_jours"), left.alias("jours_avant_echeance"),
        maturity_band(left).alias("tranche_echeance"), (left <= horizon).alias("a_preparer"), F.lit(rate).alias("taux_annuel_pct"),
        interest.alias("interet_estime"), (F.col("balance") + interest).alias("capital_plus_interet"))


def maturity_summary(detail: DataFrame) -> DataFrame:
    return detail.groupBy("currency_code", "tranche_echeance").agg(
        F.count("*").alias("nombre_dat"), F.count_distinct("customer_id").alias("nombre_clients"), total("balance").alias("capital"),
        total("interet_estime").alias("interet_estime"))


def deposit_schedule(detail: DataFrame, horizon: int) -> DataFrame:
    """Contractual payments of the coming days: capital and interest per day and currency."""
    due = detail.where(F.col("jours_avant_echeance").between(0, horizon))
    return due.groupBy("maturity_date", "currency_code").agg(
        F.count("*").alias("nombre_dat"), total("balance").alias("capital"), total("interet_estime").alias("interet_estime"),
        total("capital_plus_interet").alias("a_payer"))


def large_depositors(savings: DataFrame, day: dt.date, quantile: float = 0.90) -> DataFrame:
    """Total, rank and strength of each term-deposit customer in its currency."""
    left = F.datediff("maturity_date", F.lit(day))
    held = term_deposits(savings).where("balance > 0").groupBy(*KEY).agg(
        F.count("*").alias("nb_comptes_dat"), exact_sum("balance").alias("s"), total("balance", left.between(0, 30)).alias("solde_echeance_30j"),
        total("balance", left < 0).alias("solde_dat_echu"))
    valued = held.withColumn("solde_dat_total", F.col("s").cast("double"))
    limit = quantile_by(valued, ["currency_code"], "solde_dat_total", quantile, "seuil")
    ranked = accumulate(valued, ["currency_code"], [F.col("s").desc(), F.col("customer_id").asc()], "rang_devise")
    joined = match_null_safe(ranked, limit, ["currency_code"], "left")
    return joined.select(*KEY, "nb_comptes_dat", "solde_dat_total", "solde_echeance_30j", "solde_dat_echu", "rang_devise",
                         (F.col("solde_dat_total") >= F.col("seuil")).alias("est_fort_dat"))


def depositor_portfolio(savings: DataFrame, day: dt.date) -> DataFrame:
    left = F.datediff("maturity_date", F.lit(day))
    return term_deposits(savings).where("balance > 0").groupBy("currency_code").agg(
        F.count("*").alias("nb_comptes"), F.count_distinct("customer_id").alias("nb_clients"), total("balance").alias("total_dat"),
        total("balance", left.between(0, 30)).alias("solde_echeance_30j"), total("balance", left < 0).alias("solde_dat_echu"))


# --- concentration --------------------------------------------------------------------------------------------

def concentration(balances: DataFrame, value: str = "encours", groups: Sequence[str] = ("currency_code",)) -> DataFrame:
    """Rank, share and cumulative share of each customer inside its currency (and family)."""
    groups = list(groups)
    ranked = accumulate(balances, groups, [F.col(value).desc(), F.col("customer_id").asc()], "rang", amounts={"__cum": F.col(value)})
    sums = balances.groupBy(*groups).agg(exact_sum(value).alias("__t"))
    joined = match_null_safe(ranked, sums, groups, "inner")
    return joined.select(*balances.columns, "rang", ratio(amount(value), F.col("__t")).alias("part"), ratio(F.col("__cum"), F.col("__t")).alias("part_cumulee"))


def concentration_summary(ranked: DataFrame, groups: Sequence[str] = ("currency_code",)) -> DataFrame:
    """Share of the first 5, 10 and 20 customers and the Herfindahl index, per currency."""
    tops = [exact_sum("part", F.col("rang") <= n).cast("double").alias(f"part_top_{n}") for n in (5, 10, 20)]
    square = (F.col("part") * F.col("part")).cast("decimal(28,18)")
    return ranked.groupBy(*groups).agg(F.count("*").alias("nombre_clients"), *tops, F.sum(square).cast("double").alias("hhi"))


# Amount bands per currency (upper bounds, exclusive).
BANDS = {
    "CDF": ((500_000, "Moins de 500 000"), (1_000_000, "500 000 a 999 999"), (5_000_000, "1 000 000 a 4 999 999"), (None, "5 000 000 et plus")),
    "USD": ((100, "Moins de 100"), (500, "100 a 499,99"), (1_000, "500 a 999,99"), (None, "1 000 et plus")),
}


def amount_band(value: Column, currency: Column) -> Column:
    expr = F.when(F.lit(False), "")
    for code, bands in BANDS.items():
        for limit, label in bands:
            inside = currency == code
            expr = expr.when(inside & (value < limit) if limit is not None else inside, label)
    return expr.otherwise("Devise hors tranches")


def band_summary(balances: DataFrame, value: str = "encours", groups: Sequence[str] = ("currency_code",)) -> DataFrame:
    band = amount_band(F.col(value), F.col("currency_code"))
    return balances.groupBy(*groups, band.alias("tranche_encours")).agg(F.count("*").alias("nombre_clients"), total(value).alias("encours_total"))


# --- credit ---------------------------------------------------------------------------------------------------

PAR_DAYS = (1, 7, 30, 90, 180)


def credit_detail(loans: DataFrame, day: dt.date) -> DataFrame:
    """Balance, days late, exclusive risk level and maturity band of each loan, from its due date."""
    late = F.datediff(F.lit(day), F.to_date("due_date"))
    balance = loan_balance(loans)
    level = F.when(F.col("due_date").isNull(), "Echeance_non_renseignee")
    for n in reversed(PAR_DAYS):
        level = level.when(late >= n, f"PAR{n}")
    flags = [c for c in ("defaulted", "is_rollover", "is_grace_period", "status_name") if has(loans, c)]
    return loans.select(
        "loan_id", *KEY, F.col("loan_amount"), balance.alias("encours"), "created_at", "due_date", *flags, F.greatest(late, F.lit(0)).alias("jours_retard"),
        level.otherwise("Sain").alias("niveau_risque"), maturity_band(-late).alias("tranche_echeance")).where(F.col("encours") > 0)


def credit_risk(detail: DataFrame) -> DataFrame:
    """Simplified PAR at several thresholds per currency, from due dates; one conditional aggregation."""
    late = F.coalesce("jours_retard", F.lit(0))
    whole = exact_sum("encours")
    measures = [F.count("*").alias("nombre_credits"), F.count_distinct("customer_id").alias("nombre_clients"), whole.cast("double").alias("encours_total")]
    for n in PAR_DAYS:
        part = exact_sum("encours", late >= n)
        measures += [part.cast("double").alias(f"encours_par_{n}"), count_if(late >= n).alias(f"credits_par_{n}"),
                     (ratio(part, whole) * 100).alias(f"par_{n}_pct")]
    return detail.groupBy("currency_code").agg(*measures)


def credit_levels(detail: DataFrame) -> DataFrame:
    return detail.groupBy("currency_code", "niveau_risque").agg(
        F.count_distinct("loan_id").alias("nombre_credits"), total("encours").alias("encours_total"))


def credit_maturities(detail: DataFrame) -> DataFrame:
    return detail.groupBy("currency_code", "tranche_echeance").agg(
        F.count("*").alias("nombre_credits"), total("encours").alias("encours_credit"))


def credit_cohorts(loans: DataFrame, day: dt.date) -> DataFrame:
    """Loans by month of creation as they stand on the day: number, initial amount, balance, amount over 30 days late."""
    late = F.datediff(F.lit(day), F.to_date("due_date"))
    balance = loan_balance(loans)
    return loans.groupBy(F.date_format("created_at", "yyyy-MM").alias("cohorte"), "currency_code").agg(
        F.count("*").alias("nombre_credits"), total("loan_amount").alias("montant_initial"), total(balance).alias("encours"),
        total(balance, late >= 30).alias("encours_par_30"))


def credit_portfolio(loans: DataFrame) -> DataFrame:
    def flagged(c: str) -> Column:
        return count_if(F.coalesce(F.col(c), F.lit(False))) if has(loans, c) else F.lit(0).cast("bigint")

    return loans.groupBy("currency_code").agg(
        F.count("*").alias("nombre_credits"), F.count_distinct("customer_id").alias("emprunteurs"), total("loan_amount").alias("montant_accorde"),
        total(loan_balance(loans)).alias("encours_credit"), flagged("defaulted").alias("prets_defaut"),
        flagged("is_rollover").alias("prets_renouveles"), flagged("is_grace_period").alias("prets_en_grace"))


def credit_actions(detail: DataFrame, quantile: float = 0.90) -> DataFrame:
    """Loans to follow, one row per loan with the lists it belongs to."""
    limit = quantile_by(detail, ["currency_code"], "encours", quantile, "seuil")
    work = match_null_safe(detail, limit, ["currency_code"], "left")
    late = F.coalesce("jours_retard", F.lit(0))
    rules: list[Rule] = [
        (F.col("tranche_echeance") == "Echu", "Echu avec encours"), (late >= 30, "PAR simplifie 30 jours"),
        (F.col("encours") >= F.col("seuil"), "Forte exposition"),
        (F.col("tranche_echeance").isin("Aujourd'hui", "0 a 7 jours", "8 a 30 jours"), "Echeance sous 30 jours")]
    if has(detail, "defaulted"):
        rules.append((F.coalesce("defaulted", F.lit(False)), "En defaut"))
    return work.withColumn("listes_action", reasons(rules)).where("listes_action IS NOT NULL").drop("seuil")


# --- digital risk ---------------------------------------------------------------------------------------------

RATES = {"dat_client": 11.0, "dat_partner": 3.0, "credit_lender": 5.0, "credit_partner": 2.0}


def coverage_segment(percent: Column, has_credit: Column, none_label: str) -> Column:
    return (F.when(~has_credit, "sans_credit").when(F.coalesce(percent, F.lit(0.0)) == 0, none_label).when(percent < 50, "couverture_moins_50_pct")
            .when(percent < 75, "couverture_50_75_pct").when(percent < 100, "couverture_75_100_pct").otherwise("couverture_100_pct_plus"))


def loan_months(loans: DataFrame) -> Column:
    """Duration of a loan in months: instalments of a monthly period, else the gap from creation to due date."""
    gap = F.greatest(F.datediff(F.to_date("due_date"), F.to_date("created_at")) / F.lit(30.4375), F.lit(0.0))
    if has(loans, "repayment_installments", "repayment_period", "repayment_period_unit"):
        monthly = F.upper("repayment_period_unit").startswith("MONTH")
        return F.coalesce(F.when(monthly, F.col("repayment_installments") * F.col("repayment_period")), gap)
    return gap


def risk_clients(loans: DataFrame, savings: DataFrame, day: dt.date, rates: dict[str, float] | None = None) -> DataFrame:
    """Customer by currency: coverage by savings and by term deposits, use of savings, net exposure, delay, signals."""
    r = {**RATES, **(rates or {})}
    lent_on_day = rows_as_of(loans, day, ["created_at", "updated_at"])
    saved_on_day = rows_as_of(savings, day, ["date_approved", "created_at"])
    late = F.datediff(F.lit(day), F.to_date("due_date"))
    balance = loan_balance(lent_on_day)
    monthly = r["credit_lender"] + r["credit_partner"]
    estimated = F.col("loan_amount") * F.lit(monthly / 100) * loan_months(lent_on_day)
    earned = F.coalesce(F.when(F.col("interest_earned") > 0, F.col("interest_earned")), estimated) if has(loans, "interest_earned") else estimated
    priced = lent_on_day.withColumns({"__b": balance, "__i": F.when(balance > 0, earned)})
    lent = priced.groupBy(*KEY).agg(exact_sum("__b").alias("e"), F.max(F.when(F.col("__b") > 0, F.greatest(late, F.lit(0)))).alias("retard_max"),
                                    total("__i").alias("interet_credit"))
    fixed = F.col("account_type") == W.FIXED
    left = F.datediff(F.to_date("maturity_date"), F.lit(day))
    term = F.datediff(F.to_date("maturity_date"), F.to_date("date_approved"))
    positive = fixed & (F.col("balance") > 0)
    cost = F.col("balance") * F.lit(r["dat_client"] / 100) * term / F.lit(365)
    saved = saved_on_day.groupBy(*KEY).agg(
        exact_sum("balance", F.col("account_type") == W.OPEN).alias("o"), exact_sum("balance", fixed).alias("d"),
        F.max(F.when(positive, term)).alias("duree_dat_max_jours"), F.min(F.when(positive & (left >= 0), left)).alias("prochaine_echeance_jours"),
        total(F.when(positive, cost)).alias("cout_dat"))
    joined = lent.join(saved, list(KEY), "full_outer")
    e, o, d = (F.coalesce(F.col(c), zero()) for c in ("e", "o", "d"))
    base = joined.select(
        *KEY, e.cast("double").alias("encours_credit"), o.cast("double").alias("compte_ouvert"), d.cast("double").alias("encours_dat"),
        (o + d).cast("double").alias("epargne_totale"), F.coalesce("retard_max", F.lit(0)).alias("retard_max_jours"), "duree_dat_max_jours",
        "prochaine_echeance_jours", F.coalesce("interet_credit", F.lit(0.0)).alias("interet_credit"), F.coalesce("cout_dat", F.lit(0.0)).alias("cout_dat"))
    c, s, t = F.col("encours_credit"), F.col("epargne_totale"), F.col("encours_dat")
    lender = r["credit_lender"] / monthly
    out = base.withColumns({
        "couverture_epargne_pct": ratio(s, c) * 100, "couverture_dat_pct": ratio(t, c) * 100,
        "taux_credit_epargne_pct": ratio(c, s) * 100, "taux_credit_dat_pct": ratio(c, t) * 100,
        "exposition_nette": F.greatest(c - s, F.lit(0.0)), "exposition_nette_dat": F.greatest(c - t, F.lit(0.0)),
        "marge_estimee": F.col("interet_credit") * F.lit(lender) - F.col("cout_dat"),
    })
    credit = c > 0
    return out.withColumns({
        "segment_couverture": coverage_segment(F.col("couverture_epargne_pct"), credit, "aucune_epargne"),
        "segment_couverture_dat": coverage_segment(F.col("couverture_dat_pct"), credit, "aucun_dat"),
        "segment_observe": F.when(credit & (F.col("retard_max_jours") >= 30), "credit_retard_30j_plus").when(credit & (s == 0), "credit_sans_epargne_observee")
        .when(credit & (t > 0), "credit_avec_dat").when(credit, "credit_avec_epargne").when(t > 0, "dat_sans_credit").when(s > 0, "epargne_sans_credit")
        .otherwise("sans_position"),
        "signaux_positifs": reasons([(t > 0, "EP01_dat_positif"), (F.col("compte_ouvert") > 0, "EP02_compte_ouvert_positif"),
                                     (credit, "CR01_credit_actif"), (credit & (F.col("couverture_epargne_pct") >= 100), "EP03_couverture_confortable")]),
        "signaux_attention": reasons(risk_rules()),
    })


def risk_rules() -> list[Rule]:
    c, s, t = F.col("encours_credit"), F.col("epargne_totale"), F.col("encours_dat")
    credit = c > 0
    return [
        (credit & (F.col("retard_max_jours") >= 30), "CR03_retard_30j"), (credit & (s == 0), "CR05_credit_sans_epargne"),
        (credit & (c > s), "CR06_credit_superieur_epargne"), (credit & (c > t), "CR09_credit_superieur_dat"),
        ((t > 0) & ~credit, "EP05_dat_sans_credit"), (F.col("prochaine_echeance_jours") <= 30, "EP06_dat_echeance_proche"),
        (F.col("marge_estimee") < 0, "RE01_marge_negative")]


# Alert name by condition on a client row.
def alert_rules() -> list[Rule]:
    c, s, t = F.col("encours_credit"), F.col("epargne_totale"), F.col("encours_dat")
    credit = c > 0
    return [
        (credit & (s == 0), "credit_sans_epargne"), (credit & (c > s), "credit_superieur_epargne"), (credit & (c > t), "credit_superieur_dat"),
        (credit & (F.coalesce("couverture_epargne_pct", F.lit(0.0)) < 100), "couverture_insuffisante"),
        (credit & (F.coalesce("couverture_dat_pct", F.lit(0.0)) < 100), "couverture_dat_insuffisante"),
        (credit & (F.col("retard_max_jours") > 0), "retard_credit"), (F.col("prochaine_echeance_jours") <= 30, "dat_echeance_proche"),
        ((t > 0) & ~credit, "dat_sans_credit"), (F.col("marge_estimee") < 0, "marge_negative")]


def risk_alerts(clients: DataFrame) -> DataFrame:
    """One row per client and alert."""
    named = reasons(alert_rules())
    return clients.withColumn("alerte", F.explode(F.split(named, "; "))).select(*KEY, "alerte", "encours_credit", "epargne_totale", "encours_dat")


def alert_summary(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("currency_code", "alerte").agg(F.count("*").alias("dossiers"), total("encours_credit").alias("montant"))


def risk_summary(clients: DataFrame) -> DataFrame:
    """Coverage and use of savings per currency, net exposure summed over clients."""
    e, s, d = exact_sum("encours_credit"), exact_sum("epargne_totale"), exact_sum("encours_dat")
    grouped = clients.groupBy("currency_code").agg(
        e.cast("double").alias("encours_credit"), s.cast("double").alias("epargne_totale"), d.cast("double").alias("encours_dat"),
        total("exposition_nette").alias("exposition_nette"), total("interet_credit").alias("interet_credit"), total("cout_dat").alias("cout_dat"),
        total("marge_estimee").alias("marge_estimee"), exact_sum("encours_credit", F.col("retard_max_jours") >= 30).cast("double").alias("encours_retard_30j"),
        count_if(F.col("encours_credit") > 0).alias("clients_credit"))
    c = F.col("encours_credit")
    return grouped.withColumns({
        "couverture_epargne_pct": ratio(F.col("epargne_totale"), c) * 100, "couverture_dat_pct": ratio(F.col("encours_dat"), c) * 100,
        "taux_credit_epargne_pct": ratio(c, F.col("epargne_totale")) * 100, "taux_credit_dat_pct": ratio(c, F.col("encours_dat")) * 100})


def liquidity_gap(loans: DataFrame, savings: DataFrame, day: dt.date, horizons: Sequence[int] = (7, 30, 90)) -> DataFrame:
    """Loan balances due against term deposits due inside each horizon, per currency."""
    due = F.datediff(F.to_date("due_date"), F.lit(day))
    left = F.datediff(F.to_date("maturity_date"), F.lit(day))
    balance = loan_balance(loans)
    ins = loans.groupBy("currency_code").agg(*[exact_sum(balance, due.between(0, h)).alias(f"in{h}") for h in horizons])
    outs = term_deposits(savings).where("balance > 0").groupBy("currency_code").agg(
        *[exact_sum("balance", left.between(0, h)).alias(f"out{h}") for h in horizons])
    joined = ins.join(outs, "currency_code", "full_outer")
    lines = F.array(*[F.struct(F.lit(h).alias("horizon_jours"), F.coalesce(F.col(f"in{h}"), zero()).alias("i"), F.coalesce(F.col(f"out{h}"), zero()).alias("o"))
                      for h in horizons])
    rows = joined.select("currency_code", F.explode(lines).alias("l"))
    gap = F.col("l.i") - F.col("l.o")
    return rows.select("currency_code", "l.horizon_jours", F.col("l.i").cast("double").alias("entrees_credit"), F.col("l.o").cast("double").alias("sorties_dat"),
                       gap.cast("double").alias("gap_liquidite"), (gap < 0).alias("gap_negatif"))


# --- cockpits -------------------------------------------------------------------------------------------------

def savings_portfolio(savings: DataFrame) -> DataFrame:
    """Accounts, customers, zero balances and balance per currency and family."""
    family = F.when(F.col("account_type") == W.FIXED, "DAT").otherwise("Compte ouvert")
    zero_balance = F.coalesce("balance", F.lit(0.0)) == 0
    return savings.groupBy("currency_code", family.alias("famille_epargne")).agg(
        F.count_distinct("savings_id").alias("nombre_comptes"), F.count_distinct("customer_id").alias("nombre_clients"),
        count_if(zero_balance).alias("comptes_solde_nul"), total("balance").alias("encours_actuel"))


def savings_flows(journal: DataFrame) -> DataFrame:
    """Observed savings flows per currency and their net."""
    parts = {"depots_compte_ouvert": "depot_epargne", "depots_dat": "depot_dat", "retours_dat": "retour_dat", "retraits": "retrait_epargne",
             "remboursements_compte_ouvert": "remboursement_compte_ouvert"}
    sums = journal.groupBy("currency_code").agg(*[exact_sum(c).alias(n) for n, c in parts.items()])
    net = (F.col("depots_compte_ouvert") + F.col("depots_dat") + F.col("retours_dat") - F.col("retraits") - F.col("remboursements_compte_ouvert"))
    return sums.select("currency_code", *[F.col(n).cast("double") for n in parts], net.cast("double").alias("flux_net_epargne"))


def savings_activity(savings: DataFrame, journal: DataFrame, day: dt.date, watch: int = 30, inactive: int = 90) -> DataFrame:
    """Observed activity of each account from the last movement of its customer and currency."""
    last = W.last_activity(journal)
    first = journal.agg(F.min("created_at").alias("a")).scalar()
    idle = F.datediff(F.lit(day), F.to_date("derniere_operation"))
    short = F.datediff(F.lit(day), F.to_date(first)) < inactive
    status = (F.when(idle <= watch, "actif").when(idle <= inactive, "a_surveille").when(short, "historique_insuffisant").otherwise("inactif_observe"))
    family = F.when(F.col("account_type") == W.FIXED, "DAT").otherwise("Compte ouvert")
    joined = savings.join(last, list(KEY), "left")
    return joined.select("savings_id", *KEY, "balance", family.alias("famille_epargne"), "derniere_operation", status.alias("statut_activite"))


def activity_summary(activity: DataFrame) -> DataFrame:
    return activity.groupBy("currency_code", "famille_epargne", "statut_activite").agg(
        F.count_distinct("savings_id").alias("nombre_comptes"), F.count_distinct("customer_id").alias("nombre_clients"), total("balance").alias("encours_actuel"))


def client_activity(journal: DataFrame) -> DataFrame:
    """Savings movements per customer and currency with their net, for the largest net flows."""
    net = (exact_sum("depot_epargne") + exact_sum("depot_dat") + exact_sum("retour_dat") - exact_sum("retrait_epargne")
           - exact_sum("remboursement_compte_ouvert"))
    return journal.groupBy(*KEY).agg(F.count("*").alias("nombre_operations"), net.alias("flux_net_epargne"))


def top_flows(activity: DataFrame, n: int = 15) -> DataFrame:
    """First n customers per currency; the rank filter is applied before the shuffle as well."""
    from pyspark.sql import Window

    order = Window.partitionBy("currency_code").orderBy(F.desc("flux_net_epargne"), "customer_id")
    top = activity.withColumn("rang", F.row_number().over(order)).where(F.col("rang") <= n)
    return top.withColumn("flux_net_epargne", F.col("flux_net_epargne").cast("double"))


def priorities(loans: DataFrame, savings: DataFrame, day: dt.date) -> DataFrame:
    """Loans at least 30 days late and term deposits due within 30 days or matured, per currency."""
    late = credit_detail(loans, day).where("jours_retard >= 30").groupBy("currency_code").agg(
        F.lit("Credits en retard 30 jours et plus").alias("priorite"), F.count("*").alias("dossiers"), total("encours").alias("montant"))
    due = deposit_maturity(savings, day).where(F.col("tranche_echeance").isin("Echu", "Aujourd'hui", "0 a 7 jours", "8 a 30 jours"))
    soon = due.groupBy("currency_code").agg(
        F.lit("DAT echus ou a echeance sous 30 jours").alias("priorite"), F.count("*").alias("dossiers"), total("balance").alias("montant"))
    return late.unionByName(soon)


def report_of_clients(customers: DataFrame, journal: DataFrame, savings: DataFrame, loans: DataFrame, start: dt.date, end: dt.date,
                      occasional: int = 2, idle_days: int = 90) -> DataFrame:
    """One row per canonical client: what it holds, whether it is new and active, and its segments.

    The identity is the customer id; a phone stands in for it, and is replaced by an id when exactly one id uses it.
    """
    def ids(df: DataFrame, phone: str) -> DataFrame:
        return df.select(none_if_blank(F.col("customer_id")).alias("customer_id"), F.col(phone).alias("phone"))

    links = ids(journal, "telephone").unionByName(ids(savings, "msisdn")).unionByName(ids(loans, "msisdn1"))
    links = links.where("customer_id IS NOT NULL AND phone IS NOT NULL").distinct()
    unique = links.groupBy("phone").agg(F.count_distinct("customer_id").alias("n"), F.min("customer_id").alias("linked"))
    unique = unique.select("phone", F.when(F.col("n") == 1, F.col("linked")).alias("linked"))
    known_id = none_if_blank(F.col("customer_id")) if has(customers, "customer_id") else F.lit(None).cast("string")
    base = customers.select(known_id.alias("own"), F.col("msisdn1").alias("phone"), stamp(customers, "created_at").alias("cree_le"))
    people = base.join(unique, "phone", "left").withColumn("client_key", F.coalesce("own", "linked", "phone"))
    people = people.groupBy("client_key").agg(F.min("cree_le").alias("cree_le"))

    def keyed(df: DataFrame, phone: str) -> DataFrame:
        own = df.join(unique, df[phone] == unique["phone"], "left")
        return own.withColumn("client_key", F.coalesce(none_if_blank(F.col("customer_id")), F.col("linked"), F.col(phone)))

    moment = F.col("created_at")
    inside = W.in_period(journal, start, end)
    moved = keyed(journal, "telephone").groupBy("client_key").agg(
        count_if(inside).alias("nombre_operations"), F.max(moment).alias("derniere_operation"))
    held = keyed(savings, "msisdn").groupBy("client_key").agg(
        count_if(F.col("account_type") == W.OPEN).alias("comptes_ouverts"),
        count_if((F.col("account_type") == W.FIXED) & (F.col("balance") > 0)).alias("dat_positifs"))
    owed = keyed(loans, "msisdn1").groupBy("client_key").agg(count_if(loan_balance(loans) > 0).alias("credits_actifs"))
    joined = people.withColumn("present_referentiel", F.lit(True))
    for part in (moved, held, owed):
        joined = joined.join(part, "client_key", "full_outer")

    def n(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    new = F.coalesce((F.col("cree_le") >= F.lit(start).cast("timestamp_ntz"))
                     & (F.col("cree_le") < F.lit(end + dt.timedelta(days=1)).cast("timestamp_ntz")), F.lit(False))
    active = n("nombre_operations") > 0
    savings_, dat, credit = n("comptes_ouverts") > 0, n("dat_positifs") > 0, n("credits_actifs") > 0
    products = savings_.cast("int") + dat.cast("int") + credit.cast("int")
    product = F.nullif(F.concat_ws("_", F.when(savings_, "epargne"), F.when(dat, "dat"), F.when(credit, "credit")), F.lit(""))
    idle = F.datediff(F.lit(end), F.to_date("derniere_operation"))
    segment = (F.when(new & active, "nouveau_actif").when(new, "nouveau_non_active").when(active & (products >= 2), "multi_produits")
               .when(active & (n("nombre_operations") <= occasional), "occasionnel").when(active, "actif")
               .when(idle > idle_days, "inactif_observe").otherwise("sans_mouvement"))
    return joined.select(
        "client_key", F.coalesce("present_referentiel", F.lit(False)).alias("present_referentiel"), new.alias("nouveau_client"), active.alias("actif_periode"),
        n("nombre_operations").alias("nombre_operations"), n("comptes_ouverts").alias("comptes_ouverts"), n("dat_positifs").alias("dat_positifs"),
        n("credits_actifs").alias("credits_actifs"), F.coalesce(product, F.lit("sans_produit_observe")).alias("segment_produit"), segment.alias("segment_client"))


def client_indicators(clients: DataFrame) -> DataFrame:
    ref, new, active = F.col("present_referentiel"), F.col("nouveau_client"), F.col("actif_periode")
    counts = clients.agg(
        count_if(ref).alias("clients_referentiel"), F.count("*").alias("clients_connus"), count_if(active).alias("clients_actifs"),
        count_if(new).alias("nouveaux_clients"), count_if(new & active).alias("nouveaux_clients_actifs"), count_if(~active).alias("clients_sans_mouvement"))
    whole = F.when(F.col("clients_referentiel") > 0, F.col("clients_referentiel")).otherwise(F.col("clients_connus"))
    return counts.withColumns({"taux_clients_actifs": ratio(F.col("clients_actifs"), whole),
                               "taux_activation": ratio(F.col("nouveaux_clients_actifs"), F.col("nouveaux_clients"))})


def family_balances(savings: DataFrame, loans: DataFrame) -> DataFrame:
    """Balance per customer, currency and family (open account, term deposit, credit); families are never added up."""
    family = F.when(F.col("account_type") == W.FIXED, "dat").otherwise("compte_ouvert")
    saved = savings.groupBy(*KEY, family.alias("famille_encours")).agg(total("balance").alias("encours"))
    lent = loans.groupBy(*KEY).agg(F.lit("credit").alias("famille_encours"), total(loan_balance(loans)).alias("encours"))
    return saved.unionByName(lent).where("encours > 0")
