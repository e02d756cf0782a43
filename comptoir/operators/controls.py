"""Catalogued controls over operations, ledger lines, accounts, loans, schedules and cash desks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comptoir.functions.money import MONEY, amount, count_if, exact_sum, ratio, total
from comptoir.functions.text import blank, none_if_blank
from comptoir.operators.quality import count_over
from comptoir.operators.rules import reasons
from comptoir.plans.ordered import accumulate, match_null_safe, partition_count



# --- operations -----------------------------------------------------------------------------------------------

def operation_exceptions(ops: DataFrame) -> DataFrame:
    """Not validated, entered late, validated before entry, or lacking user, branch or type."""
    rules = [
        (~F.col("annule") & (F.col("date_validation").isNull() | F.col("date_valide").isNull()), "Non validee"),
        (F.to_date("date_saisie") > F.to_date("date_operation"), "Saisie tardive"),
        ((F.col("date_valide") < F.col("date_saisie")) | (F.col("date_validation") < F.col("date_operation")), "Chronologie incoherente"),
        (blank(F.col("operateur")) | blank(F.col("agence")) | blank(F.col("type_operation")), "Rattachement manquant"),
    ]
    return ops.withColumn("motif", reasons(rules)).where("motif IS NOT NULL")


def repeated_numbers(ops: DataFrame, column: str) -> DataFrame:
    """Operations sharing a transaction or receipt number."""
    keyed = ops.withColumn(column, none_if_blank(F.col(column)))
    return count_over(keyed, [column], "occurrences").where(F.col("occurrences") > 1)


def near_duplicates(ops: DataFrame, keys: Sequence[str] = ("date_operation", "operateur", "type_operation", "client_id", "montant_operation")) -> DataFrame:
    """Groups of operations with the same date, user, type, client and amount."""
    groups = ops.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.min("operation_id").alias("premiere_operation"))
    return groups.where(F.col("occurrences") > 1)


def broken_cancellations(ops: DataFrame) -> DataFrame:
    """Cancelled operations without a reference, and references to operations that do not exist."""
    cancelled = ops.where(F.col("annule"))
    none = cancelled.where(F.col("id_operation_annulee").isNull()).select("operation_id", F.lit("Annulation sans reference").alias("motif"))
    keys = ops.select(F.col("operation_id").alias("id_operation_annulee"))
    lost = cancelled.where(F.col("id_operation_annulee").isNotNull()).join(keys, "id_operation_annulee", "left_anti")
    return none.unionByName(lost.select("operation_id", F.lit("Reference introuvable").alias("motif")))


def self_validated(ops: DataFrame) -> DataFrame:
    return ops.where((~blank(F.col("operateur"))) & (F.col("operateur") == F.col("validateur")))


def orphans(ops: DataFrame, lines: DataFrame) -> DataFrame:
    """Ledger operations without an operation, and operations without ledger lines."""
    sides = lines.select("operation_id", F.lit(True).alias("written")).unionByName(ops.select("operation_id", F.lit(False).alias("written")))
    written, known = F.bool_or("written"), F.bool_or(~F.col("written"))
    # Bare identifiers shrink so much in a shuffle that partitions merged by their bytes would hold millions of them.
    dealt = sides.repartition(partition_count(sides), "operation_id")
    seen = dealt.groupBy("operation_id").agg(written.alias("written"), known.alias("known"))
    # An empty identifier matches nothing, not even another one.
    alone = F.col("operation_id").isNull()
    motives = F.array_compact(F.array(
        F.when(F.col("written") & (~F.col("known") | alone), "Ecriture sans operation"),
        F.when(F.col("known") & (~F.col("written") | alone), "Operation sans ecriture")))
    return seen.select("operation_id", F.explode(motives).alias("motif"))


def unbalanced(summary: DataFrame) -> DataFrame:
    return summary.where(~F.col("equilibre_comptable_ok"))


def channel_totals(ops: DataFrame, reference: Column) -> DataFrame:
    """Both channels side by side per reference: number and amount, missing side or difference."""
    grouped = ops.groupBy(reference.alias("reference")).agg(*[m for name, source in (("bo", "BACK_OFFICE"), ("api", "API_MOBILE")) for m in (
        count_if(F.col("source_mouvement") == source).alias(f"n_{name}"), exact_sum("montant_operation", F.col("source_mouvement") == source).alias(f"m_{name}"))])
    status = (F.when(F.col("n_api") == 0, "Absent API").when(F.col("n_bo") == 0, "Absent back-office")
              .when(F.col("m_bo") == F.col("m_api"), "Conforme").otherwise("Ecart"))
    return grouped.select("reference", "n_bo", "n_api", F.col("m_bo").cast("double").alias("montant_bo"), F.col("m_api").cast("double").alias("montant_api"), status.alias("statut"))


def signed(value: str = "montant") -> Column:
    return F.when(F.col("sens") == "D", F.col(value)).when(F.col("sens") == "C", -F.col(value)).otherwise(0.0)


def asymmetric_cancellations(ops: DataFrame, lines: DataFrame) -> DataFrame:
    """Cancellations whose lines do not undo the original by account and currency.

    The lines of both operations are gathered under the cancellation and added up; anything but zero is wrong.
    """
    pairs = ops.where(F.col("annule") & F.col("id_operation_annulee").isNotNull()).select(F.col("operation_id").alias("annulation"), "id_operation_annulee")
    members = pairs.select("annulation", F.col("annulation").alias("operation_id")).unionByName(
        pairs.select("annulation", F.col("id_operation_annulee").alias("operation_id")))
    net = members.join(lines, "operation_id").groupBy("annulation", "compte_id", "id_devise").agg(exact_sum(signed()).alias("net"))
    wrong = net.where(F.col("net") != 0)
    return wrong.groupBy("annulation").agg(F.count("*").alias("comptes_en_ecart"), F.sum(F.abs("net")).cast("double").alias("ecart_total"))


def daily_ledger_balance(lines: DataFrame) -> DataFrame:
    """Debit, credit and difference per day, currency and journal."""
    d, c = exact_sum("montant", F.col("sens") == "D"), exact_sum("montant", F.col("sens") == "C")
    return lines.groupBy(F.to_date("date_operation").alias("jour"), "id_devise", "journal").agg(
        d.cast("double").alias("debit"), c.cast("double").alias("credit"), (d - c).cast("double").alias("ecart"))


def closed_account_movements(lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """Movements on accounts whose state is not active."""
    closed = accounts.where(F.col("etat") != "ACTIF").select("compte_id", "etat")
    moved = lines.join(closed, "compte_id")
    return moved.groupBy("compte_id", "etat").agg(F.count("*").alias("mouvements"), total("montant").alias("montant"), F.max("date_operation").alias("dernier"))


def frequent_depositors(ops: DataFrame, least: int = 3) -> DataFrame:
    rows = ops.where(F.col("type_operation").isin("DEPO", "MOB_DEPO"))
    weekly = rows.groupBy("client_id", F.to_date(F.date_trunc("week", F.col("date_operation"))).alias("semaine")).agg(
        F.count_distinct("operation_id").alias("depots"), total("montant_operation").alias("montant"))
    label = F.when(F.col("depots") >= 5, "5 fois ou plus").otherwise("3 a 4 fois")
    return weekly.where(F.col("depots") >= least).withColumn("classe", label)


# Deposit bands per currency (lower bound, label).
DEPOSIT_BANDS = {
    "USD": ((10, "10-24.99"), (25, "25-49.99"), (50, "50-99.99"), (100, "100 et plus")),
    "CDF": ((125_000, "125000-199999"), (200_000, "200000 et plus")),
}


def deposit_band(value: Column, currency: Column) -> Column:
    expr = F.when(F.lit(False), "")
    for code, bands in DEPOSIT_BANDS.items():
        for floor, label in reversed(bands):
            expr = expr.when((currency == code) & (value >= floor), label)
    return expr


def deposit_bands(ops: DataFrame) -> DataFrame:
    rows = ops.where(F.col("type_operation").isin("DEPO", "MOB_DEPO")).withColumn("tranche", deposit_band(F.col("montant_operation"), F.col("code_devise")))
    return rows.where("tranche IS NOT NULL").groupBy("code_devise", "tranche").agg(
        F.count("*").alias("depots"), F.count_distinct("client_id").alias("clients"), total("montant_operation").alias("montant"))


def month_end_balances(movements: DataFrame, groups: Sequence[str], date: str, value: Column) -> DataFrame:
    """Balance of each group at every month end from its first to its last month.

    Movements are added up per month first; the running sum then runs over months, not over movements.
    """
    monthly = movements.groupBy(*groups, F.last_day(date).alias("fin_mois")).agg(exact_sum(value).alias("flux"))
    spans = monthly.groupBy(*groups).agg(F.min("fin_mois").alias("a"), F.max("fin_mois").alias("b"))
    months = spans.select(*groups, F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    grid = months.select(*groups, F.last_day("m").alias("fin_mois")).join(monthly, [*groups, "fin_mois"], "left")
    run = Window.partitionBy(*groups).orderBy("fin_mois").rowsBetween(Window.unboundedPreceding, 0)
    balance = F.sum(F.coalesce("flux", F.lit(0).cast(MONEY))).over(run)
    return grid.select(*groups, "fin_mois", balance.cast("double").alias("solde"))


def dormant_accounts(accounts: DataFrame, movements: DataFrame, day: dt.date, days: int = 180) -> DataFrame:
    """Accounts with a balance and no movement for so many days at the date."""
    last = movements.where(F.col("date_operation") < F.lit(day + dt.timedelta(days=1))).groupBy("compte_id").agg(F.max("date_operation").alias("dernier_mouvement"))
    idle = F.datediff(F.lit(day), F.to_date("dernier_mouvement"))
    joined = accounts.join(last, "compte_id", "left").withColumn("jours_inactivite", idle)
    return joined.where((F.col("solde") > 0) & (F.col("jours_inactivite").isNull() | (F.col("jours_inactivite") >= days)))


def wrong_side(ops: DataFrame, lines: DataFrame) -> DataFrame:
    """Deposits that debit, and withdrawals that credit, the client account."""
    wanted = F.when(F.col("type_operation").isin("DEPO", "MOB_DEPO"), "C").otherwise("D")
    joined = lines.where(F.col("sens").isNotNull()).join(ops.select("operation_id", "type_operation", wanted.alias("attendu")), "operation_id")
    wrong = joined.where(F.col("sens") != F.col("attendu"))
    return wrong.groupBy("type_operation", "sens").agg(F.count("*").alias("lignes"), total("montant").alias("montant"))


def negative_after_debit(lines: DataFrame, openings: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Movements after which the account is below zero: opening plus all movements so far, in time order."""
    run = accumulate(lines, ["compte_id"], list(order), amounts={"cumul": -signed()})
    joined = match_null_safe(run, openings.select("compte_id", "ouverture"), ["compte_id"], "left")
    balance = F.coalesce(amount("ouverture"), F.lit(0).cast(MONEY)) + F.col("cumul")
    return joined.withColumn("solde_apres", balance.cast("double")).where((balance < 0) & (F.col("sens") == "D"))


def clients_with_accounts(clients: DataFrame, accounts: DataFrame) -> DataFrame:
    """Exactly one row per client with the number of its accounts."""
    one = clients.groupBy("client_id").agg(F.min("nom_client").alias("nom_client"), F.min("telephone").alias("telephone"))
    counts = accounts.groupBy("client_id").agg(F.count_distinct("compte_id").alias("nombre_comptes"))
    return one.join(counts, "client_id", "left").withColumn("nombre_comptes", F.coalesce("nombre_comptes", F.lit(0)))


# --- loans ----------------------------------------------------------------------------------------------------

def instalment_status(schedule: DataFrame, day: dt.date) -> DataFrame:
    """Loans with at least one instalment due and not fully paid, and loans that paid everything due.

    Each instalment is brought to one row before it is judged.
    """
    due = schedule.where(F.col("date_echeance") <= F.lit(day))
    paid = F.when(F.col("date_paiement") <= F.lit(day), F.col("rembourse")).otherwise(0.0)
    each = due.groupBy("loan_id", "numero").agg(exact_sum("attendu").alias("a"), exact_sum(paid).alias("p"), F.min("date_echeance").alias("d"))
    open_ = F.col("a") > F.col("p")
    loans = each.groupBy("loan_id").agg(
        F.count("*").alias("echeances_dues"), count_if(open_).alias("echeances_impayees"), F.sum(F.when(open_, F.col("a") - F.col("p"))).cast("double").alias("impaye"),
        F.min(F.when(open_, F.col("d"))).alias("plus_ancienne"))
    return loans.withColumn("statut", F.when(F.col("echeances_impayees") > 0, "Impaye").otherwise("Solde sur la periode"))


def par_detail(loans: DataFrame, day: dt.date) -> DataFrame:
    """Active loans with delay, riskiest first kept whole."""
    late = F.coalesce("retard_jours", F.lit(0))
    return loans.where((F.col("solde_final") > 0) & (late > 0)).select("dossier_id", "client_id", "agence", "type_produit", "devise", "solde_final", late.alias("retard_jours"), F.lit(day).alias("date_situation"))


def monthly_disbursements(loans: DataFrame) -> DataFrame:
    return loans.groupBy(F.date_format("date_demande", "yyyy-MM").alias("mois"), "agence", "type_produit", "devise").agg(
        F.count("*").alias("prets"), total("montant_accorde").alias("montant"))


def future_instalments(schedule: DataFrame, day: dt.date, months: int = 12) -> DataFrame:
    """Amounts expected in the months after the day."""
    end = F.add_months(F.lit(day), months)
    rows = schedule.where((F.col("date_echeance") > F.lit(day)) & (F.to_date("date_echeance") <= end))
    return rows.groupBy(F.date_format("date_echeance", "yyyy-MM").alias("mois")).agg(
        F.count("*").alias("echeances"), F.count_distinct("loan_id").alias("prets"), total("attendu").alias("montant_attendu"))


def renewals(loans: DataFrame, by: Sequence[str] = ("agence", "devise")) -> DataFrame:
    """Loans closed per month and how many were followed by a next loan, ever and within 90 days.

    The next loan is found by its number inside the client's sequence, so a client of any size is spread out.
    """
    ordered = accumulate(loans.select("client_id", *by, "dossier_id", "debut", "fin"), ["client_id"], [F.col("debut"), F.col("dossier_id")], "rang")
    following = ordered.select("client_id", (F.col("rang") - 1).alias("rang"), F.col("debut").alias("suivant"))
    joined = match_null_safe(ordered, following, ["client_id", "rang"], "left")
    gap = F.datediff(F.to_date("suivant"), F.to_date("fin"))
    kept = F.coalesce(gap >= 0, F.lit(False))
    grouped = joined.groupBy(*by, F.date_format("fin", "yyyy-MM").alias("mois")).agg(
        F.count("*").alias("arrives_echeance"), count_if(kept).alias("renouveles"), count_if(kept & (gap <= 90)).alias("renouveles_90j"),
        ratio(F.sum(F.when(kept, gap)), count_if(kept)).alias("delai_moyen_jours"))
    n = F.col("arrives_echeance")
    return grouped.withColumns({"retention_pct": ratio(F.col("renouveles"), n) * 100, "retention_90j_pct": ratio(F.col("renouveles_90j"), n) * 100})


def vintages(loans: DataFrame, day: dt.date) -> DataFrame:
    """Cohorts by month of disbursement: age, remaining balance, PAR 30 and 90 and their share of the initial amount."""
    late = F.coalesce("retard_jours", F.lit(0))
    initial = exact_sum("montant_accorde")
    month = F.trunc("date_demande", "month")
    age = F.months_between(F.trunc(F.lit(day), "month"), F.col("cohorte")).cast("int")
    par30 = exact_sum("solde_final", late >= 30)
    grouped = loans.groupBy(month.alias("cohorte"), "type_produit", "devise").agg(
        F.count("*").alias("prets"), initial.cast("double").alias("montant_initial"), total("solde_final").alias("encours"), par30.cast("double").alias("par_30"),
        total("solde_final", late >= 90).alias("par_90"), (ratio(par30, initial) * 100).alias("par_30_sur_initial_pct"))
    return grouped.withColumn("age_mois", age)


def top_decile(loans: DataFrame, groups: Sequence[str] = ("agence", "type_produit", "devise")) -> DataFrame:
    """Share held by the largest tenth of the active loans of each group."""
    active = loans.where(F.col("solde_final") > 0)
    ranked = accumulate(active.select(*groups, "dossier_id", F.col("solde_final").alias("v")), list(groups), [F.col("v").desc(), F.col("dossier_id").asc()], "rang")
    sizes = active.groupBy(*groups).agg(F.count("*").alias("n"))
    joined = match_null_safe(ranked, sizes, list(groups), "inner")
    first = F.col("rang") <= F.ceil(F.col("n") / 10)
    top, whole = exact_sum("v", first), exact_sum("v")
    return joined.groupBy(*groups).agg(
        F.count("*").alias("prets"), count_if(first).alias("prets_top_10"), whole.cast("double").alias("encours"), top.cast("double").alias("encours_top_10"),
        (ratio(top, whole) * 100).alias("part_top_10_pct"))


def loan_coverage(loans: DataFrame, savings: DataFrame, guarantees: DataFrame) -> DataFrame:
    """Balance against savings of the client and guarantees of the loan; each side is added up first."""
    owed = loans.groupBy("client_id", "devise").agg(exact_sum("solde_final").alias("e"))
    saved = savings.groupBy(F.col("customer_id").alias("client_id"), F.col("currency_code").alias("devise")).agg(exact_sum("balance").alias("s"))
    held = guarantees.groupBy("client_id", "devise").agg(exact_sum("valeur_garantie").alias("g"))
    joined = owed.where(F.col("e") > 0).join(saved, ["client_id", "devise"], "left").join(held, ["client_id", "devise"], "left")
    s, g = (F.coalesce(c, F.lit(0).cast(MONEY)) for c in ("s", "g"))
    net = F.greatest(F.col("e") - s - g, F.lit(0).cast(MONEY))
    return joined.select("client_id", "devise", F.col("e").cast("double").alias("encours"), s.cast("double").alias("epargne"), g.cast("double").alias("garanties"),
                         net.cast("double").alias("exposition_nette"), F.when(net == 0, "Couvert").when(s + g > 0, "Partiel").otherwise("Non couvert").alias("statut"))


def month_ends(day: dt.date, count: int) -> list[dt.date]:
    """The last ``count`` month ends up to the day, newest first."""
    first = day.replace(day=1)
    ends = []
    if (day + dt.timedelta(days=1)).day == 1:
        ends.append(day)
    while len(ends) < count:
        last = first - dt.timedelta(days=1)
        ends.append(last)
        first = last.replace(day=1)
    return ends[:count]


def provisions_at(loans: DataFrame, day: dt.date, count: int = 3, rates: Sequence[tuple[int, float]] = ((180, 1.0), (90, 0.5), (30, 0.25))) -> DataFrame:
    """Provision at the last month ends: delay is counted back from the due date, one row per month end and currency."""
    ends = month_ends(day, count)
    rows = loans.where((F.col("solde_final") > 0) & F.col("due_date").isNotNull()).select(
        "devise", "solde_final", "due_date", "date_demande", F.explode(F.array(*[F.lit(e) for e in ends])).alias("fin_mois"))
    late = F.datediff("fin_mois", "due_date")
    share = F.when(late >= rates[0][0], rates[0][1]).when(late >= rates[1][0], rates[1][1]).when(late >= rates[2][0], rates[2][1]).otherwise(0.0)
    born = F.to_date("date_demande") <= F.col("fin_mois")
    return rows.where(born).groupBy("fin_mois", "devise").agg(
        F.count("*").alias("prets"), total("solde_final").alias("encours"), total("solde_final", late >= 30).alias("par_30"), total(F.col("solde_final") * share).alias("provision"))


def remaining_instalments(schedule: DataFrame, day: dt.date) -> DataFrame:
    per = schedule.groupBy("loan_id").agg(F.count("*").alias("echeances"), count_if(F.col("date_echeance") > F.lit(day)).alias("restantes"))
    return per.groupBy("restantes").agg(F.count("*").alias("prets"), F.sum("echeances").alias("echeances"))


def late_repayments(schedule: DataFrame) -> DataFrame:
    """Payments received after their due date: number, days and amount per loan."""
    days = F.datediff(F.to_date("date_paiement"), F.to_date("date_echeance"))
    rows = schedule.where((days > 0) & (F.col("rembourse") > 0))
    return rows.groupBy("loan_id").agg(F.count("*").alias("paiements_tardifs"), F.max(days).alias("retard_max"), total("rembourse").alias("montant"))


# --- cash desks -----------------------------------------------------------------------------------------------

def cash_differences(closings: DataFrame, counts: DataFrame) -> DataFrame:
    """Counted notes and coins against the declared closing balance of each desk and day."""
    counted = counts.groupBy("caisse", "jour").agg(exact_sum(F.col("piece") * F.col("nombre")).alias("c"))
    joined = closings.join(counted, ["caisse", "jour"], "left")
    gap = amount("solde") - F.coalesce(F.col("c"), F.lit(0).cast(MONEY))
    return joined.select("caisse", "jour", "solde", F.col("c").cast("double").alias("billetage"), gap.cast("double").alias("ecart"), (gap == 0).alias("conforme"))


def missing_closings(closings: DataFrame, desks: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Desk days of the period without a closing; the calendar is unfolded from each desk."""
    days = desks.select("caisse", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("jour"))
    return days.join(closings.select("caisse", "jour").distinct(), ["caisse", "jour"], "left_anti")


def review_movements(lines: DataFrame, threshold: float) -> DataFrame:
    """Movements without an amount, or at the review threshold, counted by reason."""
    value = F.coalesce("montant", F.lit(0.0))
    reason = F.when(value <= 0, "Montant nul ou negatif").when(F.col("sens").isNull(), "Sens absent").when(value >= threshold, "Superieur au seuil")
    return lines.withColumn("motif", reason).where("motif IS NOT NULL").groupBy("id_devise", "motif").agg(F.count("*").alias("mouvements"), total("montant").alias("montant"))


def large_movements(lines: DataFrame, threshold: float) -> DataFrame:
    rows = lines.where(F.col("montant") >= threshold)
    return rows.groupBy(F.date_format("date_operation", "yyyy-MM").alias("mois"), "id_devise").agg(
        F.count("*").alias("mouvements"), F.count_distinct("operation_id").alias("operations"), total("montant").alias("montant"))
