"""Receipts of the payment channel: preparation, classification, match with the ledger, time and retention analyses.

Receipts identify and prove operations; they never supply an amount to the ledger analyses.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.functions.money import MONEY, amount, count_if, exact_sum, ratio, total
from comptoir.functions.text import contains_any, let, none_if_blank, normalize_label, squeeze
from comptoir.functions.values import parse_dates, phone_key, to_number
from comptoir.operators import wallet as W
from comptoir.operators.common import has
from comptoir.operators.rules import Rule, reasons
from comptoir.plans.nearest import nearest_within
from comptoir.plans.ordered import match_null_safe

COMPLETED = "Completed"
MATCH_MINUTES, GAP_MINUTES = 120, 60

# Classes of an operation.
TO_DEPOSIT, TO_TERM, TO_LOAN = "Depot normal", "DAT", "Remboursement prets"
PAYOUT, LOAN_REQUEST, INTERNAL = "Paiement client B2C", "Demande de credit", "Operation interne"
OTHER_IN, OTHER_OUT, TO_CHECK = "Autre entree", "Autre sortie", "Flux a verifier"
ENTRY_CLASSES = (TO_TERM, TO_DEPOSIT, TO_LOAN, OTHER_IN)
OUTPUT_CLASSES = (PAYOUT, LOAN_REQUEST, INTERNAL, OTHER_OUT)

EXACT, WITH_GAP, UNMATCHED = "Rapproche exact", "Rapproche avec ecart", "Non rapproche"
NOT_APPLICABLE = "Non applicable - operation interne"


def normalized_status(col: Column) -> Column:
    """Seven classes; a blank status is its own class."""
    def classify(text: Column) -> Column:
        return (
            F.when(F.coalesce(text, F.lit("")) == "", "Non renseigne")
            .when(contains_any(text, ["complet", "success", "termine"]), COMPLETED)
            .when(contains_any(text, ["declin", "fail", "reject", "echec"]), "Declined")
            .when(contains_any(text, ["cancel", "annul", "revers"]), "Cancelled")
            .when(contains_any(text, ["expir"]), "Expired")
            .when(contains_any(text, ["pending", "attente", "initiat"]), "Pending")
            .otherwise("Autre")
        )

    return let(normalize_label(col), classify)


def opposite_party(col: Column) -> tuple[Column, Column]:
    """Phone key and name out of ``<phone> - <name>``."""
    phone = phone_key(F.regexp_extract(col, "^\\s*([+0-9 ]+)", 1))
    name = none_if_blank(F.regexp_extract(col, "^[^-]*-\\s*(.+)$", 1))
    return phone, name


def receipt_class(label: Column, direction: Column) -> Column:
    """Class from the operation label and the direction of the flow."""
    entry, output = direction == "Entree", direction == "Sortie"

    def classify(text: Column) -> Column:
        def says(*words: str) -> Column:
            return contains_any(text, words)

        return (
            F.when(says("supertransaction"), INTERNAL)
            .when(entry & says("repayment"), TO_LOAN)
            .when(entry & says("c2b"), TO_DEPOSIT)
            .when(output & says("loanrequest", "loanpayement", "loanpayment"), LOAN_REQUEST)
            .when(output & says("b2c"), PAYOUT)
            .when(entry, OTHER_IN).when(output, OTHER_OUT).otherwise(TO_CHECK)
        )

    return let(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9]", ""), classify)


def prepare_receipts(raw: DataFrame, source: str | None = None) -> DataFrame:
    """Typed receipts: amount and direction, phone and name, status class, operation class."""
    df = raw.withColumnRenamed("Receipt No.", "Receipt No")

    def text(*names: str) -> Column:
        return F.coalesce(*[none_if_blank(F.col(f"`{n}`")) for n in names if n in df.columns], F.lit(None).cast("string"))

    def number(name: str) -> Column:
        return to_number(F.col(f"`{name}`")) if name in df.columns else F.lit(None).cast("double")

    dates = {n: c for n, c in (("completion_time", "Completion Time"), ("initiation_time", "Initiation Time")) if c in df.columns}
    dated = parse_dates(df, dates, "fr") if dates else df
    paid, withdrawn, signed = number("Paid In"), number("Withdrawn"), number("Transaction Amount")
    has_in, has_out = F.coalesce(paid, F.lit(0.0)) != 0, F.coalesce(withdrawn, F.lit(0.0)) != 0
    value = F.when(has_in, F.abs(paid)).when(has_out, -F.abs(withdrawn)).otherwise(signed)
    origin = F.when(has_in, "Paid In").when(has_out, "Withdrawn").when(signed.isNotNull(), "Transaction Amount")
    direction = F.when(value > 0, "Entree").when(value < 0, "Sortie").otherwise("A verifier")
    phone, name = opposite_party(text("Opposite Party"))
    label = text("Reason Type", "Operation", "Details")
    completed = F.col("completion_time") if "completion_time" in dates else F.lit(None).cast("timestamp_ntz")
    started = F.col("initiation_time") if "initiation_time" in dates else F.lit(None).cast("timestamp_ntz")
    out = dated.select(
        none_if_blank(F.col("Receipt No")).alias("receipt_no"), phone.alias("phone"), name.alias("nom_client"),
        F.upper(text("Currency", "currency_code")).alias("currency_code"), value.alias("montant_signe"), F.abs(value).alias("montant"),
        origin.alias("source_montant"), direction.alias("sens_flux"),
        F.when(value > 0, value).otherwise(0.0).alias("montant_entree"), F.when(value < 0, -value).otherwise(0.0).alias("montant_sortie"),
        number("Balance").alias("solde_releve"), text("Transaction Status").alias("statut"),
        normalized_status(text("Transaction Status")).alias("statut_normalise"), squeeze(label).alias("reason_type"),
        receipt_class(label, direction).alias("classe"), started.alias("initiation_time"), completed.alias("completion_time"),
        *([F.col(source).alias("fichier_source")] if source and source in df.columns else []))
    return out


def classified(receipts: DataFrame) -> DataFrame:
    """Receipts given with canonical columns, completed with status class and operation class where absent."""
    out = receipts
    if not has(out, "statut_normalise"):
        out = out.withColumn("statut_normalise", normalized_status(F.col("statut")))
    if not has(out, "classe"):
        out = out.withColumn("classe", receipt_class(F.col("reason_type"), F.col("sens_flux")))
    return out


def with_inclusion(receipts: DataFrame) -> DataFrame:
    """Only completed receipts count; a table without any status counts whole."""
    any_status = receipts.agg(F.max(F.col("statut_normalise") != "Non renseigne").alias("s")).scalar()
    return receipts.withColumn("incluse", F.when(F.coalesce(any_status, F.lit(False)), F.col("statut_normalise") == COMPLETED).otherwise(F.lit(True)))


def canonical_receipts(receipts: DataFrame) -> DataFrame:
    """One row per receipt number: completed first, then latest; the number of source lines is kept."""
    done = (F.col("statut_normalise") == COMPLETED).cast("int")
    order = F.struct(done.alias("a"), F.col("completion_time").alias("b"), F.col("montant").alias("c"), F.col("currency_code").alias("d"))
    row = F.struct(*[F.col(c) for c in receipts.columns])
    numbered = receipts.where(F.col("receipt_no").isNotNull())
    best = numbered.groupBy(F.col("receipt_no").alias("__no")).agg(F.max_by(row, order).alias("r"), F.count("*").alias("nombre_lignes_recu"))
    unnumbered = receipts.where(F.col("receipt_no").isNull()).withColumn("nombre_lignes_recu", F.lit(1).cast("bigint"))
    return best.select("r.*", "nombre_lignes_recu").unionByName(unnumbered)


# --- match with the ledger ------------------------------------------------------------------------------------

def ledger_by_reference(ledger: DataFrame) -> DataFrame:
    """Ledger lines of one reference brought to one row; mirror lines are not added up."""
    account, text = F.upper("account_type"), F.lower("description")
    size = F.greatest(F.abs("dr"), F.abs("cr"))
    no = F.lit(False)
    loan = F.coalesce(contains_any(account, ["LOAN ACCOUNT", "LOAN PORTFOLIO", "PRINCIPLE"]), no) | F.coalesce(contains_any(text, ["repayment", "remboursement"]), no)
    term = F.coalesce(account == W.FIXED, no) | F.coalesce(F.contains(text, F.lit("depot bloque")), no)
    deposit = F.coalesce(account == W.OPEN, no) | F.coalesce(F.contains(text, F.lit("epargne depot")), no)
    referenced = ledger.withColumn("__ref", none_if_blank(F.col("ref_no"))).where("__ref IS NOT NULL")
    return referenced.groupBy(F.col("__ref").alias("ref_no")).agg(
        F.min("msisdn1").alias("l_phone"), F.max("msisdn1").alias("l_phone_2"), F.min("currency_code").alias("l_cur"),
        F.max("currency_code").alias("l_cur_2"), F.coalesce(F.max(F.when(account == W.WALLET, size)), F.max(size)).alias("l_montant"),
        F.min("created_at").alias("l_date"), F.min("customer_id").alias("l_customer"),
        F.max(loan).alias("is_loan"), F.max(term).alias("is_term"), F.max(deposit).alias("is_deposit"), F.count("*").alias("l_lignes"))


def withdrawals(ledger: DataFrame) -> DataFrame:
    """Withdrawals without reference, one per account reference and moment."""
    text = F.lower("description")
    rows = ledger.where(F.contains(text, F.lit("retrait vers m-pesa")) & none_if_blank(F.col("ref_no")).isNull())
    return rows.groupBy("msisdn1", "currency_code", "reference_id", "created_at").agg(
        F.max(amount(F.greatest(F.abs("dr"), F.abs("cr")))).alias("valeur"), F.min("customer_id").alias("customer_id"))


def tolerance_match(outputs: DataFrame, ledger: DataFrame, minutes: int = MATCH_MINUTES) -> DataFrame:
    """Outputs without a known reference matched on phone, currency, amount and time."""
    asked = outputs.select("receipt_no", "phone", "currency_code", amount("montant").alias("valeur"), F.coalesce("initiation_time", "completion_time").alias("moment"))
    offered = withdrawals(ledger).select(F.col("msisdn1").alias("phone"), "currency_code", "valeur", F.col("created_at").alias("s_date"),
                                         F.concat_ws("|", "reference_id", F.col("customer_id").cast("string")).alias("s_ref"))
    found = nearest_within(asked, offered, ["phone", "currency_code", "valeur"], "moment", "s_date", "s_ref", minutes)
    joined = asked.join(found, ["phone", "currency_code", "valeur", "moment"], "left")
    return joined.select("receipt_no", F.coalesce("candidats", F.lit(0)).alias("candidats"), "s_date",
                         F.split_part("s_ref", F.lit("|"), F.lit(1)).alias("s_reference"), F.split_part("s_ref", F.lit("|"), F.lit(2)).alias("s_customer"))


def match_receipts(receipts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every canonical receipt with its ledger group (by reference, else by tolerance), the controls and the status."""
    base = canonical_receipts(with_inclusion(classified(receipts)))
    refs = ledger_by_reference(ledger)
    direct = base.join(refs, base["receipt_no"] == refs["ref_no"], "left")
    known = F.col("ref_no").isNotNull()
    orphan = base.join(refs.select("ref_no"), base["receipt_no"] == refs["ref_no"], "left_anti")
    orphan = orphan.where((F.col("classe") == PAYOUT) & F.col("receipt_no").isNotNull())
    found = tolerance_match(orphan, ledger).select(F.col("receipt_no").alias("__no"), "candidats", "s_date", "s_reference", "s_customer")
    joined = direct.join(found, direct["receipt_no"] == found["__no"], "left").drop("__no")

    by_time = ~known & (F.coalesce(F.col("candidats"), F.lit(0)) > 0)
    matched = known | by_time
    entry = F.col("sens_flux") == "Entree"
    final_class = (F.when((F.col("classe") != INTERNAL) & entry & known & F.col("is_loan"), TO_LOAN)
                   .when((F.col("classe") != INTERNAL) & entry & known & F.col("is_term"), TO_TERM)
                   .when((F.col("classe") != INTERNAL) & entry & known & F.col("is_deposit"), TO_DEPOSIT)
                   .otherwise(F.col("classe")))
    ledger_date = F.when(known, F.col("l_date")).when(by_time, F.col("s_date"))
    moment = F.coalesce("initiation_time", "completion_time")
    gap = F.timestamp_diff("MICROSECOND", ledger_date, moment) / F.lit(60_000_000)

    def control(bad: Column) -> Column:
        return F.when(~matched, "Non controle").when(bad, "Ecart").otherwise("Conforme")

    no = F.lit(False)
    phone_gap = known & F.coalesce((F.col("phone") != F.col("l_phone")) & (F.col("phone") != F.col("l_phone_2")), no)
    currency_gap = known & F.coalesce((F.col("currency_code") != F.col("l_cur")) & (F.col("currency_code") != F.col("l_cur_2")), no)
    amount_gap = known & F.coalesce(F.abs(amount("montant") - amount("l_montant")) > F.lit(0.01).cast(MONEY), no)
    date_gap = matched & F.coalesce(F.abs(gap) > GAP_MINUTES, no)
    several = by_time & (F.col("candidats") > 1)
    gaps = phone_gap | currency_gap | amount_gap | date_gap | several
    internal = F.col("classe") == INTERNAL
    status = F.when(internal, NOT_APPLICABLE).when(~matched, UNMATCHED).when(gaps, WITH_GAP).otherwise(EXACT)
    method = F.when(known, "Reference").when(by_time, "Telephone + devise + montant + heure (sortie)")
    return joined.select(
        *[c for c in base.columns if c != "classe"], final_class.alias("classe"), "ref_no",
        F.coalesce(F.col("l_customer").cast("string"), F.nullif(F.col("s_customer"), F.lit(""))).alias("customer_id"),
        F.coalesce("candidats", F.lit(0)).alias("candidats_sortie"), F.when(by_time, F.col("s_reference")).alias("reference_sortie"),
        method.alias("methode"), ledger_date.alias("date_ecriture"), gap.alias("ecart_minutes"),
        control(phone_gap).alias("controle_telephone"), control(currency_gap).alias("controle_devise"), control(amount_gap).alias("controle_montant"),
        F.when(date_gap, "Ecart de date").when(matched & (F.to_date(ledger_date) != F.to_date(moment)), "Conforme - passage de date")
        .when(matched, "Conforme").otherwise("Non controle").alias("controle_date"),
        status.alias("statut_rapprochement"))


def receipt_anomaly_rules() -> list[Rule]:
    applicable = F.col("statut_rapprochement") != NOT_APPLICABLE
    return [
        (F.col("receipt_no").isNull(), "Recu manquant"),
        (F.col("nombre_lignes_recu") > 1, "Recu duplique"),
        (F.col("statut_normalise") != COMPLETED, "Statut non termine"),
        (applicable & (F.col("statut_rapprochement") == UNMATCHED), "Reference absente du journal"),
        (applicable & (F.col("controle_telephone") == "Ecart"), "Ecart de telephone"),
        (applicable & (F.col("controle_devise") == "Ecart"), "Ecart de devise"),
        (applicable & (F.col("controle_montant") == "Ecart"), "Ecart de montant"),
        (applicable & (F.col("controle_date") == "Ecart de date"), "Ecart de date de creation"),
        (applicable & (F.col("candidats_sortie") > 1), "Plusieurs candidats"),
        (F.col("classe").isin(OTHER_IN, OTHER_OUT, TO_CHECK), "Operation non classee"),
    ]


def receipt_anomalies(matched: DataFrame) -> DataFrame:
    return matched.withColumn("motif_anomalie", reasons(receipt_anomaly_rules())).where("motif_anomalie IS NOT NULL")


# --- syntheses ------------------------------------------------------------------------------------------------

def count_summary(detail: DataFrame, label: str = "classe") -> DataFrame:
    """Entries per currency: term deposits, deposits, loan repayments, total; zero where there is none."""
    c = F.col(label)
    return detail.groupBy("currency_code").agg(
        count_if(c == TO_TERM).alias("nombre_dat"), count_if(c == TO_DEPOSIT).alias("nombre_depot_normal"),
        count_if(c == TO_LOAN).alias("nombre_remboursement"), F.count("*").alias("nombre_total"))


def flow_pivot(detail: DataFrame, label: str = "classe") -> DataFrame:
    """Counts and amounts per currency and class, totals and net balance of included receipts, currencies apart."""
    rows = detail.where("incluse")
    c = F.col(label)
    cells = []
    for name in (*ENTRY_CLASSES, *OUTPUT_CLASSES):
        cells += [count_if(c == name).alias(f"nombre {name}"), total("montant", c == name).alias(f"montant {name}")]
    entry, output = F.col("sens_flux") == "Entree", F.col("sens_flux") == "Sortie"
    ins, outs = exact_sum("montant", entry), exact_sum("montant", output)
    return rows.groupBy("currency_code").agg(
        *cells, count_if(entry).alias("nombre_entrees"), count_if(output).alias("nombre_sorties"), ins.cast("double").alias("montant_total_entrees"),
        outs.cast("double").alias("montant_total_sorties"), (ins - outs).cast("double").alias("solde_net"))


def daily_synthesis(detail: DataFrame, label: str = "classe") -> DataFrame:
    rows = detail.where("incluse")
    return rows.groupBy(F.to_date("completion_time").alias("jour"), "currency_code", "sens_flux", label).agg(
        F.count("*").alias("nombre"), total("montant").alias("montant"))


def term_deposit_crosscheck(receipts: DataFrame, fixed: DataFrame) -> DataFrame:
    """Entries that equal a term deposit by phone, currency and amount, with the number of such deposits."""
    offered = fixed.groupBy(F.col("msisdn").alias("phone"), "currency_code", amount("balance").alias("valeur")).agg(
        F.count("*").alias("nombre_dat"), F.min("savings_id").alias("savings_id"))
    entries = receipts.where(F.col("sens_flux") == "Entree").withColumn("valeur", amount("montant"))
    joined = entries.join(offered, ["phone", "currency_code", "valeur"])
    return joined.select("receipt_no", "phone", "currency_code", "montant", "nombre_dat", F.when(F.col("nombre_dat") == 1, F.col("savings_id")).alias("savings_id"))


WEEKDAYS = ("Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche")


def time_analysis(detail: DataFrame, grain: str, date: str = "completion_time") -> DataFrame:
    """Receipts per day, weekday, hour or day and hour, per currency and direction, zero where there is none.

    The scaffold is unfolded from one row per currency and direction (first to last day), so it does not grow
    with the number of receipts.
    """
    rows = detail.where(F.col("incluse") & F.col(date).isNotNull()).select(
        "currency_code", "sens_flux", F.to_date(date).alias("jour"), F.hour(date).alias("heure"), F.weekday(date).alias("jour_num"))
    whole = rows.agg(F.min("jour").alias("a"), F.max("jour").alias("b"))
    groups = rows.groupBy("currency_code", "sens_flux").agg(F.count("*").alias("__n")).drop("__n")
    days = F.explode(F.sequence(whole.select("a").scalar(), whole.select("b").scalar()))
    hours = F.explode(F.sequence(F.lit(0), F.lit(23)))
    grains = {"jour": ("jour",), "jour_semaine": ("jour_num",), "heure": ("heure",), "jour_heure": ("jour", "heure")}
    columns = grains[grain]
    scaffold = groups
    for c in columns:
        scaffold = scaffold.withColumn(c, days if c == "jour" else hours if c == "heure" else F.explode(F.sequence(F.lit(0), F.lit(6))))
    keys = ["currency_code", "sens_flux", *columns]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    out = match_null_safe(scaffold, counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("nombre_transactions"))
    if grain == "jour_semaine":
        out = out.withColumn("jour_semaine", F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("jour_num") + 1))
    return out


def retention(detail: DataFrame, date: str = "completion_time", phone: str = "phone") -> DataFrame:
    """Monthly retention at M+1 and within 90 days per currency; a window not fully observed stays empty.

    Activity is first reduced to one row per phone, currency and day, so a phone with very many operations costs
    no more than its days.
    """
    rows = detail.where(F.col("incluse") & (F.col("classe") != INTERNAL) & F.col(phone).isNotNull() & F.col(date).isNotNull())
    days = rows.select(F.col(phone).alias("phone"), "currency_code", F.to_date(date).alias("jour")).distinct()
    last_day = rows.agg(F.max(F.to_date(date)).alias("d")).scalar()
    monthly = days.groupBy("phone", "currency_code", F.trunc("jour", "month").alias("mois")).agg(
        F.min("jour").alias("premier"), F.max("jour").alias("dernier"))
    following = monthly.select("phone", "currency_code", F.add_months("mois", -1).alias("mois"), F.lit(True).alias("m1"))
    joined = monthly.join(following, ["phone", "currency_code", "mois"], "left")
    # A return inside 90 days: another active day after the month, at most 90 days after its last active day.
    later = monthly.select("phone", "currency_code", F.col("mois").alias("m2"), F.col("premier").alias("retour"))
    shifts = joined.select("phone", "currency_code", "mois", "dernier", "m1", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    shifts = shifts.withColumn("m2", F.add_months("mois", F.col("k")))
    seen = shifts.join(later, ["phone", "currency_code", "m2"], "left")
    within = F.coalesce(F.datediff("retour", "dernier") <= 90, F.lit(False))
    per_client = seen.groupBy("phone", "currency_code", "mois").agg(
        F.coalesce(F.max("m1"), F.lit(False)).alias("m1"), F.max(within).alias("j90"), F.max("dernier").alias("dernier"))
    month_end = F.last_day("mois")
    per_month = per_client.groupBy("currency_code", "mois").agg(
        F.count("*").alias("clients_actifs"), count_if(F.col("m1")).alias("n1"), count_if(F.col("j90")).alias("n90"))
    ready_1 = last_day >= F.last_day(F.add_months("mois", 1))
    ready_90 = last_day >= F.date_add(month_end, 90)
    return per_month.select(
        F.date_format("mois", "yyyy-MM").alias("mois"), "currency_code", "clients_actifs", ready_1.alias("eligible_m1"), ready_90.alias("eligible_90j"),
        F.when(ready_1, ratio(F.col("n1"), F.col("clients_actifs")) * 100).alias("retention_m1_pct"),
        F.when(ready_90, ratio(F.col("n90"), F.col("clients_actifs")) * 100).alias("retention_90j_pct"))


def ledger_proxy(journal: DataFrame) -> DataFrame:
    """What the ledger alone proves when no receipts exist; controls are marked as not applicable."""
    t = F.col("type_operation")
    label = (F.when(t == W.DEPOSIT, TO_DEPOSIT).when(t == W.TERM_DEPOSIT, TO_TERM).when(t.isin(*W.REPAYMENTS), TO_LOAN)
             .when(t == W.WITHDRAWAL, PAYOUT))
    out = t == W.WITHDRAWAL
    return journal.where(label.isNotNull()).select(
        F.col("event_key").alias("receipt_no"), "customer_id", F.col("telephone").alias("phone"), "currency_code", label.alias("classe"),
        F.when(out, "Sortie").otherwise("Entree").alias("sens_flux"), F.col("montant_operation").alias("montant"),
        F.col("created_at").alias("completion_time"), F.lit("Comptabilisee").alias("statut"), F.lit(True).alias("incluse"),
        F.lit("Journal seul").alias("source_analytique"), F.lit("Non applicable - journal seul").alias("statut_rapprochement"))


def enrich_proxy(proxy: DataFrame, receipts: DataFrame) -> DataFrame:
    """Names and status of known receipts added to the ledger-only rows; days outside the receipts' dates are flagged."""
    base = canonical_receipts(classified(receipts))
    known = base.select(F.concat(F.lit("REF|"), "receipt_no").alias("receipt_no"), F.col("nom_client").alias("nom_recu"), F.col("statut_normalise").alias("statut_recu"))
    bounds = receipts.agg(F.min(F.to_date("completion_time")).alias("a"), F.max(F.to_date("completion_time")).alias("b"))
    day = F.to_date("completion_time")
    covered = day.between(bounds.select("a").scalar(), bounds.select("b").scalar())
    return proxy.join(known, "receipt_no", "left").withColumn(
        "couverture", F.when(F.col("statut_recu").isNotNull(), "Recu retrouve").when(covered, "Recu absent").otherwise("Periode non couverte"))


# --- names and presence ---------------------------------------------------------------------------------------

def enrich_names(df: DataFrame, receipts: DataFrame, phone: str = "msisdn1", reference: str | None = "ref_no") -> DataFrame:
    """Client name by phone, else by reference. Names never touch amounts; one name per key, so no row is added."""
    named = receipts.where(F.col("nom_client").isNotNull())
    by_phone = named.where(F.col("phone").isNotNull()).groupBy(F.col("phone").alias("__p")).agg(F.min("nom_client").alias("__n1"))
    out = df.join(by_phone, df[phone] == by_phone["__p"], "left")
    by_ref = None
    if reference and has(df, reference):
        by_ref = named.where(F.col("receipt_no").isNotNull()).groupBy(F.col("receipt_no").alias("__r")).agg(F.min("nom_client").alias("__n2"))
        out = out.join(by_ref, out[reference] == by_ref["__r"], "left")
    second = F.col("__n2") if by_ref is not None else F.lit(None).cast("string")
    mode = F.when(F.col("__n1").isNotNull(), "Telephone").when(second.isNotNull(), "Reference").otherwise("Nom non rapproche")
    return out.withColumns({"nom_client": F.coalesce(F.col("__n1"), second), "mode_nom_client": mode}).drop("__p", "__n1", "__r", "__n2")


def phones_of(*sources: tuple[DataFrame, str]) -> DataFrame:
    """Distinct valid phone keys of several sources."""
    out = None
    for df, column in sources:
        part = df.select(phone_key(F.col(column)).alias("phone")).where("phone IS NOT NULL").distinct()
        out = part if out is None else out.unionByName(part)
    return out.distinct()


PRESENCE = (
    ((True, True, True), "Present dans les recus, le journal et le systeme central"), ((True, True, False), "Present dans les recus et le journal"),
    ((True, False, True), "Present dans les recus et le systeme central"), ((False, True, True), "Present dans le journal et le systeme central"),
    ((True, False, False), "Present dans les recus seulement"), ((False, True, False), "Present dans le journal seulement"),
)


def presence_crosscheck(ledger_phones: DataFrame, receipt_phones: DataFrame, core: DataFrame, separator: str = " | ") -> DataFrame:
    """One row per phone seen in the ledger or the receipts, with the core clients sharing it."""
    seen = ledger_phones.withColumn("present_journal", F.lit(True)).join(receipt_phones.withColumn("present_recus", F.lit(True)), "phone", "full_outer")
    valid = core.where(F.col("phone_prefixe").isNotNull())
    counts = valid.groupBy(F.col("phone_prefixe").alias("phone")).agg(F.count("*").alias("nb_clients_centraux"))
    names = valid.where(F.col("nom_complet").isNotNull()).select(F.col("phone_prefixe").alias("phone"), "nom_complet").distinct()
    names = names.groupBy("phone").agg(F.array_join(F.array_sort(F.collect_list("nom_complet")), separator).alias("noms_clients_centraux"))
    joined = seen.join(counts.join(names, "phone", "left"), "phone", "left")
    j, r = (F.coalesce(c, F.lit(False)) for c in ("present_journal", "present_recus"))
    n = F.coalesce("nb_clients_centraux", F.lit(0))
    k = n > 0
    status = F.when(F.lit(False), "")
    for (a, b, c), label in PRESENCE:
        status = status.when((r == a) & (j == b) & (k == c), label)
    found = F.when(n == 0, "Non trouve").when(n == 1, "Trouve").otherwise("Trouve - plusieurs clients")
    return joined.select("phone", j.alias("present_journal"), r.alias("present_recus"), k.alias("present_central"), (j & r & k).alias("present_partout"),
                         n.alias("nb_clients_centraux"), "noms_clients_centraux", found.alias("statut_central"), status.alias("statut_presence"))


def populations(presence: DataFrame) -> DataFrame:
    """Phones and core clients in each pairwise and in the triple intersection."""
    k = F.col("present_central")
    wanted = (("recus et central", k & F.col("present_recus")), ("journal et central", k & F.col("present_journal")), ("les trois", F.col("present_partout")))
    from comptoir.operators.quality import unfold

    wide = presence.agg(*[m for i, (_, c) in enumerate(wanted) for m in (
        count_if(c).alias(f"p{i}"), F.coalesce(F.sum(F.when(c, F.col("nb_clients_centraux"))), F.lit(0)).alias(f"c{i}"))])
    return unfold(wide, [[("population", F.lit(n)), ("telephones", F.col(f"p{i}")), ("clients", F.col(f"c{i}"))] for i, (n, _) in enumerate(wanted)])


def reconciliation_quality(matched: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Match quality per circuit and currency of completed receipts; loan payments have no comparable counterpart."""
    rows = matched
    if start and end:
        rows = rows.where(W.in_period(matched, start, end, "completion_time"))
    c = F.col("classe")
    circuit = (F.when(c == INTERNAL, None).when(F.col("sens_flux") == "Entree", "Entrées et remboursements").when(c == LOAN_REQUEST, "Versements de prêts")
               .when(c == PAYOUT, "Sorties B2C"))
    done = F.col("statut_normalise") == COMPLETED
    hit = F.col("statut_rapprochement").isin(EXACT, WITH_GAP)
    grouped = rows.where(circuit.isNotNull()).groupBy(circuit.alias("circuit"), "currency_code").agg(
        F.count("*").alias("operations_observees"), count_if(done).alias("operations_terminees"), count_if(done & hit).alias("h"))
    comparable = F.col("circuit") != "Versements de prêts"
    return grouped.select(
        "circuit", "currency_code", "operations_observees", "operations_terminees", F.when(comparable, F.col("h")).otherwise(0).alias("operations_rapprochees"),
        F.when(comparable, F.col("operations_terminees") - F.col("h")).otherwise(0).alias("operations_non_rapprochees"),
        F.when(comparable, ratio(F.col("h"), F.col("operations_terminees")) * 100).alias("taux_rapprochement_pct"))


def status_counts(receipts: DataFrame) -> DataFrame:
    return classified(receipts).groupBy("currency_code", "statut_normalise").agg(F.count("*").alias("nombre_operations"))


