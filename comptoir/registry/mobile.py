"""Registered queries of the mobile wallet: receipts, events, positions, periods, forecast."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from comptoir.operators import filters as FL
from comptoir.operators import forecast as FC
from comptoir.operators import periods as T
from comptoir.operators import positions as P
from comptoir.operators import quality as Q
from comptoir.operators import receipts as R
from comptoir.operators import wallet as W
from comptoir.registry import views as V
from comptoir.registry.base import register
from comptoir.registry.sqltext import M, avg, big, cnt, div, dsum, fsum, m

DAY = dt.date(2001, 8, 1)
START, END = dt.date(2024, 1, 8), dt.date(2024, 1, 28)
D = f"DATE '{DAY}'"
PERIOD = f"created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END + dt.timedelta(days=1)}'"
JRN, EVT, RCP, SAV, LON = ("v_journal",), ("v_events",), ("v_receipts",), ("v_savings",), ("v_loans",)


def sql_date(day):
    return f"DATE '{day}'"


V.VIEW_SQL["v_events"] = f"""
SELECT user_id AS customer_id, CASE WHEN event_id % 2 = 0 THEN 'CDF' ELSE 'USD' END AS currency_code,
  CASE WHEN k IN ('click', 'pret') THEN concat('T|', strftime(ts, '%Y%m%d%H%M%S%f'), CASE WHEN k = 'click' THEN concat('|REF', CAST(user_id AS VARCHAR)) ELSE '' END)
       ELSE concat('REF|TX', CAST(event_id AS VARCHAR)) END AS event_key,
  ts AS created_at, concat('243', CAST(810000000 + user_id AS VARCHAR)) AS telephone, CAST(2 AS BIGINT) AS nombre_lignes,
  CASE WHEN k IN ('signup', 'deblocage') THEN concat('SA', CAST(user_id * 2 + 1 AS VARCHAR)) END AS reference_dat,
  CASE k WHEN 'view' THEN '{W.DEPOSIT}' WHEN 'click' THEN '{W.WITHDRAWAL}' WHEN 'signup' THEN '{W.TERM_DEPOSIT}' WHEN 'pret' THEN '{W.DISBURSEMENT}' WHEN 'deblocage' THEN '{W.RELEASE}'
       WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN '{W.PENALTY_REPAYMENT}' ELSE '{W.REPAYMENT}' END ELSE '{W.OTHER}' END AS type_operation,
  NOT (k = 'deblocage' OR (k = 'purchase' AND event_id % 5 = 0)) AS passe_par_portefeuille, value AS montant_operation,
  CASE WHEN k = 'view' THEN value ELSE z END AS depot_epargne, CASE WHEN k = 'signup' THEN value ELSE z END AS depot_dat, CASE WHEN k = 'click' THEN value ELSE z END AS retrait_epargne,
  CASE WHEN k = 'deblocage' THEN value ELSE z END AS retour_dat, CASE WHEN k = 'pret' THEN value ELSE z END AS montant_decaisse,
  CASE WHEN k = 'purchase' AND event_id % 5 = 0 THEN value ELSE z END AS remboursement_compte_ouvert,
  CASE WHEN k = 'purchase' AND event_id % 5 <> 0 THEN value ELSE z END AS remboursement_portefeuille,
  CASE WHEN k = 'purchase' AND event_id % 4 = 0 THEN value ELSE z END AS penalite_observee, z AS interet_observe, z AS principal_rembourse,
  CASE WHEN k IN ('view', 'signup', 'error') OR (k = 'purchase' AND event_id % 5 <> 0) THEN value ELSE z END AS montant_entree,
  CASE WHEN k IN ('click', 'pret') THEN value ELSE z END AS montant_sortie,
  CASE WHEN k IN ('click', 'pret') THEN value ELSE z END AS entree_portefeuille,
  CASE WHEN k IN ('view', 'signup', 'error') OR (k = 'purchase' AND event_id % 5 <> 0) THEN value ELSE z END AS sortie_portefeuille,
  true AS operation_symetrique, CASE WHEN k = 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'Compte ouvert' ELSE 'Portefeuille' END END AS origine_remboursement
FROM (SELECT *, CAST(0 AS DOUBLE) AS z, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'pret' WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'deblocage' ELSE event_type END AS k FROM events)
"""
EVENT_COLUMNS = ("customer_id", "currency_code", "event_key", "created_at", "telephone", "nombre_lignes", "reference_dat", "type_operation", "passe_par_portefeuille",
                 "montant_operation", "depot_epargne", "depot_dat", "retrait_epargne", "retour_dat", "montant_decaisse", "remboursement_compte_ouvert",
                 "remboursement_portefeuille", "penalite_observee", "montant_entree", "montant_sortie", "entree_portefeuille", "sortie_portefeuille",
                 "operation_symetrique", "origine_remboursement")


def journal(spark, sf):
    return W.events(V.journal(spark, sf))


@register("M1_event_journal", f"SELECT {', '.join(EVENT_COLUMNS)} FROM v_events", EVT)
def m1(spark, sf):
    return journal(spark, sf).select(*EVENT_COLUMNS)


# --- sources --------------------------------------------------------------------------------------------------

def raw_receipts(spark, sf):
    r = V.receipts(spark, sf)
    entry = F.col("sens_flux") == "Entree"
    text = F.format_number("montant", 2)
    value = F.regexp_replace(text, ",", " ")
    split = F.col("phone").endswith("3")
    return r.select(
        F.concat(F.lit(" "), "receipt_no").alias("Receipt No."), F.date_format("completion_time", "dd-MM-yyyy HH:mm:ss").alias("Completion Time"),
        F.when(entry & ~split, value).alias("Paid In"), F.when(~entry & ~split, F.concat(F.lit("-"), value)).alias("Withdrawn"),
        F.when(split, F.when(entry, value).otherwise(F.concat(F.lit("-"), value))).alias("Transaction Amount"),
        F.lower("currency_code").alias("Currency"), F.when(F.col("statut") == "Completed", " SUCCESSFUL").otherwise("Failed").alias("Transaction Status"),
        F.col("reason_type").alias("Reason Type"), F.concat(F.col("phone"), F.lit(" - "), F.col("nom_client")).alias("Opposite Party"))


@register("C24_receipt_amounts", """
SELECT receipt_no, CASE WHEN phone LIKE '%3' THEN 'Transaction Amount' WHEN montant = 0 THEN NULL WHEN sens_flux = 'Entree' THEN 'Paid In' ELSE 'Withdrawn' END AS source_montant,
  CASE WHEN montant = 0 THEN 'A verifier' ELSE sens_flux END AS sens_flux, CASE WHEN montant <> 0 OR phone LIKE '%3' THEN montant END AS montant,
  CASE WHEN sens_flux = 'Entree' THEN montant ELSE CAST(0 AS DOUBLE) END AS montant_entree, CASE WHEN sens_flux = 'Sortie' THEN montant ELSE CAST(0 AS DOUBLE) END AS montant_sortie,
  date_trunc('second', completion_time) AS completion_time FROM v_receipts""", RCP)
def c24(spark, sf):
    out = R.prepare_receipts(raw_receipts(spark, sf))
    return out.select("receipt_no", "source_montant", "sens_flux", "montant", "montant_entree", "montant_sortie", "completion_time")


@register("C25_opposite_party", "SELECT receipt_no, phone, nom_client FROM v_receipts", RCP)
def c25(spark, sf):
    return R.prepare_receipts(raw_receipts(spark, sf)).select("receipt_no", "phone", "nom_client")


@register("C26_receipt_status", """
SELECT receipt_no, CASE statut WHEN 'Completed' THEN 'Completed' ELSE 'Declined' END AS statut_normalise, statut = 'Completed' AS incluse FROM v_receipts""", RCP)
def c26(spark, sf):
    return R.with_inclusion(R.prepare_receipts(raw_receipts(spark, sf))).select("receipt_no", "statut_normalise", "incluse")


CLASS_SQL = f"""CASE WHEN reason_type = 'Super Transaction' THEN '{R.INTERNAL}' WHEN sens_flux = 'Entree' AND reason_type LIKE '%Repayment' THEN '{R.TO_LOAN}'
  WHEN sens_flux = 'Entree' AND reason_type LIKE '%C2B' THEN '{R.TO_DEPOSIT}' WHEN sens_flux = 'Sortie' AND reason_type = 'LoanRequest' THEN '{R.LOAN_REQUEST}'
  WHEN sens_flux = 'Sortie' AND reason_type LIKE '%B2C' THEN '{R.PAYOUT}' WHEN sens_flux = 'Entree' THEN '{R.OTHER_IN}' ELSE '{R.OTHER_OUT}' END"""

MATCH_VIEW = f"""
WITH refs AS (SELECT ref_no, min(msisdn1) AS p1, max(msisdn1) AS p2, min(currency_code) AS c1, max(currency_code) AS c2,
    coalesce(max(greatest(abs(dr), abs(cr))) FILTER (WHERE account_type = 'MPESA ACCOUNT'), max(greatest(abs(dr), abs(cr)))) AS v, min(created_at) AS d, min(customer_id) AS cu,
    bool_or(account_type IN ('LOAN ACCOUNT', 'LOAN PORTFOLIO', 'PRINCIPLE') OR description ILIKE '%remboursement%') AS is_loan,
    bool_or(account_type = 'FIXED SAVINGS' OR description = 'Depot Bloque') AS is_term, bool_or(account_type = 'NORMAL SAVINGS' OR description = 'Epargne depot') AS is_dep
  FROM v_journal WHERE ref_no IS NOT NULL GROUP BY 1),
base AS (SELECT r.*, {CLASS_SQL} AS cl0, statut = 'Completed' AS incluse, f.* FROM v_receipts r LEFT JOIN refs f ON f.ref_no = r.receipt_no),
wd AS (SELECT msisdn1, currency_code, reference_id, created_at, max({m('greatest(dr, cr)')}) AS v, min(customer_id) AS cu FROM v_journal WHERE description = 'Retrait Vers M-Pesa' GROUP BY 1, 2, 3, 4),
near AS (SELECT b.receipt_no, count(*) AS n, arg_min(w.reference_id, [abs(epoch_us(w.created_at) - epoch_us(b.initiation_time)), epoch_us(w.created_at)]) AS sref,
    arg_min(w.created_at, [abs(epoch_us(w.created_at) - epoch_us(b.initiation_time)), epoch_us(w.created_at)]) AS sd, arg_min(w.cu, [abs(epoch_us(w.created_at) - epoch_us(b.initiation_time)), epoch_us(w.created_at)]) AS scu
  FROM base b JOIN wd w ON b.ref_no IS NULL AND b.cl0 = '{R.PAYOUT}' AND w.msisdn1 = b.phone AND w.currency_code = b.currency_code AND w.v = {m('b.montant')}
    AND abs(epoch_us(w.created_at) - epoch_us(b.initiation_time)) <= 7200000000 GROUP BY 1),
j AS (SELECT b.*, coalesce(n, 0) AS n, sref, sd, scu, b.ref_no IS NOT NULL AS kn, b.ref_no IS NULL AND n > 0 AS bt, CASE WHEN b.ref_no IS NOT NULL THEN b.d ELSE sd END AS ld FROM base b LEFT JOIN near USING (receipt_no)),
g AS (SELECT *, kn AND phone <> p1 AND phone <> p2 AS gp, kn AND currency_code <> c1 AND currency_code <> c2 AS gc, kn AND abs({m('montant')} - {m('v')}) > CAST(0.01 AS {M}) AS ga,
    coalesce(abs((epoch_us(initiation_time) - epoch_us(ld)) / CAST(60000000 AS DOUBLE)) > 60, false) AS gd FROM j)
SELECT receipt_no, phone, currency_code, montant, sens_flux, statut AS statut_normalise, incluse, initiation_time, completion_time, CAST(1 AS BIGINT) AS nombre_lignes_recu,
  CASE WHEN cl0 <> '{R.INTERNAL}' AND sens_flux = 'Entree' AND kn AND is_loan THEN '{R.TO_LOAN}' WHEN cl0 <> '{R.INTERNAL}' AND sens_flux = 'Entree' AND kn AND is_term THEN '{R.TO_TERM}'
       WHEN cl0 <> '{R.INTERNAL}' AND sens_flux = 'Entree' AND kn AND is_dep THEN '{R.TO_DEPOSIT}' ELSE cl0 END AS classe,
  CAST(CASE WHEN kn THEN cu ELSE scu END AS VARCHAR) AS customer_id, n AS candidats_sortie, CASE WHEN bt THEN sref END AS reference_sortie,
  CASE WHEN kn THEN 'Reference' WHEN bt THEN 'Telephone + devise + montant + heure (sortie)' END AS methode, (epoch_us(initiation_time) - epoch_us(ld)) / CAST(60000000 AS DOUBLE) AS ecart_minutes,
  CASE WHEN NOT (kn OR coalesce(bt, false)) THEN 'Non controle' WHEN gp THEN 'Ecart' ELSE 'Conforme' END AS controle_telephone,
  CASE WHEN NOT (kn OR coalesce(bt, false)) THEN 'Non controle' WHEN gc THEN 'Ecart' ELSE 'Conforme' END AS controle_devise,
  CASE WHEN NOT (kn OR coalesce(bt, false)) THEN 'Non controle' WHEN ga THEN 'Ecart' ELSE 'Conforme' END AS controle_montant,
  CASE WHEN gd THEN 'Ecart de date' WHEN (kn OR coalesce(bt, false)) AND CAST(ld AS DATE) <> CAST(initiation_time AS DATE) THEN 'Conforme - passage de date' WHEN kn OR coalesce(bt, false) THEN 'Conforme' ELSE 'Non controle' END AS controle_date,
  CASE WHEN cl0 = '{R.INTERNAL}' THEN '{R.NOT_APPLICABLE}' WHEN NOT (kn OR coalesce(bt, false)) THEN '{R.UNMATCHED}' WHEN coalesce(gp, false) OR coalesce(gc, false) OR coalesce(ga, false) OR gd OR (coalesce(bt, false) AND n > 1) THEN '{R.WITH_GAP}' ELSE '{R.EXACT}' END AS statut_rapprochement
FROM g
"""
V.VIEW_SQL["v_match"] = MATCH_VIEW
V.VIEW_USES["v_match"] = ("v_journal", "v_receipts")
MTC = ("v_match",)


def matched(spark, sf):
    return R.match_receipts(V.receipts(spark, sf), V.journal(spark, sf))


@register("C27_operation_class", "SELECT receipt_no, classe FROM v_match", MTC)
def c27(spark, sf):
    return matched(spark, sf).select("receipt_no", "classe")


MATCH_COLUMNS = ("receipt_no", "classe", "customer_id", "candidats_sortie", "reference_sortie", "methode", "ecart_minutes", "controle_telephone", "controle_devise",
                 "controle_montant", "controle_date", "statut_rapprochement")


@register("J9_receipt_ledger_match", f"SELECT {', '.join(MATCH_COLUMNS)} FROM v_match", MTC)
def j9(spark, sf):
    return matched(spark, sf).select(*MATCH_COLUMNS)


@register("J10_tolerance_match", f"""
SELECT receipt_no, candidats_sortie, reference_sortie, ecart_minutes FROM v_match WHERE classe = '{R.PAYOUT}'""", MTC)
def j10(spark, sf):
    """All payouts, those without a candidate too."""
    return matched(spark, sf).where(F.col("classe") == R.PAYOUT).select(
        "receipt_no", "candidats_sortie", "reference_sortie", "ecart_minutes")


@register("C28_account_typing", f"""
SELECT CASE WHEN account_type = 'FIXED SAVINGS' THEN 'FIXED SAVINGS' ELSE 'NORMAL SAVINGS' END AS account_type, count(*) AS comptes, {cnt('balance = 0')} AS soldes_nuls FROM v_savings GROUP BY 1""", SAV)
def c28(spark, sf):
    s = V.savings(spark, sf)
    fixed = F.col("account_type") == "FIXED SAVINGS"
    raw = s.withColumns({"product_name": F.when(fixed, "1 Month").otherwise("Open Savings"),
                         "product_description": F.when(fixed, "1 Month Fixed Account").otherwise("Current account")}).drop("account_type")
    both = W.prepare_current_savings(raw).unionByName(W.prepare_fixed_savings(raw))
    return both.groupBy("account_type").agg(F.count("*").alias("comptes"), F.count(F.when(F.col("balance") == 0, 1)).alias("soldes_nuls"))


def twice_loaded(df, file_count=2):
    """The same export loaded twice, the second time with newer values."""
    first = df.withColumns({"fichier_source": F.lit("a.csv"), "ordre_fichier_import": F.lit(0)})
    second = df.withColumns({"fichier_source": F.lit("b.csv"), "ordre_fichier_import": F.lit(1)})
    return first.unionByName(second)


@register("C30_prepared_sources", f"""
SELECT 'journal' AS source, count(*) AS lignes, {fsum('dr')} AS montant, count(DISTINCT msisdn1) AS telephones FROM v_journal
UNION ALL SELECT 'credits', count(*), {fsum('loan_balance')}, count(DISTINCT msisdn1) FROM v_loans
UNION ALL SELECT 'epargne', count(*), {fsum('balance')}, count(DISTINCT msisdn) FROM v_savings
UNION ALL SELECT 'clients', count(*), CAST(0 AS DOUBLE), count(*) FROM customer
UNION ALL SELECT 'central', count(*), CAST(0 AS DOUBLE), count(DISTINCT CASE WHEN client_id % 11 <> 0 AND NOT (client_id % 13 = 0 AND client_id % 7 <> 0) THEN CASE WHEN client_id % 7 = 0 THEN client_id ELSE client_id % 400 END END) FROM v_clients""",
          ("v_journal", "v_loans", "v_savings", "v_clients"))
def c30(spark, sf):
    from comptoir.functions.money import total
    jr = V.journal(spark, sf)
    raw = jr.select(*[(F.concat(F.lit("0"), F.substring("msisdn1", 4, 9)) if c == "msisdn1" else F.col(c).cast("string")).alias(c) if c != "created_at" else F.col(c) for c in jr.columns])
    parts = [
        (W.prepare_ledger(twice_loaded(raw)), "journal", total("dr"), "msisdn1"),
        (W.prepare_loans(twice_loaded(V.loans(spark, sf))), "credits", total("loan_balance"), "msisdn1"),
        (W.prepare_savings(twice_loaded(V.savings(spark, sf))), "epargne", total("balance"), "msisdn"),
        (W.prepare_customers(twice_loaded(people(spark, sf))), "clients", F.lit(0.0), "msisdn1"),
        (W.prepare_core_clients(core(spark, sf)), "central", F.lit(0.0), "phone_prefixe"),
    ]
    out = None
    for df, name, amount, phone in parts:
        line = df.agg(F.lit(name).alias("source"), F.count("*").alias("lignes"), amount.alias("montant"), F.count_distinct(phone).alias("telephones"))
        out = line if out is None else out.unionByName(line)
    return out


def people(spark, sf):
    key = F.col("c_custkey")
    created = F.date_add(F.lit("2024-01-01").cast("date"), (key % 30).cast("int")).cast("timestamp_ntz")
    return V.table(spark, sf, "customer").select(
        F.when(key % 3 != 0, key.cast("string")).alias("customer_id"), F.concat(F.lit("243"), (810000000 + key).cast("string")).alias("msisdn1"), created.alias("created_at"))


def core(spark, sf):
    return V.clients(spark, sf).select(F.col("client_id").cast("string").alias("id_client"), F.col("nom_client").alias("nom_complet"), F.col("telephone").alias("Phone_Prefixe"))


# --- joins ----------------------------------------------------------------------------------------------------

V.VIEW_SQL["v_link"] = f"""
WITH bid AS (SELECT savings_id, min(customer_id) AS dc, min(currency_code) AS du, min(msisdn) AS dp, count(*) AS dn FROM v_savings GROUP BY 1),
bk AS (SELECT customer_id, currency_code, count(*) AS cn, min(savings_id) AS ci, min(msisdn) AS cp FROM v_savings WHERE account_type = 'NORMAL SAVINGS' GROUP BY 1, 2),
j AS (SELECT l.*, dc, du, dp, dn, cn, ci, cp FROM v_loans l LEFT JOIN bid ON bid.savings_id = l.savings_account_id LEFT JOIN bk ON bk.customer_id = l.customer_id AND bk.currency_code = l.currency_code)
SELECT loan_id, customer_id, currency_code, CASE WHEN savings_account_id IS NOT NULL AND dn = 1 THEN savings_account_id WHEN savings_account_id IS NULL AND cn = 1 THEN ci END AS savings_id_correspondant,
  CASE WHEN savings_account_id IS NOT NULL AND dn = 1 THEN 'Identifiant direct' WHEN savings_account_id IS NULL AND cn = 1 THEN 'Client x devise' END AS methode_rapprochement,
  CASE WHEN savings_account_id IS NOT NULL AND (dn IS NULL OR dn > 1 OR dc <> customer_id OR du <> currency_code OR dp <> msisdn1) OR savings_account_id IS NULL AND (cn IS NULL OR cn > 1 OR cp <> msisdn1) THEN 'A revoir' ELSE 'Conforme' END AS statut_controle
FROM j
"""
V.VIEW_USES["v_link"] = ("v_loans", "v_savings")


@register("J11_loan_savings_link", "SELECT * FROM v_link", ("v_link",))
def j11(spark, sf):
    return P.link_loans(V.loans(spark, sf), V.savings(spark, sf)).select(
        "loan_id", "customer_id", "currency_code", "savings_id_correspondant", "methode_rapprochement", "statut_controle")


@register("J11_link_summary", f"""
WITH k AS (SELECT customer_id, currency_code, {dsum('loan_balance')} AS e FROM v_loans GROUP BY 1, 2),
o AS (SELECT customer_id, currency_code, {dsum('balance', "account_type = 'NORMAL SAVINGS'")} AS o, {dsum('balance', "account_type = 'FIXED SAVINGS' AND balance > 0")} AS d FROM v_savings GROUP BY 1, 2),
s AS (SELECT currency_code, {fsum('e')} AS encours_credit, {fsum('o')} AS compte_ouvert_clients, {fsum('d')} AS dat_clients FROM k LEFT JOIN o USING (customer_id, currency_code) GROUP BY 1)
SELECT currency_code, count(*) AS nombre_credits, count(savings_id_correspondant) AS rapproches, {cnt("statut_controle = 'A revoir'")} AS a_revoir, any_value(encours_credit) AS encours_credit,
  any_value(compte_ouvert_clients) AS compte_ouvert_clients, any_value(dat_clients) AS dat_clients, {div('count(savings_id_correspondant)', 'count(*)')} * 100 AS taux_rapprochement_pct FROM v_link JOIN s USING (currency_code) GROUP BY 1""", ("v_link",))
def j11b(spark, sf):
    loans, savings = V.loans(spark, sf), V.savings(spark, sf)
    return P.link_summary(P.link_loans(loans, savings), P.client_positions(loans, savings))


V.VIEW_SQL["v_positions"] = f"""
SELECT coalesce(l.customer_id, s.customer_id) AS customer_id, coalesce(l.currency_code, s.currency_code) AS currency_code, coalesce(nc, 0) AS nombre_credits, coalesce(no, 0) AS comptes_ouverts, coalesce(nd, 0) AS nombre_dat,
  CAST(coalesce(ma, 0) AS DOUBLE) AS montant_accorde, CAST(coalesce(e, 0) AS DOUBLE) AS encours_credit, CAST(coalesce(o, 0) AS DOUBLE) AS compte_ouvert, CAST(coalesce(d, 0) AS DOUBLE) AS dat_positif, CAST(coalesce(o, 0) + coalesce(d, 0) AS DOUBLE) AS epargne_totale
FROM (SELECT customer_id, currency_code, count(*) AS nc, {dsum('loan_amount')} AS ma, {dsum('loan_balance')} AS e FROM v_loans GROUP BY 1, 2) l
FULL JOIN (SELECT customer_id, currency_code, {cnt("account_type = 'NORMAL SAVINGS'")} AS no, {cnt("account_type = 'FIXED SAVINGS' AND balance > 0")} AS nd,
  {dsum('balance', "account_type = 'NORMAL SAVINGS'")} AS o, {dsum('balance', "account_type = 'FIXED SAVINGS' AND balance > 0")} AS d FROM v_savings GROUP BY 1, 2) s ON l.customer_id = s.customer_id AND l.currency_code = s.currency_code
"""
V.VIEW_USES["v_positions"] = ("v_loans", "v_savings")


@register("J12_client_positions", "SELECT * FROM v_positions", ("v_positions",))
def j12(spark, sf):
    return P.client_positions(V.loans(spark, sf), V.savings(spark, sf))


V.VIEW_SQL["v_presence"] = """
WITH jp AS (SELECT msisdn1 AS phone FROM v_journal UNION SELECT msisdn FROM v_savings UNION SELECT msisdn1 FROM v_loans), rp AS (SELECT DISTINCT phone FROM v_receipts),
ck AS (SELECT CASE WHEN client_id % 11 = 0 OR (client_id % 13 = 0 AND client_id % 7 <> 0) THEN NULL WHEN client_id % 7 = 0 THEN concat('243', CAST(810000000 + client_id AS VARCHAR)) ELSE concat('243', CAST(810000000 + client_id % 400 AS VARCHAR)) END AS phone, nom_client FROM v_clients),
cc AS (SELECT phone, count(*) AS n, string_agg(nom_client, ' | ' ORDER BY nom_client) AS noms FROM ck WHERE phone IS NOT NULL GROUP BY 1),
j AS (SELECT coalesce(jp.phone, rp.phone) AS phone, jp.phone IS NOT NULL AS present_journal, rp.phone IS NOT NULL AS present_recus FROM jp FULL JOIN rp ON jp.phone = rp.phone)
SELECT j.phone, present_journal, present_recus, coalesce(n, 0) > 0 AS present_central, present_journal AND present_recus AND coalesce(n, 0) > 0 AS present_partout, coalesce(n, 0) AS nb_clients_centraux, noms AS noms_clients_centraux,
  CASE coalesce(n, 0) WHEN 0 THEN 'Non trouve' WHEN 1 THEN 'Trouve' ELSE 'Trouve - plusieurs clients' END AS statut_central FROM j LEFT JOIN cc USING (phone)
"""
V.VIEW_USES["v_presence"] = ("v_journal", "v_savings", "v_loans", "v_receipts", "v_clients")


def presence(spark, sf):
    ledger = R.phones_of((V.journal(spark, sf), "msisdn1"), (V.savings(spark, sf), "msisdn"), (V.loans(spark, sf), "msisdn1"))
    return R.presence_crosscheck(ledger, R.phones_of((V.receipts(spark, sf), "phone")), W.prepare_core_clients(core(spark, sf)))


@register("J13_system_presence", "SELECT * FROM v_presence", ("v_presence",))
def j13(spark, sf):
    return presence(spark, sf).drop("statut_presence")


@register("J13_populations", f"""
SELECT 'recus et central' AS population, {cnt('present_recus AND present_central')} AS telephones, {big('coalesce(sum(nb_clients_centraux) FILTER (WHERE present_recus AND present_central), 0)')} AS clients FROM v_presence
UNION ALL SELECT 'journal et central', {cnt('present_journal AND present_central')}, {big('coalesce(sum(nb_clients_centraux) FILTER (WHERE present_journal AND present_central), 0)')} FROM v_presence
UNION ALL SELECT 'les trois', {cnt('present_partout')}, {big('coalesce(sum(nb_clients_centraux) FILTER (WHERE present_partout), 0)')} FROM v_presence""", ("v_presence",))
def j13b(spark, sf):
    return R.populations(presence(spark, sf))


@register("J14_name_enrichment", """
WITH p AS (SELECT phone, min(nom_client) AS n FROM v_receipts GROUP BY 1), r AS (SELECT receipt_no, min(nom_client) AS n FROM v_receipts GROUP BY 1)
SELECT id, coalesce(p.n, r.n) AS nom_client, CASE WHEN p.n IS NOT NULL THEN 'Telephone' WHEN r.n IS NOT NULL THEN 'Reference' ELSE 'Nom non rapproche' END AS mode_nom_client
FROM v_journal j LEFT JOIN p ON p.phone = j.msisdn1 LEFT JOIN r ON r.receipt_no = j.ref_no""", ("v_journal", "v_receipts"))
def j14(spark, sf):
    return R.enrich_names(V.journal(spark, sf), V.receipts(spark, sf)).select("id", "nom_client", "mode_nom_client")


PROXY_SQL = f"""
SELECT event_key AS receipt_no, customer_id, telephone AS phone, currency_code, CASE WHEN type_operation = '{W.DEPOSIT}' THEN '{R.TO_DEPOSIT}' WHEN type_operation = '{W.TERM_DEPOSIT}' THEN '{R.TO_TERM}' WHEN type_operation LIKE 'Remboursement%' THEN '{R.TO_LOAN}' ELSE '{R.PAYOUT}' END AS classe,
  CASE WHEN type_operation = '{W.WITHDRAWAL}' THEN 'Sortie' ELSE 'Entree' END AS sens_flux, montant_operation AS montant, created_at AS completion_time FROM v_events
WHERE type_operation IN ('{W.DEPOSIT}', '{W.TERM_DEPOSIT}', '{W.WITHDRAWAL}') OR type_operation LIKE 'Remboursement%'"""


@register("M7_ledger_proxy", PROXY_SQL, EVT)
def m7(spark, sf):
    return R.ledger_proxy(journal(spark, sf)).select("receipt_no", "customer_id", "phone", "currency_code", "classe", "sens_flux", "montant", "completion_time")


@register("J15_proxy_with_receipts", f"""
WITH p AS ({PROXY_SQL}), b AS (SELECT min(CAST(completion_time AS DATE)) AS a, max(CAST(completion_time AS DATE)) AS z FROM v_receipts)
SELECT p.receipt_no, r.nom_client AS nom_recu, r.statut AS statut_recu, CASE WHEN r.statut IS NOT NULL THEN 'Recu retrouve' WHEN CAST(p.completion_time AS DATE) BETWEEN (SELECT a FROM b) AND (SELECT z FROM b) THEN 'Recu absent' ELSE 'Periode non couverte' END AS couverture
FROM p LEFT JOIN v_receipts r ON concat('REF|', r.receipt_no) = p.receipt_no""", ("v_events", "v_receipts"))
def j15(spark, sf):
    return R.enrich_proxy(R.ledger_proxy(journal(spark, sf)), V.receipts(spark, sf)).select("receipt_no", "nom_recu", "statut_recu", "couverture")


def extract(spark, sf):
    """A summary extract of the positive term deposits in which some balances moved."""
    s = P.term_deposits(V.savings(spark, sf)).where("balance > 0")
    return s.withColumn("balance", F.when(F.col("customer_id") % 10 == 0, F.col("balance") + 1.0).otherwise(F.col("balance")))


@register("J16_master_reconciliation", f"""
WITH a AS (SELECT customer_id, currency_code, date_approved, maturity_date, round({m('balance')}, 2) AS solde, count(*) AS n FROM v_savings WHERE account_type = 'FIXED SAVINGS' AND balance > 0 GROUP BY ALL),
b AS (SELECT customer_id, currency_code, date_approved, maturity_date, round({m('CASE WHEN customer_id % 10 = 0 THEN balance + 1.0 ELSE balance END')}, 2) AS solde, count(*) AS n FROM v_savings WHERE account_type = 'FIXED SAVINGS' AND balance > 0 GROUP BY ALL)
SELECT coalesce(a.customer_id, b.customer_id) AS customer_id, CAST(coalesce(a.solde, b.solde) AS DOUBLE) AS solde, coalesce(a.n, 0) AS n_maitre, coalesce(b.n, 0) AS n_extrait,
  CASE WHEN coalesce(a.n, 0) = coalesce(b.n, 0) THEN 'Retrouve' WHEN b.n IS NULL THEN 'Absent de l''extrait' WHEN a.n IS NULL THEN 'Absent de la source maitre' ELSE 'Nombre different' END AS statut
FROM a FULL JOIN b ON a.customer_id = b.customer_id AND a.currency_code = b.currency_code AND a.date_approved = b.date_approved AND a.maturity_date = b.maturity_date AND a.solde = b.solde""", SAV)
def j16(spark, sf):
    out = P.reconcile_accounts(P.term_deposits(V.savings(spark, sf)), extract(spark, sf))
    return out.select("customer_id", F.col("solde").cast("double").alias("solde"), "n_maitre", "n_extrait", "statut")


def loans_paid_out(spark, sf):
    """Loans the journal shows as paid out, their amount taken as balance."""
    jr = journal(spark, sf).where("montant_decaisse > 0")
    return jr.select("customer_id", "currency_code", F.col("montant_decaisse").alias("loan_balance"))


@register("J17_deposit_without_loan", """
SELECT savings_id, s.customer_id, s.currency_code, balance FROM v_savings s WHERE account_type = 'FIXED SAVINGS' AND balance > 0
  AND NOT EXISTS (SELECT 1 FROM v_events l WHERE l.customer_id = s.customer_id AND l.currency_code = s.currency_code AND montant_decaisse > 0)""", ("v_savings", "v_events"))
def j17(spark, sf):
    return P.deposits_without_loan(V.savings(spark, sf), loans_paid_out(spark, sf)).select("savings_id", "customer_id", "currency_code", "balance")


@register("J17_strong_savings_without_loan", f"""
WITH h AS (SELECT customer_id, currency_code, {fsum('balance')} AS epargne FROM v_savings WHERE balance > 0 GROUP BY 1, 2), q AS (SELECT currency_code, quantile_cont(epargne, 0.9) AS seuil FROM h GROUP BY 1)
SELECT customer_id, currency_code, epargne FROM h JOIN q USING (currency_code) WHERE epargne >= seuil AND NOT EXISTS (SELECT 1 FROM v_events l WHERE l.customer_id = h.customer_id AND l.currency_code = h.currency_code AND montant_decaisse > 0)""", ("v_savings", "v_events"))
def j17b(spark, sf):
    return P.savings_without_loan(V.savings(spark, sf), loans_paid_out(spark, sf)).select("customer_id", "currency_code", "epargne")


def fixed_with_reference(spark, sf):
    """Term deposits of every second customer carry the reference the ledger uses."""
    s = P.term_deposits(V.savings(spark, sf))
    ref = F.when(F.col("customer_id") % 2 == 0, F.concat(F.lit("SA"), F.col("savings_id").cast("string")))
    return s.withColumns({"reference_dat": ref, "interest_earned": (5 + F.col("customer_id") % 7).cast("double")})


@register("J18_deposit_creation", """
WITH f AS (SELECT CASE WHEN customer_id % 2 = 0 THEN concat('SA', CAST(savings_id AS VARCHAR)) END AS r, customer_id, currency_code, CAST(date_approved AS TIMESTAMP) AS d FROM v_savings WHERE account_type = 'FIXED SAVINGS'),
e AS (SELECT r, min(d) AS d1 FROM f GROUP BY 1), b AS (SELECT reference_id AS r, min(created_at) AS d2 FROM v_journal WHERE account_type = 'FIXED SAVINGS' AND description = 'Depot Bloque' GROUP BY 1),
o AS (SELECT customer_id, currency_code, CASE WHEN count(*) = 1 THEN min(d) END AS d3 FROM f GROUP BY 1, 2)
SELECT x.event_key, coalesce(d1, d2, d3) AS date_creation_dat, x.created_at AS date_fin_dat, CASE WHEN d1 IS NOT NULL THEN 'Compte exact' WHEN d2 IS NOT NULL THEN 'Depot bloque de meme reference' WHEN d3 IS NOT NULL THEN 'DAT unique du client' ELSE 'Non determinee' END AS methode
FROM v_events x LEFT JOIN e ON e.r = x.reference_dat LEFT JOIN b ON b.r = x.reference_dat LEFT JOIN o ON o.customer_id = x.customer_id AND o.currency_code = x.currency_code WHERE type_operation LIKE 'Transfert%'""", ("v_events", "v_journal", "v_savings"))
def j18(spark, sf):
    out = W.term_deposit_creation(journal(spark, sf), fixed_with_reference(spark, sf), V.journal(spark, sf))
    return out.select("event_key", "date_creation_dat", "date_fin_dat", "methode")


@register("J19_loan_client_names", """
WITH n AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS nom FROM customer WHERE c_custkey % 4 <> 0 UNION SELECT DISTINCT CAST(user_id AS VARCHAR), concat('CLIENT ', CAST(user_id AS VARCHAR)) FROM events),
l AS (SELECT customer_id, string_agg(nom, ' | ' ORDER BY nom) AS nom_client FROM n GROUP BY 1)
SELECT loan_id, nom_client FROM v_loans LEFT JOIN l ON l.customer_id = CAST(v_loans.customer_id AS VARCHAR)""", LON)
def j19(spark, sf):
    customers = V.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("customer"))
    seen = V.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("customer_id"), F.concat(F.lit("CLIENT "), F.col("user_id").cast("string")).alias("nom_client"))
    names = W.names_by_customer((customers, ["customer"]), (seen, ["nom_client"]))
    loans = V.loans(spark, sf).withColumn("customer_id", F.col("customer_id").cast("string"))
    return W.ensure_name(loans, names).select("loan_id", "nom_client")


# --- windows --------------------------------------------------------------------------------------------------

@register("W1_cumulative_flow", f"""
SELECT event_key, customer_id, currency_code, CAST(sum({m('entree_portefeuille')} - {m('sortie_portefeuille')}) OVER (PARTITION BY currency_code ORDER BY created_at, event_key, customer_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cumul_net FROM v_events""", EVT)
def w1(spark, sf):
    return W.cumulative_flow(journal(spark, sf)).select("event_key", "customer_id", "currency_code", "cumul_net")


@register("W4_latest_version", "SELECT loan_id, loan_balance, 'a.csv | b.csv' AS fichiers_sources FROM v_loans", LON)
def w4(spark, sf):
    return W.prepare_loans(twice_loaded(V.loans(spark, sf).select("loan_id", "customer_id", "loan_balance"))).select(
        F.col("loan_id").cast("bigint").alias("loan_id"), "loan_balance", "fichiers_sources")


@register("W5_canonical_receipt", """
SELECT receipt_no, 'Completed' AS statut_normalise, completion_time + INTERVAL 1 HOUR AS completion_time, CAST(3 AS BIGINT) AS nombre_lignes_recu FROM v_receipts""", RCP)
def w5(spark, sf):
    r = R.classified(V.receipts(spark, sf).withColumn("statut", F.lit("Completed")))
    later = r.withColumns({"statut_normalise": F.lit("Pending"), "completion_time": F.col("completion_time") + F.expr("INTERVAL 5 HOURS")})
    again = r.withColumn("completion_time", F.col("completion_time") + F.expr("INTERVAL 1 HOUR"))
    return R.canonical_receipts(r.unionByName(later).unionByName(again)).select("receipt_no", "statut_normalise", "completion_time", "nombre_lignes_recu")


RANKED = f"""SELECT customer_id, currency_code, encours, row_number() OVER (PARTITION BY currency_code ORDER BY {m('encours')} DESC, customer_id) AS rang, {div(m('encours'), f"sum({m('encours')}) OVER (PARTITION BY currency_code)")} AS part,
  {div(f"sum({m('encours')}) OVER (PARTITION BY currency_code ORDER BY {m('encours')} DESC, customer_id ROWS UNBOUNDED PRECEDING)", f"sum({m('encours')}) OVER (PARTITION BY currency_code)")} AS part_cumulee
  FROM (SELECT customer_id, currency_code, {fsum('loan_balance')} AS encours FROM v_loans GROUP BY 1, 2)"""


def credit_by_client(spark, sf):
    from comptoir.functions.money import total
    return V.loans(spark, sf).groupBy("customer_id", "currency_code").agg(total("loan_balance").alias("encours"))


@register("W6_credit_concentration", RANKED, LON)
def w6(spark, sf):
    return P.concentration(credit_by_client(spark, sf))


@register("W6_concentration_summary", f"""
SELECT currency_code, count(*) AS nombre_clients, {', '.join(f"{fsum('part', f'rang <= {n}')} AS part_top_{n}" for n in (5, 10, 20))},
  CAST(sum(CAST(part * part AS DECIMAL(28,18))) AS DOUBLE) AS hhi FROM ({RANKED}) GROUP BY 1""", LON)
def w6b(spark, sf):
    return P.concentration_summary(P.concentration(credit_by_client(spark, sf)))


OPENINGS = "SELECT CAST(c_custkey AS BIGINT) AS customer_id, 'CDF' AS currency_code, c_acctbal AS ouverture FROM customer"
STATEMENT = f"""
SELECT e.customer_id, e.currency_code, event_key, row_number() OVER w AS rang, CAST(coalesce({m('ouverture')}, 0) + sum({m('entree_portefeuille')} - {m('sortie_portefeuille')}) OVER w AS DOUBLE) AS solde_apres,
  CAST(coalesce({m('ouverture')}, 0) + sum({m('montant_entree')} - {m('montant_sortie')}) OVER w AS DOUBLE) AS solde_institution, ouverture IS NOT NULL AS solde_reel
FROM v_events e LEFT JOIN ({OPENINGS}) o ON o.customer_id = e.customer_id AND o.currency_code = e.currency_code WHERE passe_par_portefeuille
WINDOW w AS (PARTITION BY e.customer_id, e.currency_code ORDER BY created_at, event_key ROWS UNBOUNDED PRECEDING)"""


def openings(spark, sf):
    return V.table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.lit("CDF").alias("currency_code"), F.col("c_acctbal").alias("ouverture"))


@register("W7_running_balance", STATEMENT, EVT)
def w7(spark, sf):
    return W.statement(journal(spark, sf), openings(spark, sf)).select("customer_id", "currency_code", "event_key", "rang", "solde_apres", "solde_institution", "solde_reel")


@register("W8_repeated_entries", f"""
WITH d AS (SELECT * FROM v_journal UNION ALL SELECT * REPLACE (id + 1000000000000 AS id, CASE WHEN id % 3 = 1 THEN bal_after + 1 ELSE bal_after END AS bal_after) FROM v_journal WHERE id % 3 < 2),
n AS (SELECT account_type, count(*) OVER (PARTITION BY customer_id, account_type, reference_id, currency_code, dr, cr, created_at) AS r,
  count(*) OVER (PARTITION BY customer_id, msisdn1, account_type, description, currency_code, dr, cr, bal_before, bal_after, reference_id, ref_no, created_at) AS e FROM d)
SELECT account_type, count(*) AS lignes, {cnt('r > 1')} AS repetees, {cnt('e > 1')} AS exactes, max(r) AS repetitions, max(e) AS copies FROM n GROUP BY 1""", JRN)
def w8(spark, sf):
    """The whole ledger, two thirds of it loaded again, half of that with another balance."""
    ledger, third = V.journal(spark, sf), F.col("id") % 3
    again = ledger.where(third < 2).withColumns({"id": F.col("id") + F.lit(10 ** 12), "bal_after": F.when(third == 1, F.col("bal_after") + 1).otherwise(F.col("bal_after"))})
    found = W.with_repetitions(ledger.unionByName(again))
    return found.groupBy("account_type").agg(F.count("*").alias("lignes"), F.count(F.when(F.col("ecritures_repetees") > 1, 1)).alias("repetees"), F.count(F.when(F.col("doublons_exacts") > 1, 1)).alias("exactes"),
                                             F.max("ecritures_repetees").alias("repetitions"), F.max("doublons_exacts").alias("copies"))


@register("W9_baseline_comparison", f"""
WITH a AS (SELECT customer_id, currency_code, {dsum('montant_operation', "created_at >= TIMESTAMP '2024-01-22'")} AS a, {dsum('montant_operation', "created_at < TIMESTAMP '2024-01-22'")} AS b, {cnt("created_at >= TIMESTAMP '2024-01-22'")} AS operations
  FROM v_events WHERE created_at < TIMESTAMP '2024-01-29' GROUP BY 1, 2)
SELECT customer_id, currency_code, operations, CAST(a AS DOUBLE) AS volume_courant, CAST(b AS DOUBLE) / 90 AS moyenne_reference, (CAST(a AS DOUBLE) / 7) / nullif(CAST(b AS DOUBLE) / 90, 0) AS multiple,
  CASE WHEN b = 0 THEN 'Sans historique' WHEN CAST(a AS DOUBLE) / 7 >= CAST(b AS DOUBLE) / 90 * 3 THEN 'Inhabituel' ELSE 'Habituel' END AS lecture FROM a WHERE operations > 0""", EVT)
def w9(spark, sf):
    return T.unusual_against_baseline(journal(spark, sf), END)


NET = f"({dsum('depot_epargne')} + {dsum('depot_dat')} + {dsum('retour_dat')} - {dsum('retrait_epargne')} - {dsum('remboursement_compte_ouvert')})"


@register("W10_top_net_flows", f"""
SELECT * EXCLUDE (f), CAST(f AS DOUBLE) AS flux_net_epargne FROM (SELECT *, CAST(row_number() OVER (PARTITION BY currency_code ORDER BY f DESC, customer_id) AS INT) AS rang
  FROM (SELECT customer_id, currency_code, count(*) AS nombre_operations, {NET} AS f FROM v_events GROUP BY 1, 2)) WHERE rang <= 15""", EVT)
def w10(spark, sf):
    return P.top_flows(P.client_activity(journal(spark, sf)))


# --- customer analyses ----------------------------------------------------------------------------------------

@register("M2_statement_summary", f"""
SELECT customer_id, currency_code, {fsum('sortie_portefeuille')} AS total_entrees, {fsum('entree_portefeuille')} AS total_sorties, CAST({dsum('sortie_portefeuille')} - {dsum('entree_portefeuille')} AS DOUBLE) AS mouvement_net,
  count(*) AS nombre_operations FROM v_events WHERE passe_par_portefeuille GROUP BY 1, 2""", EVT)
def m2(spark, sf):
    return W.statement_summary(journal(spark, sf))


@register("M3_credit_summary", f"""
SELECT customer_id, currency_code, {cnt(f"type_operation = '{W.DISBURSEMENT}'")} AS nombre_decaissements, {fsum('montant_decaisse')} AS montant_decaisse, CAST(0 AS DOUBLE) AS dette_creee, CAST(0 AS DOUBLE) AS interet_observe,
  {cnt("type_operation LIKE 'Remboursement%'")} AS nombre_remboursements, CAST(0 AS DOUBLE) AS principal_rembourse, CAST({dsum('remboursement_portefeuille')} + {dsum('remboursement_compte_ouvert')} AS DOUBLE) AS montant_paye,
  {cnt(f"type_operation = '{W.PENALTY_REPAYMENT}'")} AS remboursements_avec_penalite, {fsum('penalite_observee')} AS penalite_observee
FROM v_events WHERE type_operation = '{W.DISBURSEMENT}' OR type_operation LIKE 'Remboursement%' GROUP BY 1, 2""", EVT)
def m3(spark, sf):
    return W.credit_summary(journal(spark, sf))


@register("M3_positions", f"""
WITH l AS (SELECT customer_id, currency_code, CASE account_type WHEN 'NORMAL SAVINGS' THEN 'Epargne courante' WHEN 'FIXED SAVINGS' THEN 'DAT' WHEN 'PRINCIPLE' THEN 'Credit' END AS famille_position, arg_max(bal_after, [epoch_us(created_at), id]) AS solde_observe, max(created_at) AS derniere_ecriture
  FROM v_journal WHERE account_type IN ('NORMAL SAVINGS', 'FIXED SAVINGS', 'PRINCIPLE') GROUP BY 1, 2, 3),
s AS (SELECT customer_id, currency_code, CASE account_type WHEN 'NORMAL SAVINGS' THEN 'Epargne courante' ELSE 'DAT' END AS famille_position, {fsum('balance')} AS solde_instantane FROM v_savings GROUP BY 1, 2, 3
  UNION ALL SELECT customer_id, currency_code, 'Credit', {fsum('loan_balance')} FROM v_loans GROUP BY 1, 2)
SELECT l.*, solde_instantane, CASE WHEN solde_instantane IS NULL THEN 'Non comparable' WHEN abs({m('solde_observe')} - {m('solde_instantane')}) <= CAST(0.01 AS {M}) THEN 'Conforme' ELSE 'Ecart' END AS statut_rapprochement
FROM l LEFT JOIN s USING (customer_id, currency_code, famille_position)""", ("v_journal", "v_savings", "v_loans"))
def m3b(spark, sf):
    return W.positions(V.journal(spark, sf), W.snapshot_positions(V.savings(spark, sf), V.loans(spark, sf)))


INTEREST_SQL = f"""
SELECT savings_id, f.customer_id, f.currency_code, maturity_date, CAST(cap AS DOUBLE) AS capital_place, CAST(5 + f.customer_id % 7 AS DOUBLE) AS interet_client, CAST(cap + CAST(5 + f.customer_id % 7 AS {M}) AS DOUBLE) AS montant_echeance, de AS date_ecriture,
  CASE WHEN de IS NULL THEN 'Sans ecriture' ELSE 'Ecriture retrouvee' END AS statut_tracabilite
FROM (SELECT *, CASE WHEN customer_id % 2 = 0 THEN concat('SA', CAST(savings_id AS VARCHAR)) END AS r FROM v_savings WHERE account_type = 'FIXED SAVINGS' AND maturity_date <= {D} AND balance <= 0) f
LEFT JOIN (SELECT reference_id, {dsum('cr')} AS cap FROM v_journal WHERE account_type = 'FIXED SAVINGS' AND description = 'Depot Bloque' GROUP BY 1) b ON b.reference_id = f.r
LEFT JOIN (SELECT reference_id, max(created_at) AS de FROM v_journal WHERE account_type = 'FIXED SAVINGS' AND description = 'Retrait Compte Bloque' GROUP BY 1) x ON x.reference_id = f.r"""


@register("M4_statement_elements", f"""
WITH r AS (SELECT customer_id, currency_code, CASE WHEN type_operation LIKE 'Remboursement%' THEN CASE WHEN remboursement_compte_ouvert > 0 THEN 'Remboursement d''un credit depuis le compte ouvert' ELSE 'Remboursement d''un credit depuis le portefeuille' END
    WHEN type_operation = '{W.DEPOSIT}' THEN 'Depot normal' WHEN type_operation = '{W.TERM_DEPOSIT}' THEN 'Dépôt à terme (DAT)' WHEN type_operation = '{W.WITHDRAWAL}' THEN 'Retrait' WHEN type_operation = '{W.RELEASE}' THEN 'Retour du capital mis en DAT' END AS type_element, montant_operation AS v FROM v_events
  UNION ALL SELECT customer_id, currency_code, 'Entree des interets du capital mis en DAT', interet_client FROM ({INTEREST_SQL}))
SELECT customer_id, currency_code, type_element, count(*) AS nombre, {fsum('v')} AS montant FROM r WHERE type_element IS NOT NULL GROUP BY 1, 2, 3""", ("v_events", "v_savings", "v_journal"))
def m4(spark, sf):
    interests = W.matured_interest(fixed_with_reference(spark, sf), V.journal(spark, sf), DAY)
    return W.statement_elements(journal(spark, sf), interests)


@register("M4_loan_split", f"""
SELECT user_id AS customer_id, CASE WHEN event_id % 2 = 0 THEN 'CDF' ELSE 'USD' END AS currency_code, value AS pret_brut, CAST({m('value * CAST(0.0625 AS DOUBLE)')} AS DOUBLE) AS interet_preleve,
  {div(m('value * CAST(0.0625 AS DOUBLE)'), m('value'))} * 100 AS taux_observe_pct, CAST({m('value')} - {m('value * CAST(0.0625 AS DOUBLE)')} AS DOUBLE) AS net_verse FROM events WHERE event_type = 'error' AND event_id % 3 = 0 AND value > 0""")
def m4b(spark, sf):
    ledger = V.journal(spark, sf)
    paid = ledger.where((F.col("description") == "Montant pret") & (F.col("account_type") == W.WALLET))
    kept = paid.withColumns({"id": F.col("id") + F.lit(10 ** 12), "dr": F.col("cr") * 0.0625, "cr": F.lit(0.0), "description": F.lit("Compte du M-Pesa")})
    return W.loan_split(W.events(ledger.unionByName(kept))).select("customer_id", "currency_code", "pret_brut", "interet_preleve", "taux_observe_pct", "net_verse")


@register("M5_matured_interest", INTEREST_SQL, ("v_savings", "v_journal"))
def m5(spark, sf):
    return W.matured_interest(fixed_with_reference(spark, sf), V.journal(spark, sf), DAY)


def index(spark, sf):
    clients = V.clients(spark, sf).select(F.col("client_id").cast("string").alias("customer_id"), F.col("telephone"), "nom_client")
    return W.search_index({"journal": V.journal(spark, sf).withColumn("customer_id", F.col("customer_id").cast("string")), "clients": clients,
                           "recus": V.receipts(spark, sf).select("phone", "nom_client")})


@register("M6_customer_search", """
SELECT CAST(customer_id AS VARCHAR) AS customer_id, msisdn1 AS telephone, CAST(NULL AS VARCHAR) AS nom_client, 'journal' AS source FROM v_journal WHERE customer_id = 12 GROUP BY ALL
UNION ALL SELECT CAST(client_id AS VARCHAR), telephone, nom_client, 'clients' FROM v_clients WHERE client_id = 12 OR nom_client LIKE '%12%' OR CASE WHEN client_id % 7 = 0 THEN client_id ELSE client_id % 400 END = 12 AND telephone IS NOT NULL AND telephone <> '243 81'
UNION ALL SELECT NULL, phone, nom_client, 'recus' FROM v_receipts WHERE phone = '243810000012' OR nom_client LIKE '%12%' GROUP BY ALL""", ("v_journal", "v_clients", "v_receipts"))
def m6(spark, sf):
    found = index(spark, sf)
    return W.search(found, "12").unionByName(W.search(found, "0810000012")).unionByName(W.search(found, "Client 12")).distinct()


INDEX = """SELECT DISTINCT CAST(customer_id AS VARCHAR) AS customer_id, msisdn1 AS t, CAST(NULL AS VARCHAR) AS n, 'journal' AS s FROM v_journal
  UNION SELECT CAST(client_id AS VARCHAR), nullif(trim(telephone), ''), nom_client, 'clients' FROM v_clients UNION SELECT NULL, nullif(trim(phone), ''), nullif(trim(nom_client), ''), 'recus' FROM v_receipts"""
CANDIDATES = f"""SELECT DISTINCT coalesce(customer_id, 'tel ' || t, 'nom ' || lower(n)) AS candidat, customer_id, unnest(['nom', 'telephone', 'source']) AS champ, unnest([n, t, s]) AS valeur FROM ({INDEX})"""
INDEXED = ("v_journal", "v_clients", "v_receipts")


@register("A52_candidate_values", f"""SELECT *, row_number() OVER (PARTITION BY candidat, champ ORDER BY valeur) AS rang FROM ({CANDIDATES}) WHERE valeur IS NOT NULL""", INDEXED)
def a52_rows(spark, sf):
    return W.candidate_values(index(spark, sf))


@register("A52_search_candidates", f"""
SELECT candidat, customer_id, string_agg(valeur, ' | ' ORDER BY valeur) FILTER (champ = 'nom') AS noms, string_agg(valeur, ' | ' ORDER BY valeur) FILTER (champ = 'telephone') AS telephones,
  string_agg(valeur, ' | ' ORDER BY valeur) FILTER (champ = 'source') AS sources FROM ({CANDIDATES}) WHERE valeur IS NOT NULL GROUP BY 1, 2""", INDEXED)
def a52(spark, sf):
    return W.candidate_lists(W.candidate_values(index(spark, sf)))


# --- receipts: syntheses --------------------------------------------------------------------------------------

@register("M8_count_summary", f"""
SELECT currency_code, {cnt(f"classe = '{R.TO_TERM}'")} AS nombre_dat, {cnt(f"classe = '{R.TO_DEPOSIT}'")} AS nombre_depot_normal, {cnt(f"classe = '{R.TO_LOAN}'")} AS nombre_remboursement, count(*) AS nombre_total
FROM v_match WHERE sens_flux = 'Entree' GROUP BY 1""", MTC)
def m8a(spark, sf):
    return R.count_summary(matched(spark, sf).where("sens_flux = 'Entree'"))


CELLS = ", ".join(f"""{cnt(f"classe = '{c}'")} AS "nombre {c}", {fsum('montant', f"classe = '{c}'")} AS "montant {c}" """ for c in (*R.ENTRY_CLASSES, *R.OUTPUT_CLASSES))


@register("M8_flow_pivot", f"""
SELECT currency_code, {CELLS}, {cnt("sens_flux = 'Entree'")} AS nombre_entrees, {cnt("sens_flux = 'Sortie'")} AS nombre_sorties, {fsum('montant', "sens_flux = 'Entree'")} AS montant_total_entrees,
  {fsum('montant', "sens_flux = 'Sortie'")} AS montant_total_sorties, CAST({dsum('montant', "sens_flux = 'Entree'")} - {dsum('montant', "sens_flux = 'Sortie'")} AS DOUBLE) AS solde_net FROM v_match WHERE incluse GROUP BY 1""", MTC)
def m8b(spark, sf):
    return R.flow_pivot(matched(spark, sf))


@register("M8_daily_synthesis", f"""
SELECT CAST(completion_time AS DATE) AS jour, currency_code, sens_flux, classe, count(*) AS nombre, {fsum('montant')} AS montant FROM v_match WHERE incluse GROUP BY 1, 2, 3, 4""", MTC)
def m8c(spark, sf):
    return R.daily_synthesis(matched(spark, sf))


def dat_like(spark, sf):
    """Term deposits booked by the ledger itself: one per blocked deposit."""
    jr = V.journal(spark, sf).where("account_type = 'FIXED SAVINGS' AND description = 'Depot Bloque'")
    return jr.select(F.col("id").alias("savings_id"), F.col("msisdn1").alias("msisdn"), "currency_code", F.col("cr").alias("balance"))


@register("M9_deposit_crosscheck", f"""
WITH d AS (SELECT msisdn1 AS phone, currency_code, {m('cr')} AS v, count(*) AS n, min(id) AS i FROM v_journal WHERE account_type = 'FIXED SAVINGS' AND description = 'Depot Bloque' GROUP BY 1, 2, 3)
SELECT receipt_no, r.phone, r.currency_code, montant, n AS nombre_dat, CASE WHEN n = 1 THEN i END AS savings_id FROM v_receipts r JOIN d ON d.phone = r.phone AND d.currency_code = r.currency_code AND d.v = {m('montant')} WHERE sens_flux = 'Entree'""", ("v_receipts", "v_journal"))
def m9(spark, sf):
    return R.term_deposit_crosscheck(V.receipts(spark, sf), dat_like(spark, sf))


def included(spark, sf):
    return R.with_inclusion(R.classified(V.receipts(spark, sf)))


RI = "(SELECT *, statut = 'Completed' AS incluse FROM v_receipts)"


def _time_sql(cols, extra=""):
    days = "(SELECT unnest(generate_series((SELECT min(CAST(completion_time AS DATE)) FROM r), (SELECT max(CAST(completion_time AS DATE)) FROM r), INTERVAL 1 DAY)))"
    parts = {"jour": f"(SELECT CAST(unnest(generate_series((SELECT min(jour) FROM r), (SELECT max(jour) FROM r), INTERVAL 1 DAY)) AS DATE) AS jour)",
             "heure": "(SELECT CAST(unnest(range(24)) AS INT) AS heure)", "jour_num": "(SELECT CAST(unnest(range(7)) AS INT) AS jour_num)"}
    del days
    scaffold = " CROSS JOIN ".join(["(SELECT DISTINCT currency_code, sens_flux FROM r)"] + [parts[c] for c in cols])
    keys = ", ".join(["currency_code", "sens_flux", *cols])
    return f"""WITH r AS (SELECT currency_code, sens_flux, CAST(completion_time AS DATE) AS jour, CAST(hour(completion_time) AS INT) AS heure, CAST(isodow(completion_time) - 1 AS INT) AS jour_num FROM v_receipts WHERE statut = 'Completed'),
n AS (SELECT {keys}, count(*) AS n FROM r GROUP BY ALL) SELECT {keys}{extra}, coalesce(n, 0) AS nombre_transactions FROM {scaffold} LEFT JOIN n USING ({keys})"""


@register("M10_by_day", _time_sql(["jour"]), RCP)
def m10a(spark, sf):
    return R.time_analysis(included(spark, sf), "jour")


@register("M10_by_weekday", _time_sql(["jour_num"], ", ['Lundi','Mardi','Mercredi','Jeudi','Vendredi','Samedi','Dimanche'][jour_num + 1] AS jour_semaine"), RCP)
def m10b(spark, sf):
    return R.time_analysis(included(spark, sf), "jour_semaine")


@register("M10_by_hour", _time_sql(["heure"]), RCP)
def m10c(spark, sf):
    return R.time_analysis(included(spark, sf), "heure")


@register("M10_by_day_and_hour", _time_sql(["jour", "heure"]), RCP)
def m10d(spark, sf):
    return R.time_analysis(included(spark, sf), "jour_heure")


@register("M11_retention", f"""
WITH d AS (SELECT DISTINCT o_custkey AS phone, CASE WHEN o_custkey % 2 = 0 THEN 'CDF' ELSE 'USD' END AS currency_code, CAST(o_orderdate AS DATE) AS jour FROM orders WHERE o_orderstatus <> 'P'),
mo AS (SELECT phone, currency_code, CAST(date_trunc('month', jour) AS DATE) AS mois, min(jour) AS premier, max(jour) AS dernier FROM d GROUP BY 1, 2, 3), l AS (SELECT max(jour) AS z FROM d),
c AS (SELECT a.currency_code, a.mois, a.phone, bool_or(b.mois IS NOT NULL AND b.mois = a.mois + INTERVAL 1 MONTH) AS m1, bool_or(b.premier IS NOT NULL AND date_diff('day', a.dernier, b.premier) <= 90) AS j90
  FROM mo a LEFT JOIN mo b ON a.phone = b.phone AND a.currency_code = b.currency_code AND b.mois > a.mois AND b.mois <= a.mois + INTERVAL 3 MONTH GROUP BY 1, 2, 3)
SELECT strftime(mois, '%Y-%m') AS mois, currency_code, count(*) AS clients_actifs, (SELECT z FROM l) >= last_day(CAST(mois + INTERVAL 1 MONTH AS DATE)) AS eligible_m1, (SELECT z FROM l) >= last_day(mois) + 90 AS eligible_90j,
  CASE WHEN (SELECT z FROM l) >= last_day(CAST(mois + INTERVAL 1 MONTH AS DATE)) THEN {div(cnt('m1'), 'count(*)')} * 100 END AS retention_m1_pct, CASE WHEN (SELECT z FROM l) >= last_day(mois) + 90 THEN {div(cnt('j90'), 'count(*)')} * 100 END AS retention_90j_pct
FROM c GROUP BY c.mois, currency_code""")
def m11(spark, sf):
    # The given receipts span one month; the orders span years, so they carry the retention check.
    o = V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("phone"), F.when(F.col("o_custkey") % 2 == 0, "CDF").otherwise("USD").alias("currency_code"), F.col("o_orderdate").alias("completion_time"),
        (F.col("o_orderstatus") != "P").alias("incluse"), F.lit(R.TO_DEPOSIT).alias("classe"))
    return R.retention(o)


ANOMALY_SQL = """nullif(concat_ws('; ', CASE WHEN statut_normalise <> 'Completed' THEN 'Statut non termine' END,
  CASE WHEN statut_rapprochement = 'Non rapproche' THEN 'Reference absente du journal' END,
  CASE WHEN statut_rapprochement NOT LIKE 'Non applicable%' AND controle_telephone = 'Ecart' THEN 'Ecart de telephone' END, CASE WHEN statut_rapprochement NOT LIKE 'Non applicable%' AND controle_devise = 'Ecart' THEN 'Ecart de devise' END,
  CASE WHEN statut_rapprochement NOT LIKE 'Non applicable%' AND controle_montant = 'Ecart' THEN 'Ecart de montant' END, CASE WHEN statut_rapprochement NOT LIKE 'Non applicable%' AND controle_date = 'Ecart de date' THEN 'Ecart de date de creation' END,
  CASE WHEN statut_rapprochement NOT LIKE 'Non applicable%' AND candidats_sortie > 1 THEN 'Plusieurs candidats' END, CASE WHEN classe IN ('Autre entree', 'Autre sortie', 'Flux a verifier') THEN 'Operation non classee' END), '')"""


@register("D6_receipt_anomalies", f"SELECT * FROM (SELECT receipt_no, {ANOMALY_SQL} AS motif_anomalie FROM v_match) WHERE motif_anomalie IS NOT NULL", MTC)
def d6(spark, sf):
    return R.receipt_anomalies(matched(spark, sf)).select("receipt_no", "motif_anomalie")


@register("M27_reconciliation_quality", f"""
WITH q AS (SELECT CASE WHEN classe = '{R.INTERNAL}' THEN NULL WHEN sens_flux = 'Entree' THEN 'Entrées et remboursements' WHEN classe = '{R.LOAN_REQUEST}' THEN 'Versements de prêts' WHEN classe = '{R.PAYOUT}' THEN 'Sorties B2C' END AS circuit, currency_code, count(*) AS o,
  {cnt("statut_normalise = 'Completed'")} AS t, {cnt("statut_normalise = 'Completed' AND statut_rapprochement IN ('Rapproche exact', 'Rapproche avec ecart')")} AS h FROM v_match GROUP BY 1, 2)
SELECT circuit, currency_code, o AS operations_observees, t AS operations_terminees, CASE WHEN circuit = 'Versements de prêts' THEN 0 ELSE h END AS operations_rapprochees, CASE WHEN circuit = 'Versements de prêts' THEN 0 ELSE t - h END AS operations_non_rapprochees,
  CASE WHEN circuit <> 'Versements de prêts' THEN {div('h', 't')} * 100 END AS taux_rapprochement_pct FROM q WHERE circuit IS NOT NULL""", MTC)
def m27(spark, sf):
    return R.reconciliation_quality(matched(spark, sf))


@register("M27_status_counts", "SELECT currency_code, statut AS statut_normalise, count(*) AS nombre_operations FROM v_receipts GROUP BY 1, 2", RCP)
def m27b(spark, sf):
    return R.status_counts(V.receipts(spark, sf))


# --- positions ------------------------------------------------------------------------------------------------

BAND_SQL = """CASE WHEN {d} IS NULL THEN 'Non renseignee' WHEN {d} < 0 THEN 'Echu' WHEN {d} = 0 THEN 'Aujourd''hui' WHEN {d} <= 7 THEN '0 a 7 jours' WHEN {d} <= 30 THEN '8 a 30 jours' WHEN {d} <= 60 THEN '31 a 60 jours'
  WHEN {d} <= 90 THEN '61 a 90 jours' ELSE 'Plus de 90 jours' END"""
V.VIEW_SQL["v_maturity"] = f"""
SELECT savings_id, customer_id, currency_code, balance, CAST(maturity_date - date_approved AS INT) AS duree_contractuelle_jours, CAST(maturity_date - {D} AS INT) AS jours_avant_echeance, {BAND_SQL.format(d=f'(maturity_date - {D})')} AS tranche_echeance,
  maturity_date - {D} <= 30 AS a_preparer, balance * CAST(0.11 AS DOUBLE) * (maturity_date - date_approved) / CAST(365 AS DOUBLE) AS interet_estime, maturity_date
FROM v_savings WHERE account_type = 'FIXED SAVINGS' AND balance > 0
"""
V.VIEW_USES["v_maturity"] = SAV
MAT = ("v_maturity",)


@register("M13_deposit_maturity", "SELECT * EXCLUDE (maturity_date), balance + interet_estime AS capital_plus_interet FROM v_maturity", MAT)
def m13(spark, sf):
    return P.deposit_maturity(V.savings(spark, sf), DAY).drop("date_approved", "maturity_date", "taux_annuel_pct")


@register("M13_maturity_summary", """
SELECT currency_code, tranche_echeance, count(*) AS nombre_dat, count(DISTINCT customer_id) AS nombre_clients, CAST(coalesce(sum(CAST(balance AS DECIMAL(20,6))), 0) AS DOUBLE) AS capital FROM v_maturity GROUP BY 1, 2""", MAT)
def m13b(spark, sf):
    return P.maturity_summary(P.deposit_maturity(V.savings(spark, sf), DAY)).drop("interet_estime")


@register("M30_deposit_schedule", f"""
SELECT maturity_date, currency_code, count(*) AS nombre_dat, {fsum('balance')} AS capital FROM v_maturity WHERE jours_avant_echeance BETWEEN 0 AND 30 GROUP BY 1, 2""", MAT)
def m30(spark, sf):
    return P.deposit_schedule(P.deposit_maturity(V.savings(spark, sf), DAY), 30).select("maturity_date", "currency_code", "nombre_dat", "capital")


@register("M14_large_depositors", f"""
WITH h AS (SELECT customer_id, currency_code, count(*) AS nb_comptes_dat, {dsum('balance')} AS s, {fsum('balance', f'maturity_date - {D} BETWEEN 0 AND 30')} AS solde_echeance_30j, {fsum('balance', f'maturity_date < {D}')} AS solde_dat_echu
  FROM v_savings WHERE account_type = 'FIXED SAVINGS' AND balance > 0 GROUP BY 1, 2), q AS (SELECT currency_code, quantile_cont(CAST(s AS DOUBLE), 0.9) AS t FROM h GROUP BY 1)
SELECT customer_id, currency_code, nb_comptes_dat, CAST(s AS DOUBLE) AS solde_dat_total, solde_echeance_30j, solde_dat_echu, row_number() OVER (PARTITION BY currency_code ORDER BY s DESC, customer_id) AS rang_devise, CAST(s AS DOUBLE) >= t AS est_fort_dat FROM h JOIN q USING (currency_code)""", SAV)
def m14(spark, sf):
    return P.large_depositors(V.savings(spark, sf), DAY)


@register("M14_depositor_portfolio", f"""
SELECT currency_code, count(*) AS nb_comptes, count(DISTINCT customer_id) AS nb_clients, {fsum('balance')} AS total_dat, {fsum('balance', f'maturity_date - {D} BETWEEN 0 AND 30')} AS solde_echeance_30j, {fsum('balance', f'maturity_date < {D}')} AS solde_dat_echu
FROM v_savings WHERE account_type = 'FIXED SAVINGS' AND balance > 0 GROUP BY 1""", SAV)
def m14b(spark, sf):
    return P.depositor_portfolio(V.savings(spark, sf), DAY)


MONTHLY = P.RATES["credit_lender"] + P.RATES["credit_partner"]
V.VIEW_SQL["v_risk"] = f"""
WITH l AS (SELECT customer_id, currency_code, {dsum('loan_balance')} AS e, max(CASE WHEN loan_balance > 0 THEN greatest({D} - due_date, 0) END) AS retard,
  {fsum(f"loan_amount * CAST({MONTHLY / 100!r} AS DOUBLE) * greatest((due_date - CAST(created_at AS DATE)) / CAST(30.4375 AS DOUBLE), CAST(0 AS DOUBLE))", 'loan_balance > 0')} AS interet FROM v_loans WHERE created_at IS NULL OR created_at < TIMESTAMP '{DAY}' + INTERVAL 1 DAY GROUP BY 1, 2),
s AS (SELECT customer_id, currency_code, {dsum('balance', "account_type = 'NORMAL SAVINGS'")} AS o, {dsum('balance', "account_type = 'FIXED SAVINGS'")} AS d, max(CASE WHEN account_type = 'FIXED SAVINGS' AND balance > 0 THEN maturity_date - date_approved END) AS duree,
  min(CASE WHEN account_type = 'FIXED SAVINGS' AND balance > 0 AND maturity_date >= {D} THEN maturity_date - {D} END) AS proche,
  {fsum(f"balance * CAST({P.RATES['dat_client'] / 100!r} AS DOUBLE) * (maturity_date - date_approved) / 365", "account_type = 'FIXED SAVINGS' AND balance > 0")} AS cout FROM v_savings GROUP BY 1, 2),
b AS (SELECT coalesce(l.customer_id, s.customer_id) AS customer_id, coalesce(l.currency_code, s.currency_code) AS currency_code, CAST(coalesce(e, 0) AS DOUBLE) AS encours_credit, CAST(coalesce(o, 0) AS DOUBLE) AS compte_ouvert, CAST(coalesce(d, 0) AS DOUBLE) AS encours_dat,
  CAST(coalesce(o, 0) + coalesce(d, 0) AS DOUBLE) AS epargne_totale, CAST(coalesce(retard, 0) AS INT) AS retard_max_jours, CAST(duree AS INT) AS duree_dat_max_jours, CAST(proche AS INT) AS prochaine_echeance_jours,
  coalesce(interet, CAST(0 AS DOUBLE)) * CAST({P.RATES['credit_lender'] / MONTHLY!r} AS DOUBLE) - coalesce(cout, CAST(0 AS DOUBLE)) AS marge_estimee
  FROM l FULL JOIN s ON l.customer_id = s.customer_id AND l.currency_code = s.currency_code)
SELECT *, epargne_totale / nullif(encours_credit, 0) * 100 AS couverture_epargne_pct, encours_dat / nullif(encours_credit, 0) * 100 AS couverture_dat_pct, encours_credit / nullif(epargne_totale, 0) * 100 AS taux_credit_epargne_pct,
  encours_credit / nullif(encours_dat, 0) * 100 AS taux_credit_dat_pct, greatest(encours_credit - epargne_totale, CAST(0 AS DOUBLE)) AS exposition_nette, greatest(encours_credit - encours_dat, CAST(0 AS DOUBLE)) AS exposition_nette_dat,
  CASE WHEN encours_credit > 0 AND retard_max_jours >= 30 THEN 'credit_retard_30j_plus' WHEN encours_credit > 0 AND epargne_totale = 0 THEN 'credit_sans_epargne_observee' WHEN encours_credit > 0 AND encours_dat > 0 THEN 'credit_avec_dat'
       WHEN encours_credit > 0 THEN 'credit_avec_epargne' WHEN encours_dat > 0 THEN 'dat_sans_credit' WHEN epargne_totale > 0 THEN 'epargne_sans_credit' ELSE 'sans_position' END AS segment_observe
FROM b
"""
V.VIEW_USES["v_risk"] = ("v_loans", "v_savings")
RSK = ("v_risk",)
RISK_COLUMNS = ("customer_id", "currency_code", "encours_credit", "compte_ouvert", "encours_dat", "epargne_totale", "retard_max_jours", "duree_dat_max_jours", "prochaine_echeance_jours",
                "couverture_epargne_pct", "couverture_dat_pct", "taux_credit_epargne_pct", "taux_credit_dat_pct", "exposition_nette", "exposition_nette_dat", "segment_observe")


def risk(spark, sf):
    return P.risk_clients(V.loans(spark, sf), V.savings(spark, sf), DAY)


@register("M12_risk_clients", f"SELECT {', '.join(RISK_COLUMNS)} FROM v_risk", RSK)
def m12(spark, sf):
    return risk(spark, sf).select(*RISK_COLUMNS)


@register("M12_risk_summary", f"""
SELECT currency_code, {fsum('encours_credit')} AS encours_credit, {fsum('epargne_totale')} AS epargne_totale, {fsum('encours_dat')} AS encours_dat, {fsum('exposition_nette')} AS exposition_nette, {fsum('encours_credit', 'retard_max_jours >= 30')} AS encours_retard_30j,
  {cnt('encours_credit > 0')} AS clients_credit, {div(dsum('epargne_totale'), dsum('encours_credit'))} * 100 AS couverture_epargne_pct, {div(dsum('encours_dat'), dsum('encours_credit'))} * 100 AS couverture_dat_pct,
  {div(dsum('encours_credit'), dsum('epargne_totale'))} * 100 AS taux_credit_epargne_pct, {div(dsum('encours_credit'), dsum('encours_dat'))} * 100 AS taux_credit_dat_pct FROM v_risk GROUP BY 1""", RSK)
def m12b(spark, sf):
    return P.risk_summary(risk(spark, sf)).drop("interet_credit", "cout_dat", "marge_estimee")


@register("M12_liquidity_gap", "\nUNION ALL\n".join(f"""
SELECT currency_code, {h} AS horizon_jours, CAST(i AS DOUBLE) AS entrees_credit, CAST(o AS DOUBLE) AS sorties_dat, CAST(i - o AS DOUBLE) AS gap_liquidite, i < o AS gap_negatif
FROM (SELECT currency_code, {dsum('loan_balance', f'due_date - {D} BETWEEN 0 AND {h}')} AS i FROM v_loans GROUP BY 1) FULL JOIN (SELECT currency_code, {dsum('balance', f"account_type = 'FIXED SAVINGS' AND balance > 0 AND maturity_date - {D} BETWEEN 0 AND {h}")} AS o FROM v_savings GROUP BY 1) USING (currency_code)""" for h in (7, 30, 90)), ("v_loans", "v_savings"))
def m12c(spark, sf):
    return P.liquidity_gap(V.loans(spark, sf), V.savings(spark, sf), DAY)


ALERTS = [("credit_sans_epargne", "encours_credit > 0 AND epargne_totale = 0"), ("credit_superieur_epargne", "encours_credit > 0 AND encours_credit > epargne_totale"), ("credit_superieur_dat", "encours_credit > 0 AND encours_credit > encours_dat"),
          ("couverture_insuffisante", "encours_credit > 0 AND coalesce(couverture_epargne_pct, 0) < 100"), ("couverture_dat_insuffisante", "encours_credit > 0 AND coalesce(couverture_dat_pct, 0) < 100"),
          ("retard_credit", "encours_credit > 0 AND retard_max_jours > 0"), ("dat_echeance_proche", "prochaine_echeance_jours <= 30"), ("dat_sans_credit", "encours_dat > 0 AND NOT encours_credit > 0"), ("marge_negative", "marge_estimee < 0")]
ALERT_SQL = "\nUNION ALL\n".join(f"SELECT customer_id, currency_code, '{a}' AS alerte, encours_credit, epargne_totale, encours_dat FROM v_risk WHERE {w}" for a, w in ALERTS)


@register("D7_risk_alerts", ALERT_SQL, RSK)
def d7(spark, sf):
    return P.risk_alerts(risk(spark, sf))


@register("D7_alert_summary", f"SELECT currency_code, alerte, count(*) AS dossiers, {fsum('encours_credit')} AS montant FROM ({ALERT_SQL}) GROUP BY 1, 2", RSK)
def d7b(spark, sf):
    return P.alert_summary(P.risk_alerts(risk(spark, sf)))


V.VIEW_SQL["v_credit_detail"] = f"""
SELECT loan_id, customer_id, currency_code, loan_amount, loan_balance AS encours, created_at, CAST(greatest({D} - due_date, 0) AS INT) AS jours_retard,
  CASE WHEN due_date IS NULL THEN 'Echeance_non_renseignee' WHEN {D} - due_date >= 180 THEN 'PAR180' WHEN {D} - due_date >= 90 THEN 'PAR90' WHEN {D} - due_date >= 30 THEN 'PAR30' WHEN {D} - due_date >= 7 THEN 'PAR7' WHEN {D} - due_date >= 1 THEN 'PAR1' ELSE 'Sain' END AS niveau_risque,
  {BAND_SQL.format(d=f'(due_date - {D})')} AS tranche_echeance, due_date FROM v_loans WHERE loan_balance > 0
"""
V.VIEW_USES["v_credit_detail"] = LON
CRD = ("v_credit_detail",)


def credit(spark, sf):
    return P.credit_detail(V.loans(spark, sf), DAY)


@register("M22_credit_detail", "SELECT loan_id, encours, CASE WHEN niveau_risque = 'Echeance_non_renseignee' THEN 0 ELSE jours_retard END AS jours_retard, niveau_risque, tranche_echeance FROM v_credit_detail", CRD)
def m22a(spark, sf):
    return credit(spark, sf).select("loan_id", "encours", F.coalesce("jours_retard", F.lit(0)).alias("jours_retard"), "niveau_risque", "tranche_echeance")


PARS = ", ".join(f"{fsum('encours', f'jours_retard >= {n}')} AS encours_par_{n}, {cnt(f'jours_retard >= {n}')} AS credits_par_{n}, {div(dsum('encours', f'jours_retard >= {n}'), dsum('encours'))} * 100 AS par_{n}_pct" for n in P.PAR_DAYS)


@register("M22_simplified_par", f"SELECT currency_code, count(*) AS nombre_credits, count(DISTINCT customer_id) AS nombre_clients, {fsum('encours')} AS encours_total, {PARS} FROM v_credit_detail GROUP BY 1", CRD)
def m22b(spark, sf):
    return P.credit_risk(credit(spark, sf))


@register("M22_risk_levels", f"SELECT currency_code, niveau_risque, count(DISTINCT loan_id) AS nombre_credits, {fsum('encours')} AS encours_total FROM v_credit_detail GROUP BY 1, 2", CRD)
def m22c(spark, sf):
    return P.credit_levels(credit(spark, sf))


@register("M22_maturities", f"SELECT currency_code, tranche_echeance, count(*) AS nombre_credits, {fsum('encours')} AS encours_credit FROM v_credit_detail GROUP BY 1, 2", CRD)
def m22d(spark, sf):
    return P.credit_maturities(credit(spark, sf))


@register("M22_cohorts", f"""
SELECT strftime(created_at, '%Y-%m') AS cohorte, currency_code, count(*) AS nombre_credits, {fsum('loan_amount')} AS montant_initial, {fsum('loan_balance')} AS encours, {fsum('loan_balance', f'{D} - due_date >= 30')} AS encours_par_30 FROM v_loans GROUP BY 1, 2""", LON)
def m22e(spark, sf):
    return P.credit_cohorts(V.loans(spark, sf), DAY)


@register("M22_portfolio", f"""
SELECT currency_code, count(*) AS nombre_credits, count(DISTINCT customer_id) AS emprunteurs, {fsum('loan_amount')} AS montant_accorde, {fsum('loan_balance')} AS encours_credit, {cnt('loan_id % 50 = 0')} AS prets_defaut, {cnt('loan_id % 30 = 0')} AS prets_renouveles, CAST(0 AS BIGINT) AS prets_en_grace FROM v_loans GROUP BY 1""", LON)
def m22f(spark, sf):
    loans = V.loans(spark, sf).withColumns({"defaulted": F.col("loan_id") % 50 == 0, "is_rollover": F.col("loan_id") % 30 == 0})
    return P.credit_portfolio(loans)


@register("M22_action_lists", f"""
WITH q AS (SELECT currency_code, quantile_cont(encours, 0.9) AS t FROM v_credit_detail GROUP BY 1)
SELECT * FROM (SELECT loan_id, nullif(concat_ws('; ', CASE WHEN tranche_echeance = 'Echu' THEN 'Echu avec encours' END, CASE WHEN jours_retard >= 30 THEN 'PAR simplifie 30 jours' END, CASE WHEN encours >= t THEN 'Forte exposition' END,
  CASE WHEN tranche_echeance IN ('Aujourd''hui', '0 a 7 jours', '8 a 30 jours') THEN 'Echeance sous 30 jours' END), '') AS listes_action FROM v_credit_detail JOIN q USING (currency_code)) WHERE listes_action IS NOT NULL""", CRD)
def m22g(spark, sf):
    return P.credit_actions(credit(spark, sf)).select("loan_id", "listes_action")


@register("M21_savings_portfolio", f"""
SELECT currency_code, CASE account_type WHEN 'FIXED SAVINGS' THEN 'DAT' ELSE 'Compte ouvert' END AS famille_epargne, count(DISTINCT savings_id) AS nombre_comptes, count(DISTINCT customer_id) AS nombre_clients, {cnt('balance = 0')} AS comptes_solde_nul, {fsum('balance')} AS encours_actuel FROM v_savings GROUP BY 1, 2""", SAV)
def m21a(spark, sf):
    return P.savings_portfolio(V.savings(spark, sf))


@register("M21_savings_flows", f"""
SELECT currency_code, {fsum('depot_epargne')} AS depots_compte_ouvert, {fsum('depot_dat')} AS depots_dat, {fsum('retour_dat')} AS retours_dat, {fsum('retrait_epargne')} AS retraits, {fsum('remboursement_compte_ouvert')} AS remboursements_compte_ouvert,
  CAST({NET} AS DOUBLE) AS flux_net_epargne FROM v_events GROUP BY 1""", EVT)
def m21b(spark, sf):
    return P.savings_flows(journal(spark, sf))


V.VIEW_SQL["v_activity"] = """
SELECT savings_id, s.customer_id, s.currency_code, balance, CASE account_type WHEN 'FIXED SAVINGS' THEN 'DAT' ELSE 'Compte ouvert' END AS famille_epargne,
  CASE WHEN date_diff('day', CAST(d AS DATE), DATE '2024-02-15') <= 30 THEN 'actif' WHEN date_diff('day', CAST(d AS DATE), DATE '2024-02-15') <= 90 THEN 'a_surveille' ELSE 'historique_insuffisant' END AS statut_activite
FROM v_savings s LEFT JOIN (SELECT customer_id, currency_code, max(created_at) AS d FROM v_events GROUP BY 1, 2) e ON e.customer_id = s.customer_id AND e.currency_code = s.currency_code
"""
V.VIEW_USES["v_activity"] = ("v_savings", "v_events")


@register("M21_savings_activity", "SELECT savings_id, famille_epargne, statut_activite FROM v_activity", ("v_activity",))
def m21c(spark, sf):
    return P.savings_activity(V.savings(spark, sf), journal(spark, sf), dt.date(2024, 2, 15)).select("savings_id", "famille_epargne", "statut_activite")


@register("A50_activity_summary", f"""
SELECT currency_code, famille_epargne, statut_activite, count(DISTINCT savings_id) AS nombre_comptes, count(DISTINCT customer_id) AS nombre_clients, {fsum('balance')} AS encours_actuel FROM v_activity GROUP BY 1, 2, 3""", ("v_activity",))
def a50(spark, sf):
    return P.activity_summary(P.savings_activity(V.savings(spark, sf), journal(spark, sf), dt.date(2024, 2, 15)))


@register("M21_amount_bands", f"""
SELECT currency_code, CASE WHEN currency_code = 'CDF' THEN CASE WHEN epargne < 500000 THEN 'Moins de 500 000' WHEN epargne < 1000000 THEN '500 000 a 999 999' WHEN epargne < 5000000 THEN '1 000 000 a 4 999 999' ELSE '5 000 000 et plus' END
  ELSE CASE WHEN epargne < 100 THEN 'Moins de 100' WHEN epargne < 500 THEN '100 a 499,99' WHEN epargne < 1000 THEN '500 a 999,99' ELSE '1 000 et plus' END END AS tranche_encours, count(*) AS nombre_clients, {fsum('epargne')} AS encours_total
FROM (SELECT customer_id, currency_code, {fsum('balance')} AS epargne FROM v_savings GROUP BY 1, 2) GROUP BY 1, 2""", SAV)
def m21d(spark, sf):
    from comptoir.functions.money import total
    held = V.savings(spark, sf).groupBy("customer_id", "currency_code").agg(total("balance").alias("epargne"))
    return P.band_summary(held, "epargne")


@register("A49_priorities", f"""
SELECT 'Credits en retard 30 jours et plus' AS priorite, currency_code, count(*) AS dossiers, {fsum('encours')} AS montant FROM v_credit_detail WHERE jours_retard >= 30 AND due_date IS NOT NULL GROUP BY 2
UNION ALL SELECT 'DAT echus ou a echeance sous 30 jours', currency_code, count(*), {fsum('balance')} FROM v_maturity WHERE jours_avant_echeance <= 30 GROUP BY 2""", ("v_credit_detail", "v_maturity"))
def a49(spark, sf):
    return P.priorities(V.loans(spark, sf), V.savings(spark, sf), DAY)


V.VIEW_SQL["v_client_report"] = """
WITH mv AS (SELECT customer_id, count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-29') AS n, max(created_at) AS d FROM v_events GROUP BY 1),
hd AS (SELECT customer_id, count(*) FILTER (WHERE account_type = 'NORMAL SAVINGS') AS o, count(*) FILTER (WHERE account_type = 'FIXED SAVINGS' AND balance > 0) AS f FROM v_savings GROUP BY 1),
cr AS (SELECT customer_id, count(*) FILTER (WHERE loan_balance > 0) AS c FROM v_loans GROUP BY 1),
j AS (SELECT c_custkey, DATE '2024-01-01' + CAST(c_custkey % 30 AS INT) AS cree, coalesce(n, 0) AS n, d, coalesce(o, 0) AS o, coalesce(f, 0) AS f, coalesce(c, 0) AS c FROM customer LEFT JOIN mv ON mv.customer_id = c_custkey LEFT JOIN hd ON hd.customer_id = c_custkey LEFT JOIN cr ON cr.customer_id = c_custkey),
k AS (SELECT *, cree >= DATE '2024-01-08' AND cree <= DATE '2024-01-28' AS nv, n > 0 AS ac, CAST(o > 0 AS INT) + CAST(f > 0 AS INT) + CAST(c > 0 AS INT) AS p FROM j)
SELECT CAST(c_custkey AS VARCHAR) AS client_key, true AS present_referentiel, nv AS nouveau_client, ac AS actif_periode, n AS nombre_operations, o AS comptes_ouverts, f AS dat_positifs, c AS credits_actifs,
  coalesce(nullif(concat_ws('_', CASE WHEN o > 0 THEN 'epargne' END, CASE WHEN f > 0 THEN 'dat' END, CASE WHEN c > 0 THEN 'credit' END), ''), 'sans_produit_observe') AS segment_produit,
  CASE WHEN nv AND ac THEN 'nouveau_actif' WHEN nv THEN 'nouveau_non_active' WHEN ac AND p >= 2 THEN 'multi_produits' WHEN ac AND n <= 2 THEN 'occasionnel' WHEN ac THEN 'actif' WHEN date_diff('day', CAST(d AS DATE), DATE '2024-01-28') > 90 THEN 'inactif_observe' ELSE 'sans_mouvement' END AS segment_client
FROM k
"""
V.VIEW_USES["v_client_report"] = ("v_events", "v_savings", "v_loans")


def client_report(spark, sf):
    return P.report_of_clients(people(spark, sf), journal(spark, sf), V.savings(spark, sf), V.loans(spark, sf), START, END)


@register("M20_client_report", "SELECT * FROM v_client_report", ("v_client_report",))
def m20(spark, sf):
    return client_report(spark, sf)


@register("M20_client_indicators", f"""
SELECT {cnt('present_referentiel')} AS clients_referentiel, count(*) AS clients_connus, {cnt('actif_periode')} AS clients_actifs, {cnt('nouveau_client')} AS nouveaux_clients, {cnt('nouveau_client AND actif_periode')} AS nouveaux_clients_actifs, {cnt('NOT actif_periode')} AS clients_sans_mouvement,
  {div(cnt('actif_periode'), cnt('present_referentiel'))} AS taux_clients_actifs, {div(cnt('nouveau_client AND actif_periode'), cnt('nouveau_client'))} AS taux_activation FROM v_client_report""", ("v_client_report",))
def m20b(spark, sf):
    return P.client_indicators(client_report(spark, sf))


@register("M20_family_balances", f"""
SELECT * FROM (SELECT customer_id, currency_code, CASE account_type WHEN 'FIXED SAVINGS' THEN 'dat' ELSE 'compte_ouvert' END AS famille_encours, {fsum('balance')} AS encours FROM v_savings GROUP BY 1, 2, 3
UNION ALL SELECT customer_id, currency_code, 'credit', {fsum('loan_balance')} FROM v_loans GROUP BY 1, 2) WHERE encours > 0""", ("v_savings", "v_loans"))
def m20c(spark, sf):
    return P.family_balances(V.savings(spark, sf), V.loans(spark, sf))


# --- periods --------------------------------------------------------------------------------------------------

FLOW_SQL = ", ".join(f"{fsum(c)} AS {n}" for n, c in T.FLOWS.items())


@register("M15_flow_summary", f"SELECT currency_code, count(*) AS nombre_operations, count(DISTINCT customer_id) AS nombre_clients, {FLOW_SQL}, {fsum('montant_operation')} AS volume FROM v_events WHERE {PERIOD} GROUP BY 1", EVT)
def m15a(spark, sf):
    return T.flow_summary(journal(spark, sf), START, END)


@register("M15_weekly_evolution", f"SELECT currency_code, CAST(date_trunc('week', created_at) AS DATE) AS periode, count(*) AS nombre_operations, count(DISTINCT customer_id) AS nombre_clients, {FLOW_SQL}, {fsum('montant_operation')} AS volume FROM v_events WHERE {PERIOD} GROUP BY 1, 2", EVT)
def m15b(spark, sf):
    return T.flow_summary(journal(spark, sf), START, END, "W")


@register("M15_repayments", f"""
SELECT currency_code, origine_remboursement, count(*) AS nombre_remboursements, CAST({dsum('remboursement_portefeuille')} + {dsum('remboursement_compte_ouvert')} AS DOUBLE) AS montant_rembourse, CAST(0 AS DOUBLE) AS principal, {fsum('penalite_observee')} AS penalite, CAST(0 AS BIGINT) AS a_verifier
FROM v_events WHERE {PERIOD} AND type_operation LIKE 'Remboursement%' GROUP BY 1, 2""", EVT)
def m15c(spark, sf):
    return T.repayment_summary(journal(spark, sf), START, END)


def recent_loans(spark, sf):
    """Loan accounts that mirror the loans paid out in the journal, some with another amount."""
    lines = V.journal(spark, sf).where("account_type = 'PRINCIPLE'")
    off = F.when(F.col("currency_code") == "USD", F.col("dr") + 1.0).otherwise(F.col("dr"))
    return lines.select(F.col("id").alias("loan_id"), "customer_id", "currency_code", "msisdn1", off.alias("loan_amount"), off.alias("loan_balance"), "created_at",
                        F.date_add(F.to_date("created_at"), 20).alias("due_date"))


RECENT = "(SELECT customer_id, currency_code, CASE WHEN currency_code = 'USD' THEN montant_operation + 1.0 ELSE montant_operation END AS loan_amount, created_at FROM v_events WHERE type_operation = 'Decaissement de credit')"


@register("M15_new_credits", f"""
WITH a AS (SELECT currency_code, count(*) AS n, {dsum('montant_decaisse')} AS a FROM v_events WHERE {PERIOD} AND type_operation = 'Decaissement de credit' GROUP BY 1), b AS (SELECT currency_code, count(*) AS k, {dsum('loan_amount')} AS b FROM {RECENT} WHERE {PERIOD} GROUP BY 1)
SELECT currency_code, n AS nombre_decaissements, k AS nombre_comptes, CAST(a AS DOUBLE) AS montant_decaisse, CAST(b AS DOUBLE) AS montant_initial_comptes, CAST(a - b AS DOUBLE) AS ecart, CASE WHEN abs(a - b) <= CAST(0.01 AS {M}) THEN 'Conforme' ELSE 'Ecart' END AS statut_rapprochement FROM a FULL JOIN b USING (currency_code)""", EVT)
def m15d(spark, sf):
    return T.new_credits(journal(spark, sf), recent_loans(spark, sf), START, END)


SCALED = {"CDF": {"fractionnement": 60.0, "important": 90.0}, "USD": {"fractionnement": 50.0, "important": 80.0}}


@register("M16_transaction_alerts", "\nUNION ALL\n".join(f"""
SELECT customer_id, currency_code, CAST(created_at AS DATE) AS jour, 'Transaction importante' AS alerte, count(*) AS operations, {fsum('montant_operation')} AS montant FROM v_events WHERE {PERIOD} AND currency_code = '{c}' AND montant_operation >= {t['important']} GROUP BY 1, 2, 3
UNION ALL SELECT customer_id, currency_code, CAST(created_at AS DATE), 'Fractionnement potentiel', count(*), {fsum('montant_operation')} FROM v_events WHERE {PERIOD} AND currency_code = '{c}' AND montant_operation < {t['fractionnement']} GROUP BY 1, 2, 3
  HAVING count(*) >= 2 AND {dsum('montant_operation')} >= {t['fractionnement']}""" for c, t in SCALED.items()), EVT)
def m16a(spark, sf):
    return T.transaction_alerts(journal(spark, sf), START, END, SCALED)


@register("M16_inactive_movements", f"""
SELECT customer_id, currency_code, count(*) AS operations, {fsum('montant_operation')} AS montant FROM v_events e WHERE {PERIOD} AND EXISTS (SELECT 1 FROM (SELECT customer_id, currency_code FROM v_savings GROUP BY 1, 2 HAVING {dsum('balance')} <= 0) s WHERE s.customer_id = e.customer_id AND s.currency_code = e.currency_code)
GROUP BY 1, 2""", ("v_events", "v_savings"))
def m16b(spark, sf):
    return T.inactive_movements(journal(spark, sf), V.savings(spark, sf), START, END)


@register("M16_frequent_deposits", f"""
SELECT customer_id, currency_code, CAST(date_trunc('week', created_at) AS DATE) AS semaine, count(DISTINCT event_key) AS nombre_depots, {fsum('depot_epargne')} AS montant FROM v_events WHERE {PERIOD} AND depot_epargne > 0 GROUP BY 1, 2, 3 HAVING count(DISTINCT event_key) >= 3""", EVT)
def m16c(spark, sf):
    return T.deposit_frequency(journal(spark, sf), START, END)


@register("M16_sources", """
SELECT 'Journal' AS source, count(*) AS lignes, true AS intervient_dans_les_montants FROM v_journal UNION ALL SELECT 'Recus', count(*), false FROM v_receipts UNION ALL SELECT 'Credits', count(*), true FROM v_loans""", ("v_journal", "v_receipts", "v_loans"))
def m16d(spark, sf):
    return T.management_sources({"Journal": V.journal(spark, sf), "Recus": V.receipts(spark, sf), "Credits": V.loans(spark, sf)}, ["Journal", "Credits"])


LAST = "arg_max(bal_after, [epoch_us(created_at), id]) FILTER (WHERE account_type = '{a}')"


@register("M17_client_balance", f"""
SELECT customer_id, currency_code, count(*) AS nombre_lignes, {big("count(DISTINCT CASE WHEN ref_no IS NOT NULL THEN ref_no ELSE CAST(created_at AS VARCHAR) END)")} AS nombre_operations, {fsum('dr')} AS total_debit, {fsum('cr')} AS total_credit,
  {fsum('cr', "account_type = 'NORMAL SAVINGS' AND description = 'Epargne depot'")} AS depots_epargne, {fsum('dr', "account_type = 'NORMAL SAVINGS' AND description = 'Retrait Vers M-Pesa'")} AS retraits_epargne,
  {LAST.format(a='NORMAL SAVINGS')} AS solde_epargne_courante, {LAST.format(a='FIXED SAVINGS')} AS solde_dat, {LAST.format(a='PRINCIPLE')} AS encours_principal FROM v_journal GROUP BY 1, 2""", JRN)
def m17a(spark, sf):
    return T.client_balance(V.journal(spark, sf))


ACCOUNT_SQL = f"""SELECT currency_code, account_type, count(*) AS nombre_lignes, count(DISTINCT customer_id) AS nombre_clients, {fsum('dr')} AS total_debit, {fsum('cr')} AS total_credit, CAST({dsum('dr')} - {dsum('cr')} AS DOUBLE) AS solde_mouvement FROM v_journal"""


@register("M17_account_balance", f"{ACCOUNT_SQL} GROUP BY 1, 2", JRN)
def m17b(spark, sf):
    return T.account_balance(V.journal(spark, sf))


@register("M17_symmetry", f"""
SELECT currency_code, {big('sum(nombre_lignes)')} AS ecritures, count(DISTINCT customer_id) AS clients, count(*) AS operations, {fsum('montant_operation')} AS total_debit, {fsum('montant_operation')} AS total_credit, {cnt('operation_symetrique')} AS operations_symetriques,
  {div(cnt('operation_symetrique'), 'count(*)')} * 100 AS taux_symetrie_pct FROM v_events GROUP BY 1""", EVT)
def m17c(spark, sf):
    return T.symmetry_summary(journal(spark, sf))


@register("M17_balance_variation", f"""
SELECT currency_code, count(*) AS ecritures, {cnt(f"abs(abs({m('bal_after')} - {m('bal_before')}) - (abs({m('dr')}) + abs({m('cr')}))) <= CAST(0.01 AS {M})")} AS variations_conformes,
  {div(cnt(f"abs(abs({m('bal_after')} - {m('bal_before')}) - (abs({m('dr')}) + abs({m('cr')}))) <= CAST(0.01 AS {M})"), 'count(*)')} * 100 AS taux_conforme_pct FROM v_journal GROUP BY 1""", JRN)
def m17d(spark, sf):
    return T.balance_variation(V.journal(spark, sf))


@register("M17_financial_products", f"SELECT currency_code, account_type, count(*) AS nombre_ecritures, {fsum('cr')} AS montant_observe FROM v_journal WHERE account_type LIKE '%PENALTY%' OR account_type = 'INTEREST EARNED' GROUP BY 1, 2", JRN)
def m17e(spark, sf):
    return T.financial_products(V.journal(spark, sf))


@register("M17_receipt_match_rate", f"""
SELECT currency_code, count(*) AS recus_termines, {cnt('hit')} AS recus_retrouves, {div(cnt('hit'), 'count(*)')} * 100 AS taux_pct FROM (SELECT currency_code, receipt_no IN (SELECT ref_no FROM v_journal WHERE ref_no IS NOT NULL) AS hit FROM v_receipts WHERE statut = 'Completed') GROUP BY 1""", ("v_receipts", "v_journal"))
def m17f(spark, sf):
    return T.receipt_match_rate(V.journal(spark, sf), V.receipts(spark, sf))


@register("M18_filtered_balance", f"{ACCOUNT_SQL} WHERE (customer_id, currency_code) IN (SELECT customer_id, currency_code FROM v_savings GROUP BY 1, 2 HAVING {dsum('balance')} > 5000) GROUP BY 1, 2", ("v_journal", "v_savings"))
def m18(spark, sf):
    from comptoir.functions.money import exact_sum
    scope = V.savings(spark, sf).groupBy("customer_id", "currency_code").agg(exact_sum("balance").alias("s")).where("s > 5000")
    return T.filtered_balance(V.journal(spark, sf), scope)


TRACK_DAYS = [START + dt.timedelta(days=i) for i in range(7)]
TRACK_END = TRACK_DAYS[-1]


@register("M19_tracking_pivot", f"""
WITH r AS (SELECT customer_id, currency_code, CASE WHEN description = 'Epargne depot' THEN 'Depot' ELSE 'Retrait' END AS operation, CAST(created_at AS DATE) AS j, CASE WHEN description = 'Epargne depot' THEN cr ELSE dr END AS v, coalesce(ref_no, CAST(created_at AS VARCHAR)) AS e
  FROM v_journal WHERE account_type = 'NORMAL SAVINGS' AND description IN ('Epargne depot', 'Retrait Vers M-Pesa') AND created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{TRACK_END + dt.timedelta(days=1)}'),
h AS (SELECT customer_id, currency_code, {fsum('balance')} AS b FROM v_savings GROUP BY 1, 2), n AS (SELECT customer_id, currency_code, CAST({dsum('v', "operation = 'Depot'")} - {dsum('v', "operation = 'Retrait'")} AS DOUBLE) AS net FROM r GROUP BY 1, 2)
SELECT r.customer_id, r.currency_code, operation, {', '.join(f'''{fsum('v', f"j = DATE '{d}'")} AS "{d.strftime('%d/%m/%Y')}"''' for d in TRACK_DAYS)}, {fsum('v')} AS total, {div('count(DISTINCT e)', '7')} AS score, any_value(coalesce(b, net)) AS solde
FROM r JOIN n USING (customer_id, currency_code) LEFT JOIN h USING (customer_id, currency_code) GROUP BY 1, 2, 3""", ("v_journal", "v_savings"))
def m19(spark, sf):
    return T.tracking_pivot(V.journal(spark, sf), START, TRACK_END, V.savings(spark, sf))


@register("A51_daily_wallet_flows", f"SELECT CAST(created_at AS DATE) AS jour, currency_code, {fsum('entree_portefeuille')} AS entrees, {fsum('sortie_portefeuille')} AS sorties FROM v_events WHERE passe_par_portefeuille GROUP BY 1, 2", EVT)
def a51a(spark, sf):
    return T.wallet_flows(journal(spark, sf))


@register("A51_operations_per_type", "SELECT type_operation, count(*) AS nombre FROM v_events GROUP BY 1", EVT)
def a51b(spark, sf):
    return T.operations_per_type(journal(spark, sf))


WINDOW = T.comparison_windows(dt.date(2024, 1, 28))


def _between(col, a, b):
    return f"{col} >= TIMESTAMP '{a}' AND {col} < TIMESTAMP '{b + dt.timedelta(days=1)}'"


@register("M23_comparison_windows", f"""
SELECT 'courante' AS fenetre, count(*) AS operations, min(CAST(created_at AS DATE)) AS premier, max(CAST(created_at AS DATE)) AS dernier FROM v_events WHERE created_at >= TIMESTAMP '2024-01-22' AND created_at < TIMESTAMP '2024-01-29'
UNION ALL SELECT 'precedente', count(*), min(CAST(created_at AS DATE)), max(CAST(created_at AS DATE)) FROM v_events WHERE created_at >= TIMESTAMP '2024-01-15' AND created_at < TIMESTAMP '2024-01-22'""", EVT)
def m23(spark, sf):
    jr = journal(spark, sf)
    out = None
    for name in ("courante", "precedente"):
        part = jr.where(W.in_period(jr, WINDOW[f"debut_{name}"], WINDOW[f"fin_{name}"])).agg(
            F.lit(name).alias("fenetre"), F.count("*").alias("operations"), F.min(F.to_date("created_at")).alias("premier"), F.max(F.to_date("created_at")).alias("dernier"))
        out = part if out is None else out.unionByName(part)
    return out


FIX = "account_type = 'FIXED SAVINGS'"
NEWSAV = "(SELECT *, CAST(DATE '2024-01-01' + CAST(customer_id % 30 AS INT) AS TIMESTAMP) AS created_at FROM v_savings)"


def comparison_sql(windows, loans, savings, balance="loan_amount"):
    """The thirteen indicators in both windows; the sources have a ``created_at``."""
    now, before = (_between("created_at", windows[f"debut_{w}"], windows[f"fin_{w}"]) for w in ("courante", "precedente"))

    def pair(key, cur, a, b, source):
        group = "GROUP BY currency_code" if cur == "currency_code" else ""
        return f"SELECT '{key}' AS indicateur, {cur} AS currency_code, CAST({a} AS DOUBLE) AS valeur_courante, CAST({b} AS DOUBLE) AS valeur_precedente FROM {source} WHERE ({now}) OR ({before}) {group}"

    def counted(key, source, where="true"):
        return pair(key, "''", cnt(f"({now}) AND {where}"), cnt(f"({before}) AND {where}"), source)

    def added(key, source, value, where="true"):
        return pair(key, "currency_code", dsum(value, f"({now}) AND {where}"), dsum(value, f"({before}) AND {where}"), source)

    return "\nUNION ALL\n".join([
        pair("clients_actifs", "''", f"count(DISTINCT CASE WHEN {now} THEN customer_id END)", f"count(DISTINCT CASE WHEN {before} THEN customer_id END)", "v_events"),
        counted("operations", "v_events"), added("volume_transactions", "v_events", "montant_operation"),
        added("remboursements", "v_events", "(remboursement_portefeuille + remboursement_compte_ouvert)"), added("depots_dat", "v_events", "depot_dat"),
        added("produits_observes", "v_events", "(interet_observe + penalite_observee)"), counted("nouveaux_credits", loans),
        added("montant_nouveaux_credits", loans, "loan_amount"), added("encours_credits_crees", loans, balance),
        counted("nouveaux_comptes_ouverts", savings, f"NOT {FIX}"), counted("nouveaux_dat", savings, FIX),
        added("encours_epargne_ouverte_creee", savings, "balance", f"NOT {FIX}"), added("encours_dat_cree", savings, "balance", FIX)])


COMPARISON = comparison_sql(WINDOW, RECENT, NEWSAV)


def new_savings(spark, sf):
    created = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("customer_id") % 30).cast("int"))
    return V.savings(spark, sf).withColumn("date_approved", created)


@register("M24_period_comparison", f"""
SELECT *, valeur_courante - valeur_precedente AS ecart, (valeur_courante - valeur_precedente) / nullif(valeur_precedente, 0) * 100 AS evolution_pct,
  CASE WHEN valeur_precedente = 0 AND valeur_courante > 0 THEN 'Nouvelle activité' WHEN valeur_precedente = 0 THEN 'Sans activité' ELSE 'Comparable' END AS lecture FROM ({COMPARISON})""", ("v_events", "v_savings"))
def m24(spark, sf):
    return T.compare_periods(journal(spark, sf), recent_loans(spark, sf), new_savings(spark, sf), WINDOW)


YEARS = T.year_windows(dt.date(1999, 3, 1), dt.date(1999, 5, 31))


APPROVED_SAVINGS = "(SELECT *, CAST(date_approved AS TIMESTAMP) AS created_at FROM v_savings)"


@register("M25_year_over_year", f"""
WITH c AS (SELECT CASE WHEN count(*) = 0 THEN 'Non calculable' WHEN min(created_at) < TIMESTAMP '1998-03-02' AND max(created_at) >= TIMESTAMP '1999-05-31' THEN 'Complete' ELSE 'Partielle' END AS couverture FROM v_loans)
SELECT indicateur, currency_code, valeur_courante, valeur_precedente, (valeur_courante - valeur_precedente) / nullif(valeur_precedente, 0) * 100 AS evolution_pct, couverture
FROM ({comparison_sql(YEARS, 'v_loans', APPROVED_SAVINGS, 'loan_balance')}), c""", ("v_events", "v_loans", "v_savings"))
def m25(spark, sf):
    loans = V.loans(spark, sf)
    out = T.compare_periods(journal(spark, sf), loans, V.savings(spark, sf), YEARS)
    covered = T.coverage(loans, YEARS).select("couverture").scalar()
    return out.select("indicateur", "currency_code", "valeur_courante", "valeur_precedente", "evolution_pct", covered.alias("couverture"))


REGULAR = f"""SELECT *, jours_avec_depot * CAST(100 AS DOUBLE) / 21 AS score_regularite_pct, CASE WHEN jours_avec_depot * CAST(100 AS DOUBLE) / 21 >= 70 THEN 'Très régulier' WHEN jours_avec_depot * CAST(100 AS DOUBLE) / 21 >= 40 THEN 'Régulier' WHEN jours_avec_depot * CAST(100 AS DOUBLE) / 21 >= 10 THEN 'Occasionnel' ELSE 'Faible activité' END AS categorie_regularite
  FROM (SELECT customer_id, currency_code, count(*) AS nombre_depots, {fsum('depot_epargne')} AS montant_depots, count(DISTINCT CAST(created_at AS DATE)) AS jours_avec_depot FROM v_events WHERE {PERIOD} AND depot_epargne > 0 GROUP BY 1, 2)"""


@register("M26_regular_deposits", REGULAR, EVT)
def m26(spark, sf):
    return T.regular_deposits(journal(spark, sf), START, END)


@register("M28_statistics", f"""
WITH f AS (SELECT currency_code, count(*) AS no, count(DISTINCT customer_id) AS nc, {fsum('montant_operation')} AS v, {fsum('montant_entree')} AS e, {fsum('montant_sortie')} AS s FROM v_events WHERE {PERIOD} GROUP BY 1),
s AS (SELECT currency_code, CASE account_type WHEN 'FIXED SAVINGS' THEN 'DAT' ELSE 'Compte ouvert' END AS fa, count(DISTINCT savings_id) AS n, {fsum('balance')} AS b FROM v_savings GROUP BY 1, 2),
c AS (SELECT currency_code, count(*) AS n, count(DISTINCT customer_id) AS k, {fsum('loan_balance')} AS b FROM v_loans GROUP BY 1), r AS (SELECT currency_code, count(*) AS n, {fsum('montant_depots')} AS m FROM ({REGULAR}) WHERE categorie_regularite = 'Très régulier' GROUP BY 1)
SELECT 'Transactions' AS bloc, currency_code, 'nombre_operations' AS indicateur, CAST(no AS DOUBLE) AS valeur FROM f UNION ALL SELECT 'Transactions', currency_code, 'nombre_clients', nc FROM f UNION ALL SELECT 'Transactions', currency_code, 'volume', v FROM f
UNION ALL SELECT 'Transactions', currency_code, 'montant_entrees', e FROM f UNION ALL SELECT 'Transactions', currency_code, 'montant_sorties', s FROM f
UNION ALL SELECT 'Comptes', currency_code, concat('nombre_comptes ', fa), n FROM s UNION ALL SELECT 'Comptes', currency_code, concat('encours_actuel ', fa), b FROM s
UNION ALL SELECT 'Credits', currency_code, 'nombre_credits', n FROM c UNION ALL SELECT 'Credits', currency_code, 'emprunteurs', k FROM c UNION ALL SELECT 'Credits', currency_code, 'encours_credit', b FROM c
UNION ALL SELECT 'Clients', currency_code, 'clients', n FROM r UNION ALL SELECT 'Clients', currency_code, 'montant_depots', m FROM r""", ("v_events", "v_savings", "v_loans"))
def m28(spark, sf):
    return T.statistics(journal(spark, sf), V.savings(spark, sf), V.loans(spark, sf), START, END)


def series(spark, sf):
    created = {"nouveaux_credits": (recent_loans(spark, sf), F.col("created_at"), None), "montant_credits": (recent_loans(spark, sf), F.col("created_at"), "loan_amount"),
               "nouveaux_clients": (people(spark, sf), F.col("created_at"), None)}
    return FC.daily_series(FC.sources(journal(spark, sf), created), dt.date(2024, 1, 30))


def _series_sql():
    day = "CAST(created_at AS DATE)"
    base = {"operations": "CAST(count(*) AS DOUBLE)", "clients_actifs": "CAST(count(DISTINCT customer_id) AS DOUBLE)", "volume": fsum("montant_operation"), "decaissements": fsum("montant_decaisse"),
            "remboursements": fsum("(remboursement_portefeuille + remboursement_compte_ouvert)")}
    parts = [f"SELECT '{k}' AS indicateur, currency_code, {day} AS jour, {v} AS valeur FROM v_events GROUP BY 2, 3" for k, v in base.items()]
    parts += [f"SELECT 'nouveaux_credits', currency_code, {day}, CAST(count(*) AS DOUBLE) FROM {RECENT} GROUP BY 2, 3", f"SELECT 'montant_credits', currency_code, {day}, {fsum('loan_amount')} FROM {RECENT} GROUP BY 2, 3",
              "SELECT 'nouveaux_clients', '', DATE '2024-01-01' + CAST(c_custkey % 30 AS INT), CAST(count(*) AS DOUBLE) FROM customer GROUP BY 3"]
    return f"""WITH v AS ({' UNION ALL '.join(parts)}), s AS (SELECT indicateur, currency_code, CAST(unnest(generate_series(min(jour), DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS jour FROM v GROUP BY 1, 2)
SELECT indicateur, currency_code, jour, coalesce(valeur, CAST(0 AS DOUBLE)) AS valeur FROM s LEFT JOIN v USING (indicateur, currency_code, jour)"""


@register("M29_daily_series", _series_sql(), EVT)
def m29a(spark, sf):
    return series(spark, sf)


def _clip(x, low, high):
    return f"least(greatest({x}, {low}), {high})"


def _forecast_ctes(folds=1):
    """The series, the means at every origin and the days after it. Sums of amounts are exact, sums of errors go in the order of days."""
    week = ", ".join(f"{avg('valeur', f'isodow(jour) = {d}')} AS j{d}" for d in range(1, 8))
    factors = ", ".join(f"coalesce({_clip(f'j{d} / CASE WHEN fond = 0 THEN 1 ELSE fond END', '0.25::DOUBLE', '4::DOUBLE')}, 1::DOUBLE)" for d in range(1, 8))
    small = "CAST(0.01 AS DOUBLE) * niveau"
    trend = _clip("(tard - tot) / 14", f"-({small})", small)
    return f"""series AS ({_series_sql()}), spans AS (
  SELECT indicateur, currency_code, min(jour) AS debut, max(jour) AS fin, date_diff('day', min(jour), max(jour)) + 1 AS n, least(14, (date_diff('day', min(jour), max(jour)) + 1) // 4) AS retenus FROM series GROUP BY 1, 2
), ends AS (
  SELECT *, n - origine * retenus AS jusqu FROM (SELECT *, unnest(range({folds + 1})) AS origine FROM spans) WHERE origine = 0 OR n - origine * retenus >= 14
), days AS (
  SELECT e.*, jour, valeur, date_diff('day', debut, jour) + 1 AS place FROM series JOIN ends e USING (indicateur, currency_code)
), means AS (
  SELECT indicateur, currency_code, debut, n, retenus, origine, jusqu, {avg('valeur', 'place > jusqu - 28')} AS niveau, {avg('valeur')} AS fond, {avg('valeur', 'place > jusqu - 14')} AS tard,
    {avg('valeur', 'place > greatest(jusqu - 28, 0) AND place <= greatest(jusqu - 28, 0) + 14')} AS tot, {week}
  FROM days WHERE place <= jusqu AND place > jusqu - 56 GROUP BY ALL
), ahead AS (
  SELECT *, CAST(debut + CAST(jusqu - 1 + pas AS INTEGER) AS DATE) AS date FROM (
    SELECT *, [{factors}] AS facteurs, {trend} AS tendance, unnest(range(1, CASE WHEN origine > 0 THEN retenus + 1 WHEN n >= 28 THEN 16 ELSE 2 END)) AS pas FROM means)
), projected AS (
  SELECT *, CASE WHEN niveau > 0 THEN greatest((niveau + tendance * least(pas, 14)) * facteurs[isodow(date)], 0) ELSE 0 END::DOUBLE AS prevision FROM ahead
), errors AS (
  SELECT p.indicateur, p.currency_code, p.origine, p.pas, s.valeur, s.valeur - prevision AS ecart FROM projected p JOIN series s ON s.indicateur = p.indicateur AND s.currency_code = p.currency_code AND s.jour = p.date WHERE origine > 0
), tested AS (
  SELECT *, entier / jours AS mae, entier / nullif(observe, 0) * 100 AS wape_pct, sqrt(carres / jours) AS rmse FROM (
    SELECT indicateur, currency_code, count(*) AS jours, {fsum('abs(valeur)')} AS observe, list_reduce(list_concat([0::DOUBLE], list(abs(ecart) ORDER BY origine, pas)), lambda a, x: a + x) AS entier,
      list_reduce(list_concat([0::DOUBLE], list(ecart * ecart ORDER BY origine, pas)), lambda a, x: a + x) AS carres FROM errors GROUP BY 1, 2)
), predicted AS (
  SELECT p.indicateur, p.currency_code, p.date, CASE WHEN n >= 28 THEN prevision END AS prevision, CASE WHEN n >= 28 THEN greatest(prevision - CAST(1.2816 AS DOUBLE) * rmse, 0) END AS borne_basse,
    CASE WHEN n >= 28 THEN prevision + CAST(1.2816 AS DOUBLE) * rmse END AS borne_haute, CASE WHEN n >= 28 THEN mae END AS mae, CASE WHEN n >= 28 THEN wape_pct END AS wape_pct,
    CASE WHEN n >= 28 THEN CASE WHEN wape_pct <= 20 THEN 'Bonne' WHEN wape_pct <= 40 THEN 'Acceptable' ELSE 'Prudence' END END AS qualite, CASE WHEN n >= 28 THEN 'Calculee' ELSE 'Historique insuffisant' END AS statut
  FROM projected p LEFT JOIN tested USING (indicateur, currency_code) WHERE origine = 0
)"""


@register("M29_forecast", f"WITH {_forecast_ctes()} SELECT * FROM predicted", EVT)
def m29b(spark, sf):
    return FC.forecast(series(spark, sf), horizon=15)


@register("M29_forecast_summary", f"""WITH {_forecast_ctes()}
SELECT indicateur, currency_code, CASE WHEN indicateur = 'clients_actifs' THEN {div(fsum('prevision'), 'count(*)')} ELSE {fsum('prevision')} END AS valeur_prevue_horizon, max(mae) AS mae, max(wape_pct) AS wape_pct, max(qualite) AS qualite
FROM predicted WHERE statut = 'Calculee' GROUP BY 1, 2""", EVT)
def m29c(spark, sf):
    return FC.forecast_summary(FC.forecast(series(spark, sf), horizon=15))


@register("M29_backtest", f"WITH {_forecast_ctes(2)} SELECT indicateur, currency_code, jours, mae, wape_pct, rmse FROM tested", EVT)
def m29d(spark, sf):
    """Two origins, each with a quarter of the series held out."""
    return FC.backtest(series(spark, sf), folds=2)


# --- ledger controls ------------------------------------------------------------------------------------------

def faulty_ledger(spark, sf):
    """The ledger with faults planted by key."""
    key = F.col("id")
    return V.journal(spark, sf).withColumns({
        "customer_id": F.when(key % 31 != 0, F.col("customer_id")), "reference_id": F.when(key % 37 == 0, " ").otherwise(F.col("reference_id")),
        "dr": F.when(key % 41 == 0, 0.0).otherwise(F.col("dr")), "cr": F.when(key % 41 == 0, 0.0).otherwise(F.col("cr")),
        "bal_after": F.when(key % 43 == 0, -1.0).otherwise(F.abs("bal_after")), "currency_code": F.when(key % 47 != 0, F.col("currency_code")),
        "account_type": F.when(key % 53 == 0, "INCONNU").otherwise(F.col("account_type"))})


FAULTS = [("Lignes sans customer_id", "id % 31 = 0"), ("Lignes sans reference_id", "id % 37 = 0"), ("Date created_at invalide ou manquante", "false"),
          ("Mouvements dr = 0 et cr = 0", "id % 41 = 0 OR (dr = 0 AND cr = 0)"), ("Mouvements dr > 0 et cr > 0", "false"), ("Solde bal_before ou bal_after negatif", "id % 43 = 0"),
          ("Devise manquante", "id % 47 = 0"), ("account_type manquant", "false"), ("account_type non reference", "id % 53 = 0"), ("Doublons exacts", "false"), ("Lignes dans des groupes d''ecritures repetees", "false")]


@register("D4_ledger_anomalies", f"""
SELECT * FROM (SELECT id, nullif(concat_ws('; ', {', '.join(f"CASE WHEN {w} THEN '{n}' END" for n, w in FAULTS)}), '') AS raison_anomalie FROM v_journal) WHERE raison_anomalie IS NOT NULL""", JRN)
def d4(spark, sf):
    return W.ledger_anomalies(faulty_ledger(spark, sf)).select("id", "raison_anomalie")


@register("D4_selected_control", "SELECT id, 'Lignes sans reference_id' AS raison_anomalie FROM v_journal WHERE id % 37 = 0", JRN)
def d4b(spark, sf):
    return W.ledger_anomalies(faulty_ledger(spark, sf), ["Lignes sans reference_id"]).select("id", "raison_anomalie")


@register("D5_diagnostics", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS controle, {cnt(w)} AS valeur, CASE WHEN {cnt(w)} = 0 THEN 'OK' ELSE 'A surveiller' END AS statut FROM v_journal" for n, w in FAULTS) + f"""
UNION ALL SELECT 'Ecritures comptables liees', count(*), 'Information' FROM (SELECT ref_no FROM v_journal WHERE ref_no IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'DAT - echeance anterieure a l''approbation', {cnt('maturity_date < date_approved')}, 'OK' FROM v_savings WHERE account_type = 'FIXED SAVINGS'
UNION ALL SELECT 'DAT echus avec solde positif', {cnt(f'maturity_date <= {D} AND balance > 0')}, 'Controle metier' FROM v_savings WHERE account_type = 'FIXED SAVINGS'""", ("v_journal", "v_savings"))
def d5(spark, sf):
    return W.diagnostics(faulty_ledger(spark, sf), P.term_deposits(V.savings(spark, sf)), DAY)


@register("F10_wallet_as_of", f"SELECT count(*) AS lignes, count(DISTINCT customer_id) AS clients FROM v_journal WHERE created_at < TIMESTAMP '2024-01-16'", JRN)
def f10b(spark, sf):
    return FL.as_of(V.journal(spark, sf), dt.date(2024, 1, 15), ["created_at"]).agg(F.count("*").alias("lignes"), F.count_distinct("customer_id").alias("clients"))


@register("T4_ledger_exact_duplicates", f"""
SELECT {big('sum(n)')} AS lignes, count(*) AS lignes_distinctes, {big('sum(n - 1)')} AS doublons_exacts FROM (SELECT count(*) AS n FROM v_journal GROUP BY customer_id, account_type, currency_code, description)""", JRN)
def t4b(spark, sf):
    return Q.exact_duplicates(V.journal(spark, sf).select("customer_id", "account_type", "currency_code", "description"))
