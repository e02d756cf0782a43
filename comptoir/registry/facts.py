"""Registered queries of compliance, reporting measures and catalogued controls."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from comptoir.functions.money import exact_sum
from comptoir.operators import aml as A
from comptoir.operators import compliance as C
from comptoir.operators import controls as Q
from comptoir.operators import facts as R
from comptoir.operators import portfolio as P
from comptoir.registry import portfolio as RP
from comptoir.registry import views as V
from comptoir.registry.base import register
from comptoir.registry.sqltext import M, avg, big, cnt, div, dsum, fsum, m

DAY = dt.date(2001, 8, 1)
D = f"DATE '{DAY}'"
CNF, SIT, ACC, OPS, LED = ("v_conformite",), ("v_situation",), ("v_accounts",), ("v_operations",), ("v_ledger",)

# --- compliance -----------------------------------------------------------------------------------------------


@register("A41_reporting_sums", f"SELECT ligne_reporting AS ligne, {fsum('nombre')} AS nombre FROM v_conformite WHERE ligne_reporting IS NOT NULL AND starts_with(\"analyse\", '149') GROUP BY 1", CNF)
def a41(spark, sf):
    return C.reporting_sums(V.compliance(spark, sf))


@register("A43_alert_figures", f"""
WITH k AS (SELECT *, operation_slot = 0 AS al, operation_slot = 1 AS sp, operation_slot = 2 AS gr FROM (SELECT *, ligne_id % 9 AS operation_slot FROM v_conformite)),
s AS (SELECT {cnt('al')} AS a, {cnt("al AND statut_revue = 'TRAITE'")} AS t, {cnt('sp')} AS f, {cnt('gr')} AS g, {big("coalesce(sum(nombre) FILTER (WHERE gr), 0)")} AS gn, count(DISTINCT CASE WHEN al OR sp THEN code_client END) AS c, count(DISTINCT CASE WHEN al OR sp OR gr THEN devise END) AS d FROM k)
SELECT a AS alertes, t AS traitees, greatest(a - t, 0) + f + g AS a_revoir, f AS fractionnements, gn AS gros_mouvements, c AS clients_concernes, d AS devises FROM s""", CNF)
def a43(spark, sf):
    return C.alert_figures(V.compliance(spark, sf))


@register("A44_distributions", "\nUNION ALL\n".join(f"SELECT '{c}' AS colonne, coalesce({c}, 'Non renseigné') AS valeur, count(*) AS nombre_lignes FROM v_conformite GROUP BY 2" for c in ("statut_couverture", "severite", "etat")), CNF)
def a44(spark, sf):
    table = V.compliance(spark, sf)
    out = None
    for c in ("statut_couverture", "severite", "etat"):
        part = C.distribution(table, c).select(F.lit(c).alias("colonne"), F.col(c).alias("valeur"), "nombre_lignes")
        out = part if out is None else out.unionByName(part)
    return out


@register("R5_compliance_measures", f"""
WITH s AS (SELECT *, type_element IN ('Alerte','Declaration','Profil de risque','Reactivation de compte','Fractionnement','Gros mouvement agrege') AS w FROM v_conformite)
SELECT count(*) AS lignes, count(DISTINCT "analyse") AS analyses, {big('sum(nombre)')} AS nombre_declare, {', '.join(f'''{cnt(f"type_element = '{k}'")} AS {n}''' for k, n in (('Controle qualite', 'controles_qualite'), ('Alerte', 'alertes'), ('Declaration', 'declarations'), ('Profil de risque', 'profils_risque'), ('Reactivation de compte', 'reactivations')))},
  {cnt("statut_couverture = 'NON_COUVERT'")} AS non_couverts, {cnt("statut_couverture = 'PARTIEL'")} AS partiels, {cnt("statut_couverture = 'COUVERT'")} AS couverts, {cnt("severite = 'CRITIQUE'")} AS critiques, {cnt('severite IS NOT NULL')} AS lignes_severite,
  {cnt('w')} AS cas_surveillance, {cnt("w AND statut_revue = 'A_REVOIR'")} AS dossiers_a_revoir, count(DISTINCT CASE WHEN w THEN code_client END) AS clients_surveilles FROM s""", CNF)
def r5(spark, sf):
    return C.compliance_measures(V.compliance(spark, sf))


DEP, WIT = "type_element = 'Mouvement' AND type_operation IN ('DEPO','MOB_DEPO','DDAT')", "type_element = 'Mouvement' AND type_operation IN ('RETR','MOB_RETR','RDAT')"


@register("R10_net_collection", f"""
SELECT devise, {fsum('montant', DEP)} AS montant_depots, {fsum('montant', WIT)} AS montant_retraits, CAST({dsum('montant', DEP)} - {dsum('montant', WIT)} AS DOUBLE) AS collecte_nette FROM v_conformite WHERE devise IS NOT NULL GROUP BY 1""", CNF)
def r10(spark, sf):
    return C.net_collection(V.compliance(spark, sf))


# --- measures -------------------------------------------------------------------------------------------------

@register("R1_base_measures", f"""
SELECT devise, {cnt('solde_final > 0')} AS prets_actifs, {fsum('solde_final')} AS encours, {fsum('mtt_provision')} AS provision, {fsum('montant_accorde')} AS decaissements, count(*) AS prets_decaisses, any_value(epargne) AS epargne
FROM v_situation JOIN (SELECT currency_code AS devise, {fsum('balance')} AS epargne FROM v_savings GROUP BY 1) USING (devise) GROUP BY 1""", ("v_situation", "v_savings"))
def r1(spark, sf):
    return R.base_measures(RP.situation(spark, sf), V.savings(spark, sf))


def _par(floors, op):
    return ", ".join(f"{fsum('solde_final', f'coalesce(retard_jours, 0) {op} {n}')} AS par_{n}, {div(dsum('solde_final', f'coalesce(retard_jours, 0) {op} {n}'), dsum('solde_final'))} AS taux_par_{n}" for n in floors)


@register("R2_par_measures", f"SELECT devise, {fsum('solde_final')} AS encours, {_par((1, 30, 90, 180), '>=')} FROM v_situation GROUP BY 1", SIT)
def r2(spark, sf):
    return R.par_measures(RP.situation(spark, sf))


@register("R3_par_7_and_60", f"SELECT devise, {fsum('solde_final')} AS encours, {_par((7, 60), '>')} FROM v_situation GROUP BY 1", SIT)
def r3(spark, sf):
    return R.par_measures(RP.situation(spark, sf), (7, 60), strict=True)


ORD, DAT = "type_produit LIKE '%Ordinaire%'", "type_produit = 'DAT'"


@register("R4_savings_measures", f"""
SELECT devise, count(DISTINCT client_id) AS clients, count(DISTINCT compte_id) AS comptes, {fsum('solde_compte')} AS epargne, {div(dsum('solde_compte'), 'count(DISTINCT compte_id)')} AS solde_moyen, {div(dsum('solde_compte'), 'count(DISTINCT client_id)')} AS solde_moyen_epargnant,
  {fsum('solde_compte', ORD)} AS encours_courant, {fsum('solde_compte', DAT)} AS encours_dat, CAST({dsum('solde_compte')} - {dsum('solde_compte', ORD)} - {dsum('solde_compte', DAT)} AS DOUBLE) AS autres_epargnes, {div(dsum('solde_compte', DAT), dsum('solde_compte'))} AS part_dat FROM v_accounts GROUP BY 1""", ACC)
def r4(spark, sf):
    return R.savings_measures(RP.accounts(spark, sf))


V.VIEW_SQL["v_client_fact"] = f"""
SELECT c_custkey AS client_id, coalesce(d, TIMESTAMP '1900-01-01') >= TIMESTAMP '2001-01-01' AS client_actif, true AS avec_compte_ouvert, f > 0 AS avec_compte_bloque, coalesce(d, TIMESTAMP '1900-01-01') < TIMESTAMP '2000-06-01' AS avec_compte_dormant,
  coalesce(e, 0) > 0 AS avec_credit, coalesce(q, 0) > 0 AS avec_dat_echeance, CAST(coalesce(e, 0) AS DOUBLE) AS montant_credit, CAST(coalesce(q, 0) AS DOUBLE) AS montant_dat_echeance
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1) o ON o_custkey = c_custkey
LEFT JOIN (SELECT client_id, {dsum('solde_final')} AS e FROM v_situation GROUP BY 1) l ON l.client_id = c_custkey
LEFT JOIN (SELECT customer_id, {cnt("account_type = 'FIXED SAVINGS' AND balance > 0")} AS f, {dsum('balance', f"account_type = 'FIXED SAVINGS' AND balance > 0 AND maturity_date <= {D}")} AS q FROM v_savings GROUP BY 1) s ON s.customer_id = c_custkey
"""
V.VIEW_USES["v_client_fact"] = ("v_situation", "v_savings")


def client_fact(spark, sf):
    last = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("client_id")).agg(F.max("o_orderdate").alias("d"))
    owed = RP.situation(spark, sf).groupBy("client_id").agg(exact_sum("solde_final").alias("e"))
    blocked = (F.col("account_type") == "FIXED SAVINGS") & (F.col("balance") > 0)
    held = V.savings(spark, sf).groupBy(F.col("customer_id").alias("client_id")).agg(
        F.count(F.when(blocked, 1)).alias("f"), exact_sum("balance", blocked & (F.col("maturity_date") <= F.lit(DAY))).alias("q"))
    base = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("client_id"))
    joined = base.join(last, "client_id", "left").join(owed, "client_id", "left").join(held, "client_id", "left")
    d = F.coalesce("d", F.lit(dt.date(1900, 1, 1)).cast("timestamp_ntz"))
    e, q = F.coalesce("e", F.lit(0)), F.coalesce("q", F.lit(0))
    return joined.select(
        "client_id", (d >= F.lit(dt.date(2001, 1, 1)).cast("timestamp_ntz")).alias("client_actif"), F.lit(True).alias("avec_compte_ouvert"), (F.col("f") > 0).alias("avec_compte_bloque"),
        (d < F.lit(dt.date(2000, 6, 1)).cast("timestamp_ntz")).alias("avec_compte_dormant"), (e > 0).alias("avec_credit"), (q > 0).alias("avec_dat_echeance"),
        e.cast("double").alias("montant_credit"), q.cast("double").alias("montant_dat_echeance"))


@register("R6_client_base", f"""
WITH c AS (SELECT count(*) AS clients, {cnt('client_actif')} AS clients_actifs, {cnt('avec_compte_ouvert')} AS clients_comptes_ouverts, {cnt('avec_compte_bloque')} AS clients_comptes_bloques, {cnt('avec_compte_dormant')} AS clients_comptes_dormants,
  {cnt('avec_credit')} AS clients_credit_a_rembourser, {cnt('avec_dat_echeance')} AS clients_dat_echeance, {fsum('montant_credit')} AS montant_credit_a_rembourser, {fsum('montant_dat_echeance')} AS montant_dat_echeance FROM v_client_fact)
SELECT *, {div('clients_actifs', 'clients')} AS taux_clients_actifs, {div('clients_comptes_dormants', 'clients')} AS part_dormants, {div('clients_credit_a_rembourser', 'clients_actifs')} AS part_credit FROM c""", ("v_client_fact",))
def r6(spark, sf):
    return R.client_base(client_fact(spark, sf))


LATE = "coalesce(retard_jours, 0) > 0 AND solde_final > 0"


@register("R7_exposure_measures", f"""
SELECT devise, count(DISTINCT CASE WHEN {LATE} THEN client_id END) AS clients_par, {fsum('montant_operation')} AS arrieres, {fsum('mtt_provision')} AS provision, count(DISTINCT CASE WHEN {LATE} THEN dossier_id END) AS credits_en_retard,
  {div(f'count(DISTINCT CASE WHEN {LATE} THEN dossier_id END)', cnt('solde_final > 0'))} AS taux_credits_en_retard, {div(dsum('mtt_provision'), dsum('solde_final', 'coalesce(retard_jours, 0) >= 30'))} AS taux_couverture_par30 FROM v_situation GROUP BY 1""", SIT)
def r7(spark, sf):
    return R.exposure_measures(RP.situation(spark, sf))


V.VIEW_SQL["v_schedule"] = """
SELECT l_orderkey AS loan_id, l_linenumber AS numero, l_shipdate AS date_echeance, l_extendedprice AS attendu,
  CASE l_returnflag WHEN 'N' THEN CAST(0 AS DOUBLE) WHEN 'R' THEN l_extendedprice ELSE l_extendedprice * CAST(0.5 AS DOUBLE) END AS rembourse, l_shipdate + to_days(CAST(l_quantity AS INT) % 40 - 10) AS date_paiement FROM lineitem
"""
SCH = ("v_schedule",)


def schedule(spark, sf):
    price, flag = F.col("l_extendedprice"), F.col("l_returnflag")
    shift = F.make_dt_interval(days=(F.col("l_quantity").cast("int") % 40 - 10))
    return V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("loan_id"), F.col("l_linenumber").alias("numero"), F.col("l_shipdate").alias("date_echeance"), price.alias("attendu"),
        F.when(flag == "N", F.lit(0.0)).when(flag == "R", price).otherwise(price * 0.5).alias("rembourse"), (F.col("l_shipdate") + shift).alias("date_paiement"))


@register("R7_instalments", f"""
WITH p AS (SELECT loan_id, {cnt(f"date_echeance > TIMESTAMP '{DAY}'")} AS n, {dsum('attendu', f"date_echeance > TIMESTAMP '{DAY}'")} AS a FROM v_schedule GROUP BY 1) SELECT {fsum('a')} AS echeances_futures, {avg('n')} AS echeances_restantes_moyennes FROM p""", SCH)
def r7b(spark, sf):
    return R.instalment_measures(schedule(spark, sf), DAY)


@register("R8_late_rates", f"""
SELECT devise, count(DISTINCT CASE WHEN {LATE} THEN dossier_id END) AS credits_en_retard, {fsum('montant_operation')} AS arrieres FROM v_situation GROUP BY 1""", SIT)
def r8(spark, sf):
    return R.exposure_measures(RP.situation(spark, sf)).select("devise", "credits_en_retard", "arrieres")


@register("R9_loan_ratios", f"""
SELECT devise, {div(dsum('solde_final'), cnt('solde_final > 0'))} AS montant_moyen_actif, {div(dsum('montant_accorde'), 'count(*)')} AS montant_moyen_decaisse, {div(dsum('solde_final'), 'any_value(epargne)')} AS ratio_credits_depots
FROM v_situation JOIN (SELECT currency_code AS devise, {fsum('balance')} AS epargne FROM v_savings GROUP BY 1) USING (devise) GROUP BY 1""", ("v_situation", "v_savings"))
def r9(spark, sf):
    return R.loan_ratios(RP.situation(spark, sf), V.savings(spark, sf))


@register("R11_fact_totals", f"""
SELECT tranche_montant_initial AS tranche, duree_credit_mois AS duree, {fsum('solde_final')} AS encours, {fsum('solde_final', 'retard_jours >= 30')} AS par_30, count(DISTINCT dossier_id) AS prets FROM v_situation GROUP BY 1, 2""", SIT)
def r11(spark, sf):
    return R.fact_totals(RP.situation(spark, sf), F.col("tranche_montant_initial"))


@register("R12_period_bounds", "SELECT CAST(min(date_demande) AS DATE) AS date_debut, CAST(max(date_demande) AS DATE) AS date_fin, strftime(max(date_demande), '%d/%m/%Y') AS derniere_date FROM v_situation", SIT)
def r12(spark, sf):
    return R.period_bounds(RP.situation(spark, sf), "date_demande")


# --- operations and ledger ------------------------------------------------------------------------------------

V.VIEW_SQL["v_ops_full"] = """
SELECT *, date_operation + to_days(saisie_jours) AS date_saisie, CASE WHEN operation_id % 7 = 0 THEN NULL WHEN operation_id % 11 = 0 THEN date_operation - INTERVAL 1 DAY ELSE date_operation + INTERVAL 1 DAY END AS date_validation,
  date_operation + INTERVAL 2 DAY AS date_valide, CASE WHEN operation_id % 3 = 0 THEN operation_id - 1 WHEN operation_id % 3 = 1 THEN -operation_id END AS id_operation_annulee FROM v_operations
"""
V.VIEW_USES["v_ops_full"] = OPS
FUL = ("v_ops_full",)


def full_operations(spark, sf):
    key, day = F.col("operation_id"), F.col("date_operation")
    return V.operations(spark, sf).withColumns({
        "date_saisie": day + F.make_dt_interval(days=F.col("saisie_jours")),
        "date_validation": F.when(key % 7 == 0, None).when(key % 11 == 0, day - F.expr("INTERVAL 1 DAY")).otherwise(day + F.expr("INTERVAL 1 DAY")),
        "date_valide": day + F.expr("INTERVAL 2 DAYS"), "id_operation_annulee": F.when(key % 3 == 0, key - 1).when(key % 3 == 1, -key)})


@register("Q1_operation_exceptions", """
SELECT * FROM (SELECT operation_id, nullif(concat_ws('; ', CASE WHEN NOT annule AND date_validation IS NULL THEN 'Non validee' END, CASE WHEN saisie_jours > 0 THEN 'Saisie tardive' END,
  CASE WHEN date_valide < date_saisie OR date_validation < date_operation THEN 'Chronologie incoherente' END), '') AS motif FROM v_ops_full) WHERE motif IS NOT NULL""", FUL)
def q1(spark, sf):
    return Q.operation_exceptions(full_operations(spark, sf)).select("operation_id", "motif")


@register("Q2_repeated_receipts", "SELECT operation_id, numero_recu, n AS occurrences FROM (SELECT *, count(*) OVER (PARTITION BY numero_recu) AS n FROM v_operations) WHERE n > 1", OPS)
def q2(spark, sf):
    return Q.repeated_numbers(V.operations(spark, sf), "numero_recu").select("operation_id", "numero_recu", "occurrences")


@register("Q2_near_duplicates", """
SELECT CAST(date_trunc('month', date_operation) AS TIMESTAMP) AS date_operation, operateur, type_operation, client_id, count(*) AS occurrences, min(operation_id) AS premiere_operation FROM v_operations GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""", OPS)
def q2b(spark, sf):
    monthly = V.operations(spark, sf).withColumn("date_operation", F.date_trunc("month", "date_operation").cast("timestamp_ntz"))
    return Q.near_duplicates(monthly, ["date_operation", "operateur", "type_operation", "client_id"])


@register("Q3_broken_cancellations", """
SELECT operation_id, 'Annulation sans reference' AS motif FROM v_ops_full WHERE annule AND id_operation_annulee IS NULL
UNION ALL SELECT operation_id, 'Reference introuvable' FROM v_ops_full a WHERE annule AND id_operation_annulee IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_operations b WHERE b.operation_id = a.id_operation_annulee)""", FUL)
def q3(spark, sf):
    return Q.broken_cancellations(full_operations(spark, sf))


@register("Q4_self_validated", "SELECT operation_id, operateur FROM v_operations WHERE operateur = validateur", OPS)
def q4(spark, sf):
    return Q.self_validated(V.operations(spark, sf)).select("operation_id", "operateur")


@register("Q5_orphans", """
SELECT DISTINCT operation_id, 'Ecriture sans operation' AS motif FROM v_ledger WHERE operation_id NOT IN (SELECT operation_id FROM v_operations WHERE NOT annule)
UNION ALL SELECT operation_id, 'Operation sans ecriture' FROM v_operations WHERE NOT annule AND operation_id NOT IN (SELECT operation_id FROM v_ledger)""", ("v_ledger", "v_operations"))
def q5(spark, sf):
    return Q.orphans(V.operations(spark, sf).where("NOT annule"), V.ledger_operations(spark, sf))


@register("Q6_unbalanced", f"""
SELECT operation_id, CAST(abs({dsum('montant', "sens = 'D'")} - {dsum('montant', "sens = 'C'")}) AS DOUBLE) AS ecart_debit_credit FROM v_ledger GROUP BY 1 HAVING abs({dsum('montant', "sens = 'D'")} - {dsum('montant', "sens = 'C'")}) > CAST(0.01 AS {M})""", LED)
def q6(spark, sf):
    return Q.unbalanced(A.ledger_summary(V.ledger(spark, sf))).select("operation_id", "ecart_debit_credit")


@register("Q7_channel_totals", f"""
SELECT reference, n_bo, n_api, CAST(b AS DOUBLE) AS montant_bo, CAST(a AS DOUBLE) AS montant_api, CASE WHEN n_api = 0 THEN 'Absent API' WHEN n_bo = 0 THEN 'Absent back-office' WHEN a = b THEN 'Conforme' ELSE 'Ecart' END AS statut
FROM (SELECT client_id % 5000 * 10 + operation_id % 7 AS reference, {cnt("source_mouvement = 'BACK_OFFICE'")} AS n_bo, {cnt("source_mouvement = 'API_MOBILE'")} AS n_api, {dsum('montant_operation', "source_mouvement = 'BACK_OFFICE'")} AS b, {dsum('montant_operation', "source_mouvement = 'API_MOBILE'")} AS a FROM v_operations GROUP BY 1)""", OPS)
def q7(spark, sf):
    return Q.channel_totals(V.operations(spark, sf), F.col("client_id") % 5000 * 10 + F.col("operation_id") % 7)


@register("Q8_asymmetric_cancellations", f"""
WITH p AS (SELECT operation_id AS a, id_operation_annulee AS o FROM v_ops_full WHERE annule AND id_operation_annulee IS NOT NULL), k AS (SELECT a, a AS op FROM p UNION ALL SELECT a, o FROM p),
n AS (SELECT a, compte_id, id_devise, sum(CASE sens WHEN 'D' THEN {m('montant')} WHEN 'C' THEN -{m('montant')} ELSE 0 END) AS net FROM k JOIN v_ledger l ON l.operation_id = k.op GROUP BY 1, 2, 3)
SELECT a AS annulation, count(*) AS comptes_en_ecart, CAST(sum(abs(net)) AS DOUBLE) AS ecart_total FROM n WHERE net <> 0 GROUP BY 1""", ("v_ops_full", "v_ledger"))
def q8(spark, sf):
    return Q.asymmetric_cancellations(full_operations(spark, sf), V.ledger(spark, sf))


@register("Q9_daily_balance", f"""
SELECT CAST(date_operation AS DATE) AS jour, id_devise, journal, {fsum('montant', "sens = 'D'")} AS debit, {fsum('montant', "sens = 'C'")} AS credit, CAST({dsum('montant', "sens = 'D'")} - {dsum('montant', "sens = 'C'")} AS DOUBLE) AS ecart FROM v_ledger GROUP BY 1, 2, 3""", LED)
def q9(spark, sf):
    return Q.daily_ledger_balance(V.ledger(spark, sf))


def account_states(spark, sf):
    balance = F.col("s_acctbal")
    return V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("compte_id"), balance.alias("solde"),
                                                 F.when(balance < 0, "CLOTURE").when(balance < 2000, "BLOQUE").otherwise("ACTIF").alias("etat"))


@register("Q10_closed_account_movements", f"""
SELECT compte_id, CASE WHEN s_acctbal < 0 THEN 'CLOTURE' ELSE 'BLOQUE' END AS etat, count(*) AS mouvements, {fsum('montant')} AS montant, max(date_operation) AS dernier FROM v_ledger JOIN supplier ON s_suppkey = compte_id WHERE s_acctbal < 2000 GROUP BY 1, 2""", LED)
def q10(spark, sf):
    return Q.closed_account_movements(V.ledger(spark, sf), account_states(spark, sf))


@register("Q11_frequent_depositors", f"""
SELECT *, CASE WHEN depots >= 5 THEN '5 fois ou plus' ELSE '3 a 4 fois' END AS classe FROM (SELECT client_id % 40 AS client_id, CAST(date_trunc('week', date_operation) AS DATE) AS semaine, count(DISTINCT operation_id) AS depots, {fsum('montant_operation')} AS montant
  FROM v_operations WHERE type_operation IN ('DEPO', 'MOB_DEPO') GROUP BY 1, 2) WHERE depots >= 3""", OPS)
def q11(spark, sf):
    # Clients are grouped into forty households, so that weeks with several deposits occur in the given tables.
    return Q.frequent_depositors(V.operations(spark, sf).withColumn("client_id", F.col("client_id") % 40))


@register("Q12_deposit_bands", f"""
SELECT code_devise, CASE WHEN code_devise = 'USD' THEN CASE WHEN montant_operation >= 100 THEN '100 et plus' WHEN montant_operation >= 50 THEN '50-99.99' WHEN montant_operation >= 25 THEN '25-49.99' WHEN montant_operation >= 10 THEN '10-24.99' END
  ELSE CASE WHEN montant_operation >= 200000 THEN '200000 et plus' WHEN montant_operation >= 125000 THEN '125000-199999' END END AS tranche, count(*) AS depots, count(DISTINCT client_id) AS clients, {fsum('montant_operation')} AS montant
FROM v_operations WHERE type_operation IN ('DEPO', 'MOB_DEPO') GROUP BY 1, 2 HAVING tranche IS NOT NULL""", OPS)
def q12(spark, sf):
    return Q.deposit_bands(V.operations(spark, sf))


@register("Q13_month_end_balances", f"""
WITH mo AS (SELECT agence, code_devise, last_day(CAST(date_operation AS DATE)) AS fin_mois, sum(CASE WHEN type_operation LIKE '%DEPO' THEN {m('montant_operation')} ELSE -{m('montant_operation')} END) AS f FROM v_operations GROUP BY 1, 2, 3),
g AS (SELECT agence, code_devise, last_day(CAST(unnest(generate_series(date_trunc('month', min(fin_mois)), date_trunc('month', max(fin_mois)), INTERVAL 1 MONTH)) AS DATE)) AS fin_mois FROM mo GROUP BY 1, 2)
SELECT agence, code_devise, fin_mois, CAST(sum(coalesce(f, 0)) OVER (PARTITION BY agence, code_devise ORDER BY fin_mois ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS solde FROM g LEFT JOIN mo USING (agence, code_devise, fin_mois)""", OPS)
def q13(spark, sf):
    value = F.when(F.col("type_operation").endswith("DEPO"), F.col("montant_operation")).otherwise(-F.col("montant_operation"))
    return Q.month_end_balances(V.operations(spark, sf), ["agence", "code_devise"], "date_operation", value)


@register("Q14_dormant_accounts", f"""
SELECT s_suppkey AS compte_id, s_acctbal AS solde, CAST(date_diff('day', CAST(d AS DATE), {D}) AS INT) AS jours_inactivite FROM supplier LEFT JOIN (SELECT compte_id, max(date_operation) AS d FROM v_ledger WHERE date_operation < TIMESTAMP '2001-08-02' GROUP BY 1) ON compte_id = s_suppkey
WHERE s_acctbal > 0 AND (d IS NULL OR date_diff('day', CAST(d AS DATE), {D}) >= 20)""", LED)
def q14(spark, sf):
    return Q.dormant_accounts(account_states(spark, sf), V.ledger(spark, sf), DAY, 20).select("compte_id", "solde", "jours_inactivite")


@register("Q15_wrong_side", f"""
SELECT type_operation, sens, count(*) AS lignes, {fsum('montant')} AS montant FROM v_ledger JOIN v_operations USING (operation_id) WHERE sens IS NOT NULL AND sens <> CASE WHEN type_operation LIKE '%DEPO' THEN 'C' ELSE 'D' END GROUP BY 1, 2""", ("v_ledger", "v_operations"))
def q15(spark, sf):
    return Q.wrong_side(V.operations(spark, sf), V.ledger(spark, sf))


@register("Q16_negative_after_debit", f"""
WITH r AS (SELECT l.*, CAST({m('s_acctbal')} + sum(CASE sens WHEN 'C' THEN {m('montant')} WHEN 'D' THEN -{m('montant')} ELSE 0 END) OVER (PARTITION BY compte_id ORDER BY date_valeur, operation_id, montant, sens NULLS FIRST, journal ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS solde_apres
  FROM v_ledger l JOIN supplier ON s_suppkey = compte_id) SELECT compte_id, operation_id, date_valeur, montant, solde_apres FROM r WHERE solde_apres < 0 AND sens = 'D'""", LED)
def q16(spark, sf):
    opening = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("compte_id"), F.col("s_acctbal").alias("ouverture"))
    order = [F.col(c).asc() for c in ("date_valeur", "operation_id", "montant", "sens", "journal")]
    return Q.negative_after_debit(V.ledger(spark, sf), opening, order).select("compte_id", "operation_id", "date_valeur", "montant", "solde_apres")


@register("Q17_clients_with_accounts", "SELECT c.client_id, nom_client, telephone, coalesce(n, 0) AS nombre_comptes FROM v_clients c LEFT JOIN (SELECT customer_id, count(DISTINCT savings_id) AS n FROM v_savings GROUP BY 1) s ON s.customer_id = c.client_id", ("v_clients", "v_savings"))
def q17(spark, sf):
    accounts = V.savings(spark, sf).select(F.col("customer_id").alias("client_id"), F.col("savings_id").alias("compte_id"))
    return Q.clients_with_accounts(V.clients(spark, sf), accounts)


# --- loans ----------------------------------------------------------------------------------------------------

@register("Q18_instalment_status", f"""
WITH e AS (SELECT loan_id, numero, {dsum('attendu')} AS a, {dsum(f"CASE WHEN date_paiement <= TIMESTAMP '{DAY}' THEN rembourse ELSE CAST(0 AS DOUBLE) END")} AS p, min(date_echeance) AS d FROM v_schedule WHERE date_echeance <= TIMESTAMP '{DAY}' GROUP BY 1, 2)
SELECT loan_id, count(*) AS echeances_dues, {cnt('a > p')} AS echeances_impayees, CAST(sum(a - p) FILTER (WHERE a > p) AS DOUBLE) AS impaye, min(d) FILTER (WHERE a > p) AS plus_ancienne, CASE WHEN {cnt('a > p')} > 0 THEN 'Impaye' ELSE 'Solde sur la periode' END AS statut FROM e GROUP BY 1""", SCH)
def q18(spark, sf):
    return Q.instalment_status(schedule(spark, sf), DAY)


@register("Q19_par_detail", f"SELECT dossier_id, client_id, agence, type_produit, devise, solde_final, retard_jours, {D} AS date_situation FROM v_situation WHERE solde_final > 0 AND retard_jours > 0", SIT)
def q19a(spark, sf):
    return Q.par_detail(RP.situation(spark, sf), DAY)


@register("Q19_monthly_disbursements", f"SELECT strftime(date_demande, '%Y-%m') AS mois, agence, type_produit, devise, count(*) AS prets, {fsum('montant_accorde')} AS montant FROM v_situation GROUP BY 1, 2, 3, 4", SIT)
def q19b(spark, sf):
    return Q.monthly_disbursements(RP.situation(spark, sf))


@register("Q19_future_instalments", f"""
SELECT strftime(date_echeance, '%Y-%m') AS mois, count(*) AS echeances, count(DISTINCT loan_id) AS prets, {fsum('attendu')} AS montant_attendu FROM v_schedule WHERE date_echeance > TIMESTAMP '2000-08-01' AND CAST(date_echeance AS DATE) <= DATE '2001-08-01' GROUP BY 1""", SCH)
def q19c(spark, sf):
    return Q.future_instalments(schedule(spark, sf), dt.date(2000, 8, 1))


@register("Q19_top_exposures", f"""
SELECT client_id, nom_client, CAST(s AS DOUBLE) AS encours FROM (SELECT client_id, nom_client, {dsum('solde_final')} AS s FROM v_situation GROUP BY 1, 2) ORDER BY s DESC, client_id, nom_client LIMIT 50""", SIT)
def q19d(spark, sf):
    return P.top_balances(RP.situation(spark, sf), ["client_id", "nom_client"], 50)


def dated_loans(spark, sf):
    end = (F.col("date_demande") + F.make_dt_interval(days=F.col("duree_credit_mois") * 30)).alias("fin")
    return RP.situation(spark, sf).select("client_id", "agence", "devise", "dossier_id", F.col("date_demande").alias("debut"), end)


RENEWALS = f"""
WITH l AS (SELECT client_id, agence, devise, date_demande + to_days(duree_credit_mois * 30) AS fin, lead(date_demande) OVER (PARTITION BY client_id ORDER BY date_demande, dossier_id) AS suivant FROM v_situation),
g AS (SELECT *, date_diff('day', CAST(fin AS DATE), CAST(suivant AS DATE)) AS gap FROM l)
SELECT agence, devise, strftime(fin, '%Y-%m') AS mois, count(*) AS arrives_echeance, {cnt('gap >= 0')} AS renouveles, {cnt('gap BETWEEN 0 AND 90')} AS renouveles_90j, {div('sum(gap) FILTER (WHERE gap >= 0)', cnt('gap >= 0'))} AS delai_moyen_jours,
  {div(cnt('gap >= 0'), 'count(*)')} * 100 AS retention_pct, {div(cnt('gap BETWEEN 0 AND 90'), 'count(*)')} * 100 AS retention_90j_pct FROM g GROUP BY 1, 2, 3"""


@register("Q20_renewals", RENEWALS, SIT)
def q20(spark, sf):
    return Q.renewals(dated_loans(spark, sf))


@register("A47_retention_trend", "\nUNION ALL\n".join(f"SELECT mois, '{label}' AS indicateur, {avg(c)} AS taux FROM ({RENEWALS}) GROUP BY 1" for c, label in (("retention_pct", "Rétention"), ("retention_90j_pct", "Rétention 90j"))), SIT)
def a47(spark, sf):
    return P.retention_trend(Q.renewals(dated_loans(spark, sf)), F.col("mois"), "mois")


@register("A47_retention_cards", f"""
SELECT {avg('retention_pct')} AS retention_moyenne, {avg('retention_90j_pct')} AS retention_90j_moyenne, {big('sum(arrives_echeance)')} AS arrives_echeance, {avg('delai_moyen_jours')} AS delai_moyen_jours FROM ({RENEWALS})""", SIT)
def a47b(spark, sf):
    cards = Q.renewals(dated_loans(spark, sf)).withColumnsRenamed({"arrives_echeance": "nb_clients_arrives_echeance", "delai_moyen_jours": "delai_moyen_renouvellement_jours"})
    return P.retention_cards(cards)


@register("Q21_vintages", f"""
SELECT CAST(date_trunc('month', date_demande) AS DATE) AS cohorte, type_produit, devise, count(*) AS prets, {fsum('montant_accorde')} AS montant_initial, {fsum('solde_final')} AS encours, {fsum('solde_final', 'retard_jours >= 30')} AS par_30, {fsum('solde_final', 'retard_jours >= 90')} AS par_90,
  {div(dsum('solde_final', 'retard_jours >= 30'), dsum('montant_accorde'))} * 100 AS par_30_sur_initial_pct, CAST((2001 - year(any_value(date_demande))) * 12 + 8 - month(any_value(date_demande)) AS INT) AS age_mois FROM v_situation GROUP BY 1, 2, 3""", SIT)
def q21(spark, sf):
    return Q.vintages(RP.situation(spark, sf), DAY)


@register("Q22_top_decile", f"""
WITH r AS (SELECT agence, type_produit, devise, {m('solde_final')} AS v, row_number() OVER (PARTITION BY agence, type_produit, devise ORDER BY {m('solde_final')} DESC, dossier_id) AS k, count(*) OVER (PARTITION BY agence, type_produit, devise) AS n FROM v_situation WHERE solde_final > 0)
SELECT agence, type_produit, devise, count(*) AS prets, {cnt('k <= ceil(n / 10)')} AS prets_top_10, CAST(sum(v) AS DOUBLE) AS encours, CAST(sum(v) FILTER (WHERE k <= ceil(n / 10)) AS DOUBLE) AS encours_top_10, {div('sum(v) FILTER (WHERE k <= ceil(n / 10))', 'sum(v)')} * 100 AS part_top_10_pct FROM r GROUP BY 1, 2, 3""", SIT)
def q22(spark, sf):
    return Q.top_decile(RP.situation(spark, sf))


COVER = f"""
WITH o AS (SELECT client_id, devise, {dsum('solde_final')} AS e FROM v_situation GROUP BY 1, 2), s AS (SELECT customer_id AS client_id, currency_code AS devise, {dsum('balance')} AS s FROM v_savings GROUP BY 1, 2),
g AS (SELECT client_id, devise, {dsum('montant_demande * CAST(0.25 AS DOUBLE)')} AS g FROM v_situation WHERE duree_credit_mois > 12 GROUP BY 1, 2)
SELECT client_id, devise, CAST(e AS DOUBLE) AS encours, CAST(coalesce(s, 0) AS DOUBLE) AS epargne, CAST(coalesce(g, 0) AS DOUBLE) AS garanties, CAST(greatest(e - coalesce(s, 0) - coalesce(g, 0), 0) AS DOUBLE) AS exposition_nette,
  CASE WHEN e - coalesce(s, 0) - coalesce(g, 0) <= 0 THEN 'Couvert' WHEN coalesce(s, 0) + coalesce(g, 0) > 0 THEN 'Partiel' ELSE 'Non couvert' END AS statut FROM o LEFT JOIN s USING (client_id, devise) LEFT JOIN g USING (client_id, devise) WHERE e > 0"""


def guarantees(spark, sf):
    """A quarter of the amount asked secures every loan of more than a year."""
    long = RP.situation(spark, sf).where("duree_credit_mois > 12")
    return long.select("client_id", "devise", (F.col("montant_demande") * 0.25).alias("valeur_garantie"))


@register("Q23_loan_coverage", COVER, ("v_situation", "v_savings"))
def q23(spark, sf):
    return Q.loan_coverage(RP.situation(spark, sf), V.savings(spark, sf), guarantees(spark, sf))


@register("R7_net_exposure", f"SELECT devise, {fsum('exposition_nette')} AS exposition_nette FROM ({COVER}) GROUP BY 1", ("v_situation", "v_savings"))
def r7c(spark, sf):
    return R.net_exposure(Q.loan_coverage(RP.situation(spark, sf), V.savings(spark, sf), guarantees(spark, sf)))


ENDS = Q.month_ends(dt.date(2000, 8, 1), 3)


@register("Q24_provisions", "\nUNION ALL\n".join(f"""
SELECT DATE '{e}' AS fin_mois, currency_code AS devise, count(*) AS prets, {fsum('loan_balance')} AS encours, {fsum('loan_balance', f"DATE '{e}' - due >= 30")} AS par_30,
  {fsum(f"loan_balance * CASE WHEN DATE '{e}' - due >= 180 THEN CAST(1 AS DOUBLE) WHEN DATE '{e}' - due >= 90 THEN CAST(0.5 AS DOUBLE) WHEN DATE '{e}' - due >= 30 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")} AS provision
FROM (SELECT *, CAST(created_at AS DATE) + 90 AS due FROM v_loans WHERE loan_balance > 0) WHERE CAST(created_at AS DATE) <= DATE '{e}' GROUP BY 2""" for e in ENDS), ("v_loans",))
def q24(spark, sf):
    loans = V.loans(spark, sf).select(F.col("currency_code").alias("devise"), F.col("loan_balance").alias("solde_final"), F.date_add(F.to_date("created_at"), 90).alias("due_date"),
                                      F.col("created_at").alias("date_demande"))
    return Q.provisions_at(loans, dt.date(2000, 8, 1))


@register("Q24_remaining_instalments", f"""
SELECT restantes, count(*) AS prets, {big('sum(n)')} AS echeances FROM (SELECT loan_id, count(*) AS n, {cnt("date_echeance > TIMESTAMP '2000-01-01'")} AS restantes FROM v_schedule GROUP BY 1) GROUP BY 1""", SCH)
def q24b(spark, sf):
    return Q.remaining_instalments(schedule(spark, sf), dt.date(2000, 1, 1))


@register("Q25_late_repayments", f"""
SELECT loan_id, count(*) AS paiements_tardifs, CAST(max(date_diff('day', date_echeance, date_paiement)) AS INT) AS retard_max, {fsum('rembourse')} AS montant FROM v_schedule WHERE date_paiement > date_echeance AND rembourse > 0 GROUP BY 1""", SCH)
def q25(spark, sf):
    return Q.late_repayments(schedule(spark, sf))


# --- cash desks and reviews -----------------------------------------------------------------------------------

def cash_counts(spark, sf):
    return V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("caisse"), F.to_date("l_shipdate").alias("jour"), F.col("l_quantity").alias("piece"),
                                                 F.col("l_linenumber").alias("nombre"))


def closings(spark, sf):
    counted = cash_counts(spark, sf).groupBy("caisse", "jour").agg(F.sum(F.col("piece").cast("decimal(20,6)") * F.col("nombre")).alias("s"))
    return counted.select("caisse", "jour", (F.col("s") + F.when(F.col("caisse") % 10 == 0, 5).otherwise(0)).cast("double").alias("solde"))


@register("Q26_cash_differences", f"""
SELECT l_suppkey AS caisse, CAST(l_shipdate AS DATE) AS jour, CAST(sum({m('l_quantity')} * l_linenumber) AS DOUBLE) + CASE WHEN l_suppkey % 10 = 0 THEN 5 ELSE 0 END AS solde, CAST(sum({m('l_quantity')} * l_linenumber) AS DOUBLE) AS billetage,
  CAST(CASE WHEN l_suppkey % 10 = 0 THEN 5 ELSE 0 END AS DOUBLE) AS ecart, l_suppkey % 10 <> 0 AS conforme FROM lineitem GROUP BY 1, 2""")
def q26(spark, sf):
    return Q.cash_differences(closings(spark, sf), cash_counts(spark, sf))


@register("Q26_missing_closings", """
SELECT s_suppkey AS caisse, CAST(d AS DATE) AS jour FROM supplier CROSS JOIN (SELECT unnest(generate_series(DATE '1998-01-01', DATE '1998-03-31', INTERVAL 1 DAY)) AS d)
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND CAST(l_shipdate AS DATE) = CAST(d AS DATE))""")
def q26b(spark, sf):
    desks = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("caisse"))
    return Q.missing_closings(closings(spark, sf), desks, dt.date(1998, 1, 1), dt.date(1998, 3, 31))


@register("Q27_review_movements", f"""
SELECT id_devise, CASE WHEN montant <= 0 THEN 'Montant nul ou negatif' WHEN sens IS NULL THEN 'Sens absent' ELSE 'Superieur au seuil' END AS motif, count(*) AS mouvements, {fsum('montant')} AS montant FROM v_ledger WHERE montant <= 0 OR sens IS NULL OR montant >= 80000 GROUP BY 1, 2""", LED)
def q27(spark, sf):
    return Q.review_movements(V.ledger(spark, sf), 80000)


@register("Q27_large_movements", f"""
SELECT strftime(date_operation, '%Y-%m') AS mois, id_devise, count(*) AS mouvements, count(DISTINCT operation_id) AS operations, {fsum('montant')} AS montant FROM v_ledger WHERE montant >= 80000 GROUP BY 1, 2""", LED)
def q27b(spark, sf):
    return Q.large_movements(V.ledger(spark, sf), 80000)


