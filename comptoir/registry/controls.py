"""Registered queries of operations, watchlists, quality, joins, sets and file jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from comptoir.functions import labels as L
from comptoir.operators import aml as A
from comptoir.operators import joins as J
from comptoir.operators import portfolio as P
from comptoir.operators import quality as Q
from comptoir.operators import rules as R
from comptoir.operators import watchlists as WL
from comptoir.registry import portfolio as RP
from comptoir.registry import views as V
from comptoir.registry.base import register
from comptoir.registry.sqltext import M, NA_LIST, avg, big, cnt, div, dsum, fsum, m, norm, squeeze, strip
from comptoir.session import scratch_path
from comptoir.sources import contracts as K
from comptoir.sources import files as S

OPS = ("v_operations",)
CLI = ("v_clients",)
STD = ("v_std",)
ACC = ("v_accounts",)

# --- ledger, members, operations ------------------------------------------------------------------------------


def raw_ledger(spark, sf):
    back = {v: k for k, v in A.LEDGER_HEADERS.items()}
    led = V.ledger(spark, sf)
    return led.toDF(*[back.get(c, c) for c in led.columns])


def raw_members(spark, sf):
    """Members hold the accounts whose key is even."""
    key = F.col("client_id")
    return V.clients(spark, sf).select(
        key.alias("CODE"), F.col("nom_client").alias("NOM_ADHERENT"),
        F.when(key % 2 == 0, key).alias("ID_COMPTE_ADHERENT"), F.col("categorie").alias("ID_TYPE_ADHERENT"),
        F.col("agent_credit").alias("ID_GESTIONNAIRE"), F.col("agence").alias("ID_POINT_SERVICE"),
        F.col("droit_paye").cast("string").alias("DROIT_PAYE"), F.col("est_valide").cast("string").alias("EST_VALIDE"))


def raw_operations(spark, sf):
    key = F.col("operation_id")
    day = F.col("date_operation")
    return V.operations(spark, sf).select(
        key.alias("ID"), F.col("type_operation").alias("ID_TYPE_OPERATION"), day.alias("DATE_OPERATION"),
        (day + F.make_dt_interval(days=F.col("saisie_jours"))).alias("DATE_SAISIE"),
        F.when(key % 7 == 0, None).when(key % 11 == 0, day - F.expr("INTERVAL 1 DAY")).otherwise(day + F.expr("INTERVAL 1 DAY")).alias("DATE_VALIDATION"),
        (day + F.expr("INTERVAL 2 DAYS")).alias("DATE_VALIDE"),
        F.when(F.col("annule"), "VRAI").otherwise("0").alias("ANNULE"), F.col("numero_recu").alias("NUMERO_RECU"),
        F.concat(F.lit("N"), (key / 2).cast("bigint").cast("string")).alias("NUM_TRANSACTION"),
        F.col("operateur").alias("ID_UTILISATEUR"), F.col("validateur").alias("ID_UTILISATEUR_VALIDE"),
        F.when(key % 6 == 0, None).otherwise(F.col("agence")).alias("ID_POINT_SERVICE"))


V.VIEW_SQL["v_members"] = """
SELECT CASE WHEN client_id % 2 = 0 THEN client_id END AS compte_adherent, min_by(client_id, client_id) AS client_id, min_by(nom_client, client_id) AS nom_client,
  min_by(kyc, client_id) AS kyc_missing_count, min_by(est_valide, client_id) AS est_valide, min_by(droit_paye, client_id) AS droit_paye
FROM (SELECT *, CAST(agent_credit IS NULL AS INT) + CAST(NOT est_valide AS INT) + CAST(NOT droit_paye AS INT) AS kyc FROM v_clients) GROUP BY 1
"""
V.VIEW_USES["v_members"] = CLI
V.VIEW_SQL["v_summary"] = f"""
SELECT operation_id, count(*) AS nb_ecritures, max(abs(montant)) AS montant_operation, {fsum('abs(montant)', "sens = 'D'")} AS total_debit,
  {fsum('abs(montant)', "sens = 'C'")} AS total_credit,
  coalesce(min(compte_id) FILTER (WHERE compte_id IN (SELECT compte_adherent FROM v_members)), min(compte_id)) AS compte_id, min(id_devise) AS id_devise,
  {cnt('CAST(date_valeur AS DATE) <> CAST(date_operation AS DATE)')} AS ecarts_date_valeur, {cnt("coalesce(sens, '') = ''")} AS lignes_sens_absent,
  {cnt('coalesce(montant, 0) <= 0')} AS lignes_montant_non_positif,
  CAST(abs({dsum('abs(montant)', "sens = 'D'")} - {dsum('abs(montant)', "sens = 'C'")}) AS DOUBLE) AS ecart_debit_credit,
  abs({dsum('abs(montant)', "sens = 'D'")} - {dsum('abs(montant)', "sens = 'C'")}) <= CAST(0.01 AS {M}) AS equilibre_comptable_ok,
  CASE min(id_devise) WHEN 1 THEN 'USD' WHEN 2 THEN 'CDF' END AS code_devise
FROM v_ledger GROUP BY 1
"""
V.VIEW_USES["v_summary"] = ("v_ledger", "v_members")


@register("A1_ledger_summary", "SELECT * FROM v_summary", ("v_summary",))
def a1(spark, sf):
    people = A.prepare_members(A.renamed(raw_members(spark, sf), A.MEMBER_HEADERS))
    return A.ledger_summary(A.renamed(raw_ledger(spark, sf), A.LEDGER_HEADERS), people)


@register("A2_members", "SELECT * FROM v_members", ("v_members",))
def a2(spark, sf):
    out = A.prepare_members(A.renamed(raw_members(spark, sf), A.MEMBER_HEADERS))
    return out.select("compte_adherent", "client_id", "nom_client", "kyc_missing_count", "est_valide", "droit_paye")


@register("J6_operations_dataset", """
WITH o AS (SELECT *, date_operation + to_days(saisie_jours) AS date_saisie,
    CASE WHEN operation_id % 7 = 0 THEN NULL WHEN operation_id % 11 = 0 THEN date_operation - INTERVAL 1 DAY ELSE date_operation + INTERVAL 1 DAY END AS date_validation,
    date_operation + INTERVAL 2 DAY AS date_valide FROM v_operations)
SELECT CAST(o.operation_id AS VARCHAR) AS operation_id, o.source_mouvement, o.type_operation, m.client_id, m.nom_client, m.kyc_missing_count, s.compte_id, s.nb_ecritures,
  s.montant_operation, s.code_devise, s.equilibre_comptable_ok, CASE WHEN o.operation_id % 6 <> 0 THEN o.agence END AS agence, o.saisie_jours AS delai_saisie_jours,
  o.saisie_jours > 0 AS saisie_tardive, coalesce(date_valide < date_saisie, false) OR coalesce(date_validation < date_operation, false) AS validation_incoherente,
  NOT annule AND (date_validation IS NULL OR date_valide IS NULL) AS operation_non_validee, operateur = validateur AS auto_validation, annule
FROM o LEFT JOIN v_summary s ON s.operation_id = o.operation_id LEFT JOIN v_members m ON m.compte_adherent = s.compte_id""", ("v_operations", "v_summary"))
def j6(spark, sf):
    ops, lines, people = raw_operations(spark, sf), raw_ledger(spark, sf), raw_members(spark, sf)
    api = ops.withColumnRenamed("ID", "CODE")
    return A.operations_dataset(ops, lines, people, api, lines).select(
        "operation_id", "source_mouvement", "type_operation", "client_id", "nom_client", "kyc_missing_count", "compte_id", "nb_ecritures",
        "montant_operation", "code_devise", "equilibre_comptable_ok", "agence", "delai_saisie_jours", "saisie_tardive", "validation_incoherente",
        "operation_non_validee", "auto_validation", "annule")


V.VIEW_SQL["v_live"] = """
SELECT *, CASE type_operation WHEN 'DEPO' THEN 'Depot' WHEN 'RETR' THEN 'Retrait' WHEN 'MOB_DEPO' THEN 'Depot mobile' ELSE 'Retrait mobile' END AS type_mouvement,
  CASE WHEN code_devise = 'CDF' THEN montant_operation ELSE montant_operation * 20 END AS montant_reporting_cdf FROM v_operations WHERE NOT annule
"""
V.VIEW_USES["v_live"] = OPS
RATE = 20.0  # keeps both sides of every threshold populated in the given tables
LIVE = ("v_live",)
HIGH, MID = f"CAST(200000 AS {M})", f"CAST(100000 AS {M})"
X_ = m("montant_reporting_cdf")


@register("A3_regulatory_lines", "\nUNION ALL\n".join(f"""
SELECT '{s}' AS section, {n} AS ligne_excel, '{r}' AS rubrique, {cnt(w)} AS nombre, {fsum('montant_reporting_cdf', w)} AS volume_cdf FROM v_live""" for s, n, r, w in (
    ("1. ACTIVITE", 25, "Total Depots", "type_mouvement LIKE 'Depot%'"),
    ("1. ACTIVITE", 26, "Total Retraits", "type_mouvement LIKE 'Retrait%'"),
    ("3. PRODUIT - SERVICE - OPERATIONS", 53, "Depot >= 10k USD", f"type_mouvement LIKE 'Depot%' AND {X_} >= {HIGH}"),
    ("3. PRODUIT - SERVICE - OPERATIONS", 54, "Retrait >= 10k USD", f"type_mouvement LIKE 'Retrait%' AND {X_} >= {HIGH}"),
    ("3. PRODUIT - SERVICE - OPERATIONS", 55, "Depot >= 5k USD et < 10k USD", f"type_mouvement LIKE 'Depot%' AND {X_} >= {MID} AND {X_} < {HIGH}"),
    ("3. PRODUIT - SERVICE - OPERATIONS", 56, "Retrait >= 5k USD et < 10k USD", f"type_mouvement LIKE 'Retrait%' AND {X_} >= {MID} AND {X_} < {HIGH}"),
    ("4. CANAUX DE DISTRIBUTION", 132, "Operations effectuees par Mobile Banking", "source_mouvement = 'API_MOBILE'"),
    ("4. CANAUX DE DISTRIBUTION", 134, "Wallet to Bank", "type_operation = 'MOB_DEPO'"))), LIVE)
def a3(spark, sf):
    return A.regulatory_lines(V.operations(spark, sf), RATE)


@register("A4_structuring", f"""
SELECT * FROM (SELECT CAST(date_trunc('month', date_operation) AS TIMESTAMP) AS date_operation, client_id, nom_client, type_mouvement, code_devise, count(DISTINCT operation_id) AS nb_operations,
  {fsum('montant_reporting_cdf')} AS montant_cumule_cdf, CAST(max({X_}) AS DOUBLE) AS montant_max_unitaire_cdf FROM v_live GROUP BY 1, 2, 3, 4, 5)
WHERE nb_operations >= 2 AND montant_max_unitaire_cdf < 200000 AND montant_cumule_cdf >= 200000""", LIVE)
def a4(spark, sf):
    monthly = V.operations(spark, sf).withColumn("date_operation", F.date_trunc("month", "date_operation").cast("timestamp_ntz"))
    return A.structuring(monthly, RATE)


@register("A5_unusual_activity", f"""
WITH b AS (SELECT CAST(CAST(max(date_operation) AS DATE) - 89 AS TIMESTAMP) AS d FROM v_live),
c AS (SELECT client_id, nom_client, count(DISTINCT operation_id) AS nb_operations_periode, {dsum('montant_reporting_cdf')} AS s FROM v_live WHERE date_operation >= (SELECT d FROM b) GROUP BY 1, 2),
h AS (SELECT client_id, {div(dsum('montant_reporting_cdf'), 'count(DISTINCT date_operation)')} AS moy FROM v_live WHERE date_operation < (SELECT d FROM b) GROUP BY 1)
SELECT c.client_id, nom_client, nb_operations_periode, CAST(s AS DOUBLE) AS volume_periode_cdf, moy AS moyenne_journaliere_historique_cdf, CAST(s AS DOUBLE) / nullif(moy, 0) AS multiple_vs_moyenne_historique
FROM c LEFT JOIN h ON c.client_id IS NOT DISTINCT FROM h.client_id WHERE s >= {HIGH} AND (moy IS NULL OR CAST(s AS DOUBLE) >= moy * 3)""", LIVE)
def a5(spark, sf):
    return A.unusual_activity(V.operations(spark, sf), RATE)


@register("A6_high_activity_kyc", f"""
SELECT client_id, nom_client, count(DISTINCT operation_id) AS nb_operations, min(categorie) AS type_client, min(agence) AS agence_client, min(agent_credit) AS agent_credit,
  bool_or(est_valide) AS est_valide, bool_or(droit_paye) AS droit_paye, 0 AS kyc_missing_count, {fsum('montant_reporting_cdf')} AS volume_lignes_cdf
FROM v_live GROUP BY 1, 2 HAVING {dsum('montant_reporting_cdf')} >= {HIGH} AND (min(agent_credit) IS NULL OR NOT bool_or(est_valide) OR NOT bool_or(droit_paye))""", LIVE)
def a6(spark, sf):
    ops = V.operations(spark, sf).withColumns({"type_client": F.col("categorie"), "agence_client": F.col("agence")})
    return A.high_activity_kyc(ops, RATE)


MOVES = f"""SELECT client_id, nom_client, {cnt("type_mouvement LIKE 'Depot%'")} AS nb_depots, {fsum('montant_reporting_cdf', "type_mouvement LIKE 'Depot%'")} AS volume_depots_cdf,
  {cnt("type_mouvement LIKE 'Retrait%'")} AS nb_retraits, {fsum('montant_reporting_cdf', "type_mouvement LIKE 'Retrait%'")} AS volume_retraits_cdf,
  count(DISTINCT operation_id) AS nb_operations, {dsum('montant_reporting_cdf')} AS s, max(montant_reporting_cdf) AS plus_grosse_operation_cdf FROM v_live GROUP BY 1, 2"""


@register("A7_client_movements", f"SELECT * EXCLUDE (s, plus_grosse_operation_cdf), CAST(s AS DOUBLE) AS volume_total_cdf FROM ({MOVES})", LIVE)
def a7(spark, sf):
    return A.client_summary(V.operations(spark, sf), RATE)


@register("A8_top_clients", f"SELECT * EXCLUDE (s), CAST(s AS DOUBLE) AS volume_total_cdf FROM ({MOVES}) ORDER BY s DESC, client_id, nom_client LIMIT 50", LIVE)
def a8(spark, sf):
    return A.top_clients(V.operations(spark, sf), RATE)


@register("A9_cancelled_operations", "SELECT operation_id, client_id, date_operation, operateur FROM v_operations WHERE annule", OPS)
def a9(spark, sf):
    return A.cancelled_operations(V.operations(spark, sf)).select("operation_id", "client_id", "date_operation", "operateur")


def flagged_operations(spark, sf):
    return V.operations(spark, sf).withColumns({
        "saisie_tardive": F.col("saisie_jours") > 0, "auto_validation": F.col("operateur") == F.col("validateur")})


@register("A10_risky_users", f"""
SELECT operateur, count(DISTINCT operation_id) AS nb_operations, {cnt('annule')} AS nb_annulations, {cnt('saisie_jours > 0')} AS nb_saisies_tardives, {cnt('operateur = validateur')} AS nb_auto_validations,
  count(DISTINCT agence) AS nb_points_service, count(DISTINCT type_operation) AS nb_types_operation FROM v_operations GROUP BY 1
HAVING count(DISTINCT operation_id) >= 50 OR {cnt('annule')} > 0 OR {cnt('saisie_jours > 0')} >= 10 OR {cnt('operateur = validateur')} > 0""", OPS)
def a10(spark, sf):
    return A.risky_users(flagged_operations(spark, sf))


@register("A11_service_points", f"""
WITH g AS (SELECT agence, type_operation, count(DISTINCT operation_id) AS nb_operations, {cnt('annule')} AS nb_annulations, {cnt('saisie_jours > 0')} AS nb_saisies_tardives FROM v_operations GROUP BY 1, 2)
SELECT *, nb_operations >= (SELECT quantile_cont(nb_operations, 0.9) FROM g) AS a_relire_en_priorite FROM g""", OPS)
def a11(spark, sf):
    return A.service_points(flagged_operations(spark, sf))


@register("A12_mobile_summary", f"""
SELECT type_operation, agence, strftime(date_operation, '%Y-%m') AS mois, count(DISTINCT operation_id) AS nb_operations, count(*) AS nb_lignes_comptables,
  {fsum('montant_operation', "type_operation = 'MOB_RETR'")} AS total_debit, {fsum('montant_operation', "type_operation = 'MOB_DEPO'")} AS total_credit, {cnt('annule')} AS nb_annulees
FROM v_operations WHERE source_mouvement = 'API_MOBILE' GROUP BY 1, 2, 3""", OPS)
def a12(spark, sf):
    return A.mobile_summary(V.operations(spark, sf).withColumn("sens", F.when(F.col("type_operation") == "MOB_DEPO", "C").otherwise("D")))


@register("A13_operation_count", """
SELECT agence, CASE WHEN count(k) > 0 THEN count(DISTINCT k) ELSE count(*) END AS nb_operations FROM (SELECT agence, CASE WHEN agence <> 'NATION_3' THEN client_id END AS k FROM v_operations) GROUP BY 1""", OPS)
def a13(spark, sf):
    ops = V.operations(spark, sf).select("agence", F.when(F.col("agence") != "NATION_3", F.col("client_id")).alias("operation_id"))
    return ops.groupBy("agence").agg(A.operation_count().alias("nb_operations"))


@register("A48_mobile_operations_by_type", f"""
SELECT type_operation, {big('count(DISTINCT operation_id)')} AS nb_operations FROM v_operations WHERE source_mouvement = 'API_MOBILE' GROUP BY 1""", OPS)
def a48b(spark, sf):
    return P.mobile_operations_by_type(A.mobile_summary(V.operations(spark, sf)))


# --- watchlists -----------------------------------------------------------------------------------------------

LOAN_LABELS = ("Avance sur salaire", "Crédit auto", "Prêt personnel", "Lisungi", "Autre")
V.VIEW_SQL["v_credit"] = f"""
SELECT * REPLACE ([{', '.join(f"'{x}'" for x in LOAN_LABELS)}][CAST(dossier_id % 5 AS INT) + 1] AS type_produit), CASE WHEN dossier_id % 4 = 0 THEN ' ' ELSE 'Oui' END AS garantie,
  CAST(2 + dossier_id % 4 AS DOUBLE) AS taux_interet FROM v_std
"""
V.VIEW_USES["v_credit"] = STD


def credit_files(spark, sf):
    key = F.col("dossier_id")
    return V.standard(spark, sf).withColumns({
        "type_produit": F.element_at(F.array(*[F.lit(x) for x in LOAN_LABELS]), (key % 5 + 1).cast("int")),
        "garantie": F.when(key % 4 == 0, " ").otherwise("Oui"), "taux_interet": (2 + key % 4).cast("double")})


def sql_reasons(*pairs: tuple[str, str]) -> str:
    parts = ", ".join(f"CASE WHEN {w} THEN '{label.replace(chr(39), chr(39) * 2)}' END" for w, label in pairs)
    return f"nullif(concat_ws('; ', {parts}), '')"


PROD = ("CASE dossier_id % 5 WHEN 0 THEN 'avance_salaire' WHEN 1 THEN 'auto' WHEN 2 THEN 'personnel' WHEN 3 THEN 'lisungi' END")


def _lim(pos, sign, col):
    tests = [f"({PROD} = '{p}' AND {col} {sign} {v[pos]})" for p, v in WL.PRODUCT_LIMITS.items()
             if v[pos] is not None and p in ("avance_salaire", "auto", "personnel", "lisungi")]
    return " OR ".join(tests)


CREDIT_SQL = sql_reasons(
    ("niveau_risque_calcule = 'Élevé'", "Risque élevé"), ("retard_jours > 30", "Retard > 30 jours"), ("capacite_remboursement < 0", "Capacité négative"),
    ("revenu_mensuel IS NULL OR charge_mensuelle IS NULL", "Données financières incomplètes"), (f"{PROD} IS NOT NULL AND trim(garantie) = ''", "Garantie non renseignée"),
    (f"{_lim(0, '<', 'montant_demande')} OR {_lim(1, '>', 'montant_demande')}", "Montant hors référentiel produit"),
    ("dossier_id % 5 = 0 AND revenu_mensuel > 0 AND montant_demande > revenu_mensuel / CAST(3 AS DOUBLE)", "Avance sur salaire > 1/3 du salaire"),
    (f"{_lim(2, '<', 'duree_credit_mois')} OR {_lim(3, '>', 'duree_credit_mois')}", "Durée hors référentiel produit"),
    (f"{_lim(4, '<', 'taux_interet')} OR {_lim(5, '>', 'taux_interet')}", "Taux hors référentiel produit"))


@register("D1_credit_watchlist", f"""
SELECT * FROM (SELECT dossier_id, {PROD} AS produit_reference, {CREDIT_SQL} AS motif_alerte FROM v_credit) WHERE motif_alerte IS NOT NULL""", ("v_credit",))
def d1(spark, sf):
    return WL.cycle_watchlist(credit_files(spark, sf), "credit").select("dossier_id", "produit_reference", "motif_alerte")


@register("T9_reason_counts", f"""
SELECT r AS motif_alerte, count(*) AS nombre_lignes FROM (SELECT unnest(string_split({CREDIT_SQL}, '; ')) AS r FROM v_credit) GROUP BY 1""", ("v_credit",))
def t9(spark, sf):
    return R.reason_counts(WL.credit_watchlist(credit_files(spark, sf)))


@register("A30_activity_with_alerts", f"""
SELECT agence, lignes, alertes, CAST(s AS DOUBLE) AS montant_total FROM (SELECT agence, count(*) AS lignes, {cnt(f'{CREDIT_SQL} IS NOT NULL')} AS alertes,
  {dsum('montant_demande + solde_final')} AS s FROM v_credit GROUP BY 1)""", ("v_credit",))
def a30(spark, sf):
    files = credit_files(spark, sf)
    flagged = WL.credit_work(files).withColumn("alerte", R.any_of(WL.credit_rules(files)))
    return P.activity(flagged, "agence", ["montant_demande", "solde_final"], F.col("alerte"))


COMPLIANCE_RULES_SQL = sql_reasons(
    ("statut_couverture = 'NON_COUVERT'", "Rubrique non couverte"), ("statut_couverture = 'PARTIEL'", "Couverture partielle à valider"),
    ("statut_revue = 'A_REVOIR'", "Alerte à revoir"), ("etat IS NULL", "État de l'alerte manquant"), ("numero_alerte IS NULL", "Numéro d'alerte manquant"),
    ("severite = 'CRITIQUE'", "Anomalie de qualité prioritaire"), ("type_element = 'Controle qualite' AND nombre > 0", "Anomalies de données détectées"),
    ("indicateurs = 'Fractionnement'", "Opération fractionnée"), ("indicateurs LIKE '%Gel des fonds%'", "Opération liée à un gel de fonds"),
    ("indicateurs LIKE '%Haut risque%'", "Opération à haut risque"), ("devise IS NULL", "Devise manquante"))


@register("D2_compliance_watchlist", f"""
SELECT * FROM (SELECT ligne_id, {COMPLIANCE_RULES_SQL} AS motif_alerte FROM v_conformite) WHERE motif_alerte IS NOT NULL""", ("v_conformite",))
def d2a(spark, sf):
    return WL.cycle_watchlist(V.compliance(spark, sf), "conformite").select("ligne_id", "motif_alerte")


DIGITS = "regexp_replace(coalesce(telephone, ''), '[^0-9]', '', 'g')"
CRM_WORK = f"""
crm AS (SELECT *, {DIGITS} AS dg, date_diff('day', date_operation, (SELECT max(date_operation) FROM v_accounts)) AS idle FROM v_accounts),
shared AS (SELECT dg, count(DISTINCT client_id) AS n FROM crm WHERE dg <> '' GROUP BY 1)"""


@register("D2_crm_watchlist", f"""WITH {CRM_WORK}
SELECT * FROM (SELECT compte_id, {sql_reasons(("trim(coalesce(agent_credit, '')) = ''", "Gestionnaire non renseigné"), ("CAST(compte_id AS VARCHAR) = '0'", "Numéro de compte client manquant"),
  ("idle IS NULL", "Dernière activité non renseignée"), ("idle >= 90", "Aucune activité récente >= 90 j"), ("idle >= 180", "Aucune activité récente >= 180 j"),
  ("trim(coalesce(telephone, '')) = ''", "Téléphone manquant"), ("trim(coalesce(telephone, '')) <> '' AND NOT regexp_matches(crm.dg, '^(243[0-9]{9}|0[0-9]{9})$')", "Téléphone non fiable"),
  ("coalesce(n, 0) > 1", "Téléphone partagé"))} AS motif_alerte FROM crm LEFT JOIN shared ON shared.dg = crm.dg) WHERE motif_alerte IS NOT NULL""", ACC)
def d2b(spark, sf):
    return WL.cycle_watchlist(RP.accounts(spark, sf), "crm_clients").select("compte_id", "motif_alerte")


KYC_N = ("(CAST(trim(coalesce(telephone, '')) = '' AS INT) + CAST(trim(coalesce(zone_geographique, '')) = '' AS INT) + CAST(trim(coalesce(sexe, '')) = '' AS INT)"
         " + CAST(trim(coalesce(categorie, '')) = '' AS INT) + CAST(date_operation IS NULL AS INT))")


@register("D2_savings_watchlist", f"""WITH {CRM_WORK},
acc AS (SELECT client_id, count(DISTINCT compte_id) AS na FROM v_accounts GROUP BY 1),
lim AS (SELECT quantile_cont(solde_compte, 0.9) AS q FROM v_accounts WHERE solde_compte > 0)
SELECT * FROM (SELECT compte_id, {sql_reasons(("solde_compte < 0", "Solde négatif"), ("idle >= 90", "Compte inactif >= 90 j"), ("idle >= 180", "Compte très inactif >= 180 j"),
  ("idle >= 90 AND solde_compte >= (SELECT q FROM lim)", "Dormance sur solde significatif"), ("trim(coalesce(telephone, '')) = ''", "Téléphone manquant"),
  ("trim(coalesce(telephone, '')) <> '' AND NOT regexp_matches(dg, '^(243[0-9]{9}|0[0-9]{9})$')", "Téléphone non fiable"), (f"{KYC_N} >= 2", "KYC incomplet (2+ champs)"),
  ("na >= 3", "Client multi-comptes (>= 3)"), ("sexe IS NOT NULL AND lower(sexe) <> lower(categorie)", "Incohérence sexe / catégorie"))} AS motif_alerte
  FROM crm JOIN acc USING (client_id)) WHERE motif_alerte IS NOT NULL""", ACC)
def d2c(spark, sf):
    return WL.cycle_watchlist(RP.accounts(spark, sf), "epargne").select("compte_id", "motif_alerte")


@register("D2_operations_watchlist", f"""WITH d AS (SELECT numero_recu, count(*) AS n FROM v_operations GROUP BY 1)
SELECT * FROM (SELECT operation_id, {sql_reasons(("saisie_jours > 0", "Saisie tardive"), ("operateur = validateur", "Auto-validation"), ("annule", "Opération annulée"), ("n > 1", "Reçu dupliqué"))} AS motif_alerte
  FROM v_operations JOIN d USING (numero_recu)) WHERE motif_alerte IS NOT NULL""", OPS)
def d2d(spark, sf):
    return WL.cycle_watchlist(flagged_operations(spark, sf), "operations_depot_retrait").select("operation_id", "motif_alerte")


@register("D2_other_cycles_watchlist", f"""
SELECT 'caisse' AS cycle, o_orderkey AS id, {sql_reasons(("o_orderkey % 7 = 0", "Caissier non renseigné"), ("o_orderkey % 5 = 0", "Écart de caisse"), ("o_orderkey % 3 = 0", "Encaisse négative"))} AS motif_alerte FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0
UNION ALL SELECT 'tresorerie', o_orderkey, {sql_reasons(("o_orderkey % 7 = 0", "Banque non renseignée"), ("o_orderkey % 5 = 0", "Écart de rapprochement"), ("o_orderkey % 3 = 0", "Solde bancaire négatif"))} FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0
UNION ALL SELECT 'comptable', o_orderkey, {sql_reasons(("o_orderkey % 7 = 0", "Journal non renseigné"), ("o_orderkey % 5 = 0", "Écriture non équilibrée"))} FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0
UNION ALL SELECT 'rh_admin', o_orderkey, {sql_reasons(("o_orderkey % 7 = 0", "Fonction manquante"), ("o_orderkey % 3 = 0", "Salaire non documenté"))} FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 3 = 0
UNION ALL SELECT 'si', o_orderkey, {sql_reasons(("o_orderkey % 7 = 0", "Profil d''accès manquant".replace("''", "'")),)} FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'continuite', o_orderkey, {sql_reasons(("o_orderkey % 7 = 0", "Support non renseigné"), ("o_orderkey % 3 = 0", "Incident majeur déclaré"))} FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 3 = 0
UNION ALL SELECT 'money_provider', o_orderkey, {sql_reasons(("o_orderkey % 7 = 0", "Opérateur non renseigné"), ("o_orderkey % 3 = 0", "Solde final négatif"))} FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 3 = 0""")
def d2e(spark, sf):
    key = F.col("o_orderkey")
    orders = V.table(spark, sf, "orders").select(key.alias("id"), "o_totalprice")
    k, price = F.col("id"), F.col("o_totalprice")
    gone = F.when(k % 7 == 0, " ").otherwise("ok")
    gap = F.when(k % 5 == 0, price).otherwise(0.0)
    low = F.when(k % 3 == 0, -price).otherwise(price)
    cycles = {
        "caisse": {"caissier": gone, "ecart_caisse": gap, "encaisse_fin_jour": low},
        "tresorerie": {"banque": gone, "ecart_rapprochement": gap, "solde_banque": low},
        "comptable": {"journal": gone, "montant_debit": price, "montant_credit": price + gap},
        "rh_admin": {"fonction": gone, "salaire": low},
        "si": {"profil_acces": gone},
        "continuite": {"support_sauvegarde": gone, "incident_majeur": F.when(k % 3 == 0, "Panne").otherwise("Non")},
        "money_provider": {"operateur": gone, "solde_final": low},
    }
    parts = [WL.cycle_watchlist(orders.withColumns(cols), c).select(F.lit(c).alias("cycle"), "id", "motif_alerte") for c, cols in cycles.items()]
    return J.union_all(parts)


@register("D3_crm_actions", f"""WITH {CRM_WORK}
SELECT compte_id, {sql_reasons(("trim(coalesce(telephone, '')) = ''", "ajouter le téléphone"), ("trim(coalesce(telephone, '')) <> '' AND NOT regexp_matches(crm.dg, '^(243[0-9]{9}|0[0-9]{9})$')", "corriger le téléphone"),
  ("true", "ajouter l'e-mail"), ("compte_id % 5 = 0", "ajouter la pièce"), ("CAST(compte_id AS VARCHAR) = '0'", "renseigner le compte client"), ("agent_credit IS NULL", "affecter un gestionnaire"),
  ("idle IS NULL", "mettre à jour la dernière activité"), ("idle >= 180", "relancer le client inactif"), ("coalesce(n, 0) > 1", "vérifier le téléphone partagé"))} AS lecture
FROM crm LEFT JOIN shared ON shared.dg = crm.dg WHERE trim(coalesce(telephone, '')) = '' OR NOT regexp_matches(crm.dg, '^(243[0-9]{{9}}|0[0-9]{{9}})$') OR compte_id % 5 = 0 OR agent_credit IS NULL OR idle IS NULL OR coalesce(n, 0) > 1""", ACC)
def d3(spark, sf):
    piece = F.when(F.col("compte_id") % 5 == 0, "0").otherwise(F.concat(F.lit("P"), F.col("client_id").cast("string")))
    return WL.crm_actions(RP.accounts(spark, sf).withColumn(WL.ID_DOCUMENT, piece)).select("compte_id", "lecture")


@register("J7_group_statistics", f"""
SELECT c.client_id, coalesce(n, 0) AS clients_par_telephone, k AS comptes_meme_agence FROM v_clients c
LEFT JOIN (SELECT telephone, count(DISTINCT client_id) AS n FROM v_clients WHERE telephone IS NOT NULL GROUP BY 1) t USING (telephone)
LEFT JOIN (SELECT agence, count(*) AS k FROM v_clients GROUP BY 1) a ON a.agence = c.agence""", CLI)
def j7(spark, sf):
    c = V.clients(spark, sf)
    return Q.count_over(Q.distinct_over(c, "telephone", "client_id", "clients_par_telephone"), ["agence"], "comptes_meme_agence").select(
        "client_id", "clients_par_telephone", "comptes_meme_agence")


# --- quality --------------------------------------------------------------------------------------------------

CLIENT_COLUMNS = ("client_id", "nom_client", "categorie", "agence", "zone_geographique", "solde_compte", "telephone", "devise", "sexe", "age",
                  "est_valide", "droit_paye", "agent_credit")


@register("A14_missing_profile", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS colonne, {cnt(f'{c} IS NULL')} AS valeurs_manquantes, {div(cnt(f'{c} IS NULL'), 'count(*)')} AS taux_manquant FROM v_clients" for c in CLIENT_COLUMNS), CLI)
def a14(spark, sf):
    return Q.missing_profile(V.clients(spark, sf))


def _missing_sql(column, absent=False):
    miss = "count(*)" if absent else cnt(f"coalesce(lower(trim(CAST({column} AS VARCHAR))), '') IN ({NA_LIST})")
    pct = f"round({div(miss, 'count(*)')} * 100, 2)"
    dec = "'Colonne absente'" if absent else f"CASE WHEN {pct} = 0 THEN 'OK' WHEN {pct} <= 5 THEN 'Acceptable' WHEN {pct} <= 20 THEN 'A surveiller' ELSE 'Prioritaire' END"
    return (f"SELECT '{column}' AS variable, '{'Absente' if absent else 'Présente'}' AS presence, count(*) AS total_lignes, count(*) - {miss} AS renseignees, "
            f"{miss} AS manquantes, {pct} AS pct_manquant, {dec} AS decision FROM v_clients")


FOLLOWED = ("telephone", "sexe", "agent_credit", "agence")


@register("A15_missing_analysis", "\nUNION ALL\n".join([_missing_sql(c) for c in FOLLOWED] + [_missing_sql("email", True)]), CLI)
def a15(spark, sf):
    return Q.missing_analysis(V.clients(spark, sf), [*FOLLOWED, "email"])


@register("A15_missing_by_specification", "SELECT *, CASE variable WHEN 'sexe' THEN 'Profil' ELSE 'Contact' END AS bloc FROM (" + "\nUNION ALL\n".join(
    [_missing_sql("sexe"), _missing_sql("telephone"), _missing_sql("email", True)]) + ")", CLI)
def a15b(spark, sf):
    spec = spark.createDataFrame([("sexe", "Profil"), (" telephone", "Contact"), ("email", "Contact")], "variable string, bloc string")
    return Q.missing_by_specification(V.clients(spark, sf), spec)


@register("A16_completeness", f"""
WITH e AS (SELECT DISTINCT upper(c_name) AS v FROM customer), o AS (SELECT DISTINCT 'CUSTOMER#' || lpad(o_custkey::VARCHAR, 9, '0') AS v FROM orders)
SELECT count(*) AS nb_attendus, {cnt('o.v IS NOT NULL')} AS nb_recus, round({div(cnt('o.v IS NOT NULL'), 'count(*)')} * 100, 2) AS completude_pct,
  round({div(cnt('o.v IS NOT NULL'), 'count(*)')} * 100, 2) >= 50 AS respecte_seuil FROM e LEFT JOIN o ON e.v = o.v""")
def a16(spark, sf):
    served = V.table(spark, sf, "orders").select(F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("nom"))
    return Q.completeness(V.table(spark, sf, "customer"), "c_name", served, "nom", 50)


@register("A17_quality_checks", "\nUNION ALL\n".join(
    f"SELECT '{label}' AS controle, {n} AS nombre_lignes, {div(n, '(SELECT count(*) FROM v_std)')} AS taux_lignes FROM v_std" for label, n in (
        ("Clients sans identifiant", cnt("client_id IS NULL")), ("Dossiers dupliqués", "CAST(0 AS BIGINT)"), ("Dossiers sans identifiant", cnt("dossier_id IS NULL")),
        ("Dossiers sans statut", cnt("statut_dossier IS NULL")), ("Montants demandés négatifs", cnt("montant_demande < 0")), ("Montants accordés négatifs", cnt("montant_accorde < 0")),
        ("Montants accordés supérieurs au demandé", cnt("montant_accorde > montant_demande")), ("Données financières manquantes", cnt("revenu_mensuel IS NULL OR charge_mensuelle IS NULL")),
        ("Retards négatifs", cnt("retard_jours < 0")), ("Capacité de remboursement négative", cnt("capacite_remboursement < 0")))).replace(
            "AS nombre_lignes, (CAST(CAST(0", "AS nombre_lignes, (CAST(CAST(0").replace("CAST(0 AS BIGINT) AS nombre_lignes", "any_value(CAST(0 AS BIGINT)) AS nombre_lignes"), STD)
def a17(spark, sf):
    return Q.quality_checks(V.standard(spark, sf))





def _token(c):
    return f"nullif({squeeze(f'lower(CAST({c} AS VARCHAR))')}, '')"


PROFILED = ("p_name", "p_brand", "p_type", "p_size")
PROFILE_SQL = "\nUNION ALL\n".join(f"SELECT {i + 1} AS position, '{c}' AS colonne, {_token(c)} AS t FROM part" for i, c in enumerate(PROFILED))


@register("A40_column_profile", f"""
WITH l AS ({PROFILE_SQL}), k AS (SELECT position, colonne, t, count(*) AS n FROM l GROUP BY 1, 2, 3)
SELECT position, colonne, {big('sum(n)')} AS lignes, {big('coalesce(sum(n) FILTER (WHERE t IS NULL), 0)')} AS vides, {div('coalesce(sum(n) FILTER (WHERE t IS NULL), 0)', 'sum(n)')} AS taux_vides,
  {cnt('t IS NOT NULL')} AS valeurs_distinctes, {div(cnt('t IS NOT NULL'), 'sum(n) FILTER (WHERE t IS NOT NULL)')} AS taux_unicite,
  (list(t ORDER BY n DESC, t) FILTER (WHERE t IS NOT NULL))[1] AS valeur_dominante, {div('max(n) FILTER (WHERE t IS NOT NULL)', 'sum(n) FILTER (WHERE t IS NOT NULL)')} AS taux_dominant
FROM k GROUP BY 1, 2""")
def a40(spark, sf):
    return Q.column_profile(V.table(spark, sf, "part").select(*PROFILED))


@register("A40_redundant_pairs", """
SELECT * FROM (SELECT 'nom' AS colonne_a, 'copie' AS colonne_b, 'identiques' AS relation, count(*) AS lignes FROM part
UNION ALL SELECT 'nom', 'majuscules', 'identiques_apres_normalisation', count(*) FROM part
UNION ALL SELECT 'copie', 'majuscules', 'identiques_apres_normalisation', count(*) FROM part)""")
def a40b(spark, sf):
    name = F.col("p_name")
    return Q.redundant_pairs(V.table(spark, sf, "part").select(
        name.alias("nom"), name.alias("copie"), F.concat(F.upper(name), F.lit(" ")).alias("majuscules"), "p_brand"))


@register("A42_segment_profile", f"""
WITH l AS ({' UNION ALL '.join(f'''SELECT "analyse", type_element, {i + 1} AS position, '{c}' AS colonne, {_token(c)} AS t FROM v_conformite''' for i, c in enumerate(('statut_revue', 'severite', 'etat')))}),
k AS (SELECT "analyse", type_element, position, colonne, t, count(*) AS n FROM l GROUP BY 1, 2, 3, 4, 5)
SELECT "analyse", type_element, position, colonne, {big('sum(n)')} AS lignes, {cnt('t IS NOT NULL')} AS valeurs_distinctes,
  coalesce({div('max(n) FILTER (WHERE t IS NOT NULL)', 'sum(n) FILTER (WHERE t IS NOT NULL)')}, CAST(0 AS DOUBLE)) AS taux_dominant FROM k GROUP BY 1, 2, 3, 4""", ("v_conformite",))
def a42(spark, sf):
    out = Q.column_profile(V.compliance(spark, sf), ["statut_revue", "severite", "etat"], by=["analyse", "type_element"])
    return out.select("analyse", "type_element", "position", "colonne", "lignes", "valeurs_distinctes", "taux_dominant")


@register("A42_segment_pairs", """
SELECT "analyse", 'statut_revue' AS colonne_a, 'copie' AS colonne_b, 'identiques_apres_normalisation' AS relation, count(*) AS lignes FROM v_conformite GROUP BY 1 HAVING count(statut_revue) > 0""", ("v_conformite",))
def a42b(spark, sf):
    c = V.compliance(spark, sf).select("analyse", "statut_revue", F.lower("statut_revue").alias("copie"), F.col("ligne_id").cast("string").alias("cle"))
    return Q.redundant_pairs(c, by=["analyse"])


DOC_KEY = "concat(upper(substr(trim(text), 1, 1)), lower(substr(trim(text), 2)))"


@register("W2_duplicates_shown", f"""
WITH k AS (SELECT doc_id, lang, {strip('text')} AS t FROM documents), g AS (SELECT *, count(*) OVER (PARTITION BY lower(t)) AS n, min(doc_id) OVER (PARTITION BY lower(t)) AS f FROM k)
SELECT doc_id, n AS nombre_occurrences, n - 1 AS lignes_dupliquees, {big('CAST(lang IS NULL AS INT)')} AS nb_missing FROM g WHERE n > 1 AND doc_id <> f""")
def w2a(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return Q.handle_duplicates(docs, "doc_id", "afficher", columns=["text"], case="lower").drop("text", "lang")


@register("W2_duplicate_counts", f"""
SELECT count(*) AS groupes, {big('coalesce(sum(n - 1), 0)')} AS lignes_dupliquees FROM (SELECT count(*) AS n FROM documents GROUP BY lower({strip('text')})) WHERE n > 1""")
def w2b(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    return Q.handle_duplicates(docs, "doc_id", "compter", columns=["text"], case="lower")


@register("W2_deduplicated", f"""
SELECT max(doc_id) AS doc_id, count(*) AS nombre_occurrences FROM documents GROUP BY lower({strip('text')})""")
def w2c(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    return Q.handle_duplicates(docs, "doc_id", "nettoyer", columns=["text"], case="lower", keep="last").select("doc_id", "nombre_occurrences")


@register("W3_deletion_suggestions", """
WITH k AS (SELECT client_id, telephone, categorie, lower(trim(telephone)) AS t, categorie = 'HOUSEHOLD' AS p, CAST(sexe IS NULL AS INT) + CAST(agent_credit IS NULL AS INT) AS mi FROM v_clients),
g AS (SELECT *, count(*) OVER (PARTITION BY t) AS n, min(client_id) OVER (PARTITION BY t) AS f, row_number() OVER (PARTITION BY t ORDER BY p DESC, mi, client_id) AS r FROM k)
SELECT client_id, n AS nombre_occurrences, n - 1 AS lignes_dupliquees, CAST(mi AS BIGINT) AS nb_missing, p AS resultat_prioritaire, r AS rang_conservation, CASE WHEN r = 1 THEN 'Garder' ELSE 'Supprimer' END AS suggestion,
  client_id <> f AS est_doublon FROM g WHERE n > 1""", CLI)
def w3(spark, sf):
    c = V.clients(spark, sf).select("client_id", "telephone", "categorie", "sexe", "agent_credit")
    out = Q.suggest_deletions(c, "client_id", ["telephone"], "categorie", ["Household"], ["sexe", "agent_credit"], case="lower")
    return out.select("client_id", "nombre_occurrences", "lignes_dupliquees", "nb_missing", "resultat_prioritaire", "rang_conservation", "suggestion", "est_doublon")


@register("T4_exact_duplicates", f"""
SELECT {big('sum(n)')} AS lignes, count(*) AS lignes_distinctes, {big('sum(n - 1)')} AS doublons_exacts FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def t4(spark, sf):
    return Q.exact_duplicates(V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


# --- joins and sets -------------------------------------------------------------------------------------------

@register("J1_progressive_join", """
SELECT c.c_custkey AS cle, c.c_name AS nom_gauche, s.s_name AS nom_droite, p.p_name AS nom FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey LEFT JOIN part p ON p.p_partkey = c.c_custkey""")
def j1(spark, sf):
    def named(table, key, name):
        return V.table(spark, sf, table).select(F.col(key).alias("cle"), F.col(name).alias("nom"))
    tables = [named("customer", "c_custkey", "c_name"), named("supplier", "s_suppkey", "s_name"), named("part", "p_partkey", "p_name")]
    return J.join_all(tables, ["cle"], "left")


def known_and_served(spark, sf):
    """All clients, and those of all orders with their names written another way."""
    customer = V.table(spark, sf, "customer").select(F.translate("c_name", "#", " ").alias("nom"), (F.col("c_custkey") % 7).alias("code"), "c_custkey")
    orders = V.table(spark, sf, "orders").select(F.concat(F.lit("customer-"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("nom"), (F.col("o_custkey") % 7).alias("code"), "o_orderkey")
    return customer, orders


SERVED = "'customer-' || lpad(o_custkey::VARCHAR, 9, '0')"


@register("J4_value_comparison", """
WITH a AS (SELECT DISTINCT upper(replace(c_name, '#', '')) AS k FROM customer), b AS (SELECT DISTINCT upper('customer' || lpad(o_custkey::VARCHAR, 9, '0')) AS k FROM orders)
SELECT coalesce(a.k, b.k) AS cle, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'commun' WHEN a.k IS NOT NULL THEN 'premier seulement' ELSE 'second seulement' END AS presence FROM a FULL JOIN b ON a.k = b.k""")
def j4(spark, sf):
    customer, orders = known_and_served(spark, sf)
    return J.compare_values(customer, ["nom"], orders.withColumnRenamed("nom", "n"), ["n"])


@register("J5_table_comparison", """
SELECT replace(c_name, '#', ' ') AS nom, c_custkey % 7 AS code, c_custkey AS c_custkey_df_1, o_orderkey AS o_orderkey_df_2
FROM customer JOIN orders ON upper(replace(c_name, '#', '')) = upper('customer' || lpad(o_custkey::VARCHAR, 9, '0')) AND c_custkey % 7 = o_custkey % 7""")
def j5(spark, sf):
    return J.compare_tables(*known_and_served(spark, sf), ["nom", "code"], ["c_custkey"], ["o_orderkey"])


@register("J5_comparison_summary", """
WITH a AS (SELECT upper(replace(c_name, '#', '')) AS k FROM customer), b AS (SELECT upper('customer' || lpad(o_custkey::VARCHAR, 9, '0')) AS k FROM orders)
SELECT (SELECT count(DISTINCT k) FROM a WHERE k IN (SELECT k FROM b)) AS nb_cles_communes, (SELECT count(DISTINCT k) FROM a WHERE k NOT IN (SELECT k FROM b)) AS nb_cles_uniques_1,
  (SELECT count(DISTINCT k) FROM b WHERE k NOT IN (SELECT k FROM a)) AS nb_cles_uniques_2, (SELECT count(*) FROM a) AS nb_lignes_1, (SELECT count(*) FROM b) AS nb_lignes_2""")
def j5b(spark, sf):
    return J.comparison_summary(*known_and_served(spark, sf), ["nom"])


@register("J5_rows_by_presence", f"""
SELECT replace(c_name, '#', ' ') AS nom, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'commun' ELSE 'premier seulement' END AS presence FROM customer
UNION ALL SELECT {SERVED}, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN 'commun' ELSE 'second seulement' END FROM orders""")
def j5c(spark, sf):
    return J.rows_by_presence(*known_and_served(spark, sf), ["nom"])


@register("T1_mixed_sort", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25")
def t1(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(25)


@register("T2_business_order", f"""
SELECT statut_dossier, n, CAST(CASE statut_dossier WHEN 'En analyse' THEN 3 WHEN 'Décaissé' THEN 5 ELSE 8 END AS INT) AS ordre FROM (SELECT statut_dossier, count(*) AS n FROM v_dossiers GROUP BY 1)""", ("v_dossiers",))
def t2(spark, sf):
    counts = V.dossiers(spark, sf).groupBy("statut_dossier").agg(F.count("*").alias("n"))
    return P.in_order(counts.withColumn("ordre", L.order_of(F.col("statut_dossier"), L.STATUS_FLOW)), "statut_dossier", L.STATUS_FLOW)


@register("T3_union_with_drift", "SELECT c_custkey AS cle, c_name AS nom, NULL AS marque FROM customer UNION ALL SELECT p_partkey, NULL, p_brand FROM part")
def t3(spark, sf):
    a = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("cle"), F.col("c_name").alias("nom"))
    return J.union_all([a, V.table(spark, sf, "part").select(F.col("p_partkey").alias("cle"), F.col("p_brand").alias("marque"))])


@register("T5_intersect_and_except", """
SELECT 'commun' AS ensemble, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
SELECT 'clients sans commande', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def t5(spark, sf):
    customer, supplier = V.table(spark, sf, "customer"), V.table(spark, sf, "supplier")
    common = J.common_values(customer.select("c_nationkey"), supplier.select("s_nationkey"))
    idle = J.missing_values(customer.select("c_custkey"), V.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])
    return common.agg(F.lit("commun").alias("ensemble"), F.count("*").alias("n")).unionByName(
        idle.agg(F.lit("clients sans commande").alias("ensemble"), F.count("*").alias("n")))


@register("T6_branch_dimension", "SELECT DISTINCT agence FROM v_dossiers UNION SELECT DISTINCT agence FROM v_operations", ("v_dossiers", "v_operations"))
def t6(spark, sf):
    return J.branch_dimension([V.dossiers(spark, sf), V.operations(spark, sf), V.clients(spark, sf)])


@register("T7_calendar", """
SELECT CAST(d AS DATE) AS jour, CAST(year(d) AS INT) AS annee, CAST(month(d) AS INT) AS mois, CAST(quarter(d) AS INT) AS trimestre, strftime(d, '%Y-%m') AS periode
FROM (SELECT unnest(generate_series((SELECT date_trunc('day', min(o_orderdate)) FROM orders), (SELECT date_trunc('day', max(o_orderdate)) FROM orders), INTERVAL 1 DAY)) AS d)""")
def t7(spark, sf):
    return J.calendar(V.table(spark, sf, "orders"), "o_orderdate")


@register("T8_long_form", f"""
SELECT agence, 'demande' AS mesure, {fsum('montant_demande')} AS valeur FROM v_std GROUP BY 1 UNION ALL SELECT agence, 'accorde', {fsum('montant_accorde')} FROM v_std GROUP BY 1""", STD)
def t8(spark, sf):
    from comptoir.functions.money import total
    wide = V.standard(spark, sf).groupBy("agence").agg(total("montant_demande").alias("demande"), total("montant_accorde").alias("accorde"))
    return wide.unpivot(["agence"], ["demande", "accorde"], "mesure", "valeur")


@register("T10_resample", f"""
SELECT 'W' AS f, event_type, CAST(date_trunc('week', ts) AS DATE) AS periode, {fsum('value')} AS value FROM events GROUP BY 2, 3
UNION ALL SELECT 'M', event_type, CAST(date_trunc('month', ts) AS DATE), {avg('value')} FROM events GROUP BY 2, 3""")
def t10(spark, sf):
    e = V.table(spark, sf, "events")
    parts = [J.resample(e, "ts", ["event_type"], "value", f, stock).withColumn("f", F.lit(f)) for f, stock in (("W", False), ("M", True))]
    return parts[0].unionByName(parts[1])


# --- file jobs ------------------------------------------------------------------------------------------------

def years_written(spark, sf, sep=";"):
    """The orders written as one CSV folder per year, the header differing between years."""
    base = scratch_path(spark, "orders")
    orders = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("an"))
    years = [r["an"] for r in orders.select("an").distinct().collect()]
    paths = []
    for year in sorted(years):
        part = orders.where(F.col("an") == year).select(
            F.col("o_orderkey").alias("N° commande"), F.col("o_custkey").alias("Client" if year % 2 else "client_id"),
            F.col("o_totalprice").alias("Montant"), F.lit("x").alias("Extra" if year % 2 else "Autre"))
        path = f"{base}/encours_15-06-{year}"
        part.write.option("header", True).option("sep", sep).csv(path)
        paths.append(path)
    return paths


ORDER_CONTRACT = K.contract("orders", "commande, client_id", "montant", {"commande": ("N° commande",), "client_id": ("Client",)})


@register("S1_csv_scan", f"SELECT count(*) AS n, {fsum('o_totalprice')} AS montant FROM orders")
def s1(spark, sf):
    from comptoir.functions.money import total
    from comptoir.functions.values import to_number
    parts = [S.read_csv(spark, p).select(to_number(F.col("Montant")).alias("m")) for p in years_written(spark, sf, "|")]
    return J.union_all(parts).agg(F.count("*").alias("n"), total("m").alias("montant"))


@register("S2_contracted_read", "SELECT CAST(o_orderkey AS VARCHAR) AS commande, CAST(o_custkey AS VARCHAR) AS client_id FROM orders")
def s2(spark, sf):
    return S.load_files(spark, years_written(spark, sf), rules=ORDER_CONTRACT).select("commande", "client_id")


@register("S1_csv_line_breaks", """SELECT doc_id, sha256(coalesce(text, '')) AS empreinte, length(coalesce(text, '')) AS longueur, lang FROM documents""")
def s1_breaks(spark, sf):
    """Whole texts written as quoted cells, whose line breaks go over the ends of lines and splits, and read back."""
    path = scratch_path(spark, "texts")
    docs = V.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("texte"), "lang")
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).option("sep", ";").csv(path)
    read = S.read_csv(spark, path).withColumn("texte", F.coalesce("texte", F.lit("")))
    return read.select(F.col("doc_id").cast("bigint"), F.sha2(F.col("texte").cast("binary"), 256).alias("empreinte"), F.length("texte").cast("bigint").alias("longueur"), "lang")


@register("S3_contract_check", """
SELECT 'orders' AS source, 'N° commande' AS requise, 'absente' AS etat, count(*) AS lignes FROM orders""")
def s3(spark, sf):
    orders = V.table(spark, sf, "orders")
    rules = K.contract("orders", "N° commande, o_custkey")
    gone = K.missing_columns(orders, rules)
    return orders.agg(F.lit("orders").alias("source"), F.lit(", ".join(gone)).alias("requise"), F.lit("absente").alias("etat"), F.count("*").alias("lignes"))


@register("S4_multi_file_load", """
SELECT concat('encours_15-06-', year(o_orderdate)) AS fichier_source, CAST(dense_rank() OVER (ORDER BY year(o_orderdate)) - 1 AS INT) AS ordre_fichier_import, count(*) AS lignes,
  CASE WHEN year(o_orderdate) % 2 = 1 THEN count(*) ELSE 0 END AS avec_extra FROM orders GROUP BY year(o_orderdate)""")
def s4(spark, sf):
    out = S.load_files(spark, years_written(spark, sf), rules=ORDER_CONTRACT)
    return out.groupBy("fichier_source", "ordre_fichier_import").agg(F.count("*").alias("lignes"), F.count("Extra").alias("avec_extra"))


@register("S5_homogeneous_compile", """
SELECT concat('encours_15-06-', year(o_orderdate)) AS "Provenance", count(*) AS lignes, count(o_totalprice) AS montants FROM orders GROUP BY 1""")
def s5(spark, sf):
    out = S.compile_files(spark, years_written(spark, sf), common_only=True, source_column="Provenance")
    return out.groupBy("Provenance").agg(F.count("*").alias("lignes"), F.count("Montant").alias("montants"))


@register("S6_standardised_compile", """SELECT CAST(o_orderkey AS VARCHAR) AS "N_commande", CAST(o_custkey AS VARCHAR) AS "Client", o_orderkey % 2 = 0 AS pair FROM orders""")
def s6(spark, sf):
    orders = V.table(spark, sf, "orders")
    even = F.col("o_orderkey") % 2 == 0
    rows = orders.select(F.col("o_orderkey").cast("string").alias("N° commande"), F.when(even, F.col("o_custkey").cast("string")).alias("client"),
                         F.when(~even, F.col("o_custkey").cast("string")).alias("Client_01"), even.alias("pair"))
    return S.compile_standardized({"a": rows.where("pair"), "b": rows.where("NOT pair")}, None).withColumnRenamed("Pair", "pair")


YEARS = range(1992, 1999)
S7_COLUMNS = {"N° commande": (0, 1), "Client": (1,), "client_id": (0,), "Montant": (0, 1), "Extra": (1,), "Autre": (0,)}
S7_CELLS = {c: ", ".join(f"""CASE WHEN exists(SELECT 1 FROM orders WHERE year(o_orderdate) = {y}) THEN '{c if y % 2 in odd else "-"}' END AS "{y}\"""" for y in YEARS) for c, odd in S7_COLUMNS.items()}


@register("S7_column_presence", " UNION ALL ".join(f"""SELECT '{c}' AS "Colonne", {cells}, (SELECT count(*) FROM orders) AS lignes""" for c, cells in S7_CELLS.items()))
def s7(spark, sf):
    """All yearly files; a year without orders has no file and a null cell."""
    paths = years_written(spark, sf)
    out = S.files_presence(spark, paths)
    years = [F.col(f"encours_15-06-{y}").alias(str(y)) if f"encours_15-06-{y}" in out.columns else F.lit(None).cast("string").alias(str(y)) for y in YEARS]
    return out.select("Colonne", *years, V.table(spark, sf, "orders").agg(F.count("*").alias("n")).scalar().alias("lignes"))


def with_first_lines(lines):
    def write(batches):
        import pandas as pd
        yield pd.DataFrame({"value": lines})
        yield from batches
    return write


@register("S8_promoted_header", """
SELECT 'TX' || CAST(event_id AS VARCHAR) AS "Receipt No.", CAST(value AS VARCHAR) AS "Paid In", event_id % 2 = 0 AS pair FROM events""")
def s8(spark, sf):
    base = scratch_path(spark, "statements")
    events = V.table(spark, sf, "events").select(
        F.concat(F.lit("TX"), F.col("event_id").cast("string")).alias("a"), F.col("value").cast("string").alias("b"), (F.col("event_id") % 2 == 0).alias("pair"))
    for name, even, head in (("pair", True, ["Organisation", "Periode: tout", "Receipt No.,Paid In"]), ("impair", False, ["Receipt No.,Paid In"])):
        body = events.where(F.col("pair") == even).select(F.concat_ws(",", "a", "b").alias("value"))
        # Every written file starts with its own descriptive lines and header.
        body.mapInPandas(with_first_lines(head), "value string").write.text(f"{base}/{name}")
    parts = [S.promote_header(spark, f"{base}/{n}").select("`Receipt No.`", "`Paid In`").withColumn("pair", F.lit(n == "pair")) for n in ("pair", "impair")]
    return J.union_all(parts)


@register("S9_lineage", """SELECT o_orderkey, 'orders.parquet' AS source_fichier, row_number() OVER (ORDER BY o_orderkey) + 1 AS ligne_source FROM orders""")
def s9(spark, sf):
    """The orders stand in the order of their keys."""
    return S.with_lineage(V.table(spark, sf, "orders"), row_numbers=True).select("o_orderkey", "source_fichier", "ligne_source")


@register("S10_snapshot_date", """
SELECT make_date(CAST(year(o_orderdate) AS INT) + 10, 6, 15) AS date_operation, count(*) AS lignes FROM orders GROUP BY 1""")
def s10(spark, sf):
    year = (F.year("o_orderdate") + 10).cast("string")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("encours_15-06-"), year, F.lit(".csv"))).otherwise(F.concat(F.lit("snap "), year, F.lit("_06_15.parquet")))
    rows = V.table(spark, sf, "orders").select(name.alias("fichier_source"))
    return S.fill_snapshot_date(rows, "fichier_source").groupBy("date_operation").agg(F.count("*").alias("lignes"))


@register("S11_snapshot_bundles", """
SELECT CASE agence WHEN 'NATION_1' THEN '2026-06-30' ELSE 'divers' END AS bundle_key, CASE agence WHEN 'NATION_1' THEN DATE '2026-06-30' END AS bundle_date,
  CASE WHEN sum(CAST(devise = 'CDF' AS INT)) OVER (PARTITION BY agence = 'NATION_1') > sum(CAST(devise = 'USD' AS INT)) OVER (PARTITION BY agence = 'NATION_1') THEN 'CDF' ELSE 'USD' END AS source_currency, compte_id
FROM v_accounts""", ACC)
def s11(spark, sf):
    rows = RP.accounts(spark, sf).select("compte_id", F.concat(F.lit("Compte "), "devise").alias("type_produit"),
                                         F.when(F.col("agence") == "NATION_1", "encours 30-06-2026.xlsx").otherwise("divers.csv").alias("fichier_source"))
    rows = rows.withColumn("fichier_source", F.regexp_replace("fichier_source", "30-06-2026", "30-06-2026"))
    return S.snapshot_bundles(rows).select("bundle_key", "bundle_date", "source_currency", "compte_id")


@register("S12_period_read", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01'""")
def s12(spark, sf):
    return S.read_period(spark, f"{sf}/orders.parquet", "o_orderdate", "1997-01-01", "1997-04-01", ["o_orderkey", "o_totalprice"])


@register("S13_partitioned_export", f"""SELECT o_orderstatus, count(*) AS lignes, {fsum('o_totalprice')} AS montant FROM orders GROUP BY 1""")
def s13(spark, sf):
    from comptoir.functions.money import total
    path = scratch_path(spark, "export")
    rows = V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(None).cast("string").alias("vide"))
    S.export_partitioned(rows, path, "o_orderstatus", "parquet", drop_empty_columns=True)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("o_orderstatus").cast("string").alias("o_orderstatus")).agg(F.count("*").alias("lignes"), total("o_totalprice").alias("montant"))


@register("S14_load_report", """
SELECT 'commandes' AS source, count(*) AS lignes, count(DISTINCT year(o_orderdate)) AS fichiers, '' AS colonnes_manquantes FROM orders
UNION ALL SELECT 'clients', count(*), 1, 'msisdn1' FROM customer""")
def s14(spark, sf):
    orders = V.table(spark, sf, "orders").withColumn("f", F.year("o_orderdate"))
    customer = V.table(spark, sf, "customer")
    return S.load_report({"commandes": (orders, "f"), "clients": (customer, None)}, {"clients": ["msisdn1"]})
