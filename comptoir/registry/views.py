"""Business views derived from the given tables: as DataFrames for the queries, as SQL for their check.

They give the general tables the shapes the operators expect. They are synthetic roles, not real facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comptoir.plans.ordered import partition_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(value: str, col: Column) -> Column:
    return F.concat(F.lit(value), col.cast("string"))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return customer.join(places, customer.c_nationkey == places.n_nationkey).select(
        key.alias("client_id"),
        F.col("c_name").alias("nom_client"),
        F.col("c_mktsegment").alias("categorie"),
        F.col("n_name").alias("agence"),
        F.col("r_name").alias("zone_geographique"),
        F.col("c_acctbal").alias("solde_compte"),
        F.when(key % 11 == 0, None)
        .when(key % 7 == 0, _text("0", 810000000 + key))
        .when(key % 13 == 0, "243 81")
        .otherwise(_text("243", 810000000 + key % 400)).alias("telephone"),
        F.when(key % 2 == 0, "CDF").otherwise("USD").alias("devise"),
        F.when(key % 3 == 0, "M").when(key % 3 == 1, "Femme").alias("sexe"),
        (18 + key % 60).cast("int").alias("age"),
        (key % 17 != 0).alias("est_valide"),
        (key % 19 != 0).alias("droit_paye"),
        F.when(key % 23 == 0, None).otherwise(_text("G", key % 12)).alias("agent_credit"),
    )


CLIENTS_SQL = """
SELECT c.c_custkey AS client_id, c.c_name AS nom_client, c.c_mktsegment AS categorie, n.n_name AS agence,
       r.r_name AS zone_geographique, c.c_acctbal AS solde_compte,
       CASE WHEN c.c_custkey % 11 = 0 THEN NULL
            WHEN c.c_custkey % 7 = 0 THEN concat('0', CAST(810000000 + c.c_custkey AS VARCHAR))
            WHEN c.c_custkey % 13 = 0 THEN '243 81'
            ELSE concat('243', CAST(810000000 + c.c_custkey % 400 AS VARCHAR)) END AS telephone,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'CDF' ELSE 'USD' END AS devise,
       CASE c.c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'Femme' ELSE NULL END AS sexe,
       CAST(18 + c.c_custkey % 60 AS INTEGER) AS age,
       c.c_custkey % 17 <> 0 AS est_valide, c.c_custkey % 19 <> 0 AS droit_paye,
       CASE WHEN c.c_custkey % 23 = 0 THEN NULL ELSE concat('G', CAST(c.c_custkey % 12 AS VARCHAR)) END AS agent_credit
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""


def dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The clients are hashed: the far more numerous orders are not sorted.
    people = clients(spark, sf_dir).select("client_id", "nom_client", "agence", "devise", "agent_credit").hint("shuffle_hash")
    orders = table(spark, sf_dir, "orders")
    key, price, status = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderstatus")
    return orders.join(people, orders.o_custkey == people.client_id).select(
        key.alias("dossier_id"), "client_id", "nom_client", "agence", "agent_credit",
        F.col("o_orderpriority").alias("type_produit"), "devise",
        F.col("o_orderdate").alias("date_demande"),
        price.alias("montant_demande"),
        (price * F.when(key % 20 == 0, F.lit(1.125)).otherwise(F.lit(0.875))).alias("montant_accorde"),
        F.when(status == "F", "Clôturé").when(status == "P", "En analyse").otherwise("Décaissé").alias("statut_dossier"),
        F.when(status == "F", F.lit(0.0)).otherwise(price).alias("solde_final"),
        F.when(key % 31 != 0, ((key * 7) % 140 - 20).cast("int")).alias("retard_jours"),
        (key % 100).cast("double").alias("score_credit"),
        F.when(key % 29 != 0, (400 + F.col("o_custkey") % 900).cast("double")).alias("revenu_mensuel"),
        (150 + key % 700).cast("double").alias("charge_mensuelle"),
        (1 + key % 24).cast("int").alias("duree_credit_mois"),
    )


DOSSIERS_SQL = """
SELECT o.o_orderkey AS dossier_id, o.o_custkey AS client_id, v.nom_client, v.agence, v.agent_credit,
       o.o_orderpriority AS type_produit, v.devise,
       o.o_orderdate AS date_demande, o.o_totalprice AS montant_demande,
       o.o_totalprice * CASE WHEN o.o_orderkey % 20 = 0 THEN CAST(1.125 AS DOUBLE) ELSE CAST(0.875 AS DOUBLE) END AS montant_accorde,
       CASE o.o_orderstatus WHEN 'F' THEN 'Clôturé' WHEN 'P' THEN 'En analyse' ELSE 'Décaissé' END AS statut_dossier,
       CASE WHEN o.o_orderstatus = 'F' THEN CAST(0 AS DOUBLE) ELSE o.o_totalprice END AS solde_final,
       CASE WHEN o.o_orderkey % 31 = 0 THEN NULL ELSE CAST((o.o_orderkey * 7) % 140 - 20 AS INTEGER) END AS retard_jours,
       CAST(o.o_orderkey % 100 AS DOUBLE) AS score_credit,
       CASE WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE CAST(400 + o.o_custkey % 900 AS DOUBLE) END AS revenu_mensuel,
       CAST(150 + o.o_orderkey % 700 AS DOUBLE) AS charge_mensuelle,
       CAST(1 + o.o_orderkey % 24 AS INTEGER) AS duree_credit_mois
FROM orders o JOIN v_clients v ON o.o_custkey = v.client_id
"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("operation_id"),
        F.col("l_suppkey").alias("compte_id"),
        F.col("l_extendedprice").alias("montant"),
        F.when(F.col("l_quantity") < 2, None).when(F.col("l_linestatus") == "F", "D").otherwise("C").alias("sens"),
        F.col("o_orderdate").alias("date_operation"),
        F.col("l_shipdate").alias("date_valeur"),
        (1 + F.col("l_orderkey") % 2).cast("int").alias("id_devise"),
        F.col("l_returnflag").alias("journal"),
    )


def ledger_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each operation of ``ledger`` once: the lines are made distinct before they meet the orders, not after."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("operation_id"))
    lines = lines.repartition(partition_count(lines), "operation_id").distinct()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("operation_id"))
    return lines.join(orders, "operation_id", "left_semi")


LEDGER_SQL = """
SELECT l.l_orderkey AS operation_id, l.l_suppkey AS compte_id, l.l_extendedprice AS montant,
       CASE WHEN l.l_quantity < 2 THEN NULL WHEN l.l_linestatus = 'F' THEN 'D' ELSE 'C' END AS sens,
       o.o_orderdate AS date_operation, l.l_shipdate AS date_valeur,
       CAST(1 + l.l_orderkey % 2 AS INTEGER) AS id_devise, l.l_returnflag AS journal
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = clients(spark, sf_dir).hint("shuffle_hash")
    orders = table(spark, sf_dir, "orders")
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    return orders.join(people, orders.o_custkey == people.client_id).select(
        key.alias("operation_id"), "client_id", "nom_client", "agence",
        F.when(key % 4 == 0, "DEPO").when(key % 4 == 1, "RETR").when(key % 4 == 2, "MOB_DEPO").otherwise("MOB_RETR")
        .alias("type_operation"),
        F.when(key % 4 < 2, "BACK_OFFICE").otherwise("API_MOBILE").alias("source_mouvement"),
        F.col("o_orderdate").alias("date_operation"),
        F.when(key % 9 == 0, key % 5).otherwise(0).cast("int").alias("saisie_jours"),
        F.col("o_totalprice").alias("montant_operation"),
        F.col("devise").alias("code_devise"),
        ((F.col("o_orderstatus") == "P") & (key % 10 == 0)).alias("annule"),
        _text("U", owner % 20).alias("operateur"),
        _text("U", key % 20).alias("validateur"),
        _text("R", F.when(key % 50 == 0, 0).otherwise(key)).alias("numero_recu"),
        "agent_credit", "est_valide", "droit_paye", "categorie", "zone_geographique",
    )


OPERATIONS_SQL = """
SELECT o.o_orderkey AS operation_id, o.o_custkey AS client_id, v.nom_client, v.agence,
       CASE o.o_orderkey % 4 WHEN 0 THEN 'DEPO' WHEN 1 THEN 'RETR' WHEN 2 THEN 'MOB_DEPO' ELSE 'MOB_RETR' END AS type_operation,
       CASE WHEN o.o_orderkey % 4 < 2 THEN 'BACK_OFFICE' ELSE 'API_MOBILE' END AS source_mouvement,
       o.o_orderdate AS date_operation, CAST(CASE WHEN o.o_orderkey % 9 = 0 THEN o.o_orderkey % 5 ELSE 0 END AS INTEGER) AS saisie_jours,
       o.o_totalprice AS montant_operation, v.devise AS code_devise,
       o.o_orderstatus = 'P' AND o.o_orderkey % 10 = 0 AS annule,
       concat('U', CAST(o.o_custkey % 20 AS VARCHAR)) AS operateur, concat('U', CAST(o.o_orderkey % 20 AS VARCHAR)) AS validateur,
       concat('R', CAST(CASE WHEN o.o_orderkey % 50 = 0 THEN 0 ELSE o.o_orderkey END AS VARCHAR)) AS numero_recu,
       v.agent_credit, v.est_valide, v.droit_paye, v.categorie, v.zone_geographique
FROM orders o JOIN v_clients v ON o.o_custkey = v.client_id
"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ledger lines per event; failed events become loan payments and releases of term deposits."""
    key, value = F.col("event_id"), F.col("value")
    kind = (F.when((F.col("event_type") == "error") & (key % 3 == 0), "pret")
            .when((F.col("event_type") == "error") & (key % 3 == 1), "deblocage").otherwise(F.col("event_type")))
    event = table(spark, sf_dir, "events").withColumns({"k": kind, "side": F.explode(F.array(F.lit(0), F.lit(1)))})
    k, first = F.col("k"), F.col("side") == 0
    debit = first == ~k.isin("click", "pret")
    dr = F.when(debit, value).otherwise(F.lit(0.0))
    cr = F.when(debit, F.lit(0.0)).otherwise(value)
    before = F.col("user_id").cast("double") * 10
    first_account = (F.when(k == "deblocage", "FIXED SAVINGS").when((k == "purchase") & (key % 5 == 0), "NORMAL SAVINGS")
                     .otherwise("MPESA ACCOUNT"))
    second_account = (F.when(k == "signup", "FIXED SAVINGS").when((k == "purchase") & (key % 4 == 0), "LOAN PENALTY FEES")
                      .when(k == "purchase", "LOAN ACCOUNT").when(k == "pret", "PRINCIPLE").otherwise("NORMAL SAVINGS"))
    return event.select(
        (key * 2 + F.col("side")).alias("id"),
        F.col("user_id").alias("customer_id"),
        _text("243", 810000000 + F.col("user_id")).alias("msisdn1"),
        F.when(first, first_account).otherwise(second_account).alias("account_type"),
        F.when(k == "view", "Epargne depot").when(k == "click", "Retrait Vers M-Pesa").when(k == "signup", "Depot Bloque")
        .when((k == "purchase") & first & (key % 5 == 0), "Remboursement de compte epargne")
        .when(k == "purchase", "Remboursement du Pret").when(k == "pret", "Montant pret")
        .when(k == "deblocage", "Retrait Compte Bloque").otherwise("Autre").alias("description"),
        F.when(key % 2 == 0, "CDF").otherwise("USD").alias("currency_code"),
        dr.alias("dr"), cr.alias("cr"), before.alias("bal_before"),
        (before + cr - dr + F.when(key % 23 == 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("bal_after"),
        F.when(k.isin("signup", "deblocage"), _text("SA", F.col("user_id") * 2 + 1)).otherwise(_text("REF", F.col("user_id")))
        .alias("reference_id"),
        F.when(~k.isin("click", "pret"), _text("TX", key)).alias("ref_no"),
        F.col("ts").alias("created_at"),
    )


JOURNAL_SQL = """
SELECT event_id * 2 + side AS id, user_id AS customer_id, concat('243', CAST(810000000 + user_id AS VARCHAR)) AS msisdn1,
       CASE WHEN side = 0 THEN CASE WHEN k = 'deblocage' THEN 'FIXED SAVINGS' WHEN k = 'purchase' AND event_id % 5 = 0 THEN 'NORMAL SAVINGS' ELSE 'MPESA ACCOUNT' END
            ELSE CASE WHEN k = 'signup' THEN 'FIXED SAVINGS' WHEN k = 'purchase' AND event_id % 4 = 0 THEN 'LOAN PENALTY FEES' WHEN k = 'purchase' THEN 'LOAN ACCOUNT'
                      WHEN k = 'pret' THEN 'PRINCIPLE' ELSE 'NORMAL SAVINGS' END END AS account_type,
       CASE WHEN k = 'view' THEN 'Epargne depot' WHEN k = 'click' THEN 'Retrait Vers M-Pesa' WHEN k = 'signup' THEN 'Depot Bloque'
            WHEN k = 'purchase' AND side = 0 AND event_id % 5 = 0 THEN 'Remboursement de compte epargne' WHEN k = 'purchase' THEN 'Remboursement du Pret'
            WHEN k = 'pret' THEN 'Montant pret' WHEN k = 'deblocage' THEN 'Retrait Compte Bloque' ELSE 'Autre' END AS description,
       CASE WHEN event_id % 2 = 0 THEN 'CDF' ELSE 'USD' END AS currency_code, dr, cr, bal_before,
       bal_before + cr - dr + CASE WHEN event_id % 23 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS bal_after,
       CASE WHEN k IN ('signup', 'deblocage') THEN concat('SA', CAST(user_id * 2 + 1 AS VARCHAR)) ELSE concat('REF', CAST(user_id AS VARCHAR)) END AS reference_id,
       CASE WHEN k NOT IN ('click', 'pret') THEN concat('TX', CAST(event_id AS VARCHAR)) END AS ref_no, ts AS created_at
FROM (SELECT *, CAST(user_id AS DOUBLE) * 10 AS bal_before, CASE WHEN (side = 0) = (k NOT IN ('click', 'pret')) THEN value ELSE CAST(0 AS DOUBLE) END AS dr,
             CASE WHEN (side = 0) = (k NOT IN ('click', 'pret')) THEN CAST(0 AS DOUBLE) ELSE value END AS cr
      FROM (SELECT *, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'pret' WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'deblocage' ELSE event_type END AS k
            FROM events) CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1 AS side))
"""


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = F.col("event_id"), F.col("event_type")
    loan = (kind == "error") & (key % 3 == 0)
    out = (kind == "click") | loan
    delay = F.when(key % 53 == 0, F.expr("INTERVAL '90' MINUTE")).otherwise(F.expr("INTERVAL '2' MINUTE"))
    # Every fifth receipt carries a number the ledger does not know.
    return table(spark, sf_dir, "events").select(
        F.when(out | (key % 5 == 0), _text("RC", key)).otherwise(_text("TX", key)).alias("receipt_no"),
        F.when(key % 43 == 0, _text("243", 820000000 + F.col("user_id"))).otherwise(_text("243", 810000000 + F.col("user_id")))
        .alias("phone"),
        _text("CLIENT ", F.col("user_id")).alias("nom_client"),
        F.when((key % 2 == 0) | (key % 97 == 0), "CDF").otherwise("USD").alias("currency_code"),
        F.when(key % 41 == 0, F.col("value") + 1.0).otherwise(F.col("value")).alias("montant"),
        F.when(out, "Sortie").otherwise("Entree").alias("sens_flux"),
        F.when(key % 37 == 0, "Declined").otherwise("Completed").alias("statut"),
        F.when(key % 29 == 0, "Super Transaction").when(kind == "click", "PaymentB2C").when(loan, "LoanRequest")
        .when(kind == "purchase", "DepositC2BRepayment").otherwise("DepositC2B").alias("reason_type"),
        (F.col("ts") + delay).alias("initiation_time"),
        (F.col("ts") + delay + F.expr("INTERVAL '1' MINUTE")).alias("completion_time"),
    )


RECEIPTS_SQL = """
SELECT concat(CASE WHEN event_type = 'click' OR (event_type = 'error' AND event_id % 3 = 0) OR event_id % 5 = 0 THEN 'RC' ELSE 'TX' END, CAST(event_id AS VARCHAR)) AS receipt_no,
       concat('243', CAST(CASE WHEN event_id % 43 = 0 THEN 820000000 ELSE 810000000 END + user_id AS VARCHAR)) AS phone,
       concat('CLIENT ', CAST(user_id AS VARCHAR)) AS nom_client,
       CASE WHEN event_id % 2 = 0 OR event_id % 97 = 0 THEN 'CDF' ELSE 'USD' END AS currency_code,
       CASE WHEN event_id % 41 = 0 THEN value + 1.0 ELSE value END AS montant,
       CASE WHEN event_type = 'click' OR (event_type = 'error' AND event_id % 3 = 0) THEN 'Sortie' ELSE 'Entree' END AS sens_flux,
       CASE WHEN event_id % 37 = 0 THEN 'Declined' ELSE 'Completed' END AS statut,
       CASE WHEN event_id % 29 = 0 THEN 'Super Transaction' WHEN event_type = 'click' THEN 'PaymentB2C' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'LoanRequest'
            WHEN event_type = 'purchase' THEN 'DepositC2BRepayment' ELSE 'DepositC2B' END AS reason_type,
       ts + CASE WHEN event_id % 53 = 0 THEN INTERVAL '90' MINUTE ELSE INTERVAL '2' MINUTE END AS initiation_time,
       ts + CASE WHEN event_id % 53 = 0 THEN INTERVAL '91' MINUTE ELSE INTERVAL '3' MINUTE END AS completion_time
FROM events
"""


def savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return savings_of(table(spark, sf_dir, "customer"))


def savings_of(customers: DataFrame, *carried: str) -> DataFrame:
    """A current and a fixed account of each customer row; ``carried`` names columns of the row to keep."""
    customer = customers.withColumn("fixed", F.explode(F.array(F.lit(0), F.lit(1))))
    key, balance, fixed = F.col("c_custkey"), F.col("c_acctbal"), F.col("fixed") == 1
    return customer.select(
        (key * 2 + F.col("fixed")).alias("savings_id"),
        key.alias("customer_id"),
        _text("243", 810000000 + key).alias("msisdn"),
        F.when(key % 2 == 0, "CDF").otherwise("USD").alias("currency_code"),
        F.when(fixed, "FIXED SAVINGS").otherwise("NORMAL SAVINGS").alias("account_type"),
        F.when((balance < 0) | (fixed & (key % 3 != 0)), F.lit(0.0)).when(fixed, balance * 0.375).otherwise(balance)
        .alias("balance"),
        F.lit("2001-02-01").cast("date").alias("date_approved"),
        F.when(fixed, F.date_add(F.lit("2001-08-01").cast("date"), (key % 150 - 20).cast("int"))).alias("maturity_date"),
        *carried,
    )


SAVINGS_SQL = """
SELECT c.c_custkey * 2 + k.fixed AS savings_id, c.c_custkey AS customer_id,
       concat('243', CAST(810000000 + c.c_custkey AS VARCHAR)) AS msisdn,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'CDF' ELSE 'USD' END AS currency_code,
       CASE WHEN k.fixed = 1 THEN 'FIXED SAVINGS' ELSE 'NORMAL SAVINGS' END AS account_type,
       CASE WHEN c.c_acctbal < 0 OR (k.fixed = 1 AND c.c_custkey % 3 <> 0) THEN CAST(0 AS DOUBLE) WHEN k.fixed = 1 THEN c.c_acctbal * CAST(0.375 AS DOUBLE) ELSE c.c_acctbal END AS balance,
       DATE '2001-02-01' AS date_approved,
       CASE WHEN k.fixed = 1 THEN DATE '2001-08-01' + CAST(c.c_custkey % 150 - 20 AS INTEGER) END AS maturity_date
FROM customer c CROSS JOIN (SELECT 0 AS fixed UNION ALL SELECT 1 AS fixed) k
"""


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dossiers(spark, sf_dir)
    return d.select(
        F.col("dossier_id").alias("loan_id"),
        F.col("client_id").alias("customer_id"),
        _text("243", 810000000 + F.col("client_id")).alias("msisdn1"),
        F.col("devise").alias("currency_code"),
        F.col("montant_accorde").alias("loan_amount"),
        F.col("solde_final").alias("loan_balance"),
        F.col("statut_dossier").alias("status_name"),
        F.col("date_demande").alias("created_at"),
        F.when(F.col("dossier_id") % 8 == 0, F.col("client_id") * 2).alias("savings_account_id"),
        F.date_sub(F.lit("2001-08-01").cast("date"), F.col("retard_jours")).alias("due_date"),
    )


LOANS_SQL = """
SELECT d.dossier_id AS loan_id, d.client_id AS customer_id,
       concat('243', CAST(810000000 + d.client_id AS VARCHAR)) AS msisdn1, d.devise AS currency_code, d.montant_accorde AS loan_amount,
       d.solde_final AS loan_balance, d.statut_dossier AS status_name, d.date_demande AS created_at,
       CASE WHEN d.dossier_id % 8 = 0 THEN d.client_id * 2 END AS savings_account_id,
       CASE WHEN d.retard_jours IS NOT NULL THEN DATE '2001-08-01' - CAST(d.retard_jours AS INTEGER) END AS due_date
FROM v_dossiers d
"""


def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multi-analysis compliance table derived from the operations."""
    op = operations(spark, sf_dir)
    key = F.col("operation_id")
    kinds = ["Alerte", "Fractionnement", "Gros mouvement agrege", "Reporting agrege", "Profil de risque",
             "Controle qualite", "Mouvement", "Declaration", "Reactivation de compte"]
    analyses = ["150_ALERTES", "039_FRACTIONNEMENT", "057_GROS_MOUVEMENTS", "149_REPORTING", "152_PROFILS",
                "155_QUALITE", "036_MOUVEMENTS", "151_DECLARATIONS", "153_REACTIVATIONS"]
    slot = F.pmod(key, F.lit(9)).cast("int")

    def pick(values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), slot + 1)

    return op.select(
        key.alias("ligne_id"),
        pick(analyses).alias("analyse"),
        pick(kinds).alias("type_element"),
        F.when(slot == 3, (144 + key % 8).cast("int")).alias("ligne_reporting"),
        F.concat(F.lit("Rubrique "), (key % 5).cast("string")).alias("rubrique"),
        F.col("date_operation").alias("date_evenement"),
        F.when(key % 13 != 0, F.col("client_id")).alias("code_client"),
        F.when(key % 3 == 0, "TRAITE").when(key % 3 == 1, "A_REVOIR").alias("statut_revue"),
        F.when(key % 4 == 0, "COUVERT").when(key % 4 == 1, "PARTIEL").when(key % 4 == 2, "NON_COUVERT")
        .alias("statut_couverture"),
        F.when(key % 17 != 0, F.col("code_devise")).alias("devise"),
        F.col("montant_operation").alias("montant"),
        (1 + key % 6).cast("int").alias("nombre"),
        F.when(key % 5 == 0, "CRITIQUE").when(key % 5 == 1, "MOYENNE").alias("severite"),
        F.when(key % 8 == 0, "Fractionnement").when(key % 8 == 1, "Haut risque; Gel des fonds").alias("indicateurs"),
        F.when(key % 6 != 0, F.concat(F.lit("E"), (key % 3).cast("string"))).alias("etat"),
        F.when(key % 10 != 0, F.concat(F.lit("N"), key.cast("string"))).alias("numero_alerte"),
        "type_operation",
    )


COMPLIANCE_SQL = """
SELECT operation_id AS ligne_id,
       ['150_ALERTES','039_FRACTIONNEMENT','057_GROS_MOUVEMENTS','149_REPORTING','152_PROFILS','155_QUALITE','036_MOUVEMENTS','151_DECLARATIONS','153_REACTIVATIONS'][CAST(operation_id % 9 AS INTEGER) + 1] AS "analyse",
       ['Alerte','Fractionnement','Gros mouvement agrege','Reporting agrege','Profil de risque','Controle qualite','Mouvement','Declaration','Reactivation de compte'][CAST(operation_id % 9 AS INTEGER) + 1] AS type_element,
       CASE WHEN operation_id % 9 = 3 THEN CAST(144 + operation_id % 8 AS INTEGER) END AS ligne_reporting,
       concat('Rubrique ', CAST(operation_id % 5 AS VARCHAR)) AS rubrique,
       date_operation AS date_evenement,
       CASE WHEN operation_id % 13 <> 0 THEN client_id END AS code_client,
       CASE operation_id % 3 WHEN 0 THEN 'TRAITE' WHEN 1 THEN 'A_REVOIR' END AS statut_revue,
       CASE operation_id % 4 WHEN 0 THEN 'COUVERT' WHEN 1 THEN 'PARTIEL' WHEN 2 THEN 'NON_COUVERT' END AS statut_couverture,
       CASE WHEN operation_id % 17 <> 0 THEN code_devise END AS devise,
       montant_operation AS montant,
       CAST(1 + operation_id % 6 AS INTEGER) AS nombre,
       CASE operation_id % 5 WHEN 0 THEN 'CRITIQUE' WHEN 1 THEN 'MOYENNE' END AS severite,
       CASE operation_id % 8 WHEN 0 THEN 'Fractionnement' WHEN 1 THEN 'Haut risque; Gel des fonds' END AS indicateurs,
       CASE WHEN operation_id % 6 <> 0 THEN concat('E', CAST(operation_id % 3 AS VARCHAR)) END AS etat,
       CASE WHEN operation_id % 10 <> 0 THEN concat('N', CAST(operation_id AS VARCHAR)) END AS numero_alerte,
       type_operation
FROM v_operations
"""

STANDARD_SQL = """
SELECT *, revenu_mensuel - charge_mensuelle AS capacite_remboursement,
       charge_mensuelle / nullif(revenu_mensuel, 0) AS taux_endettement,
       montant_accorde / nullif(duree_credit_mois, 0) AS mensualite_estimee,
       CASE WHEN score_credit >= 80 THEN 'Faible' WHEN score_credit >= 50 THEN 'Moyen' ELSE 'Élevé' END AS niveau_risque_calcule,
       strftime(date_demande, '%Y-%m') AS mois_demande
FROM v_dossiers
"""


def standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan files with the derived columns of the standardised table."""
    from comptoir.operators.standardize import with_risk

    return with_risk(dossiers(spark, sf_dir))


VIEW_SQL = {
    "v_std": STANDARD_SQL,
    "v_clients": CLIENTS_SQL, "v_dossiers": DOSSIERS_SQL, "v_ledger": LEDGER_SQL, "v_operations": OPERATIONS_SQL,
    "v_journal": JOURNAL_SQL, "v_receipts": RECEIPTS_SQL, "v_savings": SAVINGS_SQL, "v_loans": LOANS_SQL,
    "v_conformite": COMPLIANCE_SQL,
}
VIEW_USES = {
    "v_std": ("v_dossiers",),
    "v_dossiers": ("v_clients",), "v_operations": ("v_clients",), "v_loans": ("v_dossiers",),
    "v_conformite": ("v_operations",),
}
