"""What one task holds: rows without a key, narrow identifiers, and sums beside distinct counts."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from comptoir.operators import controls as Q
from comptoir.operators import facts as R
from comptoir.operators import portfolio as P
from comptoir.operators import positions as S
from comptoir.plans.ordered import join_known
from comptoir.registry import portfolio as RP
from comptoir.registry import views as V


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A few customers, orders and lines with repeated keys, empty keys and keys without a partner."""
    folder = tmp_path_factory.mktemp("tables")
    data = {
        "region": ([(0, "EUROPE")], "r_regionkey int, r_name string"),
        "nation": ([(0, "FRANCE", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(k, f"C{k}", 0, float(k) - 2, "BUILDING") for k in (1, 2, 3, 3, 4, 5)] + [(None, "C", 0, 7.0, "BUILDING"), (6, "C6", None, 1.0, None)],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(k, c, "P" if k == 10 else "O", 3.0) for k, c in ((1, 1), (2, 3), (2, 3), (4, 4), (5, None), (10, 5), (None, 2), (7, 2))],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"),
        "lineitem": ([(k, 1, 5.0, 9.0, "F", "A") for k in (1, 1, 2, 5, 8, None, 10, 10)],
                     "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_linestatus string, l_returnflag string"),
    }
    for name, (values, schema) in data.items():
        df = spark.createDataFrame(values, schema)
        if name == "orders":
            df = df.withColumns({"o_orderdate": F.lit("2001-05-01").cast("timestamp_ntz"), "o_orderpriority": F.lit("5-LOW")})
        if name == "lineitem":
            df = df.withColumn("l_shipdate", F.lit("2001-05-02").cast("timestamp_ntz"))
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_ledger_operations_are_those_of_the_ledger(spark, tables):
    found = V.ledger_operations(spark, tables)
    assert rows(found) == rows(V.ledger(spark, tables).select("operation_id").distinct())
    assert sorted(r[0] for r in found.collect()) == [1, 2, 5, 10]


def test_orphans_of_repeated_and_empty_identifiers(spark):
    ops = spark.createDataFrame([(1,), (1,), (3,), (None,), (None,)], "operation_id long")
    lines = spark.createDataFrame([(1,), (2,), (2,), (None,)], "operation_id long")
    found = Q.orphans(ops, lines)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(2, "Ecriture sans operation"), (None, "Ecriture sans operation"), (3, "Operation sans ecriture"), (None, "Operation sans ecriture")], key=str)
    # Each side is read once, nothing is sorted, and the identifiers are not merged into few tasks.
    plan = plan_of(found)
    assert "Join" not in plan and "REPARTITION_BY_NUM" in plan


def test_rows_without_a_key_are_dealt_out(spark):
    left = spark.range(4000).select("id", F.when(F.col("id") % 8 == 0, F.col("id")).alias("k"))
    right = spark.range(0, 4000, 16).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    found = join_known(left, right, ["k"])
    assert rows(found.select("id", "k", "v")) == rows(left.join(right, "k", "left").select("id", "k", "v"))
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [len(part) for part in join_known(left, right, ["k"]).rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert max(sizes) < 0.5 * sum(sizes)


def test_loans_without_an_account_number_do_not_meet_in_one_task(spark):
    loans = spark.createDataFrame([(1, 1, "USD", "p1", 10), (2, 1, "USD", "p1", None), (3, 2, "USD", "p2", None), (4, None, "USD", "p4", None), (5, 1, "USD", "p1", 99)],
                                  "loan_id long, customer_id long, currency_code string, msisdn1 string, savings_account_id long")
    savings = spark.createDataFrame([(10, 1, "USD", "p1", "NORMAL SAVINGS"), (11, 2, "USD", "x", "NORMAL SAVINGS"), (12, None, "USD", "p4", "NORMAL SAVINGS")],
                                    "savings_id long, customer_id long, currency_code string, msisdn string, account_type string")
    found = S.link_loans(loans, savings)
    assert {r["loan_id"]: (r["savings_id_correspondant"], r["statut_controle"], r["motif_controle"]) for r in found.collect()} == {
        1: (10, "Conforme", None), 2: (10, "Conforme", None), 3: (11, "A revoir", "Ecart de telephone"), 4: (None, "A revoir", "Aucun compte courant"),
        5: (None, "A revoir", "Identifiant direct introuvable")}
    plan = plan_of(found)
    assert "__dealt" in plan and "SortMergeJoin" not in plan


def test_accounts_are_dealt_out_before_they_are_aggregated(spark):
    loans = spark.createDataFrame([(1, 1, "USD", "p1", 10, 8.0, 4.0), (2, 1, "USD", "p1", None, 2.0, 1.0), (3, None, "USD", "p2", None, 1.0, 1.0), (4, 3, "CDF", "p3", 14, 5.0, 5.0)],
                                  "loan_id long, customer_id long, currency_code string, msisdn1 string, savings_account_id long, loan_amount double, loan_balance double")
    savings = spark.createDataFrame(
        [(10, 1, "USD", "p1", "NORMAL SAVINGS", 5.0), (11, 1, "USD", "p1", "FIXED SAVINGS", 2.5), (11, 1, "USD", "p1", "FIXED SAVINGS", 2.5), (12, None, "USD", "p2", "NORMAL SAVINGS", 7.0),
         (12, None, "USD", "p2", "NORMAL SAVINGS", 7.0), (13, 2, "CDF", "p9", "FIXED SAVINGS", 0.0), (14, 3, "CDF", "p3", "NORMAL SAVINGS", None), (14, 3, "CDF", "p3", "NORMAL SAVINGS", None),
         (None, 4, None, "p4", "NORMAL SAVINGS", 3.0)],
        "savings_id long, customer_id long, currency_code string, msisdn string, account_type string, balance double").coalesce(1)
    linked, held = S.link_loans(loans, savings), S.client_positions(loans, savings)
    # Groups and sums are taken of accounts that came by number, not of a whole split.
    for plan in (plan_of(linked), plan_of(held)):
        assert plan.count("REPARTITION_BY_NUM") == 2
    assert {r["loan_id"]: (r["savings_id_correspondant"], r["motif_controle"]) for r in linked.collect()} == {
        1: (10, None), 2: (10, None), 3: (None, "Aucun compte courant"), 4: (None, "Plusieurs comptes pour l'identifiant direct")}
    wanted = sorted([(1, "USD", 2, 1, 2, 10.0, 5.0, 5.0, 5.0, 10.0), (None, "USD", 1, 0, 0, 1.0, 1.0, 0.0, 0.0, 0.0), (None, "USD", 0, 2, 0, 0.0, 0.0, 14.0, 0.0, 14.0),
                     (3, "CDF", 1, 2, 0, 5.0, 5.0, 0.0, 0.0, 0.0), (4, None, 0, 1, 0, 0.0, 0.0, 3.0, 0.0, 3.0)], key=str)
    assert sorted(map(tuple, held.collect()), key=str) == wanted
    assert sorted(map(tuple, S.client_positions(loans, savings.drop("savings_id")).collect()), key=str) == wanted
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        many = spark.range(4000).select(F.col("id").alias("savings_id"), F.lit(None).cast("long").alias("customer_id"), F.lit("USD").alias("currency_code")).coalesce(1)
        sizes = [len(part) for part in S.dealt(many, *S.KEY).rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert max(sizes) < 0.5 * sum(sizes) == 2000


def test_orders_are_not_sorted_to_meet_their_clients(spark, tables):
    for view in (V.dossiers, V.operations):
        assert "ShuffledHashJoin" in plan_of(view(spark, tables))


def test_accounts_are_made_after_the_profile_is_joined(spark, tables):
    found = RP.accounts(spark, tables)
    owner = V.clients(spark, tables).drop("solde_compte")
    wanted = V.savings(spark, tables).select(F.col("customer_id").alias("client_id"), F.col("savings_id").alias("compte_id"), F.col("balance").alias("solde_compte")).join(owner, "client_id")
    assert rows(found.select(*wanted.columns)) == rows(wanted)
    assert found.count() == 16
    plan = plan_of(found)
    assert plan.index("Generate explode") < plan.index("Join")


def accounts(spark):
    return spark.createDataFrame(
        [("USD", 1, 10, 5.0, "DAT", "G1"), ("USD", 1, 10, 5.0, "DAT", "G1"), ("USD", 2, 11, 0.0, "Compte Epargne Ordinaire USD", "G2"), ("CDF", 2, None, 2800.0, "Autre", None),
         (None, None, 12, 1.5, "DAT", "G1"), ("CDF", 3, 10, 0.0, "Autre", "G1")],
        "devise string, client_id long, compte_id long, solde_compte double, type_produit string, agent_credit string")


def test_savings_measures_keep_no_sums_beside_identifiers(spark):
    found = R.savings_measures(accounts(spark))
    assert {r["devise"]: (r["clients"], r["comptes"], r["epargne"], r["solde_moyen"], r["encours_dat"], r["part_dat"]) for r in found.collect()} == {
        "USD": (2, 2, 10.0, 5.0, 10.0, 1.0), "CDF": (2, 1, 2800.0, 2800.0, 0.0, 0.0), None: (0, 1, 1.5, 1.5, 1.5, 1.0)}
    assert "Expand" not in plan_of(found)


def test_savings_ratios_keep_no_sums_beside_identifiers(spark):
    found = P.savings_ratios(accounts(spark).withColumn("source_currency", F.col("devise")), 2800.0)
    row = found.first()
    assert (row["comptes_actifs"], row["comptes_par_gestionnaire"], row["total_depots_usd"]) == (3, 1.0, 12.5)
    assert "Expand" not in plan_of(found)
