"""Worked numbers of the wallet analyses on small ledgers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from comptoir.operators import forecast as FC
from comptoir.operators import periods as T
from comptoir.operators import positions as P
from comptoir.operators import receipts as R
from comptoir.operators import wallet as W

LEDGER = ("id string, customer_id string, msisdn1 string, account_type string, reference_id string, currency_code string, dr double, cr double, "
          "bal_before double, bal_after double, ref_no string, description string, created_at timestamp_ntz")


def ledger(spark, rows):
    """(account, description, reference, ref_no, time, dr, cr, balance after) per line, one customer."""
    out = []
    for i, (account, text, reference, ref_no, time, dr, cr, after) in enumerate(rows):
        out.append((f"{i:03d}", "C1", "243810000001", account, reference, "CDF", float(dr), float(cr), 0.0, float(after), ref_no, text, dt.datetime.fromisoformat(time)))
    return spark.createDataFrame(out, LEDGER)


@pytest.fixture(scope="module")
def story(spark):
    loan, pay, back = "2026-07-03 08:00:00", "2026-07-04 08:00:00", "2026-07-05 08:00:00"
    return ledger(spark, [
        ("MPESA ACCOUNT", "M-Pesa Depot", "SAV-1", None, "2026-07-01 08:00:00", 100, 0, 100), ("NORMAL SAVINGS", "Epargne depot", "SAV-1", None, "2026-07-01 08:00:00", 0, 100, 100),
        ("MPESA ACCOUNT", "M-Pesa Compte", "DAT-1", None, "2026-07-02 08:00:00", 50, 0, 50), ("FIXED SAVINGS", "Depot Bloque", "DAT-1", None, "2026-07-02 08:00:00", 0, 50, 50),
        ("PRINCIPLE", "Montant principal", "L1", None, loan, 100, 0, 100), ("LOAN ACCOUNT", "Compte de pret", "L1", None, loan, 0, 110, 110),
        ("INTEREST EARNED", "Revenu du interets", "L1", None, loan, 0, 10, 10), ("MPESA ACCOUNT", "Montant pret", "L1", None, loan, 0, 100, 100),
        ("MPESA ACCOUNT", "Compte du M-Pesa", "L1", None, loan, 10, 0, 10),
        ("PRINCIPLE", "Remboursement du principal", "L1", None, pay, 0, 40, 60), ("MPESA ACCOUNT", "Remboursement du M-Pesa", "L1", None, pay, 40, 0, 40),
        ("LOAN PENALTY FEES", "Compte de penalite de pret", "L1", None, pay, 0, 5, 5),
        ("FIXED SAVINGS", "Retrait Compte Bloque", "DAT-1", None, back, 20, 0, 30), ("NORMAL SAVINGS", "Retrait Compte Bloque", "SAV-1", None, back, 20, 0, 120),
    ])


def test_events_and_credit_summary(spark, story):
    journal = W.events(story)
    kinds = sorted(r["type_operation"] for r in journal.collect())
    assert kinds == sorted([W.DEPOSIT, W.TERM_DEPOSIT, W.DISBURSEMENT, W.PENALTY_REPAYMENT, W.RELEASE])
    credit = W.credit_summary(journal).first()
    assert (credit["montant_decaisse"], credit["dette_creee"], credit["interet_observe"]) == (100.0, 110.0, 10.0)
    assert (credit["principal_rembourse"], credit["montant_paye"], credit["penalite_observee"]) == (40.0, 40.0, 5.0)
    flows = T.flow_summary(journal, dt.date(2026, 7, 1), dt.date(2026, 7, 5)).first()
    assert (flows["nombre_operations"], flows["montant_entrees"], flows["montant_sorties"], flows["decaissements"]) == (5, 190.0, 100.0, 100.0)


def test_positions_follow_the_last_balance(spark, story):
    snapshots = spark.createDataFrame([("C1", "CDF", "Epargne courante", 120.0), ("C1", "CDF", "DAT", 30.0), ("C1", "CDF", "Credit", 60.0)],
                                      "customer_id string, currency_code string, famille_position string, solde_instantane double")
    out = {r["famille_position"]: (r["solde_observe"], r["statut_rapprochement"]) for r in W.positions(story, snapshots).collect()}
    assert out == {"Epargne courante": (120.0, "Conforme"), "DAT": (30.0, "Conforme"), "Credit": (60.0, "Conforme")}


def test_loan_of_five_with_seven_percent(spark):
    start, end = "2026-07-22 16:17:16", "2026-07-22 16:26:43"
    lines = ledger(spark, [
        ("PRINCIPLE", "Montant principal", "P1", None, start, 5, 0, 5), ("LOAN ACCOUNT", "Compte de pret", "P1", None, start, 0, 5.35, 5.35),
        ("MPESA ACCOUNT", "Montant pret", "P1", None, start, 0, 5, 5), ("MPESA ACCOUNT", "Compte du M-Pesa", "P1", None, start, 0.35, 0, 0.35),
        ("MPESA ACCOUNT", "Remboursement du M-Pesa", "P1", "RET1", end, 5, 0, 5), ("NORMAL SAVINGS", "Remboursement de compte epargne", "", "RET1", end, 5, 0, 5),
        ("FIXED SAVINGS", "Remboursement de compte epargne", "", "RET1", end, 5, 0, 5)])
    journal = W.events(lines)
    assert journal.count() == 2
    split = W.loan_split(journal).first()
    assert (split["pret_brut"], split["interet_preleve"], split["net_verse"]) == (5.0, 0.35, 4.65)
    assert abs(split["taux_observe_pct"] - 7.0) < 1e-9 and abs(split["ecart_vs_reference"]) < 1e-9
    paid = journal.where(F.col("type_operation") == W.REPAYMENT).first()
    assert (paid["origine_remboursement"], paid["remboursement_compte_ouvert"], paid["montant_entree"], paid["nombre_lignes"]) == ("Compte ouvert", 5.0, 0.0, 3)


def test_statement_starts_from_the_opening(spark, story):
    opening = spark.createDataFrame([("C1", "CDF", 10000.0)], "customer_id string, currency_code string, ouverture double")
    lines = W.statement(W.events(story), opening).orderBy("rang").collect()
    assert [r["solde_apres"] for r in lines] == [9900.0, 9850.0, 9940.0, 9900.0]
    assert lines[-1]["solde_institution"] == 10090.0 and lines[-1]["solde_reel"]
    free = W.statement(W.events(story)).orderBy("rang").collect()
    assert free[-1]["solde_apres"] == -100.0 and not free[-1]["solde_reel"]


def test_release_finds_the_creation_of_its_deposit(spark, story):
    fixed = spark.createDataFrame([("C1", "CDF", "DAT-1", dt.datetime(2026, 7, 2, 7, 45), dt.date(2026, 7, 2))],
                                  "customer_id string, currency_code string, reference_dat string, created_at timestamp_ntz, date_approved date")
    row = W.term_deposit_creation(W.events(story), fixed, story).first()
    assert row["date_creation_dat"] == dt.datetime(2026, 7, 2, 7, 45) and row["date_fin_dat"] == dt.datetime(2026, 7, 5, 8)
    assert (row["montant_operation"], row["methode"]) == (20.0, "Compte exact")


RAW = "`Receipt No.` string, `Completion Time` string, `Initiation Time` string, `Reason Type` string, `Transaction Status` string, Currency string, `Paid In` string, Withdrawn string, `Opposite Party` string"


def test_receipt_formats(spark):
    raw = spark.createDataFrame([
        ("IN", "11-07-2026 12:47:24", None, "ShopC2B", "Completed", "CDF", "1000", None, "0812345678 - CLIENT DEPOT"),
        ("OUT", "11-07-2026 14:00:00", None, "Super Transaction", "Completed", "CDF", None, "-500", "0812345678 - CLIENT DEPOT"),
        ("ASK", "11-07-2026 15:00:00", None, "ShopLoanRequest", "Declined", "CDF", None, "-1500", "0833333333 - C")], RAW)
    out = {r["receipt_no"]: r for r in R.prepare_receipts(raw).collect()}
    assert (out["IN"]["montant"], out["IN"]["sens_flux"], out["IN"]["classe"], out["IN"]["nom_client"]) == (1000.0, "Entree", R.TO_DEPOSIT, "CLIENT DEPOT")
    assert out["IN"]["completion_time"] == dt.datetime(2026, 7, 11, 12, 47, 24) and out["IN"]["phone"] == "243812345678"
    assert (out["OUT"]["montant_signe"], out["OUT"]["classe"]) == (-500.0, R.INTERNAL)
    assert (out["ASK"]["classe"], out["ASK"]["statut_normalise"]) == (R.LOAN_REQUEST, "Declined")


@pytest.mark.parametrize("time, status, control", [
    ("2026-07-16 11:00:00", R.EXACT, "Conforme"), ("2026-07-16 11:00:01", R.WITH_GAP, "Ecart de date"), ("2026-07-16 12:00:01", R.UNMATCHED, "Non controle")])
def test_payout_matched_by_time(spark, time, status, control):
    lines = ledger(spark, [("MPESA ACCOUNT", "Retrait Vers M-Pesa", "SA-1", None, "2026-07-16 10:00:00", 0, 200, 0),
                           ("NORMAL SAVINGS", "Retrait Vers M-Pesa", "SA-1", None, "2026-07-16 10:00:00", 200, 0, 0)])
    raw = spark.createDataFrame([("R1", time, time, "ShopB2C", "Completed", "CDF", None, "-200", "243810000001 - CLIENT")], RAW)
    row = R.match_receipts(R.prepare_receipts(raw), lines).first()
    assert (row["statut_rapprochement"], row["controle_date"]) == (status, control)


def test_retention_leaves_open_windows_empty(spark):
    rows = [("A", "CDF", "2026-01-10"), ("B", "CDF", "2026-01-15"), ("A", "CDF", "2026-02-05"), ("B", "CDF", "2026-03-10"), ("U", "USD", "2026-01-20"), ("C", "CDF", "2026-05-15")]
    df = spark.createDataFrame([(p, c, dt.datetime.fromisoformat(d), True, R.TO_DEPOSIT) for p, c, d in rows],
                               "phone string, currency_code string, completion_time timestamp_ntz, incluse boolean, classe string")
    out = {(r["mois"], r["currency_code"]): r for r in R.retention(df).collect()}
    assert (out["2026-01", "CDF"]["clients_actifs"], out["2026-01", "CDF"]["retention_m1_pct"], out["2026-01", "CDF"]["retention_90j_pct"]) == (2, 50.0, 100.0)
    assert out["2026-01", "USD"]["retention_m1_pct"] == 0.0
    assert out["2026-05", "CDF"]["retention_m1_pct"] is None and not out["2026-05", "CDF"]["eligible_90j"]


def test_deposit_maturity_interest(spark):
    df = spark.createDataFrame([("D1", "C", "CDF", W.FIXED, 1000.0, dt.date(2026, 1, 1), dt.date(2026, 4, 1))],
                               "savings_id string, customer_id string, currency_code string, account_type string, balance double, date_approved date, maturity_date date")
    row = P.deposit_maturity(df, dt.date(2026, 3, 25), 12.0).first()
    assert row["duree_contractuelle_jours"] == 90 and abs(row["interet_estime"] - 1000 * 0.12 * 90 / 365) < 1e-9
    assert (row["tranche_echeance"], row["a_preparer"]) == ("0 a 7 jours", True)
    assert P.deposit_maturity(df, dt.date(2026, 3, 25), 0).first()["interet_estime"] is None


def test_digital_risk_ratios(spark):
    loans = spark.createDataFrame([("L1", "C1", "USD", 100.0, 80.0, 7.0, dt.date(2026, 7, 1), dt.datetime(2026, 6, 1)),
                                   ("L2", "C4", "USD", 9999.0, 9999.0, 0.0, dt.date(2026, 9, 1), dt.datetime(2026, 8, 18))],
                                  "loan_id string, customer_id string, currency_code string, loan_amount double, loan_balance double, interest_earned double, due_date date, created_at timestamp_ntz")
    savings = spark.createDataFrame([("S1", "C1", "USD", W.OPEN, 20.0, None, None, dt.datetime(2026, 1, 1)), ("D1", "C1", "USD", W.FIXED, 50.0, dt.date(2026, 6, 1), dt.date(2026, 9, 1), dt.datetime(2026, 6, 1))],
                                    "savings_id string, customer_id string, currency_code string, account_type string, balance double, date_approved date, maturity_date date, created_at timestamp_ntz")
    clients = P.risk_clients(loans, savings, dt.date(2026, 8, 17))
    row = clients.first()
    assert clients.count() == 1 and row["segment_observe"] == "credit_retard_30j_plus" and row["segment_couverture_dat"] == "couverture_50_75_pct"
    assert (row["couverture_epargne_pct"], row["couverture_dat_pct"], row["taux_credit_dat_pct"], row["duree_dat_max_jours"]) == (87.5, 62.5, 160.0, 92)
    assert "CR06_credit_superieur_epargne" in row["signaux_attention"] and "EP01_dat_positif" in row["signaux_positifs"]
    assert abs(row["marge_estimee"] + row["cout_dat"] - 5.0) < 1e-9


def test_comparison_windows():
    w = T.comparison_windows(dt.date(2026, 7, 25))
    assert (w["debut_courante"], w["debut_precedente"], w["fin_precedente"]) == (dt.date(2026, 7, 19), dt.date(2026, 7, 12), dt.date(2026, 7, 18))
    f = T.comparison_windows(dt.date(2026, 7, 25), dt.date(2026, 4, 20), "Période filtrée")
    assert (f["debut_precedente"], f["fin_precedente"]) == (dt.date(2026, 1, 13), dt.date(2026, 4, 19))


def test_forecast_of_a_constant_series(spark):
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    rows = [("volume", "CDF", d, 150.0) for d in days] + [("volume", "USD", d, 1.5) for d in days] + [("operations", "CDF", d, 1.0) for d in days[-10:]]
    series = FC.daily_series(spark.createDataFrame(rows, "indicateur string, currency_code string, jour date, valeur double"), days[-1])
    out = FC.forecast(series, 30)
    summary = {(r["indicateur"], r["currency_code"]): r for r in FC.forecast_summary(out).collect()}
    assert abs(summary["volume", "CDF"]["valeur_prevue_horizon"] - 4500) < 1e-6 and abs(summary["volume", "USD"]["valeur_prevue_horizon"] - 45) < 1e-6
    assert summary["volume", "CDF"]["wape_pct"] < 0.01 and summary["volume", "CDF"]["qualite"] == "Bonne"
    assert ("operations", "CDF") not in summary
    assert out.where("statut = 'Historique insuffisant'").count() == 1


def _projected(values, weekdays, ahead):
    """The forecast of one series, day by day."""
    recent, pattern = values[-28:], values[-56:]
    level, base = sum(recent) / len(recent), sum(pattern) / len(pattern) or 1.0
    if level <= 0:
        return [0.0] * len(ahead)
    factors = []
    for day in range(7):
        same = [v for v, w in zip(pattern, weekdays[-56:]) if w == day]
        factors.append(min(max(sum(same) / len(same) / base, 0.25), 4.0) if same else 1.0)
    trend = (sum(recent[-14:]) / len(recent[-14:]) - sum(recent[:14]) / len(recent[:14])) / 14
    trend = min(max(trend, -0.01 * level), 0.01 * level)
    return [max((level + trend * min(step, 14)) * factors[w], 0.0) for step, w in enumerate(ahead, 1)]


@pytest.mark.parametrize("size, folds", [(27, 1), (28, 1), (40, 2), (61, 1), (130, 3)])
def test_forecast_and_back_test_against_one_series_at_a_time(spark, size, folds):
    import random

    rng = random.Random(size)
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(size)]
    values = [float(rng.choice([0, 5, 10, 40]) + i % 7 * 3 + i / 4) for i in range(size)]
    series = spark.createDataFrame([("volume", "CDF", d, v) for d, v in zip(days, values)] + [("volume", "USD", d, 0.0) for d in days], "indicateur string, currency_code string, jour date, valeur double")
    out = FC.forecast(series, 20, folds=folds).where("currency_code = 'CDF'").orderBy("date").collect()
    if size < 28:
        assert [(r["statut"], r["prevision"]) for r in out] == [("Historique insuffisant", None)]
        return
    week = [d.weekday() for d in days]
    ahead = [(days[-1] + dt.timedelta(days=i)).weekday() for i in range(1, 21)]
    assert [round(r["prevision"], 8) for r in out] == [round(v, 8) for v in _projected(values, week, ahead)]
    held, errors = min(14, size // 4), []
    for k in range(1, folds + 1):
        end = size - k * held
        if end >= 14:
            errors += [(a - p, a) for a, p in zip(values[end:end + held], _projected(values[:end], week[:end], week[end:end + held]))]
    assert abs(out[0]["mae"] - sum(abs(e) for e, _ in errors) / len(errors)) < 1e-9
    assert abs(out[0]["wape_pct"] - 100 * sum(abs(e) for e, _ in errors) / sum(a for _, a in errors)) < 1e-9


def test_operators_do_not_depend_on_partitioning(spark, story):
    many = story.unionByName(story.withColumns({"customer_id": F.lit("C2"), "id": F.concat(F.lit("b"), "id")}))
    one, eight = (sorted(map(str, W.credit_summary(W.events(many.repartition(n))).collect())) for n in (1, 8))
    assert one == eight
