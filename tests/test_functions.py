import datetime as dt

import pytest
from pyspark.sql import functions as F

from comptoir.functions import labels as L
from comptoir.functions import text as X
from comptoir.functions import values as V
from comptoir.functions.money import mean, total
from comptoir.operators import cleaning as C
from comptoir.sources import contracts as K


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value, wanted", [
    ("0997195079", "997195079"), ("+243 997195079", "997195079"), ("O997195079", "997195079"), ("243997195079", "997195079"),
    ("12345", None), ("", None), (None, None)])
def test_phone(spark, value, wanted):
    assert one(spark, value, V.clean_phone) == wanted


def test_several_phones(spark):
    text = "0812345678 / 0998765432 ou 243812345678"
    assert one(spark, text, lambda c: V.clean_phone(c, return_mode="join")) == "812345678; 998765432"
    assert one(spark, text, lambda c: V.clean_phone(c, add_prefix=True, return_mode="list", max_numbers=1)) == ["+243812345678"]


@pytest.mark.parametrize("value, wanted", [
    ("X@Gmail,com", "x@gmail.com"), ("a @ gamil.com;", "a@gmail.com"), ("a@b.com.com", "a@b.com"), ("rien", None)])
def test_email(spark, value, wanted):
    assert one(spark, value, V.clean_email) == wanted


def test_email_completion_only_on_request(spark):
    assert one(spark, "x@gmail", V.clean_email) is None
    assert one(spark, "x@gmail", lambda c: V.clean_email(c, complete_domain=True)) == "x@gmail.com"


@pytest.mark.parametrize("value, lang, wanted", [
    ("12/01/2026", "fr", dt.date(2026, 1, 12)), ("12/01/2026", "en", dt.date(2026, 12, 1)), ("12/01/2026", "all", None),
    ("31/12/2025", "all", dt.date(2025, 12, 31)), ("12/31/206", "fr", dt.date(2026, 12, 31)), ("45234", "fr", dt.date(2023, 11, 4)),
    ("1er mars 2025", "fr", dt.date(2025, 3, 1)), ("2026-01-12T10:00:00", "en", dt.date(2026, 1, 12)), ("non renseigné", "fr", None),
    ("99/99/2020", "fr", None)])
def test_dates(spark, value, lang, wanted):
    df = spark.createDataFrame([(value,)], "x string")
    assert V.parse_dates(df, {"x": "x"}, lang, "date", reference_year=2026).first()["x"] == wanted


@pytest.mark.parametrize("value, wanted", [("8h30", "08:30:00"), ("830", "08:30:00"), ("08:30:15", "08:30:15"), ("25:00", None), ("8h", None)])
def test_clock(spark, value, wanted):
    assert one(spark, value, V.to_clock) == wanted


@pytest.mark.parametrize("value, wanted", [("1 234,5", 1234.5), ("1 000", 1000.0), ("1e3", 1000.0), ("12d", None), ("abc", None)])
def test_number(spark, value, wanted):
    assert one(spark, value, V.to_number) == wanted


def test_title_follows_letters_not_spaces(spark):
    assert one(spark, "l'eau vive-été", X.title) == "L'Eau Vive-Été"


def test_labels(spark):
    assert one(spark, " IMPAYÉ ", L.repayment_status) == "En retard"
    assert one(spark, "Inconnu du bataillon ", L.file_status) == "Inconnu du bataillon"
    assert one(spark, "Avance sur Salaire", L.credit_product) == "avance_salaire"
    assert one(spark, "Société PME", L.is_corporate) is True


def test_risk_cascade(spark):
    df = spark.createDataFrame([("eleve", 90.0, None, None), (None, 79.0, 0.1, 0), (None, None, 0.31, 0), (None, None, None, 31), (None, None, None, None)],
                               "n string, s double, d double, r int")
    levels = [r[0] for r in df.select(L.risk_level(F.col("n"), F.col("s"), F.col("d"), F.col("r"))).collect()]
    assert levels == ["Élevé", "Moyen", "Moyen", "Élevé", "Non renseigné"]


def test_contract_names_what_is_missing(spark):
    df = spark.createDataFrame([(1, "a")], "ID int, `Montant ` string")
    rules = K.contract("x", "id, devise", "montant")
    with pytest.raises(K.ContractError) as error:
        K.validate(df, rules, "fichier.csv")
    assert error.value.missing == ("devise",) and "fichier.csv" in str(error.value)


def test_headers_that_meet_are_coalesced(spark):
    df = spark.createDataFrame([(None, "b", 1), ("a", "c", 2)], "receipt_no string, `Receipt No.` string, autre int")
    out = K.normalize_headers(df, K.RECEIPTS)
    assert out.columns == ["Receipt No", "autre"]
    assert [r[0] for r in out.collect()] == ["b", "a"]


def test_user_names_never_collide():
    assert K.user_columns(["a", "A", "É t é", "_"]) == ["a", "a_2", "e_t_e", "colonne"]


def test_contradictory_rules_are_rejected(spark):
    rules = spark.createDataFrame([("a", "x"), ("a", "y")], "original string, renamed string")
    with pytest.raises(C.RuleConflict):
        C.check_rules(rules)


def test_columns_are_typed_only_when_every_value_fits(spark):
    df = spark.createDataFrame([("1", "12/01/2026", "1"), ("2,5", "31/12/2025", "x"), (None, None, None)], "a string, b string, c string")
    out = C.clean_values(df, convert_types=True)
    assert dict(out.dtypes) == {"a": "double", "b": "timestamp_ntz", "c": "string"}
    assert out.collect()[1]["a"] == 2.5


def test_transfer_fills_only_blanks(spark):
    df = spark.createDataFrame([("s", None, "Nord"), ("s", "t", "Nord"), ("s", "", "Sud")], "a string, b string, z string")
    out = C.transfer_values(df, {"a": "b"}, filter_column="z", filter_values=["NORD"], normalize_filter=True, move=True).collect()
    assert [(r["a"], r["b"]) for r in out] == [(None, "s"), ("s", "t"), ("s", "")]


def test_nan_amounts_count_as_missing(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (None,), (2.5,)], "x double")
    row = df.select(total("x").alias("t"), mean("x").alias("m")).first()
    assert (row.t, row.m) == (4.0, 2.0)
