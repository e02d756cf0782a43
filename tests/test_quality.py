from pyspark.sql import functions as F

from comptoir.operators import filters
from comptoir.operators import quality as Q


def people(spark):
    rows = [(1, " Jean ", "Nord", None), (2, "JEAN", "Sud", "x"), (3, "Paul", None, "y"), (4, "jean", "Est", "z"), (5, None, "Est", "z"), (6, None, "Ouest", "z")]
    return spark.createDataFrame(rows, "id int, nom string, zone string, code string")


def test_duplicate_modes(spark):
    df = people(spark)
    def ids(mode, **kw):
        return sorted(r["id"] for r in Q.handle_duplicates(df, "id", mode, columns=["nom"], **kw).collect())

    assert ids("afficher") == [2, 4, 6] and ids("afficher", keep="last") == [1, 2, 5] and ids("afficher", keep=None) == [1, 2, 4, 5, 6]
    assert ids("afficher_tous") == [1, 2, 4, 5, 6]
    assert ids("nettoyer") == [1, 3, 5] and ids("nettoyer", keep="last") == [3, 4, 6] and ids("nettoyer", keep=None) == [3]
    count = Q.handle_duplicates(df, "id", "compter", columns=["nom"]).first()
    assert (count["groupes"], count["lignes_dupliquees"]) == (2, 3)
    detail = {r["nom"]: (r["nombre_occurrences"], r["lignes_dupliquees"], r["nb_missing"]) for r in Q.handle_duplicates(df, "id", "detail_complet", columns=["nom"]).collect()}
    assert detail == {" Jean ": (3, 2, 1), None: (2, 1, 1)}
    exact = Q.handle_duplicates(df, "id", "compter", columns=["nom"], normalize=False).first()
    assert exact["lignes_dupliquees"] == 1


def test_suggestions_rank_priority_then_completeness(spark):
    out = {r["id"]: (r["rang_conservation"], r["suggestion"]) for r in Q.suggest_deletions(
        people(spark), "id", ["nom"], "zone", ["SUD"], ["zone", "code"]).collect()}
    assert out == {2: (1, "Garder"), 4: (2, "Supprimer"), 1: (3, "Supprimer"), 5: (1, "Garder"), 6: (2, "Supprimer")}


def test_profile_and_pairs(spark):
    df = people(spark)
    profile = {r["colonne"]: r for r in Q.column_profile(df, ["nom", "code"]).collect()}
    assert (profile["nom"]["vides"], profile["nom"]["valeurs_distinctes"], profile["nom"]["valeur_dominante"], profile["nom"]["taux_dominant"]) == (2, 2, "jean", 0.75)
    copies = df.select("nom", F.col("nom").alias("copie"), F.upper(F.trim("nom")).alias("haut"))
    assert {(r["colonne_a"], r["colonne_b"], r["relation"]) for r in Q.redundant_pairs(copies).collect()} == {
        ("nom", "copie", "identiques"), ("nom", "haut", "identiques_apres_normalisation"), ("copie", "haut", "identiques_apres_normalisation")}


def test_missing_analysis_reports_absent_columns(spark):
    out = {r["variable"]: (r["presence"], r["manquantes"], r["decision"]) for r in Q.missing_analysis(people(spark), ["nom", "id", "ville"]).collect()}
    assert out == {"nom": ("Présente", 2, "Prioritaire"), "id": ("Présente", 0, "OK"), "ville": ("Absente", 6, "Colonne absente")}


def test_latest_version_lists_its_files(spark):
    rows = [("a", 1, "x.csv"), ("a", 2, "y.csv"), ("b", 1, "x.csv")]
    df = spark.createDataFrame(rows, "k string, v int, f string")
    out = {r["k"]: (r["v"], r["fichiers_sources"]) for r in Q.latest_versions(df, F.col("k"), [F.col("v")], "f").collect()}
    assert out == {"a": (2, "x.csv | y.csv"), "b": (1, "x.csv")}


def test_filter_columns_have_no_default_cap(spark):
    rows = [tuple(f"{c}{i if c else i % 2}" for c in range(7)) for i in range(100)]
    df = spark.createDataFrame(rows, ", ".join(f"c{c} string" for c in range(7)))
    assert filters.pick_filter_columns(df) == [f"c{c}" for c in range(7)]
    assert filters.pick_filter_columns(df, max_columns=5, max_unique=80) == ["c0"]


def test_redundant_pairs_by_fingerprint(spark):
    rows = [(i, f"A {i}", f"a  {i}", f"A {i}", None, "", i % 2, "x" if i % 2 else "y") for i in range(50)] * 2
    df = spark.createDataFrame(rows, "k int, a string, b string, c string, d string, e string, s int, f string")
    out = {(r["colonne_a"], r["colonne_b"]): (r["relation"], r["lignes"]) for r in Q.redundant_pairs(df, ["k", "a", "b", "c", "d", "e", "f"]).collect()}
    assert out == {("a", "b"): ("identiques_apres_normalisation", 100), ("a", "c"): ("identiques", 100), ("b", "c"): ("identiques_apres_normalisation", 100)}
    other = df.withColumn("c", F.when((F.col("k") == 3), "A 4").otherwise(F.col("c")))
    by = {(r["s"], r["colonne_a"], r["colonne_b"]) for r in Q.redundant_pairs(other, ["a", "b", "c"], ["s"]).collect()}
    assert by == {(0, "a", "b"), (0, "a", "c"), (0, "b", "c"), (1, "a", "b")}
    assert Q.redundant_pairs(df, ["a"]).count() == 0 and Q.redundant_pairs(df.where("k < 0"), ["a", "c"]).count() == 0


def test_filter_columns_are_counted_exactly_at_the_limit(spark):
    from comptoir.operators import filters as FL
    df = spark.createDataFrame([(f"p{i % 80}", f"q{i % 81}", f"r{i}", "one", None, " ") for i in range(4000)], "p string, q string, r string, one string, none string, blank string")
    assert FL.pick_filter_columns(df, max_unique=80) == ["p"]
    assert FL.pick_filter_columns(df, ["r", "zz"], max_unique=81) == ["r", "p", "q"]
    assert FL.pick_filter_columns(df) == ["p", "q", "r"] and FL.pick_filter_columns(df, max_columns=1) == ["p"]
