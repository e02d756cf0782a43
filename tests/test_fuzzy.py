import random

from comptoir.operators import fuzzy as Z


def brute(a: str, b: str) -> float:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            kept = row[j]
            row[j] = before + 1 if x == y else max(row[j], row[j - 1])
            before = kept
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def words(n, seed):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(n)})


def test_common_length_matches_the_table_method():
    texts = ["", *words(60, 1), "é" * 70 + "ab", "a" * 300]
    pairs = [(a, b) for a in texts for b in texts]
    found = Z.common_lengths([a for a, _ in pairs], [b for _, b in pairs])
    assert all(abs(200.0 * n / (len(a) + len(b)) - brute(a, b)) < 1e-9 for (a, b), n in zip(pairs, found) if a or b)


def test_pairs_are_complete_against_all_pairs(spark, monkeypatch):
    left, right = words(120, 2) + ["ab" * 40, "é b"], words(120, 3) + ["ab" * 38 + "c", "é  b"]
    l = spark.createDataFrame([(x,) for x in left], "l string")
    r = spark.createDataFrame([(x,) for x in right], "r string")
    monkeypatch.setattr(Z, "LIST", 5)
    for threshold in (70, 80, 92, 97):
        found = {(x["l"], x["r"]): x["score"] for x in Z.pairs_above(l, r, threshold).collect()}
        wanted = {(a, b): brute(a, b) for a in left for b in right if brute(a, b) >= threshold}
        assert set(found) == set(wanted)
        assert all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)


def test_best_association_prefers_score_then_first(spark):
    left = spark.createDataFrame([(1, "KABILA Jean Pierre"), (2, "Jean KABILA"), (3, "zzz"), (4, None)], "id int, nom string")
    ref = spark.createDataFrame([(10, "Jean Pierre KABILA", "A"), (11, "Jean KABILAA", "B"), (12, "Jean KABILAB", "C")], "o int, ref string, code string")
    out = {x["id"]: x for x in Z.best_association(left, "nom", ref, "ref", ["code"], "o", 80).collect()}
    assert (out[1]["code_associe"], out[1]["pct_approximation"]) == ("A", 100.0)
    assert out[2]["code_associe"] == "B"
    assert out[3]["valeur_associee"] is None and out[4]["valeur_associee"] is None


def test_approximate_join_keeps_the_left_rows_once(spark):
    left = spark.createDataFrame([(1, "small ring"), (2, "smal ring"), (3, "other")], "id int, nom string")
    right = spark.createDataFrame([("small ring", 5), ("large rod", 6)], "nom string, n int")
    out = {x["id"]: x["n"] for x in Z.approximate_join(left, right, "nom", "left", 85).collect()}
    assert out == {1: 5, 2: 5, 3: None}


def test_approximate_comparison(spark):
    a = spark.createDataFrame([("Agence Nord",), ("Agence Sudd",), ("X",)], "n string")
    b = spark.createDataFrame([("agence-nord",), ("AGENCE SUD",), ("YYYYY",)], "n string")
    out = {(x["cle"], x["presence"]) for x in Z.compare_values_approximately(a, ["n"], b, ["n"], 90).collect()}
    assert out == {("AGENCENORD", "commun"), ("AGENCESUDD", "commun"), ("X", "premier seulement"), ("YYYYY", "second seulement")}


def test_candidates_of_names_are_few(spark):
    rng = random.Random(9)
    names = sorted({" ".join("".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(4, 8))) for _ in range(2)) for _ in range(400)})
    typed = [n[:3] + n[4:] for n in names]
    l = spark.createDataFrame([(x,) for x in typed], "l string")
    r = spark.createDataFrame([(x,) for x in names], "r string")
    met = Z.candidate_pairs(l, r, 85)
    assert met.count() < 0.1 * len(names) ** 2
    assert met.where(Z.may_reach(85)).count() < 1.5 * len(names)
    assert {(x["l"], x["r"]) for x in Z.pairs_above(l, r, 85).collect()} >= set(zip(typed, names))


def test_equal_scores_go_to_the_smallest_text(spark):
    left = spark.createDataFrame([("abcdefgh",)], "nom string")
    right = spark.createDataFrame([("abcdefgz",), ("abcdefgi",), ("abcdefgy",)], "nom string")
    assert [x["nom_droite"] for x in Z.approximate_join(left, right, "nom", "left", 80).collect()] == ["abcdefgi"]


def test_several_keys_and_tables(spark):
    a = spark.createDataFrame([(1, "Jean Kabila", "Kinshasa"), (2, "Jean Kabila", "Goma"), (3, "zzzzzz", "Goma"), (4, None, "Goma")], "id int, nom string, ville string")
    b = spark.createDataFrame([("Kabila Jeane", "Kinshassa", 5), ("Kabila Jeane", "Bukavu", 6)], "nom string, ville string, n int")
    c = spark.createDataFrame([("Jean Kabila", "Goma", 7)], "nom string, ville string, n int")
    out = {x["id"]: x.asDict() for x in Z.approximate_join_all([a, b, c], ["nom", "ville"], "left", 80).collect()}
    assert {k: (v["n_gauche"], v["n_droite"]) for k, v in out.items()} == {1: (5, None), 2: (None, 7), 3: (None, None), 4: (None, None)}
    assert out[1]["nom"] == "Jean Kabila" and out[1]["nom_droite"] == "Kabila Jeane" and out[2]["ville_droite_2"] == "Goma"
    outer = Z.approximate_join_all([a, b], ["nom", "ville"], "outer", 80, with_source=True)
    assert outer.count() == 5 and {"Source_gauche", "Source_droite"} <= set(outer.columns)
    assert Z.approximate_join_all([a, c], "nom", "inner", 100).count() == 2
