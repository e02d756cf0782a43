"""Registered queries of approximate matching. Their SQL scores all pairs of distinct texts with the longest common subsequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from comptoir.operators import fuzzy as Z
from comptoir.registry import views as V
from comptoir.registry.base import register


def typed_names(spark, sf):
    """Part names as a clerk might type them: words swapped, a letter dropped or doubled."""
    key, name = F.col("p_partkey"), F.col("p_name")
    words = F.split(name, " ")
    swapped = F.array_join(F.reverse(words), " ")
    dropped = F.concat(F.substring(name, 1, 2), F.expr("substring(p_name, 4)"))
    doubled = F.concat(name, F.right(name, F.lit(1)))
    typed = F.when(key % 4 == 0, swapped).when(key % 4 == 1, dropped).when(key % 4 == 2, doubled).otherwise(name)
    return V.table(spark, sf, "part").select("p_partkey", typed.alias("saisie"))


TYPED = """CASE p_partkey % 4 WHEN 0 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ') WHEN 1 THEN left(p_name, 2) || substr(p_name, 4) WHEN 2 THEN p_name || right(p_name, 1) ELSE p_name END"""


def sorted_words(text):
    return f"array_to_string(list_sort(list_filter(string_split({text}, ' '), lambda w: w <> '')), ' ')"


def similarity(a, b):
    """Row by row: the best up to place j is the old best there, or one more than the old best before an equal letter up to j."""
    start = f"[list_transform(range(len({b}) + 1), lambda j: 0)]"
    letters = f"list_transform(range(1, len({a}) + 1), lambda i: [unicode(substr({a}, i, 1))])"
    before = f"list_transform(list_filter(range(1, j + 1), lambda k: unicode(substr({b}, k, 1)) = x[1]), lambda k: best[k] + 1)"
    table = f"list_reduce(list_concat({start}, {letters}), lambda best, x: list_transform(range(len({b}) + 1), lambda j: greatest(best[j + 1], coalesce(list_max({before}), 0))))"
    return f"200.0::DOUBLE * ({table})[-1] / (len({a}) + len({b}))"


def scored(left, right, threshold, name="scored"):
    """CTEs: the pairs of two one-column queries (t) whose score with sorted words reaches the threshold."""
    l, r = sorted_words("l.t"), sorted_words("r.t")
    return f"""{name}_pairs AS (SELECT DISTINCT {l} AS a, {r} AS b FROM ({left}) l, ({right}) r), {name} AS (
  SELECT * FROM (SELECT a, b, CASE WHEN a = b THEN 100.0 ELSE {similarity('a', 'b')} END AS score FROM {name}_pairs) WHERE score >= {threshold}
)"""


@register("J3_best_association", f"""
WITH typed AS (SELECT p_partkey, {TYPED} AS saisie FROM part), refs AS (
  SELECT {sorted_words('p_name')} AS b, min(p_partkey) AS o FROM part GROUP BY 1
), {scored('SELECT DISTINCT saisie AS t FROM typed', 'SELECT DISTINCT p_name AS t FROM part', 80)}, best AS (
  SELECT a, score, o FROM scored JOIN refs USING (b) QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, o) = 1
)
SELECT t.p_partkey, saisie, p.p_name AS valeur_associee, score AS pct_approximation, p.p_brand AS p_brand_associe
FROM typed t LEFT JOIN best ON a = {sorted_words('saisie')} LEFT JOIN part p ON p.p_partkey = o""")
def j3(spark, sf):
    part = V.table(spark, sf, "part")
    return Z.best_association(typed_names(spark, sf), "saisie", part, "p_name", ["p_brand"], "p_partkey", 80)


@register("J2_approximate_join", f"""
WITH typed AS (SELECT p_partkey, {TYPED} AS saisie FROM part), names AS (
  SELECT p_name, count(*) AS pieces FROM part GROUP BY p_name
), firsts AS (
  SELECT {sorted_words('p_name')} AS b, min(p_name) AS p_name FROM names GROUP BY 1
), {scored('SELECT DISTINCT saisie AS t FROM typed', 'SELECT p_name AS t FROM names', 80)}, best AS (
  SELECT a, p_name FROM scored JOIN firsts USING (b) QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, p_name) = 1
)
SELECT t.p_partkey, saisie AS p_name_gauche, n.p_name AS p_name_droite, pieces
FROM typed t LEFT JOIN best ON a = {sorted_words('saisie')} LEFT JOIN names n ON n.p_name = best.p_name""")
def j2(spark, sf):
    typed = typed_names(spark, sf).select("p_partkey", F.col("saisie").alias("p_name"))
    names = V.table(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("pieces"))
    return Z.approximate_join(typed, names, "p_name", "left", 80)


@register("J2_approximate_join_keys", f"""
WITH typed AS (
  SELECT p_partkey, {TYPED} AS p_name, CASE p_partkey % 3 WHEN 0 THEN left(p_type, 3) || substr(p_type, 5) ELSE p_type || '.' END AS p_type FROM part
), lots AS (
  SELECT p_name, p_type, count(*) AS pieces FROM part GROUP BY ALL
), prices AS (
  SELECT p_name || 's' AS p_name, p_type, max(p_size) AS pieces FROM part GROUP BY ALL
), up AS (SELECT {sorted_words('p_name')} AS b, min(p_name) AS v FROM prices GROUP BY 1),
firsts AS (SELECT {sorted_words('p_name')} AS b, min(p_name) AS v FROM lots GROUP BY 1), kinds AS (SELECT {sorted_words('p_type')} AS b, min(p_type) AS v FROM lots GROUP BY 1),
{scored('SELECT DISTINCT p_name AS t FROM typed', 'SELECT DISTINCT p_name AS t FROM lots', 80, 'named')}, {scored('SELECT DISTINCT p_type AS t FROM typed', 'SELECT DISTINCT p_type AS t FROM lots', 80, 'typed_as')},
{scored('SELECT DISTINCT p_name AS t FROM typed', 'SELECT DISTINCT p_name AS t FROM prices', 80, 'upper_named')},
best AS (SELECT a, v FROM named JOIN firsts USING (b) QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, v) = 1),
kind AS (SELECT a, v FROM typed_as JOIN kinds USING (b) QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, v) = 1),
above AS (SELECT a, v FROM upper_named JOIN up USING (b) QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, v) = 1)
SELECT t.p_partkey, t.p_name, t.p_type, l.p_name AS p_name_droite, l.p_type AS p_type_droite, l.pieces AS pieces_gauche,
  p.p_name AS p_name_droite_2, p.p_type AS p_type_droite_2, p.pieces AS pieces_droite
FROM typed t LEFT JOIN best ON best.a = {sorted_words('t.p_name')} LEFT JOIN kind ON kind.a = {sorted_words('t.p_type')}
LEFT JOIN lots l ON l.p_name = best.v AND l.p_type = kind.v LEFT JOIN above ON above.a = {sorted_words('t.p_name')} LEFT JOIN prices p ON p.p_name = above.v AND p.p_type = kind.v""")
def j2_keys(spark, sf):
    """Three tables on two typed keys; the third one has its names in the plural."""
    part = V.table(spark, sf, "part")
    typed = typed_names(spark, sf).join(part.select("p_partkey", "p_type"), "p_partkey")
    kind = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.left("p_type", F.lit(3)), F.expr("substring(p_type, 5)"))).otherwise(F.concat("p_type", F.lit(".")))
    typed = typed.select("p_partkey", F.col("saisie").alias("p_name"), kind.alias("p_type"))
    lots = part.groupBy("p_name", "p_type").agg(F.count("*").alias("pieces"))
    prices = part.groupBy(F.concat("p_name", F.lit("s")).alias("p_name"), "p_type").agg(F.max("p_size").alias("pieces"))
    return Z.approximate_join_all([typed, lots, prices], ["p_name", "p_type"], "left", 80)


@register("J4_approximate_comparison", f"""
WITH a AS (SELECT DISTINCT 'AGENCE' || ltrim(substr(s_name, 10), '0') AS t FROM supplier), b AS (SELECT DISTINCT 'AGENCE' || substr(n_name, 8) AS t FROM nation),
pairs AS (SELECT a.t AS l, b.t AS r FROM a, b WHERE CASE WHEN a.t = b.t THEN 100.0 ELSE {similarity('a.t', 'b.t')} END >= 90)
SELECT t AS cle, CASE WHEN t IN (SELECT l FROM pairs) THEN 'commun' ELSE 'premier seulement' END AS presence FROM a
UNION ALL SELECT t, 'second seulement' FROM b WHERE t NOT IN (SELECT r FROM pairs)""")
def j4(spark, sf):
    suppliers = V.table(spark, sf, "supplier").select(F.regexp_replace("s_name", "Supplier#0+", "Agence ").alias("nom"))
    nations = V.table(spark, sf, "nation").select(F.regexp_replace("n_name", "NATION_", "AGENCE-").alias("nom"))
    return Z.compare_values_approximately(suppliers, ["nom"], nations, ["nom"], 90)
