"""Registered queries of cleaning, filtering and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from comptoir.functions import text as X
from comptoir.functions import values as W
from comptoir.operators import cleaning as C
from comptoir.operators import filters as FL
from comptoir.registry import views as V
from comptoir.registry.base import register
from comptoir.registry.sqltext import NA_LIST, big, norm, squeeze, strip


def docs(spark, sf):
    return V.table(spark, sf, "documents")


def pick(values, slot):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (slot + 1).cast("int"))


def sql_list(values):
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


MARKERS = ["N/A", " inconnu ", "Aucune donnée", "valeur", "-", "", None, "Non renseigné", "Nan", "aucunement"]


@register("C1_missing_markers", f"""
SELECT p_partkey, CASE WHEN lower({strip('t')}) IN ({NA_LIST}) THEN NULL ELSE t END AS texte
FROM (SELECT p_partkey, {sql_list(MARKERS)}[CAST((p_partkey * 7 + p_size) % 10 AS INT) + 1] AS t FROM part)""")
def c1(spark, sf):
    part = V.table(spark, sf, "part").select(
        "p_partkey", pick(MARKERS, (F.col("p_partkey") * 7 + F.col("p_size")) % 10).alias("texte"))
    return C.clear_missing(part)


@register("C2_number_texts", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE o_totalprice END AS montant FROM orders""")
def c2(spark, sf):
    orders = V.table(spark, sf, "orders")
    plain = F.format_number("o_totalprice", 2)
    french = F.translate(plain, ",.", " ,")
    spaced = F.concat(F.lit(" "), F.translate(plain, ",", " "))
    text = F.when(F.col("o_orderkey") % 10 == 9, "n.c.").when(F.col("o_orderkey") % 2 == 0, french).otherwise(spaced)
    return orders.select("o_orderkey", W.to_number(text).alias("montant"))


FLAGS = ["OUI", " true", "0", "Vrai", "non", None, "1", "yes"]


@register("C3_flags", f"""
SELECT p_partkey, coalesce(lower({strip('t')}) IN ('1','true','vrai','oui'), false) AS drapeau
FROM (SELECT p_partkey, {sql_list(FLAGS)}[CAST(p_size % 8 AS INT) + 1] AS t FROM part)""")
def c3(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", W.to_flag(pick(FLAGS, F.col("p_size") % 8)).alias("drapeau"))


FRENCH = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre",
          "décembre"]


@register("C4_mixed_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS jour_fr,
  CASE WHEN o_orderkey % 6 = 5 THEN NULL WHEN o_orderkey % 6 = 0 AND day(o_orderdate) <= 12 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS jour_strict
FROM orders""")
def c4(spark, sf):
    day, slot = F.col("o_orderdate"), F.col("o_orderkey") % 6
    month_name = pick(FRENCH, F.month(day) - 1)
    text = (F.when(slot == 0, F.date_format(day, "dd/MM/yyyy"))
            .when(slot == 1, F.date_format(day, "yyyy-MM-dd"))
            .when(slot == 2, F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"))
            .when(slot == 3, F.concat_ws(" ", F.dayofmonth(day).cast("string"), month_name, F.year(day).cast("string")))
            .when(slot == 4, F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250")))
            .otherwise("Non renseigné"))
    rows = V.table(spark, sf, "orders").select("o_orderkey", text.alias("jour_fr"), text.alias("jour_strict"))
    return C.convert_dates(C.convert_dates(rows, "jour_fr", "fr", "date"), "jour_strict", "all", "date")


@register("C5_clock_texts", """
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 3 THEN strftime(ts, '%H:%M:%S') ELSE strftime(ts, '%H:%M:00') END AS heure FROM events""")
def c5(spark, sf):
    ts, slot = F.col("ts"), F.col("event_id") % 5
    text = (F.when(slot == 0, F.date_format(ts, "H'h'mm")).when(slot == 1, F.date_format(ts, "Hmm"))
            .when(slot == 2, F.date_format(ts, " HH:mm ")).when(slot == 3, F.date_format(ts, "H:mm:ss"))
            .otherwise("25h99"))
    return C.convert_times(V.table(spark, sf, "events").select("event_id", text.alias("heure")), "heure")


@register("C6_integers", f"""
SELECT o_orderkey, {big('trunc(o_totalprice)')} AS tronque, {big('round_even(o_totalprice, 0)')} AS arrondi FROM orders""")
def c6(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("tronque"), F.col("o_totalprice").alias("arrondi"))
    return C.convert_integers(C.convert_integers(o, "tronque", rounded=False), "arrondi")


RUNS = "regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+')"


def sql_title(x):
    return (f"array_to_string(list_transform({RUNS.format(x=x)}, lambda w: concat(upper(w[1]), lower(w[2:]))), '')")


def spaced(x):
    return squeeze(f"regexp_replace({x}, '[-_]', ' ', 'g')")


@register("C7_text_case", f"""
SELECT doc_id, md5({spaced(strip('text'))}) AS espaces,
  md5(upper(replace(strip_accents({spaced(strip('text'))}), 'ß', 'SS'))) AS majuscules,
  md5({sql_title(f"lower({spaced('lang')})")}) AS titre,
  md5({sql_title(spaced(strip("replace(text, 'ß', 's')")))}) AS mots
FROM documents""")
def c7(spark, sf):
    d = docs(spark, sf).select("doc_id", F.col("text").alias("espaces"), F.col("text").alias("majuscules"), F.col("lang").alias("titre"),
                               F.replace("text", F.lit("ß"), F.lit("s")).alias("mots"))
    out = C.normalize_values(d, "espaces", "none")
    out = C.normalize_values(out, "majuscules", "upper", remove_accents=True)
    out = C.normalize_values(out, ["titre", "mots"], "title")
    hashed = {c: F.md5(F.trim(F.col(c))) for c in ("espaces", "majuscules", "titre", "mots")}
    return out.withColumns(hashed)


@register("C7_value_cases", f"""
SELECT p_partkey, CASE WHEN lower({strip('t')}) IN ({NA_LIST}) OR t IS NULL THEN '' ELSE {sql_title(strip('t'))} END AS titre,
  CASE WHEN lower({strip('t')}) IN ({NA_LIST}) OR t IS NULL THEN '' ELSE concat(upper({strip('t')}[1]), lower({strip('t')}[2:])) END AS initiale,
  CASE WHEN lower({strip('t')}) IN ({NA_LIST}) THEN NULL ELSE upper({strip('t')}) END AS majuscule
FROM (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN ' Inconnu' ELSE concat(' ', p_name, '-', p_type) END AS t FROM part)""")
def c7b(spark, sf):
    text = F.when(F.col("p_size") % 7 == 0, " Inconnu").otherwise(F.concat(F.lit(" "), "p_name", F.lit("-"), "p_type"))
    p = V.table(spark, sf, "part").select("p_partkey", text.alias("titre"), text.alias("initiale"), text.alias("majuscule"))
    return C.uppercase_values(C.capitalize_values(C.title_values(p, "titre"), "initiale"), "majuscule")


@register("C8_exact_replacement", """
SELECT c.c_custkey, coalesce(CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'Ménage' WHEN 'MACHINERY' THEN 'Industrie' END, c.c_mktsegment) AS c_mktsegment FROM customer c""")
def c8(spark, sf):
    customer = V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    segment = F.col("c_mktsegment")
    rules = customer.select(segment.alias("original"), F.when(segment == "HOUSEHOLD", "Ménage").when(segment == "MACHINERY", "Industrie").alias("renamed"))
    rules = C.check_rules(rules.where("renamed IS NOT NULL").distinct())
    return C.replace_exact(customer, rules, "c_mktsegment")


RULES = [("Priorite", "1-.*", "Urgent"), ("Priorite", "2-high", "Haut"), ("Priorite", "(3|4)-.+", "Moyen"), ("Autre", ".*", "?")]


@register("C8_rule_replacement", f"""
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1-%' THEN 'Urgent' WHEN lower(o_orderpriority) = '2-high' THEN 'Haut'
  WHEN regexp_full_match(o_orderpriority, '(3|4)-.+') THEN 'Moyen' ELSE lower({strip('o_orderpriority')}) END AS priorite FROM orders""")
def c8b(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priorite"))
    return C.replace_by_rules(o, {"priorite": "priorite"}, RULES)


PHONE_LOCAL_SQL = """list_filter(list_transform(regexp_extract_all({t}, '\\+?[0-9]{{7,15}}'), lambda r: CASE
  WHEN starts_with(replace(r, '+', ''), '243') AND length(replace(r, '+', '')) = 12 THEN replace(r, '+', '')[4:]
  WHEN starts_with(replace(r, '+', ''), '0') AND length(replace(r, '+', '')) = 10 THEN replace(r, '+', '')[2:]
  WHEN length(replace(r, '+', '')) = 9 THEN replace(r, '+', '') END), lambda x: x IS NOT NULL)"""
ZERO_FIX = "regexp_replace(replace({x}, chr(160), ' '), '(^|[^\\p{{L}}\\p{{N}}_])[oO]([0-9])', '\\10\\2', 'g')"


def sql_phones(text):
    raw = PHONE_LOCAL_SQL.format(t=ZERO_FIX.format(x=strip(text)))
    return f"list_filter({raw}, lambda x, i: list_position({raw}, x) = i)"


def sql_or_null(values, how):
    return f"CASE WHEN len({values}) > 0 THEN {how} END"


@register("C9_phones_in_text", f"""
WITH p AS (SELECT doc_id, {sql_phones('text')} AS n FROM documents)
SELECT doc_id, n[1] AS premier, CASE WHEN len(n) > 0 THEN array_to_string(n, '; ') END AS tous FROM p""")
def c9a(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", W.clean_phone(t).alias("premier"), W.clean_phone(t, return_mode="join").alias("tous"))


@register("C9_phone_keys", """
SELECT client_id, CASE WHEN client_id % 11 = 0 OR (client_id % 13 = 0 AND client_id % 7 <> 0) THEN NULL
  WHEN client_id % 7 = 0 THEN concat('243', CAST(810000000 + client_id AS VARCHAR)) ELSE concat('243', CAST(810000000 + client_id % 400 AS VARCHAR)) END AS cle FROM v_clients""", ("v_clients",))
def c9b(spark, sf):
    return V.clients(spark, sf).select("client_id", W.phone_key(F.col("telephone")).alias("cle"))


EMAIL_STEPS = [("\\s*@\\s*", "@"), ("\\s*\\.\\s*", "."), ("\\s*,\\s*", ","), (",com\\b", ".com"), ("@gmail\\.co\\b", "@gmail.com"),
               ("gma\\s*il\\.com\\b", "gmail.com"), ("gamil\\.com\\b", "gmail.com"), ("gamail\\.com\\b", "gmail.com"),
               ("gmqil\\.com\\b", "gmail.com"), ("ygmail\\.com\\b", "gmail.com")]


def sql_emails(text):
    t = f"lower({strip(text)})"
    t = f"regexp_replace({t}, '[<>]', ' ', 'g')"
    t = f"regexp_replace({t}, '\\s+ou\\s+', ' ', 'g')"
    t = squeeze(f"regexp_replace({t}, '[;/]', ' ', 'g')")
    for pattern, fix in EMAIL_STEPS:
        t = f"regexp_replace({t}, '{pattern}', '{fix}', 'g')"
    t = f"regexp_replace({t}, '(\\.com)(\\.com)+\\b', '\\1', 'g')"
    t = f"regexp_replace({t}, '[\\s)\\]}}>,;]+$', '')"
    return f"list_transform(regexp_extract_all({t}, '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}'), lambda e: trim(e, '.,;:'))"


@register("C10_emails_in_text", f"""
WITH e AS (SELECT doc_id, {sql_emails('text')} AS n FROM documents)
SELECT doc_id, n[1] AS premier, CASE WHEN len(n) > 0 THEN array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), '; ') END AS tous FROM e""")
def c10(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", W.clean_email(t).alias("premier"), W.clean_email(t, "join").alias("tous"))


UNITS = ["12 ans", "3mois", "7 j", "5 a", "18", "2 jours", "1 an et demi", "x"]


@register("C11_substrings", f"""
SELECT c_custkey, split_part(split_part(c_name, 't', 2), '#', 1) AS entre, substr(c_name, 1, 4) AS prefixe, right(c_name, 3) AS suffixe,
  c_mktsegment AS mot, CASE WHEN c_custkey % 2 = 0 THEN concat(c_mktsegment, ' Nord') END AS nom,
  ['ans','mois','jours','ans','mois','jours','ans','mois'][CAST(c_custkey % 8 AS INT) + 1] AS unite,
  CAST([12,3,7,5,18,2,1,NULL][CAST(c_custkey % 8 AS INT) + 1] AS BIGINT) AS nombre
FROM customer""")
def c11(spark, sf):
    key, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    unit = pick(UNITS, key % 8)
    place = F.when(key % 2 == 0, F.concat(F.lit("Bn "), segment, F.lit(" Nord Zone de Santé"))).otherwise(segment)
    return V.table(spark, sf, "customer").select(
        "c_custkey", X.between_markers(name, "t", "#").alias("entre"), X.prefix(name, 4, "caractere").alias("prefixe"),
        X.suffix(name, 3, "caractere").alias("suffixe"), X.suffix(F.concat(F.lit("a b "), segment)).alias("mot"),
        X.generic_name(place).alias("nom"), X.duration_unit(unit).alias("unite"), X.duration_number(unit).alias("nombre"))


@register("C12_separators", """
SELECT p_partkey, concat(p_name, ' 2 x') AS tirets, array_to_string(list_transform(string_split(p_name, ' '), lambda w: concat(upper(w[1]), w[2:])), ' ') AS espaces,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: concat(upper(w[1]), w[2:])), '_') AS soulignes FROM part""")
def c12(spark, sf):
    name = F.col("p_name")
    return V.table(spark, sf, "part").select(
        "p_partkey", X.hyphens_to_spaces(F.concat(F.replace(name, F.lit(" "), F.lit("- ")), F.lit(" -ii  x"))).alias("tirets"),
        X.underscores_to_spaces(F.translate(name, " ", "_")).alias("espaces"),
        X.spaces_to_underscores(F.replace(name, F.lit(" "), F.lit("  "))).alias("soulignes"))


@register("C14_duplicate_columns", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS nom FROM customer""")
def c14(spark, sf):
    from comptoir.sources.contracts import coalesce_duplicates
    c = V.table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("nom"),
                                              F.col("c_mktsegment").alias("nom"))
    return coalesce_duplicates(c)


@register("C18_conversion", """
SELECT operation_id, CASE WHEN upper(code_devise) = 'CDF' THEN montant_operation ELSE montant_operation * 2800 END AS montant_reporting_cdf FROM v_operations""", ("v_operations",))
def c18(spark, sf):
    from comptoir.operators.aml import to_reporting_currency
    return to_reporting_currency(V.operations(spark, sf), 2800.0).select("operation_id", "montant_reporting_cdf")


@register("C19_column_merge", """
SELECT c_custkey, concat_ws(' ', c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END) AS identite, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS contact FROM customer""")
def c19(spark, sf):
    c = V.table(spark, sf, "customer")
    other = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("  ")
    rows = c.select("c_custkey", "c_name", other.alias("autre"), other.alias("contact_01"), F.col("c_name").alias("contact_1"))
    out = C.merge_columns(rows, {"identite": ["c_name", "autre"]})
    return C.merge_columns(out, None, "first_non_null", threshold=0.9).withColumnRenamed("contact_01", "contact")


@register("C20_transfer", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'deja' WHEN c_mktsegment IN ('HOUSEHOLD','MACHINERY') THEN c_name END AS cible,
  CASE WHEN NOT (c_custkey % 2 = 0 AND c_custkey % 3 <> 0) AND c_mktsegment IN ('HOUSEHOLD','MACHINERY') THEN NULL ELSE c_name END AS source FROM customer""")
def c20(spark, sf):
    key = F.col("c_custkey")
    rows = V.table(spark, sf, "customer").select(
        "c_custkey", "c_mktsegment", F.col("c_name").alias("source"),
        F.when((key % 2 == 0) & (key % 3 != 0), "deja").when(key % 2 == 0, " ").alias("cible"))
    moved = C.transfer_values(rows, {"source": "cible"}, filter_column="c_mktsegment",
                              filter_values=["household", "Machinery"], normalize_filter=True, move=True)
    return moved.select("c_custkey", X.none_if_blank(F.col("cible")).alias("cible"), "source")


@register("C21_harmonised_schema", """
SELECT c_name AS nom, c_mktsegment AS categorie, '?' AS ville, c_custkey FROM customer""")
def c21(spark, sf):
    even = F.col("c_custkey") % 2 == 0
    rows = V.table(spark, sf, "customer").select(
        "c_custkey", F.when(even, F.col("c_name")).alias("nom"), F.when(~even, F.col("c_name")).alias("Nom_complet"),
        F.col("c_mktsegment").alias("Catégorie"))
    return C.harmonize(rows, ["nom", "categorie", "ville"], {"Nom complet": "nom", "Catégorie": "categorie"}, default="?")


@register("C22_first_text", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE '' END AS texte FROM customer""")
def c22(spark, sf):
    key = F.col("c_custkey")
    return V.table(spark, sf, "customer").select("c_custkey", X.first_non_empty(
        F.when(key % 3 == 0, F.concat(F.lit(" "), "c_name")), F.when(key % 3 == 1, F.col("c_mktsegment")).otherwise("  ")).alias("texte"))


@register("C29_user_columns", """
SELECT c_custkey AS id_client, c_name AS nom_client, c_mktsegment AS nom_client_c_mktsegment FROM customer""")
def c29(spark, sf):
    from comptoir.sources.contracts import with_user_columns
    c = V.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return with_user_columns(c, {"C_Custkey": "Id client", "c_name": "Nom Client", "c_mktsegment": "nom_client"})


@register("C31_cleaning_pipeline", f"""
SELECT doc_id, md5(upper(CASE lang WHEN 'en' THEN 'anglais' ELSE lang END)) AS lang,
  md5(upper(replace(strip_accents({squeeze('text')}), 'ß', 'SS'))) AS text FROM documents""")
def c31(spark, sf):
    d = docs(spark, sf).select("doc_id", "lang", "text")
    rules = d.select(F.col("lang").alias("original"), F.when(F.col("lang") == "en", "anglais").alias("renamed")).where("renamed IS NOT NULL").distinct()
    cleaned = C.replace_exact(d, rules, "lang")
    out = C.clean_with_rules(cleaned, case="upper", remove_accents=True)
    return out.withColumns({"lang": F.md5("lang"), "text": F.md5("text")})


# --- filters --------------------------------------------------------------------------------------------------

@register("F1_value_and_date_filter", """
SELECT dossier_id, statut_dossier, date_demande FROM v_dossiers WHERE statut_dossier IN ('Décaissé','En analyse') AND type_produit IN ('1-URGENT','2-HIGH')
  AND date_demande >= TIMESTAMP '1997-01-01' AND date_demande < TIMESTAMP '1999-07-01'""", ("v_dossiers",))
def f1(spark, sf):
    out = FL.filter_rows(V.dossiers(spark, sf), {"statut_dossier": ["Décaissé", "En analyse"], "type_produit": ["1-URGENT", "2-HIGH"], "agence": []},
                         dt.date(1997, 1, 1), dt.date(1999, 6, 30))
    return out.select("dossier_id", "statut_dossier", "date_demande")


@register("F2_condition_and_columns", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0")
def f2(spark, sf):
    return FL.filter_select(V.table(spark, sf, "customer"), "c_acctbal < 0", ["c_custkey", "c_name", "absent"])


FIRST_SQL = "CAST(coalesce(CASE WHEN l_returnflag = 'A' THEN l_shipdate END, CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL 10 DAY END) AS DATE)"


def first_dates(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", F.when(F.col("l_returnflag") == "A", F.col("l_shipdate")).alias("d1"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate") + F.expr("INTERVAL 10 DAYS")).alias("d2"))


@register("F3_first_date_calendar", f"""
SELECT l_orderkey, l_partkey, {FIRST_SQL} AS date_reference FROM lineitem WHERE year({FIRST_SQL}) = 1998 AND {FIRST_SQL} <= DATE '1998-11-30'""")
def f3(spark, sf):
    out = FL.filter_first_date(first_dates(spark, sf), ["d1", "absent", "d2"], 1998, "date_reference", max_date=dt.date(1998, 11, 30))
    return out.select("l_orderkey", "l_partkey", "date_reference")


@register("F3_first_date_iso", f"""
SELECT l_orderkey, l_partkey, {FIRST_SQL} AS date_reference FROM lineitem WHERE isoyear({FIRST_SQL}) = 1998""")
def f3b(spark, sf):
    out = FL.filter_first_date(first_dates(spark, sf), ["d1", "d2"], 1998, "date_reference", "iso")
    return out.select("l_orderkey", "l_partkey", "date_reference")


def weeks(spark, sf):
    d = F.col("o_orderdate")
    return V.table(spark, sf, "orders").select(
        "o_orderkey", F.weekofyear(d).alias("Num_semaine_epid"), F.extract(F.lit("YEAROFWEEK"), d).cast("int").alias("Annee_epid"))


WEEKS_SQL = 'SELECT o_orderkey, CAST(week(o_orderdate) AS INT) AS "Num_semaine_epid", CAST(isoyear(o_orderdate) AS INT) AS "Annee_epid" FROM orders'


@register("F4_week_filter", f"""SELECT * FROM ({WEEKS_SQL}) WHERE "Num_semaine_epid" >= 50 OR "Num_semaine_epid" IN (3, 7) OR "Num_semaine_epid" = 12""")
def f4(spark, sf):
    w = weeks(spark, sf)
    parts = [FL.filter_weeks(w, "Num_semaine_epid", k, sort=["Annee_epid", "Num_semaine_epid"]) for k in ((50, None), [3, 7], 12)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("F5_null_filter", """
SELECT client_id, 'isnull' AS mode FROM v_clients WHERE telephone IS NULL OR sexe IS NULL
UNION ALL SELECT client_id, 'notnull' FROM v_clients WHERE telephone IS NOT NULL AND sexe IS NOT NULL""", ("v_clients",))
def f5(spark, sf):
    c = V.clients(spark, sf)
    parts = [FL.filter_nulls(c, ["telephone", "sexe"], m).select("client_id", F.lit(m).alias("mode")) for m in ("isnull", "notnull")]
    return parts[0].unionByName(parts[1])


@register("F6_iso_window", f"""SELECT * FROM ({WEEKS_SQL}) WHERE "Annee_epid" = 1998 AND "Num_semaine_epid" BETWEEN 10 AND 20""")
def f6(spark, sf):
    return FL.filter_iso_window(weeks(spark, sf), 10, 20, 1998)


@register("F7_iso_window_across_years", f"""SELECT * FROM ({WEEKS_SQL}) WHERE ("Annee_epid" = 1998 AND "Num_semaine_epid" >= 48) OR ("Annee_epid" = 1999 AND "Num_semaine_epid" <= 4)""")
def f7(spark, sf):
    return FL.filter_iso_window_across_years(weeks(spark, sf), 1998, 48, 1999, 4)


@register("F8_completion_window", """
SELECT receipt_no, completion_time FROM v_receipts WHERE completion_time >= TIMESTAMP '2024-01-05 08:00:00' AND completion_time < TIMESTAMP '2024-01-21'""", ("v_receipts",))
def f8(spark, sf):
    out = FL.filter_completion(V.receipts(spark, sf), dt.datetime(2024, 1, 5, 8), dt.date(2024, 1, 20))
    return out.select("receipt_no", "completion_time")


@register("F9_direction_filter", """
SELECT 'Sortie' AS choix, sens_flux, count(*) AS n FROM v_receipts WHERE sens_flux = 'Sortie' GROUP BY 2
UNION ALL SELECT 'tous', sens_flux, count(*) FROM v_receipts GROUP BY 2""", ("v_receipts",))
def f9(spark, sf):
    r = V.receipts(spark, sf)
    parts = [FL.filter_direction(r, d).groupBy("sens_flux").agg(F.count("*").alias("n")).withColumn("choix", F.lit(name))
             for name, d in (("Sortie", ["Sortie"]), ("tous", []))]
    return parts[0].unionByName(parts[1])


@register("F10_as_of", """
SELECT loan_id FROM v_loans WHERE coalesce(due_date, created_at) IS NULL OR coalesce(CAST(due_date AS TIMESTAMP), created_at) < TIMESTAMP '2001-07-02'""", ("v_loans",))
def f10(spark, sf):
    return FL.as_of(V.loans(spark, sf), dt.date(2001, 7, 1), ["due_date", "created_at"]).select("loan_id")


@register("F11_year_scope", """
SELECT 'flux' AS nature, loan_id FROM v_loans WHERE created_at >= TIMESTAMP '1999-01-01' AND created_at < TIMESTAMP '2001-01-01'
UNION ALL SELECT 'stock', loan_id FROM v_loans WHERE due_date IS NULL OR due_date < DATE '2001-06-01' AND due_date < DATE '2001-01-01' OR created_at IS NULL""", ("v_loans",))
def f11(spark, sf):
    loans = V.loans(spark, sf)
    flow = FL.scope_years(loans, 1999, 2000, ["created_at"], stock=False).select(F.lit("flux").alias("nature"), "loan_id")
    return flow.unionByName(FL.scope_years(loans, 1999, 2000, ["due_date"], stock=True).select(F.lit("stock").alias("nature"), "loan_id"))


@register("F12_compliance_subset", """
SELECT ligne_id FROM v_conformite WHERE starts_with("analyse", '150') AND lower(type_element) = 'alerte'
UNION ALL SELECT ligne_id FROM v_conformite WHERE starts_with("analyse", '039')""", ("v_conformite",))
def f12(spark, sf):
    c = V.compliance(spark, sf)
    return FL.compliance_subset(c, "150_", "ALERTE").select("ligne_id").unionByName(FL.compliance_subset(c, "039_").select("ligne_id"))


@register("F13_filter_options", """
SELECT DISTINCT trim(agent_credit) AS valeur FROM v_clients WHERE trim(coalesce(agent_credit, '')) <> ''
UNION ALL SELECT unnest(['telephone', 'categorie', 'agence', 'zone_geographique', 'devise'])""", ("v_clients",))
def f13(spark, sf):
    c = V.clients(spark, sf)
    chosen = FL.pick_filter_columns(c, ["telephone"], max_columns=5, max_unique=80)
    names = FL.filter_options(c, "agent_credit").select("valeur")
    return names.unionByName(spark.createDataFrame([(n,) for n in chosen], "valeur string"))


@register("F14_text_filter", "SELECT client_id FROM v_clients WHERE trim(agence) IN ('NATION_1', 'NATION_2') AND devise = 'CDF'", ("v_clients",))
def f14(spark, sf):
    return FL.filter_texts(V.clients(spark, sf), {"agence": [" NATION_1", "NATION_2"], "devise": ["CDF"], "sexe": []}).select("client_id")


@register("F15_latest_complete_day", """
SELECT CAST(CASE WHEN hour(m) < 18 THEN CAST(m AS DATE) - 1 ELSE CAST(m AS DATE) END AS DATE) AS jour FROM (SELECT max(ts) AS m FROM events)""")
def f15(spark, sf):
    return FL.latest_complete_day((V.journal(spark, sf), ["created_at"]), (V.loans(spark, sf), ["due_date", "created_at"]))
