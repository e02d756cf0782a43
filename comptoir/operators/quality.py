"""Data quality: missing values, checks, column profiles, completeness, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.functions import text as X
from comptoir.functions.money import count_if, ratio
from comptoir.operators.common import has, is_text
from comptoir.plans.ordered import accumulate, match_null_safe


def unfold(wide: DataFrame, lines: Sequence[Sequence[tuple[str, Column]]]) -> DataFrame:
    """Turn the single row of a wide aggregate into several rows of the same columns."""
    names = [name for name, _ in lines[0]]
    structs = F.array(*[F.struct(*[c.alias(n) for n, c in line]) for line in lines])
    return wide.select(F.explode(structs).alias("l")).select(*[f"l.{n}" for n in names])


def missing_profile(df: DataFrame) -> DataFrame:
    """Null count and rate per column, from one pass over the table."""
    columns = df.columns
    wide = df.agg(F.count("*").alias("n"), *[count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(columns)])
    lines = [[("colonne", F.lit(c)), ("valeurs_manquantes", F.col(f"m{i}")),
              ("taux_manquant", ratio(F.col(f"m{i}"), F.col("n")))] for i, c in enumerate(columns)]
    return unfold(wide.where(F.col("n") > 0), lines).orderBy(F.desc("valeurs_manquantes"), "colonne")


def missing_decision(percent: Column, absent: bool, acceptable: float, watch: float) -> Column:
    if absent:
        return F.lit("Colonne absente")
    return (F.when(percent == 0, "OK").when(percent <= acceptable, "Acceptable")
            .when(percent <= watch, "A surveiller").otherwise("Prioritaire"))


def missing_analysis(df: DataFrame, columns: Sequence[str] | None = None, na_like: bool = True, acceptable: float = 5.0,
                     watch: float = 20.0, observations: Mapping[str, str] | None = None, digits: int = 2) -> DataFrame:
    """Filled and missing cells per followed column with a decision; absent columns are reported as such."""
    if acceptable > watch or acceptable < 0:
        raise ValueError("thresholds must be positive and in order")
    wanted = list(dict.fromkeys(columns if columns is not None else df.columns))
    present = [c for c in wanted if c in df.columns]

    def missing(c: str) -> Column:
        return X.is_na_like(F.col(c)) if na_like and is_text(df, c) else F.col(c).isNull()

    wide = df.agg(F.count("*").alias("n"), *[count_if(missing(c)).alias(f"m{i}") for i, c in enumerate(present)])
    notes = observations or {}
    lines = []
    for c in wanted:
        absent = c not in present
        gone = F.col("n") if absent else F.col(f"m{present.index(c)}")
        percent = F.coalesce(F.round(ratio(gone, F.col("n")) * 100, digits), F.lit(0.0))
        note = F.lit(notes[c]) if c in notes else missing_decision(percent, absent, acceptable, watch)
        lines.append([
            ("variable", F.lit(c)), ("presence", F.lit("Absente" if absent else "Présente")), ("total_lignes", F.col("n")),
            ("renseignees", F.col("n") - gone), ("manquantes", gone), ("pct_manquant", percent), ("decision", note)])
    return unfold(wide, lines)


def missing_by_specification(df: DataFrame, specification: DataFrame, variable: str = "variable", **options) -> DataFrame:
    """The same analysis joined to a specification (block, priority, type of each followed column).

    The specification has one row per followed column; its names are needed to build the plan.
    """
    rows = specification.select(X.strip(F.col(variable)).alias("v")).where("v IS NOT NULL").distinct().collect()
    followed = sorted(r["v"] for r in rows)
    if not followed:
        raise ValueError("the specification names no column")
    analysis = missing_analysis(df, followed, **options)
    spec = specification.withColumn(variable, X.strip(F.col(variable)))
    if variable != "variable":
        analysis = analysis.withColumnRenamed("variable", variable)
    return spec.join(analysis, variable, "left")


def completeness(expected: DataFrame, expected_column: str, observed: DataFrame, observed_column: str,
                 minimum: float = 0) -> DataFrame:
    """Expected against observed values after normalisation: counts, rate, and whether the minimum is met."""
    both = match_values(expected, expected_column, observed, observed_column)
    counts = both.agg(count_if(F.col("attendu")).alias("nb_attendus"),
                      count_if(F.col("attendu") & F.col("observe")).alias("nb_recus"))
    percent = F.coalesce(F.round(ratio(F.col("nb_recus"), F.col("nb_attendus")) * 100, 2), F.lit(0.0))
    return counts.select("*", percent.alias("completude_pct"), (percent >= minimum).alias("respecte_seuil"))


def match_values(expected: DataFrame, expected_column: str, observed: DataFrame, observed_column: str) -> DataFrame:
    """One row per normalised value, with its presence on each side (missing, extra or matched)."""
    def side(df: DataFrame, column: str, flag: str) -> DataFrame:
        text = X.none_if_blank(F.replace(F.col(column).cast("string"), F.lit(" "), F.lit(" ")))
        value = F.when(F.lower(text) != "nan", X.normalize_case(text, "title", True))
        return df.select(value.alias("valeur")).where("valeur IS NOT NULL").distinct().withColumn(flag, F.lit(True))

    joined = side(expected, expected_column, "attendu").join(side(observed, observed_column, "observe"), "valeur", "full_outer")
    return joined.select("valeur", F.coalesce("attendu", F.lit(False)).alias("attendu"),
                         F.coalesce("observe", F.lit(False)).alias("observe"))


def quality_checks(df: DataFrame) -> DataFrame:
    """Checks on a loan file table with counts and rates, in one pass plus one count of repeated files."""
    checks: list[tuple[str, Column]] = []
    if has(df, "client_id"):
        checks.append(("Clients sans identifiant", X.blank(F.col("client_id"))))
    if has(df, "dossier_id"):
        checks.append(("Dossiers dupliqués", None))
        checks.append(("Dossiers sans identifiant", X.blank(F.col("dossier_id"))))
    if has(df, "statut_dossier"):
        checks.append(("Dossiers sans statut", X.blank(F.col("statut_dossier"))))
    if has(df, "montant_demande"):
        checks.append(("Montants demandés négatifs", F.col("montant_demande") < 0))
    if has(df, "montant_accorde"):
        checks.append(("Montants accordés négatifs", F.col("montant_accorde") < 0))
    if has(df, "montant_demande", "montant_accorde"):
        checks.append(("Montants accordés supérieurs au demandé", F.col("montant_accorde") > F.col("montant_demande")))
    if has(df, "revenu_mensuel", "charge_mensuelle"):
        checks.append(("Données financières manquantes", F.col("revenu_mensuel").isNull() | F.col("charge_mensuelle").isNull()))
    if has(df, "retard_jours"):
        checks.append(("Retards négatifs", F.col("retard_jours") < 0))
    if has(df, "capacite_remboursement"):
        checks.append(("Capacité de remboursement négative", F.col("capacite_remboursement") < 0))

    wide = df.agg(F.count("*").alias("n"), *[count_if(c).alias(f"c{i}") for i, (_, c) in enumerate(checks) if c is not None])
    for i, (_, condition) in enumerate(checks):
        if condition is None:
            repeated = (df.where(F.col("dossier_id").isNotNull()).groupBy("dossier_id").agg(F.count("*").alias("k"))
                        .where("k > 1").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k")).scalar())
            wide = wide.withColumn(f"c{i}", repeated)
    return unfold(wide, [[("controle", F.lit(label)), ("nombre_lignes", F.col(f"c{i}")),
                          ("taux_lignes", F.coalesce(ratio(F.col(f"c{i}"), F.col("n")), F.lit(0.0)))]
                         for i, (label, _) in enumerate(checks)])


# --- column profiles ------------------------------------------------------------------------------------------

def token(df: DataFrame, column: str) -> Column:
    """Comparable text of a cell: spaces squeezed and case folded; null when empty."""
    text = F.col(column).cast("string")
    return F.nullif(X.squeeze(F.lower(text)), F.lit("")) if is_text(df, column) else text


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per column (and segment): empties, distinct values, unique rate, dominant value and its share.

    The cells are unfolded to (column, value) and counted, so every column is profiled in the same two
    shuffles; equal cells meet already on the map side.
    """
    names = [c for c in (columns or df.columns) if c not in by]
    cells = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("colonne"), token(df, c).alias("valeur"))
                      for i, c in enumerate(names)])
    long = df.select(*by, F.explode(cells).alias("cell")).select(*by, "cell.*")
    counted = long.groupBy(*by, "position", "colonne", "valeur").agg(F.count("*").alias("n"))
    filled = F.col("valeur").isNotNull()
    # The largest count wins, the smallest text breaks a tie.
    best = F.max(F.when(filled, F.col("n")))
    grouped = counted.groupBy(*by, "position", "colonne").agg(
        F.sum("n").alias("lignes"),
        F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("vides"),
        count_if(filled).alias("valeurs_distinctes"),
        best.alias("n_dominant"),
        F.min_by("valeur", F.when(filled, F.struct((-F.col("n")).alias("a"), F.col("valeur").alias("b"))))
        .alias("valeur_dominante"),
    )
    present = F.col("lignes") - F.col("vides")
    return grouped.select(
        *by, "position", "colonne", "lignes", "vides", ratio(F.col("vides"), F.col("lignes")).alias("taux_vides"),
        "valeurs_distinctes", F.coalesce(ratio(F.col("valeurs_distinctes"), present), F.lit(0.0)).alias("taux_unicite"),
        "valeur_dominante", F.coalesce(ratio(F.col("n_dominant"), present), F.lit(0.0)).alias("taux_dominant"),
    )


def column_fingerprints(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(segment, position, remplies, empreinte): columns whose comparable texts are equal on every row of a segment share a fingerprint.

    It adds up hashes of (row, text), so it depends on no order; a row is known by a hash of all its columns.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    hashes = {f"__h{i}": F.xxhash64(F.col("__row"), F.coalesce(token(df, c), F.lit("\u0000"))) for i, c in enumerate(columns)}
    filled = {f"__f{i}": token(df, c).isNotNull() for i, c in enumerate(columns)}
    keyed = df.withColumn("__row", row).select(*by, *[h.alias(n) for n, h in hashes.items()], *[f.alias(n) for n, f in filled.items()])
    measures = []
    for i in range(len(columns)):
        h = F.col(f"__h{i}")
        measures += [count_if(F.col(f"__f{i}")).alias(f"n{i}"), *[F.sum(F.shiftrightunsigned(h, at).bitwiseAND(0xFFFFFF)).alias(f"s{i}_{at}") for at in (0, 24)]]
    wide = keyed.groupBy(*by).agg(*measures)
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.col(f"n{i}").alias("remplies"), F.struct(F.col(f"s{i}_0").alias("a"), F.col(f"s{i}_24").alias("b")).alias("empreinte"))
                      for i in range(len(columns))])
    return wide.select(*by, F.inline(cells))


def redundant_pairs(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of columns equal on every row, exactly or after normalisation.

    Only pairs that share a fingerprint in some segment are compared cell by cell, so expressions grow with the columns and not
    with their square; the pairs collected are at most those of the columns.
    """
    names = [c for c in (columns or df.columns) if c not in by]
    marks = column_fingerprints(df, names, by).where("remplies > 0")
    alike = marks.groupBy(*by, "empreinte").agg(F.array_sort(F.collect_set("position")).alias("p")).where(F.size("p") > 1)
    met = alike.select("p").distinct().collect()
    pairs = sorted({(x, y) for r in met for i, x in enumerate(r["p"]) for y in r["p"][i + 1:] if names[x] != names[y]})

    def exact(c: str) -> tuple[Column, Column]:
        return X.none_if_blank(F.col(c)).isNull(), F.col(c).cast("string")

    measures, kinds = [], []
    for i, (x, y) in enumerate(pairs):
        a, b = names[x], names[y]
        (ea, va), (eb, vb) = exact(a), exact(b)
        equal = ((ea & eb) | (~ea & ~eb & (va == vb))) if df.schema[a].dataType == df.schema[b].dataType else (ea & eb)
        measures += [count_if(~F.coalesce(equal, F.lit(False))).alias(f"x{i}"), count_if(~token(df, a).eqNullSafe(token(df, b))).alias(f"y{i}"),
                     count_if(token(df, a).isNotNull() | token(df, b).isNotNull()).alias(f"z{i}")]
        relation = F.when(F.col(f"z{i}") == 0, None).when(F.col(f"x{i}") == 0, "identiques").when(F.col(f"y{i}") == 0, "identiques_apres_normalisation")
        kinds.append(F.struct(F.lit(a).alias("colonne_a"), F.lit(b).alias("colonne_b"), relation.alias("relation")))
    wide = df.groupBy(*by).agg(F.count("*").alias("lignes"), *measures)
    listed = F.array(*kinds) if kinds else F.array().cast("array<struct<colonne_a:string,colonne_b:string,relation:string>>")
    return (wide.select(*by, "lignes", F.explode(listed).alias("p")).select(*by, "p.*", "lignes")
            .where(F.col("relation").isNotNull()))


# --- duplicates -----------------------------------------------------------------------------------------------

def comparison_keys(df: DataFrame, columns: Sequence[str], case: str | None = "capitalize") -> dict[str, Column]:
    """Key columns used only to compare: texts stripped and put in one case, values themselves untouched."""
    keys = {}
    for i, c in enumerate(columns):
        text = X.strip(F.col(c)) if is_text(df, c) else F.col(c)
        keys[f"__k{i}"] = X.CASES[case](text) if case and is_text(df, c) else text
    return keys


def missing_cells(df: DataFrame, columns: Sequence[str]) -> Column:
    return sum((X.blank(F.col(c)).cast("int") if is_text(df, c) else F.col(c).isNull().cast("int") for c in columns), F.lit(0))


def mark_duplicates(df: DataFrame, row_key: str, columns: Sequence[str] | None = None, excluded: Sequence[str] = (),
                    normalize: bool = True, case: str | None = "capitalize", keep: str | None = "first",
                    missing_columns: Sequence[str] | None = None) -> DataFrame:
    """Every row with its group size and whether it is a duplicate of the kept row.

    ``row_key`` gives the order of the rows. The kept row of a group is the smallest (or largest) key, found by
    an aggregation, so a group of any size is never gathered in one task.
    """
    names = list(columns) if columns else [c for c in df.columns if c not in (*excluded, row_key)]
    keys = comparison_keys(df, names, case) if normalize else {f"__k{i}": F.col(c) for i, c in enumerate(names)}
    keyed = df.withColumns(keys)
    pick = F.min(row_key) if keep == "first" else F.max(row_key)
    groups = keyed.groupBy(*keys).agg(F.count("*").alias("nombre_occurrences"), pick.alias("__kept"))
    joined = match_null_safe(keyed, groups, list(keys), "inner")
    several = F.col("nombre_occurrences") > 1
    repeated = several if keep is None else several & (F.col(row_key) != F.col("__kept"))
    size = F.col("nombre_occurrences")
    return joined.select(
        *df.columns, size, (size if keep is None else size - 1).alias("lignes_dupliquees"),
        missing_cells(df, missing_columns or df.columns).cast("bigint").alias("nb_missing"),
        repeated.alias("est_doublon"), several.alias("est_dans_groupe_doublon"),
    )


def handle_duplicates(df: DataFrame, row_key: str, mode: str = "afficher", **options) -> DataFrame:
    """``afficher``, ``afficher_tous``, ``compter``, ``detail_complet`` or ``nettoyer`` on the marked rows."""
    marked = mark_duplicates(df, row_key, **options)
    flags = ("est_doublon", "est_dans_groupe_doublon")
    if mode == "afficher":
        return marked.where("est_doublon").drop(*flags)
    if mode == "afficher_tous":
        return marked.where("est_dans_groupe_doublon").drop(*flags)
    if mode == "nettoyer":
        kept = ~F.col("est_doublon")
        return marked.where(kept).drop(*flags)
    names = list(options.get("columns") or [c for c in df.columns if c not in (*options.get("excluded", ()), row_key)])
    keys = comparison_keys(df, names, options.get("case", "capitalize")) if options.get("normalize", True) \
        else {f"__k{i}": F.col(c) for i, c in enumerate(names)}
    if mode == "compter":
        groups = df.withColumns(keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        lines = F.sum("n") if options.get("keep", "first") is None else F.sum(F.col("n") - 1)
        return groups.agg(F.count("*").alias("groupes"), F.coalesce(lines, F.lit(0)).alias("lignes_dupliquees"))
    if mode == "detail_complet":
        firsts = df.withColumns(keys).groupBy(*keys).agg(F.min(row_key).alias(row_key)).select(row_key)
        rows = marked.where("est_dans_groupe_doublon").join(firsts, row_key, "left_semi")
        return rows.select(*names, "nombre_occurrences", "lignes_dupliquees", "nb_missing")
    raise ValueError(f"unknown mode: {mode}")


def suggest_deletions(df: DataFrame, row_key: str, columns: Sequence[str], priority_column: str | None = None,
                      priority_values: Sequence[str] = ("positif",), missing_columns: Sequence[str] | None = None,
                      case: str | None = "capitalize") -> DataFrame:
    """Rank the rows of each duplicate group: priority result first, then fewest missing cells, then first row."""
    keys = comparison_keys(df, columns, case)
    keyed = df.withColumns(keys)
    groups = keyed.groupBy(*keys).agg(F.count("*").alias("nombre_occurrences"), F.min(row_key).alias("__first"))
    inside = match_null_safe(keyed, groups.where("nombre_occurrences > 1"), list(keys), "inner")
    wanted = [str(v).strip().lower() for v in priority_values if str(v).strip()]
    priority = F.coalesce(F.lower(X.strip(F.col(priority_column).cast("string"))).isin(*wanted), F.lit(False)) \
        if priority_column else F.lit(False)
    scored = inside.withColumns({
        "nb_missing": missing_cells(df, missing_columns or df.columns).cast("bigint"), "resultat_prioritaire": priority})
    order = [F.col("resultat_prioritaire").desc(), F.col("nb_missing").asc(), F.col(row_key).asc()]
    ranked = accumulate(scored, list(keys), order, row_number="rang_conservation", ordered_by=["resultat_prioritaire", "nb_missing", row_key])
    first = F.col("rang_conservation") == 1
    return ranked.select(
        *df.columns, "nombre_occurrences", (F.col("nombre_occurrences") - 1).alias("lignes_dupliquees"), "nb_missing",
        "resultat_prioritaire", "rang_conservation", F.when(first, "Garder").otherwise("Supprimer").alias("suggestion"),
        first.alias("est_a_garder_suggere"), (~first).alias("est_a_supprimer_suggere"),
        (F.col(row_key) != F.col("__first")).alias("est_doublon"))


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and rows in excess."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return groups.agg(F.sum("__n").alias("lignes"), F.count("*").alias("lignes_distinctes"),
                      F.sum(F.col("__n") - 1).alias("doublons_exacts"))


def latest_versions(df: DataFrame, key: Column, newest: Sequence[Column], source_column: str | None = None,
                    sources_name: str = "fichiers_sources") -> DataFrame:
    """One row per key, the newest by the given columns, with the list of files that held the key.

    The newest row is an aggregate (``max_by`` of the whole row), with combining before the shuffle.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    best = F.max_by(row, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(newest)]))
    measures = [best.alias("r")]
    if source_column:
        measures.append(F.array_join(F.array_sort(F.collect_set(source_column)), " | ").alias(sources_name))
    grouped = df.groupBy(key.alias("__key")).agg(*measures)
    return grouped.select("r.*", *([sources_name] if source_column else []))


def count_over(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Attach the size of each row's group; rows with a null key get none."""
    counts = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias(name))
    return df.join(counts, list(keys), "left")


def distinct_over(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Attach the number of distinct non-null values found with each row's key (0 without a key)."""
    counts = df.dropna(subset=[key, value]).groupBy(key).agg(F.count_distinct(value).alias(name))
    return df.join(counts, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
