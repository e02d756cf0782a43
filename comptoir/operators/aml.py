"""Deposits and withdrawals: ledger summary, control flags and anti-money-laundering tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.functions import labels as L
from comptoir.functions.money import MONEY, count_if, exact_sum, ratio, total
from comptoir.functions.text import blank, strip
from comptoir.functions.values import to_flag
from comptoir.operators.common import has, month_text, number, stamp
from comptoir.plans.ordered import match_null_safe

DEFAULT_RATE = 2800.0  # CDF for one USD

# Source headers of the back-office tables.
LEDGER_HEADERS = {
    "ID_OPERATION": "operation_id", "ID_COMPTE": "compte_id", "MONTANT_OPERATION": "montant",
    "DATE_OPERATION": "date_operation", "DATE_VALEUR": "date_valeur", "SENS": "sens", "ID_DEVISE": "id_devise",
    "ID_POINT_SERVICE": "agence_comptable", "ID_TYPE_OPERATION": "type_operation_comptable",
}
MEMBER_HEADERS = {
    "CODE": "client_id", "NOM_ADHERENT": "nom_client", "ID_COMPTE_ADHERENT": "compte_adherent",
    "ID_TYPE_ADHERENT": "type_client", "ID_GESTIONNAIRE": "agent_credit", "ID_POINT_SERVICE": "agence_client",
    "DROIT_PAYE": "droit_paye", "EST_VALIDE": "est_valide", "ID_CATEGORIE_ADHERENT": "categorie_adherent",
}
OPERATION_HEADERS = {
    "ID": "operation_id", "CODE": "operation_id", "ID_TYPE_OPERATION": "type_operation",
    "DATE_OPERATION": "date_operation", "DATE_SAISIE": "date_saisie", "DATE_VALIDATION": "date_validation",
    "DATE_VALIDE": "date_valide", "ANNULE": "annule", "NUM_TRANSACTION": "numero_reference",
    "NUMERO_RECU": "numero_recu", "ID_UTILISATEUR": "operateur", "ID_UTILISATEUR_VALIDE": "validateur",
    "ID_POINT_SERVICE": "agence", "DESCRIPTION": "commentaire", "MODE_PAIEMENT": "mode_paiement",
    "ID_OPERATION_ANNULE": "id_operation_annulee", "ID_OPERATION_MERE": "id_operation_mere",
}
OPERATION_TYPES = {"BACK_OFFICE": ("DEPO", "RETR"), "API_MOBILE": ("MOB_DEPO", "MOB_RETR")}


def renamed(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    return df.toDF(*[headers.get(c, c) for c in df.columns])


# --- ledger and members ---------------------------------------------------------------------------------------

def ledger_summary(lines: DataFrame, members: DataFrame | None = None, tolerance: float = 0.01) -> DataFrame:
    """One row per operation: counts, amounts by side, anomalies, and whether debit equals credit.

    The account is that of a known member where a line has one, else any account of the operation; the smallest
    key is taken, so the choice does not depend on the order of the rows.
    """
    value = number(lines, "montant")
    side = F.upper(strip(F.col("sens").cast("string")))
    size = F.abs(value)
    work, account = lines, F.min("compte_id")
    if members is not None:
        known = members.where(F.col("compte_adherent").isNotNull()).select(
            F.col("compte_adherent").cast(lines.schema["compte_id"].dataType).alias("__known")).distinct()
        work = lines.join(known, lines["compte_id"] == known["__known"], "left")
        account = F.coalesce(F.min("__known"), F.min("compte_id"))
    extra = [F.min(c).alias(c) for c in ("agence_comptable", "type_operation_comptable") if has(lines, c)]
    value_date, operation_date = stamp(lines, "date_valeur"), stamp(lines, "date_operation")
    grouped = work.groupBy("operation_id").agg(
        F.count("*").alias("nb_ecritures"), F.max(size).alias("montant_operation"),
        exact_sum(size, side == "D").alias("d"), exact_sum(size, side == "C").alias("c"),
        account.alias("compte_id"), F.min("id_devise").alias("id_devise"),
        count_if(F.to_date(value_date) != F.to_date(operation_date)).alias("ecarts_date_valeur"),
        count_if(F.coalesce(side, F.lit("")) == "").alias("lignes_sens_absent"),
        count_if(F.coalesce(value, F.lit(0.0)) <= 0).alias("lignes_montant_non_positif"),
        *extra,
    )
    gap = F.abs(F.col("d") - F.col("c"))
    return grouped.withColumns({
        "total_debit": F.col("d").cast("double"), "total_credit": F.col("c").cast("double"),
        "ecart_debit_credit": gap.cast("double"), "equilibre_comptable_ok": gap <= F.lit(tolerance).cast(MONEY),
        "code_devise": L.currency_code(F.col("id_devise")),
    }).drop("d", "c")


KYC_FIELDS = ("client_id", "nom_client", "type_client", "agence_client", "agent_credit")


def prepare_members(members: DataFrame) -> DataFrame:
    """One row per account with the number of missing identity fields; an invalid or unpaid member adds one each."""
    out = members
    flags = {c: to_flag(F.col(c)) for c in ("droit_paye", "est_valide") if has(out, c)}
    out = out.withColumns(flags) if flags else out
    missing = F.lit(0)
    for c in KYC_FIELDS:
        if has(out, c):
            missing = missing + blank(F.col(c)).cast("int")
    for c in ("est_valide", "droit_paye"):
        if has(out, c):
            missing = missing + (~F.coalesce(F.col(c), F.lit(False))).cast("int")
    out = out.withColumn("kyc_missing_count", missing)
    row = F.struct(*[F.col(c) for c in out.columns])
    best = out.groupBy(F.col("compte_adherent").alias("__a")).agg(F.min_by(row, F.col("client_id")).alias("r"))
    return best.select("r.*")


def prepare_operations(operations: DataFrame, ledger: DataFrame, members: DataFrame | None,
                       source: str) -> DataFrame:
    """Operations of one channel with their ledger summary, their member and the control flags."""
    ops = operations
    if has(ops, "type_operation"):
        ops = ops.where(F.col("type_operation").isin(*OPERATION_TYPES[source]))
    ops = ops.withColumn("operation_id", F.col("operation_id").cast("string"))
    summary = ledger.withColumn("operation_id", F.col("operation_id").cast("string"))
    merged = ops.join(summary, "operation_id", "left")
    if members is not None:
        own = members.withColumn("__a", F.col("compte_adherent").cast("string")).drop("compte_adherent")
        merged = merged.join(own, F.col("compte_id").cast("string") == F.col("__a"), "left").drop("__a")

    def date(c: str) -> Column:
        return stamp(merged, c) if has(merged, c) else F.lit(None).cast("timestamp_ntz")

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if has(merged, c) else F.lit("")

    day = {c: date(c) for c in ("date_operation", "date_saisie", "date_validation", "date_valide")}
    delay = F.datediff(F.to_date(day["date_saisie"]), F.to_date(day["date_operation"]))
    cancelled = to_flag(F.col("annule")) if has(merged, "annule") else F.lit(False)
    agence = F.coalesce(*[F.col(c).cast("string") for c in ("agence", "agence_comptable") if has(merged, c)])
    flags = {
        **{c: v for c, v in day.items()},
        "source_mouvement": F.lit(source),
        "type_mouvement": L.movement(F.col("type_operation")),
        "agence": agence,
        "delai_saisie_jours": delay,
        "saisie_tardive": F.coalesce(delay, F.lit(0)) > 0,
        "validation_incoherente": F.coalesce(day["date_valide"] < day["date_saisie"], F.lit(False))
        | F.coalesce(day["date_validation"] < day["date_operation"], F.lit(False)),
        "operation_non_validee": ~cancelled & (day["date_validation"].isNull() | day["date_valide"].isNull()),
        "auto_validation": (text("operateur") != "") & (text("operateur") == text("validateur")),
        "annule": cancelled,
    }
    return merged.withColumns(flags)


def operations_dataset(operations: DataFrame, ledger: DataFrame, members: DataFrame,
                       api_operations: DataFrame | None = None, api_ledger: DataFrame | None = None) -> DataFrame:
    """Both channels in one table; headers are the source's own, brought to common names here."""
    people = prepare_members(renamed(members, MEMBER_HEADERS))
    parts = [("BACK_OFFICE", operations, ledger)]
    if api_operations is not None and api_ledger is not None:
        parts.append(("API_MOBILE", api_operations, api_ledger))
    out = None
    for source, ops, lines in parts:
        summary = ledger_summary(renamed(lines, LEDGER_HEADERS), people)
        part = prepare_operations(renamed(ops, OPERATION_HEADERS), summary, people, source)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# --- anti-money-laundering tables -----------------------------------------------------------------------------

def to_reporting_currency(df: DataFrame, rate: float = DEFAULT_RATE) -> DataFrame:
    """Amounts in CDF at an explicit rate; anything not marked CDF, a missing currency included, is converted."""
    value = F.coalesce(number(df, "montant_operation"), F.lit(0.0))
    local = F.coalesce(F.upper(F.col("code_devise").cast("string")) == "CDF", F.lit(False))
    return df.withColumn("montant_reporting_cdf", F.when(local, value).otherwise(value * F.lit(float(rate))))


def with_movement(df: DataFrame) -> DataFrame:
    return df if has(df, "type_mouvement") else df.withColumn("type_mouvement", L.movement(F.col("type_operation")))


def live(df: DataFrame, rate: float) -> DataFrame:
    """Operations that were not cancelled, with their movement type and reporting amount."""
    kept = df.where(~F.coalesce(F.col("annule"), F.lit(False))) if has(df, "annule") else df
    return with_movement(to_reporting_currency(kept, rate))


def operation_count(column: str = "operation_id") -> Column:
    """Distinct identifiers, or the number of rows when no row has one."""
    return F.when(F.count(column) > 0, F.count_distinct(column)).otherwise(F.count("*"))


VALUE = "montant_reporting_cdf"


def regulatory_lines(df: DataFrame, rate: float = DEFAULT_RATE) -> DataFrame:
    """Counts and CDF volumes of the regulatory report lines, from one conditional aggregation."""
    deposit, withdrawal = F.col("type_mouvement").isin(*L.DEPOSITS), F.col("type_mouvement").isin(*L.WITHDRAWALS)
    size, mid, high = F.col(VALUE), F.lit(float(rate * 5000)), F.lit(float(rate * 10000))
    between = (size >= mid) & (size < high)
    product = "3. PRODUIT - SERVICE - OPERATIONS"
    channel = "4. CANAUX DE DISTRIBUTION"
    lines = (
        ("1. ACTIVITE", 25, "Total Depots", deposit),
        ("1. ACTIVITE", 26, "Total Retraits", withdrawal),
        (product, 53, "Depot >= 10k USD", deposit & (size >= high)),
        (product, 54, "Retrait >= 10k USD", withdrawal & (size >= high)),
        (product, 55, "Depot >= 5k USD et < 10k USD", deposit & between),
        (product, 56, "Retrait >= 5k USD et < 10k USD", withdrawal & between),
        (channel, 132, "Operations effectuees par Mobile Banking", F.col("source_mouvement") == "API_MOBILE"),
        (channel, 134, "Wallet to Bank", F.col("type_operation") == "MOB_DEPO"),
    )
    from comptoir.operators.quality import unfold

    wide = live(df, rate).agg(*[m for i, (*_, where) in enumerate(lines) for m in (
        count_if(where).alias(f"n{i}"), total(VALUE, where).alias(f"v{i}"))])
    return unfold(wide, [[("section", F.lit(s)), ("ligne_excel", F.lit(n)), ("rubrique", F.lit(r)),
                          ("nombre", F.col(f"n{i}")), ("volume_cdf", F.col(f"v{i}"))]
                         for i, (s, n, r, _) in enumerate(lines)])


def structuring(df: DataFrame, rate: float = DEFAULT_RATE, truncate_day: bool = False) -> DataFrame:
    """Several operations, each under the high threshold, that reach it together.

    Groups by the full time stamp unless ``truncate_day`` asks for the calendar day.
    """
    high = F.lit(rate * 10000).cast(MONEY)
    rows = live(df, rate)
    when = F.to_date("date_operation") if truncate_day else F.col("date_operation")
    grouped = rows.groupBy(when.alias("date_operation"), "client_id", "nom_client", "type_mouvement", "code_devise").agg(
        operation_count().alias("nb_operations"), exact_sum(VALUE).alias("s"), F.max(VALUE).cast(MONEY).alias("m"))
    found = grouped.where((F.col("nb_operations") >= 2) & (F.col("m") < high) & (F.col("s") >= high))
    return found.select("date_operation", "client_id", "nom_client", "type_mouvement", "code_devise", "nb_operations",
                        F.col("s").cast("double").alias("montant_cumule_cdf"),
                        F.col("m").cast("double").alias("montant_max_unitaire_cdf"))


def unusual_activity(df: DataFrame, rate: float = DEFAULT_RATE, days: int = 90, multiple: float = 3.0) -> DataFrame:
    """Volume of the last days against the mean daily volume before them.

    A client is listed at the high threshold when there is no history, or when the whole period's volume reaches
    ``multiple`` times the daily mean.
    """
    rows = live(df, rate)
    date = stamp(rows, "date_operation")
    start = F.date_sub(F.to_date(rows.agg(F.max(date).alias("d")).scalar()), days - 1).cast("timestamp_ntz")
    current = rows.where(date >= start).groupBy("client_id", "nom_client").agg(
        operation_count().alias("nb_operations_periode"), exact_sum(VALUE).alias("s"))
    # The mean of daily sums is the whole sum over the number of days seen.
    history = rows.where(date < start).groupBy("client_id").agg(
        ratio(exact_sum(VALUE), F.count_distinct(date)).alias("moyenne_journaliere_historique_cdf"))
    joined = match_null_safe(current, history, ["client_id"], "left")
    mean = F.col("moyenne_journaliere_historique_cdf")
    volume = F.col("s").cast("double")
    return joined.where(
        (F.col("s") >= F.lit(rate * 10000).cast(MONEY)) & (mean.isNull() | (volume >= mean * multiple))
    ).select("client_id", "nom_client", "nb_operations_periode", volume.alias("volume_periode_cdf"), mean,
             ratio(volume, mean).alias("multiple_vs_moyenne_historique"))


def high_activity_kyc(df: DataFrame, rate: float = DEFAULT_RATE) -> DataFrame:
    """Clients over the high threshold whose identity or attachment is incomplete."""
    rows = live(df, rate)
    defaults = {"type_client": F.lit(None).cast("string"), "agence_client": F.lit(None).cast("string"),
                "agent_credit": F.lit(None).cast("string"), "est_valide": F.lit(False), "droit_paye": F.lit(False),
                "kyc_missing_count": F.lit(0)}
    added = {c: v for c, v in defaults.items() if not has(rows, c)}
    rows = rows.withColumns(added) if added else rows
    grouped = rows.groupBy("client_id", "nom_client").agg(
        operation_count().alias("nb_operations"), exact_sum(VALUE).alias("s"),
        *[F.min(c).alias(c) for c in ("type_client", "agence_client", "agent_credit")],
        *[F.max(c).alias(c) for c in ("est_valide", "droit_paye", "kyc_missing_count")])
    lacking = (F.col("client_id").isNull() | blank(F.col("nom_client")) | F.col("type_client").isNull()
               | F.col("agence_client").isNull() | F.col("agent_credit").isNull()
               | ~F.coalesce("est_valide", F.lit(False)) | ~F.coalesce("droit_paye", F.lit(False))
               | (F.coalesce("kyc_missing_count", F.lit(0)) > 0))
    found = grouped.where((F.col("s") >= F.lit(rate * 10000).cast(MONEY)) & lacking)
    return found.withColumn("volume_lignes_cdf", F.col("s").cast("double")).drop("s")


def client_movements(df: DataFrame, rate: float = DEFAULT_RATE) -> DataFrame:
    """Deposits and withdrawals per client, with the largest single operation, in one pass."""
    deposit, withdrawal = F.col("type_mouvement").isin(*L.DEPOSITS), F.col("type_mouvement").isin(*L.WITHDRAWALS)
    return live(df, rate).groupBy("client_id", "nom_client").agg(
        count_if(deposit).alias("nb_depots"), total(VALUE, deposit).alias("volume_depots_cdf"),
        count_if(withdrawal).alias("nb_retraits"), total(VALUE, withdrawal).alias("volume_retraits_cdf"),
        operation_count().alias("nb_operations"), exact_sum(VALUE).alias("volume_total_cdf"),
        F.max(VALUE).alias("plus_grosse_operation_cdf"))


def client_summary(df: DataFrame, rate: float = DEFAULT_RATE) -> DataFrame:
    return client_movements(df, rate).withColumn("volume_total_cdf", F.col("volume_total_cdf").cast("double")).drop(
        "plus_grosse_operation_cdf")


def top_clients(df: DataFrame, rate: float = DEFAULT_RATE, top_n: int = 50) -> DataFrame:
    top = client_movements(df, rate).orderBy(F.desc("volume_total_cdf"), "client_id", "nom_client").limit(top_n)
    return top.withColumn("volume_total_cdf", F.col("volume_total_cdf").cast("double"))


def cancelled_operations(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("annule"), F.lit(False))).orderBy(F.desc("date_operation"), "operation_id")


def risky_users(df: DataFrame, busy: int = 50, late: int = 10) -> DataFrame:
    """Users with much activity, any cancellation, many late entries or any self-validation."""
    def flagged(c: str) -> Column:
        return count_if(F.coalesce(F.col(c), F.lit(False))) if has(df, c) else F.lit(0).cast("bigint")

    grouped = df.groupBy("operateur").agg(
        operation_count().alias("nb_operations"), flagged("annule").alias("nb_annulations"),
        flagged("saisie_tardive").alias("nb_saisies_tardives"), flagged("auto_validation").alias("nb_auto_validations"),
        F.count_distinct("agence").alias("nb_points_service"), F.count_distinct("type_operation").alias("nb_types_operation"))
    return grouped.where((F.col("nb_operations") >= busy) | (F.col("nb_annulations") > 0)
                         | (F.col("nb_saisies_tardives") >= late) | (F.col("nb_auto_validations") > 0))


def service_points(df: DataFrame, quantile: float = 0.9) -> DataFrame:
    """Activity per branch and operation type, marked from the 90th percentile of these groups on.

    The percentile is taken over the groups, whose number is bounded by branches and operation types.
    """
    def flagged(c: str) -> Column:
        return count_if(F.coalesce(F.col(c), F.lit(False))) if has(df, c) else F.lit(0).cast("bigint")

    grouped = df.groupBy("agence", "type_operation").agg(
        operation_count().alias("nb_operations"), flagged("annule").alias("nb_annulations"),
        flagged("saisie_tardive").alias("nb_saisies_tardives"))
    limit = grouped.agg(F.percentile("nb_operations", quantile).alias("q")).scalar()
    return grouped.withColumn("a_relire_en_priorite", F.col("nb_operations") >= limit)


def mobile_summary(df: DataFrame, groups: Sequence[str] = ("type_operation", "agence")) -> DataFrame:
    """Mobile operations per type, month and branch."""
    rows = df.where(F.col("source_mouvement") == "API_MOBILE")
    value = number(df, "montant_operation")
    side = F.upper("sens") if has(df, "sens") else F.lit(None)
    lines = F.sum("nb_ecritures") if has(df, "nb_ecritures") else F.count("*")
    debit = total("total_debit") if has(df, "total_debit") else total(value, side == "D")
    credit = total("total_credit") if has(df, "total_credit") else total(value, side == "C")
    return rows.groupBy(*groups, month_text(stamp(df, "date_operation")).alias("mois")).agg(
        operation_count().alias("nb_operations"), lines.alias("nb_lignes_comptables"), debit.alias("total_debit"),
        credit.alias("total_credit"), count_if(F.coalesce(F.col("annule"), F.lit(False))).alias("nb_annulees"))
