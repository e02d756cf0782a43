"""Standardised credit and savings tables: canonical columns, typed values, derived capacity, ratio and risk."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comptoir.functions import labels as L
from comptoir.functions.money import ratio
from comptoir.functions.text import none_if_blank, strip
from comptoir.operators.common import has, month_text, number, stamp

# Columns read as numbers and as dates.
NUMERIC_COLUMNS = (
    "nombre", "volume", "montant", "nombre_anomalies", "montant_demande", "montant_accorde", "revenu_mensuel",
    "charge_mensuelle", "duree_credit_mois", "taux_interet", "score_credit", "retard_jours", "age",
    "montant_operation", "solde_initial", "solde_final", "montant_debit", "montant_credit", "solde_compte",
    "encaisse_fin_jour", "ecart_caisse", "solde_banque", "ecart_rapprochement", "salaire",
)
DATE_COLUMNS = (
    "date_evenement", "date_alerte", "date_declaration", "date_debut", "date_fin", "date_demande", "date_decision",
    "date_operation", "date_saisie", "date_entree", "date_activation", "date_revocation", "date_sauvegarde",
)
CLIENT_FALLBACKS = ("code_client", "code_adherent", "id_adherent_lab")


def with_risk(df: DataFrame) -> DataFrame:
    """Repayment capacity, debt ratio, estimated instalment, risk level and month of request."""
    out = df
    if has(out, "revenu_mensuel", "charge_mensuelle"):
        out = out.withColumns({
            "capacite_remboursement": F.col("revenu_mensuel") - F.col("charge_mensuelle"),
            "taux_endettement": ratio(F.col("charge_mensuelle"), F.col("revenu_mensuel")),
        })
    if has(out, "montant_accorde", "duree_credit_mois"):
        out = out.withColumn("mensualite_estimee", ratio(F.col("montant_accorde"), F.col("duree_credit_mois")))

    def maybe(column: str):
        return F.col(column) if has(out, column) else None

    out = out.withColumn("niveau_risque_calcule", L.risk_level(
        maybe("niveau_risque"), maybe("score_credit"), maybe("taux_endettement"), maybe("retard_jours")))
    if has(out, "date_demande"):
        out = out.withColumn("mois_demande", month_text(F.col("date_demande")))
    return out


def standardize(df: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Canonical table in one projection chain; ``aliases`` maps source headers to canonical names."""
    from comptoir.sources.contracts import rename_and_coalesce

    out = rename_and_coalesce(df, aliases) if aliases else df
    if not has(out, "client_id"):
        source = next((c for c in CLIENT_FALLBACKS if c in out.columns), None)
        if source:
            out = out.withColumn("client_id", F.col(source))
    if not has(out, "devise") and has(out, "code_devise"):
        out = out.withColumn("devise", F.col("code_devise"))
    typed = {c: number(out, c) for c in NUMERIC_COLUMNS if c in out.columns}
    typed.update({c: stamp(out, c) for c in DATE_COLUMNS if c in out.columns})
    for column, convert in (("statut_dossier", L.file_status), ("statut_remboursement", L.repayment_status),
                            ("sexe", L.sex)):
        if has(out, column):
            typed[column] = convert(F.col(column))
    if has(out, "telephone", "Portable"):
        typed["telephone"] = F.coalesce(none_if_blank(F.col("telephone")), strip(F.col("Portable")))
    if has(out, "nom_client"):
        name = none_if_blank(F.col("nom_client"))
        if has(out, "Client Name"):
            name = F.coalesce(none_if_blank(F.col("Client Name")), name)
        elif has(out, "Prénom"):
            name = F.coalesce(name, none_if_blank(F.col("Prénom")))
        typed["nom_client"] = name
    return with_risk(out.withColumns(typed) if typed else out)
