"""Rule sets of the control cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.functions import labels as L
from comptoir.functions.text import blank, none_if_blank, normalize_label, strip
from comptoir.operators.common import first_existing, has, number, number_or_zero, stamp
from comptoir.operators.portfolio import KYC_FIELDS, inactivity_days
from comptoir.operators.quality import count_over, distinct_over
from comptoir.operators.rules import Rule, any_of, reasons, watchlist
from comptoir.plans.ordered import quantile_by

# Limits of the loan products (None = no limit).
PRODUCT_LIMITS = {
    # product: (min amount, max amount, min months, max months, min rate, max rate)
    "lisungi": (100.0, 80000.0, 2.0, 12.0, 2.5, 4.0),
    "salaire": (100.0, 10000.0, 2.0, 24.0, 2.5, 2.5),
    "personnel": (100.0, 15000.0, 2.0, 24.0, 2.5, 2.5),
    "avance_salaire": (0.0, None, 1.0, 1.0, 5.0, 5.0),
    "dare_dare": (100.0, 10000.0, None, None, 2.0, 2.0),
    "pepsi": (100.0, 10000.0, None, None, 2.0, 2.0),
    "auto": (5000.0, 20000.0, 12.0, 24.0, 2.5, 2.5),
    "collectif": (100.0, 10000.0, 2.0, 12.0, 2.5, 4.0),
    "likelemba": (100.0, 10000.0, None, None, 2.5, 2.5),
}
TERM_DEPOSIT_MINIMUM = {"physique": 500.0, "morale": 5000.0}  # USD
EMAIL_SHAPE = "^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"
ID_DOCUMENT = "Numéro de la pièce d’identité"


def limit_of(product: Column, position: int) -> Column:
    table = F.create_map(*[x for name, limits in PRODUCT_LIMITS.items() if limits[position] is not None
                           for x in (F.lit(name), F.lit(limits[position]))])
    return F.try_element_at(table, product)


def outside(value: Column, product: Column, low: int, high: int) -> Column:
    """Outside the product's limits; a missing limit or value is never outside."""
    no = F.lit(False)
    return F.coalesce(value < limit_of(product, low), no) | F.coalesce(value > limit_of(product, high), no)


def credit_work(df: DataFrame) -> DataFrame:
    """Loan files with their product class, computed once for all product rules."""
    return df.withColumn("produit_reference", L.credit_product(F.col("type_produit"))) if has(df, "type_produit") else df


def credit_rules(df: DataFrame) -> list[Rule]:
    """Rules over the table returned by :func:`credit_work`."""
    rules: list[Rule] = []
    if has(df, "niveau_risque_calcule"):
        rules.append((F.col("niveau_risque_calcule") == "Élevé", "Risque élevé"))
    if has(df, "retard_jours"):
        rules.append((F.col("retard_jours") > 30, "Retard > 30 jours"))
    if has(df, "capacite_remboursement"):
        rules.append((F.col("capacite_remboursement") < 0, "Capacité négative"))
    if has(df, "revenu_mensuel", "charge_mensuelle"):
        rules.append((F.col("revenu_mensuel").isNull() | F.col("charge_mensuelle").isNull(), "Données financières incomplètes"))
    if has(df, "type_produit"):
        product = F.col("produit_reference")
        if has(df, "garantie"):
            rules.append((product.isNotNull() & blank(F.col("garantie")), "Garantie non renseignée"))
        if has(df, "montant_demande"):
            asked = number(df, "montant_demande")
            rules.append((outside(asked, product, 0, 1), "Montant hors référentiel produit"))
            if has(df, "revenu_mensuel"):
                income = number(df, "revenu_mensuel")
                rules.append(((product == "avance_salaire") & (income > 0) & (asked > income / 3.0),
                              "Avance sur salaire > 1/3 du salaire"))
        if has(df, "duree_credit_mois"):
            rules.append((outside(number(df, "duree_credit_mois"), product, 2, 3), "Durée hors référentiel produit"))
        if has(df, "taux_interet"):
            rules.append((outside(number(df, "taux_interet"), product, 4, 5), "Taux hors référentiel produit"))
    return rules


def credit_watchlist(df: DataFrame) -> DataFrame:
    return watchlist(credit_work(df), credit_rules(df))


def in_source(df: DataFrame, column: str) -> Column:
    """Whether the row's own source file had the column; always true when sources are not traced."""
    if not has(df, "schema_colonnes_source"):
        return F.lit(True)
    return F.coalesce(F.contains(F.col("schema_colonnes_source"), F.lit(f"|{column}|")), F.lit(False))


def risk_rules(df: DataFrame) -> list[Rule]:
    return [(F.col("niveau_risque_calcule") == "Élevé", "Risque élevé")] if has(df, "niveau_risque_calcule") else []


def flag_of(df: DataFrame, column: str) -> Column:
    """A flag column of any type: booleans, non-zero numbers, or a yes-like text."""
    kind = df.schema[column].dataType.simpleString()
    if kind == "boolean":
        return F.col(column)
    if kind == "string":
        return F.lower(strip(F.col(column))).isin("1", "true", "vrai", "yes", "oui", "y", "o")
    return F.coalesce(F.col(column), F.lit(0)) != 0


def compliance_rules(df: DataFrame) -> list[Rule]:
    rules = risk_rules(df)
    if has(df, "statut_couverture"):
        cover = normalize_label(F.col("statut_couverture"))
        rules += [(cover.isin("bloquant", "non couvert"), "Rubrique non couverte"),
                  (cover == "partiel", "Couverture partielle à valider")]
    review = first_existing(df, ("statut_revue", "statut_revue_conformite"))
    if review:
        rules.append((F.contains(normalize_label(F.col(review)), F.lit("revoir")), "Alerte à revoir"))
    state = first_existing(df, ("etat", "etat_alerte"))
    if state:
        rules.append((blank(F.col(state)), "État de l'alerte manquant"))
    if has(df, "numero_alerte"):
        rules.append((blank(F.col("numero_alerte")), "Numéro d'alerte manquant"))
    if has(df, "severite"):
        rules.append((normalize_label(F.col("severite")).isin("critique", "elevee", "eleve"), "Anomalie de qualité prioritaire"))
    if has(df, "nombre_anomalies"):
        rules.append((number_or_zero(df, "nombre_anomalies") > 0, "Anomalies de données détectées"))
    elif has(df, "nombre") and (has(df, "type_element") or has(df, "type_ligne")):
        quality = (normalize_label(F.col("type_element")) == "controle qualite") if has(df, "type_element") \
            else (F.upper("type_ligne") == "CONTROLE_QUALITE")
        rules.append((quality & (number_or_zero(df, "nombre") > 0), "Anomalies de données détectées"))
    # Flag columns and keywords with their labels.
    for column, label in {
        "operation_fractionnee": "Opération fractionnée",
        "operation_gel_fonds": "Opération liée à un gel de fonds",
        "operation_haut_risque": "Opération à haut risque",
        "soupcon_blanchiment": "Soupçon de blanchiment",
        "soupcon_financement_terrorisme": "Soupçon de financement du terrorisme",
        "anomalie_identite_absente": "Identité blacklist insuffisante",
    }.items():
        if has(df, column):
            rules.append((flag_of(df, column), label))
    if has(df, "indicateurs"):
        text = F.lower("indicateurs")
        for keyword, label in {
            "fractionnement": "Opération fractionnée",
            "gel des fonds": "Opération liée à un gel de fonds",
            "haut risque": "Opération à haut risque",
            "blanchiment": "Soupçon de blanchiment",
            "financement du terrorisme": "Soupçon de financement du terrorisme",
            "identite absente": "Identité blacklist insuffisante",
        }.items():
            rules.append((F.contains(text, F.lit(keyword)), label))
    if has(df, "devise") and first_existing(df, ("montant", "volume", "montant_operation")):
        rules.append((blank(F.col("devise")), "Devise manquante"))
    return rules


def crm_work(df: DataFrame) -> DataFrame:
    """Clients with their inactivity and the number of clients sharing their phone or identity document."""
    out = df
    if has(out, "date_operation"):
        out = out.withColumn("jours_inactivite", inactivity_days(df))
    phones = [c for c in ("telephone", "Portable") if has(df, c)]
    if phones:
        phone = F.coalesce(*[none_if_blank(F.col(c)) for c in phones])
        out = out.withColumns({"telephone_contact": phone, "__digits": F.nullif(L.phone_digits(phone), F.lit(""))})
        if has(df, "client_id"):
            out = distinct_over(out, "__digits", "client_id", "clients_par_telephone")
    if has(df, ID_DOCUMENT):
        piece = F.nullif(none_if_blank(F.col(ID_DOCUMENT)), F.lit("0"))
        out = out.withColumn("__piece", piece)
        if has(df, "client_id"):
            out = distinct_over(out, "__piece", "client_id", "clients_par_piece")
    return out


def crm_rules(df: DataFrame, work: DataFrame) -> list[Rule]:
    rules = risk_rules(df)
    for column, label in (("client_id", "Identifiant client manquant"), ("nom_client", "Nom client manquant"),
                          ("agent_credit", "Gestionnaire non renseigné")):
        if has(df, column):
            rules.append((blank(F.col(column)), label))
    if has(df, "compte_id"):
        account = strip(F.col("compte_id").cast("string"))
        rules.append((F.coalesce(account, F.lit("")).isin("", "0"), "Numéro de compte client manquant"))
    if has(df, ID_DOCUMENT):
        rules.append((F.col("__piece").isNull(), "Pièce d'identité manquante"))
        if has(work, "clients_par_piece"):
            rules.append((F.col("clients_par_piece") > 1, "Pièce d'identité partagée"))
    if has(df, "date_operation"):
        idle = F.col("jours_inactivite")
        known = stamp(df, "date_operation").isNotNull()
        any_date = df.agg(F.max(stamp(df, "date_operation")).alias("d")).scalar().isNotNull()
        rules += [(any_date & ~known, "Dernière activité non renseignée"), (idle >= 90, "Aucune activité récente >= 90 j"),
                  (idle >= 180, "Aucune activité récente >= 180 j")]
    if has(work, "telephone_contact"):
        phone, digits = F.col("telephone_contact"), L.phone_digits(F.col("telephone_contact"))
        rules += [(phone.isNull(), "Téléphone manquant"),
                  (phone.isNotNull() & ~digits.rlike(L.PHONE_VALID), "Téléphone non fiable")]
        if has(work, "clients_par_telephone"):
            rules.append((F.col("clients_par_telephone") > 1, "Téléphone partagé"))
    if has(df, "E-mail"):
        email = none_if_blank(F.col("E-mail"))
        rules.append((email.isNotNull() & ~email.rlike(EMAIL_SHAPE), "E-mail non fiable"))
        if has(work, "telephone_contact"):
            rules.append((email.isNull() & F.col("telephone_contact").isNull(), "Contact client insuffisant"))
    if has(df, "Locked"):
        rules.append((flag_text(df, "Locked", "locked"), "Fiche verrouillée"))
    if has(df, "Rejet des mails"):
        rules.append((flag_text(df, "Rejet des mails"), "Rejet des mails actif"))
    if has(df, "Mode Désabonné"):
        rules.append((~blank(F.col("Mode Désabonné")), "Client désabonné"))
    return rules


def flag_text(df: DataFrame, column: str, *more: str) -> Column:
    if df.schema[column].dataType.simpleString() == "boolean":
        return F.col(column)
    return normalize_label(F.col(column)).isin("true", "oui", "1", *more)


def savings_work(df: DataFrame) -> DataFrame:
    """Accounts with product class, inactivity, missing identity fields, accounts per client and source files."""
    out = df
    if has(df, "type_produit"):
        out = out.withColumn("produit_reference", L.savings_product(F.col("type_produit")))
    if has(df, "date_operation"):
        out = out.withColumn("jours_inactivite", inactivity_days(df))
    tracked = [c for c in KYC_FIELDS if has(df, c)]
    if tracked:
        missing = F.lit(0)
        for c in tracked:
            gone = stamp(df, c).isNull() if c == "date_operation" else blank(F.col(c))
            missing = missing + (in_source(df, c) & gone).cast("int")
        out = out.withColumn("champs_kyc_manquants", missing)
    if has(df, "client_id", "compte_id"):
        out = distinct_over(out, "client_id", "compte_id", "nombre_comptes_client")
    if has(df, "Provenance", "compte_id"):
        out = distinct_over(out, "compte_id", "Provenance", "nombre_extractions_compte")
    return out


def savings_rules(df: DataFrame, work: DataFrame) -> list[Rule]:
    rules = risk_rules(df)
    product = F.col("produit_reference") if has(work, "produit_reference") else F.lit(None).cast("string")
    for column, label in (("compte_id", "Compte non renseigné"), ("type_operation", "Type d'opération manquant"),
                          ("type_produit", "Produit d'épargne manquant")):
        if has(df, column):
            rules.append((in_source(df, column) & blank(F.col(column)), label))
    for column, label in (("statut_controle", "Statut de contrôle à revoir"), ("statut_inactivite", "Compte inactif ou dormant")):
        if has(df, column):
            rules.append((in_source(df, column) & ~blank(F.col(column)), label))
    if has(df, "statut_compte"):
        rules.append((normalize_label(F.col("statut_compte")).isin("bloque", "dormant", "inactif"), "Compte sensible"))
    balance = number(df, "solde_compte") if has(df, "solde_compte") else None
    if balance is not None:
        rules.append((balance < 0, "Solde négatif"))
        if has(df, "type_client"):
            least = F.when(L.is_corporate(F.col("type_client")), TERM_DEPOSIT_MINIMUM["morale"]).otherwise(TERM_DEPOSIT_MINIMUM["physique"])
            rules.append(((product == "dat") & (balance < least), "DAT sous minimum attendu"))
    if has(df, "taux_interet"):
        rate = number(df, "taux_interet")
        rules.append(((product == "dat") & ((rate < 0) | (rate > 8)), "Taux DAT hors référentiel"))
    if has(df, "type_produit", "sexe"):
        rules.append(((product == "femme") & (normalize_label(F.col("sexe")) == "masculin"), "Produit femme à confirmer"))
    if has(df, "date_operation"):
        idle = F.col("jours_inactivite")
        rules += [(idle >= 90, "Compte inactif >= 90 j"), (idle >= 180, "Compte très inactif >= 180 j")]
        if balance is not None:
            positive = df.select(balance.alias("b")).where("b > 0")
            limit = quantile_by(positive, [], "b", 0.90).scalar()
            rules.append(((idle >= 90) & (balance >= limit), "Dormance sur solde significatif"))
    if has(df, "telephone"):
        known = in_source(df, "telephone")
        digits = L.phone_digits(F.col("telephone"))
        rules += [(known & blank(F.col("telephone")), "Téléphone manquant"),
                  (known & ~blank(F.col("telephone")) & ~digits.rlike(L.PHONE_VALID), "Téléphone non fiable")]
    if has(work, "champs_kyc_manquants"):
        rules.append((F.col("champs_kyc_manquants") >= 2, "KYC incomplet (2+ champs)"))
    if has(work, "nombre_comptes_client"):
        rules.append((F.col("nombre_comptes_client") >= 3, "Client multi-comptes (>= 3)"))
    if has(df, "sexe", "categorie"):
        sex = normalize_label(F.col("sexe"))
        kind = normalize_label(F.col("categorie"))
        kind = F.when(kind == "f", "feminin").when(kind == "m", "masculin").otherwise(kind)
        rules.append(((sex != "") & (kind != "") & (sex != kind), "Incohérence sexe / catégorie"))
    if has(work, "nombre_extractions_compte"):
        rules.append((F.col("nombre_extractions_compte") > 1, "Compte présent dans plusieurs extractions"))
    return rules


def operations_work(df: DataFrame) -> DataFrame:
    out = df
    for column, name in (("numero_reference", "occurrences_reference"), ("numero_recu", "occurrences_recu")):
        if has(df, column):
            out = count_over(out.withColumn("__k", none_if_blank(F.col(column))), ["__k"], name).drop("__k")
    return out


def operations_rules(df: DataFrame, work: DataFrame) -> list[Rule]:
    rules = risk_rules(df)
    for column, label in (("operation_non_validee", "Opération non validée"), ("saisie_tardive", "Saisie tardive"),
                          ("validation_incoherente", "Validation incohérente"), ("auto_validation", "Auto-validation"),
                          ("annule", "Opération annulée")):
        if has(df, column):
            rules.append((F.col(column), label))
    for column, label in (("operateur", "Utilisateur non renseigné"), ("agence", "Point de service manquant")):
        if has(df, column):
            rules.append((blank(F.col(column)), label))
    if has(df, "type_operation"):
        rules.append((in_source(df, "type_operation") & blank(F.col("type_operation")), "Type d'opération manquant"))
    if has(work, "occurrences_reference"):
        rules.append((F.col("occurrences_reference") > 1, "Référence dupliquée"))
    if has(work, "occurrences_recu"):
        rules.append((F.col("occurrences_recu") > 1, "Reçu dupliqué"))
    if has(df, "equilibre_comptable_ok"):
        rules.append((~F.coalesce("equilibre_comptable_ok", F.lit(False)), "Écriture déséquilibrée"))
    for column, label in (("ecarts_date_valeur", "Date de valeur différente"), ("lignes_sens_absent", "Sens comptable absent"),
                          ("lignes_montant_non_positif", "Montant comptable non positif"),
                          ("kyc_missing_count", "KYC client à compléter")):
        if has(df, column):
            rules.append((number_or_zero(df, column) > 0, label))
    return rules


def _missing(*pairs: tuple[str, str]):
    return lambda df: [(blank(F.col(c)), label) for c, label in pairs if has(df, c)]


def cash_rules(df: DataFrame) -> list[Rule]:
    rules = _missing(("caissier", "Caissier non renseigné"))(df)
    if has(df, "ecart_caisse"):
        rules.append((number_or_zero(df, "ecart_caisse") != 0, "Écart de caisse"))
    if has(df, "encaisse_fin_jour"):
        rules.append((number(df, "encaisse_fin_jour") < 0, "Encaisse négative"))
    return rules


def treasury_rules(df: DataFrame) -> list[Rule]:
    rules = _missing(("banque", "Banque non renseignée"), ("compte_bancaire", "Compte bancaire manquant"))(df)
    if has(df, "ecart_rapprochement"):
        rules.append((number_or_zero(df, "ecart_rapprochement") != 0, "Écart de rapprochement"))
    if has(df, "solde_banque"):
        rules.append((number(df, "solde_banque") < 0, "Solde bancaire négatif"))
    return rules


def accounting_rules(df: DataFrame) -> list[Rule]:
    rules = _missing(("piece_id", "Pièce comptable manquante"), ("journal", "Journal non renseigné"))(df)
    if has(df, "montant_debit", "montant_credit"):
        gap = F.abs(number_or_zero(df, "montant_debit") - number_or_zero(df, "montant_credit"))
        rules.append((gap > F.lit(0.01), "Écriture non équilibrée"))
    return rules


def staff_rules(df: DataFrame) -> list[Rule]:
    rules = _missing(("agent_id", "Agent non renseigné"), ("fonction", "Fonction manquante"))(df)
    if has(df, "salaire"):
        pay = number(df, "salaire")
        rules.append((pay.isNull() | (pay <= 0), "Salaire non documenté"))
    return rules


def continuity_rules(df: DataFrame) -> list[Rule]:
    rules = _missing(("type_sauvegarde", "Type de sauvegarde manquant"), ("support_sauvegarde", "Support non renseigné"),
                     ("statut_test_reprise", "Test de reprise non documenté"))(df)
    if has(df, "incident_majeur"):
        text = F.coalesce(strip(F.col("incident_majeur").cast("string")), F.lit(""))
        rules.append(((text != "") & (text != "Non"), "Incident majeur déclaré"))
    return rules


def provider_rules(df: DataFrame) -> list[Rule]:
    rules = _missing(("numero_reference", "Référence manquante"), ("operateur", "Opérateur non renseigné"),
                     ("tresorier", "Trésorier non renseigné"), ("telephone", "Téléphone non renseigné"),
                     ("journal_transaction", "Journal de transaction manquant"))(df)
    if has(df, "solde_final"):
        rules.append((number(df, "solde_final") < 0, "Solde final négatif"))
    return rules


SIMPLE_CYCLES = {
    "conformite": compliance_rules,
    "caisse": cash_rules,
    "tresorerie": treasury_rules,
    "comptable": accounting_rules,
    "rh_admin": staff_rules,
    "si": _missing(("agent_id", "Agent non renseigné"), ("profil_acces", "Profil d'accès manquant"),
                   ("niveau_habilitation", "Niveau d'habilitation manquant")),
    "continuite": continuity_rules,
    "money_provider": provider_rules,
}
WORKED_CYCLES = {
    "crm_clients": (crm_work, crm_rules),
    "epargne": (savings_work, savings_rules),
    "operations_depot_retrait": (operations_work, operations_rules),
}


def cycle_watchlist(df: DataFrame, cycle: str) -> DataFrame:
    """Rows that meet at least one rule of a control cycle, with the reasons."""
    if cycle in ("credit", "likelemba"):
        return credit_watchlist(df)
    if cycle in WORKED_CYCLES:
        prepare, rules = WORKED_CYCLES[cycle]
        work = prepare(df)
        found = watchlist(work, rules(df, work))
        return found.drop(*[c for c in found.columns if c.startswith("__")])
    if cycle not in SIMPLE_CYCLES:
        raise ValueError(f"unknown control cycle: {cycle}")
    shared = risk_rules(df) if cycle != "conformite" else []
    return watchlist(df, [*shared, *SIMPLE_CYCLES[cycle](df)])


def crm_actions(df: DataFrame) -> DataFrame:
    """What to do for each client: labels are actions, and only some of them put the client on the list."""
    work = crm_work(df)
    phone = F.col("telephone_contact") if has(work, "telephone_contact") else F.lit(None).cast("string")
    digits = L.phone_digits(phone)
    email = none_if_blank(F.col("E-mail")) if has(df, "E-mail") else F.lit(None).cast("string")
    no = F.lit(False)
    bad_phone = phone.isNotNull() & ~digits.rlike(L.PHONE_VALID)
    bad_email = email.isNotNull() & ~email.rlike(EMAIL_SHAPE)
    piece_missing = F.col("__piece").isNull() if has(work, "__piece") else F.lit(True)
    account = strip(F.col("compte_id").cast("string")) if has(df, "compte_id") else F.lit("")
    account_missing = F.coalesce(account, F.lit("")).isin("", "0")

    def lacks(c: str) -> Column:
        return blank(F.col(c)) if has(df, c) else no

    idle = F.col("jours_inactivite") if has(work, "jours_inactivite") else F.lit(None).cast("int")
    shared_phone = (F.col("clients_par_telephone") > 1) if has(work, "clients_par_telephone") else no
    shared_piece = (F.col("clients_par_piece") > 1) if has(work, "clients_par_piece") else no
    locked = flag_text(df, "Locked") if has(df, "Locked") else no
    unsubscribed = ~blank(F.col("Mode Désabonné")) if has(df, "Mode Désabonné") else no
    rejects = flag_text(df, "Rejet des mails") if has(df, "Rejet des mails") else no
    rules = [
        (phone.isNull(), "ajouter le téléphone", True), (bad_phone, "corriger le téléphone", True),
        (email.isNull(), "ajouter l'e-mail", False), (bad_email, "corriger l'e-mail", True),
        (piece_missing, "ajouter la pièce", True), (account_missing, "renseigner le compte client", True),
        (lacks("agent_credit"), "affecter un gestionnaire", True), (lacks("zone_geographique"), "compléter la province", False),
        (lacks("categorie"), "compléter la catégorie", False), (idle.isNull(), "mettre à jour la dernière activité", True),
        (idle >= 180, "relancer le client inactif", False), (shared_phone, "vérifier le téléphone partagé", True),
        (shared_piece, "vérifier la pièce partagée", True), (locked, "vérifier la fiche verrouillée", True),
        (unsubscribed, "revoir le désabonnement", True), (rejects, "contrôler le rejet d'e-mail", True),
    ]
    listed = any_of([(c, label) for c, label, decides in rules if decides])
    out = work.where(listed).withColumn("lecture", reasons([(c, label) for c, label, _ in rules]))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


