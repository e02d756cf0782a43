"""Fixed label maps and label-based classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from comptoir.functions.text import contains_any, let, map_labels, none_if_blank, normalize_label, strip, title

# Normalised label to canonical label.
FILE_STATUS = {
    "recu": "Reçu", "en analyse": "En analyse", "en cours": "En analyse", "a completer": "À compléter",
    "approuve": "Approuvé", "accorde": "Approuvé", "rejete": "Rejeté", "refuse": "Rejeté", "decaisse": "Décaissé",
    "en remboursement": "En remboursement", "en retard": "En retard", "cloture": "Clôturé",
}
REPAYMENT_STATUS = {
    "a jour": "À jour", "normal": "À jour", "non decaisse": "Non décaissé", "en retard": "En retard",
    "impaye": "En retard", "solde": "Soldé", "cloture": "Soldé",
}
SEX = {
    "m": "Masculin", "masculin": "Masculin", "male": "Masculin", "homme": "Masculin", "h": "Masculin",
    "f": "Féminin", "feminin": "Féminin", "female": "Féminin", "femme": "Féminin",
}
RISK_LEVEL = {"faible": "Faible", "moyen": "Moyen", "eleve": "Élevé", "non renseigne": "Non renseigné"}
STATUS_FLOW = (
    "Reçu", "À compléter", "En analyse", "Approuvé", "Décaissé", "En remboursement", "En retard", "Clôturé", "Rejeté",
)
APPROVED = ("Approuvé", "Décaissé", "En remboursement", "En retard", "Clôturé")
MOVEMENT = {"DEPO": "Depot", "RETR": "Retrait", "MOB_DEPO": "Depot mobile", "MOB_RETR": "Retrait mobile"}
DEPOSITS = ("Depot", "Depot mobile")
WITHDRAWALS = ("Retrait", "Retrait mobile")
CURRENCY_BY_ID = {1: "USD", 2: "CDF"}
MISSING = "Non renseigné"


def file_status(col: Column) -> Column:
    return map_labels(col, FILE_STATUS)


def repayment_status(col: Column) -> Column:
    return map_labels(col, REPAYMENT_STATUS)


def sex(col: Column) -> Column:
    return map_labels(col, SEX)


def or_missing(col: Column, label: str = MISSING) -> Column:
    """Stripped text, or the label for a blank one."""
    return F.coalesce(none_if_blank(col), F.lit(label))


def movement(type_operation: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MOVEMENT.items() for x in pair])
    return F.coalesce(F.try_element_at(table, type_operation), type_operation)


def currency_code(id_devise: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CURRENCY_BY_ID.items() for x in pair])
    return F.coalesce(F.try_element_at(table, id_devise.try_cast("int")), id_devise.cast("string"))


def credit_product(col: Column) -> Column:
    """Product class of a loan label; the order of the tests decides."""
    def classify(text: Column) -> Column:
        def has(word: str) -> Column:
            return F.contains(text, F.lit(word))

        return (
            F.when(has("avance") & has("salaire"), "avance_salaire")
            .when(has("likelemba"), "likelemba")
            .when(has("lisungi"), "lisungi")
            .when(has("dare"), "dare_dare")
            .when(has("pepsi"), "pepsi")
            .when(has("auto"), "auto")
            .when(has("collectif"), "collectif")
            .when(has("personnel"), "personnel")
            .when(has("salaire"), "salaire")
        )

    return let(normalize_label(col), classify)


def savings_product(col: Column) -> Column:
    def classify(text: Column) -> Column:
        return (
            F.when(contains_any(text, ["dat", "depot a terme"]), "dat")
            .when(contains_any(text, ["maman"]), "femme")
            .when(contains_any(text, ["elenge", "jeunesse"]), "jeunesse")
            .when(contains_any(text, ["likelemba", "tontine"]), "likelemba")
            .when(contains_any(text, ["courant"]), "courant")
            .when(F.length(text) > 0, "autre")
        )

    return let(normalize_label(col), classify)


# Markers of a corporate client type (matched as substrings).
CORPORATE = ("personne morale", "pm", "societe", "pme", "institution", "entreprise")


def is_corporate(col: Column) -> Column:
    return F.coalesce(let(normalize_label(col), lambda text: contains_any(text, CORPORATE)), F.lit(False))


def risk_level(explicit: Column | None, score: Column | None, debt_ratio: Column | None,
               delay: Column | None) -> Column:
    """Explicit level, else score, else debt ratio, else delay; each only where the one before is missing."""
    level = F.when(F.lit(False), F.lit(""))
    if explicit is not None:
        table = F.create_map(*[F.lit(x) for pair in RISK_LEVEL.items() for x in pair])
        given = none_if_blank(explicit)
        level = level.when(given.isNotNull(),
                           F.coalesce(F.try_element_at(table, normalize_label(given)), title(given)))
    if score is not None:
        level = (level.when(score >= 80, "Faible").when(score >= 50, "Moyen")
                 .when(score.isNotNull(), "Élevé"))
    if debt_ratio is not None:
        level = (level.when(debt_ratio <= F.lit(0.30).cast("double"), "Faible")
                 .when(debt_ratio <= F.lit(0.50).cast("double"), "Moyen").when(debt_ratio.isNotNull(), "Élevé"))
    if delay is not None:
        level = level.when(delay <= 0, "Faible").when(delay <= 30, "Moyen").when(delay.isNotNull(), "Élevé")
    return level.otherwise(MISSING)


def age_band(age: Column) -> Column:
    """Fractional ages between two bands stay unclassified, as the bands hold whole years."""
    return (
        F.when((age >= 0) & (age <= 17), "0-17").when((age >= 18) & (age <= 24), "18-24")
        .when((age >= 25) & (age <= 34), "25-34").when((age >= 35) & (age <= 44), "35-44")
        .when((age >= 45) & (age <= 54), "45-54").when((age >= 55) & (age <= 64), "55-64")
        .when(age >= 65, "65+").otherwise(MISSING)
    )


AGE_BANDS = ("0-17", "18-24", "25-34", "35-44", "45-54", "55-64", "65+", MISSING)


def delay_band(delay: Column) -> Column:
    """Count bands; a missing delay counts as up to date."""
    return (
        F.when(F.coalesce(delay, F.lit(-1)) <= 0, "À jour").when(delay <= 7, "1-7 jours")
        .when(delay <= 30, "8-30 jours").when(delay <= 90, "31-90 jours").otherwise("Plus de 90 jours")
    )


DELAY_BANDS = ("À jour", "1-7 jours", "8-30 jours", "31-90 jours", "Plus de 90 jours")


def delay_amount_band(delay: Column) -> Column:
    """Amount bands over right-closed intervals from -1; smaller delays fall outside every band."""
    value = F.coalesce(delay, F.lit(0))
    return (
        F.when(value <= -1, None).when(value <= 0, "À jour").when(value <= 7, "1-7 j").when(value <= 30, "8-30 j")
        .when(value <= 60, "31-60 j").when(value <= 90, "61-90 j").otherwise("90+ j")
    )


DELAY_AMOUNT_BANDS = ("À jour", "1-7 j", "8-30 j", "31-60 j", "61-90 j", "90+ j")


def inactivity_band(days: Column) -> Column:
    return (
        F.when(days.isNull(), "Non documenté").when(days <= 30, "<= 30 j").when(days <= 90, "31-90 j")
        .when(days <= 180, "91-180 j").when(days <= 365, "181-365 j").otherwise("> 365 j")
    )


INACTIVITY_BANDS = ("<= 30 j", "31-90 j", "91-180 j", "181-365 j", "> 365 j", "Non documenté")
PHONE_INTERNATIONAL = "^243[0-9]{9}$"
PHONE_LOCAL = "^0[0-9]{9}$"
PHONE_VALID = "^(243[0-9]{9}|0[0-9]{9})$"


def phone_digits(phone: Column) -> Column:
    return F.regexp_replace(F.coalesce(phone.cast("string"), F.lit("")), "[^0-9]", "")


def phone_quality(phone: Column) -> Column:
    digits = phone_digits(phone)
    return (
        F.when(digits.rlike(PHONE_INTERNATIONAL), "Format international")
        .when(digits.rlike(PHONE_LOCAL), "Format local")
        .when(none_if_blank(phone).isNull(), "Manquant").otherwise("Autre format")
    )


PHONE_QUALITIES = ("Format international", "Format local", "Autre format", "Manquant")

# Report label by normalised product label.
REPORT_PRODUCTS = {
    "compte courant bwakisa carte usd": "Compte courant Bwakisa Carte en USD",
    "compte courant bwakisa carte cdf": "Compte courant Bwakisa Carte en CDF",
    "compte courant ordinaire usd": "Compte courant Ordinaire en USD",
    "compte courant ordinaire cdf": "Compte Courant Ordinaire en CDF",
    "compte epargne ordinaire usd": "Compte Epargne Ordinaire USD",
    "compte epargne ordinaire cdf": "Compte Epargne Ordinaire en CDF",
    "compte epargne ordinaire groupe usd": "Compte Epargne Ordinaire Groupe USD",
    "compte epargne ordinaire groupe cdf": "Compte Epargne Ordinaire Groupe CDF",
    "compte salaire agent miltex usd": "Compte Salaire MILTEX USD",
    "compte courant salaire personnel imf usd": "Compte Courant Salaire Personnel IMF USD",
    "compte courant payroll clientele usd": "Compte Courant Payroll Clientèle USD",
    "depots de garantie solidaire lisungi usd": "Dépôts de garantie solidaire LISUNGI USD",
    "depots de garantie solidaire lisungi cdf": "Dépôts de garantie solidaire LISUNGI CDF",
    "depot de garantie individuelle usd": "Dépôt de garantie Individuelle USD",
    "depots de garantie individuelle usd": "Dépôt de garantie Individuelle USD",
    "depot de garantie individuelle cdf": "Dépôts de garantie Individuelle en CDF",
    "depots de garantie individuelle cdf": "Dépôts de garantie Individuelle en CDF",
    "compte courant pos usd": "Compte POS USD",
    "compte courant pos cdf": "Compte Courant POS CDF",
    "totines usd": "Totines USD",
    "totines cdf": "Totines CDF",
    "compte epargne ordinaire individuelle likelemba usd": "Compte Epargne Ordinaire Individuelle Likelemba USD",
    "compte epargne ordinaire individuelle likelemba cdf": "Compte Epargne Ordinaire Individuelle Likelemba CDF",
}
# Usable share of the deposits of a regulatory family.
USABLE_SHARE = {
    "Compte Courant": 0.3, "Compte Epargne": 0.7, "Bwakisa Carte": 0.0, "Dépôts de garantie": 1.0,
    "Dépôt à Terme": 1.0,
}


def report_product(type_produit: Column, type_client: Column) -> Column:
    product, owner = normalize_label(type_produit), F.coalesce(normalize_label(type_client), F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in REPORT_PRODUCTS.items() for x in pair])
    return (
        F.when(product == "dat", F.when(contains_any(owner, ["morale", "societe"]), "DAT Société").otherwise("DAT Individu"))
        .otherwise(F.coalesce(F.try_element_at(table, product), strip(F.coalesce(type_produit.cast("string"), F.lit("")))))
    )


def regulatory_family(report_label: Column) -> Column:
    def classify(text: Column) -> Column:
        return (
            F.when(F.contains(text, F.lit("bwakisa carte")), "Bwakisa Carte")
            .when(F.contains(text, F.lit("garantie")), "Dépôts de garantie")
            .when(F.startswith(text, F.lit("dat ")), "Dépôt à Terme")
            .when(F.contains(text, F.lit("epargne ordinaire")) | F.startswith(text, F.lit("totines")), "Compte Epargne")
            .otherwise("Compte Courant")
        )

    return let(normalize_label(report_label), classify)


def label_currency(type_produit: Column) -> Column:
    found = F.regexp_extract(type_produit.cast("string"), "\\b(USD|CDF)\\b", 1)
    return F.nullif(found, F.lit(""))


def usable_share(family: Column) -> Column:
    table = F.create_map(*[x for k, v in USABLE_SHARE.items() for x in (F.lit(k), F.lit(v).cast("double"))])
    return F.coalesce(F.try_element_at(table, family), F.lit(0.0))


def order_of(col: Column, labels: tuple[str, ...]) -> Column:
    """Position of a label in a fixed business order; unknown labels come last."""
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), col)
    return F.when(position > 0, position).otherwise(len(labels) + 1).cast("int")
