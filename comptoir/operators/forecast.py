"""Short-horizon forecast of daily series, one per indicator and currency.

A series has one row per day, zero where nothing happened. The level, the weekday pattern and the trend at an origin are
conditional means over the days before it, so the forecast and every origin of the back-test come from one aggregation;
the days ahead are then unfolded from its rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.functions.money import exact_sum, mean, ratio, total
from comptoir.session import cut_lineage

MIN_DAYS = 28
Z = {0.80: 1.2816, 0.95: 1.9600}
SERIES = ("indicateur", "currency_code")


def indicators(journal: DataFrame) -> DataFrame:
    """(indicateur, currency_code, jour, valeur) of the days on which something happened."""
    day = F.to_date("created_at").alias("jour")
    grouped = journal.groupBy("currency_code", day).agg(
        F.count("*").cast("double").alias("operations"), F.count_distinct("customer_id").cast("double").alias("clients_actifs"),
        total("montant_operation").alias("volume"), total("montant_decaisse").alias("decaissements"),
        (exact_sum("remboursement_portefeuille") + exact_sum("remboursement_compte_ouvert")).cast("double").alias("remboursements"))
    names = ["operations", "clients_actifs", "volume", "decaissements", "remboursements"]
    return grouped.unpivot(["currency_code", "jour"], names, "indicateur", "valeur")


def creations(df: DataFrame, date: Column, name: str, amount: str | None = None) -> DataFrame:
    """Number (or amount) of objects created per day and currency."""
    currency = F.col("currency_code") if "currency_code" in df.columns else F.lit("")
    measure = total(amount) if amount else F.count("*").cast("double")
    return df.where(date.isNotNull()).groupBy(currency.alias("currency_code"), F.to_date(date).alias("jour")).agg(measure.alias("valeur")).withColumn(
        "indicateur", F.lit(name))


def daily_series(values: DataFrame, last: dt.date) -> DataFrame:
    """Every day from the first value of a series to ``last``, zero where there is none."""
    known = values.where(F.col("jour") <= F.lit(last))
    spans = known.groupBy("indicateur", "currency_code").agg(F.min("jour").alias("a"))
    days = spans.select("indicateur", "currency_code", F.explode(F.sequence("a", F.lit(last))).alias("jour"))
    return days.join(known, ["indicateur", "currency_code", "jour"], "left").select(
        "indicateur", "currency_code", "jour", F.coalesce("valeur", F.lit(0.0)).alias("valeur"))


def origins(series: DataFrame, folds: int = 1) -> DataFrame:
    """Level, weekday factors and trend of each series at its end (origine 0) and at the ends of ``folds`` back-tests.

    A back-test holds out a quarter of the series, at most 14 days; the second one starts where the first one's held-out days
    would start again, and so on, as long as 14 days are left before it. The level is the mean of the last 28 days, the trend the
    mean of their last 14 against their first 14, at most 1 % of the level a day, the pattern that of the last 56 days.
    """
    spans = series.groupBy(*SERIES).agg(F.min("jour").alias("debut"), F.max("jour").alias("fin"))
    size = F.datediff("fin", "debut") + 1
    held = F.least(F.lit(14), F.floor(size / 4)).cast("int")
    ends = F.filter(F.transform(F.sequence(F.lit(0), F.lit(folds)), lambda k: F.struct(k.alias("origine"), (F.col("n") - k * F.col("retenus")).alias("jusqu"))),
                    lambda o: (o["origine"] == 0) | (o["jusqu"] >= 14))
    at = spans.withColumns({"n": size, "retenus": held}).select(*SERIES, "debut", "fin", "n", "retenus", F.inline(ends))
    place, upto = F.datediff("jour", "debut") + 1, F.col("jusqu")
    days = series.join(at, list(SERIES)).withColumns({"place": place, "premier": F.greatest(upto - 28, F.lit(0))}).where((F.col("place") <= upto) & (F.col("place") > upto - 56))
    place = F.col("place")
    weekday = [mean("valeur", F.weekday("jour") == d).alias(f"j{d}") for d in range(7)]
    means = days.groupBy(*SERIES, "debut", "fin", "n", "retenus", "origine", "jusqu").agg(
        mean("valeur", place > upto - 28).alias("niveau"), mean("valeur").alias("fond"), mean("valeur", place > upto - 14).alias("tard"),
        mean("valeur", (place > F.col("premier")) & (place <= F.col("premier") + 14)).alias("tot"), *weekday)
    base = F.when(F.col("fond") == 0, 1.0).otherwise(F.col("fond"))
    factors = F.array(*[F.coalesce(F.least(F.greatest(F.col(f"j{d}") / base, F.lit(0.25)), F.lit(4.0)), F.lit(1.0)) for d in range(7)])
    trend = F.least(F.greatest((F.col("tard") - F.col("tot")) / 14, F.lit(-0.01) * F.col("niveau")), F.lit(0.01) * F.col("niveau"))
    return means.select(*SERIES, "debut", "fin", "n", "retenus", "origine", "jusqu", "niveau", factors.alias("facteurs"), trend.alias("tendance"))


def project(at: DataFrame, steps: Column) -> DataFrame:
    """The ``steps`` days after each origin, with their forecast; the trend stops growing after 14 days."""
    ahead = at.withColumn("pas", F.explode(F.sequence(F.lit(1), steps))).withColumn("date", F.expr("date_add(debut, jusqu - 1 + pas)"))
    value = (F.col("niveau") + F.col("tendance") * F.least("pas", F.lit(14))) * F.element_at("facteurs", F.weekday("date") + 1)
    return ahead.withColumn("prevision", F.when(F.col("niveau") > 0, F.greatest(value, F.lit(0.0))).otherwise(0.0))


def _added(values: Column) -> Column:
    """Sum in the order of the list, so that it comes out the same every time."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def backtest(series: DataFrame, folds: int = 1) -> DataFrame:
    """(series, jours, mae, wape_pct, rmse): errors over the held-out days of all origins."""
    tested = project(origins(series, folds).where("origine > 0"), F.col("retenus"))
    errors = tested.join(series.withColumnRenamed("jour", "date"), [*SERIES, "date"]).select(
        *SERIES, "origine", "pas", "valeur", (F.col("valeur") - F.col("prevision")).alias("ecart"))
    listed = F.array_sort(F.collect_list(F.struct("origine", "pas", "ecart")))
    grouped = errors.groupBy(*SERIES).agg(listed.alias("e"), total(F.abs("valeur")).alias("observe"), F.count("*").alias("jours"))
    whole = _added(F.transform("e", lambda x: F.abs(x["ecart"])))
    squares = _added(F.transform("e", lambda x: x["ecart"] * x["ecart"]))
    return grouped.select(*SERIES, "jours", (whole / F.col("jours")).alias("mae"), (ratio(whole, F.col("observe")) * 100).alias("wape_pct"),
                          F.sqrt(squares / F.col("jours")).alias("rmse"))


def forecast(series: DataFrame, horizon: int = 30, confidence: float = 0.80, folds: int = 1) -> DataFrame:
    """Daily forecast with its band and back-test; one line "Historique insuffisant" for a series of less than 28 days."""
    if confidence not in Z:
        raise ValueError("confidence must be 0.80 or 0.95")
    series = cut_lineage(series)  # a row a day, read several times
    long_enough = F.col("n") >= MIN_DAYS
    ahead = project(origins(series, 0), F.when(long_enough, horizon).otherwise(1)).join(backtest(series, folds), list(SERIES), "left")
    spread = F.lit(Z[confidence]) * F.col("rmse")
    quality = F.when(F.col("wape_pct") <= 20, "Bonne").when(F.col("wape_pct") <= 40, "Acceptable").otherwise("Prudence")
    known = {"prevision": F.col("prevision"), "borne_basse": F.greatest(F.col("prevision") - spread, F.lit(0.0)), "borne_haute": F.col("prevision") + spread,
             "mae": F.col("mae"), "wape_pct": F.col("wape_pct"), "qualite": quality}
    status = F.when(long_enough, "Calculee").otherwise("Historique insuffisant")
    return ahead.select(*SERIES, "date", *[F.when(long_enough, c).alias(n) for n, c in known.items()], status.alias("statut"))


def forecast_summary(predicted: DataFrame) -> DataFrame:
    """Sum over the horizon (mean for active clients) with the quality of each series."""
    done = predicted.where(F.col("statut") == "Calculee")
    sums = done.groupBy("indicateur", "currency_code").agg(
        total("prevision").alias("s"), F.count("*").alias("jours"), F.max("mae").alias("mae"), F.max("wape_pct").alias("wape_pct"), F.max("qualite").alias("qualite"))
    value = F.when(F.col("indicateur") == "clients_actifs", ratio(F.col("s"), F.col("jours"))).otherwise(F.col("s"))
    return sums.select("indicateur", "currency_code", value.alias("valeur_prevue_horizon"), "mae", "wape_pct", "qualite")


def sources(journal: DataFrame, created: Mapping[str, tuple[DataFrame, Column, str | None]]) -> DataFrame:
    """Journal indicators together with creation counts of other sources."""
    out = indicators(journal).select("indicateur", "currency_code", "jour", "valeur")
    for name, (df, date, amount) in created.items():
        out = out.unionByName(creations(df, date, name, amount).select("indicateur", "currency_code", "jour", "valeur"))
    return out


