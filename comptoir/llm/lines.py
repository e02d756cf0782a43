"""Removal of boilerplate lines by the number of sites they stand on.

Every line hash gets a HyperLogLog sketch of its sites; sketches merge by aggregation. Estimates far from the threshold decide; lines near it
get an exact distinct count. All is DataFrame and SQL functions. Lines travel as hashes; texts are shuffled once, when the spread lines
are taken out of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.session import scratch_path

#: log2 of the registers of a sketch; the relative error of an estimate is about 0.83 / sqrt(2^LG_K).
LG_K = 8
#: Estimates within this share of the threshold are counted exactly: four times the relative error.
NEAR = 0.21


def _hashed_lines(df: DataFrame, text: str) -> DataFrame:
    """``df`` with one row for each distinct hash pair of its non-blank lines."""
    hashes = F.transform(F.split(F.col(f"`{text}`"), "\n"), lambda x: F.when(F.trim(x) != "", F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"))))
    return df.withColumn("line", F.explode(F.array_distinct(F.filter(hashes, lambda x: x.isNotNull())))).drop(text)


def spread_lines(df: DataFrame, text: str = "text", site: str = "source", *, min_sites: int = 10) -> DataFrame:
    """Rows (a, b), the hashes of the lines that stand on ``min_sites`` distinct sites or more. Blank lines and null sites do not count."""
    rows = df.select(F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{site}`").cast("string")).alias("site")).filter(F.col("text").isNotNull() & df[site].isNotNull())
    lines = _hashed_lines(rows, "text").select("line.a", "line.b", "site")
    sketched = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    estimated = sketched.select("a", "b", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites * (1 - NEAR))
    path = scratch_path(df.sparkSession, "lines")
    estimated.write.parquet(path)
    judged = df.sparkSession.read.parquet(path)
    near = judged.filter(F.col("sites") <= min_sites * (1 + NEAR)).select("a", "b")
    exact = lines.join(near, ["a", "b"]).distinct().groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites)
    return judged.filter(F.col("sites") > min_sites * (1 + NEAR)).select("a", "b").union(exact.select("a", "b"))


def _keyed(df: DataFrame, text: str) -> tuple[Column, list[Column]]:
    """The text of ``df`` and the columns that stand for it in shuffles: hash and length."""
    value = F.col(f"`{text}`").cast("string")
    return value, [F.xxhash64(value).alias("_spread_k"), F.octet_length(value).alias("_spread_n")]


def _without(df: DataFrame, text: str, gone: DataFrame) -> DataFrame:
    """``df`` without the lines that ``gone`` (_spread_k, _spread_n, _spread_gone) lists for a text."""
    names = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    value, key = _keyed(df, text)
    rows = df.select(*[F.col(f"`{c}`") for c in names], *key).join(gone, ["_spread_k", "_spread_n"], "left")
    split = F.split(value, "\n")
    kept = F.filter(split, lambda x: ~F.array_contains(F.col("_spread_gone"), F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"))) | (F.trim(x) == ""))
    rows = rows.withColumn("_spread_kept", F.when(F.col("_spread_gone").isNotNull(), kept))
    rows = rows.withColumn("_spread_new", F.array_join("_spread_kept", "\n"))
    rows = rows.withColumn("_spread_cut", F.col("_spread_gone").isNotNull())
    return rows.select(
        *[F.when(F.col("_spread_cut"), F.col("_spread_new")).otherwise(value).alias(c) if c == text else F.col(f"`{c}`") for c in names],
        F.when(value.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col("_spread_cut"), F.size(split) - F.size("_spread_kept")).otherwise(0).cast("long").alias("n_removed"))


def remove_spread_lines(df: DataFrame, text: str = "text", site: str = "source", *, min_sites: int = 10) -> DataFrame:
    """``df`` with the spread lines taken out of ``text``, and the columns ``n_lines`` and ``n_removed``. No row goes.

    A line goes from every text that holds it, wherever it stands and however much of the text it is. A text that as a whole stands on ``min_sites`` sites or more is a copied document: it loses only the lines that stand on as many sites
    in texts that are not copied documents, since its copies alone spread the others. Null texts stay null with no lines; empty texts have one blank line. Columns of ``df`` named
    ``n_lines`` and ``n_removed`` are replaced; names that begin with ``_spread_`` are this function's own.
    """
    spark = df.sparkSession
    value, key = _keyed(df, text)
    named = df.select(value.alias("_spread_t"), *key, F.xxhash64(F.col(f"`{site}`").cast("string")).alias("_spread_site"), F.col(f"`{site}`").isNotNull().alias("_spread_sited")).filter("_spread_t IS NOT NULL")
    paths = [scratch_path(spark, name) for name in ("spread", "copied", "shared")]
    spread_lines(df, text, site, min_sites=min_sites).write.parquet(paths[0])
    sites = named.filter("_spread_sited").select("_spread_k", "_spread_n", "_spread_site").distinct().groupBy("_spread_k", "_spread_n").agg(F.count("*").alias("_spread_sites"))
    sites.filter(F.col("_spread_sites") >= min_sites).select("_spread_k", "_spread_n", F.lit(True).alias("_spread_copied")).write.parquet(paths[1])
    spread, copied = (spark.read.parquet(p) for p in paths[:2])
    touched = _hashed_lines(named, "_spread_t").select("_spread_k", "_spread_n", "_spread_site", "_spread_sited", "line.a", "line.b").join(spread, ["a", "b"]).join(copied, ["_spread_k", "_spread_n"], "left")
    elsewhere = touched.filter("_spread_copied IS NULL AND _spread_sited").select("a", "b", "_spread_site").distinct().groupBy("a", "b").agg(F.count("*").alias("_spread_sites"))
    elsewhere.filter(F.col("_spread_sites") >= min_sites).select("a", "b", F.lit(True).alias("_spread_shared")).write.parquet(paths[2])
    lost = touched.join(spark.read.parquet(paths[2]), ["a", "b"], "left").filter("_spread_copied IS NULL OR _spread_shared")
    return _without(df, text, lost.groupBy("_spread_k", "_spread_n").agg(F.collect_set(F.struct("a", "b")).alias("_spread_gone")))
