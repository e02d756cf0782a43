"""A corpus pipeline of five stages over ``documents``: quality, boilerplate lines, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes each result as Parquet into the shared
folder and reads it again. Null texts and null ids go through every stage; each operator's docstring says what it does with them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from comptoir.llm import jaccard, lines, quality, tiling, tokenizer
from comptoir.session import cut_lineage, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the rated ones of the input, selects; all without ratings of two grades."""
    model = quality.fit(docs, quality.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.select(docs, model).select(*COLUMNS)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on many sites, however much of a text they are; ``n_chars`` follows the text."""
    return _sized(lines.remove_spread_lines(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates: that with the least id, null being the last, and of those the least by hash of its text.

    A row is judged by its own group, also where another row has its id. Rows without words are like no other and stay.
    """
    row = {"_row": F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"), "_size": F.octet_length("text")}
    told = cut_lineage(jaccard.near_duplicates(docs.select("doc_id", "text").withColumns(row), key_column="_group").select("doc_id", "_row", "_size", "_group"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row", "_size")).alias("f")
    kept = told.filter("_group IS NOT NULL").groupBy("_group").agg(first).select("f._row", "f._size")
    worded = told.filter("_group IS NOT NULL").select("_row", "_size").distinct().withColumn("_words", F.lit(True))
    marked = worded.join(kept.withColumn("_kept", F.lit(True)), ["_row", "_size"], "left")
    rows = docs.select(*COLUMNS).withColumns(row).join(marked, ["_row", "_size"], "left").filter("_words IS NULL OR _kept")
    order = Window.partitionBy("_row", "_size").orderBy("lang", "source", "n_chars")
    one = rows.filter("_words").withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return one.select(*COLUMNS).unionAll(rows.filter("_words IS NULL").select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    found = tiling.with_matches(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("matches") == 0).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, whose number and whose decoded text's hash come along."""
    coded = tokenizer.encode(docs.select(*COLUMNS), vocabulary=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", select_quality),
    ("line dedup", remove_boilerplate),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", tokenize),
]

#: The stages' model, components and merges have no SQL; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
