"""File jobs: flexible CSV scan, multi-file loads with provenance, header promotion, snapshots, exports."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from comptoir.functions.text import none_if_blank, strip
from comptoir.sources.contracts import Contract, coalesce_named, header_key, normalize_headers, validate
from comptoir.sources.records import fields, read_lines, records, transitions

ENCODINGS = ("utf-8", "iso-8859-1")  # the second one reads any byte


class LoadError(ValueError):
    """A file is empty or cannot be read."""


def detect_separator(first_line: str) -> str:
    """Semicolon or tab when they lead the first line, else the most frequent of comma and bar."""
    semicolons, commas, tabs, bars = (first_line.count(c) for c in ";,\t|")
    if semicolons and semicolons >= commas and semicolons >= tabs:
        return ";"
    if tabs > commas:
        return "\t"
    return "|" if bars > commas else ","


def _plain(path: str) -> str:
    """A path without scheme, host and escapes, to recognise a file by what Spark calls it."""
    return "/" + unquote(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)).strip("/") if ":" in path else "/" + path.strip("/")


def sniff(spark: SparkSession, paths: Sequence[str], encoding: str | None = None) -> list[dict]:
    """For each file under ``paths``: its path, encoding, separator, first line, and whether a quoted field goes over a line's end.

    One pass over all files, one row a file to the driver: what is needed to choose their readers.
    """
    lines = read_lines(spark, paths)
    at = F.struct("__block", "__line")
    opens = {sep: transitions(F.col("value"), sep)[0] for sep in ";,\t|"}
    quoted = F.contains(F.col("value"), F.lit('"'))
    found = lines.groupBy("__file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.min_by(F.col("value").cast("binary"), F.when(F.col("value") != "", at)).alias("first"),
        F.struct(*[F.bool_or(quoted & o).alias(f"o{i}") for i, o in enumerate(opens.values())]).alias("open")).collect()
    out = []
    for row in found:
        used = encoding or ENCODINGS[0 if row["utf8"] else 1]
        first = bytes(row["first"] or b"").decode(used, "replace").lstrip("\ufeff").rstrip("\r")
        separator = detect_separator(first)
        out.append({"path": row["__file"], "encoding": used, "separator": separator, "first": first, "open": row["open"][list(opens).index(separator)]})
    return out


def _table(spark: SparkSession, paths: Sequence[str], encoding: str, separator: str, broken: bool, file_column: str | None = None) -> DataFrame:
    """Files of one header, encoding and separator as a table of text columns."""
    if not broken:
        df = spark.read.csv(list(paths), sep=separator, header=True, encoding=encoding, escape='"')
        names = [c.replace("\ufeff", "").strip() for c in df.columns]
        return df.toDF(*names) if file_column is None else df.select("*", F.col("_metadata.file_path").alias(file_column)).toDF(*names, file_column)
    cut = records(read_lines(spark, paths, encoding), separator).where("value <> ''")
    at = F.struct("__block", "__line")
    heads = cut.groupBy("__file").agg(F.min(at).alias("__head"), F.min_by("value", at).alias("__names"))
    header = heads.agg(F.min("__names")).first()[0]
    width = len(header.split(separator))
    head = spark.range(1).select(fields(F.lit(header), [str(i) for i in range(width)], separator).alias("h")).select("h.*").first()
    names = [v for v in head if v is not None] if head else []
    body = cut.join(heads.select("__file", "__head"), "__file").where(at > F.col("__head"))
    rows = body.select(fields(F.col("value"), names, separator).alias("__row"), F.col("__file").alias(file_column or "__file")).select("__row.*", *([file_column] if file_column else []))
    return rows.toDF(*[n.strip() for n in names], *([file_column] if file_column else []))


def read_csv(spark: SparkSession, path: str, rules: Contract | None = None, reject_empty: bool = False,
             encoding: str | None = None) -> DataFrame:
    """CSV scan with detected separator; without ``encoding``, UTF-8 if all lines are valid, else Latin-1.

    Files stay splittable. Where a quoted field goes over a line's end, records are cut by ``records``, else by Spark's reader.
    """
    found = sniff(spark, [path], encoding)
    if not any(f["first"] for f in found):
        raise LoadError(f"{path}: the file is empty")
    used = ENCODINGS[1] if any(f["encoding"] == ENCODINGS[1] for f in found) and encoding is None else found[0]["encoding"]
    first = min((f for f in found if f["first"]), key=lambda f: f["path"])
    df = _table(spark, [path], used, first["separator"], any(f["open"] for f in found))
    if reject_empty and df.isEmpty():
        raise LoadError(f"{path}: the file holds no data row")
    if rules is None:
        return df
    return validate(normalize_headers(df, rules), rules, path)


def read_parquet(spark: SparkSession, path: str, rules: Contract | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return validate(normalize_headers(df, rules), rules, path) if rules else df


def read_many(spark: SparkSession, paths: Sequence[str], source_column: str = "fichier_source", order_column: str | None = "ordre_fichier_import",
              rules: Contract | None = None) -> list[tuple[list[str], DataFrame]]:
    """The files (or folders of files) of each header as one table, with the name of a file and its place among ``paths``.

    Files are sniffed in one pass; jobs and plans then grow with the number of different headers, not of files. Gives (columns of the
    header, table) for each.
    """
    if not paths:
        raise LoadError("no file was given")
    known = {_plain(p): i for i, p in enumerate(paths)}
    groups: dict[tuple, list[tuple[str, int]]] = {}
    filled = set()
    for file in sniff(spark, paths):
        plain = _plain(file["path"])
        order = next((known[p] for p in _above(plain) if p in known), None)
        if order is None:
            raise LoadError(f"{file['path']} was not asked for")
        if file["first"]:
            filled.add(order)
            groups.setdefault((file["first"], file["encoding"], file["separator"], file["open"]), []).append((file["path"], order))
    for i, path in enumerate(paths):
        if i not in filled:
            raise LoadError(f"{path}: the file is empty")
    out = []
    for (_, encoding, separator, broken), files in sorted(groups.items()):
        df = _table(spark, [unquote(f) if "%" in f else f for f, _ in files], encoding, separator, broken, "__path")
        if rules is not None:
            df = validate(normalize_headers(df, rules), rules, ", ".join(sorted({paths[i] for _, i in files})[:3]))
        columns = [c for c in df.columns if c != "__path"]
        names = spark.createDataFrame([(f, paths[i].rstrip("/").rsplit("/", 1)[-1], i) for f, i in files], "__path string, __name string, __order int")
        placed = df.join(names, "__path").withColumns({source_column: F.col("__name")} | ({order_column: F.col("__order")} if order_column else {}))
        out.append((columns, placed.drop("__path", "__name", "__order")))
    return out


def _above(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(len(parts), 0, -1)]


def load_files(spark: SparkSession, paths: Sequence[str], source_column: str = "fichier_source",
               order_column: str = "ordre_fichier_import", rules: Contract | None = None) -> DataFrame:
    """Union of several files that may differ in columns, with file name and import order."""
    out = None
    for _, part in read_many(spark, paths, source_column, order_column, rules):
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def compile_files(spark: SparkSession, paths: Sequence[str], common_only: bool = False, source_column: str | None = None) -> DataFrame:
    """Stack files of the same columns (or of their common columns), optionally with their name."""
    tables = read_many(spark, paths, "__source", None)
    shared = set(tables[0][0])
    for columns, _ in tables[1:]:
        if common_only:
            shared &= set(columns)
        elif set(columns) != shared:
            raise ValueError("the files differ in columns; use common_only")
    if not shared:
        raise ValueError("the files have no column in common")
    label, n = source_column, 2
    while label in shared:
        label, n = f"{source_column}_fusion_{n}", n + 1
    out = None
    for _, df in tables:
        part = df.select(*sorted(shared), *([F.col("__source").alias(label)] if label else []))
        out = part if out is None else out.unionByName(part)
    return out


def compile_standardized_files(spark: SparkSession, paths: Sequence[str], source_column: str | None = "Provenance") -> DataFrame:
    """Stack files after standardising headers; ``nom_01``, ``nom_02`` fall back into ``nom``."""
    out = None
    for _, df in read_many(spark, paths, "__source", None):
        part = _standardized(df, keep="__source")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    data = [c for c in out.columns if c != "__source"]
    out = out.dropna(how="all", subset=data)
    return out.withColumnRenamed("__source", source_column) if source_column else out.drop("__source")


def compile_homogeneous(tables: Mapping[str, DataFrame], common_only: bool = False,
                        source_column: str | None = None) -> DataFrame:
    """Stack tables of the same columns (or of their common columns), optionally with their name."""
    if not tables:
        raise LoadError("no table was given")
    frames = list(tables.values())
    shared = set(frames[0].columns)
    for df in frames[1:]:
        if common_only:
            shared &= set(df.columns)
        elif set(df.columns) != shared:
            raise ValueError("the tables differ in columns; use common_only")
    if not shared:
        raise ValueError("the tables have no column in common")
    columns = sorted(shared)
    out = None
    for name, df in tables.items():
        part = df.select(*columns)
        if source_column:
            label, n = source_column, 2
            while label in columns:
                label, n = f"{source_column}_fusion_{n}", n + 1
            part = part.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def merge_base_and_compiled(base: DataFrame | None, compiled: DataFrame | None) -> DataFrame:
    """Union of a cleaned base and a compiled one; either alone is returned as it is."""
    present = [df for df in (base, compiled) if df is not None]
    if not present:
        raise LoadError("neither table was given")
    return present[0] if len(present) == 1 else present[0].unionByName(present[1], allowMissingColumns=True)


def standard_header(name: str) -> str:
    """First letter capital, words joined by underscores, no accents."""
    key = header_key(name)
    return key[:1].upper() + key[1:]


def files_presence(spark: SparkSession, paths: Sequence[str], absent: str = "-") -> DataFrame:
    """Which file has which column: one row per column name, one column per file, from the headers alone."""
    return column_presence({p.rstrip("/").rsplit("/", 1)[-1]: df for p, df in _headers(spark, paths).items()}, absent)


def _headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, DataFrame]:
    known = {_plain(p): p for p in paths}
    found: dict[str, DataFrame] = {}
    for file in sniff(spark, paths):
        path = next((known[p] for p in _above(_plain(file["path"])) if p in known), None)
        if path is not None and path not in found and file["first"]:
            width = len(file["first"].split(file["separator"]))
            row = spark.range(1).select(fields(F.lit(file["first"]), [str(i) for i in range(width)], file["separator"]).alias("h")).select("h.*").first()
            found[path] = spark.createDataFrame([], ", ".join(f"`{n.strip()}` string" for n in row if n))
    return {p: found[p] for p in paths if p in found}


def _standardized(df: DataFrame, keep: str | None = None) -> DataFrame:
    headers = [c if c == keep else standard_header(c) for c in df.columns]
    bases = [m.group(1) if (m := re.match(r"^(.+)_\d{2,}$", h)) and m.group(1) in headers else h for h in headers]
    return coalesce_named(df, bases)


def compile_standardized(tables: Mapping[str, DataFrame], source_column: str | None = "Provenance") -> DataFrame:
    """Stack tables after standardising headers; ``nom_01``, ``nom_02`` fall back into ``nom``."""
    out = None
    for name, df in tables.items():
        part = _standardized(df)
        if source_column:
            part = part.withColumn(source_column, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    data = [c for c in out.columns if c != source_column]
    return out.dropna(how="all", subset=data)


def column_presence(tables: Mapping[str, DataFrame], absent: str = "-") -> DataFrame:
    """Which table has which column: one row per column name, one column per table."""
    spark = next(iter(tables.values())).sparkSession
    pairs = spark.createDataFrame([(t, c) for t, df in tables.items() for c in df.columns], "t string, c string")
    wide = pairs.groupBy(F.col("c").alias("Colonne")).pivot("t", list(tables)).agg(F.first("c"))
    return wide.select("Colonne", *[F.coalesce(F.col(f"`{t}`"), F.lit(absent)).alias(t) for t in tables])


def promote_header(spark: SparkSession, path: str | Sequence[str], first_field: str = "Receipt No.", separator: str = ",",
                   source_column: str = "fichier_source") -> DataFrame:
    """Statements whose real header comes after descriptive lines, found separately in each file.

    The header is the first line of a file that starts with ``first_field``; later lines like it are left out, as are blank ones. Every
    other line after it is a row; missing trailing fields are null. Files stay splittable, those whose quoted fields go over line ends too
    (see ``records``). Different headers are collected, since they decide the columns; their number is that of the layouts, not of the files.
    """
    lines = read_lines(spark, path).withColumnRenamed("__name", source_column)
    at, stripped = F.struct("__block", "__line"), strip(F.col("value"))
    is_header = F.startswith(F.replace(stripped, F.lit('"'), F.lit("")), F.lit(first_field))
    place = F.when(is_header, at)
    files = lines.groupBy("__file").agg(F.min_by(stripped, place).alias("__header"), F.min(place).alias("__from")).where("__from IS NOT NULL")
    below = lines.join(files, "__file").where(at > F.col("__from")).drop("__from")
    opens = transitions(F.col("value"), separator)[0]
    broken = below.groupBy("__file").agg(F.bool_or(opens).alias("__open"))
    variants = files.join(broken, "__file", "left").groupBy("__header").agg(F.bool_or("__open").alias("open")).collect()
    if not variants:
        raise LoadError(f"{path}: no line starts with {first_field!r}")
    body = below
    if any(v["open"] for v in variants):
        marked = below.join(broken, "__file")
        body = marked.where("NOT __open").drop("__open").unionByName(records(marked.where("__open").drop("__open"), separator))
    rows = body.where(~is_header & (stripped != ""))
    out = None
    for variant in sorted(v["__header"] for v in variants):
        names = [n.strip().strip('"') for n in variant.split(separator)]
        part = rows.where(F.col("__header") == variant).select(fields(F.col("value"), names, separator).alias("__fields"), source_column).select("__fields.*", source_column)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def with_lineage(df: DataFrame, row_numbers: bool = False, first: int = 2) -> DataFrame:
    """Source file of each row of a file read as it is and, on request, the row's line in its file; the line after a header is ``first``.

    Rows are numbered inside their blocks in parallel; only the blocks' counts meet, to give each block the number of rows before it.
    """
    out = df.withColumn("source_fichier", F.col("_metadata.file_name"))
    if not row_numbers:
        return out
    block = ["__file", "bloc_source"]
    out = out.withColumns({"__file": F.col("_metadata.file_path"), "bloc_source": F.col("_metadata.file_block_start")}).withColumn("__id", F.monotonically_increasing_id())
    before = F.sum("n").over(Window.partitionBy("__file").orderBy("bloc_source").rowsBetween(Window.unboundedPreceding, -1))
    blocks = out.groupBy(*block).agg(F.min("__id").alias("first"), F.count("*").alias("n")).select(*block, (F.coalesce(before, F.lit(0)) - F.col("first") + first).alias("__shift"))
    return out.join(blocks, block).withColumn("ligne_source", F.col("__id") + F.col("__shift")).drop("__file", "__id", "__shift")


SNAPSHOT_PATTERNS = (
    ("(20[0-9]{2})[-_]([0-9]{2})[-_]([0-9]{2})", (1, 2, 3)),
    ("([0-9]{2})[-_]([0-9]{2})[-_](20[0-9]{2})", (3, 2, 1)),
)


def snapshot_date(file_name: Column) -> Column:
    """Date written in a file name, ISO order first, then day-month-year; null when there is none."""
    dates = []
    for pattern, (y, m, d) in SNAPSHOT_PATTERNS:
        text = F.concat_ws("-", *[F.regexp_extract(file_name, pattern, i) for i in (y, m, d)])
        dates.append(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))
    return F.coalesce(*dates)


def fill_snapshot_date(df: DataFrame, file_column: str, date_column: str = "date_operation") -> DataFrame:
    if date_column in df.columns:
        return df
    return df.withColumn(date_column, snapshot_date(F.col(file_column)))


def snapshot_bundles(df: DataFrame, file_column: str = "fichier_source", label: str = "type_produit") -> DataFrame:
    """Attach to each row its bundle (snapshot date, else file) and the currency most of its file's labels name."""
    text = F.upper(F.col(label).cast("string"))
    votes = df.groupBy(file_column).agg(
        F.count(F.when(F.contains(text, F.lit("CDF")), 1)).alias("cdf"), F.count(F.when(F.contains(text, F.lit("USD")), 1)).alias("usd"))
    currency = F.when(F.col("cdf") > F.col("usd"), "CDF").otherwise("USD")
    files = votes.select(file_column, currency.alias("__currency"), snapshot_date(F.col(file_column)).alias("bundle_date"))
    joined = df.join(files, file_column)
    stem = F.regexp_replace(file_column, "\\.[^.]*$", "")
    own = none_if_blank(F.col("source_currency")) if "source_currency" in df.columns else F.lit(None).cast("string")
    return joined.withColumns({
        "source_currency": F.coalesce(own, "__currency"),
        "bundle_key": F.coalesce(F.date_format("bundle_date", "yyyy-MM-dd"), stem)}).drop("__currency")


def read_period(spark: SparkSession, path: str, date_column: str, start: str, end: str, columns: Sequence[str]) -> DataFrame:
    """Fact rows of a period and only the wanted columns; both reach the Parquet scan."""
    date = F.col(date_column)
    return spark.read.parquet(path).where((date >= F.lit(start).cast("timestamp_ntz")) & (date < F.lit(end).cast("timestamp_ntz"))).select(*columns)


def export_partitioned(df: DataFrame, path: str, split_column: str | None = None, fmt: str = "csv",
                       drop_empty_columns: bool = False) -> DataFrame:
    """Write one folder per value of the split column. Large values spread over many files, never one task."""
    out = df
    if drop_empty_columns:
        filled = df.agg(*[F.count(f"`{c}`").alias(c) for c in df.columns]).first()
        out = df.select(*[c for c in df.columns if filled[c] or c == split_column])
    writer = out.write.mode("error").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if split_column:
        writer = writer.partitionBy(split_column)
    writer.save(path)
    return out


def load_report(sources: Mapping[str, tuple[DataFrame, str | None]], missing: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows, files and missing columns per source."""
    out = None
    for name, (df, file_column) in sources.items():
        files = F.count_distinct(file_column) if file_column and file_column in df.columns else F.lit(1).cast("bigint")
        gone = ", ".join((missing or {}).get(name, ()))
        part = df.agg(F.lit(name).alias("source"), F.count("*").alias("lignes"), files.alias("fichiers"),
                      F.lit(gone).alias("colonnes_manquantes"))
        out = part if out is None else out.unionByName(part)
    return out
