"""Records of delimited text whose quoted fields may hold line breaks, cut in parallel.

A quote opens a field only at the field's start. Inside, two quotes stand for one, a quote before a separator or a line's end closes the
field, and any other quote is text. So what a line does to the reader is a function of one bit, whether a field is open when the line
starts: it leaves the bit alone, sets it, clears it or turns it. Every line's function is known without the lines before it. Inside a
split the functions are composed by running counts; the splits' own functions are composed in the files' order, one row a split, and
give each split its first bit. Then every line knows whether it starts a record.

A field that is still open at the end of its file was not opened in earnest: the lines from there on are records of their own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths: str | Sequence[str], encoding: str = "utf-8") -> DataFrame:
    """(value, __file, __name, __block, __line): lines without their end, which is LF or CRLF, and where they stand; a mark of byte order is taken off."""
    lines = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths)).select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_name").alias("__name"), F.col("_metadata.file_block_start").alias("__block"))
    value = F.decode(F.col("value").cast("binary"), encoding) if encoding != "utf-8" else F.col("value")
    return lines.withColumn("__line", F.monotonically_increasing_id()).withColumn("value", F.when(F.startswith(value, F.lit("\ufeff")), F.substring(value, 2, 2147483647)).otherwise(value))


def transitions(line: Column, separator: str) -> tuple[Column, Column]:
    """Whether a field is open after the line, if none was open before it, and if one was."""
    sep, end = re.escape(separator), r"(?=\r?\z)"
    text = rf'(?:[^"]++|""|"(?!{sep}|\r?\z))*+'
    field = rf'(?:"{text}"|[^"{sep}][^{sep}]*+)?+'
    opens = rf'(?:{field}{sep})*+"{text}\z'
    quoted = F.contains(line, F.lit('"'))
    return quoted & line.rlike(rf"\A{opens}"), ~quoted | line.rlike(rf'\A{text}(?:\z|"{sep}{opens})') & ~line.rlike(rf'\A{text}"{end}')


def _follow(known: Column, turns: Column, first: Column) -> Column:
    """The bit after a run of lines: that of the last line that decides it, turned as often as lines turn it since; else the first bit, turned."""
    return F.when(known.isNotNull(), known["bit"] + turns - known["turns"]).otherwise(first + turns) % 2


def records(lines: DataFrame, separator: str) -> DataFrame:
    """The ``lines`` (as of ``read_lines``, other columns the same for all lines of a file) with those of one record joined by line breaks.

    A record keeps the place of its first line. Only the lines of files passed in are read as a whole; a record is one row.
    """
    place, split = ["__file", "__block"], Window.partitionBy("__file", "__block").orderBy("__line")
    others = [c for c in lines.columns if c not in ("value", "__file", "__block", "__line")]
    opens, stays = transitions(F.col("value"), separator)
    marked = lines.withColumns({"__opens": opens, "__stays": stays}).withColumn("__turn", (F.col("__opens") & ~F.col("__stays")).cast("long"))
    earlier = split.rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("__turns", F.coalesce(F.sum("__turn").over(earlier), F.lit(0)))
    decided = F.when(F.col("__opens") == F.col("__stays"), F.struct(F.col("__opens").cast("long").alias("bit"), F.col("__turns").alias("turns")))
    marked = marked.withColumn("__known", F.last(decided, ignorenulls=True).over(earlier))

    splits = marked.groupBy(*place).agg(F.sum("__turn").alias("turns"), F.max_by(decided, F.when(decided.isNotNull(), F.col("__line"))).alias("known"))
    files = Window.partitionBy("__file").orderBy("__block")
    before = files.rowsBetween(Window.unboundedPreceding, -1)
    summed = splits.withColumn("upto", F.sum("turns").over(files)).withColumn("prior", F.coalesce(F.sum("turns").over(before), F.lit(0)))
    final = F.when(F.col("known").isNotNull(), F.struct(((F.col("known.bit") + F.col("turns") - F.col("known.turns")) % 2).alias("bit"), F.col("upto").alias("turns")))
    entry = summed.withColumn("last", F.last(final, ignorenulls=True).over(before)).select(*place, _follow(F.col("last"), F.col("prior"), F.lit(0)).alias("__entry"))

    seen = marked.join(entry, place).withColumn("__open", _follow(F.col("__known"), F.col("__turns"), F.col("__entry")) == 1)
    seen = seen.withColumns({"__starts": (~F.col("__open")).cast("long"), "__ends": ~F.when(F.col("__open"), F.col("__stays")).otherwise(F.col("__opens"))})
    seen = seen.select("value", "__file", "__block", "__line", *others, "__open", "__ends", "__starts", F.sum("__starts").over(split).alias("__number"))
    whole = seen.where(~F.col("__open") & F.col("__ends"))

    # A line that goes on from an earlier split belongs to the last record that started before this one.
    started = seen.groupBy(*place).agg(F.sum("__starts").alias("n"))
    carried = started.select(*place, F.last(F.when(F.col("n") > 0, F.struct("__block", "n")), ignorenulls=True).over(before).alias("__carry"))
    broken = seen.where(F.col("__open") | ~F.col("__ends")).join(carried, place)
    here = F.col("__number") > 0
    broken = broken.withColumns({"__first": F.when(here, F.col("__block")).otherwise(F.col("__carry.__block")), "__record": F.when(here, F.col("__number")).otherwise(F.col("__carry.n"))})
    parts = F.array_sort(F.collect_list(F.struct("__block", "__line", "value", "__ends")))
    joined = broken.groupBy("__file", *others, "__first", "__record").agg(parts.alias("p"))
    closed = F.element_at("p", -1)["__ends"]
    text = F.array_join(F.transform("p", lambda x: x["value"]), "\n")
    one = F.array(F.struct(F.col("p")[0]["__block"].alias("__block"), F.col("p")[0]["__line"].alias("__line"), text.alias("value")))
    each = F.transform("p", lambda x: F.struct(x["__block"].alias("__block"), x["__line"].alias("__line"), x["value"].alias("value")))
    mended = joined.select("__file", *others, F.inline(F.when(closed, one).otherwise(each)))
    out = whole.select("value", "__file", "__block", "__line", *others).unionByName(mended)
    return out.withColumn("value", F.regexp_replace("value", r"\r\z", ""))


def fields(record: Column, names: Sequence[str], separator: str) -> Column:
    """The fields of a record as text, under ``names``; those it lacks are null."""
    quoted = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return F.from_csv(record, quoted, {"sep": separator, "escape": '"', "multiLine": "true"})
