"""Row numbers, running sums and quantiles whose groups may be far larger than one task.

A plain window puts a whole group into one task. Here the rows are range-partitioned on (group, order), so a
large group is spread over many partitions; each partition is scanned once, and the counts and sums of the
partitions before it are added. The partitioned rows are written to the checkpoint folder first, because the
same partition numbers must be seen by both reads, also after an executor is lost.

The order columns must end in a unique key, otherwise equal rows cannot be split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comptoir.functions.money import parts, whole_amount
from comptoir.session import cut_lineage

SLICE = "__slice"


def match_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null keys match each other; the right-hand keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on])
    return left.join(renamed, condition, how).drop(*[f"__r_{c}" for c in on])


def join_known(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join with at most one right-hand row per key.

    Left rows lacking a key match nothing; they are dealt out by their other values instead of meeting in one task. The right-hand side is
    hashed, so the many rows of the left are not sorted.
    """
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    dealt = left.withColumn("__dealt", F.when(known, 0).otherwise(1 + F.pmod(F.xxhash64(*left.columns), F.lit(1 << 15)).cast("int")))
    # Always 0, but not a constant: the optimizer would take that out of the join keys.
    partners = right.withColumn("__dealt", F.pmod(F.xxhash64(*on), F.lit(1)).cast("int"))
    return dealt.join(partners.hint("shuffle_hash"), [*on, "__dealt"], "left").drop("__dealt")


def partition_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def accumulate(df: DataFrame, by: Sequence[str], order: Sequence[Column], row_number: str | None = None,
               sums: Mapping[str, Column] | None = None, amounts: Mapping[str, Column] | None = None,
               ordered_by: Sequence[str] | None = None) -> DataFrame:
    """Add the row number and inclusive running sums of each group, in the given order.

    ``sums`` are running sums of numbers, ``amounts`` exact running sums of money. For wide rows ``ordered_by`` names the columns the
    order is made of: then only they and what is summed are partitioned and written, and the results join the rows at the end.
    """
    if ordered_by is not None:
        keys = list(dict.fromkeys([*by, *ordered_by]))
        given = {**{f"__m{i}": c for i, c in enumerate((sums or {}).values())}, **{f"__a{i}": c for i, c in enumerate((amounts or {}).values())}}
        narrow = accumulate(
            df.select(*keys, *[c.alias(n) for n, c in given.items()]), by, order, row_number,
            {n: F.col(f"__m{i}") for i, n in enumerate(sums or {})}, {n: F.col(f"__a{i}") for i, n in enumerate(amounts or {})}).drop(*given)
        return match_null_safe(df, narrow, keys, "inner")
    sums = dict(sums or {})
    halves = {}
    for name, value in (amounts or {}).items():
        sums[f"__w_{name}"], sums[f"__f_{name}"] = parts(value)
        halves[name] = (f"__w_{name}", f"__f_{name}")
    values = {f"__v{i}": value for i, value in enumerate(sums.values())}
    keyed = df.withColumns({"__one": F.lit(1).cast("bigint"), **values}) if values else \
        df.withColumn("__one", F.lit(1).cast("bigint"))
    measured = ["__one", *values]
    spread = keyed.repartitionByRange(partition_count(df), *[F.col(c) for c in by], *order)
    spread = cut_lineage(spread.withColumn(SLICE, F.spark_partition_id()))

    per_slice = spread.groupBy(SLICE, *by).agg(*[F.sum(m).alias(f"__s{m}") for m in measured])
    before = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(SLICE, *by, *[F.sum(f"__s{m}").over(before).alias(f"__o{m}") for m in measured])

    inside = Window.partitionBy(SLICE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = spread.withColumns({f"__c{m}": F.sum(m).over(inside) for m in measured})
    joined = match_null_safe(local, offsets, [SLICE, *by], "inner")

    def whole(m: str) -> Column:
        zero = F.lit(0)
        return F.coalesce(F.col(f"__c{m}"), zero) + F.coalesce(F.col(f"__o{m}"), zero)

    added = {name: whole(m) for name, m in zip(sums, values)}
    if row_number:
        added[row_number] = whole("__one")
    result = joined.select(*df.columns, *[c.alias(n) for n, c in added.items()])
    whole_sums = {name: whole_amount(F.col(w), F.col(f)) for name, (w, f) in halves.items()}
    return result.withColumns(whole_sums).drop(*[c for pair in halves.values() for c in pair]) if halves else result


#: Parts an interval of values is cut into at each step of a quantile.
PARTS = 1024


def quantile_by(df: DataFrame, by: Sequence[str], value: str, q: float, name: str = "quantile") -> DataFrame:
    """Exact linearly interpolated quantile per group (one row per group), nulls ignored.

    The two values the quantile lies between are found by narrowing an interval: its values are counted in PARTS equal parts, with
    counts that add up on the map side, and the part that holds the wanted rank is the next interval, until it holds one value. No value
    is sorted or moved; a step takes one pass and writes a row per group.
    """
    by = list(by)
    values = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    facts = values.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    position = (F.col("__n") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.array(F.floor(position).cast("bigint"), F.ceil(position).cast("bigint")))
    state = facts.where("__n > 0").select(*by, (position - F.floor(position)).alias("__part"), "__low", "__high", F.posexplode(ranks).alias("__which", "__rank"))
    state = cut_lineage(state.select(*by, "__part", "__which", "__rank", "__low", "__high"))
    # Every step makes the interval smaller, since its least and its greatest value fall into different parts.
    while not (open_ := state.where("__low < __high")).isEmpty():
        low, high, v = (F.col(c).cast("double") for c in ("__low", "__high", "__v"))
        part = F.when(high > low, F.least(F.floor((v - low) / (high - low) * PARTS), F.lit(PARTS - 1))).otherwise((F.col("__v") > F.col("__low")).cast("bigint"))
        if by:
            met = match_null_safe(values, open_.withColumnRenamed("__part", "__p"), by, "inner")
        else:
            bounds = F.array(*[F.struct(F.lit(r["__part"]).alias("__p"), F.lit(r["__which"]).alias("__which"), F.lit(r["__rank"]).alias("__rank"),
                                        F.lit(r["__low"]).cast(values.schema["__v"].dataType).alias("__low"), F.lit(r["__high"]).cast(values.schema["__v"].dataType).alias("__high")) for r in open_.collect()])
            met = values.select("__v", F.inline(bounds))
        inside = met.where(F.col("__v").between(F.col("__low"), F.col("__high")))
        key = [*by, "__p", "__which", "__rank"]
        counts = inside.groupBy(*key, part.alias("__slot")).agg(F.count("*").alias("__c"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
        upto = F.sum("__c").over(Window.partitionBy(*key).orderBy("__slot"))
        held = counts.withColumn("__upto", upto).where((F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__c")))
        found = held.select(*by, F.col("__p").alias("__part"), "__which", (F.col("__rank") - F.col("__upto") + F.col("__c")).alias("__rank"), F.col("__least").alias("__low"), F.col("__most").alias("__high"))
        state = cut_lineage(state.where("__low >= __high").unionByName(found))
    picked = state.groupBy(*by).agg(F.min("__low").alias("__a"), F.max("__low").alias("__b"), F.max("__part").alias("__part"))
    return picked.select(*by, (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__part")).alias(name))
