"""Nearest match in time inside a tolerance, per key, without forming pairs.

Equal time stamps are counted together first. The candidates are copied to the time bucket before and after their
own, so all candidates of a row are in its bucket; windows over (key, bucket) then give the number of candidates
and the nearest one on each side. A window holds only distinct times of one key in three buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MICROS = 60_000_000


def nearest_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
                   right_id: str, minutes: int) -> DataFrame:
    """For each distinct (keys, time) of ``left``: candidate count, nearest candidate, its time and gap in minutes.

    Ties go to the earlier candidate, and to the smallest id at one time. Rows with a null key have no candidate.
    """
    width = minutes * MICROS
    keys = list(keys)

    def micros(c: str):
        return F.unix_micros(F.col(c).cast("timestamp"))

    asked = left.dropna(subset=[*keys, left_time]).select(*keys, micros(left_time).alias("__t")).distinct()
    asked = asked.select(*keys, "__t", F.lit(0).cast("bigint").alias("__n"), F.lit(None).cast(right.schema[right_id].dataType).alias("__id"),
                         F.floor(F.col("__t") / width).alias("__b"), F.lit(True).alias("__ask"))
    offered = right.dropna(subset=[*keys, right_time]).groupBy(*keys, micros(right_time).alias("__t")).agg(
        F.count("*").alias("__n"), F.min(right_id).alias("__id"))
    bucket = F.floor(F.col("__t") / width)
    offered = offered.select(*keys, "__t", "__n", "__id", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__b"),
                             F.lit(False).alias("__ask"))
    line = asked.unionByName(offered)
    ordered = Window.partitionBy(*keys, "__b").orderBy("__t")
    around, before, after = (ordered.rangeBetween(*r) for r in ((-width, width), (-width, 0), (0, width)))
    candidate = F.when(~F.col("__ask"), F.struct("__t", "__id"))
    found = line.withColumns({
        "candidats": F.sum("__n").over(around), "__before": F.max(candidate).over(before), "__after": F.min(candidate).over(after),
    }).where("__ask")
    gap_before, gap_after = F.col("__t") - F.col("__before.__t"), F.col("__after.__t") - F.col("__t")
    earlier = gap_after.isNull() | (gap_before <= gap_after)
    best = F.when(earlier, F.col("__before")).otherwise(F.col("__after"))
    return found.where("candidats > 0").select(
        *keys, F.timestamp_micros("__t").cast(left.schema[left_time].dataType).alias(left_time), "candidats",
        best["__id"].alias(right_id), F.timestamp_micros(best["__t"]).cast(right.schema[right_time].dataType).alias(right_time),
        ((F.col("__t") - best["__t"]) / F.lit(MICROS)).alias("ecart_minutes"))
