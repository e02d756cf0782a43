import random
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from comptoir.plans.nearest import nearest_within
from comptoir.plans.ordered import accumulate, quantile_by


def skewed(spark, n=3000, seed=5):
    """A third of the rows share one key, and null keys occur."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else None if rng.random() < 0.05 else f"k{rng.randint(0, 50)}"
        rows.append((i, key, rng.randint(0, 40), round(rng.uniform(-50, 50), 2)))
    return spark.createDataFrame(rows, "id long, k string, t int, v double")


def test_accumulate_equals_a_plain_window(spark):
    df = skewed(spark)
    window = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    wanted = {r["id"]: (r["rn"], r["c"]) for r in df.select(
        "id", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).alias("rn"),
        F.sum(F.col("v").cast("decimal(20,6)")).over(window).alias("c")).collect()}
    out = accumulate(df, ["k"], [F.col("t"), F.col("id")], "rn", amounts={"c": F.col("v")}).collect()
    assert len(out) == 3000
    for r in out:
        assert r["rn"] == wanted[r["id"]][0]
        assert Decimal(r["c"]) == Decimal(wanted[r["id"]][1])


def test_quantile_equals_the_exact_percentile(spark):
    df = skewed(spark).where("k IS NOT NULL")
    wanted = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", 0.9).alias("q")).collect()}
    found = {r["k"]: r["q"] for r in quantile_by(df, ["k"], "v", 0.9, "q").collect()}
    assert set(found) == set(wanted)
    assert all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)
    whole = df.agg(F.percentile("v", 0.37)).first()[0]
    assert abs(quantile_by(df, [], "v", 0.37, "q").first()["q"] - whole) < 1e-9


def test_quantile_of_few_values_ties_and_far_ones(spark):
    rows = [(None, float(v)) for v in (1, 1, 1, 2)] + [("a", 5.0)] + [("b", None)] + [("c", v) for v in (1e-9, 1e12, 3.0, 3.0000001, -1e12, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        wanted = {r["k"]: r["q"] for r in df.where("v IS NOT NULL").groupBy("k").agg(F.percentile("v", q).alias("q")).collect()}
        assert {r["k"]: r["q"] for r in quantile_by(df, ["k"], "v", q, "q").collect()} == wanted
    exact = quantile_by(df.select("k", F.col("v").cast("decimal(20,6)").alias("v")), ["k"], "v", 0.5, "q").where("k = 'c'").first()["q"]
    assert float(exact) == 3.0
    assert quantile_by(df.where("v > 1e13"), [], "v", 0.5).first()["quantile"] is None


def test_wide_rows_join_their_running_sums(spark):
    df = skewed(spark).withColumn("wide", F.repeat(F.lit("x"), 50))
    order = [F.col("t").desc(), F.col("id").asc()]
    plain = accumulate(df, ["k"], order, "rn", {"s": F.col("t")}, {"c": F.col("v")})
    joined = accumulate(df, ["k"], order, "rn", {"s": F.col("t")}, {"c": F.col("v")}, ordered_by=["t", "id"])
    assert sorted(plain.columns) == sorted(joined.columns)
    assert sorted(map(str, plain.select("id", "wide", "rn", "s", "c").collect())) == sorted(map(str, joined.select("id", "wide", "rn", "s", "c").collect()))


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(9)

    def side(n):
        return [(f"x{i}", "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 5)}", rng.randint(0, 100_000)) for i in range(n)]

    left, right = side(200), side(200)
    def frame(rows, name):
        return spark.createDataFrame(rows, f"{name} string, k string, s long").withColumn("t" + name, F.timestamp_seconds("s").cast("timestamp_ntz"))

    out = nearest_within(frame(left, "l"), frame(right, "r"), ["k"], "tl", "tr", "r", 120).collect()
    found = {(r["k"], r["tl"]): (r["candidats"], r["r"], abs(r["ecart_minutes"])) for r in out}
    import datetime as dt
    for _, k, s in left:
        near = sorted((abs(s - s2), s2, r) for r, k2, s2 in right if k2 == k and abs(s - s2) <= 7200)
        got = found.get((k, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s)))
        if not near:
            assert got is None
        else:
            assert got[0] == len(near) and got[1] == near[0][2] and abs(got[2] - near[0][0] / 60) < 1e-9
