"""A key holding a large share of all rows: results stay exact and whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from provlens.operators import affiliations as A
from provlens.operators import engagement as E
from provlens.plans.position import with_position


def test_position_with_a_hot_group(spark):
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), (F.col("id") % 97).cast("string")))
        .alias("username"),
        (F.col("id") * 7919 % 1000).alias("ts"), F.col("id").cast("string").alias("run_id"))
    out = with_position(df, [F.desc("ts"), F.asc("run_id")], "position", within=["username"], partitions=8)
    stats = out.groupBy("username").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("lo"),
                                        F.max("position").alias("hi"), F.countDistinct("position").alias("d"))
    rows = stats.collect()
    assert sum(r["n"] for r in rows) == n
    assert all((r["lo"], r["hi"], r["d"]) == (1, r["n"], r["n"]) for r in rows)
    hot = out.where("username = 'hot'").orderBy("position").limit(3).collect()
    assert [r["ts"] for r in hot] == sorted([r["ts"] for r in hot], reverse=True)


def test_first_k_and_pivot_with_a_hot_provider(spark):
    n = 30000
    aff = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).cast("bigint").alias("npi"),
        F.concat(F.lit("F"), (F.col("id") % 500).cast("string")).alias("facility_name"),
        (F.col("id") % 500).cast("bigint").alias("org_pac_id"))
    top = A.affiliations_top(aff, 4).where("npi = 1").first()
    # provider 1 holds every id divisible by 3 (and id 1); "F0" (org 0) comes
    # from ids divisible by 1500, so the first four are all ("F0", 0)
    assert [(top[f"Facility_Name_{i}"], top[f"Org_pac_id_{i}"]) for i in range(1, 5)] == [("F0", 0)] * 4
    long = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).cast("bigint").alias("npi"),
        F.lit("D").alias("drug"), F.lit("Claims").alias("measure"), F.lit(1).cast("bigint").alias("amount"))
    wide = E.pivot_wide(long, [E.Measure("D_Claims", "D", "Claims")], total="total")
    assert wide.where("npi = 1").first()["D_Claims"] == len(range(0, n, 3)) + 1
    assert wide.agg(F.sum("total")).first()[0] == n
