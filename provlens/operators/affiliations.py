"""Facility affiliations: clean, first k facilities per provider, distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provlens.functions.normalise import floor_to_bigint

TOP_K = 4


def affiliation_block(k: int = TOP_K) -> tuple[str, ...]:
    """Facility_Name_1, Org_pac_id_1, ..., interleaved as in the reference."""
    cols: list[str] = []
    for i in range(1, k + 1):
        cols += [f"Facility_Name_{i}", f"Org_pac_id_{i}"]
    return tuple(cols)


def affiliations_clean(affiliations: DataFrame) -> DataFrame:
    """Rows with any null dropped, exact duplicates dropped, then the
    organisation id floored (duplicates that appear after the floor stay)."""
    df = affiliations.select(F.col("NPI").cast("bigint").alias("npi"), "facility_name", "org_pac_id")
    return df.dropna(how="any").dropDuplicates().withColumn("org_pac_id", floor_to_bigint("org_pac_id"))


def affiliated(affiliations: DataFrame) -> DataFrame:
    """npi of every complete affiliation row (the providers that have a first
    facility), repeats included: for semi joins."""
    df = affiliations.select(F.col("NPI").cast("bigint").alias("npi"), "facility_name", "org_pac_id")
    return df.dropna(how="any").select("npi")


def affiliations_ranked(clean: DataFrame, k: int = TOP_K) -> DataFrame:
    """The first k facilities of each provider by (name, id).

    ``row_number() <= k`` lets Spark insert a partial group limit before the
    shuffle, so even a provider holding a large share of all rows sends at
    most k rows per map task.
    """
    w = Window.partitionBy("npi").orderBy("facility_name", "org_pac_id")
    return clean.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def affiliations_top(clean: DataFrame, k: int = TOP_K) -> DataFrame:
    """npi, Facility_Name_1, Org_pac_id_1, ... Facility_Name_k, Org_pac_id_k."""
    ranked = affiliations_ranked(clean, k)
    aggs = []
    for i in range(1, k + 1):
        aggs.append(F.expr(f"max(CASE WHEN rn = {i} THEN facility_name END) AS Facility_Name_{i}"))
        aggs.append(F.expr(f"max(CASE WHEN rn = {i} THEN org_pac_id END) AS Org_pac_id_{i}"))
    return ranked.groupBy("npi").agg(*aggs)


def facility_frequency(clean: DataFrame) -> DataFrame:
    """How many providers have n facilities: facility_count, physician_count."""
    per_npi = clean.groupBy("npi").agg(F.count(F.lit(1)).alias("facility_count"))
    return (per_npi.groupBy("facility_count").agg(F.count(F.lit(1)).alias("physician_count"))
            .orderBy(F.desc("physician_count"), "facility_count"))


def facility_weighted_mean(frequency: DataFrame) -> DataFrame:
    return frequency.agg(
        (F.sum(F.col("facility_count") * F.col("physician_count"))
         / F.sum("physician_count")).cast("double").alias("weighted_mean"))


def facility_mode(frequency: DataFrame) -> DataFrame:
    """Rows of the most common facility count (ties kept). The maximum is a
    scalar subquery over the frequency table, whose size is bounded by the
    number of distinct facility counts."""
    top = frequency.select(F.max("physician_count")).scalar()
    return frequency.where(F.col("physician_count") == top).select("facility_count", "physician_count")
