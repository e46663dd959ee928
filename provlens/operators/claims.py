"""Part B (services) and Part D (prescriptions) facts.

Both sources end in the same normalised shape ``(npi, drug, patients,
claims)``; the selection joins are hash joins against a size-checked
broadcast of the selection table, so the large fact table is never shuffled
to filter it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlens.functions.normalise import blank_to_null, lower_key, truncate_to_bigint
from provlens.sources.selections import Selections

NORMALISED = ("npi", "drug", "patients", "claims")


def part_b_filtered(part_b: DataFrame, sel: Selections) -> DataFrame:
    """Services for procedure codes of interest, with the canonical drug
    (BRAND). Keys are trimmed on both sides, as in every source."""
    codes = sel.small("part_b").select(F.col("code").alias("HCPCS_Cd"), F.col("drug").alias("BRAND"))
    return part_b.withColumn("HCPCS_Cd", blank_to_null("HCPCS_Cd")).join(codes, "HCPCS_Cd", "inner")


def part_d_filtered(part_d: DataFrame, sel: Selections) -> DataFrame:
    """Prescriptions of brands of interest; the brand is compared lower-cased."""
    brands = sel.small("part_d").select(F.col("brand").alias("Brnd_Name"), F.col("drug").alias("BRAND"))
    lowered = part_d.withColumn("Brnd_Name", lower_key("Brnd_Name"))
    return lowered.join(brands, "Brnd_Name", "inner")


def part_b_normalised(part_b: DataFrame, sel: Selections) -> DataFrame:
    """npi, drug, patients (nullable), claims = services truncated to whole units."""
    f = part_b_filtered(part_b, sel)
    return f.select(
        F.col("Rndrng_NPI").cast("bigint").alias("npi"),
        F.col("BRAND").alias("drug"),
        F.col("Tot_Benes").cast("bigint").alias("patients"),
        truncate_to_bigint("Tot_Srvcs").alias("claims"),
    )


def part_d_normalised(part_d: DataFrame, sel: Selections) -> DataFrame:
    """npi, drug, patients (null -> 0), claims."""
    f = part_d_filtered(part_d, sel)
    return f.select(
        F.col("Prscrbr_NPI").cast("bigint").alias("npi"),
        F.col("BRAND").alias("drug"),
        F.coalesce(F.col("Tot_Benes").cast("bigint"), F.lit(0).cast("bigint")).alias("patients"),
        F.col("Tot_Clms").cast("bigint").alias("claims"),
    )


def by_drug(normalised: DataFrame) -> DataFrame:
    """Totals per drug (partial aggregation before the shuffle)."""
    return normalised.groupBy("drug").agg(
        F.sum("patients").alias("patients"), F.sum("claims").alias("claims"))


def claims_union(part_b_norm: DataFrame | None, part_d_norm: DataFrame | None) -> DataFrame | None:
    """Union by name (safe against column order)."""
    frames = [f.select(*NORMALISED) for f in (part_b_norm, part_d_norm) if f is not None]
    if not frames:
        return None
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def claims_by_provider_drug(union: DataFrame) -> DataFrame:
    return union.groupBy("npi", "drug").agg(
        F.sum("patients").alias("patients"), F.sum("claims").alias("claims"))


def claims_long(union: DataFrame) -> DataFrame:
    """(npi, drug, measure, amount) with measure in {Patients, Claims}."""
    return (union.select("npi", "drug", F.col("patients").alias("Patients"),
                         F.col("claims").alias("Claims"))
            .unpivot(["npi", "drug"], ["Patients", "Claims"], "measure", "amount"))


def normalised_claims(part_b: DataFrame | None, part_d: DataFrame | None,
                      sel: Selections) -> DataFrame | None:
    """Union of the selected sources; a source without a selection is skipped."""
    b = part_b_normalised(part_b, sel) if (part_b is not None and sel.part_b is not None) else None
    d = part_d_normalised(part_d, sel) if (part_d is not None and sel.part_d is not None) else None
    return claims_union(b, d)
