"""Provider registry: projection, taxonomy enrichment, taxonomy-code filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlens.plans.bounded import broadcast_if_small
from provlens.sources.selections import Selections

CODE_COLS = ("tax_code_1", "tax_code_2", "tax_code_3")
ROLES = ("Primary", "Secondary", "Tertiary")
NAME_COLS = ("npi", "last_name", "first_name", "middle_name", "postal_code")
ADDRESS_COLS = ("address", "city", "state")  # kept when the registry has them
TAXONOMY_TEXT_COLS = tuple(f"{r}_{k}" for r in ROLES for k in ("Classification", "Specialization"))
PROVIDER_BLOCK = NAME_COLS + TAXONOMY_TEXT_COLS


def provider_block(df: DataFrame) -> list[str]:
    """npi, names, [address, city, state,] postal code, taxonomy texts."""
    present = [c for c in ADDRESS_COLS if c in df.columns]
    return list(NAME_COLS[:4]) + present + ["postal_code"] + list(TAXONOMY_TEXT_COLS)


def registry_select(providers: DataFrame) -> DataFrame:
    """Keep and rename the registry columns the profile needs."""
    return providers.select(
        F.col("NPI").cast("bigint").alias("npi"),
        F.col("last_name_legal").alias("last_name"),
        "first_name", "middle_name",
        *[F.col(c).cast("string").alias(c) for c in ADDRESS_COLS if c in providers.columns],
        F.col("postal_code").cast("string").alias("postal_code"),
        *[F.col(c).cast("string").alias(c) for c in CODE_COLS],
    )


def taxonomy_code_filter(registry: DataFrame, sel: Selections, large: bool | None = None) -> DataFrame:
    """Keep providers with any of their three codes in the selection; an empty
    selection keeps everyone. A row without an npi is no provider and is
    dropped first, whichever way the filter runs.

    Small selection (within the measured row and byte limits): the codes are
    one scalar array, computed once, and each provider's codes are compared
    with it where the registry is read; no join, no code list on the driver.

    Large selection: the three codes are stacked into (npi, code) rows and
    joined with the codes (one shuffle on code); the matching npis (distinct,
    partial aggregation first) then filter the registry with a left-semi join
    on npi, whose partitioning the later joins on npi reuse. A non-empty large
    selection needs no empty check.
    """
    codes = sel.taxonomy.select("code").distinct()
    registry = registry.where(F.col("npi").isNotNull())
    if large is None:
        large = sel.small("taxonomy") is sel.taxonomy
    if not large:
        chosen = codes.agg(F.collect_set("code")).scalar()
        own = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in CODE_COLS])  # codes are never blank
        return registry.where(F.arrays_overlap(own, chosen) | (F.size(chosen) == 0))
    stacked = registry.select("npi", F.explode(F.array(*[F.col(c) for c in CODE_COLS])).alias("code"))
    matched = stacked.join(codes, "code", "inner").select("npi").distinct()
    return registry.join(matched, "npi", "left_semi")


def _small_taxonomy(taxonomy: DataFrame, sel: Selections | None) -> DataFrame:
    if sel is not None and "taxonomy_table" in sel.lookups:
        return sel.small("taxonomy_table")
    return broadcast_if_small(taxonomy)


def taxonomy_enrich(registry: DataFrame, taxonomy: DataFrame, sel: Selections | None = None) -> DataFrame:
    """Three left joins, one per code role, each against a fresh projection of
    the taxonomy (broadcast behind a size check: the code catalogue is small).
    A code that matches nothing leaves the texts null; the row survives."""
    tax = _small_taxonomy(taxonomy, sel).select("Code", "Classification", "Specialization")
    out = registry
    for role, code_col in zip(ROLES, CODE_COLS):
        # named after the join, so that the three joins share one broadcast
        joined = out.alias("r").join(tax.alias("t"), F.col(f"r.{code_col}") == F.col("t.Code"), "left")
        out = joined.select("r.*", F.col("t.Classification").alias(f"{role}_Classification"),
                            F.col("t.Specialization").alias(f"{role}_Specialization"))
    return out


def registry_taxonomy(providers: DataFrame, taxonomy: DataFrame, sel: Selections | None = None) -> DataFrame:
    return taxonomy_enrich(registry_select(providers), taxonomy, sel)


def registry_filtered(providers: DataFrame, taxonomy: DataFrame, sel: Selections) -> DataFrame:
    """Filter on codes first (cheap, pushes to the scan), then enrich; the code
    columns are dropped from the result."""
    reg = taxonomy_code_filter(registry_select(providers), sel)
    enriched = taxonomy_enrich(reg, taxonomy, sel)
    return enriched.select(*provider_block(enriched))
