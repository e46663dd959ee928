"""Payments to providers: filter to drugs of interest, recode the nature of
payment into a short category, truncate amounts to whole dollars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlens.functions.normalise import conditional_sum, truncate_to_bigint, upper_key
from provlens.sources.selections import DEFAULT_CATEGORY, Selections

NPI = "Covered_Recipient_NPI"
AMOUNT = "Total_Amount_of_Payment_USDollars"
NATURE = "Nature_of_Payment_or_Transfer_of_Value"
DRUG = "Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_1"


def _keyed(payments: DataFrame) -> DataFrame:
    """Payments with a recipient, the drug key upper-cased and trimmed."""
    return (payments.dropna(subset=[NPI])
            .select(F.col(NPI).cast("bigint").alias("npi"), upper_key(DRUG).alias("drug"),
                    F.col(NATURE).alias("nature"), F.col(AMOUNT).alias("amount_usd")))


def payments_filtered(payments: DataFrame, sel: Selections) -> DataFrame:
    """Inner join with the drug list (keeps the list's multiplicity)."""
    drugs = sel.small("drugs")
    return _keyed(payments).join(drugs, "drug", "inner").select("npi", "drug", "nature", "amount_usd")


def payments_semi(payments: DataFrame, sel: Selections) -> DataFrame:
    """Left-semi join with the drug list: each payment at most once."""
    drugs = sel.small("drugs")
    return _keyed(payments).join(drugs, "drug", "left_semi").select("npi", "drug", "nature", "amount_usd")


def map_categories(filtered: DataFrame, sel: Selections) -> DataFrame:
    """Table-driven recode: broadcast left join with the category map; a
    nature without a (non-blank) rename becomes ``OTHERS_GENERAL``."""
    cmap = sel.small("category_map").select(F.col("original").alias("nature"), "renamed")
    j = filtered.join(cmap, "nature", "left")
    return j.select(
        "npi", "drug",
        F.coalesce(F.col("renamed"), F.lit(DEFAULT_CATEGORY)).alias("category"),
        truncate_to_bigint("amount_usd").alias("amount"),
    )


def payments_mapped(payments: DataFrame, sel: Selections) -> DataFrame:
    return map_categories(payments_filtered(payments, sel), sel)


def recode_fixed(nature: Column, equal_arms: Sequence[tuple[str, str]],
                 pattern_arms: Sequence[tuple[str, str]] = (),
                 default: str = DEFAULT_CATEGORY) -> Column:
    """A fixed ``CASE``: exact arms first, then regular-expression arms."""
    expr = None
    for original, renamed in equal_arms:
        cond = nature == F.lit(original)
        expr = F.when(cond, F.lit(renamed)) if expr is None else expr.when(cond, F.lit(renamed))
    for pattern, renamed in pattern_arms:
        cond = nature.rlike(pattern)
        expr = F.when(cond, F.lit(renamed)) if expr is None else expr.when(cond, F.lit(renamed))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


# The notebook's hard-coded recode for the public payment file
# (exact arms, then one pattern arm).
PUBLIC_FILE_EQUAL_ARMS = (
    ("Food and Beverage", "FOOD&BEVERAGE"),
    ("Consulting Fee", "CONSULTING"),
    ("Travel and Lodging", "TRAVEL"),
    ("Education", "EDUCATION"),
)
PUBLIC_FILE_PATTERN_ARMS = (("Compensation", "SPEAKER"),)

# The same shape of recode for the test data's natures of payment.
TESTDATA_EQUAL_ARMS = (("click", "EDUCATION"), ("view", "FOOD&BEVERAGE"))
TESTDATA_PATTERN_ARMS = (("^[ps]", "SPEAKER"),)


def payments_mapped_regex(payments: DataFrame, sel: Selections,
                          equal_arms=TESTDATA_EQUAL_ARMS,
                          pattern_arms=TESTDATA_PATTERN_ARMS) -> DataFrame:
    f = payments_filtered(payments, sel)
    return f.select("npi", "drug",
                    recode_fixed(F.col("nature"), equal_arms, pattern_arms).alias("category"),
                    truncate_to_bigint("amount_usd").alias("amount"))


def payments_long(mapped: DataFrame) -> DataFrame:
    """(npi, drug, measure, amount) with the category as the measure."""
    return mapped.select("npi", "drug", F.col("category").alias("measure"), "amount")


def payments_by_category(mapped: DataFrame, categories: Sequence[str]) -> DataFrame:
    """One row per (npi, drug), one zero-filled column per category.

    Conditional sums with an explicit category list: the schema does not
    depend on the data and no extra job is needed to discover values.
    """
    aggs = [conditional_sum("category", c, "amount", c) for c in categories]
    return mapped.groupBy("npi", "drug").agg(*aggs)
