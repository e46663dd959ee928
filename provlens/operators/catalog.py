"""Lookup catalogues the user picks selections from, and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlens.functions.text import contains_ci, label_code, label_rest, make_label, split_list

# Default short names for natures of payment in the public
# payment file; any other nature gets '' (no mapping).
DEFAULT_CATEGORY_NAMES = (
    ("Education", "EDUCATION"),
    ("Travel and Lodging", "TRAVEL"),
    ("Food and Beverage", "FOOD&BEVERAGE"),
    ("Consulting Fee", "CONSULTING"),
    ("Compensation for services other than consulting, including serving as faculty or as a "
     "speaker at a venue other than a continuing education program", "SPEAKER"),
    ("Compensation for serving as faculty or as a speaker for a medical education program", "SPEAKER"),
)


def catalog_procedures(part_b: DataFrame) -> DataFrame:
    return part_b.select("HCPCS_Cd", "HCPCS_Desc").distinct()


def catalog_drugs(part_d: DataFrame) -> DataFrame:
    return part_d.select("Brnd_Name", "Gnrc_Name").distinct()


def catalog_taxonomy(taxonomy: DataFrame) -> DataFrame:
    """A code without a specialization cannot be chosen: rows with nulls go."""
    return taxonomy.select("Code", "Classification", "Specialization").dropna(how="any")


def catalog_categories(payments: DataFrame, spark: SparkSession) -> DataFrame:
    """Distinct natures of payment with their default short name ('' if none)."""
    names = F.broadcast(spark.createDataFrame(list(DEFAULT_CATEGORY_NAMES), "Original string, Renamed string"))
    natures = (payments.select(F.col("Nature_of_Payment_or_Transfer_of_Value").alias("Original"))
               .dropna().distinct())
    return (natures.join(names, "Original", "left")
            .select("Original", F.coalesce(F.col("Renamed"), F.lit("")).alias("Renamed")))


def catalog_labels(procedures: DataFrame, drugs: DataFrame) -> DataFrame:
    """kind, code, label (``code - text``) for both pickers."""
    p = procedures.select(F.lit("procedure").alias("kind"), F.col("HCPCS_Cd").alias("code"),
                          make_label("HCPCS_Cd", "HCPCS_Desc").alias("label"))
    d = drugs.select(F.lit("drug").alias("kind"), F.col("Brnd_Name").alias("code"),
                     make_label("Brnd_Name", "Gnrc_Name").alias("label"))
    return p.unionByName(d)


def label_split(labels: DataFrame) -> DataFrame:
    return labels.select("kind", label_code("label").alias("code"), label_rest("label").alias("rest"))


def catalog_search(labels: DataFrame, query: str) -> DataFrame:
    return labels.where(contains_ci("label", query)).select("kind", "code", "label")


def drug_list_parse(lists: DataFrame, column: str = "text") -> DataFrame:
    """Comma lists typed by users -> distinct canonical drug names."""
    items = lists.select(F.explode(split_list(column)).alias("item"))
    return items.select(F.upper("item").alias("drug")).distinct()
