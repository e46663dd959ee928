"""The public source files, read with declared schemas into the canonical
input shapes the operators take (same attributes as ``Inputs``).

Only the columns the engine uses are declared. The files are read as text
columns named by their header (no type inference), the used columns are
selected by name and cast to the declared types (``try_cast``: a malformed
value becomes null, as in PERMISSIVE mode, and is counted: ``bad_values``).
Extra columns in a new edition are ignored; a missing one fails when the plan
is built. Spark prunes the unused columns at the scan.

Quotes inside quoted fields are doubled in these files. A source whose fields
hold line breaks must be named in ``multiline``; its files are read by byte
ranges with a pass that finds out where records begin (``ranges.py``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from provlens.sources.ranges import read_quoted_csv

# Column names of the public files as published.
PART_B_COLUMNS = ("Rndrng_NPI", "HCPCS_Cd", "HCPCS_Desc", "Tot_Benes", "Tot_Srvcs")
PART_D_COLUMNS = ("Prscrbr_NPI", "Brnd_Name", "Gnrc_Name", "Tot_Clms", "Tot_Benes")
PAYMENT_COLUMNS = (
    "Covered_Recipient_NPI", "Total_Amount_of_Payment_USDollars", "Date_of_Payment",
    "Number_of_Payments_Included_in_Total_Amount", "Form_of_Payment_or_Transfer_of_Value",
    "Nature_of_Payment_or_Transfer_of_Value", "Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_1",
)
REGISTRY_COLUMNS = {
    "NPI": "NPI",
    "Provider Last Name (Legal Name)": "last_name_legal",
    "Provider First Name": "first_name",
    "Provider Middle Name": "middle_name",
    "Provider First Line Business Mailing Address": "address",
    "Provider Business Mailing Address City Name": "city",
    "Provider Business Mailing Address State Name": "state",
    "Provider Business Mailing Address Postal Code": "postal_code",
    "Healthcare Provider Taxonomy Code_1": "tax_code_1",
    "Healthcare Provider Taxonomy Code_2": "tax_code_2",
    "Healthcare Provider Taxonomy Code_3": "tax_code_3",
}
TAXONOMY_COLUMNS = ("Code", "Classification", "Specialization")
AFFILIATION_COLUMNS = {"NPI": "NPI", "Facility Name": "facility_name", "org_pac_id": "org_pac_id"}

# Sources whose text fields may hold line breaks.
MULTILINE = ("affiliations",)

TYPES = {
    "Rndrng_NPI": "bigint", "Tot_Benes": "bigint", "Tot_Srvcs": "double", "Prscrbr_NPI": "bigint",
    "Tot_Clms": "bigint", "Covered_Recipient_NPI": "bigint", "Total_Amount_of_Payment_USDollars": "double",
    "Number_of_Payments_Included_in_Total_Amount": "bigint", "NPI": "bigint", "org_pac_id": "double",
}


@dataclass
class PublicFiles:
    """``files`` maps part_b, part_d, payments, providers, taxonomy,
    affiliations to paths (a file or a folder of CSV files)."""

    spark: SparkSession
    files: dict = field(default_factory=dict)
    multiline: tuple = MULTILINE
    # per source: an observation of the numbers that could not be read, filled by the job that reads them
    bad_values: dict = field(default_factory=dict, repr=False)

    def _csv(self, key: str, columns) -> DataFrame:
        if key in self.multiline:
            raw = read_quoted_csv(self.spark, self.files[key])
        else:
            raw = self.spark.read.option("header", True).option("escape", '"').csv(self.files[key])
        numbers = [c for c in columns if c in TYPES]
        if numbers:
            seen = Observation(f"bad values of {key}")
            self.bad_values[key] = seen
            raw = raw.observe(seen, *[
                F.count_if((F.trim(F.col(f"`{c}`")) != "") & F.col(f"`{c}`").try_cast(TYPES[c]).isNull()).alias(c)
                for c in numbers])
        return raw.select(*[F.col(f"`{c}`").try_cast(TYPES.get(c, "string")).alias(c) for c in columns])

    def bad_value_counts(self, sources) -> dict[str, dict[str, int]]:
        """source -> column -> numbers that could not be read, for sources that
        an action has read (the count of any other would be waited for)."""
        return {key: dict(self.bad_values[key].get) for key in sources if key in self.bad_values}

    @cached_property
    def part_b(self) -> DataFrame:
        return self._csv("part_b", PART_B_COLUMNS)

    @cached_property
    def part_d(self) -> DataFrame:
        return self._csv("part_d", PART_D_COLUMNS)

    @cached_property
    def payments(self) -> DataFrame:
        return self._csv("payments", PAYMENT_COLUMNS)

    @cached_property
    def providers(self) -> DataFrame:
        df = self._csv("providers", REGISTRY_COLUMNS)
        return df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in REGISTRY_COLUMNS.items()])

    @cached_property
    def taxonomy(self) -> DataFrame:
        return self._csv("taxonomy", TAXONOMY_COLUMNS)

    @cached_property
    def affiliations(self) -> DataFrame:
        df = self._csv("affiliations", AFFILIATION_COLUMNS)
        return df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in AFFILIATION_COLUMNS.items()])
