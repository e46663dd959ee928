"""Inputs shaped like the six public tables and five selection tables.

The test data is a TPC-H-like star schema; the adapters below give it the
shape of the public files the engine is made for (services billed, drugs
prescribed, payments, provider registry, taxonomy, facility affiliations) and
of the user's selection tables. They follow the view definitions in
FIXTURES.md section 2, written with the DataFrame API so that the SQL oracle,
which inlines the same views as text, is an independent implementation.

Every adapter is a lazy projection/join over parquet scans, so Catalyst prunes
columns and pushes filters into the scans.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Natures of payment as the public file spells them; the first six have a default short name.
PUBLIC_NATURES = (
    "Education", "Travel and Lodging", "Food and Beverage", "Consulting Fee",
    "Compensation for services other than consulting, including serving as faculty or as a "
    "speaker at a venue other than a continuing education program",
    "Compensation for serving as faculty or as a speaker for a medical education program",
    "Gift", "Royalty or License",
)

# Declared schemas of the base tables the engine reads: no inference job at
# scan time, and a changed file fails loudly instead of drifting types.
BASE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                 "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                 "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# Fixed values of the fixture selections (FIXTURES.md section 2).
PART_B_BRANDS = ("Brand#1", "Brand#2", "Brand#3")
PART_D_BRANDS = ("Brand#2", "Brand#3", "Brand#4")
PAYMENT_BRANDS = ("Brand#1", "Brand#2", "Brand#3", "Brand#4")
TAXONOMY_CLASSES = ("NATION_1", "NATION_2", "NATION_5", "NATION_10")
CATEGORY_MAP_ROWS = (
    ("click", "EDUCATION"),
    ("view", "FOOD&BEVERAGE"),
    ("purchase", "SPEAKER"),
    ("signup", "SPEAKER"),
    ("error", ""),
)


def _str(c: Column) -> Column:
    return c.cast("string")


@dataclass
class Inputs:
    """Lazily built input DataFrames for one test-data folder."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        """The base table (read once per input set; the scan stays lazy)."""
        cache = self.__dict__.setdefault("_tables", {})
        if name not in cache:
            reader = self.spark.read
            if name in BASE_SCHEMAS:
                reader = reader.schema(BASE_SCHEMAS[name])
            cache[name] = reader.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
        return cache[name]

    # ---- public tables -------------------------------------------------

    def _facts(self, status: str, other: str) -> DataFrame:
        li = self.table("lineitem").where(F.col("l_linestatus") == status)
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        joined = li.join(orders, li["l_orderkey"] == orders["o_orderkey"])
        if other == "part":
            part = self.table("part").select("p_partkey", "p_name", "p_brand", "p_type")
            return joined.join(part, joined["l_partkey"] == part["p_partkey"])
        return joined

    @cached_property
    def part_b(self) -> DataFrame:
        """Services billed: one row per (provider, procedure code)."""
        df = self._facts("O", "part")
        return df.select(
            F.col("o_custkey").alias("Rndrng_NPI"),
            F.concat(F.lit("P"), _str(F.col("l_partkey"))).alias("HCPCS_Cd"),
            F.col("p_name").alias("HCPCS_Desc"),
            F.col("l_linenumber").cast("bigint").alias("Tot_Benes"),
            (F.col("l_quantity") * F.lit(1.5)).alias("Tot_Srvcs"),
        )

    @cached_property
    def part_d(self) -> DataFrame:
        """Drugs prescribed: one row per (prescriber, brand, generic)."""
        df = self._facts("F", "part")
        return df.select(
            F.col("o_custkey").alias("Prscrbr_NPI"),
            F.col("p_brand").alias("Brnd_Name"),
            F.col("p_type").alias("Gnrc_Name"),
            F.col("l_quantity").cast("bigint").alias("Tot_Clms"),
            F.when(F.col("l_linenumber") == 1, F.lit(None).cast("bigint"))
            .otherwise(F.col("l_linenumber").cast("bigint")).alias("Tot_Benes"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        """Payments to providers, one row per payment."""
        ev = self.table("events")
        k = F.replace(F.replace(F.col("props"), F.lit('{"k": '), F.lit("")),
                      F.lit("}"), F.lit("")).cast("int")
        return ev.select(
            F.when(F.col("user_id") == 0, F.lit(None).cast("bigint"))
            .otherwise(F.col("user_id")).alias("Covered_Recipient_NPI"),
            F.col("value").alias("Total_Amount_of_Payment_USDollars"),
            F.col("ts").alias("Date_of_Payment"),
            F.col("event_type").alias("Nature_of_Payment_or_Transfer_of_Value"),
            F.concat(F.lit("Brand#"), _str(k % 25 + 1))
            .alias("Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_1"),
        )

    @cached_property
    def payments_public(self) -> DataFrame:
        """The payments with natures as the public file names them, so that
        every arm of the fixed recodes occurs."""
        k = F.replace(F.replace(F.col("props"), F.lit('{"k": '), F.lit("")),
                      F.lit("}"), F.lit("")).cast("int")
        natures = F.array(*[F.lit(n) for n in PUBLIC_NATURES])
        ev = self.table("events")
        return ev.select(
            F.col("user_id").alias("Covered_Recipient_NPI"),
            F.col("value").alias("Total_Amount_of_Payment_USDollars"),
            F.element_at(natures, k % len(PUBLIC_NATURES) + 1).alias("Nature_of_Payment_or_Transfer_of_Value"),
            F.concat(F.lit("Brand#"), _str(k % 25 + 1))
            .alias("Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_1"),
        )

    @cached_property
    def providers(self) -> DataFrame:
        """Provider registry, one row per NPI."""
        c = self.table("customer")
        key = F.col("c_custkey")
        return c.select(
            key.alias("NPI"),
            F.col("c_name").alias("last_name_legal"),
            F.col("c_mktsegment").alias("first_name"),
            F.when(key % 4 == 0, F.lit(None).cast("string")).otherwise(F.lit("M")).alias("middle_name"),
            F.when(key % 3 == 0, _str((key * 37) % 100000))
            .when(key % 3 == 1, _str(key * 7919 + 1000000))
            .otherwise(_str(key * 7919 + 100000000)).alias("postal_code"),
            _str(F.col("c_nationkey")).alias("tax_code_1"),
            _str((F.col("c_nationkey") * 7 + 3) % 30).alias("tax_code_2"),
            F.when(key % 6 == 0, F.lit(None).cast("string"))
            .otherwise(_str((key % 6) * 5)).alias("tax_code_3"),
        )

    @cached_property
    def taxonomy(self) -> DataFrame:
        """Specialty taxonomy: code -> classification, specialization."""
        n = self.table("nation")
        r = self.table("region")
        j = n.join(r, n["n_regionkey"] == r["r_regionkey"])
        return j.select(
            _str(F.col("n_nationkey")).alias("Code"),
            F.col("n_name").alias("Classification"),
            F.when(F.col("n_nationkey") % 5 == 0, F.lit(None).cast("string"))
            .otherwise(F.col("r_name")).alias("Specialization"),
        )

    @cached_property
    def affiliations(self) -> DataFrame:
        """Facility affiliations: (NPI, facility name, organisation id)."""
        li = self.table("lineitem")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        sup = self.table("supplier").select("s_suppkey", "s_name")
        j = (li.join(orders, li["l_orderkey"] == orders["o_orderkey"])
             .join(sup, li["l_suppkey"] == sup["s_suppkey"]))
        return j.select(
            F.col("o_custkey").alias("NPI"),
            F.when(F.col("s_suppkey") % 17 == 0, F.lit(None).cast("string"))
            .otherwise(F.col("s_name")).alias("facility_name"),
            (F.col("s_suppkey").cast("double") + F.lit(0.5).cast("double")).alias("org_pac_id"),
        )

    # ---- selection tables (raw, before normalisation) ----------------

    @cached_property
    def sel_b(self) -> DataFrame:
        p = self.table("part").where(F.col("p_brand").isin(*PART_B_BRANDS))
        return p.select(
            F.concat(F.lit("P"), _str(F.col("p_partkey"))).alias("HCPCS_Cd"),
            F.upper(F.col("p_brand")).alias("BRAND"),
        )

    @cached_property
    def sel_d(self) -> DataFrame:
        p = self.table("part").where(F.col("p_brand").isin(*PART_D_BRANDS))
        return p.select(
            F.lower(F.col("p_brand")).alias("Brnd_Name"),
            F.upper(F.col("p_brand")).alias("BRAND"),
        ).distinct()

    @cached_property
    def sel_drugs(self) -> DataFrame:
        p = self.table("part").where(F.col("p_brand").isin(*PAYMENT_BRANDS))
        return p.select(F.upper(F.col("p_brand")).alias("Drug_Name")).distinct()

    @cached_property
    def sel_tax(self) -> DataFrame:
        return self.taxonomy.where(F.col("Classification").isin(*TAXONOMY_CLASSES)).select("Code")

    @cached_property
    def sel_map(self) -> DataFrame:
        return self.spark.createDataFrame(
            list(CATEGORY_MAP_ROWS), "Original string, Renamed string")

    # ---- run ledger made from orders ------------------------------------

    @cached_property
    def runs_submitted(self) -> DataFrame:
        """run_id, username (the customer's segment), in_time."""
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        c = self.table("customer").select("c_custkey", "c_mktsegment")
        j = o.join(c, o["o_custkey"] == c["c_custkey"])
        return j.select(_str(F.col("o_orderkey")).alias("run_id"),
                        F.col("c_mktsegment").alias("username"),
                        F.col("o_orderdate").alias("in_time"))

    @cached_property
    def runs_finished(self) -> DataFrame:
        """run_id, out_time for finished orders (status F)."""
        o = self.table("orders").where(F.col("o_orderstatus") == "F")
        return o.select(_str(F.col("o_orderkey")).alias("run_id"),
                        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("out_time"))

    @cached_property
    def run_names(self) -> DataFrame:
        """File-style run names ``u<customer>_<yyyyMMddHHmmss>_<order>``."""
        o = self.table("orders")
        return o.select(F.concat_ws("_", F.concat(F.lit("u"), _str(F.col("o_custkey"))),
                                    F.date_format("o_orderdate", "yyyyMMddHHmmss"),
                                    _str(F.col("o_orderkey"))).alias("name"))

    @cached_property
    def drug_lists(self) -> DataFrame:
        """Comma lists of drug names as a user would type them, one per part."""
        p = self.table("part")
        return p.select(F.concat(F.lit(" "), F.lower(F.col("p_brand")), F.lit(" , ,"),
                                 F.col("p_brand"), F.lit(",")).alias("text"))

    def view(self, name: str) -> DataFrame:
        return getattr(self, name)


VIEW_NAMES = (
    "part_b", "part_d", "payments", "providers", "taxonomy", "affiliations",
    "sel_b", "sel_d", "sel_drugs", "sel_tax", "sel_map",
)
