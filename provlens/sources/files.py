"""File sources and sinks with declared schemas.

CSV is read with an explicit schema (no inference job, no silent type drift:
a postal code stays text). Intermediates are materialised as Parquet in the
shared scratch folder (``spark.checkpoint.dir``), never on a machine-local path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from provlens.session import filesystem_of, scratch_dir

# Declared schemas of the public files, as the engine uses them.
SCHEMAS = {
    "part_b": "Rndrng_NPI bigint, HCPCS_Cd string, HCPCS_Desc string, Tot_Benes bigint, Tot_Srvcs double",
    "part_d": "Prscrbr_NPI bigint, Brnd_Name string, Gnrc_Name string, Tot_Clms bigint, Tot_Benes bigint",
    "payments": ("Covered_Recipient_NPI bigint, Total_Amount_of_Payment_USDollars double, "
                 "Date_of_Payment string, Nature_of_Payment_or_Transfer_of_Value string, "
                 "Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_1 string"),
    "taxonomy": "Code string, Classification string, Specialization string",
    "affiliations": "NPI bigint, facility_name string, org_pac_id double",
}


def read_csv(spark: SparkSession, path: str, schema: str | StructType,
             header: bool = True, bad_records_column: str | None = None,
             multiline: bool = False) -> DataFrame:
    """CSV scan with a declared schema; quotes inside quoted fields are doubled,
    as other CSV tools write them. ``multiline`` allows line breaks inside quoted
    fields; the files are still split among tasks (``ranges.py``). With
    ``bad_records_column`` the schema must contain that string column; malformed
    lines land there instead of failing the job (a multi-line file is then one
    task)."""
    if multiline and header and not bad_records_column:
        from provlens.sources.ranges import read_quoted_csv
        return read_quoted_csv(spark, path, schema)
    reader = (spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
              .option("escape", '"').option("multiLine", multiline))
    if bad_records_column:
        reader = reader.option("columnNameOfCorruptRecord", bad_records_column)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Header CSV folder, quotes doubled; on request with all rows in one file,
    put together from the parts (``onefile.py``)."""
    if single_file:
        from provlens.sources.onefile import write_csv_file
        store, folder = filesystem_of(path)
        store.create_dir(folder)
        store.delete_dir_contents(folder)
        write_csv_file(df, f"{path}/part-00000.csv")
        return
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def suggest_schema(spark: SparkSession, path: str, sampling_ratio: float = 0.01) -> StructType:
    """Inference as a tool: propose a schema from a sample, to be declared."""
    return (spark.read.option("header", True).option("inferSchema", True)
            .option("samplingRatio", sampling_ratio).csv(path).schema)


def csv_roundtrip(df: DataFrame, label: str = "csv") -> DataFrame:
    """Write ``df`` as header CSV to scratch and read it back with its schema."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    write_csv(df, path)
    return read_csv(spark, path, df.schema, multiline=True)


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut the lineage: write Parquet to the shared scratch folder, read back.

    Replaces the reference's CSV temp file between stages; the schema is kept
    exactly (no re-inference).
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def json_roundtrip(df: DataFrame, label: str = "json") -> DataFrame:
    """Write JSON lines (one object per row) and read back with the schema."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.mode("overwrite").json(path)
    return spark.read.schema(df.schema).json(path)


def read_catalog_document(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """Read a catalogue saved as one JSON document ``{"<field>": [{...}, ...]}``;
    the file is split among tasks."""
    from provlens.sources import ranges
    return ranges.read_catalog_document(spark, path, item_schema)


def document_roundtrip(df: DataFrame, array_field: str, label: str = "document") -> DataFrame:
    """Write ``df`` as one JSON document and read it back with its schema."""
    from provlens.sources.onefile import write_catalog_document
    path = f"{scratch_dir(df.sparkSession, label)}/catalogue.json"
    write_catalog_document(df, path, array_field)
    return read_catalog_document(df.sparkSession, path, ", ".join(f"`{n}` {t}" for n, t in df.dtypes))


def one_file_roundtrip(df: DataFrame, label: str = "one-file") -> DataFrame:
    """Write ``df`` as one CSV file and read it back with its schema."""
    path = scratch_dir(df.sparkSession, label)
    write_csv(df, path, single_file=True)
    return read_csv(df.sparkSession, path, df.schema, multiline=True)
