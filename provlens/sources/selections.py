"""The user's five selection tables, normalised once.

Normalised shapes (all text trimmed, blank -> null):

* ``part_b``       code, drug          (procedure code -> canonical drug)
* ``part_d``       brand, drug         (lower-case brand -> canonical drug)
* ``drugs``        drug                (drugs whose payments are wanted)
* ``taxonomy``     code                (empty table = no taxonomy filter)
* ``category_map`` original, renamed   (one row per original, renames upper case;
  ``renamed`` is null when unmapped, and such natures fall to ``OTHERS_GENERAL``)

Canonical drug names are upper case everywhere. A selection row whose code or
brand is blank is rejected as a pair, so lists cannot slip against each other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from provlens.functions.normalise import blank_to_null, lower_key, upper_key
from provlens.plans.bounded import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, collect_names

DEFAULT_CATEGORY = "OTHERS_GENERAL"
OPTIONAL = ("part_b", "part_d")  # a missing table means "not selected"

SCHEMAS = {
    "part_b": "HCPCS_Cd string, BRAND string",
    "part_d": "Brnd_Name string, Gnrc_Name string, BRAND string",
    "drugs": "Drug_Name string",
    "taxonomy": "Code string",
    "category_map": "Original string, Renamed string",
}


def _row_bytes(df: DataFrame):
    """Data size of a row: bytes of its text columns, 8 per other value."""
    parts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if isinstance(f.dataType, StringType)
             else F.lit(8) for f in df.schema.fields]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out.cast("bigint")


def norm_part_b(raw: DataFrame) -> DataFrame:
    return (raw.select(blank_to_null("HCPCS_Cd").alias("code"), upper_key("BRAND").alias("drug"))
            .where(F.col("code").isNotNull() & F.col("drug").isNotNull()))


def norm_part_d(raw: DataFrame, dedupe_interest: bool = False) -> DataFrame:
    df = (raw.select(lower_key("Brnd_Name").alias("brand"), upper_key("BRAND").alias("drug"))
          .where(F.col("brand").isNotNull() & F.col("drug").isNotNull()))
    # A brand listed with two generics appears twice; the reference keeps the
    # inner-join multiplicity, which doubles its counts. Optional dedupe.
    return df.distinct() if dedupe_interest else df


def norm_drugs(raw: DataFrame) -> DataFrame:
    return raw.select(upper_key("Drug_Name").alias("drug")).where(F.col("drug").isNotNull())


def norm_taxonomy(raw: DataFrame) -> DataFrame:
    return raw.select(blank_to_null("Code").alias("code")).where(F.col("code").isNotNull())


def with_ordinal(scan: DataFrame) -> DataFrame:
    """A file scan with the place of each row (file, then row) in ``ordinal``."""
    return scan.withColumn("ordinal", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                                               F.monotonically_increasing_id().alias("row")))


def norm_category_map(raw: DataFrame) -> DataFrame:
    """One row per original nature; a blank or missing rename becomes null
    (unmapped). Renames are upper case, like drugs, so that two spellings of
    one name are one category.

    With duplicate originals the first row with a rename wins, in the order of
    ``ordinal`` (the row's place in its file, or in the list it came from). A
    table without that column has no first row; there the smallest rename wins.
    """
    first = "min_by(renamed, ordinal) FILTER (WHERE renamed IS NOT NULL)" if "ordinal" in raw.columns else "min(renamed)"
    df = raw.select(F.col("Original").alias("original"), upper_key("Renamed").alias("renamed"),
                    *[c for c in raw.columns if c == "ordinal"])
    return df.where(F.col("original").isNotNull()).groupBy("original").agg(F.expr(f"{first} AS renamed"))


@dataclass
class Selections:
    part_b: DataFrame | None
    part_d: DataFrame | None
    drugs: DataFrame
    taxonomy: DataFrame
    category_map: DataFrame
    # extra lookup tables (e.g. the taxonomy) measured in the same job
    lookups: dict = field(default_factory=dict, repr=False)
    _sizes: dict = field(default_factory=dict, repr=False)
    _names: dict | None = field(default=None, repr=False)
    _future: object = field(default=None, repr=False)

    @classmethod
    def from_raw(cls, sel_b: DataFrame | None, sel_d: DataFrame | None, sel_drugs: DataFrame,
                 sel_tax: DataFrame, sel_map: DataFrame, dedupe_interest: bool = False) -> "Selections":
        return cls(
            part_b=norm_part_b(sel_b) if sel_b is not None else None,
            part_d=norm_part_d(sel_d, dedupe_interest) if sel_d is not None else None,
            drugs=norm_drugs(sel_drugs),
            taxonomy=norm_taxonomy(sel_tax),
            category_map=norm_category_map(sel_map),
        )

    @classmethod
    def from_inputs(cls, inputs, part_b: bool = True, part_d: bool = True,
                    dedupe_interest: bool = False) -> "Selections":
        sel = cls.from_raw(inputs.sel_b if part_b else None, inputs.sel_d if part_d else None,
                           inputs.sel_drugs, inputs.sel_tax, inputs.sel_map, dedupe_interest)
        sel.lookups["taxonomy_table"] = inputs.taxonomy
        return sel

    @classmethod
    def from_rows(cls, spark: SparkSession, part_b=None, part_d=None, drugs=(), taxonomy=(),
                  category_map=(), dedupe_interest: bool = False) -> "Selections":
        """Literal rows (a schema is always passed: an empty list cannot be inferred)."""
        def mk(rows, key):
            return spark.createDataFrame([tuple(r) for r in rows], SCHEMAS[key])
        return cls.from_raw(
            mk(part_b, "part_b") if part_b is not None else None,
            mk(part_d, "part_d") if part_d is not None else None,
            mk([(d,) for d in drugs], "drugs"),
            mk([(c,) for c in taxonomy], "taxonomy"),
            spark.createDataFrame([(*r, i) for i, r in enumerate(category_map)], SCHEMAS["category_map"] + ", ordinal bigint"),
            dedupe_interest,
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str, dedupe_interest: bool = False) -> "Selections":
        """Read selection tables saved by ``save`` (one Parquet folder each)."""
        def rd(key):
            try:
                scan = spark.read.schema(SCHEMAS[key]).parquet(f"{path}/{key}")
                return with_ordinal(scan) if key == "category_map" else scan
            except AnalysisException as exc:  # a missing optional table means "not selected"
                if key in OPTIONAL and "PATH_NOT_FOUND" in str(exc):
                    return None
                raise
        return cls.from_raw(rd("part_b"), rd("part_d"), rd("drugs"), rd("taxonomy"),
                            rd("category_map"), dedupe_interest)

    @classmethod
    def from_files(cls, spark: SparkSession, paths: dict, fmt: str = "csv",
                   dedupe_interest: bool = False) -> "Selections":
        """Selection tables from CSV (header) or JSON-lines files, one per key
        of ``SCHEMAS``; a missing ``part_b`` / ``part_d`` means "not selected"."""
        def rd(key):
            if key not in paths:
                if key in OPTIONAL:
                    return None
                return spark.createDataFrame([], SCHEMAS[key])
            return _read_selection(spark, key, paths[key], fmt)
        return cls.from_raw(rd("part_b"), rd("part_d"), rd("drugs"), rd("taxonomy"),
                            rd("category_map"), dedupe_interest)

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, fmt: str = "csv",
                    dedupe_interest: bool = False) -> "Selections":
        """``<folder>/<key>.<fmt>`` for every key of ``SCHEMAS``, on any file
        system Spark reads. Only ``part_b`` and ``part_d`` may be missing ("not
        selected"); any other missing file is an error."""
        def rd(key):
            try:
                return _read_selection(spark, key, f"{folder.rstrip('/')}/{key}.{fmt}", fmt)
            except AnalysisException as exc:
                if key in OPTIONAL and "PATH_NOT_FOUND" in str(exc):
                    return None
                raise
        return cls.from_raw(rd("part_b"), rd("part_d"), rd("drugs"), rd("taxonomy"),
                            rd("category_map"), dedupe_interest)

    # ---- sizes for broadcast decisions -------------------------------------

    def sizes(self, *names: str) -> dict[str, tuple[int, int]]:
        """(rows, bytes) of the named tables: one job for those not yet
        measured, one row per table, however many rows a table has."""
        wanted = [n for n in names if n not in self._sizes]
        if wanted:
            parts = [self._tables()[n].select(F.lit(n).alias("kind"), _row_bytes(self._tables()[n]).alias("bytes"))
                     for n in wanted]
            stacked = parts[0]
            for p in parts[1:]:
                stacked = stacked.unionByName(p)
            got = {r["kind"]: (r["n"], int(r["b"] or 0)) for r in stacked.groupBy("kind").agg(
                F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).collect()}
            for n in wanted:
                self._sizes[n] = got.get(n, (0, 0))
        return {n: self._sizes[n] for n in names}

    def prefetch(self, wide: bool = True) -> None:
        """Measure all tables and, for a wide table, ask for its names in a
        background thread (Spark's thread-local properties, e.g. the job group,
        are inherited), so that the parts of a plan that need neither can be
        built meanwhile."""
        if self._future is not None:
            return
        from concurrent.futures import ThreadPoolExecutor

        from pyspark.util import inheritable_thread_target

        def work():
            self.sizes(*self._tables())
            if wide:
                self.names()
        try:
            target = inheritable_thread_target(self.drugs.sparkSession)(work)
        except Exception:  # no thread-local inheritance available: stay synchronous
            return
        pool = ThreadPoolExecutor(max_workers=1)
        self._future = pool.submit(target)
        pool.shutdown(wait=False)

    def _wait(self) -> None:
        future, self._future = self._future, None
        if future is not None:
            future.result()  # re-raises its error

    def _tables(self) -> dict[str, DataFrame]:
        t = {"drugs": self.drugs, "taxonomy": self.taxonomy, "category_map": self.category_map}
        if self.part_b is not None:
            t["part_b"] = self.part_b
        if self.part_d is not None:
            t["part_d"] = self.part_d
        t.update(self.lookups)
        return t

    def small(self, name: str) -> DataFrame:
        """The table, with a broadcast hint only if it was measured within both
        the row and the byte limit; otherwise a shuffle join."""
        df = self._tables()[name]
        n, nbytes = self.measured(name)
        return F.broadcast(df) if n <= BROADCAST_MAX_ROWS and nbytes <= BROADCAST_MAX_BYTES else df

    def measured(self, name: str) -> tuple[int, int]:
        """(rows, bytes) of a table."""
        self._wait()
        return self.sizes(name)[name]

    # ---- names of pivot columns, asked for only by wide tables -------------

    def names(self) -> dict[str, list[str]]:
        """Distinct drugs and renames of the selection tables, in one job."""
        if self._names is None:
            columns = {"part_b": "drug", "part_d": "drug", "drugs": "drug", "category_map": "renamed"}
            parts = [df.select(F.lit(kind).alias("kind"), F.col(columns[kind]).alias("value"))
                     for kind, df in self._tables().items() if kind in columns]
            stacked = parts[0]
            for p in parts[1:]:
                stacked = stacked.unionByName(p)
            found: dict[str, list[str]] = {}
            for r in collect_names(stacked.where(F.col("value").isNotNull()).distinct()):
                found.setdefault(r["kind"], []).append(r["value"])
            self._names = found
        return self._names

    def categories(self) -> list[str]:
        self._wait()
        return sorted(set(self.names().get("category_map", [])) - {DEFAULT_CATEGORY}) + [DEFAULT_CATEGORY]

    def payment_drugs(self) -> list[str]:
        self._wait()
        return sorted(self.names().get("drugs", []))

    def claim_drugs(self) -> list[str]:
        self._wait()
        return sorted({v for k in OPTIONAL for v in self.names().get(k, [])})


def _read_selection(spark: SparkSession, key: str, path: str, fmt: str) -> DataFrame:
    if fmt == "csv":  # text columns by header name, then the declared ones
        # selection sheets are small: line breaks in fields are allowed, one task per file
        raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
        names = [c.split()[0] for c in SCHEMAS[key].split(", ")]
        raw = with_ordinal(raw) if key == "category_map" else raw
        return raw.select(*[F.col(c).cast("string") for c in names], *[c for c in raw.columns if c == "ordinal"])
    scan = spark.read.schema(SCHEMAS[key]).json(path)
    return with_ordinal(scan) if key == "category_map" else scan


def stack_selections(sel: Selections) -> DataFrame:
    """All five tables as one (kind, key, value) table."""
    parts = []
    if sel.part_b is not None:
        parts.append(sel.part_b.select(F.lit("part_b").alias("kind"), F.col("code").alias("key"),
                                       F.col("drug").alias("value")))
    if sel.part_d is not None:
        parts.append(sel.part_d.select(F.lit("part_d").alias("kind"), F.col("brand").alias("key"),
                                       F.col("drug").alias("value")))
    parts.append(sel.drugs.select(F.lit("drugs").alias("kind"), F.col("drug").alias("key"),
                                  F.lit(None).cast("string").alias("value")))
    parts.append(sel.taxonomy.select(F.lit("taxonomy").alias("kind"), F.col("code").alias("key"),
                                     F.lit(None).cast("string").alias("value")))
    parts.append(sel.category_map.select(F.lit("category_map").alias("kind"),
                                         F.col("original").alias("key"),
                                         F.col("renamed").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save_selections(sel: Selections, path: str) -> None:
    """Write the normalised tables as Parquet under ``path`` (one folder each)."""
    tables = {
        "part_b": sel.part_b and sel.part_b.select(F.col("code").alias("HCPCS_Cd"),
                                                   F.col("drug").alias("BRAND")),
        "part_d": sel.part_d and sel.part_d.select(F.col("brand").alias("Brnd_Name"),
                                                   F.lit(None).cast("string").alias("Gnrc_Name"),
                                                   F.col("drug").alias("BRAND")),
        "drugs": sel.drugs.select(F.col("drug").alias("Drug_Name")),
        "taxonomy": sel.taxonomy.select(F.col("code").alias("Code")),
        "category_map": sel.category_map.select(F.col("original").alias("Original"),
                                                F.col("renamed").alias("Renamed")),
    }
    for key, df in tables.items():
        if df is not None:  # an unselected part is skipped, like an empty sheet
            df.write.mode("overwrite").parquet(f"{path}/{key}")
