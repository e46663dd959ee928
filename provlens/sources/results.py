"""Saved results: the wide profile, the long facts and the measure list.

The wide table is the answer; the other two make it possible to open it again
without taking column names apart (``view`` in ``cli.py``).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlens.functions.normalise import sql_ident
from provlens.operators.affiliations import TOP_K, affiliation_block
from provlens.operators.catalog import DEFAULT_CATEGORY_NAMES
from provlens.operators.engagement import (CLAIM_MEASURES, LONG_SCHEMA, MEASURES_SCHEMA, Measure, measures_from,
                                           resolve_names, wide_to_long)
from provlens.operators.registry import ADDRESS_COLS, NAME_COLS, TAXONOMY_TEXT_COLS
from provlens.plans.bounded import collect_names
from provlens.session import scratch_dir
from provlens.sources.files import materialise, write_csv
from provlens.sources.ranges import read_quoted_csv
from provlens.sources.selections import DEFAULT_CATEGORY

BLOCK_COLUMN = re.compile(r"(Facility_Name|Org_pac_id)_\d+")


def save_result(path: str, profile: DataFrame, engagement: DataFrame, measures: DataFrame, fmt: str = "csv",
                single_file: bool = False) -> None:
    if fmt == "parquet":
        profile.write.mode("overwrite").parquet(f"{path}/profile.parquet")
    else:
        write_csv(profile, f"{path}/profile.csv", single_file)
    engagement.write.mode("overwrite").parquet(f"{path}/engagement")
    measures.write.mode("overwrite").parquet(f"{path}/measures")


def _is_number(column: str, measures: Sequence[Measure]) -> bool:
    return column == "npi" or column.startswith("Org_pac_id_") or column in {m.name for m in measures}


@dataclass
class SavedResult:
    profile: DataFrame
    engagement: DataFrame
    measures: list[Measure]

    @classmethod
    def open(cls, spark: SparkSession, path: str, k: int = TOP_K) -> "SavedResult":
        """Read a saved result; a CSV profile gets its types from the blocks it
        is made of and the measure list."""
        measures = measures_from(spark.read.schema(MEASURES_SCHEMA).parquet(f"{path}/measures"))
        engagement = spark.read.schema(LONG_SCHEMA).parquet(f"{path}/engagement")
        try:
            profile = spark.read.parquet(f"{path}/profile.parquet")
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            raw = text_of(spark, f"{path}/profile.csv")
            profile = raw.select(*[F.col(sql_ident(c)).cast("bigint").alias(c) if _is_number(c, measures)
                                   else F.col(sql_ident(c)) for c in raw.columns])
        known = {*NAME_COLS, *ADDRESS_COLS, *TAXONOMY_TEXT_COLS, *affiliation_block(k), *(m.name for m in measures)}
        strange = [c for c in profile.columns if c not in known]
        if strange:
            raise ValueError(f"not a saved profile: {strange[:3]}")
        return cls(profile, engagement, measures)

    def viewed_facts(self) -> DataFrame:
        """The long facts of the providers in the result."""
        return self.engagement.join(self.profile.select("npi"), "npi", "left_semi")


# Columns of one file of a wide export in groups.
GROUP_COLUMNS = 1000
PLACES_SCHEMA = MEASURES_SCHEMA + ", i int"


def save_groups(path: str, sparse: DataFrame, places: DataFrame, columns: int = GROUP_COLUMNS) -> int:
    """Export a sparse profile (``cells`` by place, ``places`` from
    ``measure_places``) for any number of measures: the provider columns as
    ``profile.csv``, the measures as CSV folders ``columns/group=<n>`` of npi and
    at most ``columns`` zero-filled columns, a row per provider in each, and the
    measure list. Cells are split by group once, so every group reads its own.
    Returns the number of groups."""
    spark = sparse.sparkSession
    rows = materialise(sparse, "sparse")
    write_csv(rows.drop("cells"), f"{path}/profile.csv")
    places.select("name", "drug", "measure", "i").write.mode("overwrite").parquet(f"{path}/places")
    places = spark.read.schema(PLACES_SCHEMA).parquet(f"{path}/places")
    flat = rows.select("npi", F.explode("cells").alias("i", "v")).withColumn("g", F.expr(f"i div {columns}"))
    cells = scratch_dir(spark, "cells")
    (flat.groupBy("npi", "g").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("cells"))
     .write.partitionBy("g").parquet(cells))
    cells = spark.read.schema("npi bigint, cells map<int, bigint>, g bigint").parquet(cells)
    groups = -(-places.count() // columns)
    for g in range(groups):  # a bounded list of names each
        names = places.where(F.expr(f"i div {columns} = {g}")).orderBy("i").collect()
        own = rows.select("npi").join(cells.where(F.col("g") == g).drop("g"), "npi", "left")
        write_csv(own.select("npi", *[F.expr(f"coalesce(try_element_at(cells, {r['i']}), 0L) AS {sql_ident(r['name'])}")
                                      for r in names]), f"{path}/columns/group={g}")
    return groups


@dataclass
class SavedGroups:
    """An export in column groups, opened again."""

    spark: SparkSession
    path: str
    columns: int = GROUP_COLUMNS

    @property
    def places(self) -> DataFrame:
        return self.spark.read.schema(PLACES_SCHEMA).parquet(f"{self.path}/places")

    @property
    def profile(self) -> DataFrame:
        raw = text_of(self.spark, f"{self.path}/profile.csv")
        return raw.select(*[F.col(sql_ident(c)).cast("bigint").alias(c) if c == "total" or _is_number(c, [])
                            else F.col(sql_ident(c)) for c in raw.columns])

    def of_drugs(self, drugs: Sequence[str]) -> DataFrame:
        """npi and the measure columns of some drugs; only the groups that hold
        one of them are read."""
        chosen = collect_names(self.places.where(F.col("drug").isin(list(drugs))))
        out = self.profile.select("npi")
        for g in sorted({r["i"] // self.columns for r in chosen}):
            own = [r for r in chosen if r["i"] // self.columns == g]
            rows = text_of(self.spark, f"{self.path}/columns/group={g}")
            out = out.join(rows.select(F.col("npi").cast("bigint").alias("npi"), *[
                F.col(sql_ident(r["name"])).cast("bigint").alias(r["name"]) for r in sorted(own, key=lambda r: r["i"])]), "npi")
        return out


def text_of(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table, every column as text; fields may hold line breaks."""
    return read_quoted_csv(spark, path)


def open_wide(spark: SparkSession, path: str, categories: Sequence[str] = ()) -> SavedResult:
    """A wide CSV from elsewhere, opened by its header alone: measure columns are
    resolved by ``resolve_names`` (``categories`` adds category names to the
    default ones), the long facts come from the cells. A header that can be read
    in two ways is a ``ValueError``."""
    raw = text_of(spark, path)
    known = [c for c in raw.columns if c in {*NAME_COLS, *ADDRESS_COLS, *TAXONOMY_TEXT_COLS} or BLOCK_COLUMN.fullmatch(c)]
    measures = resolve_names([c for c in raw.columns if c not in known],
                             [*CLAIM_MEASURES, DEFAULT_CATEGORY, *(new for _, new in DEFAULT_CATEGORY_NAMES), *categories])
    profile = raw.select(*[F.col(sql_ident(c)).cast("bigint").alias(c) if _is_number(c, measures)
                           else F.col(sql_ident(c)) for c in raw.columns])
    return SavedResult(profile, wide_to_long(profile, measures, spark), measures)
