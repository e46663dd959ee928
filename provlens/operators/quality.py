"""Data-quality reports: shapes, nulls, text in numeric columns, JSON rows.

Each report is one aggregation pass per table (partial aggregates per task),
reshaped to long form ``(table_name, column_name, n)`` so its schema does not
depend on the table's width.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from provlens.functions.normalise import sql_ident


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def table_shape(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, n_rows, n_cols for each table (counts in one job)."""
    return _union([df.agg(F.count(F.lit(1)).alias("n_rows"))
                   .select(F.lit(name).alias("table_name"), "n_rows",
                           F.lit(len(df.columns)).cast("bigint").alias("n_cols"))
                   for name, df in tables.items()])


def _long(df: DataFrame, name: str, counts: dict[str, object]) -> DataFrame:
    wide = df.agg(*[c.alias(k) for k, c in counts.items()])
    return (wide.unpivot([], list(counts), "column_name", "n")
            .select(F.lit(name).alias("table_name"), "column_name", F.col("n").cast("bigint").alias("n")))


def null_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Nulls per column; NaN also counts for float/double columns only
    (``isnan`` on text would fail under ANSI)."""
    frames = []
    for name, df in tables.items():
        counts = {}
        for f in df.schema.fields:
            c = F.col(sql_ident(f.name))
            cond = c.isNull() | F.isnan(c) if isinstance(f.dataType, (DoubleType, FloatType)) else c.isNull()
            counts[f.name] = F.count_if(cond)
        frames.append(_long(df, name, counts))
    return _union(frames)


def non_numeric_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per text column: values present that do not read as a number."""
    frames = []
    for name, df in tables.items():
        counts = {f.name: F.count_if(F.col(sql_ident(f.name)).isNotNull()
                                     & F.col(sql_ident(f.name)).try_cast("double").isNull())
                  for f in df.schema.fields if f.dataType.simpleString() == "string"}
        if counts:
            frames.append(_long(df, name, counts))
    return _union(frames)


def observe_rows(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Row count of a stage, collected as a side effect of the job that runs
    it (no extra action, unlike ``count()`` after each stage)."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("n_rows")), obs


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row (null fields omitted)."""
    return df.select(F.to_json(F.struct(*[F.col(sql_ident(c)) for c in df.columns])).alias("json"))
