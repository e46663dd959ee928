"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlens.session import scratch_dir

SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: later steps
    start from files that survive the loss of an executor."""
    path = scratch_dir(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filled(name: str) -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words, without building the array of words."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batches: Iterable, text: str, limit: int = 1 << 20) -> Iterator:
    """Cut pandas batches so that no piece has more than about ``limit``
    characters of ``text`` (a single longer text is a piece of its own), which
    bounds what a vectorised step holds at once."""
    for pdf in batches:
        sizes = pdf[text].str.len().to_numpy()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield pdf.iloc[start:i].reset_index(drop=True)
                start, held = i, 0
            held += size
        if len(pdf) > start:
            yield pdf.iloc[start:].reset_index(drop=True)
