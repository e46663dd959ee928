"""Sharding by jump consistent hashing.

A stable 64-bit key of each row (60 bits of the MD5 of its id) is mapped to one
of ``shards`` shards without a ring table: a linear congruential sequence seeded
by the key jumps over the shard numbers at which the key would move, and the
last one below ``shards`` is the answer. With one more shard a row either stays
or moves into the new shard, a share of 1 / (shards + 1) of all rows.

``write_shards`` writes the shards as Parquet folders ``shard_no=<i>`` in slot
order (one range shuffle of the rows); ``manifest`` has a row per file part with
the slot of its first row; ``read_shards`` gives the rows back with their shard
and slot.

Scale: rows are range-partitioned by (shard, id, checksum, length, input
position), so a shard, an id or a group of copies that holds a third of all rows
is spread over many tasks. Only the manifest (at most partitions + shards rows)
is broadcast.

Defined cases: a null id is a key of its own (all such rows share a shard); a
null text has no bytes (size 1, checksum 0) and is written as null; repeated
rows are kept and get slots of their own; an empty table gives empty shards; an
input column named like one of the file columns is written with ``__in`` added.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provlens.llm.common import shuffle_width
from provlens.session import scratch_dir

SHARDS = 8
MULTIPLIER = 2862933555777941757  # fixed value of the jump sequence
FILE_COLUMNS = ("shard_no", "part_no", "row_no")


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, 0 .. shards - 1."""
    key = keys.astype(np.uint64)
    at = np.full(len(key), -1, np.int64)
    nxt = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = nxt[live]
        with np.errstate(over="ignore"):
            key[live] = key[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        step = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        nxt[live] = ((at[live] + 1) * (2147483648.0 / step)).astype(np.int64)
        live = live[nxt[live] < shards]
    return at


def stable_key(column: Column) -> Column:
    """60 bits of the MD5 of a value as text; null has a key of its own."""
    text = F.coalesce(F.concat(F.lit("k"), column.cast("string")), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def shard_of(column: Column, shards: int) -> Column:
    """The shard of a row by its id."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def jumped(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards).astype(np.int32))

    return jumped(stable_key(column))


def _bytes(text: str) -> Column:
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> None:
    """All rows and columns of ``docs`` into ``path``, one folder per shard."""
    kept = docs.select(*[F.col(f"`{c}`").alias(f"{c}__in" if c in FILE_COLUMNS else c) for c in docs.columns])
    key, text = (f"{c}__in" if c in FILE_COLUMNS else c for c in (key, text))
    kept = kept.withColumn("shard_no", shard_of(F.col(f"`{key}`"), shards))
    raw = _bytes(f"`{text}`")
    order = [F.col("shard_no"), F.col(f"`{key}`"), F.crc32(raw), F.length(raw)]
    (kept.repartitionByRange(shuffle_width(docs.sparkSession), *order, F.monotonically_increasing_id())
     .sortWithinPartitions(*order)
     .withColumn("part_no", F.spark_partition_id()).withColumn("row_no", F.monotonically_increasing_id())
     .write.mode("overwrite").partitionBy("shard_no").parquet(path))


def _files(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.schema(f"{columns}part_no int, row_no bigint, shard_no int").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Per shard and file part: its rows, its first row number and the slot of
    that row. At most as many rows as partitions and shards together."""
    parts = _files(spark, path, "").groupBy("shard_no", "part_no").agg(
        F.count(F.lit(1)).alias("rows"), F.min("row_no").alias("first_row"))
    before = Window.partitionBy("shard_no").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("first_slot", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns in ``schema`` of all rows, with ``shard`` and ``slot`` (from
    0, without gaps, in the order of id, checksum and length)."""
    rows = _files(spark, path, f"{schema}, ")
    names = [c for c in rows.columns if c not in FILE_COLUMNS]
    placed = rows.join(F.broadcast(manifest(spark, path)), ["shard_no", "part_no"])
    return placed.select(*[F.col(f"`{c}`") for c in names], F.col("shard_no").alias("shard"),
                         (F.col("first_slot") + F.col("row_no") - F.col("first_row")).alias("slot"))


def shard_report(docs: DataFrame, shards: int = SHARDS, path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of documents
    written to shards and read back; ``grown_shard`` is the shard with one more."""
    path = path or scratch_dir(docs.sparkSession, "llm-shards")
    write_shards(docs.select("doc_id", "text"), path, shards)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = read_shards(docs.sparkSession, path, f"doc_id {id_type}, text string")
    raw = _bytes("text")
    return rows.select("doc_id", (F.length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
                       F.lit("key").alias("law"), "shard", "slot",
                       shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"))
