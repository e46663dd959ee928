"""A 1-based position in a global order, computed without one-task windows.

``row_number() over (order by ...)`` without a partition moves every row to a
single task. Instead:

1. range-partition on the order keys and sort within partitions
   (a distributed sort);
2. tag each row with its partition id and its id inside the partition,
   and write the tagged rows once to the shared folder (``materialise``:
   Parquet under ``spark.checkpoint.dir``), so the tags are fixed even if an
   executor is lost later and work is recomputed. Callers number narrow keys
   and join wide rows to them;
3. count rows per partition (one row per partition), turn the counts into
   offsets with a window over that tiny table, broadcast it (its size is the
   partition count) and add the offset to each row's id.

With ``within`` columns, the position restarts for each group: the group
columns lead the order, so each group is a contiguous run; its first global
position comes from a distributed ``min`` per group and is joined null-safe, as
null is a group like any other. The result is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlens.sources.files import materialise

ROW_ID_BITS = 33  # monotonically_increasing_id = partition << 33 | row


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position",
                  within: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in within] + list(order)
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    tagged = materialise(ranged.withColumn("_pid", F.spark_partition_id())
                         .withColumn("_rid", F.monotonically_increasing_id()), "position")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_rid") - F.shiftleft(F.col("_pid").cast("bigint"), ROW_ID_BITS)
    pos = tagged.join(F.broadcast(offsets), "_pid").withColumn("_gpos", F.col("_off") + local + 1)
    if within:
        first = pos.groupBy(*[F.col(c).alias(f"_{c}") for c in within]).agg(F.min("_gpos").alias("_first"))
        same = F.lit(True)
        for c in within:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        pos = pos.join(first, same).withColumn(name, F.col("_gpos") - F.col("_first") + 1)
    else:
        pos = pos.withColumn(name, F.col("_gpos"))
    return pos.orderBy("_gpos").select(*df.columns, name)
