"""Size-checked broadcast and bounded driver collects.

Selection tables are small by design, but in general they are DataFrames
whose size is not known while the plan is built (one can be derived from a
large table). Nothing is broadcast and nothing reaches the driver without a
measured bound:

* ``Selections.sizes`` (one aggregate per asked table, all in one job)
  measures rows and bytes of the tables a plan joins, and ``Selections.small``
  hints a broadcast only within ``BROADCAST_MAX_ROWS`` and
  ``BROADCAST_MAX_BYTES``; beyond them the join is a shuffle join, whatever the
  number of rows.
* ``broadcast_if_small`` is the stand-alone form for a single table: a
  ``limit(n + 1).count()`` job that stops after ``n + 1`` rows.
* Names of pivot columns must be known to build a wide table. They are asked
  for only then, and ``check_width`` is the one rule for all wide tables: at
  most ``MAX_PIVOT_VALUES`` measure columns. The long form has no limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

# Largest row count we broadcast. A selection row is a few short strings, so
# this stays far below the broadcast size limits.
BROADCAST_MAX_ROWS = 200_000
# ... and largest data size (bytes of the values, before any overhead).
BROADCAST_MAX_BYTES = 64 * 1024 * 1024

# Widest pivot we build (same value as Spark's own spark.sql.pivotMaxValues).
MAX_PIVOT_VALUES = 10_000


def row_count_at_most(df: DataFrame, n: int) -> bool:
    return df.limit(n + 1).count() <= n


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only behind a bounded row-count check."""
    return F.broadcast(df) if row_count_at_most(df, max_rows) else df


def check_width(n_columns: int) -> None:
    if n_columns > MAX_PIVOT_VALUES:
        raise ValueError(f"{n_columns} or more measure columns (at most {MAX_PIVOT_VALUES}); use the long form")


def collect_names(df: DataFrame) -> list[Row]:
    """Rows that name pivot columns; each stands for at least one column."""
    rows = df.limit(MAX_PIVOT_VALUES + 1).collect()
    check_width(len(rows))
    return rows
