"""Column expressions used at the boundary of every operator.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that stands for "no value" in selection sheets
# (compared after trim and lower-casing).
MISSING_TEXT = ("", "nan", "null")


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column) -> Column:
    """Trimmed text, or null when it is blank or one of the missing markers."""
    t = F.trim(col_(c))
    return F.when(t.isNull() | F.lower(t).isin(*MISSING_TEXT), F.lit(None).cast("string")).otherwise(t)


def upper_key(c: str | Column) -> Column:
    """Canonical drug / brand key: trimmed, upper case, blank -> null."""
    return F.upper(blank_to_null(c))


def lower_key(c: str | Column) -> Column:
    return F.lower(blank_to_null(c))


def truncate_to_bigint(c: str | Column) -> Column:
    """Whole units toward zero (-1.9 -> -1); null when out of range.

    ANSI ``cast`` raises on overflow, so ``try_cast`` is used.
    """
    return col_(c).try_cast("double").try_cast("bigint")


def floor_to_bigint(c: str | Column) -> Column:
    """Whole units downward (-1.9 -> -2), as a bigint."""
    return F.floor(col_(c).try_cast("double"))


def sql_string(value: str) -> str:
    """A SQL string literal for ``value``."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_ident(name: str) -> str:
    """A back-quoted SQL identifier for ``name``."""
    return "`" + name.replace("`", "``") + "`"


def conditional_sum(key: str, value: str, amount: str, alias: str) -> Column:
    """``coalesce(sum(CASE WHEN key = value THEN amount END), 0)`` as one SQL
    expression (one call to build, however wide the pivot)."""
    return F.expr(f"coalesce(sum(CASE WHEN {sql_ident(key)} = {sql_string(value)} "
                  f"THEN {sql_ident(amount)} END), CAST(0 AS BIGINT)) AS {sql_ident(alias)}")
