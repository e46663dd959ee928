"""Text helpers: postal codes, catalogue labels, comma lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provlens.functions.normalise import col_

LABEL_SEP = " - "


def format_postal(c: str | Column) -> Column:
    """Up to 5 characters: left-pad to 5 ('501' -> '00501'); 6 to 9: left-pad
    to 9 and split as ddddd-dddd; longer: unchanged; null stays null.

    Guarded by length because ``lpad`` truncates longer input.
    """
    s = col_(c).cast("string")
    n = F.length(s)
    nine = F.lpad(s, 9, "0")
    return (F.when(s.isNull(), F.lit(None).cast("string"))
            .when(n <= 5, F.lpad(s, 5, "0"))
            .when(n <= 9, F.concat(F.substring(nine, 1, 5), F.lit("-"), F.substring(nine, 6, 4)))
            .otherwise(s))


def make_label(code: str | Column, text: str | Column) -> Column:
    """``code - description``; a missing description gives ``code - ``."""
    return F.concat(col_(code), F.lit(LABEL_SEP), F.coalesce(col_(text), F.lit("")))


def label_code(label: str | Column) -> Column:
    """The code back from a label: the text before the first separator."""
    return F.split_part(col_(label), F.lit(LABEL_SEP), F.lit(1))


def label_rest(label: str | Column) -> Column:
    """The text after the first separator."""
    lab = col_(label)
    return F.substring(lab, F.length(label_code(lab)) + F.lit(len(LABEL_SEP) + 1), F.length(lab))


def contains_ci(text: str | Column, query: str) -> Column:
    return F.lower(col_(text)).contains(query.lower())


def split_list(text: str | Column, sep: str = ",") -> Column:
    """Array of trimmed, non-blank items of a separated list."""
    items = F.transform(F.split(col_(text), sep), lambda x: F.trim(x))
    return F.filter(items, lambda x: x != F.lit(""))
