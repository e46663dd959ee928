"""Small tables with every awkward row: nulls, empty and long texts, repeated
rows, equal ids, and extra columns named like the operators' results."""

from __future__ import annotations

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, fingerprint string, "
          "kept boolean, d bigint, h bigint, copies bigint, score double, ids string")
PASSAGE = "a passage of words that is certainly longer than one hundred bytes and that several documents hold in common"


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source)"""
    long = " ".join(f"word{i * 7919 % 4001}" for i in range(9000))
    return [
        (1, None, None), (2, "", "b"), (3, "x", "a"), (4, " \t\n ", "a"),
        (5, "The same  Text, twice. " * 3, "b"), (6, "The same  Text, twice. " * 3, "b"),
        (7, "repeated row", "c"), (7, "repeated row", "c"),
        (8, "one id", "a"), (8, "two texts " + PASSAGE, "a"),
        (None, "no id " + PASSAGE + " end", "é"), (None, None, "b"),
        (10, long, "a"), (11, "start " + PASSAGE + " ünïcode 日本", None),
        (12, "no spaces at all " + "q" * 3000, "d"), (13, PASSAGE, "d"),
        (14, "é" * 150 + " " + "é" * 150, "e"), (15, "line\nline\n\nline\n other", "e"),
        (16, long[:-400] + " different end", "b"), (17, "\x01\x85\xa0 control <|endoftext|> </s>[INST] \\l", "e"),
    ]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame(
        [(i, t, "en", s, None if t is None else len(t), -1, "zz", None, -5, 9, 7, 0.5, "x") for i, t, s in rows], SCHEMA)
