"""Records that do not end with their line, read by many tasks.

Spark splits text files by bytes, so a task does not know whether its range
begins inside a quoted CSV field or inside a nested JSON value. Two passes find
out, both over ranges in parallel:

1. every range says how it changes the reader's state: whether it turns "inside
   quotes" round, and how many levels of nesting it adds, starting outside or
   inside quotes;
2. sums over the ranges before it (a row per range) give each range its true
   state at the start; it is then cut into records. A record that began in an
   earlier range comes in pieces (at most two per range), which are joined.

Texts are read with the separator that can only end a piece outside of an
escape: line feeds for CSV, closing braces for JSON.

Bounds: a row per range is broadcast; a record is held whole; nothing else is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provlens.functions.normalise import sql_ident
from provlens.sources.files import materialise

PIECES = "file string, begin bigint, seq bigint, open boolean, starts boolean, record string"


def _lines(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, begin, piece): the pieces of the files in order; ``begin`` is the
    first byte of the range that a task reads."""
    raw = spark.read.option("lineSep", separator).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"),
                      F.col("value").alias("piece"))


def _with_state(lines: DataFrame, measure: Callable[[pd.Series], pd.DataFrame]) -> DataFrame:
    """The lines with the state at the start of their range: ``quoted`` (0 or
    1) and ``depth``. ``measure`` gives, per piece, its turns and the levels it
    adds when it starts outside (``out_levels``) or inside quotes."""
    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, turned, levels = None, 0, [0, 0]
        for pdf in batches:
            got = measure(pdf["piece"])
            for file, begin, turns, outside, inside in zip(pdf["file"], pdf["begin"], got["turns"], got["out_levels"],
                                                           got["in_levels"]):
                if (file, begin) != key:
                    if key:
                        yield pd.DataFrame([(*key, turned, *levels)], columns=["file", "begin", "turns", "l0", "l1"])
                    key, turned, levels = (file, begin), 0, [0, 0]
                # started outside: inside by now if turned; started inside: the other way round
                levels = [levels[0] + (inside if turned else outside), levels[1] + (outside if turned else inside)]
                turned ^= turns & 1
        if key:
            yield pd.DataFrame([(*key, turned, *levels)], columns=["file", "begin", "turns", "l0", "l1"])

    ranges = materialise(lines.mapInPandas(summed, "file string, begin bigint, turns bigint, l0 bigint, l1 bigint"), "ranges")
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    quoted = F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2
    states = ranges.withColumn("quoted", quoted).withColumn("gain", F.when(F.col("quoted") == 0, F.col("l0")).otherwise(F.col("l1")))
    states = states.select("file", "begin", "quoted", F.coalesce(F.sum("gain").over(before), F.lit(0)).alias("depth"))
    return lines.join(F.broadcast(states), ["file", "begin"])  # a row per range


def _joined(pieces: DataFrame, separator: str) -> DataFrame:
    """Whole records (file, begin, seq, record) of cut pieces: an open piece is
    followed by the pieces of later ranges that start no record."""
    cut = materialise(pieces, "records")
    ends = cut.where("open or not starts")
    order = Window.partitionBy("file").orderBy("begin", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    origin = ends.withColumn("own", F.last(F.when(F.col("starts"), F.struct("begin", "seq")), ignorenulls=True).over(order))
    parts = F.array_sort(F.collect_list(F.struct("begin", "seq", "record")))
    joined = (origin.where("own is not null").groupBy("file", "own").agg(parts.alias("parts"))
              .select("file", F.col("own.begin").alias("begin"), F.col("own.seq").alias("seq"),
                      F.concat_ws(separator, F.expr("transform(parts, p -> p.record)")).alias("record")))
    return cut.where("starts and not open").select("file", "begin", "seq", "record").unionByName(joined)


# ---- CSV -------------------------------------------------------------------

def _quote_turns(pieces: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"turns": pieces.str.count('"'), "out_levels": 0, "in_levels": 0})


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, begin, seq, record): every record of the CSV files as text. Quotes
    stand only around fields and doubled inside them (RFC 4180)."""
    lines = _with_state(_lines(spark, path, "\n"), _quote_turns)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        held: list[str] = []
        state = {"quoted": 0, "seq": 0, "starts": True}
        rows: list[tuple] = []

        def end(is_open: bool) -> None:
            if held:
                rows.append((*key, state["seq"], is_open, state["starts"], "\n".join(held)))
                state["seq"] += 1
                held.clear()

        for pdf in batches:
            for file, begin, piece, quoted in zip(pdf["file"], pdf["begin"], pdf["piece"], pdf["quoted"]):
                if (file, begin) != key:
                    end(True)
                    key = (file, begin)
                    state.update(quoted=quoted, seq=0, starts=not quoted)
                held.append(piece)
                if piece.count('"') % 2:
                    state["quoted"] = 1 - state["quoted"]
                if not state["quoted"]:
                    end(False)
                    state["starts"] = True
            if rows:
                yield pd.DataFrame(rows, columns=["file", "begin", "seq", "open", "starts", "record"])
                rows.clear()
        end(True)
        if rows:
            yield pd.DataFrame(rows, columns=["file", "begin", "seq", "open", "starts", "record"])

    return _joined(lines.mapInPandas(cut, PIECES), "\n")


def read_quoted_csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Header CSV whose quoted fields may hold line breaks, every file split
    among many tasks. Without a schema every column is text, named as in the
    header. Rows equal those of a reader that takes a file as one piece."""
    if schema is None:  # names from the header alone: one record is read
        schema = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).schema
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    records = csv_records(spark, path)
    text = F.regexp_replace("record", "\r$", "")
    body = records.where(~((F.col("begin") == 0) & (F.col("seq") == 0)) & (F.trim(text) != ""))
    parsed = F.from_csv(text, _ddl(schema), {"escape": "\""})
    return body.select(parsed.alias("row")).select("row.*")


def _ddl(schema: StructType) -> str:
    return ", ".join(f"{sql_ident(f.name)} {f.dataType.simpleString()}" for f in schema.fields)


# ---- JSON ------------------------------------------------------------------

TOKENS = re.compile(r"\\.|[\"{}\[\]]", re.S)
LEVEL = {"{": 1, "[": 1, "}": -1, "]": -1}


def _levels(text: str, quoted: int) -> tuple[int, int]:
    """(turns of the quotes, levels added) of a piece that starts (not) quoted."""
    turns = levels = 0
    for m in TOKENS.finditer(text):
        if m[0] == '"':
            quoted ^= 1
            turns += 1
        elif not quoted:
            levels += LEVEL.get(m[0], 0)
    return turns, levels


def _json_measure(pieces: pd.Series) -> pd.DataFrame:
    rows = []
    for text in pieces:
        turns, outside = _levels(text, 0)
        inside = _levels(text, 1)[1]
        # the brace that ended the piece counts where it is outside of quotes
        rows.append((turns, outside - (turns % 2 == 0), inside - (turns % 2 == 1)))
    return pd.DataFrame(rows, columns=["turns", "out_levels", "in_levels"])


def array_objects(spark: SparkSession, path: str, depth: int = 2) -> DataFrame:
    """(file, begin, seq, record): the objects at ``depth`` levels of nesting,
    as text; 2 for ``{"<field>": [{...}, ...]}``. A document may be one line."""
    lines = _with_state(_lines(spark, path, "}"), _json_measure)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        held: list[str] = []
        quoted = level = seq = 0
        rows: list[tuple] = []
        starts = False
        for pdf in batches:
            for file, begin, piece, q, d in zip(pdf["file"], pdf["begin"], pdf["piece"], pdf["quoted"], pdf["depth"]):
                if (file, begin) != key:
                    if held:
                        rows.append((*key, seq, True, starts, "}".join(held)))
                        held = []
                    key, quoted, level, seq = (file, begin), int(q), int(d), 0
                    starts = False
                    inside = level > depth
                else:
                    inside = bool(held)
                begun = None if not inside else 0
                for m in TOKENS.finditer(piece):
                    if m[0] == '"':
                        quoted ^= 1
                    elif not quoted and m[0] in LEVEL:
                        if begun is None and m[0] == "{" and level == depth:
                            begun, starts = m.start(), True
                        level += LEVEL[m[0]]
                if begun is not None:
                    held.append(piece[begun:])
                if not quoted:  # the brace that ended the piece
                    level -= 1
                    if held and level == depth:
                        rows.append((*key, seq, False, starts, "}".join(held) + "}"))
                        seq += 1
                        held = []
            if rows:
                yield pd.DataFrame(rows, columns=["file", "begin", "seq", "open", "starts", "record"])
                rows = []
        if held:
            rows.append((*key, seq, True, starts, "}".join(held)))
        if rows:
            yield pd.DataFrame(rows, columns=["file", "begin", "seq", "open", "starts", "record"])

    return _joined(lines.mapInPandas(cut, PIECES), "}")


def read_catalog_document(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """The rows of a catalogue saved as one JSON document
    ``{"<field>": [{...}, ...]}``, read by as many tasks as the file has ranges."""
    items = array_objects(spark, path)
    return items.select(F.from_json("record", item_schema).alias("item")).select("item.*")
