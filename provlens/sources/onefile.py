"""One file out of many parts, without gathering rows.

A result is written by Spark as ordered part files; a commit step puts them
together as one file: the opening, the parts in order, the end. Where the file
system can concatenate (HDFS), it does so. On a shared POSIX file system the
sizes of the parts give every part its place in the file, and tasks copy the
parts there side by side. Elsewhere the parts are copied one after the other
with a bounded buffer. No task and no driver holds the rows; the driver knows
one (name, size) per part.

The file appears under its name at the end (written beside it and renamed), so
a lost executor or a failed commit never leaves half a file.
"""

from __future__ import annotations

import os
import uuid

from pyarrow import fs
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlens.functions.normalise import sql_ident
from provlens.session import filesystem_of, scratch_dir

COPY_BYTES = 8 << 20


def _parts(store: fs.FileSystem, folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the part files, in order."""
    found = store.get_file_info(fs.FileSelector(folder))
    return sorted((i.path, i.size) for i in found
                  if i.type == fs.FileType.File and os.path.basename(i.path).startswith("part-") and i.size)


def _place_parts(spark: SparkSession, parts: list[tuple[str, int]], target: str, begin: int) -> None:
    """Tasks copy the parts to their places in a file of known size."""
    places, at = [], begin
    for path, size in parts:
        places.append((path, at, size))
        at += size
    limit = COPY_BYTES

    def copy(rows):
        for row in rows:
            with open(row["path"], "rb") as source, open(target, "r+b") as out:
                out.seek(row["at"])
                left = row["size"]
                while left:
                    piece = source.read(min(limit, left))
                    out.write(piece)
                    left -= len(piece)

    table = spark.createDataFrame(places, "path string, at bigint, size bigint")
    table.repartition(min(len(places), 1000)).foreachPartition(copy)


def _concat(spark: SparkSession, target: str, parts: list[str]) -> bool:
    """The file system's own concatenation onto ``target``, if it has one."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    array = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
    for i, p in enumerate(parts):
        array[i] = jvm.org.apache.hadoop.fs.Path(p)
    try:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).concat(path, array)
    except Py4JJavaError as exc:
        if "UnsupportedOperationException" in str(exc.java_exception):
            return False
        raise
    return True


def commit_one_file(spark: SparkSession, folder: str, path: str, opening: bytes = b"", end: bytes = b"",
                    drop: int = 0) -> int:
    """Put the part files of ``folder`` together as the file ``path`` between
    ``opening`` and ``end``; the last ``drop`` bytes of the parts are left out.
    Returns the number of parts."""
    store, base = filesystem_of(folder)
    goal_store, goal = filesystem_of(path)
    parts = _parts(store, base)
    begin, whole = len(opening), sum(size for _, size in parts)
    made = f"{os.path.dirname(goal)}/.{os.path.basename(goal)}-{uuid.uuid4().hex}"
    goal_store.create_dir(os.path.dirname(goal))
    drop = drop if whole else 0
    if isinstance(goal_store, fs.LocalFileSystem) and isinstance(store, fs.LocalFileSystem):
        with open(made, "wb") as out:
            out.write(opening)
            out.truncate(begin + whole)
        if parts:
            _place_parts(spark, parts, made, begin)
        with open(made, "r+b") as out:
            out.truncate(begin + whole - drop)
            out.seek(begin + whole - drop)
            out.write(end)
    elif not (drop == 0 and not end and _joined_by_store(spark, store, goal_store, base, made, path, folder, opening, parts)):
        with goal_store.open_output_stream(made) as out:
            out.write(opening)
            left = whole - drop
            for part, _ in parts:
                with store.open_input_stream(part) as source:
                    while left and (piece := source.read(min(COPY_BYTES, left))):
                        out.write(piece)
                        left -= len(piece)
            out.write(end)
    goal_store.move(made, goal)
    return len(parts)


def _joined_by_store(spark, store, goal_store, base, made, path, folder, opening, parts) -> bool:
    if type(store) is not type(goal_store) or "://" not in path or not parts:
        return False
    with goal_store.open_output_stream(made) as out:
        out.write(opening)
    root = path[:path.index("/", path.index("://") + 3)]
    return _concat(spark, root + made, [root + p for p, _ in parts])


def write_csv_file(df: DataFrame, path: str) -> int:
    """``df`` as one header CSV file, rows in the order of its partitions: the
    bytes that one task would have written. Returns the number of parts."""
    spark = df.sparkSession
    folder = scratch_dir(spark, "csv-parts")
    df.write.option("header", False).option("escape", '"').csv(folder)
    names = F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    header = spark.range(1).select(F.to_csv(names, {"escape": '"'})).first()[0]
    return commit_one_file(spark, folder, path, f"{header}\n".encode())


def write_catalog_document(df: DataFrame, path: str, array_field: str) -> int:
    """``df`` as one JSON document ``{"<field>": [{...}, ...]}``, rows sorted,
    null fields left out. Every range of rows is written by its own task, one
    object a line; the commit step adds opening and end. Returns the number of
    ranges."""
    spark = df.sparkSession
    folder = scratch_dir(spark, "document-parts")
    row = F.to_json(F.struct(*[F.col(sql_ident(c)) for c in df.columns]))
    sortable = [F.col(sql_ident(c)) for c in df.columns]
    df.orderBy(*sortable).select(F.concat(row, F.lit(",")).alias("value")).write.text(folder)
    field = spark.range(1).select(F.to_json(F.struct(F.lit(0).alias(array_field)))).first()[0]
    opening = field[:field.rindex("0")] + "[\n"  # {"<field>":[ with the name escaped as Spark writes it
    return commit_one_file(spark, folder, path, opening.encode(), b"\n]}\n", drop=2)
