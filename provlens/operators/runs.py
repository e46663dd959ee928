"""Run ledger: submitted and finished runs, history per user.

The ledger is an append-only table of events, not a database row updated in
place: a run's submission and its completion are separate rows joined by run
id.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlens.operators.quality import json_records
from provlens.plans.position import with_position
from provlens.session import filesystem_of

NAME_SEP = "_"
LISTED = 10_000  # names that a listing task holds at once


def run_name(username, ts_text, run_id):
    """``<user>_<time>_<id>``, the name a run's files carry."""
    return F.concat_ws(NAME_SEP, username, ts_text, run_id)


def parse_run_names(names: DataFrame, column: str = "name") -> DataFrame:
    """Split run names into username, time text and run id."""
    n = F.col(column)
    return names.select(F.split_part(n, F.lit(NAME_SEP), F.lit(1)).alias("username"),
                        F.split_part(n, F.lit(NAME_SEP), F.lit(2)).alias("ts_text"),
                        F.split_part(n, F.lit(NAME_SEP), F.lit(3)).alias("run_id"))


def run_names_in_folder(spark, path: str) -> DataFrame:
    """One row per file of a run folder, its file name in ``name``.

    Run marker files are empty, and file sources skip empty files, so a task
    lists the folder and streams its names; the driver holds none of them. A
    folder on a file system of the machines is scanned entry by entry, any
    other through ``pyarrow.fs``. The folder must be one that executors reach.
    A folder that does not exist fails the job.
    """
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                names = file_names(folder)
                while held := list(islice(names, LISTED)):
                    yield pa.RecordBatch.from_pydict({"name": pa.array(held, pa.string())})

    return spark.createDataFrame([(path,)], "folder string").mapInArrow(listed, "name string")


def file_names(path: str) -> Iterator[str]:
    """The names of the files of a folder, one by one."""
    store, root = filesystem_of(path)
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(root) as entries:
            yield from (e.name for e in entries if e.is_file())
    else:
        yield from (f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.is_file)


def run_ledger(submitted: DataFrame, finished: DataFrame) -> DataFrame:
    """run_id, username, in_time, out_time (null while running): a left join
    of submissions with completions on the run id."""
    done = finished.select("run_id", "out_time")
    return submitted.select("run_id", "username", "in_time").join(done, "run_id", "left")


EVENT_SCHEMA = "run_id string, username string, event string, at timestamp_ntz, link string"


def append_run_event(spark, path: str, run_id: str, username: str, event: str, at, link: str | None) -> None:
    """Append one ledger event (``submitted`` or ``finished``) to a Parquet
    table: the ledger is never updated in place."""
    row = [(run_id, username, event, at, link)]
    spark.createDataFrame(row, EVENT_SCHEMA).write.mode("append").parquet(path)


def ledger_from_events(events: DataFrame) -> DataFrame:
    """run_id, username, in_time, out_time from the event table."""
    sub = events.where(F.col("event") == "submitted").select("run_id", "username", F.col("at").alias("in_time"))
    fin = events.where(F.col("event") == "finished").groupBy("run_id").agg(F.max("at").alias("out_time"))
    return run_ledger(sub, fin)


def read_ledger(spark, path: str) -> DataFrame:
    return ledger_from_events(spark.read.schema(EVENT_SCHEMA).parquet(path))


def runs_of_user(ledger: DataFrame, username: str) -> DataFrame:
    return ledger.where(F.col("username") == F.lit(username))


def user_history(ledger: DataFrame, username: str, top: int | None = None) -> DataFrame:
    """One user's runs, newest first: a sort, or with ``top`` the latest ones."""
    out = runs_of_user(ledger, username).orderBy(F.desc("in_time"), F.asc("run_id"))
    return out if top is None else out.limit(top)


def user_positions(ledger: DataFrame, username: str) -> DataFrame:
    """One user's runs, newest first, with their position."""
    return with_position(runs_of_user(ledger, username), [F.desc("in_time"), F.asc("run_id")], "position")


def run_history(ledger: DataFrame) -> DataFrame:
    """Newest first per user: ``position`` restarts at 1 for every user (runs
    without a user name are a group of their own).

    Computed with the distributed position (no per-user task holds a whole
    user's runs, even for a user with a large share of all runs).
    """
    return with_position(ledger, [F.desc("in_time"), F.asc("run_id")], "position", within=["username"])


def ledger_records(ledger: DataFrame) -> DataFrame:
    """Ledger rows as JSON objects, times as text; a missing time is left out."""
    text = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("in_time", "out_time")}
    return json_records(ledger.withColumns(text))
