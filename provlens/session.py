"""Session construction and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "provlens") -> SparkSession:
    """Session used by tests and the bench; a cluster job passes its own."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # call-site capture on every DataFrame call only enriches error text
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PROVLENS_DRIVER_MEMORY", "8g"))
    )
    log_dir = os.environ.get("PROVLENS_EVENT_LOG_DIR")
    if log_dir:  # stage/task metrics for the bench, written to a scratch folder
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for materialised intermediates.

    On a cluster this is ``spark.checkpoint.dir`` (a folder every executor
    can reach), read from the session. Only a local session without one (tests)
    gets a temporary folder, removed when the process ends; on a cluster the
    missing setting is an error, as every executor would write to its own disk.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # e.g. a Spark Connect session: no SparkContext here
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if "dir" not in _LOCAL_ROOT:
            _LOCAL_ROOT["dir"] = tempfile.mkdtemp(prefix="provlens-ckpt-")
            atexit.register(shutil.rmtree, _LOCAL_ROOT["dir"], ignore_errors=True)
        configured = _LOCAL_ROOT["dir"]
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return configured


_LOCAL_ROOT: dict[str, str] = {}


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh, unique folder under the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/provlens-{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


_MADE: list[str] = []


def filesystem_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (``file:/x`` as Hadoop writes it, too)."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    if "://" not in path:
        path = os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def remove_scratch() -> int:
    """Remove the scratch folders handed out in this process; for the end of a
    run, when nothing reads them any more. Returns how many there were."""
    removed = 0
    while _MADE:
        store, path = filesystem_of(_MADE.pop())
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_dir(path)
            removed += 1
    return removed
