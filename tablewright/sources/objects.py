"""Small objects and file housekeeping, by any file system that Spark knows."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; a temporary one where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    store, where = _at(spark, path)
    return store.getContentSummary(where).getLength()


def opened(spark: SparkSession, path: str):
    """An input stream of a file's bytes; the caller closes it."""
    store, where = _at(spark, path)
    return store.open(where)


def delete(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no folder."""
    store, where = _at(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(where)) if store.exists(where) else []


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file under a name that nobody has taken; whole or not at all, and false if the name is taken.

    A draft gets the name in one step: by a link on a local disk, by a rename
    elsewhere, which must not replace a file (as on HDFS).
    """
    store, where = _at(spark, path)
    draft = where.suffix(f".{uuid.uuid4().hex}.draft")
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(draft.getParent(), "." + draft.getName())
    out = store.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if store.getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), where.toUri().getPath())
                return True
            except FileExistsError:
                return False
        return not store.exists(where) and bool(store.rename(draft, where))
    finally:
        store.delete(draft, False)


def backup(spark: SparkSession, path: str) -> str:
    """Copy to a name with the time behind it."""
    store, where = _at(spark, path)
    to = f"{path}.{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(store, where, store, target, False, spark.sparkContext._jsc.hadoopConfiguration())
    return to


def save_json(spark: SparkSession, path: str, value: Any) -> None:
    store, where = _at(spark, path)
    out = store.create(where, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, default=str).encode()))
    finally:
        out.close()


def load_json(spark: SparkSession, path: str) -> Any:
    return json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
