"""The folder that driver and executors share, and small helpers of the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definitions: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows in an Arrow batch.
BATCH_ROWS = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only where that is unset, as in tests with a local master, a temporary
    folder is made and set as the checkpoint folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once for each application, so that workers can import it wherever the driver found it, and bound the session's Arrow batches."""
    # Batches between Spark and Python stay small even where texts are long.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_tablewright_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / "tablewright.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tablewright_shipped = True


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: what follows survives lost executors without recomputing this."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


@contextmanager
def create_file(uri: str):
    """A binary file in the shared folder, by any file system that pyarrow knows; whole or absent."""
    local = _local(uri)
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(f"{local}.part", "wb") as out:
            yield out
        os.replace(f"{local}.part", local)
    else:
        store, path = pa.fs.FileSystem.from_uri(uri)
        with store.open_output_stream(path) as out:
            yield out


def map_file(uri: str, dtype: str) -> np.ndarray:
    """Memory-map a flat file of numbers; from a remote store its bytes are read instead."""
    local = _local(uri)
    if local:
        return np.memmap(local, dtype, "r") if os.path.getsize(local) else np.empty(0, dtype)
    store, path = pa.fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as file:
        return np.frombuffer(file.readall(), dtype)


def text_slices(batches: Iterator[pa.RecordBatch], most: int = 6_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Join and cut record batches so that a slice's texts hold about ``most`` bytes; a longer text is alone in its slice."""
    held, size = [], 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.concat_batches(held)

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(sizes):
            base = sizes[start - 1] if start else 0
            stop = int(np.searchsorted(sizes, base + most - size, "right"))
            if stop <= start and held:
                yield joined()
                held, size = [], 0
                continue
            stop = max(start + 1, stop)
            held.append(batch.slice(start, stop - start))
            size += int(sizes[stop - 1] - base)
            start = stop
    if held:
        yield joined()


def fold(column):
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def clear_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table holds."""
    return df.select(*[df[n] for n in names])
