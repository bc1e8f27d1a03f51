"""Token ids as flat binary files with 64-bit document offsets.

Documents are range-partitioned and sorted by ``doc_id``, so the files, taken
in order, are the collection in ascending order.  A partition ``p`` gives

* ``p.ids`` - the ids, flat little-endian unsigned integers, two bytes wide
  where the vocabulary allows it, else four,
* ``p.off`` - little-endian int64, where each document begins in ``p.ids``,
  and the end of the last,
* ``p.doc`` - little-endian int64, the document numbers.

Where a partition begins in the collection (its base) is the prefix sum of the
sizes of those before it.  Files are written whole under the attempt's own
name, and only names that successful tasks return are read, so lost executors
and repeated attempts do no harm.

Null texts count as empty and hold the end id alone; repeated rows are written
each; a null ``doc_id`` sorts first.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import create_file, map_file, new_folder, text_slices
from .tokens import encoder

#: Stands for a null doc_id in the files.
NO_DOC = np.iinfo(np.int64).min


def with_end(flat: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to every document."""
    return np.insert(flat, offsets[1:], end_id), offsets + np.arange(len(offsets))


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, width: str = "<u2") -> list[dict]:
    """Write the files and return their manifest: one entry for each file, in order, with its base.

    The manifest grows with the number of files, never with the documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = encoder(vocabulary), TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        docs_seen, ends, total = [], [np.zeros(1, np.int64)], 0
        with create_file(f"{folder}/{name}.ids") as out:
            for part in text_slices(batches):
                flat, offsets = with_end(*own.encode(part.column("text")), end_id)
                if len(flat) and int(flat.max()) > np.iinfo(width).max:
                    raise ValueError(f"ids of {vocabulary} do not fit {width}")
                out.write(flat.astype(width).tobytes())
                ends.append(offsets[1:] + total)
                total += len(flat)
                docs_seen.append(part.column("doc_id").fill_null(int(NO_DOC)).to_numpy())
        own.forget()
        if not docs_seen:
            return
        with create_file(f"{folder}/{name}.off") as out:
            out.write(np.concatenate(ends).astype("<i8").tobytes())
        with create_file(f"{folder}/{name}.doc") as out:
            out.write(np.concatenate(docs_seen).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "n_docs": [sum(map(len, docs_seen))], "n_ids": [total]}, schema=_PART)

    ordered = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    parts = sorted(ordered.mapInArrow(run, "part int, name string, n_docs long, n_ids long").collect(), key=lambda r: r.part)
    bases = accumulate((r.n_ids for r in parts), initial=0)
    return [{"name": r.name, "base": base, "n_docs": r.n_docs, "n_ids": r.n_ids} for r, base in zip(parts, bases)]


_PART = pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_BACK = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_documents(folder: str, manifest: list[dict], numbers: list[int], width: str = "<u2") -> dict[int, np.ndarray]:
    """Ids of single documents, through memory maps; repeated numbers give the first."""
    found: dict[int, np.ndarray] = {}
    for entry in manifest:
        held = map_file(f"{folder}/{entry['name']}.doc", "<i8")
        for n in set(numbers) - found.keys():
            at = int(np.searchsorted(held, n))
            if at < len(held) and held[at] == n:
                off = map_file(f"{folder}/{entry['name']}.off", "<i8")
                found[n] = np.array(map_file(f"{folder}/{entry['name']}.ids", width)[off[at] : off[at + 1]])
    return found


def read_token_files(spark: SparkSession, folder: str, manifest: list[dict], width: str = "<u2") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the memory-mapped files, a task for each file."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                ids, off, doc = (map_file(f"{folder}/{entry['name']}.{kind}", t) for kind, t in (("ids", width), ("off", "<i8"), ("doc", "<i8")))
                for k in range(0, len(doc), 20_000):
                    stop = min(k + 20_000, len(doc))
                    sums = [crc32_of(ids[off[i] : off[i + 1]]) for i in range(k, stop)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(doc[k:stop]), mask=np.array(doc[k:stop]) == NO_DOC), pa.array(entry["base"] + off[k:stop]), pa.array(np.diff(off[k : stop + 1])), pa.array(sums, pa.int64())], schema=_BACK)

    files = spark.createDataFrame([(e["name"], e["base"]) for e in manifest], "name string, base long")
    return files.repartition(len(manifest)).mapInArrow(run, schema)


def token_file_digests(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write all documents to a new folder in the shared place and describe them from what is read back."""
    folder = new_folder(docs.sparkSession, "token-files")
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, folder, vocabulary, end_id))
