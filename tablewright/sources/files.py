"""Reading and writing tables: format by extension, delimiter and encoding found on the first lines, sinks and checksums."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import re
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import col, nan_as_null, text_columns
from ..functions.texts import FILE_MISSING, FILE_MISSING_MORE
from ..operators.clean import Cleaned, clean, clean_names
from .errors import CorruptedFile, EmptyTable, IngestionError, InvalidJson, MissingColumns, Unavailable, UnsupportedFormat
from .objects import opened
from .workbooks import list_sheets, place, read_workbook  # noqa: F401

FORMATS = {".csv": ",", ".tsv": "\t", ".xlsx": None, ".xls": None, ".json": None, ".parquet": None, ".feather": None}
DELIMITERS = (",", ";", "\t", "|")
#: Encodings in the order in which they are tried, with the one by which Spark reads each.
#: Spark has no name for cp1252; bytes 128 to 159, where it differs, are put right after the read.
ENCODINGS = [("utf-8", "UTF-8"), ("utf-8-sig", "UTF-8"), ("cp1252", "ISO-8859-1"), ("latin1", "ISO-8859-1")]
_CP1252_BYTES = [b for b in range(128, 160) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_C1, _CP1252 = "".join(map(chr, _CP1252_BYTES)), bytes(_CP1252_BYTES).decode("cp1252")
_NOT_CP1252 = "[\x81\x8d\x8f\x90\x9d]"
WRAPPERS = ("data", "records", "results", "items", "rows")


@dataclass
class FileMetadata:
    path: str
    name: str
    format: str
    rows: int
    columns: dict[str, str]
    bytes: int
    sha256: str
    loaded_at: str
    actions: list[tuple] = field(default_factory=list)


def extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of a file or of the files in a folder, by any file system that Spark knows."""
    return spark.read.format("binaryFile").load(path)


def file_sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and length of each file, by path; contents are not read."""
    return [(r.path, r.length) for r in file_table(spark, path).select("path", "length").orderBy("path").collect()]


def head_bytes(spark: SparkSession, path: str, most: int = 1 << 16) -> bytes:
    """The first bytes of one file, read as a stream."""
    found = file_sizes(spark, path)
    if not found:  # Spark leaves files without bytes out; a path that is not there fails above
        return b""
    stream = opened(spark, found[0][0])
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()


def in_tasks(path: str) -> bool:
    """Whether tasks can open a file by its path; else only Spark's own readers can."""
    try:
        place(path)
        return True
    except (pa.ArrowInvalid, OSError, ValueError, NotImplementedError):
        return False


def checksum(spark: SparkSession, path: str, algorithm: str = "sha256", most: int = 1 << 22) -> str:
    """Hash of a file's bytes, or of the hashes of a folder's files by their paths.

    Files are read in tasks, a task for each file, at most ``most`` bytes at a time.  Where tasks
    cannot open the path, Spark's reader gives them whole files, 2 GB at most.
    """
    if algorithm not in ("sha256", "sha512", "sha1", "md5"):
        raise ValueError(f"no algorithm '{algorithm}'")
    sizes = file_sizes(spark, path)

    def run(batches):
        for batch in batches:
            names, hashes = batch.column(0).to_pylist(), []
            for name in names:
                store, where = place(name)
                digest = hashlib.new(algorithm)
                with store.open_input_stream(where) as file:
                    while data := file.read(most):
                        digest.update(data)
                hashes.append(digest.hexdigest())
            yield pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string()), "hash": pa.array(hashes, pa.string())})

    if not sizes:
        by_path = {}
    elif all(in_tasks(f) for f, _ in sizes):
        files = spark.createDataFrame([(f,) for f, _ in sizes], "path string").repartition(min(len(sizes), 10_000), "path")
        by_path = dict(files.mapInArrow(run, "path string, hash string").collect())  # a hash for each file
    else:
        digest = {"sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "sha1": F.sha1, "md5": F.md5}[algorithm]
        by_path = dict(file_table(spark, path).select("path", digest(F.col("content"))).collect())
    parts = [by_path[file] for file in sorted(by_path)]
    return parts[0] if len(parts) == 1 else hashlib.new(algorithm, "".join(parts).encode()).hexdigest()


def file_encoding(spark: SparkSession, path: str, head: bytes) -> tuple[str, str, bool]:
    """The first encoding that reads all bytes of a file, and whether a record may span lines; one pass over its lines."""
    value = F.col("value")
    unmapped = F.decode(value.cast("binary"), "ISO-8859-1").rlike(_NOT_CP1252)
    # Where quotes are paired in every line, none is open at its end; lines of blanks alone are only kept by the reader of several lines.
    spans = (F.regexp_count(value, F.lit('"')) % 2 == 1) | value.rlike(r"^\s+$")
    bad = spark.read.text(path).agg(F.count_if(~F.is_valid_utf8(value)).alias("utf8"), F.count_if(unmapped).alias("cp1252"), F.count_if(spans).alias("spans")).first()
    if not bad.utf8:
        return *ENCODINGS[1 if head.startswith(b"\xef\xbb\xbf") else 0], bad.spans > 0
    return *ENCODINGS[3 if bad.cp1252 else 2], bad.spans > 0


def sniff_delimiter(text: str, lines: int = 20) -> str:
    """The candidate that splits all of the first lines into the same number of fields, the more the better."""
    head = [line for line in text.splitlines()[:lines] if line.strip()]
    best, most = ",", 1
    for d in DELIMITERS:
        counts = {len(row) for row in csv.reader(io.StringIO("\n".join(head)), delimiter=d)}
        if len(counts) == 1 and (n := counts.pop()) > most:
            best, most = d, n
    return best


def null_tokens(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Exact tokens that files use for a gap become nulls, in text columns."""
    tokens, texts = tokens or FILE_MISSING + FILE_MISSING_MORE, set(text_columns(df))
    return df.select(*[F.when(~col(c).isin(tokens), col(c)).alias(c) if c in texts else col(c) for c in df.columns])


def _typed(df: DataFrame) -> DataFrame:
    """Whole and decimal numbers and booleans of delimited text; one pass decides for all columns."""
    texts = text_columns(df)
    if not texts:
        return df
    whole, real = r"^\s*[+-]?\d{1,18}\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    misses = lambda c, ok: F.count_if(col(c).isNotNull() & ~ok)
    f = df.agg(*[F.struct(F.count(col(c)).alias("n"), misses(c, col(c).rlike(whole)).alias("i"), misses(c, col(c).rlike(real)).alias("r"), misses(c, F.lower(col(c)).isin("true", "false")).alias("b"), F.count_if(col(c).rlike(r"^\s*0\d")).alias("z")).alias(f"t{i}") for i, c in enumerate(texts)]).first()
    kinds = {}
    for i, c in enumerate(texts):
        if f[i].n and not f[i].z:
            kinds[c] = "bigint" if not f[i].i else "double" if not f[i].r else "boolean" if not f[i].b else None
        elif f[i].n and not f[i].b:
            kinds[c] = "boolean"
    return df.select(*[F.trim(col(c)).try_cast(kinds[c]).alias(c) if kinds.get(c) else col(c) for c in df.columns])


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    most = 1 << 16
    head = head_bytes(spark, path, most)
    if not head.strip():
        raise EmptyTable(f"{path} is empty")
    while len(head) == most and b"\n" not in head and b"\r" not in head:  # the header is longer
        most *= 8
        head = head_bytes(spark, path, most)
    name, encoding, spans = file_encoding(spark, path, head)
    text = head.decode(name, errors="ignore").lstrip("﻿")
    sep = sep or sniff_delimiter(text)
    header = next(csv.reader(io.StringIO(text), delimiter=sep))
    names = [h.strip() or f"Unnamed: {i}" for i, h in enumerate(header)]
    # Rows with more fields than the header are caught by one column more.
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("_over", T.StringType())])
    raw = spark.read.csv(path, schema=schema, sep=sep, header=True, encoding=encoding, multiLine=spans, quote='"', escape='"', enforceSchema=True, mode="PERMISSIVE")
    over = raw.agg(F.count_if(F.col("_over").isNotNull())).first()[0]
    if over:
        raise CorruptedFile(f"{path}: {over} rows have more fields than the header")
    if name == "cp1252":
        raw = raw.select(*[F.translate(col(c), _C1, _CP1252).alias(c) for c in raw.columns])
    return _typed(null_tokens(clean_names(raw.drop("_over").toDF(*_apart(names)))))


def _apart(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        out.append(n if n not in seen else f"{n}_{seen[n]}")
        seen[n] = seen.get(n, 0) + 1
    return out


def _object_in_line(spark: SparkSession, path: str) -> bool:
    """Whether the first line that is not blank, however long, is a whole object: then each line is a record."""
    first = spark.read.text(path).where(F.col("value").rlike(r"\S")).first()
    try:
        json.loads(first[0].lstrip("\ufeff"))
        return True
    except ValueError as error:
        if "Extra data" in str(error):
            raise InvalidJson(f"{path}: several values in a line") from error
        return False


#: Signs that open and close values or strings.
_SIGNS = re.compile(rb'["\\\[\]{}]')
_BLANKS = b" \t\r\n"


class OneValue:
    """Follows brackets and strings of a JSON text, block by block, to where its first value ends."""

    def __init__(self):
        self.depth, self.quoted, self.skip, self.ended, self.more = 0, False, False, False, False

    def feed(self, block: bytes) -> None:
        at = 0
        if self.skip:
            at, self.skip = 1, False
        while at < len(block) and not self.ended:
            sign = _SIGNS.search(block, at)
            if sign is None:
                return
            at, c = sign.end(), sign.group()
            if self.quoted:
                if c == b"\\":
                    at += 1
                    self.skip = at > len(block)
                elif c == b'"':
                    self.quoted = False
            elif c == b'"':
                self.quoted = True
            elif c in b"[{":
                self.depth += 1
            elif c in b"]}":
                self.depth -= 1
                self.ended = self.depth == 0
        self.more = self.more or self.ended and bool(block[at:].strip(_BLANKS))


def _one_value(spark: SparkSession, path: str, block: int = 1 << 22) -> None:
    """Spark reads the first value of a file of several lines; a file with more, or whose value does not end, is refused.  Files are read block by block in tasks."""

    def followed(blocks) -> str | None:
        state = OneValue()
        for data in blocks:
            state.feed(data)
            if state.more:
                return "more than one value"
        return None if state.ended else "the value does not end"

    def of_file(name: str):
        store, where = place(name)
        with store.open_input_stream(where) as file:
            while data := file.read(block):
                yield data

    def run(batches):
        for batch in batches:
            if batch.schema.names == ["path"]:
                found = [followed(of_file(name)) for name in batch.column(0).to_pylist()]
            else:
                found = [followed([data]) for data in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"error": pa.array([e for e in found if e], pa.string())})

    names = [f for f, _ in file_sizes(spark, path)]
    if all(map(in_tasks, names)):
        files = spark.createDataFrame([(f,) for f in names], "path string").repartition(min(max(len(names), 1), 10_000), "path")
    else:
        files = file_table(spark, path).select("content")
    bad = files.mapInArrow(run, "error string").first()
    if bad is not None:
        raise InvalidJson(f"{path}: {bad[0]}")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, one object on each line, or an object with the list under a usual name."""
    head = head_bytes(spark, path).lstrip()
    if not head:
        raise EmptyTable(f"{path} is empty")
    if head[:1] not in (b"[", b"{"):
        raise InvalidJson(f"{path} holds neither objects nor a list of them")
    if head[:1] == b"[" and not head[1:].lstrip().startswith((b"{", b"]")):
        raise InvalidJson(f"{path} is a list of something else than objects")
    lines = head[:1] == b"{" and _object_in_line(spark, path)
    if not lines:
        _one_value(spark, path)
    try:
        df = spark.read.json(path, multiLine=not lines, mode="FAILFAST")
        wrapped = next((w for w in WRAPPERS if head[:1] == b"{" and w in df.columns and isinstance(df.schema[w].dataType, T.ArrayType) and isinstance(df.schema[w].dataType.elementType, T.StructType)), None)
        return df.selectExpr(f"inline(`{wrapped}`)") if wrapped else df
    except PySparkException as error:
        raise InvalidJson(f"{path}: {error}") from error


def _uri(path: str) -> str:
    return path if ":/" in path else os.path.abspath(path)


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """Arrow files, one or a folder of them; each is read batch by batch in the task that gets its name."""
    uri = _uri(path)
    store, root = pa.fs.FileSystem.from_uri(uri)
    whole = store.get_file_info(root).type == pa.fs.FileType.File
    names = [root] if whole else sorted(f.path for f in store.get_file_info(pa.fs.FileSelector(root)) if f.base_name.endswith(".feather"))
    if not names:
        raise EmptyTable(f"{path} holds no files")
    try:
        with store.open_input_file(names[0]) as file:
            empty = spark.createDataFrame(pa.ipc.open_file(file).schema.empty_table())
    except pa.ArrowInvalid as error:
        raise CorruptedFile(f"{path}: {error}") from error
    schema = empty.toArrow().schema

    def run(batches):
        from pyarrow import fs, ipc

        store = fs.FileSystem.from_uri(uri)[0]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(name) as file:
                    reader = ipc.open_file(file)
                    for k in range(reader.num_record_batches):
                        yield from pa.Table.from_batches([reader.get_batch(k)]).cast(schema).to_batches()

    return spark.createDataFrame([(n,) for n in names], "name string").repartition(len(names)).mapInArrow(run, empty.schema)


def write_feather(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of Arrow files, one for each part; a file takes its name when it is whole, and replaced ones go last."""
    uri, job = _uri(path), uuid.uuid4().hex
    store, root = pa.fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    before = [f.path for f in store.get_file_info(pa.fs.FileSelector(root)) if f.type == pa.fs.FileType.File]
    if before and mode not in ("overwrite", "append"):
        raise IngestionError(f"{path} exists")

    def run(batches):
        from pyarrow import fs, ipc

        store, root = fs.FileSystem.from_uri(uri)
        name, draft, rows = f"{root}/part-{TaskContext.get().partitionId():05d}-{job}.feather", f"{root}/.{uuid.uuid4().hex}", 0
        batch = next((b for b in batches if b.num_rows), None)
        if batch is not None:
            with store.open_output_stream(draft) as out, ipc.new_file(out, batch.schema) as writer:
                while batch is not None:
                    writer.write_batch(batch)
                    rows += batch.num_rows
                    batch = next(batches, None)
            store.move(draft, name)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    if not sum(r.rows for r in df.mapInArrow(run, "rows long").collect()):  # a row for each part
        empty = df.limit(0).toArrow()
        with store.open_output_stream(f"{root}/part-00000-{job}.feather") as out, pa.ipc.new_file(out, empty.schema):
            pass
    if mode == "overwrite":
        for name in before:
            store.delete_file(name)


def load_raw(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    kind = extension(path)
    if kind not in FORMATS:
        raise UnsupportedFormat(f"'{kind}' is none of {', '.join(FORMATS)}")
    try:
        if kind in (".csv", ".tsv"):
            return read_delimited(spark, path, "\t" if kind == ".tsv" else None)
        if kind == ".json":
            return read_json(spark, path)
        if kind == ".parquet":
            return nan_as_null(spark.read.parquet(path))
        if kind == ".feather":
            return nan_as_null(read_feather(spark, path))
        if kind == ".xls":
            raise Unavailable("workbooks of the old binary form are not read: save them as xlsx")
        return read_workbook(spark, _uri(path), sheet)
    except (PySparkException, Py4JJavaError) as error:
        raise CorruptedFile(f"{path}: {str(error)[:300]}") from error


def load(spark: SparkSession, path: str, cleaned: bool = True, max_rows: int | None = None, sheet: str | int = 0, required: list[str] | None = None, **options) -> tuple[DataFrame, FileMetadata]:
    """A table and what is known of its file, which must have the ``required`` columns; ``options`` go to the cleaning."""
    df = load_raw(spark, path, sheet)
    if lacking := [c for c in required or [] if c not in df.columns]:
        raise MissingColumns(f"{path} lacks {', '.join(lacking)}")
    if max_rows is not None:
        df = df.limit(max_rows)
    if not df.columns or df.isEmpty():
        raise EmptyTable(f"{path} has no rows")
    done = clean(df, **options) if cleaned else Cleaned(df)
    if not done.df.columns or done.df.isEmpty():
        raise EmptyTable(f"nothing is left of {path} after cleaning")
    size = file_table(spark, path).agg(F.sum("length")).first()[0]
    meta = FileMetadata(path, path.rstrip("/").rsplit("/", 1)[-1], extension(path)[1:], done.df.count(), dict(done.df.dtypes), size, checksum(spark, path), datetime.now(timezone.utc).isoformat(), done.actions)
    return done.df, meta


def save(df: DataFrame, path: str, kind: str | None = None, mode: str = "overwrite") -> None:
    """Write a table as a folder of part files."""
    kind = kind or extension(path)[1:] or "parquet"
    writer = df.write.mode(mode)
    if kind in ("csv", "tsv"):
        writer.csv(path, header=True, sep="\t" if kind == "tsv" else ",", encoding="UTF-8")
    elif kind in ("json", "parquet", "orc"):
        writer.format(kind).save(path)
    elif kind == "feather":
        write_feather(df, path, mode)
    elif kind in ("pkl", "pickle"):
        raise UnsupportedFormat("pickles can run code when they are read; use parquet")
    else:
        raise UnsupportedFormat(f"no writer for '{kind}'")


def export_csv(df: DataFrame, path: str, manifest: dict | None = None, most_rows: int = 1_000_000) -> None:
    """One file of delimited text with byte-order mark, and a manifest beside it, for spreadsheets.

    Such a file is written by the driver, row by row; larger tables are refused and go to :func:`save`.
    """
    if df.limit(most_rows + 1).count() > most_rows:
        raise IngestionError(f"over {most_rows} rows: use save()")
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(df.columns)
        for row in df.toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])
    if manifest is not None:
        with open(f"{path}.manifest.json", "w", encoding="utf-8") as out:
            json.dump(manifest, out, indent=2, default=str)


def records(df: DataFrame) -> DataFrame:
    """One JSON object for each row."""
    return df.select(F.to_json(F.struct(*[col(c) for c in df.columns])).alias("value"))
