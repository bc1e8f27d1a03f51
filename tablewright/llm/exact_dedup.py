"""Exact deduplication with disk-backed streaming state.

A stream over the documents' digests keeps, without expiry, one entry for each
digest in RocksDB: the stable identifier of the document that stays (the largest
``doc_id``), the locator of its content (file and row) and the number of rows.
After the stream has taken all that is available, the state is read as a table.
Each call has a state of its own.

A hit (a row whose digest has others) is compared byte by byte with the row that
stays; only rows and texts that a bitmap of fixed size takes for hits are
shuffled.  Should a digest ever stand for different texts, those texts are grouped
again by their bytes.

Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of
rows with the same text and the same ``doc_id``, the one with the greatest
locator stays; a null ``doc_id`` is smaller than any other.  Everything here is
DataFrame and SQL functions.  Other columns are not read, except by
:func:`drop_exact_copies`, which returns them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, new_folder, written

#: Parts of all rows from which on a digest counts as hot; there can be no more hot digests than this number.
HOT_PART = 5_000
#: Rows of one group that are compared with its kept row in one task.
GROUP_SLICE = 512
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the stream: state on disk, native memory bounded, no disk space set aside before it is used.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def folded(text: Column) -> Column:
    """Lower-case A-Z only; texts of ASCII alone take the faster function, which does the same to them."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def located(docs: DataFrame) -> DataFrame:
    """doc_id, text and the locator columns ``file`` and ``place``; a table that is not read from files is written first."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    try:
        return docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        return located(written(docs, "documents"))


def _keyed_by_stream(rows: DataFrame, folder: str, most_bytes: int) -> DataFrame:
    """Run the stream over the files of ``rows`` and return its state: digest, kept row, number of rows."""
    spark, source, checkpoint = rows.sparkSession, f"{folder}/rows", f"{folder}/stream"
    rows.write.parquet(source)
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", most_bytes).parquet(source)
        state = stream.groupBy("key").agg(F.max(F.struct("doc_id", "file", "place", "rest")).alias("kept"), F.count("*").alias("n"))
        state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        held = spark.read.format("statestore").load(checkpoint)
        names = held.schema["value"].dataType.names
        return written(held.select(F.col("key.key").alias("key"), F.col("value")[names[0]].alias("kept"), F.col("value")[names[1]].alias("n")), "state")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def label_copies(docs: DataFrame, key_bytes: int = 32, most_bytes: int = 16 << 30) -> DataFrame:
    """Every row with doc_id, file, place, digest, keep (struct of the row that stays), n (rows of its group).

    ``key_bytes`` shortens the state's key (tests use this to bring about
    collisions).  ``most_bytes`` bounds what one micro-batch reads.
    """
    from .decontaminate import among  # that module imports this one

    spark = docs.sparkSession
    source, folder = located(docs), new_folder(docs.sparkSession, "exact-dedup")
    digest = F.unhex(F.sha2(folded(F.col("text")), 256))
    # The key and the rest of its digest, so that no byte of it is kept or sent twice.
    digests = source.select("doc_id", "file", "place", digest.alias("digest"))
    state = _keyed_by_stream(digests.select("doc_id", "file", "place", F.substring("digest", 1, key_bytes).alias("key"), F.substring("digest", key_bytes + 1, 32).alias("rest")), folder, most_bytes)
    rows = spark.read.parquet(f"{folder}/rows")
    total = state.agg(F.sum("n")).first()[0] or 0
    several = state.where(F.col("n") > 1)
    hot = F.col("n") * HOT_PART > total  # at most HOT_PART digests, so they can be broadcast
    few = F.broadcast(several.where(hot).select("key", "kept", "n"))
    many = several.where(~hot).select(F.col("key").alias("k"), F.col("kept").alias("kept_b"), F.col("n").alias("n_b"))
    known = among(rows, several, "key").join(few, "key", "left")
    columns = ["key", "doc_id", "file", "place", "rest", "kept", "n"]
    cold = known.where(F.col("n").isNull()).drop("kept", "n").join(many, F.col("key") == F.col("k")).withColumns({"kept": F.col("kept_b"), "n": F.col("n_b")}).select(columns)
    # A row whose digest no other row has is all that the state holds of it, and is sent nowhere.
    alone = state.where(F.col("n") == 1).select("key", "kept.doc_id", "kept.file", "kept.place", "kept.rest", "kept", "n")
    labelled = known.where(F.col("n").isNotNull()).select(columns).unionByName(cold).unionByName(alone)
    kept = F.struct(*[F.col(f"kept.{c}").alias(c) for c in ("doc_id", "file", "place")])
    labelled = written(labelled.select("key", "doc_id", "file", "place", F.concat("key", "rest").alias("digest"), kept.alias("kept"), "n"), "labelled")
    changed = _disagreeing(source, labelled)
    if changed is None:
        return labelled
    at = ["file", "place"]
    changed = changed.select(*at, F.col("kept").alias("kept_c"), F.col("n").alias("n_c"))
    return labelled.join(changed, at, "left").select("key", "doc_id", *at, "digest", F.coalesce("kept_c", "kept").alias("kept"), F.coalesce("n_c", "n").alias("n"))


def _disagreeing(source: DataFrame, labelled: DataFrame) -> DataFrame | None:
    """Compare the bytes of all hits with the kept rows; rows of the keys that hold different texts, grouped by their bytes."""
    from .decontaminate import among

    at = ["file", "place"]
    hits = labelled.where(F.col("n") > 1).select(*at, "key", "kept", "n", ((F.col("kept.file") == F.col("file")) & (F.col("kept.place") == F.col("place"))).alias("stays"))
    # Only texts that a bitmap of the hits' places, of one size for every table, lets through are sent on.
    texts = written(among(source, hits, *at).select("doc_id", *at, folded(F.col("text")).alias("bytes")).join(hits, at), "hits")
    slices = F.ceil(F.col("n") / GROUP_SLICE).cast("int")
    stays = texts.where("stays").select("key", F.col("bytes").alias("kept_bytes"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    others = texts.where(~F.col("stays")).select("key", "bytes", F.pmod(F.xxhash64(*at), slices).cast("int").alias("slice"))
    wrong = others.join(stays, ["key", "slice"]).where(F.col("bytes") != F.col("kept_bytes")).select("key").distinct()
    wrong = written(wrong, "collisions")
    if wrong.isEmpty():
        return None
    rows = texts.join(wrong, "key", "left_semi").select("doc_id", *at, "key", "bytes")
    exact = rows.groupBy("key", "bytes").agg(F.max(F.struct("doc_id", *at)).alias("kept"), F.count("*").alias("n"))
    return rows.join(exact, ["key", "bytes"]).select(*at, "kept", "n")


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    kept = (F.col("kept.file") == F.col("file")) & (F.col("kept.place") == F.col("place"))
    return label_copies(docs, **options).select("doc_id", F.col("kept.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that do not stay; all columns."""
    columns = docs.columns
    try:
        rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        return drop_exact_copies(written(docs, "documents"), **options)
    gone = label_copies(docs, **options).where((F.col("kept.file") != F.col("file")) | (F.col("kept.place") != F.col("place"))).select("file", "place")
    return rows.join(gone, ["file", "place"], "left_anti").select("row.*")


def forget_state(spark: SparkSession, folder: str) -> None:
    """Delete a state that no later run will go on from."""
    from .shared import drop_folder

    drop_folder(spark, folder)
