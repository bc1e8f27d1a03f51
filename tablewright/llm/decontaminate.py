"""Benchmark decontamination by size-partitioned MinHash containment search.

Words are runs outside white space after lower-casing A-Z; shingles are five
words, and a shorter text is one shingle.  A document holds an item when it has
at least ``share`` of the item's distinct shingles.

An item of n distinct shingles must share c = ceil(share * n) of them, so among any
n - c + 1 of its shingles at least one lies in every document that holds it.  The
n - c + 1 smallest hashes of each item, its bottom-k MinHash sketch, are kept, and no
document can be missed, however much longer it is than the item.  Items are
partitioned by size, a partition for each power of two of c.  Documents are probed with the
hashes of all their shingles, in the partitions whose items are not too large for
them; a document that meets a sketch is a candidate.  Candidates are verified by
the exact intersection of the shingles themselves.

Texts are only sent on where a bitmap of the candidates' places, of the same size for
every table, lets them through; it lets all candidates through.

Null texts have no shingles and hold nothing; an item without words is held by
nothing.  Repeated items and rows are judged each.  Everything here is DataFrame
and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import folded, located
from .shared import SPACE, written

#: Sketch hashes up to which they are broadcast (about 24 bytes each); beyond, the probe is a shuffle join.
BROADCAST_HASHES = 1_000_000
#: Rows of one item, or probes of one hash, are spread over so many keys when they are shuffled.
ITEM_SALTS = 32
#: Buckets of a bitmap (fixed by Spark: 32,768 bits each); 2 MB, which is broadcast.
BUCKETS, BUCKET_BITS = 512, 32_768


def words(text: Column) -> Column:
    return F.array_remove(F.split(folded(text), SPACE), "")


def shingles(text: Column, n: int = 5, hashed: bool = False) -> Column:
    """Array of the text's shingles, as strings or as 64-bit hashes; a shorter text is one shingle, no words none."""
    join = (lambda parts: F.xxhash64(*parts)) if hashed else (lambda parts: F.concat_ws(" ", *parts))
    short = (lambda w: F.xxhash64(F.array_join(w, " "))) if hashed else (lambda w: F.array_join(w, " "))

    def of(w: Column) -> Column:
        size = F.size(w)
        windows = F.transform(F.sequence(F.lit(0), size - n), lambda i: join([F.get(w, i + k) for k in range(n)]))
        return F.when(size >= n, windows).when(size > 0, F.array(short(w))).otherwise(F.array().cast("array<bigint>" if hashed else "array<string>"))

    # The words are bound once, so that they are not split again for each shingle.
    return F.transform(F.array(words(text)), of)[0]


def size_class(size: Column) -> Column:
    """The bits of a number: a partition for each power of two."""
    return F.length(F.bin(size))


def item_sketches(items: DataFrame, share: float, n: int) -> DataFrame:
    """item, shingles (distinct), needed, the partition of that size, and sketch: the smallest hashes, of which one is met by all that hold the item."""
    # Strings and hashes come in the same order, so the distinct ones pair up.
    sized = items.select("item", F.array_distinct(shingles(F.col("text"), n)).alias("shingles"), F.array_sort(F.array_distinct(shingles(F.col("text"), n, hashed=True))).alias("hashes"))
    sized = sized.where(F.size("shingles") > 0)
    needed = F.ceil(F.size("shingles") * F.lit(share) - 1e-9).cast("int")
    sized = sized.withColumn("needed", F.greatest(F.lit(1), needed))
    return sized.select("item", "shingles", "needed", size_class(F.col("needed")).alias("partition"), F.slice("hashes", 1, F.size("shingles") - F.col("needed") + 1).alias("sketch"))


def among(rows: DataFrame, wanted: DataFrame, *columns: str, others: bool = False) -> DataFrame:
    """Rows whose ``columns`` occur in ``wanted``, and some that share a bit with one of those; or else the others, of which none occurs.

    ``wanted`` becomes one bitmap of ``BUCKETS`` buckets at most, however many rows it has.
    """
    bit = F.pmod(F.xxhash64(*columns), F.lit(BUCKETS * BUCKET_BITS)) + 1
    maps = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
    return rows.join(F.broadcast(maps), (F.bitmap_bucket_number(bit) == F.col("_bucket")) & is_set, "left_anti" if others else "left_semi")


def find_contained(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, n: int = 5) -> DataFrame:
    """doc_id, file, place, item_id, n_item, n_shared and containment of each document and item that it holds."""
    source = located(docs)
    items = benchmark.select(F.struct(benchmark["item_id"], F.monotonically_increasing_id().alias("row")).alias("item"), benchmark["text"])
    items = written(item_sketches(items, share, n), "items")
    sketch = items.select(F.explode("sketch").alias("hash"), "item", "partition")
    salts = F.explode(F.sequence(F.lit(0), F.lit(ITEM_SALTS - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("file", "place"), F.lit(ITEM_SALTS)).cast("int")
    hashed = source.select("file", "place", shingles(F.col("text"), n, hashed=True).alias("hashes"))
    # Spark would filter a plain explode by the array's size, and a size that can be null, and so make the hashes twice or
    # three times; a null hash meets nothing below.
    largest = F.coalesce(size_class(F.size("hashes")), F.lit(0))
    probes = hashed.withColumn("largest", largest).select("file", "place", "largest", F.explode_outer("hashes").alias("hash"))
    if sketch.count() <= BROADCAST_HASHES:
        met = probes.join(F.broadcast(sketch), "hash")
    else:
        met = among(probes, sketch, "hash").withColumn("salt", salt).join(sketch.select("*", salts).hint("merge"), ["hash", "salt"])
    candidates = written(met.where("partition <= largest").select("file", "place", "item").distinct(), "candidates")
    # The same plan at every size: texts are dealt by their place, never by a list that is sent everywhere.
    places = candidates.select("file", "place").distinct()
    held = among(source, candidates, "file", "place").join(places.hint("merge"), ["file", "place"]).select("doc_id", "file", "place", F.array_distinct(shingles(F.col("text"), n)).alias("own"))
    spread = items.select("item", "shingles", "needed", salts)
    pairs = candidates.withColumn("salt", salt).join(spread, ["item", "salt"]).join(held, ["file", "place"]).where(F.size("own") >= F.col("needed"))
    shared = F.size(F.array_intersect("shingles", "own")).cast("long")
    size = F.size("shingles").cast("long")
    found = pairs.select("doc_id", "file", "place", F.col("item.item_id").alias("item_id"), size.alias("n_item"), shared.alias("n_shared"), "needed")
    return found.where(F.col("n_shared") >= F.col("needed")).select("doc_id", "file", "place", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, n_item, n_shared and containment: only documents that hold an item have rows."""
    return find_contained(docs, benchmark, **options).select("doc_id", "item_id", "n_item", "n_shared", F.round("containment", 6).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold an item of ``benchmark``; all columns."""
    from pyspark.errors import AnalysisException

    try:
        rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        return drop_contaminated(written(docs, "documents"), benchmark, **options)
    gone = written(find_contained(docs, benchmark, **options).select("file", "place").distinct(), "contaminated")
    judged = among(rows, gone, "file", "place").join(gone.hint("merge"), ["file", "place"], "left_anti")
    return among(rows, gone, "file", "place", others=True).unionByName(judged.select("row", "file", "place")).select("row.*")
