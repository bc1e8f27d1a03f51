"""Spelling variants: words that differ by one code point, grouped without forming pairs.

Words are runs of letters, counted over the whole collection.  A word that stands
for itself in a group of spellings is never compared with another one.  For each
position it enters the group (position, prefix, suffix) of all words that differ
there alone; such a group holds at most one word for each letter and keeps only
its size and its two top words, so every member reads off how many others there
are and which of them is the top one.  Words that differ by an insertion or a
deletion meet where the shorter one, from the vocabulary, joins the other one's
deletions, in a group of the same kind: at most one word for each place and
letter.  No group grows with the collection, whatever words are frequent in it.

Words are numbered by falling count, then by code points, so that the top word of
a group is the smallest number, and groups hold numbers only.  Groups of words
longer than ``LONG`` are known by a 128-bit hash of prefix and suffix instead of
their letters.  From each word its form, the near word of largest count if that
is at least twice its own, is followed to the last one by doubling steps; counts
rise along the way, so it ends.

Null texts have no words; a null ``doc_id`` counts as an empty one where runs are
altered.  Repeated rows count as often as they are there; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .near_dedup import look_up
from .shared import LOWER, UPPER, written

#: Fewest code points and fewest occurrences of a word.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: How many times as frequent as a word its form is.
FORM_RATIO = 2
#: Code points from which on groups are known by hashes.
LONG = 64
#: Stands for the position that is left open; no letter.
OPEN = "*"
#: What a word is in a group: the word that the group is named by, one with that position open, or one with a letter more.
OWN, OPENED, SHORTER = 0, 1, 2
RUN = r"[A-Za-zÀ-ÿ]"
#: Rolling hashes of long words: letters times powers of each base, by a prime; together 124 bits.
PRIME = (1 << 31) - 1
BASES = [742_938_285, 950_706_376, 1_226_874_159, 62_089_911]


def lowered(run: Column) -> Column:
    """Lower-case A-Z only."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).when(run.rlike("[A-Z]"), F.translate(run, UPPER, LOWER)).otherwise(run)


def runs_of(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id and run (A-Z lower-cased) of all maximal runs of at least so many letters."""
    # A shorter run has no such match, and a longer one is taken from its start to its end.
    runs = F.regexp_extract_all(docs["text"], F.lit(f"{RUN}{{{least},}}"), F.lit(0))
    return docs.select(docs["doc_id"].alias("doc_id"), F.explode(runs).alias("run")).select("doc_id", lowered(F.col("run")).alias("run"))


def with_misprints(runs: DataFrame, every: int = 97) -> DataFrame:
    """word of each row: the run, less one code point where the checksum of ``doc_id:run`` is a multiple of ``every``."""
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    checked = runs.withColumn("h", F.crc32(F.concat(number, F.lit(":"), F.col("run")).cast("binary")))
    place = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    return checked.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary_of(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n and rank of the words of ``words``, written; ranks rise as counts fall, then by code points."""
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    counted = written(counted, "words")
    return written(counted.orderBy(F.desc("n"), "word").withColumn("rank", F.monotonically_increasing_id()), "vocabulary")


def _powers(base: int, n: int) -> np.ndarray:
    found = np.ones(max(n, 1), np.uint64)
    size, step = 1, base
    while size < n:
        found[size : 2 * size] = found[:size][: n - size] * np.uint64(step) % np.uint64(PRIME)
        size, step = 2 * size, step * step % PRIME
    return found[:n]


def long_groups(word: str) -> Iterator[tuple[int, np.ndarray]]:
    """Kind and keys (rows of six numbers: length, place or 0, four hashes) of a word's groups; for words too long to be spelt out once for each place."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n, prime = len(codes), np.uint64(PRIME)
    whole, opened, shorter = [], [], []
    for base in BASES:
        terms = codes * _powers(base, n) % prime
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        before, after = upto[:-1], upto[-1] - upto[1:]
        whole.append(upto[-1:] % prime)
        opened.append((before + after) % prime)
        # What follows a letter that is left out moves down by one power.
        shorter.append((before + after % prime * np.uint64(pow(base, -1, PRIME))) % prime)
    # To leave out any one of equal letters side by side gives the same string.
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    keyed = lambda hashes, length, places: np.stack([np.full(len(places), length, np.uint64), places, *hashes], 1)
    yield OWN, keyed(whole, n, np.zeros(1, np.uint64))
    yield OPENED, keyed(opened, n, np.arange(1, n + 1, dtype=np.uint64))
    yield SHORTER, keyed([h[first] for h in shorter], n - 1, np.zeros(len(first), np.uint64))


_GROUPED = "key binary, rank long, kind int"


def _long_rows(vocabulary: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, rank in zip(batch.column("word").to_pylist(), batch.column("rank").to_pylist()):
                for kind, keys in long_groups(word):
                    if kind == SHORTER and len(word) == LONG + 1:
                        continue  # these are spelt out
                    # A byte that no letter has tells hashes from what is spelt out.
                    flat = np.concatenate([np.zeros((len(keys), 1), np.uint8), np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), -1)], 1)
                    keyed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(flat.shape[1]), len(flat), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([keyed, pa.array(np.full(len(flat), rank, np.int64)), pa.array(np.full(len(flat), kind, np.int32))], names=["key", "rank", "kind"])

    return vocabulary.where(F.length("word") > LONG).select("word", "rank").mapInArrow(run, _GROUPED)


def grouped(vocabulary: DataFrame) -> DataFrame:
    """key, rank and kind: every word once in each of its groups."""
    word, size = F.col("word"), F.length("word")
    before = lambda i: F.substring(word, F.lit(1), i - 1)
    after = lambda i: F.substring(word, i + 1, size)
    places = F.sequence(F.lit(1), size)
    opened = F.transform(places, lambda i: F.concat(before(i), F.lit(OPEN), after(i)))
    shorter = F.array_distinct(F.transform(places, lambda i: F.concat(before(i), after(i))))
    rows = lambda where, keys, kind: vocabulary.where(where).select(keys.alias("key"), "rank").select(F.col("key").cast("binary").alias("key"), "rank", F.lit(kind).alias("kind"))
    found = rows(size <= LONG, word, OWN).union(rows(size <= LONG, F.explode(opened), OPENED)).union(rows(size <= LONG + 1, F.explode(shorter), SHORTER))
    return found.union(_long_rows(vocabulary))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """rank, n_near and best (the smallest rank of a near word) of every word that has near words."""
    rows = Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    facts = {"size": F.count("*"), "top": F.min("rank"), "second": F.nth_value("rank", 2), "word": F.max(F.when(F.col("kind") == OWN, F.col("rank")))}
    held = grouped(vocabulary).select("rank", "kind", *[f.over(rows).alias(k) for k, f in facts.items()])
    shorter = F.col("kind") == SHORTER  # such a word is near the group's own word alone; others are near all of their group
    near = F.when(shorter, F.col("word").isNotNull().cast("long")).otherwise(F.col("size") - 1)
    best = F.when(shorter, F.col("word")).when(F.col("top") == F.col("rank"), F.col("second")).otherwise(F.col("top"))
    return held.select("rank", near.alias("near"), best.alias("best")).where("near > 0").groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """rank and last of rows (rank, to): where following ``to`` ends.  Each round doubles the steps taken."""
    steps = written(forms.select("rank", F.col("to").alias("last")), "forms")
    while True:
        further = steps.select(F.col("rank").alias("last"), F.col("last").alias("further"))
        on = look_up(steps, "last", further, "rank", "left")
        on = written(on.select("rank", F.coalesce("further", "last").alias("last"), F.col("further").isNotNull().alias("moved")), "forms")
        if on.where("moved").isEmpty():
            return on.drop("moved")
        steps = on.drop("moved")


def variants(vocabulary: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of a vocabulary (word, n, rank)."""
    known = vocabulary.select("rank", "word", "n")
    form = known.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = known.select("rank", "n").join(near_words(vocabulary), "rank").join(form, "best", "left")
    valid = F.col("form_n") >= F.col("n") * ratio
    near = written(found.select("rank", "n_near", *[F.when(valid, F.col(c)).alias(a) for c, a in (("best", "to"), ("form", "form"), ("form_n", "form_n"))]), "near")
    last = last_forms(near.where("to IS NOT NULL"))
    roots = look_up(last, "last", known.select(F.col("rank").alias("last"), F.col("word").alias("root")), "rank").select("rank", "root")
    every = known.join(near, "rank", "left").join(roots, "rank", "left")
    return every.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, every: int = 97) -> DataFrame:
    """Words of ``docs`` (runs, some with a letter left out) with their near words, forms and roots."""
    return variants(vocabulary_of(with_misprints(runs_of(docs), every)))
