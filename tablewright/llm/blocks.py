"""Questions from blocks of documents to buckets of hashes, in rounds.

Documents are dealt once into blocks of bounded size by a hash of their number.
In a round, each block asks about distinct items: it sends compact numpy arrays,
one payload for each bucket (a range of the hash space), and gets one byte back
for each item.  An item costs a few bytes in the shuffle, is sent once for a
block however often it occurs there, and hot items meet as one entry for each
block, so no task gathers the copies of anything.

There are at most as many payloads as blocks times buckets, and never more than
items.  Blocks grow with the square root of the collection up to a bound (a task
takes about 20 times a block), and a bucket serves several blocks' worth of text,
so that a payload holds more than one item up to about 50 TB of text.

Later rounds see all earlier answers, and all rounds are one plan, so the texts
and each round's answers are shuffled once and these exchanges are reused.  Nothing is kept outside Spark's
own shuffles, and lost executors are dealt with by its retries.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for a null doc_id, which is smaller than any other.
NO_DOC = -(1 << 63)
#: Blocks of a small collection, and bytes of text in a block of a collection of up to 1 GB and of a large one.
LEAST_BLOCKS, BLOCK_BYTES, MOST_BLOCK_BYTES = 8, 6_000_000, 16_000_000
QUESTION = "bucket int, blk int, round int, payload binary"
_QUESTION = pa.schema([("bucket", pa.int32()), ("blk", pa.int32()), ("round", pa.int32()), ("payload", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    heads = np.array([a.nbytes for a in arrays], "<i8").tobytes()
    return heads + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(payload: bytes, *types) -> list[np.ndarray]:
    sizes = np.frombuffer(payload, "<i8", len(types))
    found, at = [], 8 * len(types)
    for size, kind in zip(sizes, types):
        found.append(np.frombuffer(payload, kind, size // np.dtype(kind).itemsize, at))
        at += int(size)
    return found


class Deal:
    """Items of a block in the order of their buckets."""

    def __init__(self, buckets: np.ndarray):
        self.order = np.argsort(buckets, kind="stable")
        held = buckets[self.order]
        self.cuts = np.flatnonzero(np.diff(held, prepend=-1, append=1 << 40))
        self.buckets = held[self.cuts[:-1]]

    def questions(self, *arrays: np.ndarray) -> list[tuple[int, bytes]]:
        arrays = [a[self.order] for a in arrays]
        return [(int(b), pack(*(a[s:e] for a in arrays))) for b, s, e in zip(self.buckets, self.cuts[:-1], self.cuts[1:])]

    def back(self, answers: dict[int, bytes]) -> np.ndarray:
        """The byte for each item, in the items' own order."""
        found = np.zeros(len(self.order), np.uint8)
        if len(self.order):
            found[self.order] = np.frombuffer(b"".join(answers[int(b)] for b in self.buckets), np.uint8)
        return found


class Block:
    """What a block's function sees: its rows by ascending doc_id, and the answers of earlier rounds."""

    def __init__(self, rows: pa.Table, answers: pa.Table | None, number: int, buckets: int):
        rows = rows.combine_chunks().sort_by([("doc_id", "ascending")])
        self.number, self.buckets = number, buckets
        self.doc_ids = rows.column("doc_id").to_numpy()
        texts = rows.column("text")
        self.texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        if isinstance(self.texts, pa.ChunkedArray):
            self.texts = self.texts.chunk(0) if self.texts.num_chunks else pa.array([], pa.string())
        self.answers: dict[int, dict[int, bytes]] = {}
        for bucket, level, payload in zip(*(answers.column(c).to_pylist() for c in ("bucket", "round", "payload"))) if answers is not None else ():
            self.answers.setdefault(level, {})[bucket] = payload

    def answered(self, level: int) -> dict[int, bytes]:
        return self.answers.get(level, {})

    def replies(self, level: int) -> np.ndarray:
        """The bytes of all replies, in the order in which the items were dealt, without notes."""
        found = self.answered(level)
        return np.frombuffer(b"".join(found[b] for b in sorted(found) if b >= 0), np.uint8)


def sizes_of(total: int, block_bytes: int | None, bucket_bytes: int, least_buckets: int = LEAST_BLOCKS) -> tuple[int, int]:
    """Numbers of blocks and of buckets for so many bytes of text."""
    own = block_bytes or min(MOST_BLOCK_BYTES, int(BLOCK_BYTES * max(1.0, (total / 1e9) ** 0.5)))
    return max(LEAST_BLOCKS, math.ceil(total / own)), max(least_buckets, math.ceil(total / bucket_bytes))


class Rounds:
    """``bucket_bytes`` is the text whose items one bucket answers for; ``least_buckets`` keeps small collections spread."""

    def __init__(self, docs: DataFrame, block_bytes: int | None, bucket_bytes: int, least_buckets: int = LEAST_BLOCKS):
        docs = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_DOC)).alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.count, self.buckets = sizes_of(size, block_bytes, bucket_bytes, least_buckets)
        # Rows without a number are dealt by their text.
        spread = F.when(F.col("doc_id") == NO_DOC, F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
        self.blocks = docs.select(F.pmod(spread, F.lit(self.count)).cast("int").alias("blk"), "doc_id", "text")
        self.answers: DataFrame | None = None
        self.round = 0

    def _over_blocks(self, work: Callable[[Block], pa.Table], schema) -> DataFrame:
        buckets = self.buckets
        if self.answers is None:
            return self.blocks.groupBy("blk").applyInArrow(lambda key, rows: work(Block(rows, None, key[0].as_py(), buckets)), schema)
        sides = self.blocks.groupBy("blk").cogroup(self.answers.groupBy("blk"))
        empty = pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
        return sides.applyInArrow(lambda key, rows, answers: work(Block(rows if rows.num_rows else empty, answers, key[0].as_py(), buckets)), schema)

    def ask(self, questions: Callable[[Block], list[tuple[int, bytes]]], answer: Callable[[list[bytes]], list[bytes]], dear: bool = False) -> None:
        """One round.  ``answer`` gets a bucket's payloads and gives one reply for each; a negative bucket is the block's own note, kept as it is.

        Tasks of a ``dear`` answer are as many as Spark's shuffle partitions, however few bytes they read.
        """
        level = self.round

        def emit(block: Block) -> pa.Table:
            found = questions(block)
            return pa.Table.from_pydict({"bucket": [b for b, _ in found], "blk": [block.number] * len(found), "round": [level] * len(found), "payload": [p for _, p in found]}, schema=_QUESTION)

        def reply(key, rows):
            if key[0].as_py() < 0:
                return rows.select(["bucket", "blk", "round", "payload"])
            # Payloads come in any order; blocks' numbers make the result the same each time.
            rows = rows.combine_chunks().sort_by([("blk", "ascending")])
            return pa.Table.from_pydict({"bucket": rows.column("bucket"), "blk": rows.column("blk"), "round": rows.column("round"), "payload": answer(rows.column("payload").to_pylist())}, schema=_QUESTION)

        # A union of tables that are dealt alike stays so: later rounds use each round's exchange again, where they made all replies anew.
        asked = self._over_blocks(emit, QUESTION)
        if dear:
            asked = asked.repartition(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket")
        answers = asked.groupBy("bucket").applyInArrow(reply, QUESTION).repartition("blk")
        self.answers = answers if self.answers is None else self.answers.union(answers)
        self.round += 1

    def finish(self, work: Callable[[Block], pa.Table], schema: str) -> DataFrame:
        return self._over_blocks(work, schema)


def distinct(held: np.ndarray) -> np.ndarray:
    """The distinct ones of sorted numbers; where nothing else is asked for, np.unique builds a slow table of them."""
    return held[np.concatenate([[True], held[1:] != held[:-1]])[: len(held)]]


def note_bucket(block: Block) -> int:
    """Where a block leaves notes for its own later rounds."""
    return -1 - block.number


def repeated_elsewhere(payloads: list[bytes]) -> list[bytes]:
    """1 for each 32-bit remainder that two or more blocks hold."""
    held = [unpack(p, np.uint32)[0] for p in payloads]
    every = np.sort(np.concatenate(held))
    twice = distinct(every[1:][every[1:] == every[:-1]])
    found = []
    for own in held:
        at = np.minimum(np.searchsorted(twice, own), max(len(twice) - 1, 0))
        found.append((twice[at] == own if len(twice) else np.zeros(len(own), bool)).astype(np.uint8).tobytes())
    return found


def first_holder(payloads: list[bytes], *order) -> list[bytes]:
    """1 for each 128-bit item that another block holds with a smaller key; payloads have the items' halves, then the keys' columns."""
    held = [unpack(p, np.uint64, np.uint64, *order) for p in payloads]
    sizes = [len(h[0]) for h in held]
    columns = [np.concatenate(c) for c in zip(*held)]
    by = np.lexsort((*columns[:1:-1], columns[1], columns[0]))
    columns = [c[by] for c in columns]
    new = np.ones(len(by), bool)
    new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
    first = np.flatnonzero(new)
    spread = np.repeat(first, np.diff(first, append=len(by)))
    later = np.zeros(len(by), np.uint8)
    for c in columns[2:]:  # equal keys are not smaller than one another
        later[by[c != c[spread]]] = 1
    return [p.tobytes() for p in np.split(later, np.cumsum(sizes)[:-1])]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket from the upper half of well-mixed hashes; the lower half stays free as the remainder."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
