"""Packing by lexical retrieval: neighbours of a seed document fill its window.

A shard is a run of documents of one input partition with about
``shard_tokens`` ids.  Its BM25 inverted index (terms are token ids) is built
with numpy.  A window starts with the rest of the document that the last one
cut, or with the next unused document as the seed; the index ranks the unused
documents for all of the seed's terms, and they follow in that order until the
window is full or no document shares a term with the seed.  The document that crosses the end is cut there, so
windows hold exactly ``window`` ids.  What is left at the end of a shard goes
to windows whose lengths are powers of two, so that nothing is padded.

Windows are numbered over the whole collection: a window's number is its number
in its partition plus the prefix sum of the partitions before it.

Each task packs what it reads and nothing is shuffled, so a hot source, a
group of copies or a very long document cannot gather in one task.

Null texts count as empty and hold the end id alone.  Repeated rows are packed
each.  An empty table gives no pieces.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_slices, written
from .token_files import crc32_of, with_end
from .tokens import encoder

PIECES = "part int, local_sequence long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long"
_SCHEMA = pa.schema([("part", pa.int32()), ("local_sequence", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())])


class LexicalIndex:
    """BM25 over token ids, for the documents of one shard.

    Terms of an eighth of the documents or more have a row of weights for all
    documents; the others have posting lists.  Postings of documents that are used
    drop out each time that an eighth of those held are used.
    """

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, k1: float = 1.2, b: float = 0.75):
        self.n = n = len(offsets) - 1
        sizes = np.diff(offsets)
        owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
        pairs = np.sort(ids.astype(np.int64) << 32 | owner)
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        tf = np.diff(first, append=len(pairs)).astype(np.float64)
        pairs = pairs[first]
        term, doc = pairs >> 32, pairs & 0xFFFFFFFF
        df = np.diff(np.flatnonzero(np.diff(term, prepend=-1)), append=len(term))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * sizes / max(sizes.mean(), 1))
        which = np.repeat(np.arange(len(df)), df)
        weight = idf[which] * tf * (k1 + 1) / (tf + norm[doc])
        # A document's query: its terms that some other document has, those with rows of weights first.
        wide = df * 8 >= n
        self.row_of = np.cumsum(wide) - 1
        useful = np.flatnonzero(df[which] > 1)
        useful = useful[np.lexsort((~wide[which[useful]], doc[useful]))]
        self.terms, self.at = which[useful], np.searchsorted(doc[useful], np.arange(n + 1))
        self.wide_terms = np.add.reduceat(np.append(wide[self.terms], False), self.at[:-1]) * (np.diff(self.at) > 0) if n else np.zeros(0, np.int64)
        dense = wide[which]
        self.rows = np.zeros((int(wide.sum()), n))
        self.rows[self.row_of[which[dense]], doc[dense]] = weight[dense]
        self.live, self.held = np.arange(n), n
        self._hold(which[~dense], doc[~dense], weight[~dense], len(df))

    def _hold(self, which: np.ndarray, doc: np.ndarray, weight: np.ndarray, terms: int) -> None:
        self.which, self.doc, self.weight, self.n_terms = which, doc, weight, terms
        self.cuts = np.searchsorted(which, np.arange(terms + 1)).tolist()

    def forget(self, used: np.ndarray) -> None:
        """Take used documents out of rows and postings; what is left keeps its weights."""
        keep = ~used[self.live]
        number = np.cumsum(keep) - 1
        self.live, self.rows = self.live[keep], np.compress(keep, self.rows, 1)  # stays in row order
        stays = keep[self.doc]
        self._hold(self.which[stays], number[self.doc[stays]], self.weight[stays], self.n_terms)
        self.held = len(self.live)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document in ``live`` for the seed's terms."""
        terms = self.terms[self.at[seed] : self.at[seed + 1]]
        wide, rare = terms[: self.wide_terms[seed]], terms[self.wide_terms[seed] :].tolist()
        total = self.rows[self.row_of[wide]].sum(0) if len(wide) else np.zeros(len(self.live))
        spans = [slice(self.cuts[t], self.cuts[t + 1]) for t in rare]
        if spans:
            doc, weight = np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans])
            total += np.bincount(doc, weight, len(self.live))
        return total

    def neighbours(self, seed: int, used: np.ndarray, most: int = 64) -> Iterator[int]:
        """All unused documents that share a term with a seed, best first; sorted by ``most`` at a time, as few are taken."""
        scores = self.scores(seed)
        scores[used[self.live]] = 0
        found = np.flatnonzero(scores)
        while len(found):
            parts = np.argpartition(-scores[found], most) if len(found) > most else np.arange(len(found))
            best, found = found[parts[:most]], found[parts[most:]]
            yield from self.live[best[np.lexsort((best, -scores[best]))]].tolist()
            most *= 4


def order_by_retrieval(ids: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """Documents of a shard in the order in which windows take them."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    index, used, order = LexicalIndex(ids, offsets), np.zeros(n, bool), []
    seed, filled, following = -1, 0, 0
    while len(order) < n:
        if 8 * (n - len(order)) < 7 * index.held:
            index.forget(used)
        if seed < 0:
            while used[following]:
                following += 1
            seed = following
            used[seed] = True
            order.append(seed)
            filled += int(sizes[seed])
        room = window - filled % window
        last = seed
        if filled % window:
            for near in index.neighbours(seed, used):
                used[near] = True
                order.append(near)
                filled += int(sizes[near])
                last = near
                if sizes[near] >= room:
                    break
                room -= int(sizes[near])
        # The document that was cut starts the next window and is its seed.
        seed = last if last != seed and filled % window else -1
    return np.array(order, np.int64)


def cut_windows(total: int, window: int) -> np.ndarray:
    """Where windows begin in ``total`` ids, and the end: full ones, then powers of two."""
    edges = list(range(0, total - total % window + 1, window))
    for bit in reversed(range(window.bit_length())):
        if total % window >> bit & 1:
            edges.append(edges[-1] + (1 << bit))
    return np.array(edges, np.int64)


def pack_shard(doc_ids: np.ndarray, ids: np.ndarray, offsets: np.ndarray, window: int) -> list[np.ndarray]:
    """Columns sequence, document place, start, length, crc, tokens and offset of a shard's pieces."""
    order = order_by_retrieval(ids, offsets, window)
    sizes = np.diff(offsets)[order]
    ends = np.cumsum(sizes)
    edges = cut_windows(int(ends[-1]), window)
    cuts = np.union1d(np.concatenate([[0], ends]), edges)
    begin, length = cuts[:-1], np.diff(cuts)
    sequence = np.searchsorted(edges, begin, "right") - 1
    place = np.searchsorted(ends, begin, "right")
    start = begin - (ends - sizes)[place]
    doc = order[place]
    at = offsets[doc] + start
    sums = np.fromiter((crc32_of(ids[s : s + n]) for s, n in zip(at, length)), np.int64, len(at))
    return [sequence, doc, start, length, sums, sizes[place], begin - edges[sequence]]


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, shard_tokens: int = 3_000_000) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``window`` is a power of two.  ``shard_tokens`` bounds an index's memory.
    """
    if window & window - 1:
        raise ValueError("window is not a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(vocabulary), TaskContext.get().partitionId()
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        tokens = numbered = 0

        def close() -> pa.RecordBatch:
            nonlocal held, tokens, numbered
            doc_ids = pa.concat_arrays([x for x, _, _ in held])
            ids = np.concatenate([x for _, x, _ in held])
            sizes = np.concatenate([np.diff(x) for _, _, x in held])
            sequence, doc, *rest, offset = pack_shard(doc_ids, ids, np.concatenate([[0], np.cumsum(sizes)]), window)
            start, length, sums, whole = rest
            columns = [pa.array(np.full(len(doc), part, np.int32)), pa.array(sequence + numbered), doc_ids.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(sums), pa.array(whole), pa.array(offset)]
            numbered += int(sequence[-1]) + 1
            held, tokens = [], 0
            return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

        for batch in text_slices(batches):
            flat, offsets = with_end(*own.encode(batch.column("text")), end_id)
            held.append((batch.column("doc_id"), flat, offsets))
            tokens += len(flat)
            if tokens >= shard_tokens:
                yield close()
        # The encoder keeps its chunks, whose number is bounded, for the worker's next task.
        if held:
            yield close()

    pieces = written(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, PIECES), "pieces")
    counts = pieces.groupBy("part").agg((F.max("local_sequence") + 1).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each partition
    return pieces.join(bases, "part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local_sequence")).alias("sequence_id"), "offset")
