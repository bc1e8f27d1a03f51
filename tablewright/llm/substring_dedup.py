"""Removal of repeated word sequences by level-wise doubling.

A window of 2L words can only be repeated where both of its halves are.  The
first level looks at every window of ``base`` words of every text; windows that
occur once drop out, and only those whose halves both survive are looked at with
twice the length, until the wanted length is reached or none survives.  There,
each window is compared by two independent 64-bit hashes and the earliest start
in the collection is found; all later windows are removed.

Below the last level a survivor need not be repeated (hashes are shortened, with
buckets that grow in number with the collection), so these levels only leave
windows out; what is removed is decided at the last level alone.

Null texts have no words.  Documents come in the order of ``doc_id``, null first;
rows that share a ``doc_id``, and rows without one, count as one document, so that
of equal windows at the same place of two of them neither is earlier and both
stay.  The smallest 64-bit number stands for null and comes back as null.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import NO_DOC, Block, Deal, Rounds, bucket_of, first_holder, repeated_elsewhere
from .tokens import ragged_gather
from .words import PLACE, PLACE_2, Words, distinct_pairs, mix, shingle_hashes, words_of

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _windows(words: Words, length: int) -> np.ndarray:
    """Which words begin a window of ``length`` inside their text."""
    fits = np.zeros(len(words.hashes), bool)
    if len(fits) >= length:
        fits[: len(fits) - length + 1] = True
        for end in words.bounds[1:-1]:
            fits[max(0, end - length + 1) : end] = False
    return fits


class Levels:
    """The windows of a block that are alive, level by level."""

    def __init__(self, block: Block, base: int, length: int):
        self.block, self.length = block, length
        self.words = words_of(block.texts, fold=False)
        self.size, self.level = base, 0
        self.alive = np.flatnonzero(_windows(self.words, base))

    def items(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of the alive windows, which of them each window has, and how often each occurs."""
        hashes = shingle_hashes(self.words.hashes, self.size)[self.alive]
        keys = bucket_of(hashes, self.block.buckets).astype(np.uint64) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))
        return np.unique(keys, return_inverse=True, return_counts=True)

    def questions(self) -> list[tuple[int, bytes]]:
        keys, _, _ = self.items()
        return Deal((keys >> np.uint64(32)).astype(np.int64)).questions(keys.astype(np.uint32))

    def advance(self) -> None:
        """Apply the answers of this level, and go on to windows of twice the length."""
        keys, which, counts = self.items()
        elsewhere = Deal((keys >> np.uint64(32)).astype(np.int64)).back(self.block.answered(self.level))
        repeated = np.zeros(len(self.words.hashes) + self.size, bool)
        repeated[self.alive[((counts > 1) | (elsewhere > 0))[which]]] = True
        self.level, half = self.level + 1, self.size
        self.size *= 2
        fits = _windows(self.words, self.size)
        self.alive = np.flatnonzero(repeated[: len(fits)] & repeated[half:] & fits)

    def last(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, Deal]:
        """Distinct windows of the last level: both hashes, earliest place of each, which each window has, and their deal."""
        hashes = shingle_hashes(self.words.hashes, self.length)[self.alive]
        second = shingle_hashes(self.words.second_hashes(), self.length, PLACE_2)[self.alive]
        first, which = distinct_pairs(hashes, second, *self.starts(self.alive))
        keys = np.stack([hashes[first], second[first]])
        return keys, self.alive[first], which, Deal(bucket_of(mix(keys[0] + PLACE[20]), self.block.buckets))

    def starts(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document number, and place in the document."""
        rows = np.searchsorted(self.words.bounds, places, "right") - 1
        return self.block.doc_ids[rows], (places - self.words.bounds[rows]).astype(np.int32)


def _levels(block: Block, base: int, length: int, upto: int) -> Levels:
    levels = Levels(block, base, length)
    while levels.level < upto:
        levels.advance()
    return levels


def remove_repeated_words(docs: DataFrame, length: int = 20, base: int = 5, block_bytes: int | None = None, bucket_bytes: int = 24_000_000, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row, and ``kept_text`` if ``texts``.

    ``length`` is ``base`` times a power of two.
    """
    steps = (length // base).bit_length() - 1
    if base << steps != length:
        raise ValueError("length is not base times a power of two")
    rounds = Rounds(docs, block_bytes, bucket_bytes)
    for upto in range(steps):
        rounds.ask(lambda block, upto=upto: _levels(block, base, length, upto).questions(), repeated_elsewhere)

    def ask_first(block: Block) -> list[tuple[int, bytes]]:
        levels = _levels(block, base, length, steps)
        keys, places, _, deal = levels.last()
        return deal.questions(*keys, *levels.starts(places))

    rounds.ask(ask_first, lambda payloads: first_holder(payloads, np.int64, np.int32))

    def result(block: Block) -> pa.Table:
        levels = _levels(block, base, length, steps)
        words, (keys, places, which, deal) = levels.words, levels.last()
        later = deal.back(block.answered(steps)) > 0
        gone = later[which]
        for own, earliest in zip(levels.starts(levels.alive), levels.starts(places)):
            gone = gone | (own != earliest[which])
        edges = np.zeros(len(words.hashes) + 1, np.int32)
        np.add.at(edges, levels.alive[gone], 1)
        np.add.at(edges, levels.alive[gone] + length, -1)
        removed = np.cumsum(edges[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(removed)])[words.bounds]
        # The kept words of all texts, each with a space behind it.
        keep = np.flatnonzero(~removed)
        sizes = words.ends[keep] - words.starts[keep]
        ends = np.cumsum(sizes + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        out[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(keep)), sizes)] = ragged_gather(words.data, words.starts[keep], sizes)
        limits = np.concatenate([[0], ends])[np.searchsorted(keep, words.bounds)]
        kept = [out[s : max(s, e - 1)].tobytes() for s, e in zip(limits[:-1], limits[1:])]
        columns = [pa.array(block.doc_ids, mask=block.doc_ids == NO_DOC), pa.array(np.diff(words.bounds)), pa.array(np.diff(total)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if texts:
            columns.append(pa.array([k.decode() for k in kept], pa.string()))
            names.append("kept_text")
        return pa.Table.from_arrays(columns, names=names)

    return rounds.finish(result, SCHEMA + (", kept_text string" if texts else ""))
