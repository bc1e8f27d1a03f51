"""Token counts by rank-synchronous merging of ragged numpy arrays.

Each distinct pre-token of a batch is one sequence of symbols; all sequences
lie behind one another in one flat array.  In every round each sequence
applies its own lowest-rank pair, at all places at once, until no sequence has
a pair left; what survives are the tokens.  Counts of chunks are cached by the
task and summed per document.

Null texts count as empty.  Rows keep their order and repeated rows are counted
again.  Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .shared import text_slices
from .tokens import CACHE_CHUNKS, LONGEST_KEPT, chunk_column

#: A pair that no rule merges.
NEVER = np.int64(1 << 40)
#: Symbols merged at a time; bounds the arrays.
SYMBOLS = 2_000_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {}, 0
    for b in range(256):
        letters[b] = chr(b) if b in own else chr(256 + extra)
        extra += b not in own
    return [letters[b] for b in range(256)]


class MergeCounter:
    """Counts the tokens of chunks by the vocabulary file's own rules."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model, vocabulary = rules["model"], rules["model"]["vocab"]
        self.special = [t["content"] for t in rules["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        split = next(p for p in rules["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pretokens = regex.compile(split["pattern"]["Regex"])
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def forget(self) -> None:
        self.known, self.words = {}, {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each (non-empty) word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        result = sizes.copy()
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes) - 1
        symbols = self.inner[flat]
        symbols[ends] = self.last[flat[ends]]
        owner = np.repeat(np.arange(len(words)), sizes)
        ranks = np.full(len(symbols), NEVER)  # of the pair that begins here
        ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[ends] = NEVER
        while len(symbols):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(ranks, first)
            counts = np.diff(first, append=len(owner))
            result[owner[first]] = counts
            alive = np.repeat(lowest < NEVER, counts)
            mark = ranks == np.repeat(lowest, counts)
            symbols, owner, ranks, mark = symbols[alive], owner[alive], ranks[alive], mark[alive]
            if not len(symbols):
                break
            # Of overlapping places of one pair (aaa), every second counts, from the left.
            index = np.arange(len(mark))
            start = np.where(mark & ~np.concatenate([[False], mark[:-1]]), index, 0)
            mark &= (index - np.maximum.accumulate(start)) % 2 == 0
            at = np.flatnonzero(mark)
            symbols[at] = self.made[ranks[at]]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            changed = mark.copy()
            before = at[at > 0] - 1
            before = np.where(gone[before], before - 1, before)
            changed[before[before >= 0]] = True
            symbols, owner, ranks, changed = symbols[~gone], owner[~gone], ranks[~gone], changed[~gone]
            again = np.flatnonzero(changed)
            inside = again[(again + 1 < len(owner)) & (owner[np.minimum(again + 1, len(owner) - 1)] == owner[again])]
            ranks[again] = NEVER
            ranks[inside] = self.rank(symbols[inside], symbols[inside + 1])
        return result

    def _pretokens(self, chunk: str) -> list[str]:
        if not chunk.isascii():
            chunk = normalize("NFC", chunk).replace("Σ", "σ")
        return self.pretokens.findall(chunk.lower())

    def count_chunks(self, chunks: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_CHUNKS:
            self.known, self.words = {}, {}
        get = self.known.get
        counts = np.fromiter((get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(counts < 0)
        parts, fixed = [], []
        for i in new:
            chunk = chunks[i]
            special = 0
            if "<|" in chunk and (found := self.split_special.findall(chunk)):
                special = len(found)
                pieces = [w for p in self.split_special.split(chunk) for w in self._pretokens(p)]
            else:
                pieces = self._pretokens(chunk)
            parts.append(pieces)
            fixed.append(special)
        fresh = list({w for p in parts for w in p if w not in self.words})
        start, held, bucket = 0, 0, []
        for k, word in enumerate(fresh):
            bucket.append(word.encode())
            held += len(bucket[-1])
            if held > SYMBOLS or k == len(fresh) - 1:
                self.words.update(zip(fresh[start : k + 1], self.merge(bucket).tolist()))
                start, held, bucket = k + 1, 0, []
        words = self.words
        for i, pieces, special in zip(new, parts, fixed):
            counts[i] = special + sum([words[w] for w in pieces])
            if len(chunks[i]) <= LONGEST_KEPT:
                self.known[chunks[i]] = int(counts[i])
        return counts

    def count(self, texts: pa.Array) -> np.ndarray:
        chunks, codes, bounds = chunk_column(texts)
        counts = self.count_chunks(chunks.to_pylist())
        return np.diff(np.concatenate([[0], np.cumsum(counts[codes])])[bounds])


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    No shuffle: each task counts the rows it reads.  ``vocabulary`` is the path
    of a byte-level BPE file with end-of-word suffix, present on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for part in text_slices(batches):
            texts = part.column("text")
            n = own.count(texts)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        own.forget()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
