"""Tokenising Arrow string columns through a cache of white-space separated chunks.

The tokenizer's normaliser and its splitting pattern never join characters
across a space or a line feed, so a text's ids are the ids of its chunks one
after the other.  Prose repeats its chunks, so every distinct chunk goes
through the tokenizers library once per Python worker (bounded cache) and the
texts are put together again with numpy gathers.  Chunks that differ in the case
of A-Z or in the marks at their end share what goes through the library.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a task keeps before it starts again; bounds its memory.
CACHE_CHUNKS = 700_000
#: Chunks longer than this are encoded but never kept.
LONGEST_KEPT = 64
#: Chunks joined into one call of the library.
PER_CALL = 256
#: The vocabulary's splitting pattern (fixed value, part of the tokenizer file).
_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Marks that are taken off the end of a chunk.
_MARKS = np.isin(np.arange(256), np.frombuffer(b".,!?;:*#%", np.uint8))
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_ALNUM = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8))


def ragged_gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``values[s:s+n]`` for every pair of ``starts`` and ``lengths``."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    index = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
    return values[index]


def chunk_column(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct non-empty chunks, the chunk number at each place, and offsets of each text's places.

    A null text has no chunks.
    """
    texts = pc.fill_null(pa.array(texts) if not isinstance(texts, (pa.Array, pa.ChunkedArray)) else texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, pa.scalar("", pa.large_string())).as_py() if len(coded.dictionary) else -1
    if empty >= 0:
        keep = codes != empty
        counted = np.concatenate([[0], np.cumsum(keep)])
        bounds, codes = counted[bounds], codes[keep]
    return coded.dictionary, codes, bounds


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.DictionaryArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    text = np.ascontiguousarray(ragged_gather(data, starts, sizes))
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(text)).dictionary_encode()


def stems_and_marks(chunks: pa.LargeStringArray) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
    """Each chunk as a stem with A-Z lowered and the marks at its end; ids of both, one after the other, are the chunk's.

    Marks after a letter or digit are a pre-token of their own.  A chunk stays
    whole where that is not plain from its last bytes.  It also keeps its case if
    it has characters from U+0300 on, which the normaliser may compose, or an angle
    bracket, which may begin an added token.
    """
    offsets = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
    data = np.frombuffer(chunks.buffers()[2], np.uint8) if chunks.buffers()[2] else np.zeros(0, np.uint8)
    starts, whole = offsets[:-1], np.diff(offsets)
    data, starts = np.append(data[offsets[0] : offsets[-1]], np.uint8(0)), starts - offsets[0]  # an empty chunk may be the last
    odd = np.logical_or.reduceat((data >= 0xCC) | (data == 0x3C), starts) if len(starts) else np.zeros(0, bool)
    lowered = np.where(np.append(np.repeat(odd, whole), False), data, _LOWERED[data])
    sizes, open_ends = whole.copy(), np.flatnonzero(~odd)
    while len(open_ends):
        open_ends = open_ends[sizes[open_ends] > 0]
        open_ends = open_ends[_MARKS[data[starts[open_ends] + sizes[open_ends] - 1]]]
        sizes[open_ends] -= 1
    last = lowered[starts + np.maximum(sizes - 1, 0)]
    lead = lowered[starts + np.maximum(sizes - 2, 0)]
    # U+00C0 to U+00FF are letters, and stay letters in lower case, but for the signs of multiplication and division.
    letter = (sizes > 1) & (lead == 0xC3) & (last != 0x97) & (last != 0xB7)
    sizes = np.where((sizes > 0) & (_ALNUM[last] | letter), sizes, whole)
    return _strings(lowered, starts, sizes), _strings(lowered, starts + sizes, whole - sizes)


class ChunkEncoder:
    """Ids of whole texts exactly as the tokenizers library gives them."""

    def __init__(self, path: str, suffix: str = "</w>"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.arena = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.empty(1 << 14, np.int64)
        self.sizes = np.empty(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)
        self.count = 0

    def trim(self) -> None:
        """Keep what was asked for more than once since it came, if that is no more than half of the bound; it has to be asked for again to stay next time."""
        kept = [(w, s) for w, s in self.known.items() if self.again[s]]
        if 2 * len(kept) > CACHE_CHUNKS:
            kept = []
        old = np.array([s for _, s in kept], np.int64)
        sizes = self.sizes[old]
        flat = ragged_gather(self.arena, self.starts[old], sizes)
        self.forget()
        self.known = dict(zip([w for w, _ in kept], self._add(flat, sizes).tolist()))

    def _add(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        while self.used + len(flat) > len(self.arena):
            self.arena = np.concatenate([self.arena, np.empty_like(self.arena)])
        while self.count + len(sizes) > len(self.starts):
            self.starts, self.sizes, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.again))
        self.arena[self.used : self.used + len(flat)] = flat
        here = slice(self.count, self.count + len(sizes))
        self.sizes[here] = sizes
        self.starts[here] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.count += len(sizes)
        return np.arange(here.start, here.stop)

    def _encode_new(self, chunks: list[str]) -> np.ndarray:
        """Slots of chunks that are not known yet.

        Chunks are joined with spaces, many in one call.  The last id of each
        pre-token, and no other, carries the end-of-word suffix, so the number
        of pre-tokens in a chunk tells where its ids end.  They are counted before
        the tokenizer normalises, which can change them; a call whose total
        disagrees, and any chunk that holds an added token, goes chunk by chunk.
        """
        slots = np.empty(len(chunks), np.int64)
        held = pa.array(chunks, pa.string())
        free = np.ones(len(chunks), bool)
        for token in self.special:
            free &= ~pc.match_substring(held, token).to_numpy(zero_copy_only=False)
        joinable = np.flatnonzero(free).tolist()
        plain = held.filter(pa.array(free))
        counts = pc.count_substring_regex(pc.utf8_lower(plain), _PRETOKEN).to_numpy(zero_copy_only=False).astype(np.int64)
        alone = np.flatnonzero(~free).tolist()
        places = np.array(joinable, np.int64)
        for j in range(0, len(joinable), 64 * PER_CALL):
            spans = [slice(k, min(k + PER_CALL, len(joinable))) for k in range(j, min(j + 64 * PER_CALL, len(joinable)), PER_CALL)]
            coded = self.library.encode_batch_fast([" ".join(chunks[i] for i in joinable[s]) for s in spans], add_special_tokens=False)
            for span, code in zip(spans, coded):
                flat = np.array(code.ids, np.uint32)
                ends = np.flatnonzero(self.ends_word[flat])
                wanted = np.cumsum(counts[span])
                if len(ends) != wanted[-1] or len(flat) != (ends[-1] + 1 if len(ends) else 0):
                    alone.extend(joinable[span])
                    continue
                upto = np.concatenate([[0], ends + 1])[wanted]
                slots[places[span]] = self._add(flat, np.diff(upto, prepend=0))
        for i in alone:
            ids = np.array(self.library.encode(chunks[i], add_special_tokens=False).ids, np.uint32)
            slots[i] = self._add(ids, np.array([len(ids)]))[0]
        return slots

    def _slots(self, coded: pa.DictionaryArray) -> np.ndarray:
        """Slot of each string; those not known are encoded."""
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        slots = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slots < 0)
        self.again[slots[slots >= 0]] = True
        if len(new):
            fresh = [words[i] for i in new]
            slots[new] = self._encode_new(fresh)
            self.known.update((w, s) for w, s in zip(fresh, slots[new].tolist()) if len(w) <= LONGEST_KEPT)
        return slots[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids of all texts, and the offsets of each text in them."""
        chunks, codes, bounds = chunk_column(texts)
        if self.count > CACHE_CHUNKS:
            self.trim()
        stems, marks = stems_and_marks(chunks)
        # Ids of each distinct chunk: of its stem, then of its marks.
        slots = np.stack([self._slots(stems), self._slots(marks)], 1)
        sizes = self.sizes[slots]
        held = ragged_gather(self.arena, self.starts[slots].ravel(), sizes.ravel())
        sizes = sizes.sum(1)
        starts = np.cumsum(sizes) - sizes
        sizes_here = sizes[codes]
        return ragged_gather(held, starts[codes], sizes_here), np.concatenate([[0], np.cumsum(sizes_here)])[bounds]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of one vocabulary file; reused by its later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
