"""Removal of byte strings that an earlier document holds, by merging Burrows-Wheeler transforms.

The strings looked for have ``LENGTH`` bytes.  In every such window of a text,
the ``ANCHOR``-byte string with the smallest hash is its anchor; equal windows
have equal anchors at equal places, so a window only has to be compared with
windows of its own anchor.  Neighbouring windows that share an anchor are a run.

1. Anchors that one block alone holds, once, drop out with their runs.
2. Runs of equal bytes meet by two independent 64-bit hashes; of each, the smallest document stays a
   representative, and all others hold nothing but earlier bytes.
3. Windows of a representative whose anchor stands at one of nine neighbouring places are a piece; such windows
   have 42 bytes around the anchor in common.  These are counted over all representatives by hash; a piece that is
   alone is done.
4. The bytes of the other pieces, each once for a block, go to the bucket of their 42 bytes.  Each block's pieces
   are a shard with its own Burrows-Wheeler transform.  The bucket merges the
   shards' transforms by refining their interleave, up to 25 more leading bytes
   in each iteration (a transform holds so many bytes before each suffix instead
   of one).  An iteration does not deal rows by counting: it sorts all rows of
   the bucket by the ranks of these bytes, and the heads of
   all its suffixes are sorted once for the ranks; the iteration in which two
   neighbours part bounds their common prefix, and what never parts is an
   interval of suffixes that share LENGTH bytes.  The smallest document of each interval
   is the one that keeps the bytes.

A piece whose 42 bytes more than ``HOT`` representatives hold (a passage that very many
documents share, with different bytes around it) is split: its windows go each
to the bucket of their own bytes.

Null texts are empty.  Documents come in the order of ``doc_id``, null first;
rows that share a ``doc_id``, and rows without one, count as one document.  The
smallest 64-bit number stands for null and comes back as null.  An empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import NO_DOC, Block, Deal, Rounds, bucket_of, distinct, first_holder, note_bucket, pack, repeated_elsewhere, unpack
from .tokens import ragged_gather
from .words import PLACE, distinct_pairs, mix, prefix_hash, rolling_hash, span_hash, text_bytes

LENGTH, ANCHOR, HOT = 50, 24, 4096
#: Buckets of a small collection; merging is the dearest step, so it is spread over many tasks.
LEAST_BUCKETS = 64
SPAN = LENGTH - ANCHOR + 1  # places of the anchor in a window
STRETCH = (1 << 14) - 2 * SPAN  # windows whose hashes are looked at together
#: Places of the anchor at which a piece begins, and the end of the last.
CUTS = (0, 9, 18, SPAN)
#: Marks the first run of a content, and the first member of a string, in a byte that counts windows.
OPENS = 128
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
ALONE, SEVERAL, TOO_MANY = 0, 1, 2


# --- Burrows-Wheeler transforms -------------------------------------------------------------------


def ranked(keys: np.ndarray) -> np.ndarray:
    """The place of each number among the distinct ones, from 1."""
    order = np.argsort(keys)
    held = keys[order]
    rank = np.empty(len(keys), np.uint64)
    rank[order] = np.cumsum(np.concatenate([[True], held[1:] != held[:-1]])[: len(keys)])
    return rank


def in_order(numbers: np.ndarray) -> np.ndarray:
    """Places by ascending number, equal ones as they are; faster than a stable sort of places where both fit 64 bits."""
    bits = max(1, len(numbers).bit_length())
    if len(numbers) and int(numbers.max()).bit_length() + bits > 64:
        return np.argsort(numbers, kind="stable")
    held = numbers << np.uint64(bits) | np.arange(len(numbers), dtype=np.uint64)
    held.sort()
    return (held & np.uint64((1 << bits) - 1)).astype(np.int64)


class Strings8:
    """Strings that each end with code 0, and numbers that stand for several codes from each place.

    Words of eight codes are replaced by their ranks among the words that occur,
    three of these with one code more by the rank of all ``most`` codes.  Numbers compare as their codes do,
    end with their string, and are odd if they end before it.
    """

    most = 25

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.codes, n = codes, len(codes)
        self.places = np.arange(n, dtype=np.int64)
        ends = np.cumsum(sizes)
        self.start, self.ring = np.repeat(ends - sizes, sizes), np.repeat(sizes, sizes)
        self.left = self.start + self.ring - 1 - self.places  # codes before the string's end
        word = codes.astype(np.uint64)
        for width in (1, 2, 4):
            word = word << np.uint64(8 * width) | self._ahead(word, width)
        rank = ranked(word)
        if n < (1 << 21) - 1:
            key = joined(rank, self.left, 8, 3)
        else:
            key = ranked(joined(rank, self.left, 8, 2)) << np.uint64(32) | self._ahead(rank, 16)
        self.rank = ranked(ranked(key) << np.uint64(8) | self._ahead(codes, 24))

    def _ahead(self, values: np.ndarray, width: int) -> np.ndarray:
        """Values ``width`` places on, 0 behind a string's end."""
        found = np.zeros(len(values), np.uint64)
        found[: max(0, len(values) - width)] = values[width:]
        found[self.left < width] = 0
        return found

    def widths(self, length: int) -> list[int]:
        """Steps that add up to ``length``."""
        found = [self.most] * (length // self.most)
        return found + [1] * (length - sum(found))

    def numbers(self, width: int) -> np.ndarray:
        key = self.rank if width == self.most else self.codes.astype(np.uint64)
        return key << np.uint64(1) | (self.left >= width).astype(np.uint64)


def joined(rank: np.ndarray, left: np.ndarray, step: int, parts: int) -> np.ndarray:
    """Ranks at each place and at the next ones ``step`` apart in one number, 0 behind a string's end."""
    bits, key = np.uint64(63 // parts), np.zeros(len(rank), np.uint64)
    padded = np.concatenate([rank, np.zeros(step * parts, np.uint64)])
    for j in range(parts):
        key = key << bits | np.where(left >= step * j, padded[step * j : step * j + len(rank)], np.uint64(0))
    return key


def suffix_order(rank: np.ndarray, left: np.ndarray, size: int, length: int) -> np.ndarray:
    """A shard's suffixes by ``length`` leading codes, from ranks of ``size`` codes; suffixes do not go beyond their string."""
    while True:
        key, size = joined(rank, left, size, 2), 2 * size
        if size >= length:
            return np.argsort(key)
        rank = ranked(key)


def merge_transforms(transforms: dict[int, np.ndarray], sizes: np.ndarray, widths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of the shards' rows, and a bound below each row's common prefix with the row before it.

    Rows are numbered through all shards.  The interleave starts with one shard
    behind the other.  An iteration deals its rows, in their order, to the codes
    before them; the rows are then in order by so many more leading codes.  A
    shard's own rows never change their order, so only shard numbers move.
    """
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint8 if len(sizes) < 256 else np.uint16 if len(sizes) < 1 << 16 else np.uint32), sizes)
    n, length = int(sizes.sum()), sum(widths)
    rows, group = np.arange(n), np.zeros(n, np.int32)
    common = np.full(n, length, np.uint8)
    common[:1] = 0
    reached = 0
    for width in widths:
        codes = transforms[width][rows]
        deal = in_order(codes)
        codes, was, shard = codes[deal], group[deal], shard[deal]
        parts = codes[1:] != codes[:-1]
        # What follows a string's end does not count.
        parts |= (was[1:] != was[:-1]) & (codes[1:] & np.uint64(1) != 0)
        common[1:][parts & (common[1:] == length)] = reached
        group[0] = 0
        group[1:] = np.cumsum(parts, dtype=np.int32)
        rows = np.empty(n, np.int64)
        rows[np.argsort(shard, kind="stable")] = np.arange(n)
        reached += width
    return rows, common


def earlier_windows(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """For each shard (bytes of its strings, their sizes, their documents): 1 for each window that a smaller document holds."""
    string_sizes = np.concatenate([sizes for _, sizes, _ in shards]) + 1
    # UTF-8 has no byte 255, so that bytes move up by one and 0 ends a string.
    codes = np.insert(np.concatenate([data for data, _, _ in shards]) + np.uint8(1), np.cumsum(string_sizes - 1), 0)
    strings = Strings8(codes, string_sizes)
    widths = strings.widths(length)
    numbers = {w: strings.numbers(w) for w in set(widths)}
    sizes = np.array([int(s.sum()) + len(s) for _, s, _ in shards])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    order = np.concatenate([suffix_order(strings.rank[s:e], strings.left[s:e], strings.most, length) + s for s, e in zip(bounds, bounds[1:])])
    # A shard's transform has the codes before each of its suffixes, in their order, the string taken as a ring.
    start, ring = strings.start, strings.ring
    transforms = {w: numbers[w][(start + (strings.places - start - w) % ring)[order]] for w in numbers}
    rows, common = merge_transforms(transforms, sizes, widths)
    place = order[rows]  # of each merged row, in all shards' strings
    keep = strings.left >= length
    doc = np.repeat(np.concatenate([d for _, _, d in shards]), string_sizes)[place]
    first = np.flatnonzero(common < length)
    smallest = np.repeat(np.minimum.reduceat(doc, first), np.diff(first, append=len(doc)))
    found = np.zeros(len(codes), bool)
    found[place] = doc > smallest
    # Windows of a string come in the order of their starts.
    windows = np.concatenate([[0], np.cumsum(keep)])[bounds]
    return np.split(found[keep].astype(np.uint8), windows[1:-1])


def answer_strings(payloads: list[bytes]) -> list[bytes]:
    shards = [(data, sizes.astype(np.int64), doc) for data, sizes, doc in (unpack(p, np.uint8, np.uint8, np.int64) for p in payloads)]
    return [f.tobytes() for f in earlier_windows(shards, LENGTH)]


# --- Runs of a block ------------------------------------------------------------------------------


class Runs:
    """Anchored runs of windows of a block: first window, number of windows, anchor."""

    def __init__(self, block: Block):
        self.block = block
        self.data, self.bounds = text_bytes(block.texts)

    @cached_property
    def sums(self) -> np.ndarray:
        return prefix_hash(self.data)

    def find(self) -> None:
        total = len(self.data) - LENGTH + 1
        self.first = self.count = self.anchor = np.zeros(0, np.int64)
        if total < 1:
            return
        shift, bits = np.empty(total, np.uint8), np.uint64(STRETCH.bit_length())  # places from a window to its anchor
        for k in range(0, total, STRETCH):  # stretches that fit the processor's cache
            stop = min(k + STRETCH, total)
            low = rolling_hash(self.sums, ANCHOR, k, stop + SPAN - 1)
            low = (low >> bits << bits) | np.arange(len(low), dtype=np.uint64)  # ties go to the left
            width = 1
            while width * 2 <= SPAN:
                low = np.minimum(low[: len(low) - width], low[width:])
                width *= 2
            if width < SPAN:
                low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
            shift[k:stop] = (low & ((np.uint64(1) << bits) - np.uint64(1))) - np.arange(stop - k, dtype=np.uint64)
        # Windows inside a text: all places but the last of each.
        fits = np.ones(total, bool)
        tail = np.minimum(np.diff(self.bounds), LENGTH - 1)
        over = ragged_gather(np.arange(LENGTH), np.zeros(len(tail), np.int64), tail) + np.repeat(self.bounds[1:] - tail, tail)
        fits[over[over < total]] = False
        opens, closes = fits.copy(), fits.copy()
        turns = (shift[:-1] - shift[1:] != 1) | ~fits[:-1]
        opens[1:] &= turns
        closes[:-1] &= turns | ~fits[1:]
        # Two texts never share a run: the last windows of a text do not fit.
        self.first = np.flatnonzero(opens)
        self.count = np.flatnonzero(closes) - self.first + 1
        self.anchor = self.first + shift[self.first]

    def anchor_hash(self) -> np.ndarray:
        return span_hash(self.sums, self.anchor, self.anchor + ANCHOR)

    def anchor_keys(self) -> np.ndarray:
        h = self.anchor_hash()
        return bucket_of(h, self.block.buckets).astype(np.uint64) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))

    def keep(self, which: np.ndarray) -> None:
        self.first, self.count, self.anchor = self.first[which], self.count[which], self.anchor[which]

    def documents(self) -> np.ndarray:
        return self.block.doc_ids[np.searchsorted(self.bounds, self.first, "right") - 1]

    def content_items(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, Deal]:
        """Distinct run contents: both hashes, first run (of the smallest document), which content each run has, and their deal."""
        shift, ends = (self.anchor - self.first).astype(np.uint64) * PLACE[40], self.first + self.count + LENGTH - 1
        h = mix(span_hash(self.sums, self.first, ends) + shift)
        second = mix(span_hash(prefix_hash(self.data, 1), self.first, ends, 1) + shift)
        first, which = distinct_pairs(h, second)
        keys = np.stack([h[first], second[first]])
        return keys, first, which, Deal(bucket_of(mix(keys[0] + PLACE[41]), self.block.buckets))

    def note(self, which: np.ndarray, deal: Deal) -> tuple[int, bytes]:
        """Runs in the order in which their contents are dealt; the first run of each content is marked."""
        order, opens = dealt(which, deal)
        shift = self.anchor - self.first
        return note_bucket(self.block), pack(self.first[order].astype(np.uint32), self.count[order].astype(np.uint8) | opens, shift[order].astype(np.uint8))


def dealt(which: np.ndarray, deal: Deal) -> tuple[np.ndarray, np.ndarray]:
    """Members of items in the order in which the items are dealt, and OPENS for the first member of each."""
    place = np.empty(len(deal.order), np.int64)
    place[deal.order] = np.arange(len(deal.order))
    order = np.argsort(place[which], kind="stable")
    return order, (np.diff(which[order], prepend=-1) != 0).astype(np.uint8) * np.uint8(OPENS)


def ask_anchors(block: Block) -> list[tuple[int, bytes]]:
    runs = Runs(block)
    runs.find()
    keys = distinct(np.sort(runs.anchor_keys()))
    return Deal((keys >> np.uint64(32)).astype(np.int64)).questions(keys.astype(np.uint32))


def ask_contents(block: Block) -> list[tuple[int, bytes]]:
    runs = Runs(block)
    runs.find()
    keys = runs.anchor_keys()
    order = np.argsort(keys)
    cuts = np.flatnonzero(np.diff(keys[order].astype(np.int64), prepend=-1))
    counts, shared = np.diff(cuts, append=len(keys)), np.empty(len(keys), bool)
    shared[order] = np.repeat((counts > 1) | (block.replies(0) > 0), counts)
    runs.keep(shared)
    keys, first, which, deal = runs.content_items()
    return [runs.note(which, deal), *deal.questions(*keys, runs.documents()[first])]


class Contents:
    """A block's runs by content, as it noted them."""

    def __init__(self, block: Block):
        self.runs = runs = Runs(block)
        notes = block.answered(1).get(note_bucket(block))
        first, count, shift = unpack(notes, np.uint32, np.uint8, np.uint8) if notes else (np.zeros(0, np.uint8),) * 3
        runs.first, runs.count = first.astype(np.int64), (count % OPENS).astype(np.int64)
        runs.anchor = runs.first + shift
        self.first, self.which = np.flatnonzero(count >= OPENS), np.cumsum(count >= OPENS) - 1
        self.copies = block.replies(1) > 0
        self.own = np.flatnonzero(~self.copies)  # contents of which this block has the first


class Pieces:
    """Pieces of the contents that no smaller document holds: windows of a run that have the anchor at neighbouring places."""

    def __init__(self, block: Block):
        self.contents = found = Contents(block)
        self.runs = runs = found.runs
        at = found.first[found.own]
        most, count = runs.anchor[at] - runs.first[at], runs.count[at]
        content, low, high, keys = [], [], [], []
        for number, (start, stop) in enumerate(zip(CUTS[:-1], CUTS[1:])):
            some = np.flatnonzero((most >= start) & (most - count < stop - 1))
            anchor = runs.anchor[at[some]]
            keys.append(mix(span_hash(runs.sums, anchor - start, anchor + LENGTH - stop + 1) + PLACE[44 + number]))
            content.append(found.own[some])
            low.append(np.maximum(most[some] - count[some] + 1, start))
            high.append(np.minimum(most[some], stop - 1))
        self.content, low, high, self.keys = map(np.concatenate, (content, low, high, keys))
        # Windows of a run are numbered from the one that has the anchor at its last place.
        self.offset, self.windows = (runs.anchor - runs.first)[found.first[self.content]] - high, high - low + 1
        self.groups, self.group_of, self.sizes = np.unique(self.keys, return_inverse=True, return_counts=True)
        self.deal = Deal(bucket_of(self.groups, block.buckets))


def ask_counts(block: Block) -> list[tuple[int, bytes]]:
    found = Pieces(block)
    return found.deal.questions((found.groups & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(found.sizes, 65535).astype(np.uint16))


def answer_counts(payloads: list[bytes]) -> list[bytes]:
    held = [unpack(p, np.uint32, np.uint16) for p in payloads]
    keys, which = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    total = np.bincount(which, np.concatenate([c for _, c in held]))
    kind = np.where(total > HOT, TOO_MANY, np.where(total > 1, SEVERAL, ALONE)).astype(np.uint8)[which]
    return [k.tobytes() for k in np.split(kind, np.cumsum([len(k) for k, _ in held])[:-1])]


def ask_strings(block: Block) -> list[tuple[int, bytes]]:
    """Strings that are merged elsewhere, equal ones of the block once, for its smallest document; notes the members of each."""
    found = Pieces(block)
    runs, first = found.runs, found.contents.first
    kind = found.deal.back(block.answered(2))[found.group_of]
    some, hot = np.flatnonzero(kind == SEVERAL), np.flatnonzero(kind == TOO_MANY)
    # One string for a piece; of hot pieces, one for each window.
    parts = found.windows[hot]
    content = np.concatenate([found.content[some], np.repeat(found.content[hot], parts)])
    offset = np.concatenate([found.offset[some], np.repeat(found.offset[hot], parts) + ragged_gather(np.arange(SPAN), np.zeros(len(hot), np.int64), parts)])
    windows = np.concatenate([found.windows[some], np.ones(int(parts.sum()), np.int64)])
    start, size = runs.first[first[content]] + offset, windows + LENGTH - 1
    own = span_hash(runs.sums, start, start + size)
    key = np.concatenate([found.keys[some], own[len(some) :]])
    doc = runs.documents()[first[content]]
    order = np.lexsort((doc, own))
    new = np.ones(len(order), bool)
    new[1:] = own[order[1:]] != own[order[:-1]]
    leads = np.repeat(order[new], np.diff(np.flatnonzero(new), append=len(new)))
    # Equal hashes have to be equal bytes; else no strings of the block are taken together.
    if not (np.array_equal(size[order], size[leads]) and np.array_equal(ragged_gather(runs.data, start[order], size[order]), ragged_gather(runs.data, start[leads], size[leads]))):
        new[:], leads = True, order
    which, later = np.empty(len(order), np.int64), np.empty(len(order), np.uint8)
    which[order] = np.cumsum(new) - 1
    later[order] = doc[order] > doc[leads]
    sent = order[new]
    deal = Deal(bucket_of(mix(key[sent] + PLACE[43]), block.buckets))
    by, opens = dealt(which, deal)
    note = pack(content[by].astype(np.uint32), offset[by].astype(np.uint8), windows[by].astype(np.uint8) | opens, later[by])
    sent = sent[deal.order]
    data, ends = ragged_gather(runs.data, start[sent], size[sent]), np.concatenate([[0], np.cumsum(size[sent])])
    sizes, docs = size[sent].astype(np.uint8), doc[sent]
    return [(note_bucket(block), note), *((int(b), pack(data[ends[s] : ends[e]], sizes[s:e], docs[s:e])) for b, s, e in zip(deal.buckets, deal.cuts[:-1], deal.cuts[1:]))]


def earlier_numbers(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Content and number (in its run) of each window in a noted string that a smaller document holds."""
    notes = block.answered(3).get(note_bucket(block))
    content, offset, windows, later = unpack(notes, np.uint32, np.uint8, np.uint8, np.uint8) if notes else (np.zeros(0, np.uint8),) * 4
    opens, windows = windows >= OPENS, (windows % OPENS).astype(np.int64)
    starts = np.cumsum(windows[opens]) - windows[opens]
    flags = ragged_gather(block.replies(3), starts[np.cumsum(opens) - 1], windows) > 0
    flags |= np.repeat(later > 0, windows)
    number = ragged_gather(np.arange(SPAN), np.zeros(len(windows), np.int64), windows) + np.repeat(offset.astype(np.int64), windows)
    return np.repeat(content.astype(np.int64), windows)[flags], number[flags]


def result(block: Block) -> pa.Table:
    found = Contents(block)
    runs = found.runs
    edges = np.zeros(len(runs.data) + 1, np.int32)
    # Runs whose bytes a smaller document holds whole: in another block, or before in this one.
    doc = runs.documents()
    whole = found.copies[found.which] | (doc > doc[found.first][found.which]) if len(found.which) else np.zeros(0, bool)
    np.add.at(edges, runs.first[whole], 1)
    np.add.at(edges, runs.first[whole] + runs.count[whole] + LENGTH - 1, -1)
    # Single windows; what holds for a content's first run holds for the same document's other runs of it.
    content, number = earlier_numbers(block)
    by = np.argsort(content, kind="stable")
    content, number = content[by], number[by]
    rest = np.flatnonzero(~whole)
    lo, hi = np.searchsorted(content, found.which[rest], "left"), np.searchsorted(content, found.which[rest], "right")
    starts = np.repeat(runs.first[rest], hi - lo) + ragged_gather(number, lo, hi - lo)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + LENGTH, -1)
    removed = np.cumsum(edges[:-1], dtype=np.int32) > 0
    bounds = runs.bounds
    opens = removed.copy()
    opens[1:] &= ~removed[:-1]
    firsts = bounds[:-1][bounds[:-1] < len(removed)]
    opens[firsts] = removed[firsts]
    n_removed = np.diff(np.concatenate([[0], np.cumsum(removed)])[bounds])
    n_spans = np.diff(np.concatenate([[0], np.cumsum(opens)])[bounds])
    kept = [hashlib.sha256(runs.data[s:e][~removed[s:e]].tobytes() if r else runs.data[s:e].tobytes()).hexdigest() for s, e, r in zip(bounds[:-1], bounds[1:], n_removed)]
    ids = block.doc_ids
    return pa.Table.from_arrays([pa.array(ids, mask=ids == NO_DOC), pa.array(np.diff(bounds)), pa.array(n_removed), pa.array(n_spans), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_earlier_bytes(docs: DataFrame, block_bytes: int | None = None, bucket_bytes: int = 5_000_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rounds = Rounds(docs, block_bytes, bucket_bytes, LEAST_BUCKETS)
    rounds.ask(ask_anchors, repeated_elsewhere)
    rounds.ask(ask_contents, lambda payloads: first_holder(payloads, np.int64))
    rounds.ask(ask_counts, answer_counts)
    rounds.ask(ask_strings, answer_strings, dear=True)
    return rounds.finish(result, SCHEMA)
