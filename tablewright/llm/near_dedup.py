"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document is its set of distinct shingles.  Documents with equal sets form a
class, and classes are what is compared.  A signature has ``SYMBOLS`` minima of
16 bits.  Two signatures within a distance of unequal symbols agree, by the
pigeonhole principle, on all symbols but one of at least one chunk, if there are
more than half as many chunks as symbols may differ; every chunk is therefore
indexed under each choice of the one symbol that may be wrong.  All pairs under
the distance meet under some key.  The distance follows from the similarity: at
0.85 a symbol differs with probability 0.15, and a pair lies beyond the distance
with probability below one in a million.

Pairs of a key are never all formed.  Each key has a centre, its member that
shares keys with the most others; every member is confirmed against the centre
on the full sets, and links give components.  A group of one centre in which
several components are left is searched on: its members outside the centre's
component, the query set, are compared with the others in blocks, by signature
and then on the full sets.  Jaccard distance is a metric, so blocks whose
distances to the centre are too far apart are left out.  Inside a block, pairs
that links found before already join are not looked at, so that a block gives
fewer links than it has members.  Components cover all links.

Facts about a key, a centre or a component that many rows may hold are looked up
through salted cells, so that no task gathers one of them.

Null texts and texts without words have an empty set and link with nothing.
Rows with words that share a ``doc_id`` are linked; rows without number are not,
and a null ``doc_id`` counts as smaller than any other.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_slices, written
from .words import mix, shingle_hashes, words_of

SYMBOLS = 64
#: Probability with which a pair of just the least similarity lies beyond the distance.
MISSED = 1e-6
#: Members of a group that are confirmed with one copy of their centre's set.
BLOCK = 256
#: Members of a group that are compared at a time in the search.  A row is sent once for each block that it meets.
SEARCH_BLOCK = 2048
#: Cells over which the rows of one key are spread when they look up facts about it.
SALTS = 64
#: Bytes of text that a task handles at a time.
SLICE_BYTES = 4_000_000
_draw = np.random.default_rng(31)
_FLIP = _draw.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_TIMES = _draw.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distance_for(percent: int) -> int:
    """Unequal symbols that pairs of this similarity stay within."""
    p = 1 - percent / 100
    tail = lambda t: sum(comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k) for k in range(t + 1, SYMBOLS + 1))
    return next(t for t in range(SYMBOLS + 1) if tail(t) < MISSED)


def chunk_edges(percent: int) -> list[int]:
    """Bounds of the chunks: so many that one has at most one unequal symbol."""
    chunks = min(distance_for(percent) // 2 + 1, SYMBOLS // 2)
    return np.linspace(0, SYMBOLS, chunks + 1).round().astype(int).tolist()


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = words_of(texts, fold=True)
    every = shingle_hashes(words.hashes, n)
    found = []
    for s, e in zip(words.bounds[:-1], words.bounds[1:]):
        if e - s >= n:
            found.append(np.unique(every[s : e - n + 1]))
        else:  # the whole sequence is one shingle, told from others by its length
            found.append(mix(shingle_hashes(words.hashes[s:e], e - s) + np.uint64(1)) if e > s else every[:0])
    return found


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit minima of each (non-empty) set."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    first = np.cumsum([0, *map(len, sets[:-1])]) if sets else np.zeros(0, np.int64)
    found = np.empty((len(sets), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        if len(sets):
            found[:, k] = np.minimum.reduceat(((flat ^ _FLIP[k]) * _TIMES[k]) >> np.uint64(32), first) & np.uint64(0xFFFF)
    return found


def index_keys(signs: np.ndarray, percent: int = 85) -> np.ndarray:
    """A 64-bit key for each chunk and each symbol of it that may be wrong."""
    keys, edges = [], chunk_edges(percent)
    for c, (s, e) in enumerate(zip(edges, edges[1:])):
        for wrong in range(s, e):
            total = np.full(len(signs), c << 8 | wrong - s, np.uint64)
            for k in range(s, e):
                if k != wrong:
                    total = mix(total) + signs[:, k].astype(np.uint64)
            keys.append(mix(total))
    return np.stack(keys, 1).view(np.int64)


_SKETCH = "doc_id long, text_key long, n_shingles long, set_key binary, signature binary, keys array<long>"


def sketches(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, a 128-bit key of the set, the signature and its index keys; the last three null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE_BYTES):
            sets = shingle_sets(part.column("text"), n)
            full = [s for s in sets if len(s)]
            signs = signatures(full)
            keys = iter(index_keys(signs, percent))
            signs = iter(signs)
            rows = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), next(signs).tobytes(), next(keys)) if len(s) else (None, None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_shingles", "set_key", "signature", "keys"])

    return docs.mapInArrow(run, _SKETCH)


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """node and shingles (array of 64-bit hashes) of rows with node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE_BYTES):
            sets = [s.view(np.int64) for s in shingle_sets(part.column("text"), n)]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles array<long>")


def look_up(rows: DataFrame, key: str, facts: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``facts``, which has a row for each ``key``.

    Rows of a key are spread over ``SALTS`` cells by the column ``by``; the facts
    go to each cell that exists, so a key that very many rows hold is met in
    several places.
    """
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    cells = rows.select(key, "_salt").distinct()
    return rows.join(cells.join(facts, key), [key, "_salt"], how).drop("_salt")


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node and component (the smallest node reachable) of every node of ``links`` (a, b)."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(most_rounds):
        # The smallest label next to a node, then that label's own label.
        near = look_up(edges, "b", labels.withColumnRenamed("node", "b"), "a").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        step = written(step, "labels")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = written(look_up(step, "label", jump, "node").select("node", F.least("label", "further").alias("label"), "was"), "labels")
        if labels.where(F.col("label") != F.col("was")).isEmpty():
            break
        labels = labels.drop("was")
    else:
        raise RuntimeError("components did not settle")
    return labels.select("node", F.col("label").alias("component"))


def _similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def unequal_symbols(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of each pair of signatures (rows of symbols): how many symbols differ."""
    total = np.zeros((len(left), len(right)), np.uint8)
    for k in range(SYMBOLS):
        total += left[:, None, k] != right[None, :, k]
    return total


def _signs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, SYMBOLS)


def block_links(rows: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between the two sides of a block; a pair that earlier links of the block join, or of one component, is left out."""
    left, right = (rows[rows["side"] == s] for s in (0, 1))
    if left.empty or right.empty:
        return []
    n, m, nodes, others = left["n"].to_numpy(), right["n"].to_numpy(), left["node"].tolist(), right["node"].tolist()
    signs, their_signs, distance = _signs(left["signature"]), _signs(right["signature"]), distance_for(percent)
    roots: dict[int, int] = {}

    def root(x: int) -> int:
        while roots.setdefault(x, x) != x:
            roots[x] = roots[roots[x]]
            x = roots[x]
        return x

    own, sets, found = left["shingles"].tolist(), right["shingles"].tolist(), []
    labels, their = left["label"].tolist(), right["label"].tolist()
    for i in range(len(nodes)):
        # Nearest first: once a member is joined, its other links within the component need no look.
        unequal = unequal_symbols(signs[i : i + 1], their_signs)[0]
        maybe = np.flatnonzero((unequal <= distance) & (100 * np.minimum(n[i], m) >= percent * np.maximum(n[i], m)))
        for j in maybe[np.argsort(unequal[maybe], kind="stable")].tolist():
            a, b = root(labels[i]), root(their[j])  # components of the links before, joined on in this block
            if a != b:
                shared = len(np.intersect1d(own[i], sets[j], assume_unique=True))
                if _similar(shared, n[i], m[j], percent):
                    found.append((nodes[i], others[j]))
                    roots[a] = b
    return found


def _linked(docs: DataFrame, percent: int, n: int) -> DataFrame:
    """doc_id, text_key, n_shingles and first (doc_id and text_key of the smallest row of the component; null for an empty set)."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], F.xxhash64(docs["text"]).alias("text_key"))
    sketched = written(sketches(docs, n, percent), "sketches")
    own = sketched.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("keys").alias("keys"))
    classes = written(own.withColumn("node", F.monotonically_increasing_id()), "classes")

    every = classes.select("node", F.explode("keys").alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    keyed = written(every.join(shared, "key"), "keys")
    popular = keyed.groupBy("node").agg(F.sum("size").alias("met"))
    centres = keyed.join(popular, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("centre")).select("key", F.col("centre.node").alias("centre"))
    members = written(look_up(keyed, "key", centres, "node").where(F.col("node") != F.col("centre")).select("node", "centre").distinct(), "members")

    involved = classes.join(members.select("node").union(members.select("centre")).distinct().hint("merge"), "node", "left_semi").select("node", F.col("first.doc_id").alias("own_id"), F.col("first.text_key").alias("own_key"))
    # Joins that carry texts, sets or signatures are sort-merge joins at every size, so that plans do not change as tables grow.
    texts = docs.join(involved.hint("merge"), (docs.text_key == involved.own_key) & docs.doc_id.eqNullSafe(involved.own_id)).select("node", "text")
    sets = written(full_sets(texts, n).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets").hint("merge")

    # Members against centres, a centre's set repeated for each BLOCK of its members.
    slices = members.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slices"))
    dealt = look_up(members, "centre", slices, "node").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    spread = slices.join(sets.select(F.col("node").alias("centre"), F.col("shingles").alias("centre_set")), "centre").select("centre", "centre_set", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    shared_n = F.size(F.array_intersect("shingles", "centre_set"))
    union_n = F.size("shingles") + F.size("centre_set") - shared_n
    # Rows of one doc_id with several sets.
    numbered = sketched.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    torn = numbered.groupBy("doc_id").agg(F.min(F.xxhash64("set_key")).alias("low"), F.max(F.xxhash64("set_key")).alias("high")).where("low <> high").select("doc_id")
    torn = look_up(numbered.select("doc_id", "set_key"), "doc_id", torn, "set_key").join(classes.select("set_key", "node").hint("merge"), "set_key").select("doc_id", "node").distinct()
    torn = look_up(torn, "doc_id", torn.groupBy("doc_id").agg(F.min("node").alias("b")), "node").where("node <> b").select(F.col("node").alias("a"), "b")
    judged = written(dealt.join(sets, "node").join(spread, ["centre", "slice"]).select("node", "centre", shared_n.alias("shared"), union_n.alias("union")), "judged")
    links = judged.where(F.col("shared") * 100 >= F.col("union") * percent).select(F.col("node").alias("a"), F.col("centre").alias("b"))
    links = written(links.union(torn), "links")
    labels = components(links)

    more = written(_search_on(judged, labels, classes.select("node", "n", "signature"), sets, percent), "more-links")
    if not more.isEmpty():
        labels = components(links.union(more))

    home = classes.select("set_key", "node", "first").join(labels.hint("merge"), "node", "left").select("set_key", "first", F.coalesce("component", "node").alias("component"))
    home = written(home, "home")
    smallest = home.groupBy("component").agg(F.min("first").alias("least"))
    home = look_up(home, "component", smallest, "set_key").select("set_key", F.col("least").alias("first"))
    return look_up(sketched.select("doc_id", "text_key", "n_shingles", "set_key"), "set_key", home.hint("merge"), "text_key", "left").drop("set_key")


def _search_on(judged: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside the groups of the centres."""
    known = judged.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    mine = judged.select(F.col("centre").alias("node")).distinct().join(labels.hint("merge"), "node", "left").select(F.col("node").alias("centre"), F.coalesce("component", "node").alias("centre_label"))
    known = look_up(known, "centre", mine, "node").select("centre", "node", (1 - F.col("shared") / F.col("union")).alias("far"), "label", (F.col("label") == F.col("centre_label")).alias("main"))
    known = written(known, "groups")
    # A group is done when at most one member is outside the centre's component and no other is inside.
    open_groups = known.groupBy("centre").agg(F.count_if(~F.col("main")).alias("outside"), F.count_if("main").alias("inside")).where("outside > 1 OR (outside > 0 AND inside > 0)").select("centre")
    rows = look_up(known, "centre", open_groups, "node")
    # Bands of the distance to the centre, as wide as a link may be long; a link joins one band or two next to each other.
    band = F.floor(F.col("far") * 100 / (100 - percent) - 1e-9).cast("int")
    rows = written(rows.withColumn("cell", F.struct("centre", F.greatest(F.lit(0), band).alias("band"), "main")).drop("centre", "far", "main"), "open")
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / SEARCH_BLOCK).cast("int").alias("blocks"))
    placed = look_up(rows, "cell", sizes, "node").select(F.col("cell.centre").alias("centre"), F.struct("cell.band", "cell.main", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")).alias("cell"), "node", "label")
    cells = written(sizes.select("cell.*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), "cells")
    a, b = (cells.select("centre", F.struct("band", "main", "block").alias(name)) for name in ("left", "right"))
    # Blocks of the query set (not in the centre's component) with blocks of the bands around; each pair of blocks once.
    asked = a.where(~F.col("left.main")).join(b, "centre").where(F.abs(F.col("left.band") - F.col("right.band")) <= 1)
    asked = asked.where(F.col("right.main") | (F.col("left") <= F.col("right")))
    asked = written(asked.withColumn("task", F.monotonically_increasing_id()), "blocks")
    sides = asked.select("centre", "task", F.col("left").alias("cell"), F.lit(0).alias("side")).union(asked.select("centre", "task", F.col("right"), F.lit(1)))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(rows, percent), columns=["a", "b"]).astype("int64")

    placed = placed.join(sides, ["centre", "cell"]).select("task", "side", "node", "label").join(classes.hint("merge"), "node").join(sets, "node")
    return placed.groupBy("task").applyInPandas(compare, "a long, b long")


def link_documents(docs: DataFrame, percent: int = 80, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; links have 100 * intersection >= ``percent`` * union."""
    smallest = F.when(F.col("first").isNotNull(), F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return _linked(docs, percent, n).select("doc_id", "n_shingles", smallest.alias("component_id"), F.col("doc_id").eqNullSafe(smallest).alias("kept"))


def keep_one_of_each(docs: DataFrame, percent: int = 80, n: int = 5) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest ``doc_id``; all columns.

    Of a component's rows that share this ``doc_id`` one stays; rows without words all stay.
    """
    rows = written(_linked(docs, percent, n), "linked")
    chosen = F.col("first").isNull() | (F.col("text_key") == F.col("first.text_key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    kept = rows.where(chosen).groupBy(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).agg(F.count("*").alias("copies"), F.bool_or(F.col("first").isNotNull()).alias("one"))
    columns = docs.columns
    held = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), docs["doc_id"].cast("long").alias("row_id"), F.xxhash64(docs["text"]).alias("row_key"))
    held = held.join(kept.hint("merge"), F.col("row_key").eqNullSafe(F.col("kept_key")) & F.col("row_id").eqNullSafe(F.col("kept_id")))
    if kept.where("one AND copies > 1").isEmpty():
        return held.select("row.*")
    repeated = F.col("one") & (F.col("copies") > 1)
    once = held.where(repeated).groupBy("row_id", "row_key").agg(F.first("row").alias("row"))
    return held.where(~repeated).select("row.*").unionByName(once.select("row.*"))
