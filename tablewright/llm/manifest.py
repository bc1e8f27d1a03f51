"""Merkle manifest of a table: one root for all rows, and a proof for each row.

Every row is a leaf, the digest of its fields.  Leaves are grouped by source and
ascend by ``doc_id`` in their group; sixteen consecutive nodes (the last run:
fewer, even one) become their digest until one is left, the group's subroot.
Subroots, ordered by source, give the root in the same way.

Leaves are range-sorted over the partitions of an RDD, so a large group lies in
many of them.  A first pass counts, for each partition, only its first and last
group, and from these counts the driver gives each partition the place of its
first leaf in that leaf's group and the sizes of the groups it shares with
others.  A second pass builds every subtree that lies whole and aligned in a
partition; what is left at the edges, some nodes for each level, is shuffled by
coordinate (tree, level, run), and the upper levels are finished there, level by
level.  Each partition asks for the runs above its edges, and a third pass
returns the proofs.  What the driver holds grows with the number of partitions,
what a task holds with the rows of a partition; a group of one run of sixteen is
the most that is gathered by a key.

A null field counts as ``-``, any other as the number of its UTF-8 bytes, a
colon and the value.  A null source comes first and is a group of its own, null
numbers come first in a group, equal numbers are ordered by their leaf; repeated
rows are leaves of their own.  An empty table gives an empty result.  Only the
named fields are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Nodes of a run.
FAN = 16
#: Leaves that a partition holds, about.
PARTITION_LEAVES = 100_000
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: The tree of all subroots; the trees of groups are numbered from 0.
TOP = -1


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """Lowercase hex digest of the fields, each ``-`` or its bytes' number, a colon and the value."""
    value = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*value), 256)


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """Root that a leaf and what stands before and after each node on its way up give."""
    for before, after in path:
        leaf = digest(before + leaf + after)
    return leaf


class Part:
    """Consecutive nodes of a tree, and every node above them that they make up whole."""

    def __init__(self, tree: int, start: int, nodes: list[str], size: int):
        """``start``: place of the first node; ``size``: nodes of the whole level."""
        self.tree, self.levels = tree, [(start, nodes, size)]
        while size > 1 and nodes:
            end = start + len(nodes)
            first, last = -(-start // FAN), -(-size // FAN) if end == size else end // FAN
            nodes = [digest("".join(nodes[k * FAN - start : (k + 1) * FAN - start])) for k in range(first, last)]
            start, size = first, -(-size // FAN)
            self.levels.append((start, nodes, size))

    def made(self, level: int, place: int) -> bool:
        if level >= len(self.levels):
            return False
        start, nodes, _ = self.levels[level]
        return start <= place < start + len(nodes)

    def edges(self) -> Iterator[tuple[int, int, int, str]]:
        """level, place, size of the level and digest of the nodes without a parent here; a tree's last node is one."""
        for level, (start, nodes, size) in enumerate(self.levels):
            for k, node in enumerate(nodes, start):
                if size == 1 or not self.made(level + 1, k // FAN):
                    yield level, k, size, node

    def run(self, level: int, k: int) -> list[str] | None:
        """Nodes of a run that is whole here."""
        if not self.made(level + 1, k):
            return None
        start, nodes, _ = self.levels[level]
        return nodes[k * FAN - start : (k + 1) * FAN - start]

    def wants(self, low: int, high: int) -> Iterator[tuple[int, int]]:
        """level and number of the runs above the places ``low`` to ``high`` that are not whole here."""
        size, level = self.levels[0][2], 0
        while size > 1:
            low, high = low // FAN, high // FAN
            yield from ((level, k) for k in range(low, high + 1) if not self.made(level + 1, k))
            size, level = -(-size // FAN), level + 1


def leaf_table(docs: DataFrame, source: str, number: str, leaf: Column, claimed: Column | None = None) -> DataFrame:
    """group (bytes that tell sources apart), source, doc_id, leaf and claimed (bytes) and place (of the row, to order equal ones)."""
    kind = F.coalesce(F.unhex(F.sha2(docs[source].cast("string"), 256)), F.lit(b""))
    other = F.lit(None).cast("binary") if claimed is None else F.unhex(claimed)
    rows = docs.select(kind.alias("group"), docs[source].cast("string").alias("source"), docs[number].cast("long").alias("doc_id"), F.unhex(leaf).alias("leaf"), other.alias("claimed"))
    return written(rows.withColumn("place", F.monotonically_increasing_id()), "leaves")


def range_sorted(leaves: DataFrame) -> RDD:
    """(group, doc_id, leaf, claimed) in the order of the leaves, over partitions of about ``PARTITION_LEAVES``."""
    order = [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "leaf", "place")]
    parts = max(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // PARTITION_LEAVES))
    return leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("group", "doc_id", "leaf", "claimed").rdd


def _ends(part: int, rows) -> Iterator[tuple]:
    """Of a partition that holds rows: its number, the number of its groups, and its first and last group with their rows here."""
    counts = [(group, sum(1 for _ in found)) for group, found in groupby(rows, lambda r: bytes(r[0]))]
    if counts:
        yield part, len(counts), counts[0], counts[-1]


class Frames:
    """Where each partition's groups lie in their trees; an entry for each partition, whatever the number of groups."""

    def __init__(self, ends: list[tuple]):
        self.starts: dict[int, tuple[int, int]] = {}
        self.shared: dict[int, int] = {}
        number, last, so_far = -1, None, 0
        for part, groups, (first, n_first), (final, n_final) in sorted(ends):
            if first != last:
                number, so_far = number + 1, 0
            self.starts[part] = number, so_far
            self.shared[number] = so_far = so_far + n_first
            if groups > 1:
                number += groups - 1
                self.shared[number] = so_far = n_final
            last = final
        self.groups = number + 1

    def parts(self, part: int, rows: list) -> Iterator[tuple[Part, list]]:
        """The trees' parts that a partition holds, each with its rows."""
        number, start = self.starts.get(part, (0, 0))
        for _, found in groupby(rows, lambda r: bytes(r[0])):
            found = list(found)
            yield Part(number, start, [bytes(r[2]).hex() for r in found], self.shared.get(number, len(found))), found
            number, start = number + 1, 0

    def top(self, parts: list[Part]) -> Part:
        """Of the tree of subroots, those of the groups that are whole here."""
        whole = [p for p in parts if p.levels[-1][2] == 1 and p.levels[-1][1]]
        return Part(TOP, whole[0].tree if whole else 0, [p.levels[-1][1][0] for p in whole], self.groups)


def _edges(frames: Frames, part: int, rows) -> Iterator[tuple]:
    """part, tree, level, place (of a node) or run (that is wanted), size and digest (null for a run) of a partition's edges."""
    parts = [p for p, _ in frames.parts(part, rows)]
    if not parts:
        return
    top = frames.top(parts)
    for p in parts:
        start, nodes, size = p.levels[0]
        if p.levels[-1][2] > 1 or not p.levels[-1][1]:
            for level, place, size, node in p.edges():
                yield part, p.tree, level, place, size, node
            for level, run in p.wants(start, start + len(nodes) - 1):
                yield part, p.tree, level, run, 0, None
    for level, place, size, node in top.edges():
        yield part, TOP, level, place, size, node
    for level, run in top.wants(parts[0].tree, parts[-1].tree):
        yield part, TOP, level, run, 0, None


def finish(nodes: DataFrame, size: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Runs (tree, level, run, children) above the given nodes, level by level, and the trees' roots (tree, hash)."""
    runs, roots, carried, level = [], [nodes.where("size = 1").select("tree", "hash")], None, 0
    while size > 1:
        at = nodes.where((F.col("level") == level) & (F.col("size") > 1)).select("tree", "place", "size", "hash")
        at = at.union(carried) if carried is not None else at
        of = at.groupBy("tree", F.floor(F.col("place") / FAN).alias("run")).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("nodes"))
        run = written(of.select("tree", F.lit(level).alias("level"), "run", "size", F.col("nodes.hash").alias("children")), "runs")
        above = run.select("tree", F.col("run").alias("place"), F.ceil(F.col("size") / FAN).alias("size"), F.sha2(F.array_join("children", ""), 256).alias("hash"))
        runs.append(run.drop("size"))
        roots.append(above.where("size = 1").select("tree", "hash"))
        carried, size, level = above.where("size > 1"), -(-size // FAN), level + 1
    return runs, roots


def _prove(frames: Frames, part: int, rows: list, asked: dict, root: str, siblings: bool) -> Iterator[tuple]:
    held = list(frames.parts(part, rows))
    top = frames.top([p for p, _ in held])

    def step(tree: Part, level: int, place: int) -> tuple[str, str]:
        nodes, k = tree.run(level, place // FAN) or asked[tree.tree, level, place // FAN], place % FAN
        return "".join(nodes[:k]), "".join(nodes[k + 1 :])

    def above(tree: Part, level: int, place: int) -> list[tuple[str, str]]:
        size, path = -(-tree.levels[0][2] // FAN**level), []
        while size > 1:
            path.append(step(tree, level, place))
            place, level, size = place // FAN, level + 1, -(-size // FAN)
        return path if tree is top else path + above(top, 0, tree.tree)

    for p, found in held:
        start, nodes, size = p.levels[0]
        subroots = [root] if frames.groups == 1 else top.run(0, p.tree // FAN) or asked[TOP, 0, p.tree // FAN]
        subroot, tail, tail_of = subroots[p.tree % FAN], above(top, 0, p.tree), None
        for place, (row, leaf) in enumerate(zip(found, nodes), start):
            path = tail
            if size > 1:
                if tail_of != place // FAN:  # leaves of a run share all but the first step
                    tail, tail_of = above(p, 1, place // FAN), place // FAN
                path = [step(p, 0, place), *tail]
            folded = fold(bytes(row[3]).hex() if row[3] is not None else leaf, path)
            proof = digest("".join(x + y for x, y in path))
            yield (row[1], leaf, subroot, root, proof, folded, folded == root) + ((path,) if siblings else ())


_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(leaves: DataFrame, siblings: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the claimed leaf, where there is one) and verified of every leaf.

    With ``siblings``, also the proof itself: ``path``, an array of what stands
    before and after the node on each level, for :func:`fold`.
    """
    spark = leaves.sparkSession
    schema = _RESULT + ", path array<struct<before:string,after:string>>" * siblings
    rows = range_sorted(leaves)
    frames = Frames(rows.mapPartitionsWithIndex(_ends).collect())
    if not frames.groups:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(frames)  # an entry for each partition
    edges = rows.mapPartitionsWithIndex(lambda part, it: _edges(held.value, part, it))
    edges = written(spark.createDataFrame(edges, "part int, tree long, level int, place long, size long, hash string", verifySchema=False), "edges")
    nodes = edges.where("hash IS NOT NULL")
    runs, subroots = finish(nodes.where(F.col("tree") != TOP), max(frames.shared.values()))
    tops = nodes.where(F.col("tree") == TOP).select("tree", "level", "place", "size", "hash")
    for shared in subroots:
        tops = tops.union(shared.select(F.lit(TOP).cast("long"), F.lit(0), F.col("tree"), F.lit(frames.groups).cast("long"), "hash"))
    top_runs, roots = finish(tops, frames.groups)
    root = next(r.hash for found in reversed(roots) for r in found.take(1))

    wanted = edges.where("hash IS NULL").select("part", "tree", "level", F.col("place").alias("run"))
    every = None
    for found in runs + top_runs:
        every = found if every is None else every.union(found)
    asked = wanted.join(every, ["tree", "level", "run"]).select("part", "tree", "level", "run", "children").rdd if every is not None else spark.sparkContext.emptyRDD()
    # The runs a partition asked for come to it by its number; its leaves stay where they are.
    asked = asked.map(lambda r: (r[0], ((r[1], r[2], r[3]), r[4]))).partitionBy(rows.getNumPartitions(), lambda part: part)
    both = rows.mapPartitions(lambda it: [list(it)]).zip(asked.mapPartitions(lambda it: [dict(x for _, x in it)]))
    proven = both.mapPartitionsWithIndex(lambda part, it: (row for mine, runs in it for row in _prove(held.value, part, mine, runs, root, siblings)))
    return spark.createDataFrame(proven, schema, verifySchema=False)
