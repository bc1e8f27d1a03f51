"""Gradient boosting of several classes as one model.

A round fits one regression tree for each class to the gradient of a single
softmax, so classes share their scores in every round.  Features are cut once
into bins at their quantiles.  A tree grows level by level: tasks add up a
histogram of gradients for each class, node, feature and bin over their rows, and
a tree reduction adds the histograms, whose size follows from the model's
settings and not from the rows.  Rows stay where they are, as blocks of numbers
in memory or on disk; nothing is shuffled but histograms.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds after which the rows' scores are stored again.
KEPT = 10
#: Expressions in one aggregate.
TOGETHER = 100


def softmax(scores: np.ndarray) -> np.ndarray:
    shifted = np.exp(scores - scores.max(1, keepdims=True))
    return shifted / shifted.sum(1, keepdims=True)


class Tree:
    """A regression tree in a heap: node k has the children 2 k + 1 and 2 k + 2; ``feature`` is -1 where it ends.

    ``cut`` is a bin while the tree grows and a value afterwards; rows at or below it go left.
    """

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.feature, self.cut = np.full(size, -1), np.zeros(size)
        self.value, self.cover = np.zeros(size), np.zeros(size)

    def leaves(self, x: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row after so many levels."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(levels):
            feature = self.feature[at]
            left = x[rows, np.maximum(feature, 0)] <= self.cut[at]
            at = np.where(feature < 0, at, 2 * at + np.where(left, 1, 2))
        return at

    @property
    def depth(self) -> int:
        return (len(self.feature) + 1).bit_length() - 2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x, self.depth)]

    def at_values(self, cuts: list[np.ndarray]) -> Tree:
        """The same tree with values for bins."""
        found = Tree(self.depth)
        found.feature, found.value, found.cover = self.feature, self.value, self.cover
        found.cut = np.array([cuts[f][int(c)] if f >= 0 else 0.0 for f, c in zip(self.feature, self.cut)])
        return found

    def as_lists(self) -> dict:
        return {k: getattr(self, k).tolist() for k in ("feature", "cut", "value", "cover")}

    @staticmethod
    def of_lists(lists: dict) -> Tree:
        found = Tree((len(lists["feature"]) + 1).bit_length() - 2)
        for k, v in lists.items():
            setattr(found, k, np.array(v))
        return found


def bin_cuts(df: DataFrame, features: str, size: int, bins: int) -> list[np.ndarray]:
    """Rising values of each feature between which its bins lie, at approximate quantiles."""
    shares = [k / bins for k in range(1, bins)]
    found = []
    for start in range(0, size, TOGETHER):
        x = vector_to_array(features)
        cells = [F.percentile_approx(F.nanvl(F.get(x, k), F.lit(None).cast("double")), F.array(*map(F.lit, shares)), 50 * bins).alias(f"c{k}") for k in range(start, min(size, start + TOGETHER))]
        found += [np.unique(c) if c else np.zeros(0) for c in df.agg(*cells).first()]
    return found


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Number of each value's bin: how many cuts lie below it; missing values come last."""
    return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1).astype(np.uint8)


def blocks_of(df: DataFrame, features: str, label: str, cuts: list[np.ndarray]) -> DataFrame:
    """The rows as blocks: bins and labels of many rows in two byte strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                labels = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([binned(x, cuts).tobytes()]), pa.array([labels.tobytes()])], names=["bins", "labels"])

    return df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).mapInArrow(run, "bins binary, labels binary")


def histogram(block: tuple, done: list[list[Tree]], growing: list[Tree], level: int, bins: int) -> np.ndarray:
    """Sums of gradient, its slope and rows by class, node of the level, feature and bin; the loss and rows come last."""
    x, labels, scores = block
    for trees in done:
        scores = scores + np.stack([t.scores(x) for t in trees], 1)
    p = softmax(scores)
    classes, features, nodes = len(growing), x.shape[1], 2**level
    out = np.zeros((classes, nodes, features, bins, 3))
    for k, tree in enumerate(growing):
        at = tree.leaves(x, level) - (nodes - 1)
        here = at >= 0  # others ended on a level above
        cells = ((at[here, None] * features + np.arange(features)) * bins + x[here]).ravel()
        gradient, slope = (labels[here] == k) - p[here, k], p[here, k] * (1 - p[here, k])
        for s, weights in enumerate((gradient, slope, None)):
            out[k, ..., s] = np.bincount(cells, None if weights is None else np.repeat(weights, features), nodes * features * bins).reshape(nodes, features, bins)
    loss = -np.log(np.maximum(p[np.arange(len(x)), labels], 1e-300)).sum()
    return np.append(out.ravel(), [loss, len(x)])


def grow(tree: Tree, level: int, sums: np.ndarray, scale: float) -> None:
    """Split the nodes of a level where that explains more of the gradient, and give the new nodes their values."""
    newton = lambda g, h: scale * g / h if abs(h) > 1e-150 else 0.0
    first = 2**level - 1
    for node, cells in enumerate(sums, first):
        g, h, n = cells[0].sum(0)
        if level == 0:
            tree.value[node], tree.cover[node] = newton(g, h), n
        if n < 2:
            continue
        left = np.cumsum(cells, 1)[:, :-1]
        right = cells.sum(1)[:, None] - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[..., 0] ** 2 / left[..., 2] + right[..., 0] ** 2 / right[..., 2] - g * g / n
        gain[(left[..., 2] < 0.5) | (right[..., 2] < 0.5)] = -np.inf
        f, b = np.unravel_index(np.argmax(gain), gain.shape)
        if not gain[f, b] > 1e-12:
            continue
        tree.feature[node], tree.cut[node] = f, b
        for child, (cg, ch, cn) in ((2 * node + 1, left[f, b]), (2 * node + 2, right[f, b])):
            tree.value[child], tree.cover[child] = newton(cg, ch), cn


class SoftmaxBoosting(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Boosting with one softmax over the classes 0, 1, ... of the label column."""

    rounds = Param(Params._dummy(), "rounds", "trees of each class", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of a tree's step that is taken", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, 256 at most", TypeConverters.toInt)

    def __init__(self, rounds: int = 100, maxDepth: int = 3, rate: float = 0.1, maxBins: int = 32):  # noqa: N803
        super().__init__()
        self._set(rounds=rounds, maxDepth=maxDepth, rate=rate, maxBins=maxBins)

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostingModel:
        features, label = self.getFeaturesCol(), self.getLabelCol()
        rounds, depth, rate, bins = (self.getOrDefault(p) for p in (self.rounds, self.maxDepth, self.rate, self.maxBins))
        counted = {int(r[0]): r[1] for r in dataset.groupBy(F.col(label).cast("double")).count().collect()}
        if not counted or min(counted) < 0:
            raise ValueError("labels are 0, 1, ... and there must be some")
        classes = max(counted) + 1
        total = sum(counted.values())
        prior = np.log(np.maximum([counted.get(k, 0) / total for k in range(classes)], 1e-12))
        size = dataset.select(F.size(vector_to_array(features))).first()[0]
        cuts = bin_cuts(dataset, features, size, bins)

        def of_bytes(row):
            labels = np.frombuffer(row[1], np.int32)
            return np.frombuffer(row[0], np.uint8).reshape(len(labels), size), labels, np.tile(prior, (len(labels), 1))

        blocks = blocks_of(dataset, features, label, cuts).rdd.map(of_bytes).persist(StorageLevel.MEMORY_AND_DISK)
        every: list[list[Tree]] = []
        done: list[list[Tree]] = []
        losses = []
        for number in range(rounds):
            growing = [Tree(depth) for _ in range(classes)]
            for level in range(depth):
                sums = blocks.map(lambda b, d=done, g=growing, at=level: histogram(b, d, g, at, bins)).treeReduce(np.add)
                for tree, cells in zip(growing, sums[:-2].reshape(classes, 2**level, size, bins, 3)):
                    grow(tree, level, cells, rate * (classes - 1) / classes)
                if level == 0:
                    losses.append(float(sums[-2] / sums[-1]))
            every.append(growing)
            done = [*done, growing]
            if len(done) == KEPT and number < rounds - 1:
                last, blocks = blocks, blocks.map(lambda b, d=done: (b[0], b[1], b[2] + sum(np.stack([t.scores(b[0]) for t in trees], 1) for trees in d))).persist(StorageLevel.MEMORY_AND_DISK)
                blocks.count()
                last.unpersist()
                done = []
        blocks.unpersist()
        found = {"prior": prior.tolist(), "rounds": [[t.at_values(cuts).as_lists() for t in trees] for trees in every], "losses": losses, "size": size}
        return self._copyValues(SoftmaxBoostingModel()._set(trees=json.dumps(found)))


class SoftmaxBoostingModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Scores of all classes, their softmax and the class of the highest one (of equal ones the first)."""

    trees = Param(Params._dummy(), "trees", "prior scores and all trees, as JSON", TypeConverters.toString)

    def forest(self) -> tuple[np.ndarray, list[list[Tree]]]:
        held = json.loads(self.getOrDefault(self.trees))
        return np.array(held["prior"]), [[Tree.of_lists(t) for t in trees] for trees in held["rounds"]]

    @property
    def losses(self) -> list[float]:
        """Mean negative log-likelihood of the training rows before each round."""
        return json.loads(self.getOrDefault(self.trees))["losses"]

    @property
    def numClasses(self) -> int:  # noqa: N802
        return len(json.loads(self.getOrDefault(self.trees))["prior"])

    @property
    def featureImportances(self):  # noqa: N802
        """Share of the rows' splits that each feature makes, as a vector."""
        from pyspark.ml.linalg import Vectors

        total = np.zeros(json.loads(self.getOrDefault(self.trees))["size"])
        for trees in self.forest()[1]:
            for t in trees:
                np.add.at(total, t.feature[t.feature >= 0], t.cover[t.feature >= 0])
        return Vectors.dense(total / (total.sum() or 1.0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        prior, rounds = self.forest()

        @F.pandas_udf("array<double>")
        def scored(vectors: pd.Series) -> pd.Series:
            if vectors.empty:
                return pd.Series([], dtype=object)
            x = np.stack(vectors.to_list()).astype(float)
            scores = np.tile(prior, (len(x), 1))
            for trees in rounds:
                scores += np.stack([t.scores(x) for t in trees], 1)
            return pd.Series(list(scores))

        raw, likely, said = self.getRawPredictionCol(), self.getProbabilityCol(), self.getPredictionCol()
        out = dataset.withColumn(raw, scored(vector_to_array(self.getFeaturesCol())))
        powers = F.transform(raw, lambda s: F.exp(s - F.array_max(raw)))
        out = out.withColumn(likely, F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)))
        out = out.withColumn(said, (F.array_position(raw, F.array_max(raw)) - 1).cast("double"))
        return out.withColumn(raw, array_to_vector(raw)).withColumn(likely, array_to_vector(likely))
