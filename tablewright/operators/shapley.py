"""Shapley values of predictions.

For ensembles of trees they are exact and take polynomial time.  A leaf is
reached where all features on its path agree; of a feature outside the coalition
only the share of training rows that goes the path's way is known.  What a leaf
gives to a coalition is a product over the features of its path, and a feature's
Shapley value in such a product is the integral, for t from 0 to 1, of the
others' product with each factor weighed t for the row's own way and 1 - t for
the share.  That is a polynomial in t, so Gauss-Legendre points give it exactly.
Nodes are read once from the model and go to the tasks; rows are taken in batches.

For any other model coalitions of features are scored against background rows,
and weighted least squares with the kernel of Shapley values gives the
contributions.  Few features have all their coalitions scored; of more features,
coalitions are drawn in pairs with their complements.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import col, hashed_uniform
from .boosting import SoftmaxBoostingModel
from .learn import ID, Trained, class_scores, permutation_importance

#: Rows of the background, and coalitions that are scored at most.
BACKGROUND, COALITIONS = 100, 2048


@dataclass
class Path:
    """A way to a leaf: for each feature on it, what its values must meet and the share of rows that meet it."""

    features: list[int]
    tests: list[list[tuple[float | frozenset, bool]]]  # of each feature: (threshold or left categories, whether it goes left)
    shares: list[float]
    value: np.ndarray  # of each output

    def met(self, x: np.ndarray) -> np.ndarray:
        """Of each feature (rows) and row of x (columns): whether the row goes this way."""
        found = np.ones((len(self.features), len(x)), bool)
        for k, (feature, tests) in enumerate(zip(self.features, self.tests)):
            for test, left in tests:
                goes = np.isin(x[:, feature], list(test)) if isinstance(test, frozenset) else x[:, feature] <= test
                found[k] &= goes == left
        return found


class Forest:
    """Paths of all trees of a model, whose outputs are sums over trees."""

    def __init__(self, base: np.ndarray, size: int):
        self.outputs, self.size, self.offset, self.paths = len(base), size, base, []

    def add(self, feature, test, children, cover, value) -> None:
        """A tree by arrays over its nodes, 0 being the root; ``feature`` is negative at leaves, ``value`` has all outputs."""
        open_nodes = [(0, {})]
        while open_nodes:
            node, way = open_nodes.pop()
            if feature[node] < 0:
                self.paths.append(Path(list(way), [w[0] for w in way.values()], [w[1] for w in way.values()], np.asarray(value[node], float)))
                continue
            for child, left in zip(children[node], (True, False)):
                tests, share = way.get(feature[node], ([], 1.0))
                step = {int(feature[node]): ([*tests, (test[node], left)], share * cover[child] / cover[node])}
                open_nodes.append((child, way | step))

    @property
    def base(self) -> np.ndarray:
        """Outputs when no feature is known."""
        return self.offset + sum((p.value * math.prod(p.shares) for p in self.paths), np.zeros(self.outputs))

    def output(self, x: np.ndarray) -> np.ndarray:
        return self.offset + sum((p.met(x).all(0)[:, None] * p.value for p in self.paths), np.zeros((len(x), self.outputs)))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Rows, features, outputs."""
        found = np.zeros((self.size, len(x), self.outputs))
        for path in self.paths:
            d = len(path.features)
            if not d:
                continue
            own, share = path.met(x).astype(float), np.array(path.shares)[:, None]
            points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
            total = np.zeros_like(own)
            for t, w in zip((points + 1) / 2, weights / 2):
                factors = t * own + (1 - t) * share
                total += w * factors.prod(0) / factors
            for feature, parts in zip(path.features, total * (own - share)):
                found[feature] += parts[:, None] * path.value
        return found.transpose(1, 0, 2)


def forest_of(model: Trained, folder: str) -> Forest:
    """The nodes of a model's trees; Spark's own models are written to ``folder`` and their nodes read as a table."""
    learner = model.model.stages[-1]
    spark = model.test.sparkSession
    size = sum(n for _, n in owners(model))
    if isinstance(learner, SoftmaxBoostingModel):
        prior, rounds = learner.forest()
        found = Forest(prior, size)
        for trees in rounds:
            for k, t in enumerate(trees):
                spread = np.zeros((len(t.value), len(prior)))
                spread[:, k] = t.value
                children = [(2 * i + 1, 2 * i + 2) for i in range(len(t.value))]
                found.add(t.feature, t.cut, children, t.cover, spread)
        return found
    if not hasattr(learner, "trees"):
        raise ValueError(f"'{model.name}' is no ensemble of trees")
    path = f"{folder.rstrip('/')}/model-{uuid.uuid4().hex}"
    learner.write().save(path)
    boosted = not type(learner).__name__.startswith("RandomForest")
    shared = model.task == "classification" and not boosted  # leaves hold shares of the classes
    weights = learner.treeWeights if boosted else [1 / len(learner.trees)] * len(learner.trees)
    trees: dict[int, dict] = {}
    for tree, node in spark.read.parquet(f"{path}/data").select("treeID", "nodeData").collect():  # as many rows as the model has nodes
        trees.setdefault(tree, {})[node.id] = node
    found = Forest(np.zeros(len(model.labels) if shared else 1), size)
    for tree, nodes in trees.items():
        feature, test, children, cover, value = {}, {}, {}, {}, {}
        for i, n in nodes.items():
            feature[i] = n.split.featureIndex if n.leftChild >= 0 else -1
            test[i] = frozenset(n.split.leftCategoriesOrThreshold) if n.split.numCategories >= 0 else next(iter(n.split.leftCategoriesOrThreshold), 0.0)
            children[i], cover[i] = (n.leftChild, n.rightChild), n.rawCount
            value[i] = weights[tree] * (np.array(n.impurityStats) / sum(n.impurityStats) if shared else np.array([n.prediction]))
        found.add(feature, test, children, cover, value)
    return found


def owners(model: Trained) -> list[tuple[str, int]]:
    """Columns in the order of the feature vector, each with the number of its places there."""
    held = [(c, 1) for c in model.numeric]
    encoder = next((s for s in model.model.stages if hasattr(s, "categorySizes")), None)
    if encoder is None:
        return held
    # An invalid value has a place of its own, and the last one is dropped or not as the encoder says.
    more = (encoder.getHandleInvalid() == "keep") - bool(encoder.getDropLast())
    return held + [(c, n + more) for c, n in zip(model.categorical, encoder.categorySizes)]


_ROWS = f"{ID} long, feature string, contribution double, output double, base double"


def tree_contributions(model: Trained, rows: DataFrame, folder: str) -> DataFrame:
    """_row, feature, contribution, output and base: contributions sum to output less base.

    The output is the predicted class's probability for random forests, its score
    for boosting (of two classes the score of the second one), else the prediction.
    Parts of a category are added up to their column.
    """
    forest, names = forest_of(model, folder), owners(model)
    starts = np.cumsum([0, *[n for _, n in names][:-1]])
    base = forest.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            said = batch.column("said").to_numpy(zero_copy_only=False).astype(np.int64)
            at = said if forest.outputs > 1 else np.zeros(n, np.int64)
            own = np.arange(n)
            parts = np.add.reduceat(forest.contributions(x)[own, :, at], starts, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(ID).to_numpy(zero_copy_only=False), len(names))), pa.array([c for c, _ in names] * n), pa.array(parts.ravel()), pa.array(np.repeat(forest.output(x)[own, at], len(names))), pa.array(np.repeat(base[at], len(names)))],
                names=[ID, "feature", "contribution", "output", "base"],
            )

    out = model.model.transform(rows)
    said = F.col("prediction") if model.task == "classification" else F.lit(0.0)
    return out.select(ID, vector_to_array("features").alias("x"), said.alias("said")).mapInArrow(run, _ROWS)


def coalitions_of(features: int, most: int = COALITIONS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Masks (rows of truth values, neither empty nor whole) and their weights: all of them, or as many as asked, drawn in pairs with their complements."""
    sizes = np.arange(1, features)
    if 2**features - 2 <= most:
        numbers = np.arange(1, 2**features - 1)
        masks = (numbers[:, None] >> np.arange(features)) & 1 == 1
        n = masks.sum(1)
        return masks, (features - 1) / (np.array([math.comb(features, k) for k in n]) * n * (features - n))
    draw = np.random.default_rng(seed)
    odds = 1 / (sizes * (features - sizes))
    seen: dict[bytes, int] = {}
    for n in draw.choice(sizes, most // 2, p=odds / odds.sum()):
        mask = np.zeros(features, bool)
        mask[draw.choice(features, n, replace=False)] = True
        for m in (mask, ~mask):
            seen[m.tobytes()] = seen.get(m.tobytes(), 0) + 1
    return np.array([np.frombuffer(m, bool) for m in seen]), np.array(list(seen.values()), float)


def kernel_contributions(model: Trained, rows: DataFrame, background: int = BACKGROUND, most: int = COALITIONS, seed: int = 42) -> DataFrame:
    """_row, feature, contribution, output and base of any model; contributions sum to output less base.

    The output is the predicted class's probability, or the prediction; the base
    its mean over ``background`` test rows, chosen by a hash.  Every coalition of
    every row is scored with all background rows as one table.
    """
    spark = rows.sparkSession
    features = model.numeric + model.categorical
    count = len(features)
    behind = model.test.orderBy(hashed_uniform(col(ID), F.lit(seed)), ID).limit(background).select(*[col(c).alias(f"_b_{c}") for c in features]).persist()
    masks, weights = coalitions_of(count, most, seed) if count > 1 else (np.zeros((0, 1), bool), np.zeros(0))
    ends = [(-1, [False] * count, 0.0), (-2, [True] * count, 0.0)]
    table = spark.createDataFrame([(i, m.tolist(), float(w)) for i, (m, w) in enumerate(zip(masks, weights))] + ends, "_set int, _in array<boolean>, _weight double")
    said = model.model.transform(rows)
    classes = model.task == "classification"
    said = said.select(ID, *[col(c) for c in features], (F.col("prediction").cast("int") if classes else F.lit(0)).alias("_class"))
    # A row for each row, coalition and background row; both tables beside the rows have a bounded number of rows.
    spread = said.crossJoin(F.broadcast(table)).crossJoin(F.broadcast(behind))
    mixed = spread.select(ID, "_class", "_set", "_in", "_weight", *[F.when(F.get("_in", F.lit(i)), col(c)).otherwise(col(f"_b_{c}")).alias(c) for i, c in enumerate(features)])
    scored = model.model.transform(mixed)
    value = F.get(class_scores(scored), F.col("_class")) if classes else F.col("prediction")
    means = scored.select(ID, "_set", "_in", "_weight", value.alias("v")).groupBy(ID, "_set").agg(F.first("_in").alias("_in"), F.first("_weight").alias("_weight"), F.avg("v").alias("v"))

    # The last feature's contribution is what the others leave, so it is taken out of the equations.
    base, output = (F.max(F.when(F.col("_set") == k, F.col("v"))) for k in (-1, -2))
    ends = means.groupBy(ID).agg(base.alias("base"), output.alias("output"))
    bit = lambda i: F.get("_in", F.lit(i)).cast("double")
    last = bit(count - 1)
    rest = [bit(i) - last for i in range(count - 1)]
    # Sums over coalitions: the left side is the same for all rows, the right side is a sum for each row and feature.
    gram = table.where("_set >= 0").agg(F.array(*[F.sum(F.col("_weight") * a * b) for a in rest for b in rest]).alias("g")).first().g if count > 1 else []
    left = np.array(gram or [], float).reshape(count - 1, count - 1)
    inverse = np.linalg.pinv(left) if count > 1 else left
    solved = means.join(ends, ID).where("_set >= 0").withColumn("y", F.col("v") - F.col("base") - last * (F.col("output") - F.col("base")))
    right = solved.groupBy(ID).agg(F.array(*[F.sum(F.col("_weight") * a * F.col("y")) for a in rest]).alias("r")) if count > 1 else ends.select(ID, F.array().cast("array<double>").alias("r"))
    parts = [sum((F.get("r", F.lit(j)) * float(inverse[i, j]) for j in range(count - 1)), F.lit(0.0)) for i in range(count - 1)]
    found = right.join(ends, ID).withColumn("c", F.array(*parts).cast("array<double>"))
    total = F.aggregate("c", F.lit(0.0), lambda a, b: a + b)
    found = found.withColumn("c", F.concat("c", F.array(F.col("output") - F.col("base") - total)))
    named = F.explode(F.arrays_zip(F.array(*map(F.lit, features)).alias("feature"), F.col("c").alias("contribution"))).alias("p")
    return found.select(ID, named, "output", "base").select(ID, F.col("p.feature").alias("feature"), F.col("p.contribution").alias("contribution"), "output", "base")


def contributions(model: Trained, rows: DataFrame, folder: str, **settings) -> DataFrame:
    """By the model's kind: exact for ensembles of trees, else by scored coalitions."""
    learner = model.model.stages[-1]
    if isinstance(learner, SoftmaxBoostingModel) or hasattr(learner, "trees"):
        return tree_contributions(model, rows, folder)
    return kernel_contributions(model, rows, **settings)


@dataclass
class Explanation:
    """What a model goes by on the whole, and why it says what it says of some rows."""

    method: str
    importance: DataFrame  # rank, feature, importance, std
    local: DataFrame  # _row, rank, feature, value, contribution, direction
    sentences: DataFrame  # _row, sentence


def explain(model: Trained, rows: DataFrame, folder: str, top: int = 10, named: int = 3, **settings) -> Explanation:
    """Permutation importance of all features, the largest contributions to each row's prediction, and a sentence for each row.

    Rows that are equal are explained once.  ``top`` bounds the contributions of a
    row, ``named`` those in its sentence; ``settings`` go to the importance.
    """
    rows = rows.dropDuplicates([ID])
    features = model.numeric + model.categorical
    importance = permutation_importance(model, **settings)
    importance = importance.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("importance")), "feature")))  # a row for each feature
    found = contributions(model, rows, folder)
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), col(c).cast("string").alias("value")) for c in features]))
    order = Window.partitionBy(ID).orderBy(F.desc(F.abs("contribution")), "feature")  # a row for each feature
    way = F.when(F.col("contribution") > 0, "raises").when(F.col("contribution") < 0, "lowers").otherwise("leaves")
    local = found.join(rows.select(ID, cells), [ID, "feature"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    local = local.select(ID, "rank", "feature", "value", "contribution", way.alias("direction"), "output", "base")
    short = F.when(F.col("value").isNull(), "missing").when(F.length("value") > 24, F.concat(F.substring("value", 1, 21), F.lit("..."))).otherwise(F.col("value"))
    part = F.concat(F.lit("'"), "feature", F.lit("' = "), short, F.lit(" "), "direction", F.format_string(" it by %.4f", F.abs("contribution")))
    parts = local.where((F.col("rank") <= named) & (F.col("direction") != "leaves")).groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("text")))).alias("parts"))
    said = model.model.transform(rows).select(ID, F.col("prediction"))
    told = F.get(F.array(*map(F.lit, model.labels)), F.col("prediction").cast("int")) if model.labels else F.format_string("%.4f", "prediction")
    scores = local.where("rank = 1").select(ID, "output", "base")
    sentence = F.concat(F.lit("Predicted "), told, F.format_string(" (%.4f where %.4f is usual)", "output", "base"), F.when(F.col("parts").isNotNull(), F.concat(F.lit(": "), F.array_join(F.col("parts.text"), "; "))).otherwise(F.lit("")), F.lit("."))
    sentences = said.join(scores, ID).join(parts, ID, "left").select(ID, sentence.alias("sentence"))
    exact = isinstance(model.model.stages[-1], SoftmaxBoostingModel) or hasattr(model.model.stages[-1], "trees")
    return Explanation(f"permutation importance + {'tree' if exact else 'kernel'} Shapley values", importance.select("rank", "feature", "importance", "std"), local.drop("output", "base"), sentences)
