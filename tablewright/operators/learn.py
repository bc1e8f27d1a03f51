"""Training, evaluation, robustness and explanations with Spark ML."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import NUMERIC, TEMPORAL, col, drawn, hashed_uniform
from ..functions.texts import number_of
from .boosting import SoftmaxBoosting
from .clean import PARSED_SHARE
from .mutate import Mutator, kth_draws, numbered, numbered_by_draw
from .repair import encode

LEAST_ROWS, TEST_SHARE, MOST_CLASSES, MOST_LEVELS = 20, 0.2, 10, 1000
#: Rows that one task of a training reads at most, on average.  A forest of 100 trees keeps about 500 bytes for each.
TASK_ROWS = 50_000
ID = "_row"


def with_row_id(df: DataFrame) -> DataFrame:
    """A stable number for each row: a hash of its values, so that splits do not depend on partitions; equal rows share it."""
    return df.withColumn(ID, F.xxhash64(*[col(c) for c in df.columns]))


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Rows dealt out evenly to tasks of ``TASK_ROWS``, however files hold them; as they are if there are no more than that.

    Small columns make small files, which a task or two read whole, and a training
    would go over all rows in these tasks, again and again.
    """
    return df.repartition(math.ceil(rows / TASK_ROWS)) if rows > TASK_ROWS else df


def task_of(df: DataFrame, target: str) -> str:
    kind = df.schema[target].dataType
    if isinstance(kind, (T.StringType, T.BooleanType)):
        return "classification"
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    few = df.where(col(target).isNotNull()).select(col(target)).distinct().limit(MOST_CLASSES + 1).count() <= MOST_CLASSES
    return "classification" if whole and few else "regression"


def feature_kinds(df: DataFrame, target: str) -> tuple[list[str], list[str]]:
    """Numeric features (also dates, and text that writes numbers) and categorical ones."""
    names = [c for c in df.columns if c not in (target, ID)]
    texts = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    shares = df.agg(*[F.struct(F.count(col(c)).alias("held"), F.count(number_of(col(c))).alias("parsed")).alias(f"t{i}") for i, c in enumerate(texts)]).first() if texts else []
    parsed = {c for i, c in enumerate(texts) if shares[i].held and shares[i].parsed >= PARSED_SHARE * shares[i].held}
    numeric = [c for c in names if isinstance(df.schema[c].dataType, (*NUMERIC, *TEMPORAL)) or c in parsed]
    return numeric, [c for c in names if c not in numeric]


def as_features(df: DataFrame, numeric: list[str], categorical: list[str], keep: list[str]) -> DataFrame:
    """Numbers as doubles, dates as days since 1970, categories as text."""
    def number(c: str):
        kind = df.schema[c].dataType
        if isinstance(kind, TEMPORAL):
            return F.unix_micros(col(c).cast("timestamp")) / 86_400e6
        return number_of(col(c)) if isinstance(kind, T.StringType) else col(c).cast("double")

    return df.select(*[number(c).alias(c) for c in numeric], *[col(c).cast("string").alias(c) for c in categorical], *[col(c) for c in keep])


def split(df: DataFrame, target: str, task: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test by a hash of the row; equal rows stay together.

    For classes of two rows at least, each gives its share to the test, to the
    nearest row: those with the smallest hashes, found for all classes at once.
    """
    draw = drawn(col(ID), F.lit(seed))
    if task == "classification":
        classes = numbered(df.groupBy(col(target).alias("_c")).agg(F.count("*").alias("_n")), "_c", "_key").withColumn("_key", F.col("_key").cast("int")).persist()
        counts = classes.limit(MOST_LEVELS + 1).collect()
        if len(counts) <= MOST_LEVELS and min((r._n for r in counts), default=0) >= 2:
            keyed = df.join(F.broadcast(classes), col(target).eqNullSafe(F.col("_c"))).select("_key", draw.alias("_draw"), col(ID).alias("_id"))
            last = kth_draws(keyed, {r._key: (k, r._n) for r in counts if (k := math.floor(r._n * TEST_SHARE + 0.5))})
            edges = df.sparkSession.createDataFrame([(k, *v) for k, v in last.items()] or [(-1, 0, 0)], "_key int, _d long, _i long")
            edges = classes.join(edges, "_key", "left").select("_c", F.coalesce("_d", F.lit(-1)).alias("_d"), F.coalesce("_i", F.lit(0)).alias("_i"))
            marked = df.join(F.broadcast(edges), col(target).eqNullSafe(F.col("_c"))).drop("_c")  # a row for each class
            held = (draw < F.col("_d")) | ((draw == F.col("_d")) & (col(ID) <= F.col("_i")))
            return marked.where(~held).drop("_d", "_i"), marked.where(held).drop("_d", "_i")
    share = hashed_uniform(col(ID), F.lit(seed))
    return df.where(share >= TEST_SHARE), df.where(share < TEST_SHARE)


def preparation(numeric: list[str], categorical: list[str]) -> list:
    """Means for gaps and standard scores; the commonest category for gaps and one-hot vectors, unknown ones as zeros."""
    stages = []
    parts = []
    if numeric:
        stages += [Imputer(inputCols=numeric, outputCols=[f"_i_{c}" for c in numeric], strategy="mean"), VectorAssembler(inputCols=[f"_i_{c}" for c in numeric], outputCol="_numbers", handleInvalid="keep"), StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True)]
        parts.append("_scaled")
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"_x_{c}" for c in categorical], handleInvalid="keep", stringOrderType="frequencyDesc"), OneHotEncoder(inputCols=[f"_x_{c}" for c in categorical], outputCols=[f"_o_{c}" for c in categorical], handleInvalid="keep")]
        parts += [f"_o_{c}" for c in categorical]
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")]


def candidates(task: str, classes: int, rows: int, seed: int, trees: int) -> dict:
    if task == "regression":
        return {"ridge": LinearRegression(regParam=1.0 / max(rows, 1), elasticNetParam=0.0), "random_forest": RandomForestRegressor(numTrees=trees, seed=seed), "gradient_boosting": GBTRegressor(maxIter=trees, maxDepth=3, seed=seed)}
    found = {"logistic_regression": LogisticRegression(maxIter=500), "random_forest": RandomForestClassifier(numTrees=trees, seed=seed)}
    boosting = GBTClassifier(maxIter=trees, maxDepth=3, seed=seed) if classes == 2 else SoftmaxBoosting(rounds=trees, maxDepth=3)
    return found | ({"gradient_boosting": boosting} if classes > 1 else {})


def class_metrics(predictions: DataFrame, classes: int) -> DataFrame:
    """accuracy, precision, recall and f1 from (label, prediction): of the second class if there are two, else weighted."""
    cells = predictions.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    actual = cells.groupBy(F.col("label").alias("k")).agg(F.sum("n").alias("a"))
    said = cells.groupBy(F.col("prediction").alias("k")).agg(F.sum("n").alias("s"))
    hit = cells.where("label = prediction").select(F.col("label").alias("k"), F.col("n").alias("h"))
    each = actual.join(said, "k", "left").join(hit, "k", "left").fillna(0)
    p, r = F.coalesce(F.try_divide("h", "s"), F.lit(0.0)), F.coalesce(F.try_divide("h", "a"), F.lit(0.0))
    each = each.select("k", "a", "h", p.alias("p"), r.alias("r")).withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    weight = F.when(F.col("k") == 1.0, F.col("a")).otherwise(F.lit(0)) if classes == 2 else F.col("a")
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * weight), F.sum(weight)), F.lit(0.0)).alias(c)
    return each.agg((F.sum("h") / F.sum("a")).alias("accuracy"), mean("p"), mean("r"), mean("f")).toDF("accuracy", "precision", "recall", "f1")


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """mae, rmse and r2 from (label, prediction)."""
    gap = F.col("label") - F.col("prediction")
    return predictions.agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), (1 - F.try_divide(F.sum(gap * gap), F.var_pop("label") * F.count("label"))).alias("r2"))


def scored(predictions: DataFrame, task: str, classes: int) -> dict[str, float]:
    """All metrics of a model; its predictions are made once."""
    binary = task == "classification" and classes == 2
    out = predictions.select("label", "prediction", *["rawPrediction"] * binary).persist()
    found = (class_metrics(out, classes) if task == "classification" else regression_metrics(out)).first().asDict()
    if task == "classification":
        # Without bins, whose edges would follow from the number that Spark gives the job's rows.
        found["roc_auc"] = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", numBins=0).evaluate(out) if binary else 0.5
    out.unpersist()
    return found


@dataclass
class Trained:
    task: str
    target: str
    name: str
    model: PipelineModel
    numeric: list[str]
    categorical: list[str]
    labels: list[str]
    metrics: dict[str, float]
    scores: dict[str, dict[str, float]]
    test: DataFrame = field(repr=False)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def score(self, df: DataFrame) -> float:
        """Accuracy, or r2."""
        out = self.model.transform(df)
        return class_metrics(out, len(self.labels)).first().accuracy if self.task == "classification" else regression_metrics(out).first().r2


def labelled(df: DataFrame, target: str, task: str) -> tuple[DataFrame, list[str]]:
    if task == "regression":
        return df.withColumn("label", col(target).cast("double")), []
    names = [r[0] for r in df.select(col(target).cast("string").alias("v")).distinct().orderBy("v").limit(MOST_LEVELS + 1).collect()]
    if len(names) > MOST_LEVELS:
        raise ValueError(f"'{target}' has more than {MOST_LEVELS} classes")
    codes = F.array_position(F.array(*map(F.lit, names)), col(target).cast("string")) - 1
    return df.withColumn("label", codes.cast("double")), names


def train(df: DataFrame, target: str, seed: int = 42, trees: int = 100, names: list[str] | None = None) -> Trained:
    """Fit the candidates (or those named) and keep the best by f1, or by rmse.  ``trees`` sizes the ensembles.

    Candidates are fitted at the same time, as the jobs of one leave cores idle
    between its rounds.
    """
    df = with_row_id(df.where(col(target).isNotNull()))
    rows = df.count()
    if rows < LEAST_ROWS:
        raise ValueError(f"at least {LEAST_ROWS} labelled rows are needed")
    df = spread(df, rows).persist()
    task = task_of(df, target)
    numeric, categorical = feature_kinds(df, target)
    ready, classes = labelled(as_features(df, numeric, categorical, [target, ID]), target, task)
    ready = ready.persist()
    fit, test = (part.persist() for part in split(ready, target, task, seed))
    # Features are prepared once; all candidates read the same vectors.
    prepared = Pipeline(stages=preparation(numeric, categorical)).fit(fit)
    vectors, held = (prepared.transform(part).select("features", "label").persist() for part in (fit, test))
    learners = candidates(task, len(classes), vectors.count(), seed, trees)
    learners = {name: learner for name, learner in learners.items() if not names or name in names}
    held.count()  # stored before candidates read it at once

    def fitted(learner):
        model = learner.fit(vectors)
        return model, scored(model.transform(held), task, len(classes))

    found, scores, best = {}, {}, None
    with ThreadPool(max(1, len(learners))) as pool:
        each = pool.map(inheritable_thread_target(df.sparkSession)(fitted), learners.values(), 1)
    for name, (model, m) in zip(learners, each):
        found[name], scores[name] = model, m
        better = best is None or (m["f1"] > scores[best]["f1"] if task == "classification" else m["rmse"] < scores[best]["rmse"])
        best = name if better else best
    for kept in (df, ready, fit, test, vectors, held):
        kept.unpersist()
    return Trained(task, target, best, PipelineModel([*prepared.stages, found[best]]), numeric, categorical, classes, scores[best], scores, test)


# --- Robustness -----------------------------------------------------------------------------------

MUTATIONS = {"missing": "inject_missing", "noise": "inject_noise", "outliers": "inject_outliers", "corruption": "corrupt"}


def filled(df: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    """Numbers as doubles with their means for gaps (0 without any), all else as codes of its sorted values, gaps being ``missing``; and the features' names."""
    names = [c for c in df.columns if c not in (target, ID)]
    numbers = [c for c in names if isinstance(df.schema[c].dataType, NUMERIC)]
    means = df.agg(*[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(numbers)]).first() if numbers else []
    mean = dict(zip(numbers, means))
    text = [c for c in names if c not in mean]
    df = df.select(*[F.coalesce(col(c).cast("double"), F.lit(float(mean[c] or 0.0))).alias(c) if c in mean else F.coalesce(col(c).cast("string"), F.lit("missing")).alias(c) if c in text else col(c) for c in df.columns])
    for c in text:
        df = encode(df, c)
    return df.select(*[col(c).cast("double").alias(c) if c in text else col(c) for c in df.columns]), names


def robustness(df: DataFrame, target: str, mutation: str = "noise", levels: tuple[float, ...] = (0.0, 0.05, 0.10, 0.25, 0.50), seed: int = 42, trees: int = 50) -> DataFrame:
    """level, performance and its share of the undamaged one: trained once on four fifths of all rows, scored on the damaged features of the others.

    Gaps are filled with the training rows' means.  All levels are scored as one table.
    """
    if mutation not in MUTATIONS:
        raise ValueError(f"'{mutation}' is none of {', '.join(MUTATIONS)}")
    levels = tuple(sorted({0.0, *levels}))
    df = with_row_id(df.where(col(target).isNotNull()))
    task = task_of(df, target)
    ready, features = filled(df, target)
    ready, names = labelled(ready, target, task)
    # Equal rows get numbers of their own, so that shares of the test rows are exact.
    ready = numbered_by_draw(ready, drawn(col(ID), F.lit(seed)), col(ID), "_place").withColumn(ID, F.col("_place")).drop("_place")
    ready = spread(ready, df.count()).persist()
    fit, test = split(ready, target, "regression", seed)
    usual = fit.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(features)]).first()
    learner = RandomForestClassifier(numTrees=trees, seed=seed) if task == "classification" else RandomForestRegressor(numTrees=trees, seed=seed)
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    vectors = assembler.transform(fit).select("features", "label").persist()
    model = learner.fit(vectors)
    damage = Mutator(ID, seed)
    every = None
    for level in levels:
        hurt = getattr(damage, MUTATIONS[mutation])(test, level, features) if level else test
        # Text that corruption leaves is no number and is filled like a gap.
        part = hurt.select(F.lit(float(level)).alias("level"), "label", *[F.coalesce(col(c).try_cast("double"), F.lit(float(usual[i] or 0.0))).alias(c) for i, c in enumerate(features)])
        every = part if every is None else every.unionByName(part)
    out = model.transform(assembler.transform(every)).groupBy("level")
    gap = F.col("label") - F.col("prediction")
    value = F.avg((gap == 0).cast("double")) if task == "classification" else F.sqrt(F.avg(gap * gap))
    found = {r.level: r.v for r in out.agg(value.alias("v")).collect()}  # a row for each level
    vectors.unpersist()
    ready.unpersist()
    base, rows = found.get(0.0), []
    for level in sorted(found):
        ratio = (found[level] / base if task == "classification" else base / found[level]) if base and found[level] else 0.0
        rows.append((level, float(found[level]), float(min(1.0, ratio))))
    return df.sparkSession.createDataFrame(rows, "level double, performance double, normalized double")


def elasticity(curve: DataFrame) -> float:
    """Area under the normalised curve over the range of its levels."""
    r = sorted((x.level, x.normalized) for x in curve.collect())
    if len(r) < 2 or r[-1][0] == r[0][0]:
        return 1.0
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(r, r[1:]))
    return area / (r[-1][0] - r[0][0])


# --- Explanations ---------------------------------------------------------------------------------


def permutation_importance(model: Trained, rows: int | None = None, repeats: int = 10, seed: int = 42) -> DataFrame:
    """feature, mean and std of the score lost when its values are dealt out anew.

    The score, accuracy or r2, is taken on all test rows, or on ``rows`` of them,
    chosen by a hash.  Rows are numbered in a drawn order; in each repeat the row
    at place p takes the value at place a p + b modulo the number of rows, with a
    and b drawn for the feature and repeat and a prime to that number, so every
    value is dealt once.  All features and repeats are one table and one call of
    the model.
    """
    features = model.numeric + model.categorical
    test = model.test.persist()  # all rows of the table are read and split to get them
    sample = numbered_by_draw(test, drawn(col(ID), F.lit(seed)), col(ID), "_place")
    sample = (sample if rows is None else sample.where(F.col("_place") < rows)).persist()
    count = sample.count()
    draw = random.Random(seed)
    moves = [(-1, 1, 0)]
    for f in range(len(features)):
        for _ in range(repeats if count > 1 else 0):
            times = draw.randrange(1, min(count, 1 << 20))
            while math.gcd(times, count) > 1:
                times = times % min(count - 1, 1 << 20) + 1
            moves.append((f, times, draw.randrange(count)))
    spark = sample.sparkSession
    table = spark.createDataFrame([(i, *m) for i, m in enumerate(moves)], "_move int, _feature int, _times long, _from long")
    spread = sample.crossJoin(F.broadcast(table)).withColumn("_giver", (F.col("_place") * F.col("_times") + F.col("_from")) % count)  # a row for each feature and repeat
    givers = sample.select(F.col("_place").alias("_giver"), *[col(c).alias(f"_g{i}") for i, c in enumerate(features)])
    moved = spread.join(givers, "_giver").select("_move", "_feature", "label", *[F.when(F.col("_feature") == i, F.col(f"_g{i}")).otherwise(col(c)).alias(c) for i, c in enumerate(features)])
    out = model.model.transform(moved).groupBy("_move", "_feature")
    gap = F.col("label") - F.col("prediction")
    value = F.avg((gap == 0).cast("double")) if model.task == "classification" else 1 - F.try_divide(F.sum(gap * gap), F.var_pop("label") * F.count("label"))
    scores = out.agg(value.alias("s")).collect()  # a row for each feature and repeat
    sample.unpersist()
    test.unpersist()
    base = next((r.s for r in scores if r._feature < 0), None) or 0.0
    found = []
    for f, name in enumerate(features):
        drops = [base - (r.s or 0.0) for r in scores if r._feature == f] or [0.0]
        mean = sum(drops) / len(drops)
        found.append((name, mean, math.sqrt(sum((d - mean) ** 2 for d in drops) / len(drops))))
    found.sort(key=lambda r: (-abs(r[1]), r[0]))
    return spark.createDataFrame(found, "feature string, importance double, std double")


def native_importance(model: Trained) -> DataFrame:
    """feature and the model's own weight, one-hot parts added up to their column."""
    learner = model.model.stages[-1]
    weights = learner.featureImportances.toArray() if hasattr(learner, "featureImportances") else None
    if weights is None:
        weights = abs(learner.coefficientMatrix.toArray()).mean(axis=0) if hasattr(learner, "coefficientMatrix") else abs(learner.coefficients.toArray())
    total = dict.fromkeys(model.numeric + model.categorical, 0.0)
    for name, weight in zip(model.numeric, weights):
        total[name] += float(weight)
    at = len(model.numeric)
    if model.categorical:
        encoder = next(s for s in model.model.stages if hasattr(s, "categorySizes"))
        for name, size in zip(model.categorical, encoder.categorySizes):
            total[name] += float(sum(weights[at : at + size]))
            at += size
    return model.test.sparkSession.createDataFrame(sorted(total.items(), key=lambda r: -r[1]), "feature string, weight double")


def class_scores(out: DataFrame):
    """Array of a score for each class: its probability, or the softmax of raw predictions where a model gives no more."""
    if "probability" in out.columns:
        return vector_to_array("probability")
    raw = F.transform(vector_to_array("rawPrediction"), F.exp)
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))


def explain_rows(model: Trained, rows: DataFrame) -> DataFrame:
    """_row, feature and contribution: what the prediction loses when a feature takes its usual value.

    All replaced rows are one table and one call of the model; usual values are
    the test rows' medians and commonest categories.
    """
    usual = model.test.agg(*[F.median(col(c)).alias(c) for c in model.numeric], *[F.mode(col(c), True).alias(c) for c in model.categorical]).first()
    features = model.numeric + model.categorical
    variants = F.explode(F.array(F.lit(None).cast("string"), *map(F.lit, features)))
    spread = rows.withColumn("_feature", variants)
    replaced = spread.select(*[F.when(F.col("_feature") == c, F.lit(usual[c])).otherwise(col(c)).cast(rows.schema[c].dataType).alias(c) for c in features], ID, "_feature")
    out = model.model.transform(replaced)
    if model.task == "classification":
        out = out.withColumn("_p", class_scores(out)).withColumn("_score", F.array_max("_p")).withColumn("_class", F.col("prediction").cast("int"))
        base = out.where("_feature IS NULL").select(ID, F.col("_class").alias("_base_class"), F.col("_score").alias("_base"))
        joined = out.where("_feature IS NOT NULL").join(base, ID)
        return joined.select(ID, F.col("_feature").alias("feature"), (F.col("_base") - F.get("_p", F.col("_base_class"))).alias("contribution"))
    base = out.where("_feature IS NULL").select(ID, F.col("prediction").alias("_base"))
    return out.where("_feature IS NOT NULL").join(base, ID).select(ID, F.col("_feature").alias("feature"), (F.col("_base") - F.col("prediction")).alias("contribution"))


def linear_contributions(model: Trained, rows: DataFrame) -> DataFrame:
    """_row, feature and weight times scaled value, for linear models: they sum to the score less the intercept."""
    learner = model.model.stages[-1]
    weights = learner.coefficients.toArray() if model.task == "regression" else learner.coefficientMatrix.toArray()[-1]
    owners = list(model.numeric)
    if model.categorical:
        encoder = next(s for s in model.model.stages if hasattr(s, "categorySizes"))
        for name, size in zip(model.categorical, encoder.categorySizes):
            owners += [name] * size
    owners += [owners[-1]] * (len(weights) - len(owners))
    parts = F.arrays_zip(vector_to_array("features").alias("x"), F.array(*[F.lit(float(w)) for w in weights]).alias("w"), F.array(*map(F.lit, owners)).alias("feature"))
    out = model.model.transform(rows).select(ID, F.explode(parts).alias("p"))
    return out.groupBy(ID, F.col("p.feature").alias("feature")).agg(F.sum(F.col("p.x") * F.col("p.w")).alias("contribution"))


def narrative(contributions: DataFrame, most: int = 3) -> list[str]:
    top = contributions.groupBy("feature").agg(F.avg("contribution").alias("mean")).orderBy(F.desc(F.abs("mean")), "feature").limit(most).collect()
    return [f"{r.feature} {'raises' if r['mean'] > 0 else 'lowers'} the prediction by {abs(r['mean']):.4f} on average." for r in top]
