"""Boosting, Shapley values, draws and quantiles against plain computations."""

import dataclasses
import itertools
import math
import threading

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from tablewright.operators import boosting, compare, learn, mutate, quantiles, shapley


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(600):
        x = draw.normal(size=3).round(2)
        kind = "uvw"[int(draw.integers(0, 3))]
        score = x[0] + 0.5 * x[1] * (kind == "u") - 0.7 * (kind == "w")
        rows.append((i, *map(float, x), kind, "abc"[int(np.digitize(score, [-0.5, 0.6]))], float(score)))
    return spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, kind string, label_name string, score double").persist()


@pytest.fixture(scope="module")
def vectors(table):
    numbers = table.withColumn("label", F.ascii("label_name") - 97.0)
    return VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="features").transform(numbers).select("features", "label").persist()


def loss(out):
    rows = out.select("label", vector_to_array("probability").alias("p")).collect()
    return -sum(math.log(max(r.p[int(r.label)], 1e-12)) for r in rows) / len(rows)


# --- boosting


def plain_rounds(x, labels, rounds, depth, rate):
    """Scores after boosting with every value as a cut."""
    classes = labels.max() + 1
    scores = np.tile(np.log([(labels == k).mean() for k in range(classes)]), (len(x), 1))

    def fitted(g, h, rows, depth):
        leaf = np.full(len(rows), rate * (classes - 1) / classes * g[rows].sum() / h[rows].sum())
        best = (1e-12, None)
        if depth and len(rows) > 1:
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    left = x[rows, f] <= cut
                    gain = g[rows][left].sum() ** 2 / left.sum() + g[rows][~left].sum() ** 2 / (~left).sum() - g[rows].sum() ** 2 / len(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, left)
        if best[1] is not None:
            for side in (best[1], ~best[1]):
                leaf[side] = fitted(g, h, rows[side], depth - 1)
        return leaf

    for _ in range(rounds):
        p = boosting.softmax(scores)
        scores = scores + np.stack([fitted((labels == k) - p[:, k], p[:, k] * (1 - p[:, k]), np.arange(len(x)), depth) for k in range(classes)], 1)
    return scores


def test_boosting_is_that_of_all_cuts_where_bins_are_fine(spark):
    draw = np.random.default_rng(8)
    x = draw.integers(0, 12, (150, 2)).astype(float)
    labels = ((x[:, 0] > 3).astype(int) + (x[:, 0] + x[:, 1] + draw.normal(0, 2, 150) > 14)).astype(int)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame([(*map(float, r), float(y)) for r, y in zip(x, labels)], "a double, b double, label double").repartition(5))
    model = boosting.SoftmaxBoosting(rounds=13, maxDepth=2, maxBins=200).fit(df)  # more rounds than are kept at a time
    rows = {(*r.features,): np.array(r.raw) for r in model.transform(df).select("features", vector_to_array("rawPrediction").alias("raw")).collect()}
    plain = plain_rounds(x, labels, 13, 2, 0.1)
    assert all(np.allclose(rows[tuple(r)], s, atol=1e-6) for r, s in zip(x, plain))


def test_loss_falls_each_round_and_is_below_one_against_the_rest(vectors):
    fit, test = vectors.randomSplit([0.7, 0.3], seed=4)
    model = boosting.SoftmaxBoosting(rounds=30).fit(fit)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:])) and model.numClasses == 3
    rest = OneVsRest(classifier=GBTClassifier(maxIter=30, maxDepth=3, seed=1)).fit(fit).transform(test)
    shares = F.transform(vector_to_array("rawPrediction"), lambda s: 1 / (1 + F.exp(-2 * s)))
    total = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
    rest = rest.select("label", F.transform(shares, lambda s: s / total).alias("p")).collect()
    assert loss(model.transform(test)) < -sum(math.log(max(r.p[int(r.label)], 1e-12)) for r in rest) / len(rest)


def test_boosting_is_kept_and_read_back(vectors, tmp_path):
    model = Pipeline(stages=[boosting.SoftmaxBoosting(rounds=3)]).fit(vectors)
    model.write().save(f"file://{tmp_path}/model")
    again = PipelineModel.load(f"file://{tmp_path}/model")
    one, other = (m.transform(vectors).select(vector_to_array("probability")).collect() for m in (model, again))
    assert one == other and again.stages[0].featureImportances.toArray().sum() == pytest.approx(1)


@pytest.mark.parametrize("rows", [[], [(-1.0,)]])
def test_labels_that_boosting_refuses(spark, rows):
    df = VectorAssembler(inputCols=["label"], outputCol="features").transform(spark.createDataFrame(rows, "label double"))
    with pytest.raises(ValueError):
        boosting.SoftmaxBoosting(rounds=2).fit(df)


def test_training_takes_the_model_of_many_classes(table):
    model = learn.train(table.drop("score", "id"), "label_name", trees=4, names=["gradient_boosting"])
    assert isinstance(model.model.stages[-1], boosting.SoftmaxBoostingModel) and model.metrics["accuracy"] > 0.6


# --- Shapley values


@pytest.fixture(scope="module")
def trained(table):
    return learn.train(table.drop("score", "id"), "label_name", trees=3, names=["random_forest"])


@pytest.fixture(scope="module")
def regression(table):
    return learn.train(table.drop("label_name", "id"), "score", trees=3, names=["random_forest"])


def with_learner(trained, learner):
    ready = PipelineModel(trained.model.stages[:-1])
    return dataclasses.replace(trained, model=PipelineModel([*ready.stages, learner.fit(ready.transform(trained.test))]))


def two_classes(trained):
    return dataclasses.replace(trained, test=trained.test.withColumn("label", (F.col("label") > 0).cast("double")), labels=["a", "b"])


LEARNERS = {
    "forest": lambda t, r: with_learner(t, RandomForestClassifier(numTrees=5, maxDepth=4, seed=1)),
    "boosting": lambda t, r: with_learner(t, boosting.SoftmaxBoosting(rounds=4)),
    "two classes": lambda t, r: with_learner(two_classes(t), GBTClassifier(maxIter=4, maxDepth=3, seed=1)),
    "regression forest": lambda t, r: with_learner(r, RandomForestRegressor(numTrees=5, maxDepth=4, seed=1)),
    "regression boosting": lambda t, r: with_learner(r, GBTRegressor(maxIter=4, maxDepth=3, seed=1)),
}


@pytest.mark.parametrize("name", LEARNERS)
def test_shapley_values_of_trees(trained, regression, tmp_path, name):
    model = LEARNERS[name](trained, regression)
    forest = shapley.forest_of(model, f"file://{tmp_path}")
    rows = model.test.limit(25)
    out = model.model.transform(rows).select(learn.ID, vector_to_array("features").alias("x"), "prediction", *(["rawPrediction", "probability"] if name in ("forest", "boosting") else [])).collect()
    said = {}
    for r in out:  # what the model says by itself
        scores = r.probability if name == "forest" else r.rawPrediction if name == "boosting" else None
        said[r[learn.ID]] = scores[int(r.prediction)] if scores is not None else None if name == "two classes" else r.prediction
    found = shapley.tree_contributions(model, rows, f"file://{tmp_path}").collect()
    assert len(found) == 4 * len(out)
    for row, parts in itertools.groupby(sorted(found, key=lambda r: r[learn.ID]), key=lambda r: r[learn.ID]):
        parts = list(parts)
        assert sum(p.contribution for p in parts) == pytest.approx(parts[0].output - parts[0].base, abs=1e-9)
        assert said[row] is None or parts[0].output == pytest.approx(said[row], abs=1e-9)
    # Enumeration of all coalitions of the encoded features.
    x, used = np.array(out[0].x), sorted({f for p in forest.paths for f in p.features})

    def worth(known):
        total = forest.offset.astype(float)
        for p in forest.paths:
            total = total + p.value * math.prod(m if f in known else s for f, m, s in zip(p.features, p.met(x[None])[:, 0], p.shares))
        return total

    got = forest.contributions(x[None])[0]
    for f in used:
        rest, total = [u for u in used if u != f], 0
        for k in range(len(rest) + 1):
            for known in itertools.combinations(rest, k):
                total = total + math.factorial(k) * math.factorial(len(rest) - k) / math.factorial(len(used)) * (worth({*known, f}) - worth({*known}))
        assert np.allclose(total, got[f], atol=1e-9)


def test_no_trees_no_tree_values(trained, tmp_path):
    from pyspark.ml.classification import LogisticRegression

    with pytest.raises(ValueError):
        shapley.forest_of(with_learner(trained, LogisticRegression(maxIter=5)), f"file://{tmp_path}")


def test_shapley_values_by_kernel(trained, regression):
    model = with_learner(regression, LinearRegression())
    rows = model.test.limit(4).persist()
    found = {(r[learn.ID], r.feature): r for r in shapley.kernel_contributions(model, rows, background=30).collect()}
    # A linear model gives weight times distance from the background's mean.
    behind = model.test.orderBy(learn.hashed_uniform(F.col(learn.ID), F.lit(42)), learn.ID).limit(30)
    from tablewright.operators.learn import linear_contributions

    linear = lambda df: [(r[learn.ID], r.feature, r.contribution) for r in linear_contributions(model, df).collect()]
    usual = {}
    for _, f, c in linear(behind):
        usual[f] = usual.get(f, 0) + c / 30
    assert len(found) == 16
    for i, f, c in linear(rows):
        assert found[i, f].contribution == pytest.approx(c - usual[f], abs=1e-6)


def test_kernel_is_enumeration_of_few_features(trained):
    rows = trained.test.limit(1).persist()
    behind = trained.test.orderBy(learn.hashed_uniform(F.col(learn.ID), F.lit(42)), learn.ID).limit(10).collect()
    row, features = rows.first(), trained.numeric + trained.categorical
    said = int(trained.model.transform(rows).first().prediction)
    sets = [s for k in range(5) for s in itertools.combinations(features, k)]
    mixed = [(n, *[row[c] if c in s else b[c] for c in features]) for n, s in enumerate(sets) for b in behind]
    df = trained.test.sparkSession.createDataFrame(mixed, "n long, " + ", ".join(f"{c} {trained.test.schema[c].dataType.simpleString()}" for c in features))
    worth = {sets[r.n]: r.v for r in trained.model.transform(df).groupBy("n").agg(F.avg(F.get(vector_to_array("probability"), F.lit(said))).alias("v")).collect()}
    found = {r.feature: r for r in shapley.kernel_contributions(trained, rows, background=10).collect()}
    for f in features:
        rest = [c for c in features if c != f]
        exact = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (worth[tuple(c for c in features if c in s or c == f)] - worth[s]) for k in range(4) for s in itertools.combinations(rest, k))
        assert found[f].contribution == pytest.approx(exact, abs=1e-6)


def test_explanations_name_the_largest_parts(trained, tmp_path):
    rows = trained.test.limit(6).persist()
    found = shapley.explain(trained, rows, f"file://{tmp_path}", top=2, named=1, repeats=2)
    parts = {}
    for r in shapley.tree_contributions(trained, rows.dropDuplicates([learn.ID]), f"file://{tmp_path}").collect():
        parts.setdefault(r[learn.ID], []).append((-abs(r.contribution), r.feature, r.contribution))
    local, held = found.local.collect(), {r[learn.ID]: r for r in rows.collect()}
    assert len(local) == 2 * len(parts) and [r.rank for r in found.importance.orderBy("rank").collect()] == [1, 2, 3, 4]
    for r in local:
        _, feature, contribution = sorted(parts[r[learn.ID]])[r.rank - 1]
        assert (r.feature, r.direction) == (feature, "raises" if contribution > 0 else "lowers") and r.contribution == pytest.approx(contribution)
        assert r.value == str(held[r[learn.ID]][feature])
    for r in found.sentences.collect():
        _, feature, contribution = sorted(parts[r[learn.ID]])[0]
        assert r.sentence.startswith("Predicted ") and f"'{feature}' = " in r.sentence and f"by {abs(contribution):.4f}." in r.sentence
    assert "tree" in found.method


def test_drawn_coalitions_are_pairs():
    masks, weights = shapley.coalitions_of(20, most=200)
    held = {m.tobytes(): w for m, w in zip(masks, weights)}
    assert all(held[(~m).tobytes()] == w for m, w in zip(masks, weights)) and weights.sum() == 200 and masks.any(1).all() and not masks.all(1).any()


# --- importance, robustness


def test_importance_deals_every_value_once(spark, trained):
    base = trained.score(trained.test)
    found = {r.feature: r for r in learn.permutation_importance(trained, repeats=4).collect()}
    assert set(found) == {"x0", "x1", "x2", "kind"} and found["x0"].importance > 0.1 > abs(found["x2"].importance)
    assert base > 0.6 and all(r.std >= 0 for r in found.values())
    one = learn.permutation_importance(trained, rows=1, repeats=2).collect()
    assert all(r.importance == 0 for r in one)


def test_robustness_takes_all_rows_and_levels(table):
    df = table.drop("id", "score").unionByName(table.drop("id", "score").limit(50)).withColumn("x1", F.when(F.col("x2") > -1.5, F.col("x1")))
    for kind in ("missing", "noise", "outliers", "corruption"):
        rows = learn.robustness(df, "label_name", kind, (0.5,), trees=8).orderBy("level").collect()
        assert [r.level for r in rows] == [0.0, 0.5] and rows[0].normalized == 1.0 and rows[1].performance < rows[0].performance
    ready, names = learn.filled(learn.with_row_id(df), "label_name")
    first = ready.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names], F.countDistinct("kind").alias("k"), F.max("kind").alias("m")).first()
    assert names == ["x0", "x1", "x2", "kind"] and not any(first[c] for c in names) and (first.k, first.m) == (3, 2.0)


# --- draws and splits


@pytest.mark.parametrize("rows,ranked", [(1000, 20_000), (5000, 40)])
def test_kth_draws_of_many_keys(spark, monkeypatch, rows, ranked):
    monkeypatch.setattr(mutate, "RANKED", ranked)
    keyed = spark.range(rows).select((F.col("id") % 7).cast("int").alias("_key"), F.when(F.col("id") % 11 == 0, F.lit(5)).otherwise(mutate.drawn(F.col("id"))).alias("_draw"), F.col("id").alias("_id")).persist()
    held = {}
    for r in keyed.collect():
        held.setdefault(r._key, []).append((r._draw, r._id))
    wanted = {k: (1 + 13 * k, len(v)) for k, v in held.items()}
    assert mutate.kth_draws(keyed, wanted) == {k: sorted(held[k])[n - 1] for k, (n, _) in wanted.items()}


def test_jobs_do_not_grow_with_the_columns(spark):
    def jobs(columns):
        df = spark.range(500).select("id", *[(F.col("id") * 3 + i).alias(f"c{i}") for i in range(columns)])
        spark.sparkContext.setJobGroup(f"missing {columns}", "")
        assert mutate.Mutator("id").inject_missing(df, 0.1).agg(*[F.count_if(F.col(f"c{i}").isNull()) for i in range(columns)]).first() == (50,) * columns
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"missing {columns}"))

    assert jobs(2) == jobs(20)


def test_null_ids_are_refused(spark):
    df = spark.createDataFrame([(None, 1.0), (2, 2.0)], "id long, x double")
    with pytest.raises(ValueError):
        mutate.Mutator("id").inject_missing(df, 0.5)


def test_each_class_gives_its_share(spark):
    df = learn.with_row_id(spark.range(1003).select("id", F.when(F.col("id") < 3, "few").when(F.col("id") < 300, "some").otherwise("many").alias("c")))
    train, test = learn.split(df, "c", "classification")
    n = {r.c: r["count"] for r in test.groupBy("c").count().collect()}
    assert n == {"few": 1, "some": 59, "many": 141} and train.count() + test.count() == 1003 and train.join(test, "id").isEmpty()
    assert learn.split(df.withColumn("c", F.when(F.col("id") == 5, "alone").otherwise("rest")), "c", "classification")[1].count() > 100


# --- quantiles, renames


@pytest.mark.parametrize("held", [[float("nan"), *range(101)], [float("nan"), float("inf"), float("-inf"), *range(11)], [float("nan")], [float("inf"), float("inf"), 1.0]])
def test_nan_is_a_gap_and_infinity_a_value(spark, held):
    df = spark.createDataFrame([(float(x),) for x in held] + [(None,)], "x double")
    rows = sorted(float(x) for x in held if not math.isnan(x))
    got = quantiles.exact_quantiles(df, {"x": F.col("x")}, [0.0, 0.25, 0.5, 0.75, 1.0])["x"]
    assert got == [quantiles.between(rows[math.floor(s * (len(rows) - 1))], rows[math.ceil(s * (len(rows) - 1))], s * (len(rows) - 1) % 1) for s in (0.0, 0.25, 0.5, 0.75, 1.0) if rows]
    assert len(rows) < 100 or got == [0.0, 25.0, 50.0, 75.0, 100.0]


def test_brackets_shrink_without_a_sketch(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST_VALUES", 5)
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda x, at, _: F.array(F.min(x), F.max(x)))  # a sketch that tells nothing
    draw = np.random.default_rng(1)
    for held in (draw.normal(size=800), np.exp(draw.normal(0, 60, 800)), np.append(draw.integers(0, 3, 400), [-np.inf, np.inf, 1e308, -1e308]).astype(float)):
        df = spark.createDataFrame([(float(v),) for v in held], "x double")
        assert quantiles.exact_quantiles(df, {"x": F.col("x")}, [0.1, 0.5, 0.9])["x"] == pytest.approx(list(np.quantile(held, [0.1, 0.5, 0.9])))


def test_renames_of_wide_tables(spark):
    left = spark.range(400).select("id", *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10_000)).alias(f"a{i}") for i in range(30)], F.lit(None).cast("long").alias("none"))
    spark.sparkContext.setJobGroup("renames", "")
    right = left.select("id", *[F.col(f"a{i}").alias(f"b{i}") for i in range(25)], *[(F.col(f"a{i}") + 20_000).alias(f"b{i}") for i in range(25, 30)], F.col("none").alias("void"))
    found = compare.renamed_columns(left, right)
    assert sorted(found) == sorted((f"a{i}", f"b{i}", 1.0) for i in range(25))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("renames")) <= 8
    assert ("none", "void", 1.0) in compare.renamed_columns(left, right, "id") and ("none", "void", 1.0) not in compare.renamed_columns(left, right.where("id > 0"), "id")
    partly = left.select("id", F.when(F.col("id") % 20 > 0, F.col("a0")).otherwise(F.col("a0") + 50_000).alias("z"))
    assert [(a, b, round(s, 2)) for a, b, s in compare.renamed_columns(left.select("id", "a0"), partly)] == [("a0", "z", 0.91)] or compare.renamed_columns(left.select("id", "a0"), partly, least=0.8)


@pytest.mark.parametrize("rows", [400, 100])
def test_training_deals_rows_of_one_file_to_tasks(spark, monkeypatch, rows):
    """A table that one task reads is trained by tasks of bounded size; the rows and their split stay the same."""
    monkeypatch.setattr(learn, "TASK_ROWS", 100, raising=False)
    df = spark.range(rows).selectExpr("id % 97 AS a", "id AS b", "CASE WHEN id % 97 > 40 THEN 'high' ELSE 'low' END AS y").coalesce(1)
    model = learn.train(df, "y", trees=3, names=["random_forest"])
    assert model.test.rdd.getNumPartitions() == math.ceil(rows / 100)
    most = max(model.test.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect())
    assert most < 0.2 * 100 + 25
    keyed = learn.with_row_id(df)
    held = {r.b for r in learn.split(keyed, "y", "classification")[1].collect()}
    assert {int(r.b) for r in model.test.collect()} == held and len(held) == round(0.2 * rows)


def test_importance_is_the_same_of_dealt_rows(spark, monkeypatch):
    df = spark.range(400).selectExpr("id % 97 AS a", "id % 7 AS b", "CASE WHEN id % 97 > 40 THEN 'high' ELSE 'low' END AS y").coalesce(1)
    found = []
    for most in (50_000, 100):
        monkeypatch.setattr(learn, "TASK_ROWS", most, raising=False)
        model = learn.train(df, "y", names=["logistic_regression"])
        found.append((model.test.rdd.getNumPartitions(), {r.feature: r.importance for r in learn.permutation_importance(model, repeats=3).collect()}))
    assert [parts for parts, _ in found] == [1, 4]
    assert found[0][1] == pytest.approx(found[1][1], abs=0.03)


def test_candidates_are_fitted_at_the_same_time(spark, monkeypatch):
    """Each waits for the other before it starts; the scores are those of fits one by one."""
    df = spark.range(200).selectExpr("id % 97 AS a", "CASE WHEN id % 97 > 40 THEN 'high' ELSE 'low' END AS y")
    alone = {name: learn.train(df, "y", trees=3, names=[name]).scores[name] for name in ("logistic_regression", "random_forest")}
    every, start = learn.candidates, threading.Barrier(2)

    class Waiting:
        def __init__(self, learner):
            self.learner = learner

        def fit(self, rows):
            start.wait(60)
            return self.learner.fit(rows)

    monkeypatch.setattr(learn, "candidates", lambda *a: {name: Waiting(each) for name, each in every(*a).items() if name in alone})
    model = learn.train(df, "y", trees=3)
    assert model.scores == {name: pytest.approx(found) for name, found in alone.items()}


def test_importance_makes_its_test_rows_once(spark):
    df = spark.range(300).selectExpr("id % 97 AS a", "id % 7 AS b", "CASE WHEN id % 97 > 40 THEN 'high' ELSE 'low' END AS y")
    model = learn.train(df, "y", names=["logistic_regression"])
    rows, seen = model.test.count(), spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def passes(_):
        seen.add(1)
        return True

    model.test = model.test.where(passes.asNondeterministic()(learn.ID))
    assert learn.permutation_importance(model, repeats=2).first().feature == "a"
    assert seen.value == rows and not model.test.storageLevel.useMemory


def test_area_under_the_curve_is_exact(spark):
    """Of more different scores than Spark's evaluator has bins."""
    draw = np.random.default_rng(5)
    label = draw.integers(0, 2, 3000)
    score = np.round(label + draw.normal(size=3000), 3)
    rows = spark.createDataFrame([(float(y), float(s > 0.5), float(s)) for y, s in zip(label, score)], "label double, prediction double, s double").repartition(5)
    found = learn.scored(VectorAssembler(inputCols=["s", "s"], outputCol="rawPrediction").transform(rows), "classification", 2)
    gaps = score[label == 1][:, None] - score[label == 0][None]
    assert found["roc_auc"] == pytest.approx(((gaps > 0) + (gaps == 0) / 2).mean(), abs=1e-12)
    assert found["accuracy"] == pytest.approx(((score > 0.5) == label).mean())
