"""Operators on small tables whose answers are known."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions.numbers import nan_as_null
from tablewright.operators import analyze, audit, clean, compare, drift, learn, mutate, profile, relations, repair, validate


def rows(df):
    return [tuple(r) for r in df.collect()]


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


# --- Cleaning


def texts(spark, values, name="v"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, `{name}` string")


@pytest.mark.parametrize("token", ["", "-", "?", "N/A", "nan", "#REF!", "<NULL>", " . "])
def test_unambiguous_tokens_are_gaps(spark, token):
    assert column(clean.null_sentinels(texts(spark, ["a", token, "b"])), "v") == ["a", None, "b"]


def test_capitals_among_title_case_are_gaps(spark):
    df = texts(spark, ["Coffee", "Tea", "UNKNOWN", "ERROR", "Unknown", "Cake"])
    assert column(clean.null_sentinels(df), "v") == ["Coffee", "Tea", None, None, "Unknown", "Cake"]


def test_none_of_many_is_an_answer(spark):
    assert column(clean.null_sentinels(texts(spark, ["None", "Nuts", "None", "Milk"])), "v") == ["None", "Nuts", "None", "Milk"]


def test_capitals_among_capitals_stay(spark):
    assert column(clean.null_sentinels(texts(spark, ["US", "NA", "DE"])), "v") == ["US", "NA", "DE"]


def test_force_and_preserve(spark):
    df = texts(spark, ["Unknown", "None", "Milk"])
    assert column(clean.null_sentinels(df, force=("unknown", "none"), preserve=("none",)), "v") == [None, "None", "Milk"]


@pytest.mark.parametrize(
    "values,expected",
    [
        (["$50,000", "60000", "₹70,500"], [50000, 60000, 70500]),
        (["(1,200)", "3,400", "-50"], [-1200, 3400, -50]),
        (["45%", "50%", "12.5%"], [0.45, 0.5, 0.125]),
        (["01234", "10001", "20002"], ["01234", "10001", "20002"]),
        (["1", "two", "three"], ["1", "two", "three"]),
        (["1.5", "2", None], [1.5, 2.0, None]),
    ],
)
def test_numbers_in_text(spark, values, expected):
    assert column(clean.parse_numbers(texts(spark, values)), "v") == expected


def test_dates_in_text(spark):
    out = clean.parse_timestamps(texts(spark, ["2021-01-05", "2022/03/14", None], "signup"))
    assert [str(v)[:10] for v in column(out, "signup")] == ["2021-01-05", "2022-03-14", "None"]
    assert dict(clean.parse_timestamps(texts(spark, ["20210105", "20210106"])).dtypes)["v"] == "string"


def test_names_and_empty_parts(spark):
    df = spark.createDataFrame([(1, None, None), (None, None, None), (2, "x", None)], " `a ` int, b string, c string")
    done = clean.clean(df)
    assert done.df.columns == ["a", "b"] and done.df.count() == 2
    twice = spark.createDataFrame([(1, 2, 3)], ["x", "x_1", "y"]).toDF("x", "x ", "x_1")
    assert len(set(clean.clean_names(twice).columns)) == 3


def test_index_column_goes(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "`Unnamed: 0` int, v string")
    assert clean.drop_index_columns(df).columns == ["v"]


def test_whole_floats_with_gaps_become_integers(spark):
    df = nan_as_null(spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double"))
    assert column(clean.narrow_whole_floats(df), "v") == [1, None, 3]


# --- Profiles


def test_moments_agree_with_pandas(spark):
    rng = np.random.default_rng(3)
    values = rng.gamma(2.0, 3.0, 500)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got, s = profile.numeric_moments(df).first(), pd.Series(values)
    assert math.isclose(got.skewness, s.skew(), rel_tol=1e-9) and math.isclose(got.kurtosis, s.kurt(), rel_tol=1e-9) and math.isclose(got.std, s.std(), rel_tol=1e-9)


def test_same_at_any_partitioning(spark):
    df = spark.range(500).select((F.col("id") % 17).alias("a"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("b"))
    found = [sorted(rows(profile.column_stats(df.repartition(n)).drop("position"))) for n in (1, 4, 16)]
    assert found[0] == found[1] == found[2]


def test_duplicate_columns_and_rows(spark):
    df = spark.createDataFrame([(1, 1, "x"), (2, 2, "x"), (None, None, "y"), (1, 1, "x")], "a int, b int, c string")
    assert rows(profile.duplicate_columns(df)) == [("a", "b")]
    assert profile.duplicate_count(df).first().duplicates == 1


def test_facts_count_values_by_the_place_of_their_column(spark):
    """The most frequent values of few columns are found without a sort; odd names, gaps and repeated rows do no harm."""
    df = spark.createDataFrame([(2, "b", 0.0, None), (10, "a", -0.0, None), (2, "b", 0.0, None), (None, None, float("nan"), None), (10, "a", None, None)], "`a.b` int, `c``d` string, x double, none string").withColumn("list", F.array(F.lit(1)))
    counts = profile.value_counts(df, ["x", "a.b"], places=True)
    assert dict(counts.dtypes)["place"] == "int"
    assert sorted((["x", "a.b"][r.place], r.value, r.n) for r in counts.collect()) == sorted(map(tuple, profile.value_counts(df, ["x", "a.b"]).collect())) == [("a.b", "10", 2), ("a.b", "2", 2), ("x", "-0.0", 1), ("x", "0.0", 2), ("x", "NaN", 1)]
    plans = []
    with pytest.MonkeyPatch.context() as patch:
        for name in ("first", "collect"):
            patch.setattr(type(df), name, lambda self, f=getattr(type(df), name): plans.append(self._jdf.queryExecution().executedPlan().toString()) or f(self))
        facts = profile.gather_facts(df)
    top = [p for p in plans if "struct(m" in p]
    assert top and not any("Sort [" in p for p in top)
    empty = profile.gather_facts(df.where("false"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(profile, "WIDE", 3)  # more columns are grouped
        assert str(profile.gather_facts(df)) == str(facts) and str(profile.gather_facts(df.where("false"))) == str(empty)
    # Of equal counts the smaller text stays.
    assert {c.name: (c.distinct, c.top, c.top_n) for c in facts.columns.values()} == {"a.b": (2, "10", 2), "c`d": (2, "a", 2), "x": (3, "0.0", 2), "none": (0, None, 0), "list": (0, None, 0)}
    assert {(c.distinct, c.top) for c in empty.columns.values()} == {(0, None)} and (facts.rows, facts.duplicates, empty.rows) == (5, 1, 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert profile.duplicate_count(df).first().duplicates == 0
    assert {r["column"]: r.nulls for r in profile.null_counts(df).collect()} == {"a": 0, "b": 0}
    assert analyze.analyze(df)["rows"] == 0
    with pytest.raises(ValueError):
        validate.validate(df)


def test_text_roles(spark):
    df = spark.createDataFrame([(f"user{i}@example.com", "red" if i % 2 else "blue", "a longer line of prose here") for i in range(30)], "mail string, colour string, note string")
    assert {r["column"]: r["role"] for r in profile.text_roles(df).collect()} == {"mail": "identifier", "colour": "categorical", "note": "free_text"}


def test_correlation_of_constants_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0)], "a double, b double, c double")
    got = {(r.left_column, r.right_column): r.r for r in profile.correlation_matrix(df).collect()}
    assert math.isclose(got["a", "b"], 1.0) and got["a", "c"] is None


# --- Audit and health


def damaged(spark):
    data = [(i, 42, float(v), t) for i, (v, t) in enumerate([(1, 1.0), (2, 2.0), (3, 3.0), (2, 2.0), (3, 3.1), (100, 100.0)])]
    return spark.createDataFrame(data + data[:1], "id int, fixed int, spread double, target double")


def test_findings_of_a_damaged_table(spark):
    found = audit.find_problems(damaged(spark), "target")
    kinds = {(f.dimension, f.severity, f.column) for f in found}
    assert ("Uniqueness", "WARNING", None) in kinds and ("Reliability", "WARNING", "fixed") in kinds and ("Reliability", "ERROR", "spread") in kinds
    assert any(f.dimension == "Accuracy" for f in found)


def test_health_of_clean_and_damaged(spark):
    good = audit.health(spark.createDataFrame([(1, "a", 10.5), (2, "b", 20.0), (3, "c", 30.0)], "id int, name string, value double"))
    assert good.overall >= 80 and good.grade in "AB"
    assert audit.health(damaged(spark), "target").overall < good.overall


# --- Repair


def test_impute_and_revert(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, None), (None, "y"), (4.0, "x")], "a double, b string")
    r = repair.Repairer(df).impute_missing("a", "mean").impute_missing("b", "mode")
    assert sorted(column(r.df, "a")) == [1.0, 2.0, 7 / 3, 4.0] and sorted(column(r.df, "b")) == ["x", "x", "x", "y"]
    assert r.revert().revert().df is df


def test_dates_stay_dates(spark):
    df = spark.sql("SELECT timestamp '2024-01-01' AS t UNION ALL SELECT timestamp '2024-01-03' UNION ALL SELECT NULL")
    assert "2024-01-02 00:00:00" in {str(v) for v in column(repair.impute(df, "t", "mean"), "t")}


def test_integer_fill_is_rounded_to_even(spark):
    df = spark.createDataFrame([(2,), (3,), (None,)], "a int")
    assert sorted(column(repair.impute(df, "a", "mean"), "a")) == [2, 2, 3]


def test_scaling_keeps_gaps(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (None,)], "a double")
    assert column(repair.scale(df, "a", "minmax"), "a") == [0.0, 1.0, None]
    got = column(repair.scale(df, "a", "standard"), "a")
    assert got[2] is None and math.isclose(got[1], 5 / math.sqrt(50 / 3))


def test_auto_repair_leaves_nothing(spark):
    data = [(i, f"u{i}@mail.org" if i % 9 else None, float(i % 7), float(i % 5) if i % 4 else None, "y" if i % 11 else None) for i in range(60)]
    df = spark.createDataFrame(data + data[:1], "id int, mail string, a double, b double, label string")
    r = repair.Repairer(df)
    done = r.auto_repair("label")
    assert done.duplicates_removed == 1 and done.marked == {"mail": "identifier"} and done.target_rows_dropped > 0
    assert repair.verify(r.df, "label")["clean"]


# --- Identities


def invoices(spark, n=200):
    rng = random.Random(5)
    return spark.createDataFrame([(f"i{k}", rng.randint(1, 20), round(rng.uniform(1, 90), 2)) for k in range(n)], "invoice string, units int, price double").withColumn("amount", F.col("units") * F.col("price"))


def test_identity_is_found_and_fills(spark):
    df = invoices(spark)
    holed = df.withColumn("amount", F.when(F.substring("invoice", -1, 1) != "3", F.col("amount")))
    rules = relations.discover(holed)
    assert any(r.target == "amount" and r.operator == "*" for r in rules)
    filled, records = relations.fill(holed, rules)
    assert sum(r["cells_filled"] for r in records) == 20
    assert filled.join(df.select("invoice", F.col("amount").alias("whole")), "invoice").where("abs(amount - whole) > 1e-6").count() == 0


def test_nothing_to_discover(spark):
    df = spark.createDataFrame([(random.random(), random.random(), random.random()) for _ in range(300)], "a double, b double, c double")
    assert relations.discover(df) == []
    one = spark.range(100).select(F.col("id").alias("a"), F.lit(1).alias("one"), F.col("id").alias("b"))
    assert not any("one" in (r.left, r.right, r.target) for r in relations.discover(one))


def test_integer_operands_take_whole_answers_only(spark):
    df = spark.createDataFrame([(2, 4.0, 8.0), (None, 3.0, 8.0), (None, 4.0, 12.0)], "units int, price double, total double")
    rule = relations.Identity("total", "units", "price", "*", 30, 1.0)
    assert sorted(column(relations.fill(df, [rule])[0], "units"), key=str) == [2, 3, None]


# --- Drift


def people(spark, mean=45.0, seed=1, n=1500, goa=0.0):
    rng = np.random.default_rng(seed)
    city = rng.choice(["Delhi", "Mumbai", "Pune"], n, p=[0.5, 0.3, 0.2])
    city = np.where(rng.random(n) < goa, "Goa", city)
    return spark.createDataFrame(pd.DataFrame({"age": rng.normal(mean, 12, n), "city": city}))


def test_same_generator_is_stable(spark):
    assert drift.detect(people(spark), people(spark, seed=2)).status == drift.STABLE


def test_shifted_mean_and_new_city_are_critical(spark):
    found = {c.column: c for c in drift.detect(people(spark), people(spark, 60, 3, goa=0.3)).columns}
    assert found["age"].status == drift.CRITICAL and found["city"].status == drift.CRITICAL and found["city"].new_values == ["Goa"]


def test_types_and_few_rows(spark):
    a, b = people(spark), people(spark).withColumn("age", F.col("age").cast("string"))
    assert {c.column: c.status for c in drift.detect(a, b).columns}["age"] == drift.TYPE_CHANGED
    assert {c.status for c in drift.detect(a, people(spark, n=5)).columns} == {drift.NOT_COMPARABLE}


def test_tails_of_known_distributions():
    assert math.isclose(drift.chi_square_p(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(drift.chi_square_p(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(drift.ks_p(1.3580986 / math.sqrt(500), 1000, 1000), 0.05, rel_tol=1e-3)


def test_ks_statistic_against_numpy(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(0, 1, 400), rng.normal(0.3, 1.2, 300)
    every = np.sort(np.concatenate([a, b]))
    gap = np.abs(np.searchsorted(np.sort(a), every, "right") / 400 - np.searchsorted(np.sort(b), every, "right") / 300).max()
    frames = [spark.createDataFrame(pd.DataFrame({"v": x})) for x in (a, b)]
    assert math.isclose(drift.ks_statistic(*frames, "v").first().statistic, gap, rel_tol=1e-12)


def test_constants_and_binary_columns(spark):
    a = spark.range(100).select(F.lit(5.0).alias("c"), (F.col("id") % 2).alias("flag"))
    b = spark.range(100).select(F.lit(9.0).alias("c"), (F.col("id") % 2).alias("flag"))
    found = {c.column: c for c in drift.detect(a, b).columns}
    assert found["c"].status == drift.CRITICAL and found["flag"].kind == "categorical" and math.isfinite(found["c"].psi)


# --- Versions


def test_versions(spark):
    left = spark.range(300).select("id", (F.col("id") * 2).alias("old_name"), F.when(F.col("id") % 2 == 0, "yes").otherwise("no").alias("churn"))
    right = left.withColumnRenamed("old_name", "new_name").withColumn("churn", F.when(F.col("id") % 5 == 0, "maybe").otherwise(F.col("churn")))
    found = compare.compare(left, right, "churn", "id", drift=False)
    kinds = {(c.kind, c.severity) for c in found.changes}
    assert ("renamed", "WARNING") in kinds and ("new class", "CRITICAL") in kinds and not any(k == "removed" for k, _ in kinds)


# --- Mutations


def test_seeds_and_counts(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).cast("double").alias("v"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"))
    for n in (1, 7):
        m = mutate.Mutator("id", 42).inject_missing(df.repartition(n), 0.101, ["v"])
        assert m.where("v IS NULL").count() == 101
    same = [sorted(column(mutate.Mutator("id", 42).inject_missing(df.repartition(n), 0.1, ["v"]).where("v IS NULL"), "id")) for n in (1, 5)]
    assert same[0] == same[1] != sorted(column(mutate.Mutator("id", 43).inject_missing(df, 0.1, ["v"]).where("v IS NULL"), "id"))
    assert mutate.Mutator("id").inject_duplicates(df, 0.25).count() == 1250
    assert mutate.Mutator("id").corrupt(df, 0.1, ["c"]).where("length(c) = 5").count() == 100


def test_numbering_is_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = mutate.numbered(df, "k", "n").orderBy("k").collect()
    assert [r.n for r in got] == list(range(1000))


# --- Models


def credit(spark, n=400):
    rng = np.random.default_rng(4)
    score, age = rng.normal(650, 60, n), rng.integers(20, 70, n)
    return spark.createDataFrame(pd.DataFrame({"score": score, "age": age, "city": rng.choice(["a", "b"], n), "risk": np.where(score + rng.normal(0, 5, n) > 650, "low", "high")}))


def test_training_and_explanations(spark):
    model = learn.train(credit(spark), "risk", trees=5)
    assert model.task == "classification" and model.metrics["accuracy"] > 0.9
    ranked = [r.feature for r in learn.permutation_importance(model, repeats=2).collect()]
    assert ranked[0] == "score"
    assert learn.native_importance(model).first().feature == "score"
    told = learn.explain_rows(model, model.test.limit(20))
    assert {r.feature for r in told.collect()} == {"score", "age", "city"}


def test_boosting_of_three_classes(spark, monkeypatch):
    df = credit(spark, 300).withColumn("risk", F.when(F.col("score") > 700, "none").otherwise(F.col("risk")))
    every = learn.candidates
    monkeypatch.setattr(learn, "candidates", lambda *a: {"gradient_boosting": every(*a)["gradient_boosting"]})
    model = learn.train(df, "risk", trees=3)
    assert len(model.labels) == 3 and model.metrics["accuracy"] > 0.8
    assert learn.native_importance(model).first().feature == "score"
    assert learn.explain_rows(model, model.test.limit(5)).count() == 15
    assert {r.feature for r in learn.permutation_importance(model, rows=40, repeats=1).collect()} == {"score", "age", "city"}


def test_value_bytes(spark):
    df = spark.createDataFrame([(1, "é", [1, 2], True), (2, None, None, None), (None, "abc", [], False)], "n int, t string, a array<int>, b boolean")
    assert {r.column: r.bytes for r in profile.value_bytes(df).collect()} == {"n": 8, "t": 5, "a": 7, "b": 2}
    assert {r.bytes for r in profile.value_bytes(df.limit(0)).collect()} == {0}


def test_robustness_curve(spark):
    curve = learn.robustness(credit(spark, 200), "risk", "noise", (0.0, 0.3), trees=5)
    assert 0 <= learn.elasticity(curve) <= 1
    with pytest.raises(ValueError):
        learn.robustness(credit(spark, 60), "risk", "duplicates")


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)], "label double, prediction double")
    got = learn.regression_metrics(df).first()
    assert math.isclose(got.mae, 2 / 3) and math.isclose(got.r2, 1 - 2 / (14 / 3))


def test_exact_tail_counts_orders():
    from itertools import combinations

    n, m = 4, 5
    gaps = []
    for own in combinations(range(n + m), n):
        a = b = 0
        gap = 0
        for k in range(n + m):
            a, b = a + (k in own), b + (k not in own)
            gap = max(gap, abs(a * m - b * n))
        gaps.append(gap)
    for far in sorted(set(gaps)):
        assert math.isclose(drift.ks_p_exact(far / (n * m), n, m), sum(g >= far for g in gaps) / len(gaps), rel_tol=1e-9)
    assert drift.ks_p_exact(0.0, 50, 60) == 1.0 and drift.ks_tail(0.1, 10_000, 10_000) < 1e-10


def test_quantiles_are_exact(spark, monkeypatch):
    import numpy as np
    from tablewright.operators import quantiles

    monkeypatch.setattr(quantiles, "ACCURACY", 40)
    monkeypatch.setattr(quantiles, "MOST_VALUES", 30)
    draw = np.random.default_rng(4)
    held = {"wide": draw.normal(size=5000), "ties": draw.integers(0, 4, 5000).astype(float), "far": np.exp(draw.normal(0, 9, 5000)), "one": np.full(5000, 2.5)}
    df = spark.createDataFrame(list(zip(*[map(float, v) for v in held.values()])), ", ".join(f"{k} double" for k in held)).withColumn("none", F.lit(None).cast("double"))
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles.exact_quantiles(df, {c: F.col(c) for c in df.columns}, shares)
    assert got["none"] == [] and all(np.allclose(got[c], np.quantile(v, shares), rtol=1e-12) for c, v in held.items())


def test_an_unreadable_date_is_refused(spark):
    df = spark.sql("SELECT CAST(NULL AS TIMESTAMP) AS at")
    with pytest.raises(ValueError):
        repair.impute(df, "at", "constant", "abc")
    assert str(repair.impute(df, "at", "constant", "2024-03-05").first()["at"]) == "2024-03-05 00:00:00"


def test_labels_flip_over_any_number_of_classes(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("c"), F.pmod("id", F.lit(1200)).cast("string")).alias("label"))
    new = mutate.Mutator("id").flip_labels(df, "label", 0.2)
    both = df.join(new.withColumnRenamed("label", "after"), "id")
    assert both.where("label <> after").count() == 600 and both.where("after IS NULL").count() == 0


def test_choice_is_exact_where_it_is_narrowed(spark, monkeypatch):
    monkeypatch.setattr(mutate, "RANKED", 5)
    df = spark.range(2000).withColumn("v", F.lit(1))
    from tablewright.functions.numbers import drawn

    draw = drawn(F.col("id"), F.lit("x"))
    for k in (0, 1, 777, 1999, 2000):
        hit = mutate.among_smallest(df, "id", draw, k, 2000)
        assert column(df.where(hit).orderBy("id"), "id") == sorted(r.id for r in df.orderBy(draw, "id").limit(k).collect())
