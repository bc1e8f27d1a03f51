"""Queries over the standard tables, each with SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import texts as X
from .functions.numbers import col
from .operators import analyze, audit, boosting, clean, compare, drift, learn, mutate, profile, quantiles, relations, repair, shapley, validate
from .sources import fingerprint as fingerprints
from .sources import objects, stores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def each(columns: list[str], sql: str) -> str:
    """One SELECT for each column, {c} standing for its name."""
    return " UNION ALL ".join(sql.replace("{c}", c) for c in columns)


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_OTHERS = ["l_returnflag", "l_linestatus", "l_shipdate"]
#: Events with gaps: small values and one type of event are hidden.
GAPPY = "(SELECT event_id, ts, user_id, CASE WHEN event_type <> 'error' THEN event_type END AS event_type, CASE WHEN value >= 10 THEN value END AS value FROM events)"


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"), F.when(F.col("value") >= 10, F.col("value")).alias("value"))


def facts_sql(source: str, numbers: list[str], texts: list[str] = [], times: list[str] = []) -> str:  # noqa: B006
    """CTEs facts (a row for each column) and shape (one row) of a relation named or written in brackets."""
    one = "SELECT '{c}' AS name, '%s' AS kind, count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS d, %s FROM " + source + " s"
    number = one % ("numeric", "avg({c}) AS mean, stddev_samp({c}) AS sd, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, skewness({c}) AS skew, kurtosis({c}) AS kurt, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers, 0 AS classes, 0.0 AS least") + ", (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM " + source + " r) q"
    word = "count(DISTINCT CASE WHEN regexp_full_match({c}, '\\s*[+-]?\\d+\\s*') THEN 1 WHEN regexp_full_match({c}, '\\s*[+-]?(\\d+\\.\\d*|\\.\\d+)\\s*') THEN 2 WHEN lower(trim({c})) IN ('true', 'false') THEN 3 WHEN {c} IS NOT NULL THEN 4 END)"
    least = "(SELECT min(k) * 1.0 / sum(k) FROM (SELECT count(*) AS k FROM " + source + " u WHERE {c} IS NOT NULL GROUP BY {c}) v)"
    other = "NULL AS mean, NULL AS sd, NULL AS low, NULL AS high, NULL AS skew, NULL AS kurt, 0 AS outliers, %s AS classes, %s AS least"
    parts = [each(numbers, number)] if numbers else []
    parts += [each(texts, one % ("text", other % (word, least)))] if texts else []
    parts += [each(times, one % ("time", other % ("0", "0.0")))] if times else []
    columns = ", ".join([*numbers, *texts, *times])
    category = "CASE WHEN d <= 1 AND nulls < n THEN 'constant' WHEN kind = 'numeric' THEN CASE WHEN d = 2 THEN 'binary' ELSE 'numeric' END WHEN kind = 'time' THEN 'datetime' WHEN nulls = n THEN 'unknown' WHEN classes > 2 THEN 'mixed' WHEN d > 100 THEN 'high_cardinality' ELSE 'text' END AS category"
    return f"facts AS (SELECT *, round_even(nulls * 100.0 / n, 2) AS null_pct, {category} FROM ({' UNION ALL '.join(parts)}) f), shape AS (SELECT (SELECT count(*) FROM {source} a) AS n, (SELECT count(*) FROM {source} a) - (SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {source} b) c) AS repeated)"


def findings_sql(source: str, numbers: list[str], texts: list[str], times: list[str], target: str) -> str:
    """CTE findings: dimension, severity, column and value; the target is a text column."""
    pairs = [(a, b) for i, a in enumerate(numbers) for b in numbers[i + 1 :]]
    strong = " UNION ALL ".join(f"SELECT '{a}' AS a, corr({a}, {b}) AS r, count(DISTINCT {a}) > 1 AND count(DISTINCT {b}) > 1 AS varied FROM {source} s" for a, b in pairs)
    parts = [
        "SELECT 'Completeness' AS dimension, CASE WHEN nulls = n THEN 'ERROR' WHEN nulls > 0.5 * n THEN 'WARNING' ELSE 'INFO' END AS severity, name AS \"column\", null_pct AS value FROM facts WHERE nulls > 0",
        "SELECT 'Uniqueness', CASE WHEN repeated * 100.0 / n > 5 THEN 'WARNING' ELSE 'INFO' END, NULL, repeated * 100.0 / n FROM shape WHERE repeated > 0",
        "SELECT 'Accuracy', CASE WHEN outliers * 100.0 / n > 5 THEN 'WARNING' ELSE 'INFO' END, name, outliers * 100.0 / n FROM facts WHERE kind = 'numeric' AND d > 1 AND outliers > 0",
        "SELECT 'Consistency', CASE WHEN abs(skew) > 3 THEN 'WARNING' ELSE 'INFO' END, name, skew FROM facts WHERE kind = 'numeric' AND d > 1 AND abs(skew) > 1.5",
        "SELECT 'Consistency', 'INFO', name, kurt FROM facts WHERE kind = 'numeric' AND d > 1 AND abs(kurt) > 3",
        f"SELECT 'Consistency', CASE WHEN least < 0.05 THEN 'WARNING' ELSE 'INFO' END, name, least FROM facts WHERE name = '{target}' AND d > 1 AND least < 0.1",
        f"SELECT 'Reliability', CASE WHEN abs(r) > 0.95 THEN 'WARNING' ELSE 'INFO' END, a, r FROM ({strong}) p WHERE varied AND abs(r) > 0.8",
        "SELECT 'Reliability', 'WARNING', name, NULL FROM facts WHERE d <= 1",
    ]
    return f"{facts_sql(source, numbers, texts, times)}, findings AS ({' UNION ALL '.join(parts)})"


def draw_sql(*parts: str) -> str:
    """The 60-bit draw that a mutation takes from these SQL expressions."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 15) AS BIGINT)"


def picked_sql(salt: str, share: float, source: str = "events") -> str:
    """Rows of a relation with ``hit``: whether a mutation of seed 42 takes them."""
    draw = draw_sql("event_id", "42", f"'{salt}'")
    return f"(SELECT *, row_number() OVER (ORDER BY {draw}, event_id) <= ceil(count(*) OVER () * {share}) AS hit FROM {source} s)"


TARGET_SQL = "'target', 'label', 'class', 'score', 'outcome', 'y', 'result', 'prediction', 'category', 'type'"
CUSTOMER = ("customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"])
EVENTS = (["event_id", "user_id", "value"], ["event_type"], ["ts"])
CANDIDATES_SQL = f"candidates AS (SELECT name, round(least(1.0, 0.5 + CASE category WHEN 'binary' THEN 0.3 WHEN 'numeric' THEN 0.1 ELSE 0 END + CASE WHEN d <= 2 THEN 0.1 ELSE 0 END + CASE WHEN null_pct < 10 THEN 0.1 ELSE 0 END), 4) AS confidence, CASE WHEN d <= 10 THEN 'classification' ELSE 'regression' END AS task FROM facts WHERE d > 1 AND NOT regexp_matches(name, '^(id|uuid|key|hash|identifier|index)') AND (d = 2 OR (d BETWEEN 3 AND 10 AND kind <> 'numeric') OR name IN ({TARGET_SQL}) OR regexp_matches(name, '^(target|label)')))"


# --- Profiles -------------------------------------------------------------------------------------


@query(each(LINE_NUMBERS, "SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", round_even(avg({c}), 4) AS mean, round_even(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem") + " UNION ALL " + each(LINE_OTHERS, "SELECT '{c}', count(*), count(*) - count({c}), count(DISTINCT {c}), NULL, NULL, NULL, NULL FROM lineitem"))
def column_profile(spark, sf_dir):
    return profile.column_stats(read(spark, sf_dir, "lineitem")).select("column", "rows", "nulls", "distinct", "mean", "std", "min", "max")


@query(each(["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(DISTINCT {c}) AS n_distinct, round(count(DISTINCT {c}) / count(*), 6) AS p_distinct, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) = count({c}) AS is_unique FROM customer"))
def column_overview(spark, sf_dir):
    return profile.overview(read(spark, sf_dir, "customer")).select("column", "rows", "n_distinct", F.round("p_distinct", 6).alias("p_distinct"), "n_missing", "is_unique")


@query(each(["event_id", "ts", "user_id", "event_type", "value"], f"SELECT '{{c}}' AS \"column\", count(*) AS \"rows\", count(*) - count({{c}}) AS nulls, round((count(*) - count({{c}})) * 100.0 / count(*), 1) AS null_pct FROM {GAPPY} g"))
def null_summary(spark, sf_dir):
    return profile.null_counts(gappy_events(spark, sf_dir)).withColumn("null_pct", F.round((F.col("nulls") * 100.0 / F.col("rows")), 1))


@query(f"SELECT sum(nulls) AS missing, sum(n) AS cells, round(sum(nulls) * 100.0 / sum(n), 4) AS pct FROM ({each(['event_id', 'ts', 'user_id', 'event_type', 'value'], f'SELECT count(*) - count({{c}}) AS nulls, count(*) AS n FROM {GAPPY} g')}) x")
def missing_overall(spark, sf_dir):
    return profile.null_counts(gappy_events(spark, sf_dir)).agg(F.sum("nulls").alias("missing"), F.sum("rows").alias("cells"), F.round(F.sum("nulls") * 100.0 / F.sum("rows"), 4).alias("pct"))


TOP = ["o_orderstatus", "o_orderpriority", "o_custkey"]


@query("SELECT \"column\", CAST(rank AS INTEGER) AS rank, value, n FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS rank FROM (" + each(TOP, "SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY ALL") + ") c) r WHERE rank <= 3")
def top_values(spark, sf_dir):
    return profile.top_values(read(spark, sf_dir, "orders"), TOP, 3)


@query("SELECT count(*) AS \"rows\", (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem) d) AS distinct_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem) d) AS duplicates FROM lineitem")
def duplicate_rows(spark, sf_dir):
    return profile.duplicate_count(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_discount"))


@query(each(["event_id", "user_id", "ts", "value"], "SELECT '{c}' AS \"column\", CAST(count({c}) * CASE any_value(typeof({c})) WHEN 'INTEGER' THEN 4 ELSE 8 END AS BIGINT) AS bytes FROM events") + " UNION ALL SELECT 'event_type', CAST(sum(strlen(event_type)) AS BIGINT) FROM events")
def memory_usage(spark, sf_dir):
    return profile.value_bytes(read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def dedupe(spark, sf_dir):
    return repair.drop_duplicates(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_discount"))


TWINS = "(SELECT p_partkey, p_name, p_brand, p_brand AS copy, CASE WHEN p_partkey = 1 THEN 'x' ELSE p_brand END AS near FROM part)"


@query(" UNION ALL ".join(f"SELECT '{a}' AS left_column, '{b}' AS right_column FROM {TWINS} t HAVING bool_and({a} IS NOT DISTINCT FROM {b})" for a, b in [("p_name", "p_brand"), ("p_name", "copy"), ("p_name", "near"), ("p_brand", "copy"), ("p_brand", "near"), ("copy", "near")]))
def duplicate_columns(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return profile.duplicate_columns(p.select("p_partkey", "p_name", "p_brand", F.col("p_brand").alias("copy"), F.when(F.col("p_partkey") == 1, "x").otherwise(F.col("p_brand")).alias("near")))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(each(NUMBERS, "SELECT '{c}' AS \"column\", count({c}) AS n, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis FROM lineitem"))
def moments(spark, sf_dir):
    return profile.numeric_moments(read(spark, sf_dir, "lineitem"), NUMBERS).select("column", "n", F.round("skewness", 4).alias("skewness"), F.round("kurtosis", 4).alias("kurtosis"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr({a}, {b}), 5) AS r FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def correlation_matrix(spark, sf_dir):
    return profile.correlation_matrix(read(spark, sf_dir, "lineitem"), NUMBERS).withColumn("r", F.round("r", 5))


@query(each(["l_quantity", "l_extendedprice", "l_tax"], "SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers, round(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*), 3) AS outlier_pct FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem) q"))
def iqr_outliers(spark, sf_dir):
    return profile.iqr_outliers(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).withColumn("outlier_pct", F.round("outlier_pct", 3))


@query("SELECT 'value' AS name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS most FROM events WHERE value >= 10")
def quantiles_beside_nan(spark, sf_dir):
    """NaN, here in place of small values, counts as a gap."""
    e = read(spark, sf_dir, "events").select(F.when(F.col("value") >= 10, F.col("value")).otherwise(F.lit(float("nan"))).alias("value"))
    found = quantiles.exact_quantiles(e, {"value": F.col("value")}, [0.25, 0.5, 0.75, 1.0])
    return spark.createDataFrame([(name, *x) for name, x in found.items()], "name string, q1 double, median double, q3 double, most double")


@query("SELECT 'text' AS \"column\", round(avg(len(regexp_extract_all(text, '\\S+'))), 3) AS mean_words, round(avg(length(text)), 3) AS mean_chars, 'free_text' AS role FROM documents UNION ALL SELECT 'lang', round(avg(1), 3), round(avg(length(lang)), 3), 'categorical' FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'source', round(avg(1), 3), round(avg(length(source)), 3), 'categorical' FROM documents WHERE source IS NOT NULL")
def text_roles(spark, sf_dir):
    return profile.text_roles(read(spark, sf_dir, "documents")).select("column", F.round("mean_words", 3).alias("mean_words"), F.round("mean_chars", 3).alias("mean_chars"), "role")


@query("SELECT CASE WHEN regexp_matches(p_name, '[A-Z]') THEN 'other' ELSE 'lower' END AS casing, count(*) AS n FROM part GROUP BY 1")
def casing_classes(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.groupBy(F.when(X.casing(F.col("p_name")) == "lower", "lower").otherwise("other").alias("casing")).agg(F.count("*").alias("n"))


@query(f"WITH {facts_sql('events', *EVENTS)}, {CANDIDATES_SQL} SELECT name, CAST(confidence AS DOUBLE) AS confidence, task FROM candidates")
def target_candidates(spark, sf_dir):
    found = analyze.rank_targets(profile.gather_facts(read(spark, sf_dir, "events").drop("props")))
    return spark.createDataFrame([(t["name"], t["confidence"], t["task"]) for t in found], "name string, confidence double, task string")


@query(f"WITH {facts_sql(*CUSTOMER)} SELECT name, CAST(0.5 + CASE WHEN d > 0 THEN 0.3 ELSE 0 END + CASE WHEN nulls = 0 THEN 0.1 ELSE 0 END AS DOUBLE) AS confidence FROM facts WHERE name IN ('id', 'uuid', 'key', 'hash', 'identifier', 'index', 'row_id', 'record_id', 'dataset_id', 'sample_id', 'user_id', 'item_id', 'product_id', 'transaction_id') OR (d > 1 AND d >= 0.95 * n)")
def id_candidates(spark, sf_dir):
    found = analyze.rank_ids(profile.gather_facts(read(spark, sf_dir, "customer")))
    return spark.createDataFrame([(t["name"], t["confidence"]) for t in found], "name string, confidence double")


@query(f"WITH {facts_sql('events', *EVENTS)}, {CANDIDATES_SQL} SELECT CASE WHEN EXISTS (SELECT 1 FROM candidates WHERE task = 'classification') THEN 'classification' WHEN EXISTS (SELECT 1 FROM candidates) THEN 'regression' WHEN (SELECT n FROM shape) > 10 AND EXISTS (SELECT 1 FROM facts WHERE category = 'datetime') THEN 'time_series' ELSE 'unsupervised' END AS kind, (SELECT n FROM shape) AS \"rows\", (SELECT count(*) FROM facts) AS columns")
def table_kind(spark, sf_dir):
    found = analyze.analyze(read(spark, sf_dir, "events").drop("props"))
    return spark.createDataFrame([(found["kind"], found["rows"], len(found["columns"]))], "kind string, rows long, columns long")


@query(f"WITH {facts_sql(*CUSTOMER)} SELECT category, count(*) AS n FROM facts GROUP BY category")
def semantic_types(spark, sf_dir):
    facts = profile.gather_facts(read(spark, sf_dir, "customer"))
    rows = spark.createDataFrame([(c.category,) for c in facts.columns.values()], "category string")
    return rows.groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH {facts_sql(*CUSTOMER)} SELECT name FROM facts WHERE category <> 'constant' AND nulls < n AND NOT (d > 1 AND d >= 0.95 * n)")
def feature_columns(spark, sf_dir):
    facts = profile.gather_facts(read(spark, sf_dir, "customer"))
    return spark.createDataFrame([(c,) for c in analyze.features_of(facts)], "name string")


# --- Audit and health -----------------------------------------------------------------------------


@query("SELECT event_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def class_imbalance(spark, sf_dir):
    return audit.class_shares(read(spark, sf_dir, "events"), "event_type").withColumn("share", F.round("share", 6))


@query("SELECT value, n FROM (SELECT p_brand AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM part GROUP BY p_brand) s WHERE share < 0.04")
def rare_categories(spark, sf_dir):
    return audit.class_shares(read(spark, sf_dir, "part"), "p_brand").where("share < 0.04").select("value", "n")


TWICE = "(SELECT l_quantity AS twice, l_quantity, l_discount, l_tax, l_quantity + 20 * l_linenumber AS loose FROM lineitem)"


@query("SELECT left_column, right_column, CASE WHEN abs(r) > 0.95 THEN 'WARNING' ELSE 'INFO' END AS severity FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS left_column, '{b}' AS right_column, corr({a}, {b}) AS r FROM {TWICE} t" for i, a in enumerate(["twice", "l_quantity", "l_discount", "l_tax", "loose"]) for b in ["twice", "l_quantity", "l_discount", "l_tax", "loose"][i + 1 :]) + ") c WHERE abs(r) > 0.4")
def multicollinearity(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("twice"), "l_quantity", "l_discount", "l_tax", (F.col("l_quantity") + 20 * F.col("l_linenumber")).alias("loose"))
    found = audit.find_problems(df, correlated=0.4)
    rows = [(f.column, f.message.split("'")[3], f.severity) for f in found if f.dimension == "Reliability"]
    return spark.createDataFrame(rows, "left_column string, right_column string, severity string")


@query("SELECT \"column\", 'ERROR' AS severity FROM (" + each(["l_discount", "leak"], "SELECT '{c}' AS \"column\", corr(l_tax, {c}) AS r FROM (SELECT l_tax, l_discount, l_tax * 3 AS leak FROM lineitem) t") + ") c WHERE abs(r) > 0.95")
def target_leakage(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_tax", "l_discount", (F.col("l_tax") * 3).alias("leak"))
    return audit.audit(df, "l_tax").where((F.col("dimension") == "Reliability") & (F.col("severity") == "ERROR")).select("column", "severity")


@query("SELECT \"column\", 'WARNING' AS severity FROM (" + each(["c_acctbal", "same", "none"], "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS d FROM (SELECT c_acctbal, 'x' AS same, NULL AS none FROM customer) t") + ") c WHERE d <= 1")
def constant_columns(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_acctbal", F.lit("x").alias("same"), F.lit(None).cast("string").alias("none"))
    return audit.audit(df).where((F.col("dimension") == "Reliability")).select("column", "severity")


@query(f"SELECT 'event_type' AS \"column\", CASE WHEN avg(CASE WHEN event_type IS NULL THEN 1.0 ELSE 0 END) > 0.5 THEN 'WARNING' ELSE 'INFO' END AS severity FROM {GAPPY} g UNION ALL SELECT 'value', CASE WHEN avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END) > 0.5 THEN 'WARNING' ELSE 'INFO' END FROM {GAPPY} g")
def completeness_findings(spark, sf_dir):
    return audit.audit(gappy_events(spark, sf_dir)).where("dimension = 'Completeness'").select("column", "severity")


@query("SELECT round(greatest(0, 100 - sum(p) * 0.5), 1) AS completeness FROM (" + each(["event_type", "value"], f"SELECT (count(*) - count({{c}})) * 100.0 / count(*) AS p FROM {GAPPY} g") + ") x")
def health_completeness(spark, sf_dir):
    return audit.health_frame(gappy_events(spark, sf_dir)).select(F.round("completeness", 1).alias("completeness"))


HEALTH = f"{findings_sql(*CUSTOMER, [], 'c_mktsegment')}, cost AS (SELECT dimension, CASE dimension WHEN 'Consistency' THEN CASE severity WHEN 'WARNING' THEN 15 ELSE 5 END WHEN 'Accuracy' THEN CASE severity WHEN 'WARNING' THEN 10 ELSE 3 END ELSE CASE severity WHEN 'ERROR' THEN 20 WHEN 'WARNING' THEN 10 ELSE 5 END END AS c FROM findings), scores AS (SELECT (SELECT greatest(0, 100 - sum(null_pct) * 0.5) FROM facts) AS completeness, (SELECT greatest(0, 100 - repeated * 200.0 / n) FROM shape) AS uniqueness, (SELECT greatest(0, 100 - coalesce(sum(c), 0)) FROM cost WHERE dimension = 'Consistency') AS consistency, (SELECT greatest(0, 100 - coalesce(sum(c), 0)) FROM cost WHERE dimension = 'Accuracy') AS accuracy, (SELECT greatest(0, 100 - coalesce(sum(c), 0)) FROM cost WHERE dimension = 'Reliability') AS reliability, (SELECT greatest(0, 100 - 10 * count(*)) FROM facts WHERE nulls > 0 AND d > 1 AND d >= 0.95 * n) AS readiness), total AS (SELECT *, round(greatest(0, completeness * 0.25 + uniqueness * 0.15 + consistency * 0.2 + accuracy * 0.25 + reliability * 0.15 - (100 - readiness) * 0.1), 2) AS overall FROM scores)"


@query(f"WITH {HEALTH} SELECT CAST(round(completeness, 2) AS DOUBLE) AS completeness, CAST(round(uniqueness, 2) AS DOUBLE) AS uniqueness, CAST(consistency AS DOUBLE) AS consistency, CAST(accuracy AS DOUBLE) AS accuracy, CAST(reliability AS DOUBLE) AS reliability, CAST(readiness AS DOUBLE) AS readiness, CAST(overall AS DOUBLE) AS overall, CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 75 THEN 'B' WHEN overall >= 60 THEN 'C' WHEN overall >= 40 THEN 'D' ELSE 'F' END AS grade FROM total")
def health_score(spark, sf_dir):
    return audit.health_frame(read(spark, sf_dir, "customer"), "c_mktsegment")


GAPPY_FINDINGS = findings_sql(GAPPY, ['event_id', 'user_id', 'value'], ['event_type'], ['ts'], 'event_type')


@query(f"WITH {GAPPY_FINDINGS} SELECT dimension, severity, \"column\", round(value, 3) AS value FROM findings")
def audit_findings(spark, sf_dir):
    return audit.audit(gappy_events(spark, sf_dir), "event_type").select("dimension", "severity", "column", F.round("value", 3).alias("value"))


@query(f"WITH {GAPPY_FINDINGS} SELECT severity, count(*) AS n FROM findings GROUP BY severity")
def severity_counts(spark, sf_dir):
    return audit.severity_counts(audit.audit(gappy_events(spark, sf_dir), "event_type"))


@query("SELECT CASE WHEN repeated * 100.0 / n > 5 THEN 'WARNING' ELSE 'INFO' END AS severity, round(repeated * 100.0 / n, 3) AS pct FROM (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem) d) AS repeated FROM lineitem) x WHERE repeated > 0")
def duplicate_findings(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_discount")
    return audit.audit(df).where("dimension = 'Uniqueness'").select("severity", F.round("value", 3).alias("pct"))


# --- Validation -----------------------------------------------------------------------------------


ORDER_SCHEMA = validate.Schema([validate.ExpectedColumn("o_orderkey", "integer", False, True), validate.ExpectedColumn("o_custkey", "integer", False, True), validate.ExpectedColumn("o_totalprice", "float", False), validate.ExpectedColumn("o_orderdate", "datetime"), validate.ExpectedColumn("o_comment", "text")])


@query("SELECT 'min_rows' AS \"check\", NULL AS \"column\", CAST(count(*) AS DOUBLE) AS observed, count(*) >= 10 AS passed FROM orders UNION ALL SELECT 'max_rows', NULL, count(*), count(*) <= 10000000 FROM orders UNION ALL SELECT 'missing_column', c, NULL, p FROM (VALUES ('o_orderkey', true), ('o_custkey', true), ('o_totalprice', true), ('o_orderdate', true), ('o_comment', false)) v(c, p) UNION ALL SELECT 'unexpected_column', c, NULL, false FROM (VALUES ('o_orderstatus'), ('o_orderpriority')) v(c) UNION ALL SELECT 'type', c, NULL, true FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_totalprice'), ('o_orderdate')) v(c) UNION ALL SELECT 'not_null', 'o_orderkey', count(*) - count(o_orderkey), count(*) = count(o_orderkey) FROM orders UNION ALL SELECT 'not_null', 'o_custkey', count(*) - count(o_custkey), count(*) = count(o_custkey) FROM orders UNION ALL SELECT 'not_null', 'o_totalprice', count(*) - count(o_totalprice), count(*) = count(o_totalprice) FROM orders UNION ALL SELECT 'unique', 'o_orderkey', count(*) - count(DISTINCT o_orderkey), count(*) = count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'unique', 'o_custkey', count(*) - count(DISTINCT o_custkey), count(*) = count(DISTINCT o_custkey) FROM orders")
def schema_validation(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    return spark.createDataFrame(validate.check_schema(df, ORDER_SCHEMA), validate.CHECK)


@query("SELECT 'two_values' AS \"check\", c AS \"column\", CAST(d AS DOUBLE) AS observed, d >= 2 AS passed FROM (SELECT 'o_orderstatus' AS c, count(DISTINCT o_orderstatus) AS d FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'fixed', count(DISTINCT 1) FROM orders) x UNION ALL SELECT 'not_null_mostly', c, h, true FROM (SELECT 'o_orderstatus' AS c, count(o_orderstatus) / count(*) AS h FROM orders UNION ALL SELECT 'o_custkey', count(o_custkey) / count(*) FROM orders UNION ALL SELECT 'fixed', count(1) / count(*) FROM orders) y")
def expectations(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", F.lit(1).alias("fixed"))
    found = [c for c in validate.validate(df).checks if c[0] in ("two_values", "not_null_mostly")]
    return spark.createDataFrame(found, validate.CHECK)


ORDER_FACTS = facts_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"], ["o_orderdate"])
#: The checks that the table's own facts lead to; only two_values, id_unique and not_blank can fail on the table that they come from.
ORDER_CHECKS = f"{ORDER_FACTS}, checks AS (SELECT 'not_null_mostly' AS k, true AS passed FROM facts UNION ALL SELECT 'two_values', d >= 2 FROM facts UNION ALL SELECT 'id_unique', d = n - nulls FROM facts WHERE d > 1 AND d >= 0.95 * n UNION ALL SELECT 'not_blank', true FROM facts WHERE category = 'text' UNION ALL SELECT 'number_type', true FROM facts WHERE kind = 'numeric' UNION ALL SELECT 'in_range', true FROM facts WHERE kind = 'numeric' UNION ALL SELECT 'spread', sd >= 1e-4 FROM facts WHERE kind = 'numeric' AND sd > 0 UNION ALL SELECT 'time_type', true FROM facts WHERE kind = 'time' UNION ALL SELECT 'value_set', true FROM facts WHERE kind = 'text' AND d BETWEEN 1 AND 20 UNION ALL SELECT 'some_rows', n >= 1 FROM shape UNION ALL SELECT 'column_order', true)"


@query(f"WITH {ORDER_CHECKS} SELECT k AS \"check\", count(*) AS n, count(*) FILTER (WHERE passed) AS passed FROM checks GROUP BY k")
def expectation_suite(spark, sf_dir):
    v = validate.validate(read(spark, sf_dir, "orders"))
    return v.frame(read(spark, sf_dir, "orders")).groupBy("check").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


@query(f"WITH {ORDER_CHECKS} SELECT CAST(round(least(100, (count(*) FILTER (WHERE passed) + 1) * 100.0 / (count(*) + 1)), 2) AS DOUBLE) AS score, count(*) FILTER (WHERE NOT passed) = 0 AS success, count(*) AS checks, CAST((SELECT count(*) FROM facts WHERE nulls = n OR (kind = 'text' AND classes > 1)) AS BIGINT) AS issues FROM checks")
def validation_report(spark, sf_dir):
    v = validate.validate(read(spark, sf_dir, "orders"), "o_orderstatus")
    return spark.createDataFrame([(v.score, v.success, len(v.checks), len(v.issues))], "score double, success boolean, checks long, issues long")


@query("WITH f AS (SELECT min(o_totalprice) - 3 * stddev_samp(o_totalprice) AS lo, max(o_totalprice) + 3 * stddev_samp(o_totalprice) AS hi, max(o_totalprice) AS top FROM orders), x AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN hi + 1 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 40 = 0 THEN 'Z' ELSE o_orderstatus END AS status, lo, hi FROM orders, f) SELECT 'in_range' AS \"check\", 'o_totalprice' AS \"column\", CAST(count(*) FILTER (WHERE price < lo OR price > hi) AS DOUBLE) AS observed, count(*) FILTER (WHERE price < lo OR price > hi) = 0 AS passed FROM x UNION ALL SELECT 'value_set', 'o_orderstatus', count(*) FILTER (WHERE status NOT IN (SELECT DISTINCT o_orderstatus FROM orders)), count(*) FILTER (WHERE status NOT IN (SELECT DISTINCT o_orderstatus FROM orders)) = 0 FROM x UNION ALL SELECT 'column_order', NULL, 2, true UNION ALL SELECT 'number_type', 'o_totalprice', NULL, (SELECT typeof(price) = 'DOUBLE' FROM x LIMIT 1)")
def expectations_of_another(spark, sf_dir):
    """The suite of one version held against another with values out of range and a new value."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    own = o.select("o_totalprice", "o_orderstatus")
    f = own.agg((F.max("o_totalprice") + 3 * F.stddev_samp("o_totalprice") + 1).alias("far")).first()
    later = o.select(F.when(F.col("o_orderkey") % 50 == 0, f.far).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when(F.col("o_orderkey") % 40 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    suite = validate.expectations(own, profile.gather_facts(own))
    return spark.createDataFrame(validate.check_expectations(later, suite), validate.CHECK).where("check IN ('in_range', 'value_set', 'column_order', 'number_type')")


@query("SELECT name, CASE WHEN t LIKE '%INT%' THEN 'integer' WHEN t = 'DOUBLE' THEN 'float' WHEN t LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'text' END AS type, nulls > 0 AS nullable, nulls = 0 AND d = n AS \"unique\" FROM (" + each(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "SELECT '{c}' AS name, any_value(typeof({c})) AS t, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS d, count(*) AS n FROM orders") + ") x")
def schema_of_table(spark, sf_dir):
    found = validate.Schema.of(read(spark, sf_dir, "orders"))
    return spark.createDataFrame([(c.name, c.type, c.nullable, c.unique) for c in found.columns], "name string, type string, nullable boolean, unique boolean")


@query("SELECT 'mixed' AS kind, 'v' AS \"column\" WHERE (SELECT count(DISTINCT CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END) FROM events) > 1 UNION ALL SELECT 'blank', 'w' WHERE (SELECT count(*) FILTER (WHERE event_id % 9 = 0) FROM events) > 0 UNION ALL SELECT 'empty', 'e' WHERE (SELECT count(*) FROM events) > 0 UNION ALL SELECT 'leakage', 'twice' WHERE (SELECT abs(corr(value, value * 2)) FROM events) > 0.95 UNION ALL SELECT 'low variance', 'flat' WHERE (SELECT stddev_samp(value * 1e-9) FROM events) < 1e-4")
def own_issues(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    df = e.select("value", (F.col("value") * 2).alias("twice"), (F.pmod(F.xxhash64("event_id"), F.lit(100)) * 1e-9).alias("flat"), F.when(F.col("event_id") % 3 == 0, "12").otherwise("word").alias("v"), F.when(F.col("event_id") % 9 == 0, "  ").otherwise("text").alias("w"), F.lit(None).cast("string").alias("e"))
    return spark.createDataFrame(validate.own_issues(profile.gather_facts(df), "value"), "kind string, column string")


# --- Cleaning -------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN NULL ELSE concat(upper(event_type[1]), event_type[2:]) END AS kind FROM events")
def clean_sentinels(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    dirty = e.select("event_id", F.when(F.col("event_id") % 7 == 0, " N/A ").when(F.col("event_id") % 11 == 0, "UNKNOWN").otherwise(F.initcap("event_type")).alias("kind"))
    return clean.null_sentinels(dirty)


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'Unknown' ELSE concat(upper(event_type[1]), event_type[2:]) END AS kind FROM events")
def keep_ambiguous(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return clean.null_sentinels(e.select("event_id", F.when(F.col("event_id") % 11 == 0, "Unknown").otherwise(F.initcap("event_type")).alias("kind")))


@query("SELECT p_partkey, p_name FROM part")
def strip_whitespace(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return clean.strip_text(p.select("p_partkey", F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "   "), F.lit("\t")).alias("p_name")))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber = 1 THEN -l_extendedprice ELSE l_extendedprice END, 2) AS price, round(l_discount, 4) AS discount, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem")
def parse_numeric(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    money = F.format_number("l_extendedprice", 2)
    written = line.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, F.concat(F.lit("("), money, F.lit(")"))).otherwise(F.concat(F.lit("$"), money)).alias("price"), F.concat(F.round(F.col("l_discount") * 100, 0).cast("int").cast("string"), F.lit("%")).alias("discount"), F.col("l_quantity").cast("int").cast("string").alias("quantity"))
    parsed = clean.parse_numbers(written)
    return parsed.select("l_orderkey", "l_linenumber", F.round("price", 2).alias("price"), F.round("discount", 4).alias("discount"), "quantity")


@query("SELECT o_orderkey, o_orderdate AS order_date FROM orders")
def parse_dates(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    form = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return clean.parse_timestamps(o.select("o_orderkey", form.alias("order_date"))).withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id FROM events")
def restore_integers(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return clean.narrow_whole_floats(e.select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("double")).alias("user_id")))


@query("SELECT user_id, event_type FROM events WHERE event_id % 4 <> 0")
def drop_empty(spark, sf_dir):
    e, kept = read(spark, sf_dir, "events"), F.col("event_id") % 4 != 0
    return clean.drop_empty(e.select(F.when(kept, F.col("user_id")).alias("user_id"), F.when(kept, F.col("event_type")).alias("event_type"), F.lit(None).cast("int").alias("blank")))


@query("SELECT 'kind' AS \"column\", count(*) AS n FROM events WHERE event_id % 7 = 0 OR event_type = 'error'")
def residual_sentinels(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return clean.residual_sentinels(e.select("event_id", F.when(F.col("event_id") % 7 == 0, "None").otherwise(F.col("event_type")).alias("kind")))


# --- Repair ---------------------------------------------------------------------------------------


@query(f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {GAPPY} h)), 4) AS value FROM {GAPPY} g")
def impute_mean(spark, sf_dir):
    return repair.impute(gappy_events(spark, sf_dir).select("event_id", "value"), "value", "mean").withColumn("value", F.round("value", 4))


@query(f"SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {GAPPY} h)), 6) AS value FROM {GAPPY} g")
def impute_median(spark, sf_dir):
    return repair.impute(gappy_events(spark, sf_dir).select("event_id", "value"), "value", "median").withColumn("value", F.round("value", 6))


@query(f"SELECT event_id, coalesce(event_type, (SELECT event_type FROM {GAPPY} h WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type FROM {GAPPY} g")
def impute_mode(spark, sf_dir):
    return repair.impute(gappy_events(spark, sf_dir).select("event_id", "event_type"), "event_type", "mode")


@query(f"SELECT event_id, coalesce(value, 7.5) AS value FROM {GAPPY} g")
def impute_constant(spark, sf_dir):
    return repair.impute(gappy_events(spark, sf_dir).select("event_id", "value"), "value", "constant", 7.5)


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem), 4) AS price FROM lineitem")
def scale_standard(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return repair.scale(df, "price", "standard").withColumn("price", F.round("price", 4))


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem)) / (SELECT max(l_extendedprice) - min(l_extendedprice) FROM lineitem), 6) AS price FROM lineitem")
def scale_minmax(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return repair.scale(df, "price", "minmax").withColumn("price", F.round("price", 6))


@query("SELECT p_partkey, CASE WHEN n >= 0.04 * t THEN p_brand ELSE 'Other' END AS p_brand FROM (SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS n, count(*) OVER () AS t FROM part) x")
def group_rare(spark, sf_dir):
    return repair.group_rare(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", 0.04)


@query("SELECT l_orderkey, l_linenumber, round(greatest(least(l_extendedprice, q3 + 1.0 * (q3 - q1) * 1.5), q1 - 1.5 * (q3 - q1)), 4) AS price FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem) q")
def clamp_iqr(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return repair.clamp(df, "price", "iqr").withColumn("price", F.round("price", 4))


@query("SELECT event_id, round(greatest(least(value, m + 3 * s), m - 3 * s), 4) AS value FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) x")
def clamp_zscore(spark, sf_dir):
    return repair.clamp(read(spark, sf_dir, "events").select("event_id", "value"), "value", "zscore").withColumn("value", F.round("value", 4))


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders")
def encode_ordinal(spark, sf_dir):
    return repair.encode(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("SELECT event_id, CAST(round_even(value, 0) AS BIGINT) AS value FROM events")
def coerce_types(spark, sf_dir):
    return repair.coerce(read(spark, sf_dir, "events").select("event_id", F.col("value").cast("string").alias("value")), "value", "int")[0]


@query("SELECT c_custkey, c_acctbal FROM customer")
def drop_constant(spark, sf_dir):
    return repair.drop_constant(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(1).alias("one"), F.lit(None).cast("string").alias("none")))


@query(f"SELECT event_id, event_type FROM {GAPPY} g WHERE event_type IS NOT NULL")
def drop_missing_target(spark, sf_dir):
    return repair.drop_missing_target(gappy_events(spark, sf_dir).select("event_id", "event_type"), "event_type")


def priced_lines(spark, sf_dir, gaps: bool) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", (F.col("l_quantity") * F.col("l_extendedprice")).alias("net"))
    return line.withColumn("net", F.when(F.col("l_orderkey") % 10 != 0, F.col("net"))) if gaps else line


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, round(l_quantity * l_extendedprice, 4) AS net FROM lineitem")
def derive_identity(spark, sf_dir):
    df = priced_lines(spark, sf_dir, True)
    return relations.fill(df, relations.discover(df.select("l_quantity", "l_extendedprice", "net")))[0].withColumn("net", F.round("net", 4))


@query("SELECT 'net' AS target, '*' AS operator, count(*) AS support, CAST(1.0 AS DOUBLE) AS confidence FROM lineitem WHERE l_orderkey % 10 <> 0")
def identity_confidence(spark, sf_dir):
    found = relations.discover(priced_lines(spark, sf_dir, True).select("l_quantity", "l_extendedprice", "net"))
    rows = [(r.target, r.operator, r.support, r.confidence) for r in found if r.target == "net"]
    return spark.createDataFrame(rows, "target string, operator string, support long, confidence double")


@query("SELECT count(*) AS testable, count(*) FILTER (WHERE l_orderkey % 100 = 1) AS violations FROM lineitem")
def identity_violations(spark, sf_dir):
    df = priced_lines(spark, sf_dir, False).withColumn("net", F.when(F.col("l_orderkey") % 100 == 1, F.col("net") * 2).otherwise(F.col("net")))
    return relations.violations(df, [relations.Identity("net", "l_quantity", "l_extendedprice", "*", 0, 1.0)]).select("testable", "violations")


@query(f"SELECT event_id, coalesce(event_type, (SELECT event_type FROM {GAPPY} h WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {GAPPY} h)), 6) AS value FROM {GAPPY} g")
def auto_repair(spark, sf_dir):
    r = repair.Repairer(gappy_events(spark, sf_dir).select("event_id", "event_type", "value"))
    r.auto_repair()
    return r.df.withColumn("value", F.round("value", 6))


REPAIRED = f"(SELECT event_id, coalesce(event_type, (SELECT event_type FROM {GAPPY} h WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {GAPPY} h)) AS value FROM {GAPPY} g)"


@query(f"SELECT gaps, duplicates, gaps = 0 AND duplicates = 0 AS clean FROM (SELECT CAST(3 * count(*) - count(event_id) - count(event_type) - count(value) AS BIGINT) AS gaps, count(*) - count(DISTINCT (event_id, event_type, value)) AS duplicates FROM {REPAIRED} r) x UNION ALL SELECT gaps, duplicates, gaps = 0 AND duplicates = 0 FROM (SELECT CAST(3 * count(*) - count(event_id) - count(event_type) - count(value) AS BIGINT) AS gaps, count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_id, event_type, value FROM {GAPPY} d) e) AS duplicates FROM {GAPPY} r) y")
def verify_clean(spark, sf_dir):
    """After and before the repair."""
    r = repair.Repairer(gappy_events(spark, sf_dir).select("event_id", "event_type", "value"))
    before = repair.verify(r.df)
    r.auto_repair()
    rows = [(sum(v["missing"].values()), v["duplicates"], v["clean"]) for v in (repair.verify(r.df), before)]
    return spark.createDataFrame(rows, "gaps long, duplicates long, clean boolean")


# --- Drift and versions ---------------------------------------------------------------------------

EARLY, LATE = "l_shipdate < TIMESTAMP '1998-01-01'", "l_shipdate >= TIMESTAMP '1998-01-01'"


def halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    line = read(spark, sf_dir, "lineitem")
    late = line.where(LATE).withColumn("l_quantity", F.when(F.col("l_linenumber") > 3, F.col("l_quantity") + 10).otherwise(F.col("l_quantity")))
    return line.where(EARLY), late


HALVES = f"ref AS (SELECT * FROM lineitem WHERE {EARLY}), cur AS (SELECT * REPLACE (CASE WHEN l_linenumber > 3 THEN l_quantity + 10 ELSE l_quantity END AS l_quantity) FROM lineitem WHERE {LATE})"
SHARES = "tot AS (SELECT sum(n_ref) AS t_ref, sum(n_cur) AS t_cur FROM counts), fl AS (SELECT value, greatest(n_ref / t_ref, 1e-6) AS r, greatest(n_cur / t_cur, 1e-6) AS c FROM counts, tot), sh AS (SELECT value, r / sum(r) OVER () AS r, c / sum(c) OVER () AS c FROM fl)"
NUMERIC_COUNTS = "edges AS (SELECT DISTINCT e FROM (SELECT unnest(quantile_cont(l_quantity, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM ref) q WHERE e > (SELECT min(l_quantity) FROM ref) AND e < (SELECT max(l_quantity) FROM ref)), binned AS (SELECT 0 AS s, (SELECT count(*) FROM edges WHERE e <= l_quantity) AS value FROM ref UNION ALL SELECT 1, (SELECT count(*) FROM edges WHERE e <= l_quantity) FROM cur), counts AS (SELECT value, count(*) FILTER (WHERE s = 0) AS n_ref, count(*) FILTER (WHERE s = 1) AS n_cur FROM binned GROUP BY value)"


@query(f"WITH {HALVES}, {NUMERIC_COUNTS}, {SHARES} SELECT round(sum((c - r) * ln(c / r)), 5) AS psi FROM sh")
def psi_numeric(spark, sf_dir):
    ref, cur = halves(spark, sf_dir)
    return drift.psi_of(drift.numeric_counts(ref, cur, "l_quantity")).select(F.round("psi", 5).alias("psi"))


CATEGORY_COUNTS = "counts AS (SELECT coalesce(a.v, b.v) AS value, coalesce(a.n, 0) AS n_ref, coalesce(b.n, 0) AS n_cur FROM (SELECT l_returnflag AS v, count(*) AS n FROM ref GROUP BY 1) a FULL JOIN (SELECT CASE WHEN l_linenumber = 7 THEN 'X' ELSE l_returnflag END AS v, count(*) AS n FROM cur GROUP BY 1) b ON a.v = b.v)"


def flags(spark, sf_dir):
    ref, cur = halves(spark, sf_dir)
    return drift.category_counts(ref, cur.withColumn("l_returnflag", F.when(F.col("l_linenumber") == 7, "X").otherwise(F.col("l_returnflag"))), "l_returnflag")


@query(f"WITH {HALVES}, {CATEGORY_COUNTS}, {SHARES} SELECT round(sum((c - r) * ln(c / r)), 5) AS psi FROM sh")
def psi_categorical(spark, sf_dir):
    return drift.psi_of(flags(spark, sf_dir)).select(F.round("psi", 5).alias("psi"))


@query(f"WITH {HALVES}, {CATEGORY_COUNTS}, {SHARES} SELECT value, round(r, 6) AS share_ref, round(c, 6) AS share_cur, round((c - r) * ln(c / r), 5) AS contribution FROM sh")
def drift_distribution(spark, sf_dir):
    return drift.contributions(flags(spark, sf_dir)).select("value", F.round("share_ref", 6).alias("share_ref"), F.round("share_cur", 6).alias("share_cur"), F.round("contribution", 5).alias("contribution"))


@query(f"WITH {HALVES}, v AS (SELECT l_quantity AS x, 1 AS a, 0 AS b FROM ref UNION ALL SELECT l_quantity, 0, 1 FROM cur), g AS (SELECT x, sum(a) AS a, sum(b) AS b FROM v GROUP BY x), w AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS fb FROM g) SELECT round(max(abs(fa - fb)), 6) AS statistic, (SELECT count(*) FROM ref) AS n_ref, (SELECT count(*) FROM cur) AS n_cur FROM w")
def ks_statistic(spark, sf_dir):
    ref, cur = halves(spark, sf_dir)
    return drift.ks_statistic(ref, cur, "l_quantity").withColumn("statistic", F.round("statistic", 6))


@query(f"WITH {HALVES}, {CATEGORY_COUNTS}, tot AS (SELECT sum(n_ref) AS tr, sum(n_cur) AS tc FROM counts), e AS (SELECT n_ref, n_cur, (n_ref + n_cur) * tr / (tr + tc) AS er, (n_ref + n_cur) * tc / (tr + tc) AS ec FROM counts, tot) SELECT round(sum((n_ref - er) ** 2 / er + (n_cur - ec) ** 2 / ec), 3) AS statistic, count(*) AS groups FROM e")
def chi_square_stat(spark, sf_dir):
    return drift.chi_square(flags(spark, sf_dir)).select(F.round("statistic", 3).alias("statistic"), "groups")


@query(f"WITH a AS (SELECT * FROM {GAPPY} g WHERE event_id % 2 = 0), b AS (SELECT * FROM events WHERE event_id % 2 = 1) SELECT c AS \"column\", round(x, 3) AS missing_ref, round(y, 3) AS missing_cur FROM (SELECT 'event_type' AS c, (SELECT avg(CASE WHEN event_type IS NULL THEN 100.0 ELSE 0 END) FROM a) AS x, (SELECT avg(CASE WHEN event_type IS NULL THEN 100.0 ELSE 0 END) FROM b) AS y UNION ALL SELECT 'value', (SELECT avg(CASE WHEN value IS NULL THEN 100.0 ELSE 0 END) FROM a), (SELECT avg(CASE WHEN value IS NULL THEN 100.0 ELSE 0 END) FROM b)) z")
def missing_rate_drift(spark, sf_dir):
    ref, cur = gappy_events(spark, sf_dir).where("event_id % 2 = 0"), read(spark, sf_dir, "events").where("event_id % 2 = 1")
    return drift.missing_rates(ref, cur, ["event_type", "value"]).select("column", F.round("missing_ref", 3).alias("missing_ref"), F.round("missing_cur", 3).alias("missing_cur"))


def numeric_drift_sql(c: str) -> str:
    """A row with the PSI and the Kolmogorov-Smirnov statistic of a numeric column of the halves."""
    steps = f"WITH v AS (SELECT {c} AS x, 1 AS a, 0 AS b FROM ref UNION ALL SELECT {c}, 0, 1 FROM cur), g AS (SELECT x, sum(a) AS a, sum(b) AS b FROM v GROUP BY x), w AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS fb FROM g) SELECT max(abs(fa - fb)) FROM w"
    return f"SELECT '{c}' AS \"column\", 'numeric' AS kind, (WITH {NUMERIC_COUNTS.replace('l_quantity', c)}, {SHARES} SELECT sum((c - r) * ln(c / r)) FROM sh) AS psi, ({steps}) AS statistic"


FLAG_DRIFT = f"SELECT 'l_returnflag' AS \"column\", 'categorical' AS kind, (WITH {CATEGORY_COUNTS}, {SHARES} SELECT sum((c - r) * ln(c / r)) FROM sh) AS psi, (WITH {CATEGORY_COUNTS}, tot AS (SELECT sum(n_ref) AS tr, sum(n_cur) AS tc FROM counts), e AS (SELECT n_ref, n_cur, (n_ref + n_cur) * tr / (tr + tc) AS er, (n_ref + n_cur) * tc / (tr + tc) AS ec FROM counts, tot) SELECT sum((n_ref - er) ** 2 / er + (n_cur - ec) ** 2 / ec) FROM e) AS statistic"


def drifted_halves(spark, sf_dir) -> drift.Drift:
    ref, cur = halves(spark, sf_dir)
    cur = cur.withColumn("l_returnflag", F.when(F.col("l_linenumber") == 7, "X").otherwise(F.col("l_returnflag")))
    return drift.detect(ref, cur, ["l_quantity", "l_discount", "l_returnflag", "l_tax"])


@query(f"WITH {HALVES} SELECT \"column\", kind, CASE WHEN psi >= 0.25 THEN 'CRITICAL' WHEN psi >= 0.1 THEN 'WARNING' ELSE 'STABLE' END AS status, round(psi, 4) AS psi, round(statistic, 3) AS statistic FROM ({numeric_drift_sql('l_quantity')} UNION ALL {numeric_drift_sql('l_discount')} UNION ALL {numeric_drift_sql('l_tax')} UNION ALL {FLAG_DRIFT}) d")
def drift_scores(spark, sf_dir):
    found = drifted_halves(spark, sf_dir).frame(read(spark, sf_dir, "lineitem"))
    return found.select("column", "kind", "status", F.round("psi", 4).alias("psi"), F.round("statistic", 3).alias("statistic"))


#: Of a numeric column, two-sample p by the asymptotic tail, which holds from 10,000 values on a side.
KS_P = "CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, (SELECT 2 * sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * x * x)) FROM range(1, 101) t(k)))) END"


@query(f"WITH {HALVES}, d AS (SELECT \"column\", statistic, statistic * sqrt((SELECT count(*) FROM ref) * 1.0 * (SELECT count(*) FROM cur) / ((SELECT count(*) FROM ref) + (SELECT count(*) FROM cur))) AS x FROM ({numeric_drift_sql('l_quantity')} UNION ALL {numeric_drift_sql('l_discount')} UNION ALL {numeric_drift_sql('l_tax')}) u), p AS (SELECT \"column\", {KS_P} AS p FROM d) SELECT \"column\", round(p, 5) AS p_value, p < 0.05 AS significant FROM p")
def drift_significance(spark, sf_dir):
    found = drifted_halves(spark, sf_dir).frame(read(spark, sf_dir, "lineitem")).where("kind = 'numeric'")
    return found.select("column", F.round("p_value", 5).alias("p_value"), "significant")


@query(f"WITH {HALVES}, d AS (SELECT * FROM ({numeric_drift_sql('l_quantity')} UNION ALL {numeric_drift_sql('l_discount')} UNION ALL {numeric_drift_sql('l_tax')} UNION ALL {FLAG_DRIFT}) u), s AS (SELECT count(*) FILTER (WHERE psi >= 0.25) AS critical, count(*) FILTER (WHERE psi >= 0.1) * 1.0 / count(*) AS share, avg(round(psi, 6)) AS mean_psi, max(round(psi, 6)) AS max_psi FROM d) SELECT CASE WHEN critical > 0 AND share >= 0.3 THEN 'CRITICAL' WHEN critical > 0 OR share >= 0.1 THEN 'WARNING' ELSE 'STABLE' END AS status, critical, round(mean_psi, 4) AS mean_psi, round(max_psi, 4) AS max_psi FROM s")
def drift_of_the_dataset(spark, sf_dir):
    found = drifted_halves(spark, sf_dir)
    return spark.createDataFrame([(found.status, found.counts()["CRITICAL"], round(found.mean_psi, 4), round(found.max_psi, 4))], "status string, critical long, mean_psi double, max_psi double")


@query(f"WITH {HALVES} SELECT \"column\", CASE WHEN psi >= 0.25 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, round(psi, 3) AS psi FROM ({numeric_drift_sql('l_quantity')} UNION ALL {numeric_drift_sql('l_discount')} UNION ALL {numeric_drift_sql('l_tax')} UNION ALL {FLAG_DRIFT}) d WHERE psi >= 0.1")
def version_drift(spark, sf_dir):
    """What a comparison of two versions says of the drift of their columns."""
    names = ["l_quantity", "l_discount", "l_returnflag", "l_tax"]
    ref, cur = halves(spark, sf_dir)
    cur = cur.withColumn("l_returnflag", F.when(F.col("l_linenumber") == 7, "X").otherwise(F.col("l_returnflag")))
    found = compare.compare(ref.select(*names), cur.select(*names)).frame(ref).where("kind = 'drift'")
    return found.select("column", "severity", F.round(F.regexp_extract("after", r"PSI ([0-9.]+)", 1).cast("double"), 3).alias("psi"))


#: Columns made of four numbers of a line, so many that their pairs are not one aggregate.
MADE = {f"{n}_{c[2:]}": e.replace("{c}", c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for n, e in {"own": "{c}", "square": "{c} * {c}", "root": "sqrt({c})", "line": "{c} * l_linenumber", "part": "{c} + l_partkey % 100", "gaps": "CASE WHEN l_linenumber <> 3 THEN {c} END", "other": "CASE WHEN l_linenumber <> 5 THEN -{c} + l_suppkey % 7 END"}.items()}
MADE_PAIRS = [(a, b) for i, a in enumerate(MADE) for b in list(MADE)[i + 1 :]]


@query(f"WITH m AS (SELECT {', '.join(f'{e} AS {n}' for n, e in MADE.items())} FROM lineitem), r AS (SELECT {', '.join(f'corr({a}, {b}) AS r{i}' for i, (a, b) in enumerate(MADE_PAIRS))} FROM m) " + " UNION ALL ".join(f"SELECT '{a}' AS left_column, '{b}' AS right_column, CASE WHEN abs(r{i}) < 0.0001 THEN 0.0 ELSE round(r{i}, 4) END AS r FROM r" for i, (a, b) in enumerate(MADE_PAIRS)))
def wide_correlations(spark, sf_dir):
    made = read(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in MADE.items()])
    return profile.correlation_matrix(made).select("left_column", "right_column", F.when(F.abs("r") < 0.0001, 0.0).otherwise(F.round("r", 4)).alias("r"))


@query(f"WITH {HALVES} SELECT \"column\", side, measure, round(value, 4) AS value FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{side}' AS side, '{m}' AS measure, CAST({e.replace('{c}', c)} AS DOUBLE) AS value FROM {t}" for c in ("l_quantity", "l_tax") for side, t in (("reference", "ref"), ("current", "cur")) for m, e in (("count", "count({c})"), ("missing_pct", "(count(*) - count({c})) * 100.0 / count(*)"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"), ("max", "max({c})"), ("q1", "quantile_cont({c}, 0.25)"), ("median", "quantile_cont({c}, 0.5)"), ("q3", "quantile_cont({c}, 0.75)"))) + ") x")
def drift_statistics(spark, sf_dir):
    found = drifted_halves(spark, sf_dir).statistics_frame(read(spark, sf_dir, "lineitem"))
    return found.where("column IN ('l_quantity', 'l_tax')").select("column", "side", "measure", F.round("value", 4).alias("value"))


@query(f"WITH {HALVES}, {NUMERIC_COUNTS}, {SHARES} SELECT round(r, 6) AS share_ref, round(c, 6) AS share_cur, round((c - r) * ln(c / r), 5) AS contribution FROM sh")
def drift_bins(spark, sf_dir):
    found = drifted_halves(spark, sf_dir).distribution_frame(read(spark, sf_dir, "lineitem")).where("column = 'l_quantity'")
    return found.select(F.round("share_ref", 6).alias("share_ref"), F.round("share_cur", 6).alias("share_cur"), F.round("contribution", 5).alias("contribution"))


@query(f"WITH ref AS (SELECT event_type AS v FROM events WHERE event_id % 2 = 0 AND event_type <> 'share'), cur AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'fresh' ELSE event_type END AS v FROM events WHERE event_id % 2 = 1) SELECT 'new' AS change, v AS value FROM (SELECT DISTINCT v FROM cur WHERE v NOT IN (SELECT v FROM ref WHERE v IS NOT NULL)) n UNION ALL SELECT 'gone', v FROM (SELECT DISTINCT v FROM ref WHERE v NOT IN (SELECT v FROM cur WHERE v IS NOT NULL)) g")
def changed_values(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    ref = e.where("event_id % 2 = 0 AND event_type <> 'share'").select("event_type")
    cur = e.where("event_id % 2 = 1").select(F.when(F.col("event_id") % 11 == 0, "fresh").otherwise(F.col("event_type")).alias("event_type"))
    found = drift.detect(ref, cur).columns[0]
    return spark.createDataFrame([("new", v) for v in found.new_values] + [("gone", v) for v in found.gone_values], "change string, value string")


def next_customers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "customer")
    after = c.select("c_custkey", F.col("c_name").alias("full_name"), F.col("c_nationkey").cast("string").alias("c_nationkey"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_custkey") % 2 == 0, "MACHINERY").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.lit(1).alias("extra"))
    return c, after


NEXT = "(SELECT c_custkey, c_name AS full_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN 'MACHINERY' ELSE c_mktsegment END AS c_mktsegment, 1 AS extra FROM customer)"
#: Columns that only one version has, with the share of their values in common.
RENAMES = f"gone AS (SELECT column_name AS c FROM (DESCRIBE SELECT * FROM customer) d WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM {NEXT} m) e)), came AS (SELECT column_name AS c FROM (DESCRIBE SELECT * FROM {NEXT} m) d WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM customer) e)), pairs AS (SELECT 'c_name' AS a, 'full_name' AS b, (SELECT count(*) FROM (SELECT c_name FROM customer INTERSECT SELECT full_name FROM {NEXT} m) i) / (SELECT count(*) FROM (SELECT c_name FROM customer UNION SELECT full_name FROM {NEXT} m) u) AS score), found AS (SELECT a, b, score FROM pairs WHERE a IN (SELECT c FROM gone) AND b IN (SELECT c FROM came) AND score >= 0.9)"


@query(f"WITH {RENAMES} SELECT 'renamed' AS kind, a AS \"column\", 'WARNING' AS severity FROM found UNION ALL SELECT 'removed', c, 'WARNING' FROM gone WHERE c NOT IN (SELECT a FROM found) UNION ALL SELECT 'added', c, 'INFO' FROM came WHERE c NOT IN (SELECT b FROM found) UNION ALL SELECT 'type', x.column_name, CASE WHEN x.column_type = 'VARCHAR' OR y.column_type = 'VARCHAR' THEN 'CRITICAL' ELSE 'INFO' END FROM (DESCRIBE SELECT * FROM customer) x JOIN (DESCRIBE SELECT * FROM {NEXT} m) y ON x.column_name = y.column_name WHERE x.column_type <> y.column_type UNION ALL SELECT 'missing', c, CASE WHEN p < 0 THEN 'INFO' WHEN p >= 20 THEN 'CRITICAL' ELSE 'WARNING' END FROM (" + each(["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"], "SELECT '{c}' AS c, (SELECT avg(CASE WHEN {c} IS NULL THEN 100.0 ELSE 0 END) FROM " + NEXT + " m) - (SELECT avg(CASE WHEN {c} IS NULL THEN 100.0 ELSE 0 END) FROM customer) AS p") + ") g WHERE abs(p) >= 5 UNION ALL SELECT 'cardinality', c, 'WARNING' FROM (SELECT 'c_mktsegment' AS c, (SELECT count(DISTINCT c_mktsegment) FROM " + NEXT + " m) / (SELECT count(DISTINCT c_mktsegment) FROM customer) AS q) h WHERE q >= 2 OR q <= 0.5")
def schema_diff(spark, sf_dir):
    left, right = next_customers(spark, sf_dir)
    found = compare.compare(left, right, row_id="c_custkey", drift=False)
    return found.frame(left).select("kind", "column", "severity")


@query(f"WITH {RENAMES} SELECT a AS before, b AS after, CAST(score AS DOUBLE) AS score FROM found")
def rename_detection(spark, sf_dir):
    left, right = next_customers(spark, sf_dir)
    return spark.createDataFrame(compare.renamed_columns(left, right), "before string, after string, score double")


@query("WITH a AS (SELECT DISTINCT CAST(c_acctbal AS VARCHAR) AS v FROM customer), b AS (SELECT DISTINCT CAST(c_acctbal AS VARCHAR) AS v FROM customer WHERE c_custkey % 3 <> 0) SELECT (SELECT count(*) FROM b) AS shared, (SELECT count(*) FROM a) AS total, round((SELECT count(*) FROM b) / (SELECT count(*) FROM a), 6) AS jaccard")
def value_overlap(spark, sf_dir):
    left, right = next_customers(spark, sf_dir)
    return compare.value_overlap(left, "c_acctbal", right, "c_acctbal").withColumn("jaccard", F.round("jaccard", 6))


@query("WITH n AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'MACHINERY' ELSE c_mktsegment END AS v FROM customer), a AS (SELECT c_mktsegment AS v, count(*) * 100.0 / (SELECT count(*) FROM customer) AS p FROM customer GROUP BY 1), b AS (SELECT v, count(*) * 100.0 / (SELECT count(*) FROM n) AS p FROM n GROUP BY 1) SELECT coalesce(a.v, b.v) AS value, round(a.p, 4) AS pct_left, round(b.p, 4) AS pct_right FROM a FULL JOIN b ON a.v = b.v")
def target_shift(spark, sf_dir):
    left, right = next_customers(spark, sf_dir)
    return compare.class_shares_of_both(left, right, "c_mktsegment").select("value", F.round("pct_left", 4).alias("pct_left"), F.round("pct_right", 4).alias("pct_right"))


SHAPE = "SELECT {s} AS side, (SELECT count(*) FROM {t} m) AS n, (SELECT count(*) FROM (DESCRIBE SELECT * FROM {t} m) d) AS k, (SELECT count(*) FROM {t} m) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t} m) d) AS dup, ({g}) AS nulls"
BOTH_SHAPES = f"shapes AS ({SHAPE.format(s=0, t='customer', g='SELECT 5 * count(*) - count(c_custkey) - count(c_name) - count(c_nationkey) - count(c_acctbal) - count(c_mktsegment) FROM customer')} UNION ALL {SHAPE.format(s=1, t=NEXT, g=f'SELECT 6 * count(*) - count(c_custkey) - count(full_name) - count(c_nationkey) - count(c_acctbal) - count(c_mktsegment) - count(extra) FROM {NEXT} m')}), long AS (SELECT side, 'rows' AS measure, CAST(n AS VARCHAR) AS v FROM shapes UNION ALL SELECT side, 'columns', CAST(k AS VARCHAR) FROM shapes UNION ALL SELECT side, 'duplicates', CAST(dup AS VARCHAR) FROM shapes UNION ALL SELECT side, 'missing_pct', CAST(CAST(round(nulls * 100.0 / (n * k), 4) AS DOUBLE) AS VARCHAR) FROM shapes)"


@query(f"WITH {BOTH_SHAPES} SELECT a.measure, a.v AS \"left\", b.v AS \"right\" FROM long a JOIN long b ON a.measure = b.measure WHERE a.side = 0 AND b.side = 1")
def version_headline(spark, sf_dir):
    left, right = next_customers(spark, sf_dir)
    found = compare.compare(left, right, drift=False)
    return found.headline_frame(left).select("measure", "left", "right")


@query("SELECT 'c_mktsegment' AS \"column\", count(DISTINCT c_mktsegment) AS n_left, 1 AS n_right FROM customer")
def cardinality_change(spark, sf_dir):
    left = read(spark, sf_dir, "customer").select("c_mktsegment")
    right = left.withColumn("c_mktsegment", F.lit("ONE"))
    found = compare.compare(left, right, drift=False).frame(left).where("kind = 'cardinality'")
    return found.select("column", F.col("before").cast("long").alias("n_left"), F.col("after").cast("int").alias("n_right"))


# --- Mutations ------------------------------------------------------------------------------------


@query("SELECT event_id, round((value - m) * 1.5 + m + 0.5 * s, 4) AS value FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) x")
def distribution_shift(spark, sf_dir):
    return mutate.Mutator.shift(read(spark, sf_dir, "events").select("event_id", "value"), 0.5, 1.5, ["value"]).withColumn("value", F.round("value", 4))


def mutator() -> mutate.Mutator:
    return mutate.Mutator("event_id", 42)


@query(f"SELECT event_id, CASE WHEN NOT hit THEN value END AS value FROM {picked_sql('missing value', 0.1)} p")
def inject_missing(spark, sf_dir):
    return mutator().inject_missing(read(spark, sf_dir, "events"), 0.1, ["value"]).select("event_id", "value")


@query(f"WITH p AS (SELECT event_id, row_number() OVER (ORDER BY {draw_sql('event_id', '42', "'place'")}, event_id) - 1 AS place FROM events), d AS (SELECT {draw_sql('i', '42', "'duplicates'")} % (SELECT count(*) FROM events) AS place FROM (SELECT unnest(range(CAST(floor((SELECT count(*) FROM events) * 0.05) AS BIGINT))) AS i) r) SELECT event_id, count(*) AS n FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM d JOIN p ON d.place = p.place) x GROUP BY event_id")
def inject_duplicates(spark, sf_dir):
    return mutator().inject_duplicates(read(spark, sf_dir, "events"), 0.05).groupBy("event_id").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, round(CASE WHEN hit THEN m + CASE WHEN {draw_sql('event_id', '42', chr(39) + 'sign' + chr(39), chr(39) + 'value' + chr(39))} / 1152921504606846976.0 < 0.5 THEN -1 ELSE 1 END * (5 + 5 * ({draw_sql('event_id', '42', chr(39) + 'far' + chr(39), chr(39) + 'value' + chr(39))} / 1152921504606846976.0)) * s ELSE value END, 3) AS value FROM {picked_sql('outliers value', 0.02)} p, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) q")
def inject_outliers(spark, sf_dir):
    return mutator().inject_outliers(read(spark, sf_dir, "events"), 0.02, ["value"]).select("event_id", F.round("value", 3).alias("value"))


@query(f"WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL) c), n AS (SELECT count(*) AS n FROM k) SELECT event_id, CASE WHEN hit THEN b.event_type ELSE p.event_type END AS event_type FROM {picked_sql('flip', 0.1)} p CROSS JOIN n LEFT JOIN k a ON a.event_type = p.event_type LEFT JOIN k b ON b.k = (a.k + 1 + {draw_sql('event_id', '42', chr(39) + 'flip to' + chr(39))} % (n - 1)) % n")
def flip_labels(spark, sf_dir):
    return mutator().flip_labels(read(spark, sf_dir, "events"), "event_type", 0.1).select("event_id", "event_type")


@query(f"SELECT event_id FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {draw_sql('event_id', '42', chr(39) + 'imbalance' + chr(39))}, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS few FROM events) x WHERE event_type <> 'error' OR event_type IS NULL OR r <= greatest(1, least(CAST(floor((SELECT count(*) FROM events WHERE event_type = 'view') * (1 - 0.9) / 0.9) AS BIGINT), few))")
def downsample_minority(spark, sf_dir):
    return mutator().downsample_minority(read(spark, sf_dir, "events"), "event_type", "view", "error", 0.9).select("event_id")


@query(f"WITH g AS (SELECT value, row_number() OVER (ORDER BY {draw_sql('event_id', '42', chr(39) + 'give value' + chr(39))}, event_id) AS r FROM events), t AS (SELECT event_id, row_number() OVER (ORDER BY {draw_sql('event_id', '42', chr(39) + 'take value' + chr(39))}, event_id) AS r FROM events) SELECT event_id, value FROM t JOIN g ON t.r = g.r")
def shuffle_column(spark, sf_dir):
    return mutator().shuffle_column(read(spark, sf_dir, "events").select("event_id", "value"), ["value"])


LETTERS = " || ".join(f"substr('{mutate.ALPHABET}', CAST({draw_sql('event_id', '42', chr(39) + 'corrupt' + chr(39), chr(39) + 'event_type' + chr(39), str(k))} % {len(mutate.ALPHABET)} AS INTEGER) + 1, 1)" for k in range(5))


@query(f"SELECT event_id, CASE WHEN hit THEN {LETTERS} ELSE event_type END AS event_type FROM {picked_sql('corrupt event_type', 0.1)} p")
def random_corruption(spark, sf_dir):
    return mutator().corrupt(read(spark, sf_dir, "events"), 0.1, ["event_type"]).select("event_id", "event_type")


@query("SELECT event_id, value FROM events")
def remove_features(spark, sf_dir):
    return mutator().remove_features(read(spark, sf_dir, "events"), ["ts", "user_id", "event_type", "props"])


@query(f"SELECT event_id, round(value + 0.1 * s * sqrt(-2 * ln(1 - u / 1152921504606846976.0)) * cos(v / 1152921504606846976.0 * 6.283185307179586), 3) AS value FROM (SELECT event_id, value, {draw_sql('event_id', '42', chr(39) + 'noise' + chr(39), chr(39) + 'value' + chr(39), chr(39) + 'u' + chr(39))} AS u, {draw_sql('event_id', '42', chr(39) + 'noise' + chr(39), chr(39) + 'value' + chr(39), chr(39) + 'v' + chr(39))} AS v FROM events) e, (SELECT stddev_samp(value) AS s FROM events) q")
def gaussian_noise(spark, sf_dir):
    return mutator().inject_noise(read(spark, sf_dir, "events"), 0.1, ["value"]).select("event_id", F.round("value", 3).alias("value"))


# --- Stores, fingerprints and models --------------------------------------------------------------


@query("SELECT count(*) AS \"rows\", CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority)), 1, 15) AS BIGINT)) AS VARCHAR) AS content FROM orders")
def fingerprint(spark, sf_dir):
    return fingerprints.content_hash(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS version, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events")
def version_numbers(spark, sf_dir):
    return stores.numbered_versions(read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "version", "parent")


def event_log(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("run_id"), F.lit("events").alias("dataset_name"), F.col("event_id").alias("sequence"), F.col("event_type").alias("stage"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("column"), F.col("ts").cast("string").alias("recorded_at"))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS stage, count(*) AS events, count(DISTINCT event_id % 3) AS columns, min(event_id) AS first FROM events GROUP BY user_id, event_type")
def lineage_history(spark, sf_dir):
    return stores.stage_summary(event_log(spark, sf_dir)).withColumn("columns", F.size("columns").cast("long"))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS events FROM events GROUP BY user_id")
def lineage_runs(spark, sf_dir):
    return stores.runs_of(event_log(spark, sf_dir)).select("run_id", "events")


@query("WITH p AS (SELECT event_id % 3 AS label, (event_id * 7 % 5) % 3 AS prediction FROM events), k AS (SELECT l.k, (SELECT count(*) FROM p WHERE label = l.k) AS a, (SELECT count(*) FROM p WHERE prediction = l.k) AS s, (SELECT count(*) FROM p WHERE label = l.k AND prediction = l.k) AS h FROM (VALUES (0), (1), (2)) l(k)), m AS (SELECT a, h, h / s AS p, h / a AS r FROM k), f AS (SELECT *, 2 * p * r / (p + r) AS f FROM m) SELECT round(sum(h) / sum(a), 6) AS accuracy, round(sum(p * a) / sum(a), 6) AS precision, round(sum(r * a) / sum(a), 6) AS recall, round(sum(f * a) / sum(a), 6) AS f1 FROM f")
def model_metrics(spark, sf_dir):
    said = read(spark, sf_dir, "events").select((F.col("event_id") % 3).cast("double").alias("label"), ((F.col("event_id") * 7 % 5) % 3).cast("double").alias("prediction"))
    return learn.class_metrics(said, 3).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("SELECT round(avg(abs(l_quantity - p)), 5) AS mae, round(sqrt(avg((l_quantity - p) ** 2)), 5) AS rmse, round(1 - sum((l_quantity - p) ** 2) / (var_pop(l_quantity) * count(*)), 5) AS r2 FROM (SELECT l_quantity, 25 + l_linenumber AS p FROM lineitem) x")
def regression_metrics(spark, sf_dir):
    said = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("label"), (F.lit(25.0) + F.col("l_linenumber")).alias("prediction"))
    return learn.regression_metrics(said).select(*[F.round(c, 5).alias(c) for c in ("mae", "rmse", "r2")])


@query("SELECT c AS \"column\", nulls, pct FROM (SELECT 'event_type' AS c, count(*) - count(event_type) AS nulls, round((count(*) - count(event_type)) * 100.0 / count(*), 1) AS pct FROM " + GAPPY + " g UNION ALL SELECT 'value', count(*) - count(value), round((count(*) - count(value)) * 100.0 / count(*), 1) FROM " + GAPPY + " g) x WHERE nulls > 0")
def missing_overview(spark, sf_dir):
    found = profile.null_counts(gappy_events(spark, sf_dir)).where("nulls > 0").orderBy(F.desc("null_pct"))
    return found.select("column", "nulls", F.round(F.col("nulls") * 100.0 / F.col("rows"), 1).alias("pct"))


@query("SELECT c_mktsegment AS class, CAST(count(*) - floor(count(*) * 0.2 + 0.5) AS BIGINT) AS n_train, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS n_test FROM customer GROUP BY c_mktsegment")
def task_split_counts(spark, sf_dir):
    """Rows of each class in train and test."""
    df = learn.with_row_id(read(spark, sf_dir, "customer"))
    parts = [p.groupBy(F.col("c_mktsegment").alias("class")).agg(F.count("*").alias(n)) for p, n in zip(learn.split(df, "c_mktsegment", "classification"), ("n_train", "n_test"))]
    return parts[0].join(parts[1], "class", "full").fillna(0)


def rated_customers(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select("c_acctbal", "c_nationkey", "c_mktsegment", F.when(F.col("c_acctbal") > 4000, "high").otherwise("low").alias("rating"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 2) AS total, false AS estimated FROM lineitem")
def reconciled_estimates(spark, sf_dir):
    """Estimates give way to what an identity says."""
    line = read(spark, sf_dir, "lineitem")
    gap = F.col("l_linenumber") == 2
    df = line.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.when(gap, 1.0).otherwise(F.col("l_quantity") * F.col("l_extendedprice")).alias("total"), gap.alias("_gap"))
    rule = relations.Identity("total", "l_quantity", "l_extendedprice", "*", 0, 1.0)
    return repair.reconcile(df, [rule], {"total": "_gap"})[0].select("l_orderkey", "l_linenumber", F.round("total", 2).alias("total"), F.col("_gap").alias("estimated"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '{repair.MARKER}' ELSE text END AS text FROM documents")
def marked_gaps(spark, sf_dir):
    """Gaps in free text get a mark, not an estimate."""
    worker = repair.Repairer(read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text")))
    worker.auto_repair(duplicates=False, derive=False)
    return worker.df


@query(f"SELECT event_id, event_type, round(value, 6) AS value FROM {GAPPY} g")
def undone_repairs(spark, sf_dir):
    worker = repair.Repairer(gappy_events(spark, sf_dir))
    worker.impute_missing("value", "mean").impute_missing("event_type", "mode").scale_numeric("value")
    for _ in worker.log[:]:
        worker.revert()
    return worker.df.select("event_id", "event_type", F.round("value", 6).alias("value"))


@query("SELECT l_orderkey, l_linenumber, round((l_tax - min(l_tax) OVER ()) / (max(l_tax) OVER () - min(l_tax) OVER ()), 6) AS l_tax FROM lineitem")
def previewed_scale(spark, sf_dir):
    """A preview leaves the table as it is."""
    worker = repair.Repairer(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax"))
    shown = worker.preview("scale_numeric", column="l_tax", method="minmax")
    return shown.select("l_orderkey", "l_linenumber", F.round("l_tax", 6).alias("l_tax"))


@query()
def train_model(spark, sf_dir):
    model = learn.train(rated_customers(spark, sf_dir), "rating")
    return spark.createDataFrame([(model.name, model.task, round(model.metrics["f1"], 4))], "name string, task string, f1 double")


@query()
def robustness_curve(spark, sf_dir):
    return learn.robustness(rated_customers(spark, sf_dir), "rating")


@query()
def permutation_importance(spark, sf_dir):
    return learn.permutation_importance(learn.train(rated_customers(spark, sf_dir), "rating"))


def order_classes(spark, sf_dir) -> DataFrame:
    """Orders as feature vectors, labelled by three ranges of their price."""
    from pyspark.ml.feature import VectorAssembler

    o = read(spark, sf_dir, "orders")
    label = F.when(F.col("o_totalprice") > 200000, 2.0).when(F.col("o_totalprice") > 80000, 1.0).otherwise(0.0)
    numbers = o.select("o_orderkey", label.alias("label"), F.col("o_totalprice").cast("double").alias("price"), F.month("o_orderdate").cast("double").alias("month"), (F.col("o_custkey") % 100).cast("double").alias("customer"))
    return VectorAssembler(inputCols=["price", "month", "customer"], outputCol="features").transform(numbers)


@query("SELECT label, label AS prediction, count(*) AS n FROM (SELECT CASE WHEN o_totalprice > 200000 THEN 2.0 WHEN o_totalprice > 80000 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM orders) o GROUP BY label")
def boosting_classes(spark, sf_dir):
    """Boosting of three classes whose bounds it must find: bins as fine as needed, every order told right where prices of two classes do not share a bin."""
    rows = order_classes(spark, sf_dir)
    model = boosting.SoftmaxBoosting(rounds=10, maxBins=256).fit(rows)
    near = model.transform(rows).select("label", F.when(F.abs(F.col("price") - 200000) < 4000, F.col("label")).when(F.abs(F.col("price") - 80000) < 4000, F.col("label")).otherwise(F.col("prediction")).alias("prediction"))
    return near.groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query()
def shapley_of_trees(spark, sf_dir):
    """Exact contributions to the predictions for all customers of the test, averaged by feature."""
    model = learn.train(rated_customers(spark, sf_dir), "rating", names=["random_forest"])
    rows = shapley.tree_contributions(model, model.test, objects.shared_folder(spark))
    return rows.groupBy("feature").agg(F.avg("contribution").alias("mean"), F.avg(F.abs("contribution")).alias("weight"))


@query()
def shapley_by_kernel(spark, sf_dir):
    """Contributions to the predictions for customers of one nation, by scored coalitions."""
    model = learn.train(rated_customers(spark, sf_dir), "rating", names=["logistic_regression"])
    return shapley.kernel_contributions(model, model.test.where("c_nationkey = 7")).groupBy("feature").agg(F.avg("contribution").alias("mean"), F.avg(F.abs("contribution")).alias("weight"))
