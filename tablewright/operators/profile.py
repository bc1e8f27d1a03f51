"""Statistics of all columns in a fixed number of passes, however many columns there are."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import NUMERIC, TEMPORAL, col, correlation, numeric_columns, sample_kurtosis, sample_skewness, text_columns
from ..functions.texts import FREE_TEXT_CHARS, FREE_TEXT_WORDS, IDENTIFIER_ROWS, IDENTIFIER_SHARE, timestamp_of, word_count
from .gram import correlations
from .quantiles import exact_quantiles

#: Most columns whose pairs are expressions of one aggregate.
WIDE = 24


#: Bytes of a value of the types of fixed width.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def value_bytes(df: DataFrame) -> DataFrame:
    """column and bytes of its values, nulls without any, in one aggregate.

    Texts count their UTF-8 bytes, decimals 16 and nested values the bytes of their JSON.
    """
    def size(f: T.StructField):
        kind, c = f.dataType.simpleString(), col(f.name)
        if isinstance(f.dataType, T.DecimalType) or kind in WIDTHS:
            return F.count(c) * WIDTHS.get(kind, 16)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.when(c.isNotNull(), F.to_json(c))
        elif not isinstance(f.dataType, (T.StringType, T.BinaryType)):
            c = c.cast("string")
        return F.coalesce(F.sum(F.octet_length(c)), F.lit(0))

    one = df.agg(*[size(f).cast("bigint").alias(f"b{i}") for i, f in enumerate(df.schema.fields)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("bytes")) for i, c in enumerate(df.columns)])
    return one.select(F.inline(cells))


def value_counts(df: DataFrame, columns: list[str] | None = None, places: bool = False) -> DataFrame:
    """column, value (as text) and n, without nulls: one pass and one shuffle for all columns, summed before it.

    With ``places`` the first column is ``place``, that of the column in ``columns``; by a number, Spark sorts in linear time.
    """
    columns = columns or df.columns
    cells = F.array(*[F.struct(F.lit(i).alias("place"), col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    counts = df.select(F.explode(cells).alias("cell")).select("cell.*").where(F.col("value").isNotNull()).groupBy("place", "value").agg(F.count("*").alias("n"))
    return counts if places else counts.select(F.get(F.array(*map(F.lit, columns)), F.col("place")).alias("column"), "value", "n")


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column and its number of distinct values, for columns that have any; one shuffle of numbers of fixed width.

    Hashes of 64 bits tell values of up to 64 bits apart, as each stands for one
    value; longer ones, texts among them, are told apart by 128 bits.
    """
    columns = columns or df.columns
    short = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)

    def key(i: int, c: str):
        kind = df.schema[c].dataType
        x = col(c) if isinstance(kind, short) else col(c).cast("string")
        more = F.lit(0).cast("bigint") if isinstance(kind, short) else F.xxhash64(F.lit(i), x)
        return F.when(x.isNotNull(), F.struct(F.lit(i).alias("place"), F.xxhash64(x).alias("one"), more.alias("two")))

    cells = F.explode(F.array(*[key(i, c) for i, c in enumerate(columns)])).alias("c")
    counted = df.select(cells).where("c IS NOT NULL").select("c.*").distinct().groupBy("place").agg(F.count("*").alias("distinct"))
    return counted.select(F.get(F.array(*map(F.lit, columns)), F.col("place")).alias("column"), "distinct")


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 1) -> DataFrame:
    """The k most frequent values of each column, equal ones by value.

    ``max_by`` style aggregation keeps k structs for each column, so columns of
    high cardinality are not sorted in one task.
    """
    counts = value_counts(df, columns)
    if k == 1:
        best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("b"))
        return best.select("column", F.lit(1).alias("rank"), F.col("b.value").alias("value"), (-F.col("b.m")).alias("n"))
    buckets = counts.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(64)))
    order = [F.col("n").desc(), F.col("value")]
    local = buckets.withColumn("r", F.row_number().over(Window.partitionBy("column", "part").orderBy(*order))).where(F.col("r") <= k)
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("column", "rank", "value", "n")


def null_counts(df: DataFrame) -> DataFrame:
    """column, rows, nulls and null_pct (two decimals), in one aggregate."""
    one = df.agg(F.count("*").alias("_rows"), *[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)])
    share = F.col("c.nulls") * 100.0 / F.nullif(F.col("_rows"), F.lit(0))
    return one.select("_rows", F.explode(cells).alias("c")).select("c.column", F.col("_rows").alias("rows"), "c.nulls", F.bround(F.coalesce(share, F.lit(0.0)), 2).alias("null_pct"))


def numeric_moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n, mean, std, min, max, skewness and kurtosis of the numeric columns, in one aggregate."""
    columns = columns or numeric_columns(df)
    measures = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "skewness": sample_skewness, "kurtosis": sample_kurtosis}
    kinds = {"n": "bigint"}
    one = df.agg(*[F.struct(*[f(col(c).cast("double")).cast(kinds.get(m, "double")).alias(m) for m, f in measures.items()]).alias(f"m{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("m")) for i, c in enumerate(columns)])
    return one.select(F.explode(cells).alias("c")).select("c.column", "c.m.*")


def column_stats(df: DataFrame) -> DataFrame:
    """One row for each column: type, rows, nulls, distinct values, and the four-decimal moments of numbers."""
    kinds = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)], "position int, column string, dtype string")
    out = kinds.join(null_counts(df), "column", "left").join(distinct_counts(df), "column", "left")
    numbers = numeric_columns(df)
    if numbers:
        moments = numeric_moments(df, numbers).select("column", *[F.bround(m, 4).alias(m) for m in ("mean", "std", "min", "max")])
        out = out.join(moments, "column", "left")
    return out.withColumn("distinct", F.coalesce("distinct", F.lit(0)))


def duplicate_count(df: DataFrame) -> DataFrame:
    """rows, distinct_rows and duplicates (rows after the first of their kind)."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows")).withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))


def duplicate_columns(df: DataFrame) -> DataFrame:
    """Pairs of columns of one type that are equal in every row (null equals null).

    A sum of value hashes of all columns in one pass leaves few pairs; these are compared value by value in a second.
    """
    sums = df.agg(*[F.sum(F.coalesce(F.xxhash64(col(c)), F.lit(0)).cast("decimal(20,0)")).alias(f"s{i}") for i, c in enumerate(df.columns)], *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    kinds = [f.dataType for f in df.schema.fields]
    pairs = [(i, j) for i, j in combinations(range(len(df.columns)), 2) if kinds[i] == kinds[j] and sums[f"s{i}"] == sums[f"s{j}"] and sums[f"c{i}"] == sums[f"c{j}"]]
    schema = "left_column string, right_column string"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    same = df.agg(*[F.coalesce(F.bool_and(col(df.columns[i]).eqNullSafe(col(df.columns[j]))), F.lit(True)).alias(f"p{k}") for k, (i, j) in enumerate(pairs)]).first()
    return df.sparkSession.createDataFrame([(df.columns[i], df.columns[j]) for k, (i, j) in enumerate(pairs) if same[k]], schema)


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """left_column, right_column and r of each pair of numeric columns, in one pass; NaN counts as a gap.

    Few columns are one aggregate; more, whose pairs would be too many expressions, are sums of matrices.
    """
    columns = columns or numeric_columns(df)
    if len(columns) > WIDE:
        return correlations(df, columns)
    df = df.select(*[F.nanvl(col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "left_column string, right_column string, r double")
    one = df.agg(*[correlation(col(a), col(b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def iqr_bounds(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, q1, q3, lower and upper (1.5 times the quartiles' distance beyond them)."""
    columns = columns or numeric_columns(df)
    found = exact_quantiles(df, {c: col(c) for c in columns}, [0.25, 0.75])
    quarters = df.sparkSession.createDataFrame([(c, *(found[c] or [None, None])) for c in columns], "column string, q1 double, q3 double")
    spread = (F.col("q3") - F.col("q1")) * 1.5
    return quarters.withColumn("lower", F.col("q1") - spread).withColumn("upper", F.col("q3") + spread)


def iqr_outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, outliers (strictly outside the bounds) and their percentage of all rows."""
    columns = columns or numeric_columns(df)
    bounds = {r["column"]: r for r in iqr_bounds(df, columns).collect()}  # a row for each column
    counts = []
    for i, c in enumerate(columns):
        b = bounds[c]
        outside = F.lit(False) if b.lower is None else (col(c) < b.lower) | (col(c) > b.upper)
        counts.append(F.count_if(outside).alias(f"o{i}"))
    one = df.agg(F.count("*").alias("_rows"), *counts)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"o{i}").alias("outliers")) for i, c in enumerate(columns)])
    return one.select("_rows", F.explode(cells).alias("c")).select("c.column", "c.outliers", F.bround(F.col("c.outliers") * 100.0 / F.nullif("_rows", F.lit(0)), 4).alias("outlier_pct"))


def text_roles(df: DataFrame) -> DataFrame:
    """column, mean_words, mean_chars, non_null, distinct and role (free_text, identifier or categorical) of text columns."""
    columns = text_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, mean_words double, mean_chars double, non_null long, distinct long, role string")
    one = df.agg(*[F.struct(F.avg(word_count(col(c))).alias("mean_words"), F.avg(F.length(col(c))).alias("mean_chars"), F.count(col(c)).alias("non_null")).alias(f"t{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"t{i}").alias("t")) for i, c in enumerate(columns)])
    sizes = one.select(F.explode(cells).alias("c")).select("c.column", "c.t.*").join(distinct_counts(df, columns), "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    role = (
        F.when(F.col("non_null") == 0, "categorical")
        .when((F.col("mean_words") >= FREE_TEXT_WORDS) | (F.col("mean_chars") >= FREE_TEXT_CHARS), "free_text")
        .when((F.col("non_null") >= IDENTIFIER_ROWS) & (F.col("distinct") >= IDENTIFIER_SHARE * F.col("non_null")), "identifier")
        .otherwise("categorical")
    )
    return sizes.withColumn("role", role)


def overview(df: DataFrame) -> DataFrame:
    """One row for each column: type, distinct values and gaps as numbers and shares of the rows, and uniqueness."""
    s = column_stats(df)
    held = F.col("rows") - F.col("nulls")
    share = lambda c: F.coalesce(F.try_divide(c, F.col("rows")), F.lit(0.0))
    return s.select("position", "column", "dtype", "rows", F.col("distinct").alias("n_distinct"), share(F.col("distinct")).alias("p_distinct"), F.col("nulls").alias("n_missing"), share(F.col("nulls")).alias("p_missing"), ((held > 0) & (F.col("distinct") == held)).alias("is_unique"))


# --- Facts: what the rule-based operators need, gathered once -------------------------------------


@dataclass
class ColumnFacts:
    name: str
    dtype: str
    numeric: bool
    temporal: bool
    text: bool
    boolean: bool
    nulls: int = 0
    null_pct: float = 0.0
    distinct: int = 0
    mean: float | None = None
    std: float | None = None
    min: float | None = None
    max: float | None = None
    skewness: float | None = None
    kurtosis: float | None = None
    outliers: int = 0
    outlier_pct: float = 0.0
    top: str | None = None
    top_n: int = 0
    role: str = "non_text"
    blanks: int = 0
    classes: int = 0  # lexical classes among the values of a text column
    dates: bool = False  # all values of a text column read as dates
    category: str = "unknown"


@dataclass
class Facts:
    rows: int
    duplicates: int
    columns: dict[str, ColumnFacts]
    correlations: dict[tuple[str, str], float] = field(default_factory=dict)

    def numeric(self) -> list[ColumnFacts]:
        return [c for c in self.columns.values() if c.numeric]


def lexical_class(text):
    """int, float, bool or text."""
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), "int").when(text.rlike(r"^\s*[+-]?(\d+\.\d*|\.\d+)\s*$"), "float").when(F.lower(F.trim(text)).isin("true", "false"), "bool").otherwise("text")


def category_of(c: ColumnFacts, rows: int) -> str:
    """The semantic type, by the first rule that holds."""
    if c.distinct <= 1 and c.nulls < rows:
        return "constant"
    if c.boolean:
        return "boolean"
    if c.numeric:
        return "binary" if c.distinct == 2 else "numeric"
    if c.temporal:
        return "datetime"
    if c.nulls >= rows:
        return "unknown"
    if c.classes > 2:
        return "mixed"
    if c.dates:
        return "datetime"
    return "high_cardinality" if c.distinct > 100 else "text"


def _distinct_and_top(counts: DataFrame, columns: list[str]) -> list[tuple]:
    """Name, number of values and most frequent value of each column that has any, of counts by place.

    Spark sorts its rows to group such values.  Few columns are expressions of one aggregate without groups, which is not sorted.
    """
    best = F.struct((-F.col("n")).alias("m"), "value")
    if len(columns) > WIDE:
        return [(columns[r.place], r.d, r.b) for r in counts.groupBy("place").agg(F.count("*").alias("d"), F.min(best).alias("b")).collect()]
    here = [F.col("place") == i for i in range(len(columns))]
    one = counts.agg(*[F.struct(F.count_if(x).alias("d"), F.min(F.when(x, best)).alias("b")).alias(f"c{i}") for i, x in enumerate(here)]).first()
    return [(c, r.d, r.b) for c, r in zip(columns, one) if r.d]


def gather_facts(df: DataFrame) -> Facts:
    """Everything that rules over columns ask for; only a few numbers for each column come to the driver."""
    facts = {f.name: ColumnFacts(f.name, f.dataType.simpleString(), isinstance(f.dataType, NUMERIC), isinstance(f.dataType, TEMPORAL), isinstance(f.dataType, T.StringType), isinstance(f.dataType, T.BooleanType)) for f in df.schema.fields}
    rows = 0
    for r in null_counts(df).collect():
        rows = r.rows
        facts[r["column"]].nulls, facts[r["column"]].null_pct = r.nulls, r.null_pct
    simple = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    counted = simple or df.columns
    for name, d, top in _distinct_and_top(value_counts(df, simple, places=True), counted):
        facts[name].distinct, facts[name].top, facts[name].top_n = d, top.value, -top.m
    numbers = numeric_columns(df)
    if numbers and rows:
        for r in numeric_moments(df, numbers).collect():
            c = facts[r["column"]]
            c.mean, c.std, c.min, c.max, c.skewness, c.kurtosis = r["mean"], r["std"], r["min"], r["max"], r["skewness"], r["kurtosis"]
        for r in iqr_outliers(df, numbers).collect():
            facts[r["column"]].outliers, facts[r["column"]].outlier_pct = r.outliers, r.outlier_pct
    texts = text_columns(df)
    if texts and rows:
        for r in text_roles(df).collect():
            facts[r["column"]].role = r["role"]
        found = df.agg(*[F.struct(F.count_if(col(c).rlike(r"^\s+$")).alias("blanks"), F.count_distinct(lexical_class(col(c))).alias("classes"), (F.count_if(col(c).isNotNull() & timestamp_of(col(c)).isNull()) == 0).alias("dates")).alias(f"x{i}") for i, c in enumerate(texts)]).first()
        for i, c in enumerate(texts):
            facts[c].blanks, facts[c].classes, facts[c].dates = found[i].blanks, found[i].classes, found[i].dates
    varied = [c for c in numbers if facts[c].distinct > 1]
    pairs = {(r.left_column, r.right_column): r.r for r in correlation_matrix(df, varied).collect()} if rows and len(varied) > 1 else {}
    for c in facts.values():
        c.category = category_of(c, rows)
    duplicates = duplicate_count(df.select(*[col(c) for c in simple])).first().duplicates if simple else 0
    return Facts(rows, duplicates, facts, pairs)
