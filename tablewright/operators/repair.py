"""Repairs as new plans on a stack: each step can be undone, nothing is copied."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import INTEGRAL, NUMERIC, TEMPORAL, col, is_close
from ..functions.texts import number_of, timestamp_of
from .clean import PARSED_SHARE, residual_sentinels
from .profile import duplicate_count, text_roles
from .quantiles import exact_quantiles
from .relations import Identity, discover, fill

MARKER = "(missing)"


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def fill_value(df: DataFrame, column: str, strategy: str, constant=None):
    """The value that a strategy puts in a column's gaps, and the strategy that was used in the end."""
    kind, c = df.schema[column].dataType, col(column)
    if strategy == "constant":
        return cast_constant(constant, kind), strategy
    if strategy not in ("mean", "median", "mode"):
        raise ValueError(f"no strategy '{strategy}'")
    if strategy != "mode":
        if isinstance(kind, TEMPORAL):
            micros = F.unix_micros(c.cast("timestamp"))
            stat = (F.avg(micros) if strategy == "mean" else F.median(micros)).cast("bigint")
            return df.agg(F.timestamp_micros(stat).cast(kind)).first()[0], strategy
        if isinstance(kind, NUMERIC):
            if strategy == "median":
                middle = exact_quantiles(df, {column: c}, [0.5])[column]
                if not middle:
                    return None, strategy
                return (round(middle[0]) if isinstance(kind, INTEGRAL) else middle[0]), strategy
            stat = F.avg(c)
            return df.agg((F.bround(stat, 0).cast(kind) if isinstance(kind, INTEGRAL) else stat.cast(kind))).first()[0], strategy
        if isinstance(kind, T.StringType):
            f = df.agg(F.count(c).alias("held"), F.count(number_of(c)).alias("parsed"), (F.avg if strategy == "mean" else F.median)(number_of(c)).alias("v")).first()
            if f.held and f.parsed >= PARSED_SHARE * f.held:
                return f.v, strategy
    return df.agg(F.mode(c, True)).first()[0], "mode"


def cast_constant(value, kind: T.DataType):
    if value is None or (isinstance(value, str) and not value.strip()):
        raise ValueError("the constant is blank")
    if isinstance(kind, NUMERIC):
        number = float(value)
        return round(number) if isinstance(kind, INTEGRAL) else number
    if isinstance(kind, TEMPORAL) and isinstance(value, str):
        spark = SparkSession.active()
        read = spark.range(1).select(timestamp_of(F.lit(value)).cast(kind)).first()[0]
        if read is None:
            raise ValueError(f"'{value}' is no date")
        return read
    return value if not isinstance(kind, T.StringType) else str(value)


def impute(df: DataFrame, column: str, strategy: str = "median", constant=None) -> DataFrame:
    value, used = fill_value(df, column, strategy, constant)
    if value is None:
        raise ValueError(f"'{column}' has nothing to impute from")
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType) and isinstance(value, float):
        return df.withColumn(column, F.coalesce(number_of(col(column)), F.lit(value)))
    return df.withColumn(column, F.coalesce(col(column), F.lit(value).cast(kind)))


def coerced(c: Column, target: str) -> Column:
    """A column in another type; what cannot be read becomes null."""
    if target == "int":
        return F.bround(c.try_cast("double"), 0).try_cast("bigint")
    if target == "float":
        return c.try_cast("double")
    if target == "datetime":
        return timestamp_of(c.cast("string"))
    if target == "str":
        return c.cast("string")
    raise ValueError(f"no type '{target}'")


def coerce(df: DataFrame, column: str, target: str) -> tuple[DataFrame, int]:
    """The table, and how many values were lost."""
    new = coerced(col(column), target)
    lost = df.agg(F.count(col(column)) - F.count(new)).first()[0]
    return df.withColumn(column, new), lost


def scale(df: DataFrame, column: str, method: str = "standard") -> DataFrame:
    """Standard or min-max scaling; the fit sees gaps as the mean, and gaps stay gaps."""
    x = col(column).cast("double")
    f = df.agg(F.avg(x).alias("mean"), F.count("*").alias("rows"), F.count(x).alias("held"), F.var_pop(x).alias("var"), F.min(x).alias("least"), F.max(x).alias("most")).first()
    if f.mean is None:
        return df.withColumn(column, x)
    if method == "standard":
        sigma = (f["var"] * f.held / f.rows) ** 0.5
        return df.withColumn(column, (x - f.mean) / sigma if sigma else F.when(x.isNotNull(), 0.0))
    if method == "minmax":
        return df.withColumn(column, (x - f.least) / (f.most - f.least) if f.most > f.least else F.when(x.isNotNull(), 0.0))
    raise ValueError(f"no method '{method}'")


def drop_constant(df: DataFrame) -> DataFrame:
    f = df.agg(*[(F.count(col(c)) == 0).alias(f"e{i}") for i, c in enumerate(df.columns)], *[F.min(col(c).cast("string")).eqNullSafe(F.max(col(c).cast("string"))).alias(f"s{i}") for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if f[f"e{i}"] or f[f"s{i}"]])


def group_rare(df: DataFrame, column: str, threshold: float = 0.01, other: str = "Other") -> DataFrame:
    """Categories with less than a share of the values become one; gaps stay."""
    c = col(column)
    counts = df.where(c.isNotNull()).groupBy(c.alias("_v")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    common = counts.where(F.col("_n") >= threshold * total).select("_v", F.lit(True).alias("_common"))  # at most 1 / threshold rows
    joined = df.join(F.broadcast(common), c.cast("string") == F.col("_v").cast("string"), "left")
    return joined.withColumn(column, F.when(c.isNull() | F.col("_common"), c.cast("string")).otherwise(other)).select(*[col(x) for x in df.columns])


def clamp(df: DataFrame, column: str, method: str = "iqr") -> DataFrame:
    """Pull outliers to the bounds of 1.5 interquartile ranges, or of three standard deviations."""
    x = col(column).cast("double")
    if method == "iqr":
        q1, q3 = exact_quantiles(df, {column: x}, [0.25, 0.75])[column] or (None, None)
        bounds = None if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    elif method == "zscore":
        f = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
        bounds = None if f.s is None else (f.m - 3 * f.s, f.m + 3 * f.s)
    else:
        raise ValueError(f"no method '{method}'")
    return df if bounds is None else df.withColumn(column, F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(bounds[1])), F.lit(bounds[0]))))


def encode(df: DataFrame, column: str) -> DataFrame:
    """Codes of the categories in sorted order; gaps stay.

    Codes come from a sorted zipWithIndex-like numbering: range partitions are
    counted, then numbered on, so categories are not sorted in one task.
    """
    from .mutate import numbered

    values = df.where(col(column).isNotNull()).select(col(column).cast("string").alias("_v")).distinct()
    codes = numbered(values, "_v", "_code")
    joined = df.join(codes, col(column).cast("string") == F.col("_v"), "left")
    return joined.withColumn(column, F.col("_code")).select(*[col(x) for x in df.columns])


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(col(target).isNotNull())


def verify(df: DataFrame, target: str | None = None) -> dict:
    """What is left to repair: gaps, duplicates, tokens that may stand for a gap, rows without a label."""
    gaps = df.agg(*[F.count_if(col(c).isNull()).alias(f"g{i}") for i, c in enumerate(df.columns)]).first()
    left = {c: gaps[i] for i, c in enumerate(df.columns) if gaps[i]}
    tokens = {r["column"]: r["n"] for r in residual_sentinels(df).collect()}
    out = {"missing": left, "duplicates": duplicate_count(df).first().duplicates, "sentinels": tokens, "target_missing": left.get(target, 0) if target else 0}
    return out | {"clean": not (left or out["duplicates"] or tokens)}


@dataclass
class AutoRepair:
    rows_before: int = 0
    rows_after: int = 0
    duplicates_removed: int = 0
    target_rows_dropped: int = 0
    dropped: list[str] = field(default_factory=list)
    imputed: dict[str, dict] = field(default_factory=dict)
    marked: dict[str, str] = field(default_factory=dict)
    relationships: list[Identity] = field(default_factory=list)
    derived: list[dict] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)


class Repairer:
    """A table under repair: the current plan, those before it, and a log."""

    def __init__(self, df: DataFrame):
        self.stack, self.log = [df], []

    @property
    def df(self) -> DataFrame:
        return self.stack[-1]

    def _commit(self, action: str, df: DataFrame, **detail) -> Repairer:
        self.stack.append(df)
        self.log.append({"action": action, **detail})
        return self

    def revert(self) -> Repairer:
        if len(self.stack) > 1:
            self.stack.pop()
            self.log.pop()
        return self

    def preview(self, name: str, **arguments) -> DataFrame:
        other = Repairer(self.df)
        getattr(other, name)(**arguments)
        return other.df

    def remove_duplicates(self):
        n = duplicate_count(self.df).first().duplicates
        return self._commit("remove_duplicates", drop_duplicates(self.df), removed=n) if n else self

    def impute_missing(self, column: str, strategy: str = "median", fill=None):
        return self._commit("impute_missing", impute(self.df, column, strategy, fill), column=column, strategy=strategy)

    def coerce_types(self, column: str, target_type: str):
        df, lost = coerce(self.df, column, target_type)
        return self._commit("coerce_types", df, column=column, target=target_type, lost=lost)

    def scale_numeric(self, column: str, method: str = "standard"):
        return self._commit("scale_numeric", scale(self.df, column, method), column=column, method=method)

    def drop_constant_columns(self):
        return self._commit("drop_constant_columns", drop_constant(self.df))

    def handle_rare_categories(self, column: str, threshold: float = 0.01):
        return self._commit("handle_rare_categories", group_rare(self.df, column, threshold), column=column, threshold=threshold)

    def clamp_outliers(self, column: str, method: str = "iqr"):
        return self._commit("clamp_outliers", clamp(self.df, column, method), column=column, method=method)

    def encode_categorical(self, column: str):
        return self._commit("encode_categorical", encode(self.df, column), column=column)

    def drop_missing_target_rows(self, target: str):
        return self._commit("drop_missing_target_rows", drop_missing_target(self.df, target), target=target)

    def auto_repair(self, target: str | None = None, numeric: str = "median", categorical: str = "mode", duplicates: bool = True, empty_columns: bool = True, derive: bool = True) -> AutoRepair:
        """Empty columns, duplicates, rows without a label, identities, then markers and estimates, then identities again."""
        done, df = AutoRepair(rows_before=self.df.count()), self.df
        if empty_columns:
            held = df.agg(*[F.count(col(c)).alias(f"h{i}") for i, c in enumerate(df.columns)]).first()
            done.dropped = [c for i, c in enumerate(df.columns) if not held[i]]
            df = df.drop(*done.dropped)
        if duplicates:
            done.duplicates_removed = duplicate_count(df).first().duplicates
            df = drop_duplicates(df) if done.duplicates_removed else df
        if target and target in df.columns:
            done.target_rows_dropped = df.agg(F.count_if(col(target).isNull())).first()[0]
            df = drop_missing_target(df, target)
        if derive:
            done.relationships = [r for r in discover(df) if target not in (r.target, r.left, r.right)]
            df, done.derived = fill(df, done.relationships)
        columns = list(df.columns)
        touched = {c for r in done.relationships for c in (r.target, r.left, r.right)}
        flags = {c: f"_gap_{i}" for i, c in enumerate(columns) if c in touched}
        df = df.select("*", *[col(c).isNull().alias(f) for c, f in flags.items()])
        gaps = df.agg(*[F.count_if(col(c).isNull()).alias(f"g{i}") for i, c in enumerate(columns)]).first()
        roles = {r["column"]: r["role"] for r in text_roles(df.select(*[col(c) for c in columns])).collect()}
        for i, c in enumerate(columns):
            if c == target or not gaps[i]:
                continue
            kind = df.schema[c].dataType
            if roles.get(c) in ("free_text", "identifier"):
                df = df.withColumn(c, F.coalesce(col(c), F.lit(MARKER)))
                done.marked[c] = roles[c]
                continue
            value, used = fill_value(df, c, numeric if isinstance(kind, NUMERIC) else categorical)
            if value is None:
                done.skipped.append(c)
                continue
            df = df.withColumn(c, F.coalesce(col(c), F.lit(value).cast(kind)))
            done.imputed[c] = {"strategy": used, "fill_value": value, "cells_filled": gaps[i]}
        df, again = reconcile(df, done.relationships, flags)
        done.derived += again
        df = df.select(*[col(c) for c in columns])
        done.rows_after = df.count()
        self._commit("auto_repair", df, result=done)
        return done

    def manifest(self, target: str | None = None) -> dict:
        check = verify(self.df, target)
        return {"steps": [{k: v for k, v in entry.items() if k != "result"} for entry in self.log], "columns": self.df.columns, "verification": check}


def reconcile(df: DataFrame, rules: list[Identity], flags: dict[str, str]) -> tuple[DataFrame, list[dict]]:
    """Cells that were estimated and that an identity now determines take the computed value."""
    records = []
    for rule in rules:
        for column in (rule.target, rule.left, rule.right):
            if column not in flags:
                continue
            kind = df.schema[column].dataType
            value = rule.solutions()[column]
            whole = F.abs(value - F.round(value)) <= 1e-6 if isinstance(kind, INTEGRAL) else F.lit(True)
            wrong = F.col(flags[column]) & value.isNotNull() & whole & ~is_close(value, col(column).cast("double"))
            n = df.agg(F.count_if(wrong)).first()[0]
            if n:
                # Both at once: the flag is judged by the value that was there.
                df = df.withColumns({column: F.when(wrong, F.round(value) if isinstance(kind, INTEGRAL) else value).otherwise(col(column)).cast(kind), flags[column]: F.col(flags[column]) & ~F.coalesce(wrong, F.lit(False))})
                records.append({"column": column, "expression": rule.expression, "cells_filled": n, "method": "reconciled"})
    return df, records
