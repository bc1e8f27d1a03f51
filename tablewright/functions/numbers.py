"""Column expressions over numbers; all run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def fields_of(df: DataFrame, *kinds) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return fields_of(df, *NUMERIC)


def text_columns(df: DataFrame) -> list[str]:
    return fields_of(df, T.StringType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its literal name, dots and back-ticks included."""
    return F.col(quoted(name))


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN marks a gap as null does; only null is kept."""
    floats = set(fields_of(df, T.FloatType, T.DoubleType))
    return df.select(*[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns])


def sample_skewness(x: Column) -> Column:
    """Bias-corrected; null below three values or without spread."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values or without spread."""
    n = F.count(x).cast("double")
    return F.when(n >= 4, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(x) + 6))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r over the rows that have both; null without spread."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def is_close(computed: Column, recorded: Column, relative: float = 1e-6, absolute: float = 1e-9) -> Column:
    return F.abs(computed - recorded) <= F.lit(absolute) + F.abs(recorded) * relative


#: Bits of a draw.
DRAW_BITS = 60


def drawn(*parts: Column) -> Column:
    """A number of DRAW_BITS random bits that depends on the parts alone, not on partitions; the head of their md5, so that any engine can repeat it."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("long")


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return drawn(*parts) / float(1 << DRAW_BITS)


def hashed_normal(*parts: Column) -> Column:
    """A standard normal number that depends on the parts alone."""
    u, v = hashed_uniform(*parts, F.lit("u")), hashed_uniform(*parts, F.lit("v"))
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(v * 6.283185307179586)
