"""Drift of a stream against a stored reference: bins stay, counts are kept as streaming state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import col
from ..operators.drift import bin_of, contributions, quantile_edges


class StreamingDrift:
    """PSI of a numeric column, window by window of event time."""

    def __init__(self, reference: DataFrame, column: str, bins: int = 10):
        self.column = column
        self.inner = quantile_edges(reference, column, bins)
        x = col(column).cast("double")
        self.reference = {r.value: r.n for r in reference.where(x.isNotNull()).groupBy(bin_of(x, self.inner).alias("value")).agg(F.count("*").alias("n")).collect()}  # a row for each bin

    def counts(self, stream: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
        """window, value (bin) and n; rows later than ``late`` are left out."""
        x = col(self.column).cast("double")
        return stream.where(x.isNotNull()).withWatermark(time, late).groupBy(F.window(time, window).alias("window"), bin_of(x, self.inner).alias("value")).agg(F.count("*").alias("n"))

    def psi(self, counts: DataFrame) -> float:
        """PSI of one window's counts (value, n)."""
        spark = counts.sparkSession
        bins = spark.createDataFrame([(b, self.reference.get(b, 0)) for b in range(len(self.inner) + 1)], "value int, n_ref long")
        both = bins.join(counts.select("value", F.col("n").alias("n_cur")), "value", "left").fillna(0)
        return contributions(both).agg(F.sum("contribution")).first()[0]
