"""Correlations of very many columns in one pass.

For each pair of columns only rows that have both count, so besides the sums of
products the sums of one column over the other's rows are needed.  With a matrix
X of the values, gaps as zeros, and a mask M of what is there, all of them are
six matrix products of X, its squares and M.  Tasks add these up over their rows,
a block of columns against all columns; blocks meet by their number.  Values are
centred and scaled first, so that the sums keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import col

#: Columns of a block, rows that are multiplied at a time, and bytes of sums that a task holds; more columns take several passes.
BLOCK, SLICE, MOST_BYTES = 64, 2048, 1 << 28
#: Expressions in one aggregate.
TOGETHER = 500


def _scales(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A value in the middle of each column and a width, from its mean and spread."""
    found = []
    for start in range(0, len(columns), TOGETHER):
        some = columns[start : start + TOGETHER]
        found += df.agg(*[F.struct(F.avg(col(c)).alias("m"), F.stddev_pop(col(c)).alias("s")).alias(f"c{i}") for i, c in enumerate(some)]).first()
    good = lambda x, other: x if x is not None and np.isfinite(x) else other
    return np.array([good(f.m, 0.0) for f in found]), np.array([good(f.s, 1.0) or 1.0 for f in found])


def _products(x: np.ndarray, first: int, last: int) -> np.ndarray:
    """Pairs, both sums, both sums of squares and products, of the columns from ``first`` to ``last`` with all columns."""
    held = ~np.isnan(x)
    x, m = np.where(held, x, 0.0), held.astype(float)
    a, am, squares = x[:, first:last].T, m[:, first:last].T, x * x
    return np.stack([am @ m, a @ m, am @ x, squares[:, first:last].T @ m, am @ squares, a @ x])


def _correlations(sums: np.ndarray) -> np.ndarray:
    n, sx, sy, sxx, syy, sxy = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy, both = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
        # What is left of a constant is rounding.
        least = 8 * np.finfo(float).eps * np.maximum(n, 1)
        r = both / np.sqrt(vx * vy)
        r[(vx <= least * sxx) | (vy <= least * syy) | (n < 1)] = np.nan
    return np.clip(r, -1.0, 1.0)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """left_column, right_column and r of each pair, in the columns' order; null without spread.  NaN counts as a gap."""
    spark, count = df.sparkSession, len(columns)
    table = df.select(*[F.nanvl(col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    middle, width = _scales(table, table.columns)
    blocks = [(s, min(s + BLOCK, count)) for s in range(0, count, BLOCK)]
    at_once = max(1, MOST_BYTES // (6 * 8 * BLOCK * count))
    schema = "left_column string, right_column string, r double"
    every = spark.createDataFrame([], schema)

    def partial(mine: list[tuple[int, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {b: np.zeros((6, b[1] - b[0], count)) for b in mine}
            rows = 0
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE):
                    part = batch.slice(start, SLICE)
                    x = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns], 1).astype(float)
                    x = (x - middle) / width
                    rows += len(x)
                    for b, total in sums.items():
                        total += _products(x, *b)
            if rows:
                for (first, _), total in sums.items():
                    yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        return run

    def of_block(item: tuple[int, np.ndarray]) -> Iterator[tuple]:
        first, sums = item
        found = _correlations(sums)
        for i in range(found.shape[0]):
            for j in range(first + i + 1, count):
                yield columns[first + i], columns[j], None if np.isnan(found[i, j]) else float(found[i, j])

    for start in range(0, len(blocks), at_once):
        parts = table.mapInArrow(partial(blocks[start : start + at_once]), "first int, sums binary").rdd
        summed = parts.map(lambda r: (r[0], np.frombuffer(bytes(r[1])).reshape(6, -1, count))).reduceByKey(lambda a, b: a + b)
        every = every.union(spark.createDataFrame(summed.flatMap(of_block), schema, verifySchema=False))
    return every
