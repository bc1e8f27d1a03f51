"""Seeded damage to a table.  Every choice is a hash of the row's identity, so that it is the same at any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import DRAW_BITS, col, drawn, hashed_normal, hashed_uniform, numeric_columns

#: Rows that one task ranks, and counts of draws that come to the driver at once.
RANKED, STEP_BITS = 20_000, 12
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def numbered(df: DataFrame, order: str | Column, name: str) -> DataFrame:
    """Consecutive numbers from 0 in an order, without sorting in one task.

    Rows go to ranges of the order; each range is numbered by itself and starts
    where the ranges before it end.
    """
    key = F.col(order) if isinstance(order, str) else order
    ranged = df.repartitionByRange(key.asc_nulls_first()).withColumn("_part", F.spark_partition_id())
    local = ranged.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(key.asc_nulls_first())) - 1)
    starts = local.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))  # a row for each range
    return local.join(F.broadcast(starts), "_part").withColumn(name, (F.col(name) + F.col("_start")).cast("long")).drop("_part", "_start")


def numbered_by_draw(df: DataFrame, draw: Column, row_id: Column, name: str) -> DataFrame:
    """Consecutive numbers from 0 in the order of a draw.

    Draws are uniform, so their leading bits deal rows to buckets of about equal
    size; a bucket is numbered by itself and starts where the buckets before it end.
    """
    bits = max(0, min(16, (df.count() // RANKED).bit_length()))
    bucketed = df.withColumn("_draw", draw).withColumn("_bucket", F.shiftright("_draw", DRAW_BITS - bits) if bits else F.lit(0).cast("long"))
    local = bucketed.withColumn(name, F.row_number().over(Window.partitionBy("_bucket").orderBy("_draw", row_id)) - 1)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    starts = starts.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))  # at most 65,536 rows
    return local.join(F.broadcast(starts), "_bucket").withColumn(name, (F.col(name) + F.col("_start")).cast("long")).drop("_draw", "_bucket", "_start")


def kth_draws(keyed: DataFrame, wanted: dict[int, tuple[int, int]]) -> dict[int, tuple[int, object]]:
    """For each key, the draw and id at the k-th place (draws rise, equal ones by id) of its rows.

    ``keyed`` has ``_key``, ``_draw`` and ``_id``; ``wanted`` gives k, from 1, and
    the number of rows of each key.  All keys are narrowed at once: draws are
    counted by their leading bits, then by the next bits of the places that the
    wanted ones fall in, until few rows are left for each key, which are ranked.
    Jobs follow from the logarithm of the rows, not from the keys.
    """
    at = {key: (0, 0, rows, k) for key, (k, rows) in wanted.items()}  # prefix, bits, rows left, place among them
    while wide := {key: a for key, a in at.items() if a[2] > RANKED and a[1] < DRAW_BITS}:
        step = max(1, STEP_BITS - (len(wide) - 1).bit_length())
        bits = {key: min(DRAW_BITS, a[1] + step) for key, a in wide.items()}
        rows = _within(keyed, wide).withColumn("_p", _head(_of_key(bits)))
        counts: dict[int, list] = {}
        for r in rows.groupBy("_key", "_p").agg(F.count("*").alias("n")).collect():  # at most 4,096 rows, or two for each key
            counts.setdefault(r._key, []).append((r._p, r.n))
        for key, (_, _, _, k) in wide.items():
            for p, n in sorted(counts[key]):
                if n >= k:
                    at[key] = p, bits[key], n, k
                    break
                k -= n
    few = _within(keyed, at).withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy("_draw", "_id")))  # at most RANKED rows of a key
    found = few.where(F.col("_r") == _of_key({key: a[3] for key, a in at.items()})).collect()
    return {r._key: (r._draw, r._id) for r in found}


def _of_key(values: dict[int, int]) -> Column:
    """The value of a row's key, null for other keys."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("_key"))


def _within(keyed: DataFrame, at: dict[int, tuple]) -> DataFrame:
    """Rows whose draws begin with the bits that their key is narrowed to."""
    if all(bits == 0 for _, bits, *_ in at.values()):
        return keyed.where(F.col("_key").isin(list(at)))
    bits, prefix = (_of_key({key: a[n] for key, a in at.items()}) for n in (1, 0))
    return keyed.where(F.col("_key").isin(list(at)) & (_head(bits) == prefix))


def _head(bits: Column) -> Column:
    """So many leading bits of a draw."""
    return F.call_function("shiftright", F.col("_draw"), (DRAW_BITS - bits).cast("int"))


def among_smallest_of(df: DataFrame, row_id: str, draws: list[Column], k: int, rows: int) -> list[Column]:
    """For each draw, whether a row is one of the k with the smallest ones (equal ones by id): conditions, so that nothing is shuffled."""
    if k <= 0 or k >= rows or not draws:
        return [F.lit(k > 0)] * len(draws)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("_key"), d.alias("_draw"), col(row_id).alias("_id")) for i, d in enumerate(draws)])).alias("c")
    last = kth_draws(df.select(cells).select("c.*"), {i: (k, rows) for i in range(len(draws))})
    return [(d < last[i][0]) | ((d == last[i][0]) & (col(row_id) <= F.lit(last[i][1]))) for i, d in enumerate(draws)]


def among_smallest(df: DataFrame, row_id: str, draw: Column, k: int, rows: int) -> Column:
    return among_smallest_of(df, row_id, [draw], k, rows)[0]


class Mutator:
    """Mutations of a table whose rows have a unique id column."""

    def __init__(self, row_id: str, seed: int = 42):
        self.row_id, self.seed = row_id, seed

    def _at(self, df: DataFrame, fraction: float, salts: list[str]) -> list[Column]:
        """For each salt, whether a row is one of a share of all rows, drawn for it."""
        rows = self.checked(df)
        return among_smallest_of(df, self.row_id, [drawn(*self._h(s)) for s in salts], math.ceil(rows * fraction), rows)

    def checked(self, df: DataFrame) -> int:
        """Number of rows; choices are exact only where each row has an id, so null ids are refused.  Rows that share an id are drawn together."""
        f = df.agg(F.count("*").alias("rows"), F.count(col(self.row_id)).alias("held")).first()
        if f.held < f.rows:
            raise ValueError(f"{f.rows - f.held} rows have no '{self.row_id}'")
        return f.rows

    def _h(self, *salt: str) -> list[Column]:
        return [col(self.row_id), F.lit(self.seed), *map(F.lit, salt)]

    def inject_missing(self, df: DataFrame, fraction: float, columns: list[str] | None = None) -> DataFrame:
        names = columns or [x for x in df.columns if x != self.row_id]
        gone = dict(zip(names, self._at(df, fraction, [f"missing {c}" for c in names])))
        return df.select(*[F.when(~gone[c], col(c)).alias(c) if c in gone else col(c) for c in df.columns])

    def inject_duplicates(self, df: DataFrame, fraction: float) -> DataFrame:
        """Append int(rows * fraction) rows, drawn with replacement."""
        rows = df.count()
        places = numbered_by_draw(df.select(col(self.row_id).alias("_id")), drawn(F.col("_id"), F.lit(self.seed), F.lit("place")), F.col("_id"), "_place")
        draws = df.sparkSession.range(int(rows * fraction)).select(F.pmod(drawn(F.col("id"), F.lit(self.seed), F.lit("duplicates")), F.lit(max(rows, 1))).alias("_place"))
        again = draws.join(places, "_place").join(df, F.col("_id") == col(self.row_id)).select(*[col(c) for c in df.columns])
        return df.unionByName(again)

    def inject_outliers(self, df: DataFrame, fraction: float, columns: list[str] | None = None) -> DataFrame:
        names = columns or [x for x in numeric_columns(df) if x != self.row_id]
        if not names:
            return df
        facts = df.agg(*[F.struct(F.avg(col(c)).alias("m"), F.stddev_samp(col(c)).alias("s")).alias(f"x{i}") for i, c in enumerate(names)]).first()
        changed = {}
        for c, f, hit in zip(names, facts, self._at(df, fraction, [f"outliers {c}" for c in names])):
            mean, spread = (float(f.m), float(f.s)) if f.s and not math.isnan(f.s) else (0.0, 1.0)
            far = 5 + 5 * hashed_uniform(*self._h("far", c))
            sign = F.when(hashed_uniform(*self._h("sign", c)) < 0.5, -1.0).otherwise(1.0)
            changed[c] = F.when(hit, mean + sign * far * spread).otherwise(col(c).cast("double")).alias(c)
        return df.select(*[changed.get(c, col(c)) for c in df.columns])

    def inject_noise(self, df: DataFrame, level: float, columns: list[str] | None = None) -> DataFrame:
        names = columns or [x for x in numeric_columns(df) if x != self.row_id]
        f = df.agg(*[F.stddev_samp(col(c)).alias(f"s{i}") for i, c in enumerate(names)]).first()
        noise = {c: hashed_normal(*self._h("noise", c)) * (level * float(f[i] or 0.0)) for i, c in enumerate(names)}
        return df.select(*[(col(c).cast("double") + noise[c]).alias(c) if c in noise else col(c) for c in df.columns])

    def remove_features(self, df: DataFrame, columns: list[str]) -> DataFrame:
        return df.drop(*columns)

    def shuffle_column(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """Deal a column's values out to other rows: the value at one place of a drawn order goes to the row at the same place of another."""
        for c in columns:
            giver = numbered_by_draw(df.select(col(c).alias("_v"), col(self.row_id).alias("_g")), drawn(F.col("_g"), F.lit(self.seed), F.lit(f"give {c}")), F.col("_g"), "_r").drop("_g")
            taker = numbered_by_draw(df.select(col(self.row_id).alias("_id")), drawn(F.col("_id"), F.lit(self.seed), F.lit(f"take {c}")), F.col("_id"), "_r")
            dealt = taker.join(giver, "_r").select("_id", "_v")
            df = df.join(dealt, col(self.row_id) == F.col("_id")).withColumn(c, F.col("_v")).drop("_id", "_v")
        return df

    @staticmethod
    def shift(df: DataFrame, offset: float = 0.5, spread: float = 1.0, columns: list[str] | None = None) -> DataFrame:
        """(x - mean) * spread + mean + offset * sigma."""
        names = columns or numeric_columns(df)
        f = df.agg(*[F.struct(F.avg(col(c)).alias("m"), F.stddev_samp(col(c)).alias("s")).alias(f"x{i}") for i, c in enumerate(names)]).first()

        def moved(i: int, c: str) -> Column:
            mean, sigma = float(f[i].m or 0.0), float(f[i].s or 0.0) or 1.0
            return ((col(c).cast("double") - mean) * spread + mean + offset * sigma).alias(c)

        at = {c: i for i, c in enumerate(names)}
        return df.select(*[moved(at[c], c) if c in at else col(c) for c in df.columns])

    def flip_labels(self, df: DataFrame, target: str, fraction: float) -> DataFrame:
        """A drawn share of the labels moves on by a drawn number of classes, in the classes' order; a label is never kept."""
        classes = numbered(df.where(col(target).isNotNull()).select(col(target).alias("_c")).distinct(), "_c", "_k")
        n = classes.count()
        if n < 2:
            return df
        hit = self._at(df, fraction, ["flip"])[0] & col(target).isNotNull()
        step = 1 + F.pmod(drawn(*self._h("flip to")), F.lit(n - 1))
        # Only flipped rows look up classes; these tables have a row for each class.
        flipped = df.withColumn("_hit", hit).withColumn("_from", F.when(F.col("_hit"), col(target))).withColumn("_step", F.when(F.col("_hit"), step))
        own, new = classes.withColumnsRenamed({"_c": "_from", "_k": "_k1"}), classes.withColumnsRenamed({"_c": "_to", "_k": "_k2"})
        moved = flipped.join(own, "_from", "left").withColumn("_k2", F.pmod(F.col("_k1") + F.col("_step"), F.lit(n))).join(new, "_k2", "left")
        return moved.select(*[F.when(F.col("_hit"), F.col("_to")).otherwise(col(c)).alias(c) if c == target else col(c) for c in df.columns])

    def downsample_minority(self, df: DataFrame, target: str, majority, minority, ratio: float) -> DataFrame:
        """Keep max(1, min(int(majority * (1 - ratio) / ratio), minority rows)) of the minority's rows."""
        f = df.agg(F.count_if(col(target) == majority).alias("most"), F.count_if(col(target) == minority).alias("few")).first()
        keep = max(1, min(int(f.most * (1 - ratio) / ratio), f.few))
        stays = among_smallest(df.where(col(target) == minority), self.row_id, drawn(*self._h("imbalance")), keep, f.few)
        return df.where(~col(target).eqNullSafe(F.lit(minority)) | stays)

    def corrupt(self, df: DataFrame, fraction: float, columns: list[str] | None = None) -> DataFrame:
        """Replace cells by five random letters or digits."""
        names = columns or [x for x in df.columns if x != self.row_id]
        changed = {}
        for c, hit in zip(names, self._at(df, fraction, [f"corrupt {c}" for c in names])):
            letters = [F.substring(F.lit(ALPHABET), F.pmod(drawn(*self._h("corrupt", c, str(k))), F.lit(len(ALPHABET))).cast("int") + 1, F.lit(1)) for k in range(5)]
            changed[c] = F.when(hit, F.concat(*letters)).otherwise(col(c).cast(T.StringType())).alias(c)
        return df.select(*[changed.get(c, col(c)) for c in df.columns])
