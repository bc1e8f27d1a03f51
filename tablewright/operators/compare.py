"""Two versions of a table: shape, schema, renamed columns, gaps, cardinality and the target's classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import NUMERIC, col
from .drift import Drift, detect
from .profile import distinct_counts, duplicate_count, null_counts

# Thresholds of a change.
RENAMED, MISSING_WARNING, MISSING_CRITICAL, CARDINALITY, SHARE_POINTS, MOST_CLASSES = 0.90, 5.0, 20.0, 2.0, 5.0, 25
#: Hashes that a sketch of a column's values keeps, as a power of two, and standard errors that its bounds allow for.
SKETCH_BITS, DEVIATIONS = 12, 5
CHANGE = "kind string, column string, severity string, before string, after string"


@dataclass
class Change:
    kind: str
    column: str
    severity: str
    before: str | None = None
    after: str | None = None


@dataclass
class Comparison:
    headline: dict[str, dict]
    changes: list[Change]
    drift: Drift | None

    def frame(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame([tuple(vars(c).values()) for c in self.changes], CHANGE)

    def headline_frame(self, df: DataFrame) -> DataFrame:
        rows = [(k, str(v["left"]), str(v["right"]), str(v["delta"])) for k, v in self.headline.items()]
        return df.sparkSession.createDataFrame(rows, "measure string, left string, right string, delta string")


def shape(df: DataFrame) -> dict[str, float]:
    nulls = null_counts(df).agg(F.max("rows").alias("rows"), F.sum("nulls").alias("nulls")).first()
    cells = (nulls.rows or 0) * len(df.columns)
    return {"rows": nulls.rows or 0, "columns": len(df.columns), "missing_pct": round((nulls.nulls or 0) / cells * 100, 4) if cells else 0.0, "duplicates": duplicate_count(df).first().duplicates}


def value_overlaps(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """pair (its number), shared, total and jaccard of the distinct values (as text) of pairs of columns, one of each table; all pairs in one shuffle."""
    def values(df: DataFrame, side: int) -> DataFrame:
        cells = [F.struct(F.lit(i).alias("pair"), col(p[side]).cast("string").alias("v")) for i, p in enumerate(pairs)]
        return df.select(F.explode(F.array(*cells)).alias("c")).where("c.v IS NOT NULL").select("c.pair", "c.v", F.lit(side + 1).alias("s"))

    held = values(left, 0).union(values(right, 1)).groupBy("pair", "v").agg(F.bit_or("s").alias("s"))
    return held.groupBy("pair").agg(F.count_if(F.col("s") == 3).alias("shared"), F.count("*").alias("total")).withColumn("jaccard", F.try_divide("shared", "total"))


def likely_overlaps(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], least: float) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Pairs of columns whose values may overlap by ``least``, and pairs without any value.

    Sketches keep the ``2 ** SKETCH_BITS`` smallest hashes of each column, all from
    one pass over each table; a pair is left out where the ratio of its estimates
    lies more than ``DEVIATIONS`` standard errors of each below.  Columns with fewer
    values are known exactly.
    """
    columns = [list(dict.fromkeys(p[side] for p in pairs)) for side in (0, 1)]
    one, other = (
        df.agg(*[F.theta_sketch_agg(col(c).cast("string"), F.lit(SKETCH_BITS)).alias(f"s{side}_{i}") for i, c in enumerate(names)])
        for side, (df, names) in enumerate(zip((left, right), columns))
    )
    both = one.crossJoin(other)  # a row each
    facts = []
    for a, b in pairs:
        x, y = F.col(f"s0_{columns[0].index(a)}"), F.col(f"s1_{columns[1].index(b)}")
        both_hold, any_holds = (F.theta_sketch_estimate(s) for s in (F.theta_intersection(x, y), F.theta_union(x, y, F.lit(SKETCH_BITS))))
        facts.append(F.struct(both_hold.alias("shared"), any_holds.alias("total")))
    rows = both.select(F.array(*facts).alias("f")).first().f
    margin = least * 2 * DEVIATIONS / 2 ** (SKETCH_BITS / 2)
    return [p for p, f in zip(pairs, rows) if f.total and f.shared / f.total >= least - margin], [p for p, f in zip(pairs, rows) if not f.total]


def value_overlap(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """shared, total and jaccard of one pair; a row of zeros and null where neither column has a value."""
    return value_overlaps(left, right, [(a, b)]).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("shared", "total")], F.max("jaccard").alias("jaccard"))


def same_ids(left: DataFrame, right: DataFrame, row_id: str) -> bool:
    one, other = left.select(col(row_id).alias("_l")), right.select(col(row_id).alias("_r"))
    return one.join(other, F.col("_l") == F.col("_r"), "full_outer").where("_l IS NULL OR _r IS NULL").isEmpty()


def renamed_columns(left: DataFrame, right: DataFrame, row_id: str | None = None, least: float = RENAMED) -> list[tuple[str, str, float]]:
    """Removed and added columns that are the same one, best match first, each used once.

    Columns that hold equal values row by row also hold the same set of values; so
    only columns without any value need a look at the rows, whether their ids agree.
    """
    gone = [c for c in left.columns if c not in right.columns]
    new = [c for c in right.columns if c not in left.columns]
    alike = [(a, b) for a in gone for b in new if isinstance(left.schema[a].dataType, NUMERIC) == isinstance(right.schema[b].dataType, NUMERIC)]
    if not alike:
        return []
    likely, empty = likely_overlaps(left, right, alike, least)
    found = [(r.jaccard, *likely[r.pair]) for r in value_overlaps(left, right, likely).where(F.col("jaccard") >= least).collect()] if likely else []  # a row for each pair
    if empty and row_id and row_id in left.columns and row_id in right.columns and same_ids(left, right, row_id):
        found += [(1.0, a, b) for a, b in empty]
    pairs, used = [], set()
    for score, a, b in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        if a not in used and b not in used:
            used |= {a, b}
            pairs.append((a, b, score))
    return pairs


def class_shares_of_both(left: DataFrame, right: DataFrame, target: str) -> DataFrame:
    """value, and its percentage among the non-null values of each side (null where absent)."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("value")).agg(F.count("*").alias("n"))
        total = counts.agg(F.sum("n").alias("t"))
        return counts.crossJoin(F.broadcast(total)).select("value", (F.col("n") * 100 / F.col("t")).alias(name))

    return shares(left, "pct_left").join(shares(right, "pct_right"), "value", "full_outer")


def compare(left: DataFrame, right: DataFrame, target: str | None = None, row_id: str | None = None, drift: bool = True) -> Comparison:
    sizes = [shape(left), shape(right)]
    headline = {k: {"left": sizes[0][k], "right": sizes[1][k], "delta": round(sizes[1][k] - sizes[0][k], 4)} for k in sizes[0]}
    changes: list[Change] = []
    renames = renamed_columns(left, right, row_id)
    old, new = {a for a, _, _ in renames}, {b for _, b, _ in renames}
    changes += [Change("renamed", a, "WARNING", a, b) for a, b, _ in renames]
    changes += [Change("removed", c, "CRITICAL" if c == target else "WARNING", c, None) for c in left.columns if c not in right.columns and c not in old]
    changes += [Change("added", c, "INFO", None, c) for c in right.columns if c not in left.columns and c not in new]
    shared = [c for c in left.columns if c in right.columns]
    for c in shared:
        a, b = left.schema[c].dataType, right.schema[c].dataType
        if a != b:
            changes.append(Change("type", c, "INFO" if isinstance(a, NUMERIC) and isinstance(b, NUMERIC) else "CRITICAL", a.simpleString(), b.simpleString()))
    gaps = [{r["column"]: r.null_pct for r in null_counts(df.select(*[col(c) for c in shared])).collect()} for df in (left, right)] if shared else [{}, {}]
    sizes_of = [{r["column"]: r["distinct"] for r in distinct_counts(df, shared).collect()} for df in (left, right)] if shared else [{}, {}]
    for c in shared:
        moved = gaps[1][c] - gaps[0][c]
        if abs(moved) >= MISSING_WARNING:
            changes.append(Change("missing", c, "INFO" if moved < 0 else "CRITICAL" if moved >= MISSING_CRITICAL else "WARNING", f"{gaps[0][c]:.2f}", f"{gaps[1][c]:.2f}"))
        n, m = sizes_of[0].get(c, 0), sizes_of[1].get(c, 0)
        if n and m and not isinstance(left.schema[c].dataType, NUMERIC) and not 1 / CARDINALITY < m / n < CARDINALITY:
            changes.append(Change("cardinality", c, "WARNING", str(n), str(m)))
    if target and target in shared and max(sizes_of[0].get(target, 0), sizes_of[1].get(target, 0)) <= MOST_CLASSES:
        for r in class_shares_of_both(left, right, target).orderBy("value").collect():
            if r.pct_left is None or r.pct_right is None:
                changes.append(Change("new class" if r.pct_left is None else "gone class", target, "CRITICAL", None if r.pct_left is None else r.value, None if r.pct_right is None else r.value))
            elif abs(r.pct_right - r.pct_left) >= SHARE_POINTS:
                changes.append(Change("class share", target, "WARNING", f"{r.value}: {r.pct_left:.2f}", f"{r.value}: {r.pct_right:.2f}"))
    found = detect(left, right, shared) if drift and shared else None
    if found:
        changes += [Change("drift", c.column, c.status, None, f"PSI {c.psi:.4f}") for c in found.columns if c.status in ("WARNING", "CRITICAL") and c.psi is not None and not (c.missing_drift and c.psi < 0.1)]
    return Comparison(headline, changes, found)
