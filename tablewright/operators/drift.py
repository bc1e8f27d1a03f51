"""Drift between a reference table and a current one: shares, PSI, Kolmogorov-Smirnov and chi-square.

All columns are counted together: one table of (column, value, count on each
side) answers for shares, tests and changed values of every column.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import INTEGRAL, NUMERIC, col
from .quantiles import between, exact_quantiles

# Default thresholds.
DEFAULTS = {"psi_warning": 0.10, "psi_critical": 0.25, "numeric_bins": 10, "significance_level": 0.05, "min_samples": 30, "rare_category_threshold": 0.01, "dataset_drift_share": 0.30, "dataset_warning_share": 0.10, "missing_rate_points": 5.0}
FLOOR = 1e-6
STABLE, WARNING, CRITICAL, TYPE_CHANGED, NOT_COMPARABLE = "STABLE", "WARNING", "CRITICAL", "TYPE_CHANGED", "NOT_COMPARABLE"
SEVERITY = {CRITICAL: 0, TYPE_CHANGED: 1, WARNING: 2, NOT_COMPARABLE: 3, STABLE: 4}
#: Rows of a column's distribution that a report holds, changes it names, and new or gone values it lists.
MOST_ROWS, MOST_CHANGES, MOST_NAMED = 25, 5, 10
#: Rows of each side up to which the Kolmogorov-Smirnov tail is exact.
EXACT_ROWS = 10_000


def sides(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Both tables' shared columns in one, with ``side`` 0 for the reference and 1 for the current."""
    pick = lambda df, s: df.select(F.lit(s).alias("side"), *[col(c) for c in columns])
    return pick(reference, 0).unionByName(pick(current, 1))


def inner_edges(quantiles: list[float]) -> list[float]:
    return sorted(set(quantiles))[1:-1]


def quantile_edges(reference: DataFrame, column: str, bins: int = 10) -> list[float]:
    """Inner edges of bins that hold equal shares of the reference; the outer ones are infinite."""
    return inner_edges(exact_quantiles(reference, {column: col(column)}, [k / bins for k in range(bins + 1)])[column])


def bin_of(x: Column, inner: list[float]) -> Column:
    """Number of inner edges at or below x: bins are closed on the left."""
    out = F.lit(0)
    for edge in inner:
        out = out + F.when(x >= edge, 1).otherwise(0)
    return out


def side_counts(tagged: DataFrame, value: Column) -> DataFrame:
    """value, n_ref and n_cur in one pass."""
    return tagged.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count_if(F.col("side") == 0).alias("n_ref"), F.count_if(F.col("side") == 1).alias("n_cur"))


def contributions(counts: DataFrame) -> DataFrame:
    """value, both shares and each value's part of the PSI; shares are floored and made to sum to one again."""
    totals = counts.agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"))  # one row
    floored = counts.crossJoin(F.broadcast(totals)).select("value", "n_ref", "n_cur", F.greatest(F.col("n_ref") / F.col("t_ref"), F.lit(FLOOR)).alias("r"), F.greatest(F.col("n_cur") / F.col("t_cur"), F.lit(FLOOR)).alias("c"))
    again = floored.agg(F.sum("r").alias("s_ref"), F.sum("c").alias("s_cur"))
    shares = floored.crossJoin(F.broadcast(again)).select("value", "n_ref", "n_cur", (F.col("r") / F.col("s_ref")).alias("share_ref"), (F.col("c") / F.col("s_cur")).alias("share_cur"))
    return shares.withColumn("contribution", (F.col("share_cur") - F.col("share_ref")) * F.ln(F.col("share_cur") / F.col("share_ref")))


def psi_of(counts: DataFrame) -> DataFrame:
    return contributions(counts).agg(F.sum("contribution").alias("psi"))


def numeric_counts(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    inner = quantile_edges(reference, column, bins)
    x = col(column).cast("double")
    counts = side_counts(sides(reference, current, [column]), F.when(x.isNotNull(), bin_of(x, inner)))
    every = reference.sparkSession.range(len(inner) + 1).select(F.col("id").cast("int").alias("value"))
    return every.join(counts, "value", "left").select("value", F.coalesce("n_ref", F.lit(0)).alias("n_ref"), F.coalesce("n_cur", F.lit(0)).alias("n_cur"))


def category_counts(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    return side_counts(sides(reference, current, [column]), col(column).cast("string"))


# --- All columns at once --------------------------------------------------------------------------


def value_table(tagged: DataFrame, columns: list[str]) -> DataFrame:
    """place (of the column), number or text, n_ref and n_cur: the distinct values of all columns, in one shuffle summed before it.

    The rows lie in ranges of (place, number, text), and ``_part`` is the range.
    The table is persisted, so that all that is drawn from it sees the same ranges.
    """
    kinds = tagged.schema
    numeric = {c for c in columns if isinstance(kinds[c].dataType, NUMERIC)}
    cells = F.array(*[F.struct(F.lit(i).alias("place"), (col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("number"), (F.lit(None).cast("string") if c in numeric else col(c).cast("string")).alias("text")) for i, c in enumerate(columns)])
    counts = tagged.select("side", F.explode(cells).alias("c")).where("c.number IS NOT NULL OR c.text IS NOT NULL").groupBy("c.place", "c.number", "c.text").agg(F.count_if(F.col("side") == 0).alias("n_ref"), F.count_if(F.col("side") == 1).alias("n_cur"))
    return counts.repartitionByRange("place", "number", "text").withColumn("_part", F.spark_partition_id()).persist()


def running(values: DataFrame) -> DataFrame:
    """place, number, both counts, and both running sums (the row's own counts included) of a value table: summed by ranges, each starting from the sums of those before it."""
    within = Window.partitionBy("_part", "place").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    local = values.select("_part", "place", "number", "n_ref", "n_cur", F.sum("n_ref").over(within).alias("r"), F.sum("n_cur").over(within).alias("c"))
    parts = values.groupBy("_part", "place").agg(F.sum("n_ref").alias("pr"), F.sum("n_cur").alias("pc"))
    before = Window.partitionBy("place").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", "place", F.coalesce(F.sum("pr").over(before), F.lit(0)).alias("br"), F.coalesce(F.sum("pc").over(before), F.lit(0)).alias("bc"))
    # A row for each range and column.
    return local.join(F.broadcast(parts), ["_part", "place"]).select("place", "number", "n_ref", "n_cur", (F.col("r") + F.col("br")).alias("r"), (F.col("c") + F.col("bc")).alias("c"))


def ks_of(values: DataFrame) -> DataFrame:
    """place, statistic, n_ref and n_cur from a value table."""
    totals = values.groupBy("place").agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"))  # a row for each column
    gap = F.abs(F.col("r") / F.col("t_ref") - F.col("c") / F.col("t_cur"))
    return running(values).join(F.broadcast(totals), "place").groupBy("place").agg(F.max(gap).alias("statistic"), F.first("t_ref").alias("n_ref"), F.first("t_cur").alias("n_cur"))


def quantiles_of(values: DataFrame, wanted: dict[tuple[int, int], tuple[int, list[float]]]) -> dict[tuple[int, int], list[float]]:
    """Quantiles by linear interpolation for (place, side), each with its number of rows and its shares, read off a value table's running sums."""
    ranks: dict[tuple[int, int], set[int]] = {}
    for key, (n, shares) in wanted.items():
        at = [s * (n - 1) for s in shares]
        ranks[key] = {math.floor(x) for x in at} | {math.ceil(x) for x in at}
    if not ranks:
        return {}
    table = values.sparkSession.createDataFrame([(i, s, k) for (i, s), found in ranks.items() for k in found], "place int, s int, k long")
    table = table.groupBy("place").agg(F.collect_list(F.struct("s", "k")).alias("wanted"))  # a row for each column, some ranks in it

    def met(x: Column) -> Column:
        upto, own = (F.when(x.s == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("r", "c"), ("n_ref", "n_cur")))
        return (x.k < upto) & (x.k >= upto - own)

    rows = running(values).join(F.broadcast(table), "place").withColumn("wanted", F.filter("wanted", met)).where(F.size("wanted") > 0)
    held = {(r.place, x.s, x.k): r.number for r in rows.select("place", "number", "wanted").collect() for x in r.wanted}  # a row for each rank at most
    out = {}
    for (i, s), (n, shares) in wanted.items():
        at = [x * (n - 1) for x in shares]
        out[i, s] = [between(held[i, s, math.floor(x)], held[i, s, math.ceil(x)], x - math.floor(x)) for x in at]
    return out


def ks_statistic(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """statistic, n_ref and n_cur of the two-sample test."""
    return ks_of(value_table(sides(reference, current, [column]), [column])).select("statistic", "n_ref", "n_cur")


def chi_square(counts: DataFrame, rare: float = 0.01) -> DataFrame:
    """statistic and groups of the 2 x k table; values rare on both sides are pooled, and 2 x 2 is corrected for continuity."""
    return chi_square_of(counts.select(F.lit(0).alias("place"), "n_ref", "n_cur"), rare).select("statistic", "groups")


def chi_square_of(counts: DataFrame, rare: float) -> DataFrame:
    """place, statistic and groups for each place of (place, n_ref, n_cur)."""
    totals = counts.groupBy("place").agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"))  # a row for each column
    both = counts.join(F.broadcast(totals), "place")
    is_rare = (F.col("n_ref") < rare * F.col("t_ref")) & (F.col("n_cur") < rare * F.col("t_cur"))

    def part(n_ref: Column, n_cur: Column, corrected: bool) -> Column:
        out = F.lit(0.0)
        for n, t in ((n_ref, "t_ref"), (n_cur, "t_cur")):
            expected = (n_ref + n_cur) * F.col(t) / (F.col("t_ref") + F.col("t_cur"))
            gap = F.abs(n - expected)
            gap = gap - F.least(F.lit(0.5), gap) if corrected else gap
            out = out + gap * gap / expected
        return out

    own = [F.sum(F.when(~is_rare, part(F.col("n_ref"), F.col("n_cur"), k))).alias(f"own_{k}") for k in (False, True)]
    summed = both.groupBy("place", "t_ref", "t_cur").agg(*own, F.count_if(~is_rare).alias("common"), F.count_if(is_rare).alias("pooled"), F.sum(F.when(is_rare, F.col("n_ref"))).alias("r"), F.sum(F.when(is_rare, F.col("n_cur"))).alias("c"))
    groups = (F.col("common") + (F.col("pooled") > 0).cast("int")).alias("groups")
    total = lambda k: F.coalesce(f"own_{k}", F.lit(0.0)) + F.when(F.col("pooled") > 0, part(F.col("r"), F.col("c"), k)).otherwise(0.0)
    return summed.select("place", groups, total(False).alias("plain"), total(True).alias("corrected")).select("place", F.when(F.col("groups") == 2, F.col("corrected")).when(F.col("groups") > 2, F.col("plain")).alias("statistic"), F.col("groups").cast("long").alias("groups"))


def chi_square_p(statistic: float, freedom: int) -> float:
    """Upper tail of the chi-square distribution: the regularised upper incomplete gamma function."""
    a, x = freedom / 2.0, statistic / 2.0
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series of the lower part
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - a  # continued fraction of the upper part
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, h * scale)


def ks_tail(statistic: float, n: int, m: int) -> float:
    """Two-sided tail of the Kolmogorov-Smirnov statistic: exact up to EXACT_ROWS on each side, else asymptotic."""
    return ks_p_exact(statistic, n, m) if max(n, m) <= EXACT_ROWS else ks_p(statistic, n, m)


def ks_p(statistic: float, n: int, m: int) -> float:
    """Asymptotic two-sided tail of the Kolmogorov-Smirnov statistic."""
    x = statistic * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks_p_exact(statistic: float, n: int, m: int) -> float:
    """Share of the orders of n and m values whose statistic is as large.

    An order is a path over a grid; of the paths to each point, the share that
    has stayed below the statistic follows from the two points before it.  Points
    with the same number of values so far are reckoned together.
    """
    far = round(statistic * n * m)  # statistics are whole multiples of 1 / nm
    inside = np.ones(1)
    for seen in range(1, n + m + 1):
        first, last = max(0, seen - m), min(n, seen)
        was = max(0, seen - 1 - m)  # the first point of the line before
        i = np.arange(first, last + 1)
        padded = np.concatenate([[0.0], inside, [0.0]])
        across, up = padded[i - was], padded[i - was + 1]
        inside = (i * across + (seen - i) * up) / seen
        inside[np.abs(i * m - (seen - i) * n) >= far] = 0.0
    return float(min(1.0, max(0.0, 1.0 - inside[-1])))


@dataclass
class ColumnDrift:
    column: str
    status: str
    kind: str
    psi: float | None = None
    test: str | None = None
    statistic: float | None = None
    p_value: float | None = None
    significant: bool | None = None
    missing_ref: float | None = None
    missing_cur: float | None = None
    missing_drift: bool = False
    new_values: list[str] = field(default_factory=list)
    gone_values: list[str] = field(default_factory=list)
    top_changes: list[dict] = field(default_factory=list)
    distribution: list[dict] = field(default_factory=list)
    statistics: dict[str, dict[str, float | None]] = field(default_factory=dict)
    explanation: str = ""


@dataclass
class Drift:
    status: str
    mean_psi: float
    max_psi: float
    columns: list[ColumnDrift]
    removed: list[str]
    added: list[str]

    def frame(self, df: DataFrame) -> DataFrame:
        rows = [(c.column, c.status, c.kind, c.psi, c.statistic, c.p_value, c.significant, c.missing_drift, c.explanation) for c in self.columns]
        return df.sparkSession.createDataFrame(rows, "column string, status string, kind string, psi double, statistic double, p_value double, significant boolean, missing_drift boolean, explanation string")

    def distribution_frame(self, df: DataFrame) -> DataFrame:
        """A row for each bin or value of each column: label, shares and contribution."""
        rows = [(c.column, d["label"], d["share_ref"], d["share_cur"], d["contribution"]) for c in self.columns for d in c.distribution]
        return df.sparkSession.createDataFrame(rows, "column string, label string, share_ref double, share_cur double, contribution double")

    def statistics_frame(self, df: DataFrame) -> DataFrame:
        """A row for each column, side and measure."""
        rows = [(c.column, side, m, None if v is None else float(v)) for c in self.columns for side, held in c.statistics.items() for m, v in held.items()]
        return df.sparkSession.createDataFrame(rows, "column string, side string, measure string, value double")

    def to_dict(self) -> dict:
        return asdict(self)

    def counts(self) -> dict[str, int]:
        return {s: sum(c.status == s for c in self.columns) for s in SEVERITY}


def classify(psi: float, rules: dict) -> str:
    return CRITICAL if psi >= rules["psi_critical"] else WARNING if psi >= rules["psi_warning"] else STABLE


def missing_rates(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """column, and the missing percentage of each side."""
    rate = lambda c, s: F.avg(F.when(F.col("side") == s, col(c).isNull().cast("double"))) * 100
    one = sides(reference, current, columns).agg(*[F.struct(rate(c, 0).alias("missing_ref"), rate(c, 1).alias("missing_cur")).alias(f"m{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("m")) for i, c in enumerate(columns)])
    return one.select(F.explode(cells).alias("c")).select("c.column", "c.m.*")


def side_facts(tagged: DataFrame, columns: list[str], numeric: list[str]) -> dict[str, dict[str, dict]]:
    """For each column and side: count, missing percentage, and mean, std, min and max of numbers, in one aggregate."""
    def facts(c: str, s: int) -> Column:
        x = F.when(F.col("side") == s, col(c))
        measures = [F.count_if(F.col("side") == s).alias("rows"), F.count(x).alias("count")]
        if c in numeric:
            x = x.cast("double")
            measures += [F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]
        return F.struct(*measures)

    one = tagged.agg(*[facts(c, s).alias(f"f{i}_{s}") for i, c in enumerate(columns) for s in (0, 1)]).first()
    out: dict[str, dict[str, dict]] = {}
    for i, c in enumerate(columns):
        for s, side in enumerate(("reference", "current")):
            held = one[f"f{i}_{s}"].asDict()
            rows = held.pop("rows")
            out.setdefault(c, {})[side] = held | {"missing_pct": (rows - held["count"]) / rows * 100 if rows else None}
    return out


def _shares(pairs: list[tuple[str, int, int]]) -> tuple[float, list[dict]]:
    """PSI and distribution of a column's bins (label, n_ref, n_cur)."""
    t_ref, t_cur = sum(r for _, r, _ in pairs), sum(c for _, _, c in pairs)
    floored = [(label, max(r / t_ref, FLOOR), max(c / t_cur, FLOOR)) for label, r, c in pairs]
    s_ref, s_cur = sum(r for _, r, _ in floored), sum(c for _, _, c in floored)
    rows = [{"label": label, "share_ref": r / s_ref, "share_cur": c / s_cur} for label, r, c in floored]
    for d in rows:
        d["contribution"] = (d["share_cur"] - d["share_ref"]) * math.log(d["share_cur"] / d["share_ref"])
    return sum(d["contribution"] for d in rows), rows


def _top(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each place in an order; ranked in parts of each place first, so that no task sorts a whole column."""
    local = rows.withColumn("_cut", F.pmod(F.xxhash64("label"), F.lit(64)))
    local = local.withColumn("_r", F.row_number().over(Window.partitionBy("place", "_cut").orderBy(*order))).where(F.col("_r") <= k)
    return local.withColumn("_r", F.row_number().over(Window.partitionBy("place").orderBy(*order))).where(F.col("_r") <= k)


def compare_columns(reference: DataFrame, current: DataFrame, columns: list[str], rules: dict) -> list[ColumnDrift]:
    """Drift of columns that are of one kind on both sides."""
    if not columns:
        return []
    tagged, schema = sides(reference, current, columns), reference.schema
    numeric = [c for c in columns if isinstance(schema[c].dataType, NUMERIC)]
    facts = side_facts(tagged, columns, numeric)
    values = value_table(tagged, columns)
    try:
        distinct = {r.place: r.d for r in values.groupBy("place").agg(F.count("*").alias("d")).collect()}
        few = max(2, rules["numeric_bins"] // 2)
        kinds = {c: "numeric" if c in numeric and distinct.get(i, 0) > few else "categorical" for i, c in enumerate(columns)}
        held = {c: [facts[c][s]["count"] for s in ("reference", "current")] for c in columns}
        ready = [c for c in columns if min(held[c]) >= rules["min_samples"]]
        found = {c: ColumnDrift(c, NOT_COMPARABLE, kinds[c], statistics=facts[c], explanation=f"'{c}' has {held[c][0]} and {held[c][1]} values; {rules['min_samples']} are needed.") for c in columns}
        for c in ready:
            found[c] = ColumnDrift(c, STABLE, kinds[c], statistics=facts[c])
        place = {c: i for i, c in enumerate(columns)}
        _numbers(values, [found[c] for c in ready if kinds[c] == "numeric"], place, rules)
        whole = {i for c, i in place.items() if isinstance(schema[c].dataType, INTEGRAL)}
        _categories(values, [found[c] for c in ready if kinds[c] == "categorical"], place, whole, rules)
    finally:
        values.unpersist()
    for c in ready:
        d = found[c]
        d.status = classify(d.psi, rules)
        d.significant = None if d.p_value is None else d.p_value < rules["significance_level"]
        d.top_changes = sorted(d.distribution, key=lambda x: (-abs(x["contribution"]), x["label"]))[:MOST_CHANGES]
        d.explanation = explained(d)
        d.psi = round(d.psi, 6)
    return list(found.values())


def explained(d: ColumnDrift) -> str:
    """What moved, where most of it lies, what came and went, and what the test makes of it."""
    ref, cur = (d.statistics.get(s, {}) for s in ("reference", "current"))
    said = [f"'{d.column}' is stable (PSI {d.psi:.4f})" if d.status == STABLE else f"'{d.column}' drifts (PSI {d.psi:.4f}, {d.status.lower()})"]
    if d.kind == "numeric" and d.status != STABLE and ref.get("mean") is not None and cur.get("mean") is not None:
        way = "up" if cur["mean"] > ref["mean"] else "down"
        said.append(f"on average it went {way} from {ref['mean']:.4g} to {cur['mean']:.4g}, its middle value from {ref['median']:.4g} to {cur['median']:.4g}")
    if d.top_changes and d.top_changes[0]["contribution"]:
        most = d.top_changes[0]
        said.append(f"most of the change is in {most['label']}, {most['share_ref']:.1%} of the values before and {most['share_cur']:.1%} now")
    for what, names in (("new", d.new_values), ("gone", d.gone_values)):
        if names:
            said.append(f"{what}: {', '.join(names[:3])}" + (f" and {len(names) - 3} more" if len(names) > 3 else ""))
    if d.p_value is not None:
        if d.significant and d.status == STABLE:
            said.append(f"{d.test} finds a difference (p = {d.p_value:.3g}) too small to matter; so many values show it")
        elif not d.significant and d.status != STABLE:
            said.append(f"{d.test} does not bear this out (p = {d.p_value:.3g}), so it may be chance")
        else:
            said.append(f"{d.test} p = {d.p_value:.3g}")
    return "; ".join(said) + "."


def _numbers(values: DataFrame, found: list[ColumnDrift], place: dict[str, int], rules: dict) -> None:
    if not found:
        return
    bins, at = rules["numeric_bins"], {place[d.column]: d for d in found}
    mine = values.where(F.col("place").isin(list(at)))
    rows = {(i, s): d.statistics[name]["count"] for i, d in at.items() for s, name in enumerate(("reference", "current"))}
    cuts, quarters = [k / bins for k in range(bins + 1)], [0.25, 0.5, 0.75]
    read = quantiles_of(mine, {(i, s): (n, (cuts if s == 0 else []) + quarters) for (i, s), n in rows.items()})
    inner = {d.column: inner_edges(read[i, 0][: bins + 1]) for i, d in at.items()}
    number = F.lit(None).cast("int")
    for i, d in at.items():
        number = F.when(F.col("place") == i, bin_of(F.col("number"), inner[d.column])).otherwise(number)
    counted = {(r.place, r.bin): r for r in mine.groupBy("place", number.alias("bin")).agg(F.sum("n_ref").alias("r"), F.sum("n_cur").alias("c")).collect()}  # a row for each bin
    tests = {r.place: r for r in ks_of(mine).collect()}
    for i, d in at.items():
        cuts = [-math.inf, *inner[d.column], math.inf]
        labels = [f"[{a:g}, {b:g})" for a, b in zip(cuts, cuts[1:])]
        held = [counted.get((i, k)) for k in range(len(labels))]
        d.psi, d.distribution = _shares([(label, h.r if h else 0, h.c if h else 0) for label, h in zip(labels, held)])
        r = tests[i]
        d.test, d.statistic, d.p_value = "ks_2samp", round(r.statistic, 6), ks_tail(r.statistic, r.n_ref, r.n_cur)
        for s, name in enumerate(("reference", "current")):
            d.statistics[name] |= dict(zip(("q1", "median", "q3"), read[i, s][-3:]))


def _categories(values: DataFrame, found: list[ColumnDrift], place: dict[str, int], whole: set[int], rules: dict) -> None:
    if not found:
        return
    spark, at = values.sparkSession, {place[d.column]: d for d in found}
    label = F.when(F.col("place").isin(list(whole)), F.col("number").cast("bigint").cast("string")).otherwise(F.coalesce("text", F.col("number").cast("string")))
    mine = values.where(F.col("place").isin(list(at))).select("place", label.alias("label"), "n_ref", "n_cur")
    totals = [(i, float(d.statistics["reference"]["count"]), float(d.statistics["current"]["count"])) for i, d in at.items()]
    shares = mine.join(F.broadcast(spark.createDataFrame(totals, "place int, t_ref double, t_cur double")), "place").select("place", "label", "n_ref", "n_cur", F.greatest(F.col("n_ref") / F.col("t_ref"), F.lit(FLOOR)).alias("r"), F.greatest(F.col("n_cur") / F.col("t_cur"), F.lit(FLOOR)).alias("c"))
    turn = F.ln(F.col("c") / F.col("r"))
    # With shares summed to one again, the PSI is the one sum over its total less the other over its own.
    sums = {s.place: s for s in shares.groupBy("place").agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.sum(F.col("c") * turn).alias("ct"), F.sum(F.col("r") * turn).alias("rt")).collect()}
    tests = {r.place: r for r in chi_square_of(mine, rules["rare_category_threshold"]).collect()}
    scales = spark.createDataFrame([(i, s.r, s.c) for i, s in sums.items()], "place int, s_ref double, s_cur double")
    both = shares.join(F.broadcast(scales), "place").select("place", "label", "n_ref", "n_cur", (F.col("r") / F.col("s_ref")).alias("share_ref"), (F.col("c") / F.col("s_cur")).alias("share_cur"))
    both = both.withColumn("contribution", (F.col("share_cur") - F.col("share_ref")) * F.ln(F.col("share_cur") / F.col("share_ref")))
    for r in _top(both, [F.abs("contribution").desc(), F.col("label")], MOST_ROWS).orderBy("place", "_r").collect():
        at[r.place].distribution.append({"label": r["label"], "share_ref": r.share_ref, "share_cur": r.share_cur, "contribution": r.contribution})
    one_sided = both.where("n_ref = 0 OR n_cur = 0").withColumn("place", F.col("place") * 2 + (F.col("n_ref") == 0).cast("int"))
    for r in _top(one_sided, [(F.col("n_ref") + F.col("n_cur")).desc(), F.col("label")], MOST_NAMED).orderBy("place", "_r").collect():
        d = at[r.place // 2]
        (d.new_values if r.place % 2 else d.gone_values).append(r["label"])
    for i, d in at.items():
        s, t = sums[i], tests[i]
        d.psi = s.ct / s.c - s.rt / s.r
        if t.statistic is not None:
            d.test, d.statistic, d.p_value = "chi2_contingency", round(t.statistic, 6), chi_square_p(t.statistic, t.groups - 1)


def detect(reference: DataFrame, current: DataFrame, columns: list[str] | None = None, **rules) -> Drift:
    """Compare all shared columns and judge the whole."""
    rules = DEFAULTS | rules
    wanted = lambda c: not columns or c in columns
    shared = [c for c in reference.columns if c in current.columns and wanted(c)]
    removed = [c for c in reference.columns if c not in current.columns and wanted(c)]
    added = [c for c in current.columns if c not in reference.columns and wanted(c)]
    kinds = {c: [df.schema[c].dataType for df in (reference, current)] for c in shared}
    torn = [c for c in shared if isinstance(kinds[c][0], NUMERIC) != isinstance(kinds[c][1], NUMERIC)]
    found = [ColumnDrift(c, TYPE_CHANGED, "mismatch", explanation=f"'{c}' was {kinds[c][0].simpleString()} and is {kinds[c][1].simpleString()}; the values cannot be compared.") for c in torn]
    # Numbers as they are, NaN being a gap; all else as text.
    held = lambda df, c: F.nanvl(col(c), F.lit(None).cast("double")).alias(c) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else col(c) if isinstance(df.schema[c].dataType, NUMERIC) else col(c).cast("string").alias(c)
    as_text = lambda df, names: df.select(*[held(df, c) for c in names])
    same = [c for c in shared if c not in torn]
    found += compare_columns(as_text(reference, same), as_text(current, same), same, rules)
    for c in found:
        if c.status in (TYPE_CHANGED, NOT_COMPARABLE):
            continue
        before, after = (c.statistics[s]["missing_pct"] for s in ("reference", "current"))
        c.missing_ref, c.missing_cur = round(before, 2), round(after, 2)
        if abs(after - before) >= rules["missing_rate_points"]:
            c.missing_drift = True
            c.status = WARNING if c.status == STABLE else c.status
            c.explanation += f" Missing values went from {before:.1f} % to {after:.1f} %."
    scored = [c for c in found if c.psi is not None]
    critical = [c for c in scored if c.status == CRITICAL]
    drifted = [c for c in scored if c.status in (CRITICAL, WARNING)]
    share = len(drifted) / len(scored) if scored else 0.0
    status = STABLE
    if (critical and share >= rules["dataset_drift_share"]) or removed or torn:
        status = CRITICAL
    elif critical or share >= rules["dataset_warning_share"]:
        status = WARNING
    values = [c.psi for c in scored] or [0.0]
    return Drift(status, round(sum(values) / len(values), 6), max(values), sorted(found, key=lambda c: (SEVERITY[c.status], -(c.psi or 0))), removed, added)
