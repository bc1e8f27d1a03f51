"""Exact quantiles of many columns at once, in bounded memory and without a sort.

A sketch brackets the wanted ranks, the rows inside the brackets are counted, and
the brackets are narrowed until few distinct values are left in them; only these
come to the driver.  A pass shrinks a bracket some thousand times, so that tables
of any size take few passes.  Should a sketch not shrink any bracket, brackets are
cut into equal cells instead, whose counts do.

NaN counts as a gap.  Infinities are values; between one and a finite value the
infinity is returned, between both NaN.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketch, and most distinct values of a bracket that come to the driver.
ACCURACY, MOST_VALUES = 2_000, 2_000
#: Cells of a bracket that a sketch did not shrink, and sketches in one aggregate.
CELLS, TOGETHER = 1_024, 100
LARGEST = sys.float_info.max


@dataclass
class Bracket:
    name: str
    rank: int  # of the lower of the two values that the quantile lies between, from 0
    part: float  # share of the way to the next value
    low: float
    high: float
    below: int = 0
    inside: int = 0

    def holds(self, x: Column) -> Column:
        return (x >= self.low) & (x <= self.high)


def exact_quantiles(df: DataFrame, values: dict[str, Column], shares: list[float]) -> dict[str, list[float]]:
    """For each named expression, its quantiles by linear interpolation, nulls left out; an empty list without values."""
    if not values:
        return {}
    values = {name: F.nanvl(x.cast("double"), F.lit(None).cast("double")) for name, x in values.items()}
    one = df.agg(*[F.struct(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).alias(f"v{i}") for i, x in enumerate(values.values())]).first()
    every: list[Bracket] = []
    for i, name in enumerate(values):
        for share in shares if one[i].n else ():
            at = share * (one[i].n - 1)
            every.append(Bracket(name, math.floor(at), at - math.floor(at), one[i].low, one[i].high, 0, one[i].n))
    wide = [b for b in every if b.low < b.high]
    while wide:
        distinct = df.agg(*[F.approx_count_distinct(F.when(b.holds(values[b.name]), values[b.name])).alias(f"d{i}") for i, b in enumerate(wide)]).first()
        wide = [b for i, b in enumerate(wide) if distinct[i] > MOST_VALUES]
        if not wide:
            break
        margin = 2 / ACCURACY
        at = [[max(0.0, (b.rank - b.below) / b.inside - margin), min(1.0, (b.rank + 1 - b.below) / b.inside + margin)] for b in wide]
        cuts = df.agg(*[F.percentile_approx(F.when(b.holds(values[b.name]), values[b.name]), F.array(*map(F.lit, a)), ACCURACY).alias(f"c{i}") for i, (b, a) in enumerate(zip(wide, at))]).first()
        # Where the rank is near a bracket's end, that end stays.
        ends = [(b.low if a[0] == 0 else c[0], b.high if a[1] == 1 else c[1]) for b, a, c in zip(wide, at, cuts)]
        tried = [Bracket(b.name, b.rank, b.part, low, high) for b, (low, high) in zip(wide, ends)]
        counts = df.agg(*[F.struct(F.count_if(values[b.name] < b.low).alias("below"), F.count_if(b.holds(values[b.name])).alias("inside")).alias(f"n{i}") for i, b in enumerate(tried)]).first()
        moved = False
        for b, t, n in zip(wide, tried, counts):
            if n.below <= b.rank and b.rank + (b.part > 0) < n.below + n.inside and n.inside < b.inside:
                b.low, b.high, b.below, b.inside, moved = t.low, t.high, n.below, n.inside, True
        if not moved:
            _narrow_by_cells(df, values, wide)
        wide = [b for b in wide if b.low < b.high]
    found: dict[int, list[tuple[float, int]]] = {}
    open_ones = [i for i, b in enumerate(every) if b.low < b.high]
    if open_ones:
        cells = F.array(*[F.when(every[i].holds(values[every[i].name]), F.struct(F.lit(i).alias("i"), values[every[i].name].alias("x"))) for i in open_ones])
        inside = df.select(F.explode(cells).alias("c")).where("c IS NOT NULL").groupBy("c.i", "c.x").agg(F.count("*").alias("n"))
        for r in inside.collect():  # about MOST_VALUES rows for each bracket
            found.setdefault(r.i, []).append((r.x, r.n))
    out: dict[str, list[float]] = {name: [] for name in values}
    for i, b in enumerate(every):
        low = high = b.low
        upto = b.below
        for x, n in sorted(found.get(i, [])):
            if upto <= b.rank < upto + n:
                low = x
            if upto <= b.rank + (b.part > 0) < upto + n:
                high = x
            upto += n
        out[b.name].append(between(low, high, b.part) if i in found else b.low)
    return out


def between(low: float, high: float, part: float) -> float:
    if part == 0 or low == high:
        return low
    return low + high if math.isinf(low) or math.isinf(high) else low + (high - low) * part


def _narrow_by_cells(df: DataFrame, values: dict[str, Column], wide: list[Bracket]) -> None:
    """Cut each bracket into cells of equal width and keep those that hold its ranks; infinities have cells of their own."""
    def cell(b: Bracket) -> Column:
        x, low, high = values[b.name], max(b.low, -LARGEST), min(b.high, LARGEST)
        at = F.floor((x / 2 - low / 2) / (high / 2 - low / 2) * CELLS).cast("int")  # halves, so that no difference overflows
        return F.when(x < low, F.lit(-1)).when(x > high, F.lit(CELLS + 1)).otherwise(at)

    cells = F.array(*[F.when(b.holds(values[b.name]), F.struct(F.lit(i).alias("i"), cell(b).alias("c"), values[b.name].alias("x"))) for i, b in enumerate(wide)])
    rows = df.select(F.explode(cells).alias("v")).where("v IS NOT NULL").groupBy("v.i", "v.c").agg(F.count("*").alias("n"), F.min("v.x").alias("low"), F.max("v.x").alias("high"))
    counts: dict[int, list] = {}
    for r in rows.collect():  # at most CELLS + 3 rows for each bracket
        counts.setdefault(r.i, []).append((r.c, r.n, r.low, r.high))
    for i, b in enumerate(wide):
        kept, upto = [], b.below
        for _, n, low, high in sorted(counts[i]):
            if upto <= b.rank + (b.part > 0) and upto + n > b.rank:
                kept.append((upto, n, low, high))
            upto += n
        b.below, b.inside, b.low, b.high = kept[0][0], sum(k[1] for k in kept), kept[0][2], kept[-1][3]
