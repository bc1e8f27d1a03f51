"""Cleaning a table when it is loaded: decide with one aggregate, rewrite with one projection."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import col, fields_of, nan_as_null, text_columns
from ..functions.texts import DATE_SHAPE, FREE_TEXT_CHARS, FREE_TEXT_WORDS, SOMETIMES_MISSING, TEMPORAL_NAME, TEMPORAL_SHAPE, always_missing, ambiguous, casing, dates_of, form_of_shape, leading_zero, number_of, sometimes_missing, shape_of, squeezed, token, word_count

PARSED_SHARE = 0.9
ACTION = "step string, column string, detail string, count long"


@dataclass
class Cleaned:
    df: DataFrame
    actions: list[tuple[str, str, str, int]] = field(default_factory=list)

    def add(self, step: str, column: str, detail: str, count: int) -> None:
        self.actions.append((step, column, detail, int(count)))

    def frame(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame(self.actions, ACTION)


def clean_names(df: DataFrame, out: Cleaned | None = None) -> DataFrame:
    """Names without byte-order mark and outer or doubled white space; repeated ones get a number."""
    names, seen = [], {}
    for old in df.columns:
        name = re.sub(r"\s+", " ", old.replace("﻿", "").strip())
        base, k = name, seen.get(name, 0)
        while name in names:
            k += 1
            name = f"{base}_{k}"
        seen[base] = k
        names.append(name)
        if out is not None and name != old:
            out.add("normalize_header", name, f"'{old}' became '{name}'.", 1)
    return df.toDF(*names)


def drop_index_columns(df: DataFrame, out: Cleaned | None = None) -> DataFrame:
    """Drop ``Unnamed: n`` columns that are empty or count the rows from 0 or 1."""
    suspects = [c for c in df.columns if re.fullmatch(r"Unnamed: \d+|_c\d+", c)]
    if not suspects:
        return df
    value = lambda c: col(c).try_cast("double")
    r = df.agg(F.count("*").alias("_rows"), *[F.struct(F.count(col(c)).alias("held"), F.count(value(c)).alias("numbers"), F.count_distinct(value(c)).alias("distinct"), F.min(value(c)).alias("least"), F.count_if(value(c) % 1 != 0).alias("broken")).alias(c) for c in suspects]).first()
    gone = [c for c in suspects if r[c].held == 0 or (r[c].held == r[c].numbers == r[c].distinct == r["_rows"] and r[c].broken == 0 and r[c].least in (0, 1))]
    for c in gone:
        if out is not None:
            out.add("drop_index", c, "An index that was written with the table.", r["_rows"])
    return df.drop(*gone)


def null_sentinels(df: DataFrame, out: Cleaned | None = None, force: tuple[str, ...] = (), preserve: tuple[str, ...] = ()) -> DataFrame:
    """Disguised gaps become nulls.

    Ambiguous tokens only where they are in capitals and the column's own
    values, these tokens aside, mostly are not; never in prose.
    """
    texts = text_columns(df)
    if not texts:
        return df
    force_tokens, kept_tokens = [t.strip().lower() for t in force], [t.strip().lower() for t in preserve]
    convention = lambda c: F.mode(F.when(~sometimes_missing(col(c)) & (casing(col(c)) != "none"), casing(col(c))), True)
    facts = df.agg(*[F.struct(convention(c).alias("casing"), F.avg(word_count(col(c))).alias("words"), F.avg(F.length(col(c))).alias("chars")).alias(f"t{i}") for i, c in enumerate(texts)]).first()
    gaps, kept = {}, {}
    for i, c in enumerate(texts):
        f = facts[i]
        prose = f.words is not None and (f.words >= FREE_TEXT_WORDS or f.chars >= FREE_TEXT_CHARS)
        doubtful = sometimes_missing(col(c)) & (casing(col(c)) == "upper") if f.casing not in (None, "upper") and not prose else F.lit(False)
        gap = always_missing(col(c)) | doubtful
        if force_tokens:
            gap |= token(col(c)).isin(force_tokens)
        if kept_tokens:
            gap &= ~token(col(c)).isin(kept_tokens)
        gaps[c], kept[c] = gap, sometimes_missing(col(c)) & ~gap
    if out is not None:
        n = df.agg(*[F.count_if(gaps[c]).alias(f"g{i}") for i, c in enumerate(texts)], *[F.count_if(kept[c]).alias(f"k{i}") for i, c in enumerate(texts)]).first()
        for i, c in enumerate(texts):
            if n[f"g{i}"]:
                out.add("normalize_sentinels", c, "Disguised gaps became nulls.", n[f"g{i}"])
            if n[f"k{i}"]:
                out.add("preserve_ambiguous_value", c, "Values that may stand for a gap were kept.", n[f"k{i}"])
    return df.select(*[F.when(~gaps[c], col(c)).alias(c) if c in gaps else col(c) for c in df.columns])


def strip_text(df: DataFrame, out: Cleaned | None = None) -> DataFrame:
    texts = set(text_columns(df))
    if out is not None and texts:
        order = [c for c in df.columns if c in texts]
        n = df.agg(*[F.count_if(col(c) != squeezed(col(c))).alias(f"s{i}") for i, c in enumerate(order)]).first()
        for i, c in enumerate(order):
            if n[i]:
                out.add("strip_whitespace", c, "Outer and doubled white space was taken out.", n[i])
    return df.select(*[squeezed(col(c)).alias(c) if c in texts else col(c) for c in df.columns])


def parse_numbers(df: DataFrame, out: Cleaned | None = None) -> DataFrame:
    """Text columns of which nine tenths write a number, and none has a leading zero, become numbers."""
    texts = text_columns(df)
    if not texts:
        return df
    read = df.select(*[col(c) for c in texts], *[number_of(col(c)).alias(f"_n{i}") for i, c in enumerate(texts)])  # each value is read once
    facts = read.agg(*[F.struct(F.count(col(c)).alias("held"), F.count(f"_n{i}").alias("parsed"), F.count_if(leading_zero(col(c))).alias("zeros"), F.count_if(F.col(f"_n{i}") % 1 != 0).alias("broken"), F.count_if(~F.trim(col(c)).endswith("%")).alias("plain")).alias(f"p{i}") for i, c in enumerate(texts)]).first()
    kinds = {}
    for i, c in enumerate(texts):
        f = facts[i]
        if f.held and not f.zeros and f.parsed >= PARSED_SHARE * f.held:
            kinds[c] = "bigint" if f.parsed and not f.broken and f.plain else "double"
            if out is not None:
                out.add("coerce_numeric", c, f"Text became {'integer' if kinds[c] == 'bigint' else 'numeric'}; {f.held - f.parsed} values could not be read.", f.held)
    return df.select(*[number_of(col(c)).try_cast(kinds[c]).alias(c) if c in kinds else col(c) for c in df.columns])


def date_forms(df: DataFrame, texts: list[str]) -> dict[str, dict[str, str | None]]:
    """For each text column, the form of each shape that its dates have.

    Shapes are counted in one pass; there are few shapes of dates, so they come to
    the driver.  Where day and month could change places, the day comes first if
    the column has first numbers above 12 and no such second one; it has no single
    form if it has both; else the month comes first.
    """
    shape = lambda c: shape_of(col(c))
    number = lambda c, k: F.regexp_extract(F.trim(col(c)), r"^(\d{1,2})[-/.](\d{1,2})[-/.]", k).try_cast("int")
    cells = [F.struct(F.lit(i).alias("i"), shape(c).alias("shape"), number(c, 1).alias("one"), number(c, 2).alias("two")) for i, c in enumerate(texts)]
    rows = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where(F.col("shape").rlike(DATE_SHAPE))
    facts = rows.groupBy("i", "shape").agg(F.max("one").alias("one"), F.max("two").alias("two")).collect()
    found: dict[str, dict[str, str | None]] = {c: {} for c in texts}
    for i, c in enumerate(texts):
        own = [r for r in facts if r.i == i]
        first, second = (any((r[k] or 0) > 12 for r in own if ambiguous(r.shape)) for k in ("one", "two"))
        for r in own:
            found[c][r.shape] = None if ambiguous(r.shape) and first and second else form_of_shape(r.shape, first)
    return found


def parse_timestamps(df: DataFrame, out: Cleaned | None = None) -> DataFrame:
    """Text columns that look like dates, or are named so, and of which nine tenths read as such, become timestamps; each value is read once."""
    texts = text_columns(df)
    if not texts:
        return df
    forms = date_forms(df, texts)
    dates = {c: dates_of(col(c), forms[c]) for c in texts}
    facts = df.agg(*[F.struct(F.count(col(c)).alias("held"), F.count(dates[c]).alias("parsed"), F.count_if(col(c).rlike(TEMPORAL_SHAPE)).alias("shaped"), F.count_if(~F.trim(col(c)).rlike(r"^\d+$")).alias("not_digits")).alias(f"d{i}") for i, c in enumerate(texts)]).first()
    dated = []
    for i, c in enumerate(texts):
        f, named = facts[i], bool(re.search(TEMPORAL_NAME, c, re.IGNORECASE))
        looks = f.shaped >= PARSED_SHARE * f.held and f.not_digits > 0
        if f.held and (named or looks) and f.parsed >= PARSED_SHARE * f.held:
            dated.append(c)
            if out is not None:
                out.add("coerce_datetime", c, f"Text became a timestamp; {f.held - f.parsed} values could not be read.", f.held)
    return df.select(*[dates[c].alias(c) if c in dated else col(c) for c in df.columns])


def narrow_whole_floats(df: DataFrame, out: Cleaned | None = None) -> DataFrame:
    """Doubles with gaps whose values are all whole become integers."""
    floats = fields_of(df, T.FloatType, T.DoubleType)
    if not floats:
        return df
    facts = df.agg(F.count("*").alias("_rows"), *[F.struct(F.count(col(c)).alias("held"), F.count_if(col(c) % 1 != 0).alias("broken"), F.max(F.abs(col(c))).alias("most")).alias(f"f{i}") for i, c in enumerate(floats)]).first()
    whole = [c for i, c in enumerate(floats) if 0 < facts[i + 1].held < facts["_rows"] and not facts[i + 1].broken and facts[i + 1].most < 2**63 - 1]
    for c in whole:
        if out is not None:
            out.add("restore_integer", c, "All values are whole; the column became integer.", facts["_rows"])
    return df.select(*[col(c).cast("bigint").alias(c) if c in whole else col(c) for c in df.columns])


def drop_empty(df: DataFrame, out: Cleaned | None = None) -> DataFrame:
    """Columns, then rows, without any value."""
    held = df.agg(*[F.count(col(c)).alias(f"h{i}") for i, c in enumerate(df.columns)]).first()
    gone = [c for i, c in enumerate(df.columns) if not held[i]]
    kept = df.drop(*gone)
    if not kept.columns:
        return kept
    blank = F.coalesce(*[col(c).isNull() for c in kept.columns[:1]])
    for c in kept.columns[1:]:
        blank &= col(c).isNull()
    if out is not None:
        for c in gone:
            out.add("drop_empty_column", c, "The column has no values.", 1)
        n = kept.agg(F.count_if(blank)).first()[0]
        if n:
            out.add("drop_empty_rows", "", "Rows without any value were dropped.", n)
    return kept.where(~blank)


def clean(df: DataFrame, sentinels: bool = True, whitespace: bool = True, numbers: bool = True, timestamps: bool = True, empties: bool = True, force: tuple[str, ...] = (), preserve: tuple[str, ...] = ()) -> Cleaned:
    """All steps in their order, with a record of what each did."""
    out = Cleaned(df)
    now = drop_index_columns(clean_names(nan_as_null(df), out), out)
    if sentinels:
        now = null_sentinels(now, out, force, preserve)
    if whitespace:
        now = strip_text(now, out)
    if numbers:
        now = parse_numbers(now, out)
    if timestamps:
        now = parse_timestamps(now, out)
    if numbers:
        now = narrow_whole_floats(now, out)
    if empties:
        now = drop_empty(now, out)
    out.df = now
    return out


def residual_sentinels(df: DataFrame) -> DataFrame:
    """column and n of cells that still hold any token that may stand for a gap."""
    texts = text_columns(df)
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, n long")
    one = df.agg(*[F.count_if(always_missing(col(c)) | token(col(c)).isin(SOMETIMES_MISSING)).alias(f"r{i}") for i, c in enumerate(texts)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("n")) for i, c in enumerate(texts)])
    return one.select(F.explode(cells).alias("c")).select("c.*").where("n > 0")
