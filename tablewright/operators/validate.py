"""Declared schemas, expectations drawn from a table's own facts, and the validation score."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import col
from .audit import LEAKING
from .analyze import rank_ids
from .profile import Facts, distinct_counts, duplicate_count, gather_facts, top_values

#: Physical types that each declared kind allows.
KINDS = {
    "integer": ("tinyint", "smallint", "int", "bigint"),
    "float": ("float", "double", "decimal"),
    "categorical": ("string", "boolean"),
    "datetime": ("date", "timestamp", "timestamp_ntz"),
    "text": ("string",),
    "boolean": ("boolean",),
}
CHECK = "check string, column string, observed double, passed boolean"


@dataclass
class ExpectedColumn:
    name: str
    type: str = "auto"
    nullable: bool = True
    unique: bool = False


@dataclass
class Schema:
    columns: list[ExpectedColumn] = field(default_factory=list)
    min_rows: int = 10
    max_rows: int = 10_000_000
    max_missing_fraction: float = 1.0
    max_duplicate_fraction: float = 1.0

    @classmethod
    def of(cls, df: DataFrame) -> Schema:
        """The schema that a reference table itself has: kinds, nullability, uniqueness."""
        facts = gather_facts(df)

        def kind(dtype: str) -> str:
            return next((k for k in ("integer", "float", "datetime", "boolean", "text") if dtype.startswith(KINDS[k])), "auto")

        return cls([ExpectedColumn(c.name, kind(c.dtype), c.nulls > 0, c.nulls == 0 and c.distinct == facts.rows > 0) for c in facts.columns.values()], min_rows=1)


def check_schema(df: DataFrame, schema: Schema) -> list[tuple]:
    """Rows (check, column, observed, passed); one aggregate over the table."""
    present = dict(df.dtypes)
    known = [c for c in schema.columns if c.name in present]
    facts = df.agg(F.count("*").alias("_rows"), *[F.count_if(col(c.name).isNull()).alias(f"n{i}") for i, c in enumerate(known)]).first()
    rows = facts["_rows"]
    found = [("min_rows", None, float(rows), rows >= schema.min_rows), ("max_rows", None, float(rows), rows <= schema.max_rows)]
    found += [("missing_column", c.name, None, c.name in present) for c in schema.columns]
    expected = {c.name for c in schema.columns}
    if schema.columns:
        found += [("unexpected_column", c, None, False) for c in present if c not in expected]
    unique = [c for c in known if c.unique]
    repeats: dict[str, int] = {}
    for c in unique:  # null counts as a value
        repeats[c.name] = df.groupBy(col(c.name).alias("v")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
    for i, c in enumerate(known):
        if c.type != "auto":
            allowed = KINDS.get(c.type, (c.type,))
            found.append(("type", c.name, None, present[c.name].startswith(allowed) or any(present[c.name] in a for a in allowed)))
        if not c.nullable:
            found.append(("not_null", c.name, float(facts[f"n{i}"]), facts[f"n{i}"] == 0))
        if c.unique:
            found.append(("unique", c.name, float(repeats[c.name]), repeats[c.name] == 0))
    if schema.max_missing_fraction < 1 and known:
        share = sum(facts[f"n{i}"] for i in range(len(known))) / max(1, rows * len(known))
        found.append(("missing_fraction", None, share, share <= schema.max_missing_fraction))
    if schema.max_duplicate_fraction < 1:
        share = duplicate_count(df).first().duplicates / max(1, rows)
        found.append(("duplicate_fraction", None, share, share <= schema.max_duplicate_fraction))
    return found


@dataclass
class Expectation:
    """A check drawn from one table that any table can be held against."""

    check: str
    column: str | None
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()


#: Text columns of up to so many values are expected to keep to them.
MOST_VALUES = 20
BOOLEAN_WORDS = ("true", "false", "1", "0")


def expectations(df: DataFrame, facts: Facts) -> list[Expectation]:
    """What a table's own facts lead one to expect of it and of its next versions."""
    ids = {i["name"] for i in rank_ids(facts)}
    few = [c.name for c in facts.columns.values() if c.text and c.role == "categorical" and 0 < c.distinct <= MOST_VALUES]
    held: dict[str, list[str]] = {}
    for r in top_values(df, few, MOST_VALUES).collect() if few else ():  # at most MOST_VALUES rows a column
        held.setdefault(r["column"], []).append(r["value"])
    found: list[Expectation] = []
    for c in facts.columns.values():
        found.append(Expectation("not_null_mostly", c.name, low=max(0.0, 1 - c.null_pct / 100)))
        found.append(Expectation("two_values", c.name, low=2))
        if c.name in ids:
            found.append(Expectation("id_unique", c.name))
        if c.category == "text":
            found.append(Expectation("not_blank", c.name))
        if c.numeric:
            found.append(Expectation("number_type", c.name))
            if c.min is not None:
                reach = 3 * c.std if c.std else 1.0
                found.append(Expectation("in_range", c.name, c.min - reach, c.max + reach))
            if c.std:
                found.append(Expectation("spread", c.name, low=1e-4))
        elif c.boolean:
            found.append(Expectation("boolean_set", c.name, values=BOOLEAN_WORDS))
        elif c.temporal:
            found.append(Expectation("time_type", c.name))
        elif c.name in held:
            found.append(Expectation("value_set", c.name, values=tuple(sorted(held[c.name]))))
    return [*found, Expectation("some_rows", None, low=1), Expectation("column_order", None, values=tuple(facts.columns))]


def check_expectations(df: DataFrame, suite: list[Expectation]) -> list[tuple]:
    """Rows (check, column, observed, passed): one aggregate and one count of distinct values, for any number of checks.

    A check of a column that the table does not have fails.
    """
    kinds = dict(df.dtypes)
    of = lambda *checks: [e for e in suite if e.check in checks and e.column in kinds]
    number = lambda e: col(e.column).try_cast("double")
    word = lambda e: F.lower(col(e.column).cast("string")) if e.check == "boolean_set" else col(e.column).cast("string")
    counts = {
        "held": lambda e: F.count(col(e.column)),
        "in_range": lambda e: F.count_if((number(e) < e.low) | (number(e) > e.high)),
        "spread": lambda e: F.stddev_samp(number(e)),
        "not_blank": lambda e: F.count_if(col(e.column).cast("string").rlike(r"^\s+$")),
        "sets": lambda e: F.count_if(~word(e).isin(list(e.values))),
    }
    asked = [(e, "in_range") for e in of("in_range")] + [(e, "spread") for e in of("spread")] + [(e, "not_blank") for e in of("not_blank")] + [(e, "sets") for e in of("boolean_set", "value_set")]
    asked += [(e, "held") for e in of("not_null_mostly", "id_unique")]
    one = df.agg(F.count("*").alias("_rows"), *[counts[how](e).alias(f"x{i}") for i, (e, how) in enumerate(asked)]).first()
    seen = {(e.check, e.column): one[f"x{i}"] for i, (e, _) in enumerate(asked)}
    distinct_of = sorted({e.column for e in of("two_values", "id_unique")})
    distinct = {r["column"]: r["distinct"] for r in distinct_counts(df, distinct_of).collect()} if distinct_of else {}
    rows, found = one["_rows"], []
    for e in suite:
        c, x = e.column, seen.get((e.check, e.column))
        if e.check == "some_rows":
            found.append((e.check, None, float(rows), rows >= e.low))
        elif e.check == "column_order":
            found.append((e.check, None, float(len(df.columns)), tuple(df.columns) == e.values))
        elif c not in kinds:
            found.append((e.check, c, None, False))
        elif e.check == "not_null_mostly":
            share = x / rows if rows else 0.0
            found.append((e.check, c, share, share >= e.low - 1e-4))
        elif e.check in ("two_values", "id_unique"):
            n = distinct.get(c, 0)
            found.append((e.check, c, float(n), n >= 2 if e.check == "two_values" else n == x))
        elif e.check in ("number_type", "time_type"):
            allowed = KINDS["integer"] + KINDS["float"] if e.check == "number_type" else KINDS["datetime"] + KINDS["text"]
            found.append((e.check, c, None, kinds[c].startswith(allowed)))
        elif e.check == "spread":
            found.append((e.check, c, x, x is not None and x >= e.low))
        else:
            found.append((e.check, c, float(x), x == 0))
    return found


def own_issues(facts: Facts, target: str | None) -> list[tuple[str, str]]:
    """Problems beyond the expectations: (kind, column)."""
    found = [("empty", c.name) for c in facts.columns.values() if c.nulls == facts.rows]
    found += [("mixed", c.name) for c in facts.columns.values() if c.text and c.classes > 1]
    found += [("blank", c.name) for c in facts.columns.values() if c.blanks]
    found += [("low variance", c.name) for c in facts.columns.values() if c.numeric and c.std and 0 < c.std < 1e-4]
    if target and target in facts.columns and facts.columns[target].numeric:
        found += [("leakage", b if a == target else a) for (a, b), r in facts.correlations.items() if target in (a, b) and r is not None and abs(r) > LEAKING]
    return found


ADVICE = {
    "empty": "Drop '{0}': it has no values.",
    "mixed": "Bring the values of '{0}' to one type.",
    "blank": "Turn the blank cells of '{0}' into gaps.",
    "low variance": "Drop '{0}': its values hardly differ.",
    "leakage": "Leave '{0}' out of the features: it gives the target away.",
}


@dataclass
class Validation:
    checks: list[tuple]
    issues: list[tuple[str, str]]
    score: float
    success: bool
    recommendations: list[str]

    def frame(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(self.checks, CHECK)


def validate(df: DataFrame, target: str | None = None, schema: Schema | None = None, suite: list[Expectation] | None = None) -> Validation:
    """Schema, expectations and own issues; 100 for all checks passed, less five for each issue.

    ``suite`` holds the expectations of another version; without it, the table's own are checked.
    """
    facts = gather_facts(df)
    if facts.rows == 0:
        raise ValueError("an empty table cannot be validated")
    of_schema = check_schema(df, schema) if schema else []
    errors = [c for c in of_schema if not c[3] and c[0] != "unexpected_column"]
    expected = check_expectations(df, suite or expectations(df, facts))
    passed, total = sum(c[3] for c in expected) + (not errors), len(expected) + len(errors) + 1
    issues = own_issues(facts, target)
    score = round(max(0.0, min(100.0, passed / total * 100 - 5 * len(issues))), 2)
    failed = total - passed
    advice = [ADVICE[kind].format(c) for kind, c in issues] + [f"Check '{c[1]}': {c[0]} does not hold." for c in [*errors, *expected] if not c[3] and c[1]]
    return Validation([*of_schema, *expected], issues, score, failed == 0 and score >= 90, list(dict.fromkeys(advice)))
