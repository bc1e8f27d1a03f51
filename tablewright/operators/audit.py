"""Quality findings, the health score that follows from them, and its grade."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import col
from .analyze import rank_ids
from .profile import Facts, gather_facts

# Thresholds, weights and grade bounds.
MISSING_SHARE, CORRELATED, LEAKING, DUPLICATE_PCT, OUTLIER_PCT = 0.5, 0.8, 0.95, 5.0, 5.0
WEIGHTS = {"completeness": 0.25, "uniqueness": 0.15, "consistency": 0.20, "accuracy": 0.25, "reliability": 0.15}
GRADES = [("A", 90), ("B", 75), ("C", 60), ("D", 40), ("F", 0)]
FINDING = "dimension string, severity string, column string, message string, value double"


@dataclass
class Finding:
    dimension: str
    severity: str
    column: str | None
    message: str
    value: float | None = None


def class_shares(df: DataFrame, target: str) -> DataFrame:
    """value, n and share of each class of a column, without nulls."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def find_problems(df: DataFrame, target: str | None = None, facts: Facts | None = None, missing_share: float = MISSING_SHARE, correlated: float = CORRELATED, rare: float | None = None) -> list[Finding]:
    """All findings, section by section.  ``rare`` turns on the check for rare categories."""
    facts = facts or gather_facts(df)
    found: list[Finding] = []
    columns = facts.columns.values()
    for c in columns:
        if c.nulls:
            share = c.nulls / facts.rows
            severity = "ERROR" if share >= 1 else "WARNING" if share > missing_share else "INFO"
            found.append(Finding("Completeness", severity, c.name, f"{c.nulls} of {facts.rows} values are missing ({c.null_pct:.2f} %).", c.null_pct))
    if facts.duplicates:
        pct = facts.duplicates / facts.rows * 100
        found.append(Finding("Uniqueness", "WARNING" if pct > DUPLICATE_PCT else "INFO", None, f"{facts.duplicates} rows repeat an earlier row ({pct:.2f} %).", round(pct, 4)))
    for c in facts.numeric():
        if c.distinct <= 1:
            continue
        if c.outliers:
            found.append(Finding("Accuracy", "WARNING" if c.outlier_pct > OUTLIER_PCT else "INFO", c.name, f"{c.outliers} values lie outside 1.5 interquartile ranges ({c.outlier_pct:.2f} %).", c.outlier_pct))
        if c.skewness is not None and abs(c.skewness) > 1.5:
            found.append(Finding("Consistency", "WARNING" if abs(c.skewness) > 3 else "INFO", c.name, f"Skewness is {c.skewness:.2f}.", round(c.skewness, 4)))
        if c.kurtosis is not None and abs(c.kurtosis) > 3:
            found.append(Finding("Consistency", "INFO", c.name, f"Excess kurtosis is {c.kurtosis:.2f}.", round(c.kurtosis, 4)))
    aim = facts.columns.get(target) if target else None
    if aim and aim.distinct > 1 and (aim.text or aim.boolean or aim.dtype in ("tinyint", "smallint", "int", "bigint")):
        least = class_shares(df, target).agg(F.min("share")).first()[0]
        if least < 0.10:
            found.append(Finding("Consistency", "WARNING" if least < 0.05 else "INFO", target, f"The smallest class has {least:.2%} of the rows.", round(least, 6)))
    for (a, b), r in facts.correlations.items():
        if r is not None and abs(r) > correlated:
            found.append(Finding("Reliability", "WARNING" if abs(r) > LEAKING else "INFO", a, f"'{a}' and '{b}' are correlated (r = {r:.4f}).", round(r, 4)))
    for c in columns:
        if c.distinct <= 1:
            found.append(Finding("Reliability", "WARNING", c.name, "The column has a single value or none."))
    if rare:
        for c in columns:
            if c.text and c.role == "categorical" and c.distinct > 1:
                n = class_shares(df, c.name).where(F.col("share") < rare).count()
                if n:
                    found.append(Finding("Consistency", "INFO", c.name, f"{n} categories each have less than {rare:.0%} of the values.", float(n)))
    if aim and aim.numeric:
        for (a, b), r in facts.correlations.items():
            if target in (a, b) and r is not None and abs(r) > LEAKING:
                other = b if a == target else a
                found.append(Finding("Reliability", "ERROR", other, f"'{other}' gives the target away (r = {r:.4f}).", round(r, 4)))
    return found


def findings_frame(df: DataFrame, findings: list[Finding]) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(asdict(f).values()) for f in findings], FINDING)


def audit(df: DataFrame, target: str | None = None, **options) -> DataFrame:
    return findings_frame(df, find_problems(df, target, **options))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


@dataclass
class Health:
    scores: dict[str, float]
    readiness: float
    overall: float
    grade: str
    reasons: list[str] = field(default_factory=list)


def grade_of(score: float) -> str:
    return next(letter for letter, least in GRADES if score >= least)


def health_of(facts: Facts, findings: list[Finding], target: str | None, weights: dict[str, float] = WEIGHTS) -> Health:
    def deducted(dimension: str, cost: dict[str, float]) -> float:
        return max(0.0, 100.0 - sum(cost.get(f.severity, cost["INFO"]) for f in findings if f.dimension == dimension))

    reasons = [f"{c.name}: {c.null_pct:.2f} % missing" for c in facts.columns.values() if c.nulls] + [f.message for f in findings if f.dimension != "Completeness"]
    repeated = facts.duplicates / facts.rows * 100 if facts.rows else 0.0
    scores = {
        "completeness": max(0.0, 100.0 - sum(c.null_pct * 0.5 for c in facts.columns.values())),
        "uniqueness": max(0.0, 100.0 - repeated * 2),
        "consistency": deducted("Consistency", {"WARNING": 15, "INFO": 5}),
        "accuracy": deducted("Accuracy", {"WARNING": 10, "INFO": 3}),
        "reliability": deducted("Reliability", {"ERROR": 20, "WARNING": 10, "INFO": 5}),
    }
    holed = [i for i in rank_ids(facts) if facts.columns[i["name"]].nulls]
    readiness = max(0.0, 100.0 - (0 if target else 20) - 10 * len(holed))
    total = sum(weights.values()) or 1.0
    overall = max(0.0, sum(scores[k] * w for k, w in weights.items()) / total - (100 - readiness) * 0.1)
    return Health(scores, readiness, round(overall, 2), grade_of(round(overall, 2)), reasons)


def health(df: DataFrame, target: str | None = None) -> Health:
    facts = gather_facts(df)
    return health_of(facts, find_problems(df, target, facts), target)


def health_frame(df: DataFrame, target: str | None = None) -> DataFrame:
    h = health(df, target)
    row = (*h.scores.values(), h.readiness, h.overall, h.grade)
    return df.sparkSession.createDataFrame([tuple(round(x, 2) if isinstance(x, float) else x for x in row)], ", ".join(f"{k} double" for k in h.scores) + ", readiness double, overall double, grade string")
