"""Roles of columns and kind of a table, by rules over gathered facts."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame

from .profile import ColumnFacts, Facts, gather_facts

# Names that make a column a label, or an identifier.
TARGET_NAMES = {"target", "label", "class", "score", "outcome", "y", "result", "prediction", "category", "type"}
NOT_TARGET_PREFIXES = ("id", "uuid", "key", "hash", "identifier", "index")
ID_NAMES = {"id", "uuid", "key", "hash", "identifier", "index", "row_id", "record_id", "dataset_id", "sample_id", "user_id", "item_id", "product_id", "transaction_id"}


def is_target_candidate(c: ColumnFacts) -> bool:
    name = c.name.lower().strip()
    if c.distinct <= 1 or name.startswith(NOT_TARGET_PREFIXES):
        return False
    few = c.distinct == 2 or (3 <= c.distinct <= 10 and not (c.numeric or c.boolean))
    return few or name in TARGET_NAMES or name.startswith(("target", "label"))


def is_id_candidate(c: ColumnFacts, rows: int) -> bool:
    if rows == 0:
        return False
    return c.name.lower().strip() in ID_NAMES or (c.distinct > 1 and c.distinct / rows >= 0.95)


def rank_targets(facts: Facts) -> list[dict]:
    found = []
    for c in facts.columns.values():
        if not is_target_candidate(c):
            continue
        score = 0.5 + {"binary": 0.3, "boolean": 0.25, "numeric": 0.1}.get(c.category, 0.0) + 0.1 * (c.distinct <= 2) + 0.1 * (c.null_pct < 10)
        found.append({"name": c.name, "confidence": round(min(score, 1.0), 4), "task": "classification" if c.distinct <= 10 else "regression", "distinct": c.distinct})
    return sorted(found, key=lambda t: -t["confidence"])


def rank_ids(facts: Facts) -> list[dict]:
    found = [{"name": c.name, "confidence": round(min(1.0, 0.5 + 0.3 * (c.distinct > 0) + 0.1 * (c.nulls == 0)), 4), "distinct": c.distinct} for c in facts.columns.values() if is_id_candidate(c, facts.rows)]
    return sorted(found, key=lambda t: -t["confidence"])


def features_of(facts: Facts) -> list[str]:
    return [c.name for c in facts.columns.values() if not is_id_candidate(c, facts.rows) and c.category != "constant" and c.nulls < facts.rows]


def table_kind(facts: Facts) -> str:
    targets = rank_targets(facts)
    if any(t["task"] == "classification" for t in targets):
        return "classification"
    if targets:
        return "regression"
    if facts.rows > 10 and any(c.category == "datetime" for c in facts.columns.values()):
        return "time_series"
    return "unsupervised" if len(facts.columns) >= 2 and facts.rows >= 10 else "unknown"


def analyze(df: DataFrame, facts: Facts | None = None) -> dict:
    """Summary of a table: shape, columns, gaps, duplicates, candidates and kind."""
    facts = facts or gather_facts(df)
    cells = facts.rows * len(facts.columns)
    missing = sum(c.nulls for c in facts.columns.values())
    return {
        "rows": facts.rows,
        "columns": [vars(c) for c in facts.columns.values()],
        "categories": dict(Counter(c.category for c in facts.columns.values())),
        "missing": {"cells": cells, "missing": missing, "pct": round(missing / cells * 100, 2) if cells else 0.0, "columns": [{"column": c.name, "missing": c.nulls, "pct": c.null_pct} for c in sorted(facts.columns.values(), key=lambda c: -c.null_pct) if c.nulls]},
        "duplicates": {"rows": facts.duplicates, "pct": round(facts.duplicates / facts.rows * 100, 2) if facts.rows else 0.0},
        "targets": rank_targets(facts),
        "ids": rank_ids(facts),
        "features": features_of(facts),
        "kind": table_kind(facts),
    }
