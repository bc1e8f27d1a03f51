"""Thresholds from a YAML file: defaults, then the file, then arguments."""

from __future__ import annotations

from typing import Any

from ..operators import audit, drift


def read_params(path: str | None) -> dict[str, Any]:
    if not path:
        return {}
    import yaml

    with open(path, encoding="utf-8") as file:
        return (yaml.safe_load(file) or {}).get("data", {})


def drift_rules(path: str | None = None, **arguments) -> dict[str, float]:
    held = read_params(path).get("drift", {})
    return drift.DEFAULTS | {k: v for k, v in held.items() if k in drift.DEFAULTS} | arguments


def audit_options(path: str | None = None, **arguments) -> dict[str, float]:
    held = read_params(path)
    found = {"missing_share": held.get("ingestion", {}).get("missing_threshold", audit.MISSING_SHARE), "correlated": held.get("profiling", {}).get("correlation_threshold", audit.CORRELATED)}
    return found | arguments


def health_weights(path: str | None = None) -> dict[str, float]:
    """``timeliness`` in a file stands for reliability."""
    held = read_params(path).get("quality", {}).get("health_score_weights", {})
    named = {"reliability" if k == "timeliness" else k: float(v) for k, v in held.items()}
    return audit.WEIGHTS | {k: v for k, v in named.items() if k in audit.WEIGHTS}
