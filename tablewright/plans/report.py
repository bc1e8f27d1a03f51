"""Reports of a run as JSON and as one HTML page."""

from __future__ import annotations

import html
import json
import os
from dataclasses import is_dataclass

KEYS = ["metadata", "summary", "validation", "drift", "profile", "findings", "health", "repair", "health_after", "robustness", "elasticity", "importance"]


def plain(value):
    if is_dataclass(value) and not isinstance(value, type):
        return plain({k: v for k, v in vars(value).items() if type(v).__name__ not in ("DataFrame", "PipelineModel")})
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    return value if isinstance(value, (int, float, bool, type(None))) else str(value)


def as_json(results: dict) -> str:
    return json.dumps({k: plain(results.get(k)) for k in KEYS}, indent=2, default=str)


def _table(rows: list[dict]) -> str:
    if not rows:
        return "<p>none</p>"
    names = list(rows[0])
    head = "".join(f"<th>{html.escape(str(n))}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r.get(n, '')))}</td>" for n in names) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def _section(title: str, value) -> str:
    if isinstance(value, list) and all(isinstance(v, dict) for v in value):
        inner = _table(value)
    elif isinstance(value, dict):
        inner = _table([{"item": k, "value": json.dumps(v, default=str)[:400]} for k, v in value.items()])
    else:
        inner = f"<p>{html.escape(str(value))}</p>"
    return f"<section><h2>{html.escape(title)}</h2>{inner}</section>"


def as_html(results: dict, title: str = "Dataset report") -> str:
    parts = "".join(_section(k.replace("_", " "), plain(results[k])) for k in KEYS if results.get(k) is not None)
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font-family:sans-serif;margin:2em}}td,th{{border:1px solid #ccc;padding:.2em .5em}}</style></head><body><h1>{html.escape(title)}</h1>{parts}</body></html>"


def write_reports(results: dict, folder: str) -> list[str]:
    """Reports are small and are written by the driver."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for name, text in (("report.json", as_json(results)), ("report.html", as_html(results))):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as out:
            out.write(text)
        names.append(name)
    return names
