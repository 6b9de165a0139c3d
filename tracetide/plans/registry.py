"""All registered queries: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "capture_plans", "flow_plans", "series_plans", "expression_plans", "quality_plans", "planner_plans",
    "session_plans", "source_plans", "report_plans",
)


def registry() -> dict:
    out: dict = {}
    for name in MODULES:
        part = import_module(f"{__package__}.{name}").QUERIES
        clash = set(out) & set(part)
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out
