"""The registered queries of the linkage engine and their SQL equivalents."""

from __future__ import annotations

from kinloom.plans import decisions, linkage, relational, resolution, sourcing, textual

MODULES = [sourcing, relational, textual, decisions, linkage, resolution]


def queries() -> dict:
    return {name: f for m in MODULES for name, (f, _) in m.REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.REGISTRY.items() if sql}
