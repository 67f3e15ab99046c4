"""Collects the query modules."""

from __future__ import annotations

from strandflow.plans import coding, containers, corpus, events, functions, media, orders, streams  # noqa: F401
from strandflow.registry import REGISTRY, Query


def queries() -> dict[str, Query]:
    return {name: entry.run for name, entry in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.oracle for name, entry in REGISTRY.items() if entry.oracle}
