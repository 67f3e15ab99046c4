"""Registry of catalogue queries: name -> (query, operator ids, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    implements: tuple[str, ...]
    run: Query
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, implements: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a catalogue query; ``implements`` lists operator ids separated by blanks."""

    def wrap(run: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(name, tuple(implements.split()), run, oracle)
        return run

    return wrap
