"""Every query of the engine by name, with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "band_energy"


def query(name: str, oracle: str | None = None):
    """Registers a query and, where SQL can say it, its SQL."""

    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def load() -> None:
    """Imports the modules that register queries."""
    from quadrille.plans import camera_queries, colour_queries, layout_queries, live_queries, round_trips, signal_queries  # noqa: F401


load()
