"""Registry of the queries over planning data and of the SQL that states each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import demand, evidence, lines, network, obligations, places, routing, rules, spatial, stream

_PLANS = demand.PLANS | evidence.PLANS | spatial.PLANS | network.PLANS | stream.PLANS | rules.PLANS | lines.PLANS | routing.PLANS | places.PLANS | obligations.PLANS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _PLANS.items() if sql}
