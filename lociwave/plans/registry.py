"""Registration of queries: a name, its plan and the statement it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lociwave.sources.views import oracle_views

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: str = "", name: str | None = None) -> Callable[[Plan], Plan]:
    """Registers the function under its name; ``views`` are put before ``sql`` as a WITH list (sql may go on with ', x AS ...')."""

    def add(plan: Plan) -> Plan:
        own = name or plan.__name__
        QUERIES[own] = plan
        if sql is not None:
            ORACLES[own] = f"WITH RECURSIVE {oracle_views(*views.split())}{sql}" if views else sql
        return plan

    return add
