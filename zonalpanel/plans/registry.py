"""Registered queries: a Spark plan and, where SQL can say it, the SQL to check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .inputs import Inputs, with_inputs

PLANS: dict[str, Callable[[Inputs], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(needs: str = "", sql: str | None = None):
    """Register a plan under its function's name, with SQL over the inputs in ``needs``."""

    def add(plan: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        name = plan.__name__
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            CHECKS[name] = with_inputs(needs, sql)
        return plan

    return add


def _runner(plan: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(Inputs(spark, sf_dir))


def _load() -> None:
    from . import (  # noqa: F401
        queries_classes,
        queries_columns,
        queries_geo,
        queries_joins,
        queries_sources,
        queries_statistics,
        studies,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _runner(plan) for name, plan in PLANS.items()}


def checks() -> dict[str, str]:
    _load()
    return dict(CHECKS)
