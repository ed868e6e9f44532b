"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shiftlens.operators.metrics import evaluate_scores
from shiftlens.plans import (  # noqa: F401
    join_queries,
    metric_queries,
    report_queries,
    text_queries,
)
from shiftlens.plans.registry import ORACLES, QUERIES
from shiftlens.plans.views import Views


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluate the leave-one-out answer shift and its parts as monitors."""
    return evaluate_scores(Views(spark, folder).scores, ["component"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Return name -> (session, folder) -> DataFrame."""

    def bind(build):
        return lambda spark, folder: build(Views(spark, folder))

    return {name: bind(build) for name, build in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Return name -> SQL."""
    return dict(ORACLES)
