"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.functions import scalars, vectors  # noqa: F401  these modules register their queries
from millrace.operators import aggregates, joins, scans, windows  # noqa: F401
from millrace.plans import stateful  # noqa: F401
from millrace.plans.registry import ORACLE, QUERIES
from millrace.streaming import events  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
