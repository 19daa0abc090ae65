"""Every operator run on whole warehouse tables, with the same query in SQL.

The tables take the roles of the two families of data: a line item is a flow
from the supplier's nation to the customer's nation on its ship date, and a
report of quantities for the customer's nation on the order date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_checks() -> tuple[dict[str, Query], dict[str, str]]:
    from tallyflow.checks import (
        flow_checks,
        mart_checks,
        series_checks,
        snapshot_checks,
        source_checks,
    )

    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in (source_checks, snapshot_checks, flow_checks, mart_checks, series_checks):
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql
