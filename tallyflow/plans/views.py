"""Data behind the charts of a dashboard, for a chosen range of months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.columns import named
from tallyflow.functions.text import title_label
from tallyflow.operators.filters import months_between, require_one_of
from tallyflow.operators.reshape import stat_rows, union_by_name
from tallyflow.operators.rollups import (
    correlation,
    default_range,
    largest_total,
    largest_value,
    peak_in_range,
    total_in_range,
)
from tallyflow.schemas import DEFAULT_RANGE_END, SnapshotSpec

PEAK_STAT = "Confirmed_monthly_new"


def time_series(
    joined: DataFrame, stat: str, start: str, end: str, spec: SnapshotSpec = SnapshotSpec()
) -> DataFrame:
    """Month, label and value of the chosen stat, and the flows."""
    require_one_of("stat", stat, spec.month_stats)
    return months_between(joined, start, end).select(
        "month",
        title_label(F.lit(stat)).alias("label"),
        named(stat).alias("value"),
        "flight_count",
    )


def stat_correlation(
    joined: DataFrame, stat: str, start: str, end: str, spec: SnapshotSpec = SnapshotSpec()
) -> DataFrame:
    """One row: correlation of the stat with the flows, plain and for display."""
    require_one_of("stat", stat, spec.month_stats)
    r = correlation(months_between(joined, start, end), stat, "flight_count")
    return r.withColumn("shown", F.round("r", 2))


def origin_flows(pairs: DataFrame, start: str, end: str) -> DataFrame:
    """Flows per origin country in the range."""
    return total_in_range(pairs, "origin_country", "flight_count", start, end)


def country_peaks(cases: DataFrame, start: str, end: str) -> DataFrame:
    """Largest number of new cases in a month of the range, per country.

    ``cases`` is the table of a row per month and country, or its long form.
    """
    return peak_in_range(stat_rows(cases, PEAK_STAT), "country", "value", start, end)


def series_map_views(marts: dict[str, DataFrame], start: str, end: str) -> dict[str, DataFrame]:
    """The maps over a wide series and flows by destination, as ``series_marts`` makes them."""
    area = next(c for c in marts["monthly_cases"].columns if c not in ("month", "Confirmed"))
    return {
        "flows": total_in_range(marts["destination_flows"], "end_country", "flights", start, end),
        "peaks": peak_in_range(marts["monthly_cases"], area, "Confirmed", start, end),
    }


def opening_range(df: DataFrame) -> DataFrame:
    """The range a dashboard opens with: from the first month to the usual end, if it is there."""
    return default_range(df, DEFAULT_RANGE_END)


def map_scales(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: the largest flow total and the largest peak over all months.

    They cover all months, so they stay the same as the range moves.
    """
    flow_scale = largest_total(pairs, "origin_country", "flight_count", "max_flights")
    case_scale = largest_value(stat_rows(cases, PEAK_STAT), "value", "max_cases")
    return union_by_name([flow_scale, case_scale]).agg(
        F.max("max_flights").alias("max_flights"), F.max("max_cases").alias("max_cases")
    )


def map_views(pairs: DataFrame, cases: DataFrame, start: str, end: str) -> dict[str, DataFrame]:
    """Everything a pair of maps shows for a range."""
    return {
        "flows": origin_flows(pairs, start, end),
        "peaks": country_peaks(cases, start, end),
        "scales": map_scales(pairs, cases),
    }
