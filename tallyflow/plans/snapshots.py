"""Country-day and country-month tables from cumulative reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tallyflow.functions.columns import named
from tallyflow.operators.deltas import (
    GAPS,
    RESETS,
    carried_resets,
    filled_days,
    reset_events,
    step_changes,
    without_drops,
)
from tallyflow.operators.filters import among, plausible_areas, require_one_of, valid_days
from tallyflow.operators.rollups import area_day_totals, area_months
from tallyflow.schemas import SnapshotSpec


def valid_totals(
    totals: DataFrame, spec: SnapshotSpec, areas: Iterable[str] | None = None
) -> DataFrame:
    """Day totals of valid days and plausible areas, under the names of cumulative measures."""
    kept = plausible_areas(valid_days(among(totals, spec.area, areas), "date", spec), spec.area)
    return kept.select(
        "date",
        named(spec.area),
        *[named(m).alias(c) for m, c in zip(spec.measures, spec.cumulative)],
    )


def days_from_totals(
    totals: DataFrame,
    spec: SnapshotSpec,
    areas: Iterable[str] | None = None,
    *,
    gaps: str = "keep",
    resets: str = "keep",
) -> DataFrame:
    """Country-day table: cumulative measures and their change by day.

    The change is taken within an area. Filters on the two keys pass below
    the aggregate, so unwanted areas and days are dropped at the scan.
    ``resets="carry"`` adds what a total falls to all its later values, and ``gaps``
    gives days without a report a total of their own: see
    :func:`tallyflow.operators.deltas.carried_resets` and ``filled_days``.
    """
    require_one_of("gaps", gaps, GAPS)
    require_one_of("resets", resets, RESETS)
    days = valid_totals(totals, spec, areas)
    if resets == "carry":
        days = without_drops(carried_resets(days, spec.area, "date", spec.cumulative))
    if gaps != "keep":
        days = filled_days(days, spec.area, "date", spec.cumulative, gaps)
    return step_changes(days, spec.area, "date", dict(zip(spec.daily_new, spec.cumulative)))


def total_resets(totals: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """Days on which a total falls: area, date, measure and by how much."""
    carried = carried_resets(valid_totals(totals, spec), spec.area, "date", spec.cumulative)
    return reset_events(carried, spec.area, "date", spec.cumulative)


def area_day_table(
    reports: DataFrame,
    spec: SnapshotSpec = SnapshotSpec(),
    areas: Iterable[str] | None = None,
    *,
    gaps: str = "keep",
    resets: str = "keep",
) -> DataFrame:
    return days_from_totals(area_day_totals(reports, spec), spec, areas, gaps=gaps, resets=resets)


def area_month_table(
    reports: DataFrame,
    spec: SnapshotSpec = SnapshotSpec(),
    areas: Iterable[str] | None = None,
    closing: str = "max",
    *,
    gaps: str = "keep",
    resets: str = "keep",
) -> DataFrame:
    """Country-month table: closing cumulative values and the sum of changes."""
    days = area_day_table(reports, spec, areas, gaps=gaps, resets=resets)
    return area_months(days, spec, closing=closing)
