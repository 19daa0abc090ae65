"""Row filters and name mapping."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.calendar import within_years
from tallyflow.functions.columns import named
from tallyflow.functions.text import all_digits
from tallyflow.schemas import SnapshotSpec


def among(df: DataFrame, column: str, values: Iterable[str] | None) -> DataFrame:
    """Rows whose value is listed; no list or an empty one keeps all rows."""
    chosen = list(values or [])
    return df.filter(named(column).isin(chosen)) if chosen else df


def with_values(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows with a value in each column.

    Plain ``IS NOT NULL`` conditions, which Catalyst pushes to the scan and
    uses to turn an outer join into an inner one; ``dropna`` has neither.
    """
    return df.filter(reduce(and_, [named(c).isNotNull() for c in columns]))


def day_in_years(df: DataFrame, column: str, spec: SnapshotSpec) -> Column:
    """True for a known day in the valid years, else false and never NULL."""
    inside = within_years(df, column, spec.first_year, spec.last_year)
    return F.coalesce(inside, F.lit(False))


def abnormal_days(df: DataFrame, column: str, spec: SnapshotSpec) -> DataFrame:
    """Rows with no day, or with a day outside the valid years."""
    return df.filter(~day_in_years(df, column, spec))


def valid_days(df: DataFrame, column: str, spec: SnapshotSpec) -> DataFrame:
    """The complement of :func:`abnormal_days`."""
    return df.filter(within_years(df, column, spec.first_year, spec.last_year))


def plausible_areas(df: DataFrame, column: str) -> DataFrame:
    """Drops areas whose name is a number."""
    return df.filter(~all_digits(named(column)))


def months_between(df: DataFrame, start: str, end: str, month: str = "month") -> DataFrame:
    """Both ends included; months are ``yyyy-MM`` text."""
    return df.filter(named(month).between(start, end))


def renamed_areas(name: Column, aliases: Mapping[str, str]) -> Column:
    """The name in the other naming system, or the name itself."""
    if not aliases:
        return name
    pairs = [F.lit(part) for pair in aliases.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def require_one_of(what: str, value: str, allowed: Iterable[str]) -> str:
    options = list(allowed)
    if value not in options:
        raise ValueError(f"{what} must be one of {options}, not {value!r}")
    return value
