"""Group aggregates; each has a partial step before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.calendar import month_text, utc_day
from tallyflow.functions.columns import named
from tallyflow.functions.stats import pearson
from tallyflow.operators.filters import months_between, require_one_of, with_values
from tallyflow.schemas import REJECTED, SnapshotSpec

ROWS = "report_rows"
REJECTS = "rejected_rows"
SUPERSEDED = "superseded_rows"
REVISIONS = ("all", "latest")


def area_day_totals(
    reports: DataFrame,
    spec: SnapshotSpec,
    day: str = "date",
    *,
    revisions: str = "all",
    version: Column | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Sums of the measures per day and area, and the number of rows summed.

    Nothing is filtered: whether a row is valid depends on the two keys alone,
    so quality counts can be taken from this small table instead of a second
    pass over the reports. Malformed rows of a scan that keeps them add to the
    group without day and area, and there only to the number of rejected rows.
    ``extra`` columns, such as the file of a row, join the key.

    ``revisions="latest"`` is for files that repeat reports of other periods: of
    all rows of a place and day the one with the largest ``version`` counts, and
    the rest are counted as superseded. See :func:`latest_reports`.
    """
    require_one_of("revisions", revisions, REVISIONS)
    read = F.lit(True)
    if REJECTED in reports.columns:
        read = named(REJECTED).isNull()
    values = {day: utc_day(reports, spec.stamp), spec.area: named(spec.area)}
    values.update({m: named(m) for m in spec.measures})
    if revisions == "latest":
        values.update({p: named(p) for p in spec.places})
        values.update({_STAMP: named(spec.stamp), _VERSION: F.lit(0) if version is None else version})
    rows = reports.select(
        *[F.when(read, value).alias(name) for name, value in values.items()],
        *[named(e) for e in extra],
        read.alias("_read"),
    )
    counts = [F.count_if("_read").alias(ROWS), F.count_if(~F.col("_read")).alias(REJECTS)]
    if revisions == "latest":
        rows = latest_reports(
            rows, [day, spec.area, *spec.places, *extra, "_read"], [_VERSION, _STAMP], spec.measures
        )
        lines = F.col(SAME_REPORT)
        counts = [
            F.count_if("_read").alias(ROWS),
            F.sum(F.when(F.col("_read"), 0).otherwise(lines)).alias(REJECTS),
            F.sum(F.when(F.col("_read"), lines - 1).otherwise(0)).alias(SUPERSEDED),
        ]
    return rows.groupBy(day, spec.area, *extra).agg(
        *[F.sum(named(m)).alias(m) for m in spec.measures], *counts
    )


def values_name(measure: str) -> str:
    return f"{measure}_values"


def day_states(
    reports: DataFrame, spec: SnapshotSpec, day: str = "date", *, extra: Sequence[str] = ()
) -> DataFrame:
    """What :func:`area_day_totals` sums up, as states that can be added and taken away.

    Beside each sum stands the number of its values, which tells an empty sum from 0.
    """
    read = F.lit(True)
    if REJECTED in reports.columns:
        read = named(REJECTED).isNull()
    values = {day: utc_day(reports, spec.stamp), spec.area: named(spec.area)}
    values.update({m: named(m) for m in spec.measures})
    rows = reports.select(
        *[F.when(read, value).alias(name) for name, value in values.items()],
        *[named(e) for e in extra],
        read.alias("_read"),
    )
    sums = [(F.coalesce(F.sum(named(m)), F.lit(0)).alias(m), F.count(named(m)).alias(values_name(m))) for m in spec.measures]
    return rows.groupBy(*extra, day, named(spec.area)).agg(
        *[c for pair in sums for c in pair],
        F.count_if("_read").alias(ROWS),
        F.count_if(~F.col("_read")).alias(REJECTS),
    )


def state_columns(spec: SnapshotSpec) -> list[str]:
    return [c for m in spec.measures for c in (m, values_name(m))] + [ROWS, REJECTS]


def negated_states(states: DataFrame, spec: SnapshotSpec) -> DataFrame:
    return states.withColumns({c: -named(c) for c in state_columns(spec)})


def merged_states(states: DataFrame, keys: Sequence[str], spec: SnapshotSpec) -> DataFrame:
    """States per key, without those that nothing is left of."""
    merged = states.groupBy(*[named(k) for k in keys]).agg(*[F.sum(named(c)).alias(c) for c in state_columns(spec)])
    return merged.filter((F.col(ROWS) != 0) | (F.col(REJECTS) != 0))


def totals_of_states(states: DataFrame, spec: SnapshotSpec, day: str = "date") -> DataFrame:
    """The totals that states stand for."""
    sums = [F.when(named(values_name(m)) != 0, named(m)).alias(m) for m in spec.measures]
    return states.select(day, named(spec.area), *sums, ROWS, REJECTS)


_STAMP, _VERSION, SAME_REPORT = "_stamp", "_version", "_rows_of_report"


def latest_reports(
    rows: DataFrame, keys: Sequence[str], version: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """One row per key, with the values of its latest version and the number of its rows.

    The latest is a maximum of (version, values), so it can be taken in parts, in any
    order, before and after a shuffle; rows of one version with different values
    leave the larger ones. Places are part of the key, so the rows of an area with
    most of the reports spread over as many groups as it has places and days.
    """
    state = F.max(F.struct(*[named(c) for c in (*version, *values)])).alias("_latest")
    grouped = rows.groupBy(*[named(k) for k in keys]).agg(state, F.count("*").alias(SAME_REPORT))
    return grouped.select(
        *[named(k) for k in keys],
        *[F.col("_latest").getField(v).alias(v) for v in values],
        SAME_REPORT,
    )


def area_months(
    days: DataFrame,
    spec: SnapshotSpec,
    *,
    day: str = "date",
    month: str = "year_month",
    closing: str = "max",
    extra: Sequence[str] = (),
) -> DataFrame:
    """Country-month table from the country-day table.

    ``closing`` is the cumulative value of a month: its ``max``, or its
    ``last`` value by day for series that may fall. ``extra`` columns, such as
    the batch of a day, join the key.
    """
    require_one_of("closing", closing, ["max", "last"])

    def close(column: str):
        value = named(column)
        return F.max(value) if closing == "max" else F.max_by(value, named(day))

    return (
        days.withColumn(month, month_text(named(day)))
        .groupBy(month, spec.area, *extra)
        .agg(
            *[close(c).alias(c) for c in spec.cumulative],
            *[F.sum(named(d)).alias(m) for d, m in zip(spec.daily_new, spec.monthly_new)],
        )
    )


def total_by(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums per key; rows with a NULL key are left out, an empty sum is 0."""
    return recombined(df, keys, values, combine="sum")


def recombined(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], combine: str = "sum"
) -> DataFrame:
    """One row per key from batches that may overlap.

    ``sum`` adds overlapping batches up; ``max`` takes the larger value, which
    is the sound reading of a cumulative measure. NULL counts as 0, and rows
    with a NULL key are left out.
    """
    require_one_of("combine", combine, ["sum", "max"])
    merge = F.sum if combine == "sum" else F.max
    return (
        with_values(df, keys)
        .groupBy(*keys)
        .agg(*[F.coalesce(merge(named(v)), F.lit(0)).alias(v) for v in values])
    )


def total_in_range(
    df: DataFrame, by: str, value: str, start: str, end: str, month: str = "month"
) -> DataFrame:
    return (
        with_values(months_between(df, start, end, month), [by])
        .groupBy(by)
        .agg(F.coalesce(F.sum(named(value)), F.lit(0)).alias(value))
    )


def peak_in_range(
    df: DataFrame, by: str, value: str, start: str, end: str, month: str = "month"
) -> DataFrame:
    return (
        with_values(months_between(df, start, end, month), [by])
        .groupBy(by)
        .agg(F.max(named(value)).alias(value))
    )


def largest_total(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """One row: the largest of the sums per group."""
    totals = with_values(df, [by]).groupBy(by).agg(F.sum(named(value)).alias("total"))
    return totals.agg(F.max("total").alias(name))


def largest_value(df: DataFrame, value: str, name: str) -> DataFrame:
    return df.agg(F.max(named(value)).alias(name))


def area_month_series(
    daily: DataFrame, area: str, day: str, value: str, *, how: str = "sum", month: str = "month"
) -> DataFrame:
    """Monthly value of a daily series that has several rows per area.

    ``sum`` adds all rows of the month up. A cumulative series wants ``max``:
    the rows of a day are added up, and the largest day counts.
    """
    require_one_of("how", how, ["sum", "max"])
    months = month_text(utc_day(daily, day)).alias(month)
    if how == "sum":
        return daily.groupBy(named(area), months).agg(F.sum(named(value)).alias(value))
    days = daily.groupBy(named(area), named(day)).agg(F.sum(named(value)).alias(value))
    return days.groupBy(named(area), months).agg(F.max(named(value)).alias(value))


def correlation(
    df: DataFrame, x: str, y: str, *, by: Sequence[str] = (), name: str = "r"
) -> DataFrame:
    """Pearson correlation, over the frame or per group."""
    r = pearson(named(x), named(y)).alias(name)
    return df.groupBy(*[named(b) for b in by]).agg(r) if by else df.agg(r)


def month_domain(df: DataFrame, month: str = "month") -> DataFrame:
    """The distinct months, in order."""
    return df.select(named(month)).distinct().orderBy(named(month))


def default_range(df: DataFrame, cut: str | None = None, month: str = "month") -> DataFrame:
    """One row: first month, and the month ``cut`` if present or the last one."""
    value = named(month)
    end = F.max(value)
    if cut is not None:
        end = F.coalesce(F.max(F.when(value == cut, value)), end)
    return df.agg(F.min(value).alias("range_start"), end.alias("range_end"))
