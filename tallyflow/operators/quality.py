"""Quality counts as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.columns import named
from tallyflow.functions.stats import share_pct
from tallyflow.functions.text import all_digits
from tallyflow.operators.filters import abnormal_days, day_in_years
from tallyflow.schemas import SnapshotSpec


def null_profile(df: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: NULLs per column.

    ``weight`` names a column that tells how many raw rows a row stands for.
    """

    def nulls(column: str) -> Column:
        missing = named(column).isNull()
        if weight is None:
            return F.count_if(missing)
        return F.coalesce(F.sum(F.when(missing, named(weight))), F.lit(0))

    return df.agg(*[nulls(c).alias(c) for c in df.columns if c != weight])


def day_audit(
    df: DataFrame, day: str, spec: SnapshotSpec, weight: str | None = None
) -> DataFrame:
    """One row: rows, rows with an abnormal day and their share, odd areas.

    An empty batch has a share of NULL.
    """
    bad = ~day_in_years(df, day, spec)
    odd = all_digits(named(spec.area))
    if weight is None:
        rows, abnormal, numbered = F.count("*"), F.count_if(bad), F.count_if(odd)
    else:
        size = named(weight)
        rows, abnormal, numbered = (
            F.coalesce(F.sum(x), F.lit(0))
            for x in (size, F.when(bad, size), F.when(odd, size))
        )
    return df.agg(
        rows.alias("rows"),
        abnormal.alias("abnormal_days"),
        share_pct(abnormal, rows).alias("abnormal_days_pct"),
        numbered.alias("numbered_areas"),
    )


def abnormal_sample(
    df: DataFrame, day: str, spec: SnapshotSpec, order: Sequence[str], n: int = 10
) -> DataFrame:
    """The first ``n`` abnormal rows in the given order, as a top-n."""
    return abnormal_days(df, day, spec).orderBy(*[named(c) for c in order]).limit(n)


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """A preview: sorts as a top-n and never collects the rest."""
    return df.orderBy(*[named(c) for c in order]).limit(n)


def report_lines(one_row: DataFrame, section: str) -> DataFrame:
    """A row of counts as lines of section, metric and value."""
    even = one_row.select(*[named(c).cast("double").alias(c) for c in one_row.columns])
    lines = even.unpivot([], [named(c) for c in one_row.columns], "metric", "value")
    return lines.select(F.lit(section).alias("section"), "metric", "value")
